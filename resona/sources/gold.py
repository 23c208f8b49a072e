"""Gold sets: expected chunks of questions at three levels, and the metrics of a run at each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.operators.retrieval import judged_metrics

ITEM = "_id string, id string, question string, ground_truth_answer string, fault_type string, expected_chunk_ids array<string>, expected_child_chunk_ids array<string>, expected_parent_chunk_ids array<string>, expected_visual_chunk_ids array<string>"
LEVELS = ("child", "parent", "visual")


def expected(items: DataFrame) -> DataFrame:
    """id, question, fault_type, child, parent, visual: ids wanted at each level, of rows of ITEM.

    id and _id stand for each other. Where children or parents aren't listed they are those of the whole list that do, or don't, have
    'child' in their name; a list without any child is taken as children, too. Visuals are as listed.
    """
    given = lambda name: F.coalesce(F.col(name), F.array().cast("array<string>"))
    whole = given("expected_chunk_ids")
    named = F.filter(whole, lambda x: F.contains(x, F.lit("child")))
    listed = lambda name, other: F.when(F.size(given(name)) > 0, given(name)).otherwise(other)
    child = listed("expected_child_chunk_ids", F.when(F.size(named) > 0, named).otherwise(whole))
    parent = listed("expected_parent_chunk_ids", F.filter(whole, lambda x: ~F.contains(x, F.lit("child"))))
    return items.select(F.coalesce("_id", "id").alias("id"), "question", "fault_type", child.alias("child"), parent.alias("parent"), given("expected_visual_chunk_ids").alias("visual"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """expected() of the JSON array in the file at path; an item that doesn't fit ITEM, or has no id or question, fails the read."""
    items = spark.read.schema(ITEM).option("multiLine", True).option("mode", "FAILFAST").json(path)
    wanted = lambda c: F.coalesce(c, F.raise_error(F.concat(F.lit("a gold item without id or question: "), F.to_json(F.struct("*")))).cast("string"))
    return expected(items.withColumns({"_id": wanted(F.coalesce("_id", "id")), "question": wanted(F.col("question"))}))


def level_metrics(results: DataFrame, gold: DataFrame, k: dict[str, int]) -> DataFrame:
    """query_id, level, recall, precision, hit, mrr, ndcg, each question at each level in one pass.

    results: query_id, level, id, rank. gold: id and an array of ids for each level. k: ranks that count at a level. A level at which
    a question expects nothing has zeros, as has one without results.
    """
    lists = F.array(*(F.struct(F.lit(level).alias("level"), F.array_distinct(level).alias("ids")) for level in LEVELS))
    wanted = gold.select(F.col("id").alias("question"), F.inline(lists))
    key: Column = F.struct("question", "level")
    most = F.create_map(*(F.lit(x) for pair in k.items() for x in pair))
    hits = wanted.select("question", "level", F.explode("ids").alias("id")).withColumn("hit", F.lit(True))
    cut = results.where(F.col("rank") <= F.try_element_at(most, F.col("level"))).withColumnRenamed("query_id", "question")
    judged = cut.join(hits, ["question", "level", "id"], "left").select(key.alias("query_id"), "id", "rank", "hit")
    counted = wanted.select(key.alias("query_id"), F.nullif(F.size("ids").cast("long"), F.lit(0)).alias("wanted"))
    return judged_metrics(judged, counted).select("query_id.question", "query_id.level", "recall", "precision", "hit", "mrr", "ndcg").withColumnRenamed("question", "query_id")
