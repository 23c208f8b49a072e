"""From raw documents to a token store: quality, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it returned, and works on all of it.
All but the last return the columns of `documents`; other columns of docs are not read and not returned. A document
that is mixed in several times has as many rows. Texts are read whole, however long. Empty docs give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resona.llm import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Of the mixing, which the order of the token store follows too.
SEED = 17
#: Not expressible in SQL: a trained model, a tokenizer.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier than not of the top grade (toxic 0, low quality 1, good 2).

    Null and empty texts are judged as texts without features, rows of one id and equal rows one by one. Null ids are not
    rated but judged. A model that learnt nothing, as from too few ratings, rejects nothing.
    """
    from resona.llm.quality import score, train
    from resona.llm.queries import grade

    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), grade(), 3)
    if not model.informed:
        return docs.select(*COLUMNS)
    return score(docs.select(*COLUMNS), model, 2).where("tail_probability >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that similarity of 0.8 or more connects, the one with the least id.

    A null id is chosen only where no other is there; of equal ids the one of the least text digest is, and of rows equal in
    id and text one stays. Texts without words, null ones too, are like no others and stay.
    """
    from resona.llm.ngram_join import one_of_each

    return one_of_each(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, up to one edit in 20 characters.

    Null and empty texts stay, as do all where the benchmark is empty; null ids and repeated rows are judged one by one.
    """
    from resona.llm.decontaminate import decontaminate

    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights by repeating documents, in a shuffled order.

    Null is a source of its own; one whose texts are all empty keeps its rate of 1. Rows equal in id and text draw the same
    number of copies; null ids draw by their text.
    """
    from resona.llm.mixing import mix

    return mix(docs.select(*COLUMNS), SEED).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A token store in the mixed order, read back: doc_id, replica, start, n_tokens, ids_crc32.

    The copies of a document are numbered anew (equal rows are alike, so it doesn't matter which is which); number, id and
    text give each its place in the mix, and the store is keyed by that place. Null texts are the end id alone; null ids
    stay null; rows equal in id and text count as copies; places that two rows share are told apart by text.
    """
    import public_tokenizers
    from resona.llm.mixing import placed
    from resona.llm.token_store import token_store

    alike = Window.partitionBy("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).orderBy(F.lit(0))
    copies = docs.select("doc_id", "text").withColumn("replica", F.row_number().over(alike) - 1)
    keyed = copies.withColumn("position", F.floor(placed(SEED, "doc_id") * float(1 << 52)).cast("long"))
    out = token_store(keyed, public_tokenizers.path("byte_bpe_50k.json"), 2, "position", ("doc_id", "replica"))
    return out.select("doc_id", "replica", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality_classifier", quality),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_store", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
