"""Query complexity: n-gram and lexical features, logistic regression, cross-validation, and a model that is kept."""

from __future__ import annotations

import math

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from resona.functions.text import ascii_turkish, lexical_features

METRICS = ("accuracy", "f1", "precision", "recall", "roc_auc")
#: A word; the texts that an n-gram has to be in, the n-grams of each kind at most and the number of lexical features.
WORD, LEAST, VOCABULARY, LEXICAL = r"(?U)\b\w\w+\b", 3, 1 << 18, 9


class _Column(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer that adds one column expression."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def expression(self, column: Column) -> Column:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), self.expression(F.col(self.getInputCol())))


class Folded(_Column):
    """Small letters, Turkish ones as ASCII."""

    def expression(self, column: Column) -> Column:
        return ascii_turkish(column)


class WordNGrams(_Column):
    """Runs of one to three words, a word having two letters, digits or underscores at least."""

    def expression(self, column: Column) -> Column:
        def runs(words: Column) -> Column:
            of = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
            return F.concat(words, of(2), of(3))

        words = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(WORD), F.lit(0))
        return F.get(F.transform(F.array(words), runs), F.lit(0))


class CharNGrams(_Column):
    """Runs of two to five characters inside words that a space begins and ends."""

    def expression(self, column: Column) -> Column:
        words = F.filter(F.split(F.coalesce(column, F.lit("")), r"(?U)\s+"), lambda w: w != "")

        def grams(word: Column) -> Column:
            n = F.length(word)
            sizes = F.sequence(F.lit(2), F.least(n, F.lit(5)))
            return F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(word, i, k))))

        return F.flatten(F.transform(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), grams))


class Lexical(_Column):
    """The nine lexical features of a folded query as a vector; terms: domain words."""

    terms = Param(Params._dummy(), "terms", "domain words", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, terms: list[str] | None = None) -> None:
        Transformer.__init__(self)
        self._setDefault(terms=[])
        self._set(**self._input_kwargs)

    def expression(self, column: Column) -> Column:
        from pyspark.ml.functions import array_to_vector

        names = self.getOrDefault(self.terms)
        words = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
        features = lexical_features(F.coalesce(column, F.lit("")), words)
        fields = ("n_tokens", "n_chars", "paired_question", "versus", "comparison", "alternative", "domain_terms", "question_suffix", "type_token_ratio")
        return array_to_vector(F.array(*(features[n] for n in fields)))


class Weighed(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """(1 + ln count) * (idf + 1) of the terms, to length 1; inputs: the counts, and the counts times idf."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pyspark.ml.linalg import SparseVector, VectorUDT

        @F.udf(returnType=VectorUDT())
        def weigh(counts, weighted):
            known = dict(zip(weighted.indices.tolist(), weighted.values.tolist(), strict=True))
            values = [(1 + math.log(c)) * (known.get(i, 0.0) / c + 1) for i, c in zip(counts.indices.tolist(), counts.values.tolist(), strict=True)]
            norm = math.sqrt(sum(v * v for v in values)) or 1.0
            return SparseVector(counts.size, counts.indices, [v / norm for v in values])

        return dataset.withColumn(self.getOutputCol(), weigh(*self.getInputCols()))


def training(spark: SparkSession, path: str) -> DataFrame:
    """id, label (1: complex), text of the JSON lines at path; a line that isn't JSON, or has no query, has a problem and no label."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.col("value"), F.try_variant_get(F.try_parse_json("value"), "$", "struct<query: string, label: string>").alias("r"))
    problem = F.when(F.col("r").isNull(), "not JSON").when(F.col("r.query").isNull(), "no query")
    label = F.when(problem.isNull(), (F.coalesce("r.label", F.lit("simple")) == "complex").cast("int"))
    return lines.select(F.xxhash64("value").alias("id"), label.alias("label"), F.col("r.query").alias("text"), problem.alias("problem"))


def domain_words(spark: SparkSession, path: str) -> list[str]:
    """The terms of a JSON file {"terms": [...]}: a list that fits the driver, being part of a model."""
    row = spark.read.text(path, wholetext=True).select(F.try_variant_get(F.try_parse_json("value"), "$.terms", "array<string>")).first()
    return list(row[0] or []) if row else []


def shaping(terms: list[str]) -> list[Transformer]:
    """The stages that learn nothing."""
    return [Folded(inputCol="text", outputCol="folded"), WordNGrams(inputCol="folded", outputCol="words"), CharNGrams(inputCol="folded", outputCol="chars"), Lexical(inputCol="folded", outputCol="lexical", terms=terms)]


def learning(n: int, steps: int = 100, least: int = LEAST, c: float = 10.0) -> list:
    """Stages for n training rows: words and characters that `least` texts hold, lexical features to mean 0 and deviation 1, L2 of 1 / (c * n), `steps` at most."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, StandardScaler, VectorAssembler

    stages: list = []
    for kind in ("words", "chars"):
        stages += [CountVectorizer(inputCol=kind, outputCol=f"{kind}_n", minDF=least, vocabSize=VOCABULARY), IDF(inputCol=f"{kind}_n", outputCol=f"{kind}_idf"), Weighed(inputCols=[f"{kind}_n", f"{kind}_idf"], outputCol=f"{kind}_w")]
    stages += [StandardScaler(inputCol="lexical", outputCol="scaled", withMean=True)]
    stages += [VectorAssembler(inputCols=["words_w", "chars_w", "scaled"], outputCol="features"), LogisticRegression(regParam=1 / (c * max(n, 1)), maxIter=steps, tol=1e-4, standardization=False)]
    return stages


def fit(labelled: DataFrame, terms: list[str]) -> PipelineModel:
    """The model of (id, label, text); it is written by model.write().save and read by PipelineModel.load."""
    return Pipeline(stages=[*shaping(terms), *learning(labelled.count())]).fit(labelled)


def predict(model: PipelineModel, queries: DataFrame, threshold: float = 0.55) -> DataFrame:
    """The columns of queries with is_complex and confidence, that of the side which was taken."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")[1]
    scored = model.transform(queries.withColumn("text", F.coalesce("text", F.lit(""))))
    return scored.select(*queries.columns, (p >= threshold).alias("is_complex"), F.when(p >= threshold, p).otherwise(1 - p).alias("confidence"))


def folds(labelled: DataFrame, n: int) -> DataFrame:
    """Stratified: the k-th row of a class by hash goes to fold k mod n.

    Rows are numbered within ranges of hashes, after those of the ranges before, so that no class is one task's.
    """
    ranged = labelled.withColumn("_range", F.shiftright(F.xxhash64("id"), 52))
    sizes = ranged.groupBy("label", "_range").agg(F.count("*").alias("_n"))
    before = sizes.select("label", "_range", F.coalesce(F.sum("_n").over(Window.partitionBy("label").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    before = F.broadcast(before.select(F.col("label").alias("_label"), F.col("_range").alias("_of"), "_before"))  # at most 4096 rows a class
    order = Window.partitionBy("label", "_range").orderBy(F.xxhash64("id"), "id")
    placed = ranged.withColumn("_k", F.row_number().over(order)).join(before, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_of")))
    return placed.select(*labelled.columns, ((F.col("_before") + F.col("_k")) % n).cast("int").alias("fold"))


def cross_validate(labelled: DataFrame, terms: list[str], n: int = 5, steps: int = 100) -> DataFrame:
    """metric, mean, spread (population deviation) of METRICS over n stratified folds.

    Texts are dealt over all tasks before their features are made. N-grams are counted as hashes, by fold, once; a fold's vocabulary is
    what the others' counts leave (as `learning` has it: those of `least` texts, the most frequent if there are too many), and its
    features are written once and removed when it is judged, so that those of one fold need disk and memory at a time.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    from resona.operators import ngrams
    from resona.sources.held import drop, held

    spark = labelled.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, labelled.rdd.getNumPartitions())
    dealt = Folded(inputCol="text", outputCol="folded").transform(folds(labelled, n).repartition(tasks, "id"))
    words = F.transform(F.regexp_extract_all(F.coalesce("folded", F.lit("")), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.coalesce("folded", F.lit("")), r"(?U)\s+", "  "), F.lit(" "))
    lexical = vector_to_array(Lexical(inputCol="folded", outputCol="lexical", terms=terms).expression(F.col("folded")))
    rows = held(dealt.select("fold", words.alias("words"), spaced.alias("spaced"), "id", "label", lexical.alias("lexical")), "folds")
    seen = rows.select("fold", "words", "spaced").mapInArrow(ngrams.frequencies, "kind int, term long, fold int, df long, tf long")
    of = lambda c, k: F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}_{k}")
    # dealt out first: most n-grams are in one text, and sums by fold before the shuffle would only spill
    seen = seen.repartition("kind", "term").groupBy("kind", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"), *(of(c, k) for c in ("df", "tf") for k in range(n)))
    seen = held(seen.where(F.col("df") >= LEAST), "vocabulary")
    columns = StructType([*rows.select("fold", "id", "label").schema.fields, StructField("features", VectorUDT())])

    def vocabulary(k: int, kind: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes, sorted, and idf of a kind's n-grams, VOCABULARY at most."""
        own = seen.where(F.col("kind") == kind).select("term", (F.col("df") - F.col(f"df_{k}")).alias("df"), (F.col("tf") - F.col(f"tf_{k}")).alias("tf")).where(F.col("df") >= LEAST)
        most = own.orderBy(F.desc("tf"), "term").limit(VOCABULARY) if own.count() > VOCABULARY else own
        found = most.select("term", "df").toArrow()
        names, df = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
        order = np.argsort(names)
        return names[order], np.log((texts + 1) / (df[order] + 1.0))

    def judge(k: int) -> DataFrame:
        others = rows.where(F.col("fold") != k)
        parts = [F.col("lexical")[i] for i in range(LEXICAL)]
        texts, *moments = others.agg(F.count("*"), *map(F.avg, parts), *map(F.stddev_samp, parts)).first()
        mean, deviation = (np.array(m, float) for m in (moments[:LEXICAL], moments[LEXICAL:]))  # null is NaN
        scale = np.divide(1.0, deviation, out=np.zeros(LEXICAL), where=deviation > 0)
        known = spark.sparkContext.broadcast(tuple(zip(*(vocabulary(k, kind, texts) for kind in range(len(ngrams.KINDS))), strict=True)))
        made = held(rows.mapInArrow(lambda b: ngrams.vectors(b, *known.value, np.nan_to_num(mean), scale), columns), "features")
        classifier = learning(texts, steps)[-1]
        model = classifier.fit(made.where(F.col("fold") != k).coalesce(spark.sparkContext.defaultParallelism))
        judged = held(model.transform(made.where(F.col("fold") == k)).select("fold", "id", "label", vector_to_array("probability")[1].alias("p")), "judged")
        drop(made)
        return judged

    one, *more = [judge(k) for k in range(n)]
    for other in more:
        one = one.unionByName(other)
    return summary(one)


def summary(judged: DataFrame) -> DataFrame:
    """Of (fold, id, label, p): the metrics of each fold, at p >= 0.5, as means and spreads over folds; equal p share their rank in the area under the curve."""
    said, right = F.col("p") >= 0.5, F.col("label") == 1
    mine = Window.partitionBy("fold")
    ranked = judged.withColumn("rank", F.rank().over(mine.orderBy("p")) + (F.count("*").over(Window.partitionBy("fold", "p")) - 1) / 2)
    tp, fp, fn, n = F.count_if(said & right), F.count_if(said & ~right), F.count_if(~said & right), F.count("*")
    ones = F.count_if(right)
    area = (F.sum(F.when(right, F.col("rank"))) - ones * (ones + 1) / 2) / F.nullif(ones * (n - ones), F.lit(0))
    zero = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    each = ranked.groupBy("fold").agg((F.count_if(said == right) / n).alias("accuracy"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"), zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), area.alias("roc_auc"))
    long = each.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS))))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
