"""Mixing sources to target weights by Poisson replication.

Each document of a source is repeated a Poisson number of times whose mean brings the source to its target
share of characters; the targets are given, or follow from the sources' sizes. The number comes from inverting the distribution at a uniform value hashed from seed,
document and text, so every run and every retried task draws the same. A large mean is the sum of several such
draws of bounded mean, which is a Poisson number again. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.llm import scratch


def uniform(seed: int, *parts: Column) -> Column:
    """A value in (0, 1) from the first 52 bits of an MD5, the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def counts(u: Column, table: Column) -> Column:
    """The Poisson count at u: how many cumulative probabilities of the source's table lie below u."""
    return F.size(F.filter(table, lambda c: c < u))


def draws(seed: int, key: Column, digest: Column, n: Column) -> Column:
    """n uniform values of a document; the first is that of a single draw, the others hash their number too."""
    numbers = F.sequence(F.lit(1), n)
    # an array of one binds the digest, so that the text is hashed once whatever n is
    each = F.transform(F.array(digest), lambda m: F.transform(numbers, lambda i: uniform(seed, key, F.when(i == 1, m).otherwise(F.concat_ws(":", m, i.cast("string"))))))
    return F.element_at(each, 1)


def placed(seed: int, key: str) -> Column:
    """The place of a copy in the shuffled order, from seed, key, replica and text."""
    return uniform(seed + 1, F.col(key), F.col("replica"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def rates(docs: DataFrame, temperature: float = 0.7, source: str = "source", most: float = 64.0, weights: DataFrame | None = None) -> DataFrame:
    """A row per source (null is a source of its own): chars, weight, rate, draws and cdf.

    weights: columns source and weight, the targets of the mix (null is a source too; of repeats the sum counts; they are made
    to sum to 1 over the sources with characters; a source that isn't there or has no positive weight has target 0 and no copies).
    Without them a source's weight is its share of all characters to the power `temperature`, made to sum to 1. rate: the mean
    number of copies that brings the whole mix back to the size of the input, without a limit. draws: over how
    many independent draws the rate is spread, so that none has a mean above `most`, where exp(-mean) would
    near zero. cdf: cumulative probabilities of 0, 1, 2, .. copies in one draw of mean = rate / draws, as far
    as mean + 12 * sqrt(mean) + 16.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("chars"))
    sizes = scratch.keep(sizes, "sizes")
    power = F.pow(F.col("chars").cast("double"), F.lit(temperature))
    if weights is not None:
        targets = weights.groupBy(F.col("source").alias("_of")).agg(F.sum("weight").alias("_target"))
        # a row per source on either side; a source without characters can't reach any target
        sizes = scratch.keep(sizes.join(targets, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of"), "sizes")
        power = F.when(F.col("chars") > 0, F.greatest(F.coalesce(F.col("_target").cast("double"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    total = sizes.agg(F.sum("chars").alias("chars"), F.sum(power).alias("power")).first()
    out = sizes.withColumn("weight", power / F.lit(total["power"] or 1.0))
    out = out.withColumn("rate", F.when(F.col("chars") > 0, F.col("weight") * F.lit(float(total["chars"] or 0)) / F.col("chars")).otherwise(F.lit(1.0)))
    out = out.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / most).cast("int"))).withColumn("mean", F.col("rate") / F.col("draws"))
    steps = F.expr("sequence(1, cast(ceil(mean + 12 * sqrt(mean) + 16) as int))")
    pmf = F.aggregate(steps, F.array(F.exp(-F.col("mean"))), lambda a, k: F.concat(a, F.array(F.element_at(a, -1) * F.col("mean") / k)))
    cdf = F.aggregate(pmf, F.array().cast("array<double>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + p)))
    return out.select("source", "chars", "weight", "rate", "draws", cdf.alias("cdf"))


def mix(docs: DataFrame, seed: int = 17, temperature: float = 0.7, key: str = "doc_id", source: str = "source", weights: DataFrame | None = None) -> DataFrame:
    """docs with each row repeated its Poisson number of times (perhaps none), in a globally shuffled order.

    Adds replica (from 0) and place, a uniform value by which the rows are sorted over all partitions. Target weights: see rates(). Null and empty texts count no characters; a source of none has rate 1. Rows
    of one key with one text draw the same number; null keys draw by text. Columns called replica and place
    are replaced, other extra columns pass through. An empty table stays empty.
    """
    docs = docs.drop("replica", "place")
    # one row of some hundred bytes per source; written, so that its size is known when the join is planned: Spark
    # broadcasts it below its limit, without dealing out any text by source, and else splits the hot source
    table = scratch.keep(rates(docs, temperature, source, weights=weights).select(F.col("source").alias("_source"), F.col("draws").alias("_draws"), F.col("cdf").alias("_cdf")), "rates")
    joined = docs.join(table, F.col(source).eqNullSafe(F.col("_source")))
    values = draws(seed, F.col(key), F.md5(F.coalesce("text", F.lit("")).cast("binary")), F.col("_draws"))
    drawn = joined.withColumn("_n", F.aggregate(values, F.lit(0), lambda n, u: n + counts(u, F.col("_cdf")))).drop("_source", "_draws", "_cdf")
    copied = drawn.where("_n > 0").withColumn("replica", F.explode(F.expr("sequence(0, _n - 1)"))).drop("_n")
    dealt = copied.withColumn("place", placed(seed, key))
    # places are uniform, so equal ranges are even partitions: no pass is needed to find their bounds
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartitionById(n, F.floor(F.col("place") * n).cast("int")).sortWithinPartitions("place")
