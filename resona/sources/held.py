"""Intermediate tables, written where all executors reach them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder (spark.checkpoint.dir); where that is unset, a folder of this machine, if Spark runs on it alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='resona-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def held(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read from there: its lineage ends, lost executors don't matter, and several branches share it."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Remove a written table that nothing will read again."""
    spark = table.sparkSession
    for name in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dealt(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """df, which is made of rows that repartition(n, key) dealt out, written once in n buckets of key, a file each: what is grouped by the key, among others, needs no shuffle."""
    spark, known = df.sparkSession, f"resona_{name}_{uuid.uuid4().hex[:12]}"
    df.write.option("path", f"{root(spark)}/{known}").bucketBy(n, key).saveAsTable(known)
    return spark.table(known)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as the cluster runs at once, if its files make fewer (a file of one row group is one task); else df as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
