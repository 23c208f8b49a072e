"""Token counts as delta-maintained rollups.

A batch of signed changes (insert +, delete -, revision - old and + new) is summed into one small partial rollup by
source, language and tokenizer version and written to a folder of its own; then the batch's name is entered in the commit
log, by creating a file that must not exist. Totals are the sum over committed batches. A batch that arrives again finds
its name taken and is not applied again, also where two senders commit it at once. Committed partials can be merged. A sender
that dies between creating its entry and writing it has written its partial before: an entry that can't be read stands for the
batch's first complete partial, and a merge that can't be read for nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm import scratch

KEYS = ["source", "lang", "tokenizer"]
PARTIAL = "source string, lang string, tokenizer string, docs long, tokens long"
#: Bits of a bitmap of ids are 2 to this power at most (16 MB), and those of a bucket of it (4 KB).
MARKS, BUCKET = 27, 15


def mark(key: Column, power: int) -> Column:
    """The bit of a key in a bitmap of 2 ** power bits."""
    return F.xxhash64(key).bitwiseAND((1 << power) - 1)


def marks(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap (its bytes, and the power of two of its bits) that every key of a column of longs is in, and few others are: 16 bits a key.

    Its size is bounded: of very many keys it holds more others.
    """
    key = F.col(keys.columns[0])
    power = min(MARKS, max(BUCKET, (16 * keys.count()).bit_length()))
    bit = mark(key, power)
    rows = keys.groupBy(F.shiftright(bit, BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(bit.bitwiseAND((1 << BUCKET) - 1)).alias("bits")).collect()
    out = np.zeros((1 << (power - BUCKET), 1 << (BUCKET - 3)), np.uint8)
    for bucket, bits in rows:
        out[bucket] = np.frombuffer(bits, np.uint8)
    return out.ravel(), power


def token_numbers(docs: DataFrame, tokenizer: str, *others: str, only: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """docs (doc_id, source, lang, text) with tokens instead of text: the number of ids that the tokenizer's file gives the whole text; null: 0.

    Those of other tokenizers follow as tokens2, tokens3, .., of documents in the bitmap `only` (see marks) if there is one; others have null.
    """
    names = ["tokens", *(f"tokens{k}" for k in range(2, len(others) + 2))]
    power = only[1] if only else BUCKET
    bitmap = docs.sparkSession.sparkContext.broadcast(only[0]) if only else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from resona.llm.hashing import column_bytes, slices
        from resona.llm.token_store import Encoder

        encoders = [Encoder.of(t, 0) for t in (tokenizer, *others)]
        for batch in batches:
            texts, bits = batch.column(3), batch.column(4).to_numpy()
            again = (bitmap.value[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool) if bitmap else np.ones(len(bits), bool)
            n = np.zeros((len(encoders), len(bits)), np.int64)
            for k, encoder in enumerate(encoders):
                at = np.flatnonzero(again) if k else np.arange(len(bits))
                some = texts.take(pa.array(at)) if k else texts
                for lo, hi in slices(column_bytes(some)[1], 1 << 20):
                    n[k, at[lo:hi]] = [len(ids) // encoder.kind.itemsize - 1 for ids in encoder.encode(some.slice(lo, hi - lo))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(own, mask=~again if k else None) for k, own in enumerate(n))], ["doc_id", "source", "lang", *names])

    key = F.col("doc_id").cast("long")
    return docs.select(key, "source", "lang", "text", mark(key, power)).mapInArrow(count, "doc_id long, source string, lang string, " + ", ".join(f"{c} long" for c in names))


def inserts(docs: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    """Signed changes that add each row of docs."""
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("docs"), tokens.alias("tokens"))


def deletes(docs: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    return inserts(docs, tokenizer, tokens).withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})


def revisions(docs: DataFrame, old: tuple[str, Column], new: tuple[str, Column]) -> DataFrame:
    """Signed changes from one tokenizer's counts to another's."""
    return docs.select("source", "lang", F.explode(F.array(*(F.struct(F.lit(name).alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (tokens * sign).alias("tokens")) for sign, (name, tokens) in ((-1, old), (1, new))))).alias("c")).select("source", "lang", "c.*")


class Rollup:
    """Totals kept in a folder that all executors share: partials/, a file of log/ a committed batch, and merged/ for merges of them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _enter(self, name: str, says: dict) -> bool:
        """Create a file that nobody has created before; False if it is there."""
        path, fs = self._path(name)
        if fs.exists(path):
            return False
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass()):
                return False
            raise
        out.write(bytearray(json.dumps(says).encode()))
        out.close()
        return True

    def _entries(self, name: str) -> dict[str, dict | None]:
        """What the files of a folder say, by name (None: it can't be read): some hundred bytes a batch."""
        path, fs = self._path(name)
        if not fs.exists(path):
            return {}
        rows = self.spark.read.text(f"{self.folder}/{name}", wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").collect()
        out: dict[str, dict | None] = {f.getPath().getName(): None for f in fs.listStatus(path)}  # empty files have no row
        for file, value in rows:
            try:
                out[file] = json.loads(value)
            except ValueError:
                out[file] = None
        return out

    def _complete(self, batch: str) -> str:
        """The first partial of a batch that was written to its end."""
        path, fs = self._path("partials")
        names = sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []
        for name in names:
            if name[:-13] == batch and fs.exists(self._path(f"partials/{name}/_SUCCESS")[0]):
                return f"partials/{name}"
        raise ValueError(f"batch {batch} is in the log but has no partial")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was there already.

        A failed or repeated commit changes nothing. Nulls among source, language and tokenizer are groups of their own;
        null counts count 0; repeated rows count as often. An empty batch is committed as such. Names are those of files.
        """
        path, fs = self._path(f"log/{batch}")
        if fs.exists(path):
            return False
        name = f"partials/{batch}-{uuid.uuid4().hex[:12]}"
        changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens")).write.parquet(f"{self.folder}/{name}")
        return self._enter(f"log/{batch}", {"partial": name})

    def _current(self) -> tuple[list[str], list[str]]:
        """The folders whose sum is the total, and the batches in it: those of the last merge, and those committed since."""
        log, merges = self._entries("log"), {k: v for k, v in self._entries("merged").items() if v}
        last = merges[max(merges)] if merges else {"partial": None, "batches": []}
        rest = sorted(set(log) - set(last["batches"]))
        said = (log[b]["partial"] if log[b] else self._complete(b) for b in rest)
        return [x for x in [last["partial"], *said] if x], sorted(log)

    def merge(self) -> bool:
        """Put all that is committed into one partial, so that later totals read one folder; False if another merge was quicker."""
        folders, batches = self._current()
        if not folders:
            return False
        name = f"partials/merge-{uuid.uuid4().hex[:12]}"
        self._sum(folders).write.parquet(f"{self.folder}/{name}")
        return self._enter(f"merged/{len(self._entries('merged')):08d}", {"partial": name, "batches": batches})

    def _sum(self, folders: list[str]) -> DataFrame:
        partials = self.spark.read.schema(PARTIAL).parquet(*(f"{self.folder}/{x}" for x in folders))
        return partials.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """docs and tokens by source, language and tokenizer; groups that came to nothing are left out."""
        folders, _ = self._current()
        return self._sum(folders).where("docs <> 0 or tokens <> 0") if folders else self.spark.createDataFrame([], PARTIAL)


def token_counts(docs: DataFrame, labels: DataFrame, old: tuple[str, str], new: tuple[str, str]) -> DataFrame:
    """Three batches over all documents, the first of them sent twice, then the totals.

    old, new: name and file of a tokenizer's versions. 1: every document, counted by the old one. 2: documents rated of low
    quality are counted anew by the new one. 3: documents rated toxic are deleted, under the version that they have by then.

    A document counts as rated if any row of labels rates it so; null ids are not rated. Null and empty texts are documents
    of no tokens; long texts are counted whole; repeated rows count as often. Extra columns are not read. Empty tables give
    empty totals.
    """
    docs = docs.select("doc_id", "source", "lang", "text")
    rated = labels.groupBy(F.col("doc_id").cast("long").alias("rated")).agg(F.max(F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("toxic"), F.max(F.coalesce(F.col("quality"), F.lit(1)) == 0).alias("low")).where("rated is not null")
    low = rated.where("low")
    # texts are read once, for both versions, and never shuffled: which documents are rated is asked of their counts, and a bitmap
    # spares most others the new version
    first = scratch.keep(token_numbers(docs, old[1], new[1], only=marks(low.select("rated"))), "counted")
    second = first.join(low, F.col("doc_id") == F.col("rated"), "left_semi").withColumn("tokens", F.col("tokens2"))
    rollup = Rollup(docs.sparkSession, scratch.folder(docs.sparkSession, "rollup"))
    n, toxic = F.col("tokens"), rated.where("toxic").select("rated")
    rollup.commit("1", inserts(first, old[0], n))
    rollup.commit("1", inserts(first, old[0], n))
    revised = deletes(first.join(low, F.col("doc_id") == F.col("rated"), "left_semi"), old[0], n).unionByName(inserts(second, new[0], n))
    rollup.commit("2", revised)
    gone = lambda df: df.join(toxic, F.col("doc_id") == F.col("rated"), "left_semi")
    as_old = first.join(low, F.col("doc_id") == F.col("rated"), "left_anti")
    rollup.commit("3", deletes(gone(as_old), old[0], n).unionByName(deletes(gone(second), new[0], n)))
    rollup.merge()
    return rollup.totals()
