"""Documents packed into chunks in document order: one row of a bucketed table holds a few megabytes of text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.llm import scratch

SCHEMA = "chunk long, n_words long, payload binary"


def pack(batch: pa.Table) -> bytes:
    """Arrow IPC stream, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA from sorted documents; the numbers rise with the documents over all partitions."""
    from resona.llm.hashing import column_bytes, slices, word_spans

    base, number = TaskContext.get().partitionId() << 32, 0
    held: list[pa.RecordBatch] = []
    weight = 0

    def row() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        data, offsets = column_bytes(table.column("text"))
        words = int(word_spans(data, offsets)[2][-1])
        return pa.RecordBatch.from_pydict({"chunk": [base + number], "n_words": [words], "payload": [pack(table)]})

    for batch in batches:
        _, offsets = column_bytes(batch.column(batch.schema.get_field_index("text")))
        for lo, hi in slices(offsets, size):
            held.append(batch.slice(lo, hi - lo))
            weight += int(offsets[hi] - offsets[lo])
            if weight >= size:
                yield row()
                held, weight, number = [], 0, number + 1
    if held:
        yield row()


def chunked(docs: DataFrame, key: str = "doc_id", size: int = 4 << 20) -> tuple[DataFrame, int]:
    """A table of SCHEMA, bucketed by chunk, and its number of buckets.

    Chunk numbers follow the order of `key` (nulls first), then of text. A join on chunk with a frame
    dealt out into that many partitions moves no text.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(key).alias("key"), "text").repartitionByRange(buckets, "key").sortWithinPartitions("key", "text")
    rows = ordered.mapInArrow(lambda batches: _chunks(batches, size), SCHEMA)
    name = f"resona_chunks_{uuid.uuid4().hex[:12]}"
    rows.write.format("parquet").option("compression", "none").option("path", scratch.folder(spark, "chunks")).bucketBy(buckets, "chunk").saveAsTable(name)
    return spark.table(name), buckets
