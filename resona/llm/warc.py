"""WARC archives: segmented records, revisits of equal payloads, and reassembly.

The writer puts one logical record per page: an HTTP response in chunked transfer framing, cut into
segments where its block is long (the first of type response, the others of type continuation), each
record gzipped on its own. A payload seen before, under a smaller key, is written as a revisit.

The reader splits archives into records, groups segments by the origin's identifier, orders them by number,
verifies the total length and decodes the chunked framing.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.llm import scratch

RECORD = "record_id string, kind string, origin string, segment int, total long, uri string, digest string, refers string, block binary"
PAYLOAD = "record_id string, kind string, uri string, digest string, refers string, payload binary, payload_bytes long"
NAMES = ["record_id", "kind", "uri", "digest", "refers"]
PREFIX = "urn:page:"
CHUNK = 16_384
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: A revisit keeps the headers of the response that it stands for, with the payload's length.
SEEN = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + CHUNK]), payload[i : i + CHUNK]) for i in range(0, len(payload), CHUNK)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def record(fields: dict[str, object], block: bytes) -> bytes:
    """One gzip member that holds a WARC record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def records(name: str, uri: str | None, payload: bytes, digest: str, refers: str | None, segment_bytes: int) -> list[bytes]:
    """The records of a page: a revisit, a response, or a response and its continuations."""
    shared = {"WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": (uri or "").replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [record({"WARC-Type": "revisit", "WARC-Record-ID": f"<{name}>", **shared, "WARC-Refers-To": f"<{refers}>", "WARC-Profile": profile, "Content-Type": "application/http; msgtype=response"}, SEEN % len(payload))]
    block = HEAD + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = []
    for k, part in enumerate(parts, 1):
        fields = {"WARC-Type": "continuation" if k > 1 else "response", "WARC-Record-ID": f"<{name}:{k}>" if k > 1 else f"<{name}>", **shared, "Content-Type": "application/http; msgtype=response"}
        if len(parts) > 1:
            fields |= {"WARC-Segment-Number": k, "WARC-Segment-Origin-ID": f"<{name}>" if k > 1 else None, "WARC-Segment-Total-Length": len(block) if k == len(parts) else None}
        out.append(record(fields, part))
    return out


def parsed(data: bytes) -> Iterator[dict]:
    """The records of an archive of gzip members."""
    view, at = memoryview(data), 0
    while at < len(view):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("the archive is cut short")
            out.append(inflate.decompress(view[at : at + 65_536]))
            at = min(at + 65_536, len(view))
        at -= len(inflate.unused_data)
        text = b"".join(out)
        head, _, rest = text.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        if len(block) != int(fields["Content-Length"]):
            raise ValueError(f"{fields['WARC-Record-ID']} is cut short")
        name = fields["WARC-Record-ID"][1:-1]
        yield {
            "record_id": name, "kind": fields["WARC-Type"], "origin": fields.get("WARC-Segment-Origin-ID", f"<{name}>")[1:-1], "segment": int(fields.get("WARC-Segment-Number", 0)), "total": int(fields["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in fields else None,
            "uri": fields["WARC-Target-URI"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers": fields["WARC-Refers-To"][1:-1] if "WARC-Refers-To" in fields else None, "block": block,
        }


def _length(block: bytes) -> int:
    """The payload length that a revisit states."""
    return int(next(line for line in block.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])


def _body(block: bytes) -> bytes:
    return dechunked(block[block.index(b"\r\n\r\n") + 4 :])


def first_copies(pages: DataFrame, least: int) -> DataFrame:
    """For each payload of at least `least` bytes that several rows have: its digest, size and least key, and whether one row alone has that key.

    Partial aggregation first: however often a page's payload occurs, each task sends one row for it; texts are not shuffled.
    """
    sized = pages.where((F.col("size") >= least) & F.col("page").isNotNull()).groupBy("digest", "size", "page").agg(F.count("*").alias("n"))
    return sized.groupBy("digest", "size").agg(F.min(F.struct("page", "n")).alias("least"), F.sum("n").alias("rows")).where("rows > 1").select("digest", "size", F.col("least.page").alias("first"), (F.col("least.n") == 1).alias("alone"))


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", least: int = 0, segment_bytes: int = 16_384, archive_bytes: int = 32 << 20) -> DataFrame:
    """Write all pages as archives into folder; returns (archive, records) of what was written.

    Of pages with equal html of at least `least` bytes the one with the smallest key is a response, the
    others revisit it; payloads are equal if their size and their SHA-1 are. The response that others may refer to has the
    page's URN as its record identifier, so a revisit names a record that is there; other records have the URN, a slash and
    their place in the archives. Where several rows have the first's key and payload, all of them are responses with a place.
    Null html: empty. Rows of one key are records of their own, each a response if the key is the
    smallest of its payload. Pages of null key are responses and no others refer to them. Extra columns are
    not read.
    """
    plain = pages.select(F.col(key).cast("long").alias("page"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    plain = plain.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    firsts = scratch.keep(first_copies(plain, least), "firsts")
    # copies of one payload meet their first in a join that Spark may split where one payload is hot
    marked = plain.join(firsts, ["digest", "size"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, seen = TaskContext.get().partitionId() << 24, [], 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                payload = row["html"].encode()
                name = f"{PREFIX}{'' if row['page'] is None else row['page']}"
                if not row["alone"] or row["first"] != row["page"]:
                    name += f"/{number}-{seen}"
                refers = None if None in (row["first"], row["page"]) or row["first"] == row["page"] else f"{PREFIX}{row['first']}"
                held += records(name, row["url"], payload, sha1_base32(payload), refers, segment_bytes)
                seen += 1
                size += len(held[-1])
                if size >= archive_bytes:
                    scratch.write_file(f"{folder}/{number:012d}.warc.gz", held)
                    yield pa.RecordBatch.from_pydict({"archive": [f"{number:012d}"], "records": [seen]})
                    number, held, size, seen = number + 1, [], 0, 0
        if held:
            scratch.write_file(f"{folder}/{number:012d}.warc.gz", held)
            yield pa.RecordBatch.from_pydict({"archive": [f"{number:012d}"], "records": [seen]})

    return scratch.keep(marked.select("page", "url", "html", "first", "alone").mapInArrow(write, "archive string, records long"), "archives")


def read_records(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """RECORD rows of the archives named in a column `archive`, one archive at a time, some to a task."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("uri", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("block", pa.binary())])
        for frame in frames:
            for name in frame.column(0).to_pylist():
                fs, path = scratch.open_fs(f"{folder}/{name}.warc.gz")
                with fs.open_input_stream(path, compression=None) as f:
                    held, size = [], 0
                    for row in parsed(f.read()):
                        held.append(row)
                        size += len(row["block"])
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    # archives are of one size, so a few for each core are even work
    cores = spark.sparkContext.defaultParallelism
    n = max(1, min(archives.count(), max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return archives.select("archive").repartition(n).mapInArrow(read, RECORD)


def reassemble(rows: DataFrame) -> DataFrame:
    """PAYLOAD rows: a row per logical record, with its payload (null for revisits).

    Records of one segment are decoded where they are read. Only segmented ones are shuffled, by origin;
    a group is the segments of one record. Missing, repeated or over-long segments fail the job.
    """
    whole = rows.where("segment = 0")
    parts = rows.where("segment > 0").repartition("origin").sortWithinPartitions("origin", "segment")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(zip(batch.column("kind").to_pylist(), batch.column("block").to_pylist(), strict=True))
            payload = [None if kind == "revisit" else _body(block) for kind, block in both]
            sizes = [_length(block) if p is None else len(p) for p, (_, block) in zip(payload, both, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in NAMES] + [pa.array(payload, pa.binary()), pa.array(sizes, pa.int64())], [*NAMES, "payload", "payload_bytes"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["origin"] != held[0]["origin"]:
                    yield _joined(held)
                    held = []
                held.append(row)
        if held:
            yield _joined(held)

    return whole.mapInArrow(decode, PAYLOAD).unionByName(parts.mapInArrow(join, PAYLOAD))


def _joined(held: list[dict]) -> pa.RecordBatch:
    block = b"".join(r["block"] for r in held)
    if [r["segment"] for r in held] != list(range(1, len(held) + 1)) or held[-1]["total"] != len(block):
        raise ValueError(f"segments of {held[0]['origin']} don't make up the whole record")
    payload = _body(block)
    return pa.RecordBatch.from_arrays([pa.array([held[0][n]], pa.string()) for n in NAMES] + [pa.array([payload], pa.binary()), pa.array([len(payload)], pa.int64())], [*NAMES, "payload", "payload_bytes"])


def warc_round_trip(pages: DataFrame, key: str = "page_id", least: int = 0) -> DataFrame:
    """Write archives and read them back: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    A revisit's size and digest are those of the record it refers to. Nulls and ties: as in write_warc().
    """
    spark = pages.sparkSession
    folder = scratch.folder(spark, "warc")
    archives = write_warc(pages, folder, key, least)
    rows = reassemble(read_records(spark, folder, archives))
    number = lambda c: F.expr(f"try_cast(split_part(substring({c}, {len(PREFIX) + 1}), '/', 1) as long)")
    return rows.select(number("record_id").alias(key), F.col("uri").alias("url"), "payload", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), number("refers").alias("refers_to"))
