"""Signal files as DataFrames: WAV, MATLAB level 5 and CSV, in long form.

Files are read by Spark's own binaryFile and csv sources, so any path that Spark reads will do; each file is
decoded in one task (a recording is bounded; long ones are stored as several files).
"""

from __future__ import annotations

import io
import re
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "path string, channel string, fs double, rpm double, i long, x double, problem string"
CHANNEL = re.compile(r"(DE|FE|BA)_time$")
PAIRS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def read_wav(data: bytes) -> tuple[float, np.ndarray]:
    """Sampling rate and samples of a PCM file; of several channels the first."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width = w.readframes(w.getnframes()), w.getsampwidth()
        if width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = (b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8
        else:
            x = np.frombuffer(raw, {1: "<u1", 2: "<i2", 4: "<i4"}[width]).astype(float) - (128 if width == 1 else 0)
        return float(w.getframerate()), x.astype(float)[:: w.getnchannels()]


def _element(data: bytes, at: int) -> tuple[int, bytes, int]:
    """Type, payload and end of a level 5 element."""
    kind, size = struct.unpack_from("<II", data, at)
    if kind >> 16:
        return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
    body = data[at + 8 : at + 8 + size]
    return kind, body, at + 8 + size + (0 if kind == 15 else -size % 8)


def read_mat(data: bytes) -> dict[str, np.ndarray]:
    """Real numeric arrays of a MATLAB level 5 file, flattened, by name. Level 7.3 files (HDF5) are refused."""
    if data[:4] == b"\x89HDF" or b"MATLAB 7.3" in data[:128]:
        raise ValueError("MATLAB 7.3 files need an HDF5 library")
    out, at = {}, 128
    while at + 8 <= len(data):
        kind, body, at = _element(data, at)
        if kind == 15:
            kind, body, _ = _element(zlib.decompress(body), 0)
        if kind == 14:
            parts, k = [], 0
            while k + 8 <= len(body):
                t, payload, k = _element(body, k)
                parts.append((t, payload))
            if len(parts) >= 4 and parts[3][0] in PAIRS:
                out[parts[2][1].decode("latin-1")] = np.frombuffer(parts[3][1], "<" + PAIRS[parts[3][0]]).astype(float)
    return out


def problem_of(x: np.ndarray, fs: float | None, least: float = 1000.0) -> str | None:
    """Why a recording can't be used, or None."""
    if fs is None or fs < least:
        return "slow" if fs is not None else "no sampling rate"
    if not len(x):
        return "empty"
    if not np.isfinite(x).all():
        return "not finite"
    return None if np.abs(x).max() > 0 else "zero"


def _decode(fs: float | None, least: float):
    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    if path.lower().endswith(".wav"):
                        rate, x = read_wav(content)
                        found, rpm = {"main": x}, None
                    else:
                        rate, arrays = fs, read_mat(content)
                        found = {m[1]: v for k, v in arrays.items() if (m := CHANNEL.search(k)) and len(v) > 1}
                        rpm = next((float(v.mean()) for k, v in arrays.items() if k.upper().endswith("RPM")), None)
                except (ValueError, wave.Error, EOFError, struct.error, zlib.error, KeyError) as e:
                    yield pd.DataFrame({"path": [path], "channel": [None], "fs": [fs], "rpm": [None], "i": [None], "x": [None], "problem": [str(e)]})
                    continue
                for channel, x in found.items():
                    bad = problem_of(x, rate, least)
                    if bad:
                        yield pd.DataFrame({"path": [path], "channel": [channel], "fs": [rate], "rpm": [rpm], "i": [None], "x": [None], "problem": [bad]})
                    for lo in range(0, 0 if bad else len(x), 1 << 18):
                        part = x[lo : lo + (1 << 18)]
                        yield pd.DataFrame({"path": path, "channel": channel, "fs": rate, "rpm": rpm, "i": np.arange(lo, lo + len(part)), "x": part, "problem": None})

    return decode


def load_binary(spark: SparkSession, path: str, fs: float | None = None, least: float = 1000.0) -> DataFrame:
    """SCHEMA rows of WAV and MATLAB files below path; fs is needed for MATLAB. Files or channels that can't be used are one row with a problem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.lower("path").rlike(r"\.(wav|mat)$"))
    return files.select("path", "content").mapInPandas(_decode(fs, least), SCHEMA)


def load_csv(spark: SparkSession, path: str, fs: float | None = None) -> DataFrame:
    """Rows (path, channel 'main', fs, i, x) of CSV files with a header.

    A first column called like time, t or sn gives fs as 1 / median spacing and the order; else fs is needed
    and lines count in file order.
    """
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path).withColumn("path", F.input_file_name())
    names = [c for c in raw.columns if c != "path"]
    timed = [c for c in names if "time" in c.lower() or c.lower() in ("t", "sn")] if len(names) >= 2 else []
    if not timed and fs is None:
        raise ValueError("a file without a time column needs fs")
    value = next(c for c in names if c not in timed[:1])
    order: Column = F.col(timed[0]).cast("double") if timed else F.monotonically_increasing_id()
    w = Window.partitionBy("path").orderBy("at")
    rows = raw.select("path", order.alias("at"), F.col(value).cast("double").alias("x"))
    rows = rows.withColumns({"i": (F.row_number().over(w) - 1).cast("long"), "gap": F.col("at") - F.lag("at").over(w)})
    if timed:
        rate = rows.groupBy("path").agg((1 / F.median("gap")).alias("fs"))
        rows = rows.join(rate, "path")
    else:
        rows = rows.withColumn("fs", F.lit(float(fs)))
    return rows.select("path", F.lit("main").alias("channel"), "fs", "i", "x")


def primary_channel(signal: DataFrame, key: str = "path") -> DataFrame:
    """One channel per record: main, else DE, FE, BA, else the first by name."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("main", "DE", "FE", "BA"))), F.col("channel")), F.lit(0))
    best = signal.groupBy(key).agg(F.min_by("channel", F.struct(F.when(rank == 0, 9).otherwise(rank), "channel")).alias("channel"))
    return signal.join(best, [key, "channel"])


def write_events(events: DataFrame, folder: str) -> None:
    """Append correction events as JSON lines."""
    events.write.mode("append").json(folder)
