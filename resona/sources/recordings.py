"""Recordings as a data source: spark.read.format("recordings").load(folder), and the same for readStream.

Large files are planned from their headers: ranges of samples of WAV files and of uncompressed arrays of MATLAB level 5
files, whole arrays where they are compressed (a zlib stream can't be entered midway), whole CSV files (read in blocks).
Small files are only listed by the driver: many of them make a partition, whose task reads their headers.
Tasks read only their range, and all of its channels that the filters ask for.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "path string, channel string, fs double, rpm double, i long, x double, problem string"
ARROW = pa.schema([("path", pa.string()), ("channel", pa.string()), ("fs", pa.float64()), ("rpm", pa.float64()), ("i", pa.int64()), ("x", pa.float64()), ("problem", pa.string())])
BLOCK = 1 << 18
#: Bytes of a partition of small files, and those that opening one counts as.
TOGETHER, OPENING = 1 << 26, 1 << 16
# Names of channel variables, of the shaft's speed, of time columns; element types of level 5 files.
CHANNEL = re.compile(r"(DE|FE|BA)_time$")
SPEED = re.compile(r"RPM$", re.IGNORECASE)
TIMES = ("t", "sn")
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


@dataclass
class Part(InputPartition):
    """Samples lo to hi of a file; what is there is told by kind: wav, array (raw), packed (compressed), csv or problem."""

    path: str
    kind: str
    fs: float | None = None
    rpm: float | None = None
    channels: tuple[str, ...] = ()
    dtype: str = ""
    at: int = 0
    lo: int = 0
    hi: int = 0
    problem: str | None = None
    wanted: tuple[str, ...] | None = field(default=None)


@dataclass
class Several(InputPartition):
    """Small files, whole, whose headers are read by the task."""

    paths: list[str]


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def listed(folder: str) -> list[tuple[int, str, int]]:
    """Time of change, path and bytes of each recording below a folder, or of one file."""
    from pyarrow import fs

    system, path = _fs(folder)
    info = system.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
    scheme = folder.split("://", 1)[0] + "://" if "://" in folder else ""
    return sorted((f.mtime_ns or 0, scheme + f.path, f.size or 0) for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".wav", ".mat", ".csv")))


def wav_header(f) -> tuple[float, int, str, int, int]:
    """Rate, channels, sample type (i3: three bytes), and place and size of the samples of a WAV file, PCM or float."""
    riff, _, wave = struct.unpack("<4sI4s", f.read(12))
    if (riff, wave) != (b"RIFF", b"WAVE"):
        raise ValueError("not a WAV file")
    layout = None
    while len(head := f.read(8)) == 8:
        name, size = struct.unpack("<4sI", head)
        if name == b"fmt ":
            body = f.read(size + size % 2)
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            kind = struct.unpack_from("<H", body, 24)[0] if kind == 0xFFFE and size >= 26 else kind
            layout = {(1, 8): "u1", (1, 16): "i2", (1, 24): "i3", (1, 32): "i4", (3, 32): "f4", (3, 64): "f8"}.get((kind, bits))
            if layout is None or not channels:
                raise ValueError(f"WAV samples of kind {kind} with {bits} bits")
        elif name == b"data":
            if layout is None:
                raise ValueError("WAV samples before their format")
            return float(rate), channels, layout, f.tell(), min(size, f.size() - f.tell())
        else:
            f.seek(f.tell() + size + size % 2)
    raise ValueError("a WAV file without samples")


def samples(raw: bytes, dtype: str) -> np.ndarray:
    """Sample values as doubles; 8-bit ones are centred."""
    if dtype == "i3":
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(float)
    return np.frombuffer(raw, "<" + dtype).astype(float) - (128 if dtype == "u1" else 0)


def width(dtype: str) -> int:
    return int(dtype[1:])


def _element(data: bytes, at: int) -> tuple[int, int, int, int]:
    """Type, start and size of the payload, and end of a level 5 element."""
    kind, size = struct.unpack_from("<II", data, at)
    if kind >> 16:
        return kind & 0xFFFF, at + 4, kind >> 16, at + 8
    return kind, at + 8, size, at + 8 + size + (0 if kind == 15 else -size % 8)


def _matrix(body: bytes) -> tuple[str, str | None, int, int]:
    """Name, sample type, and place and size of the real part, from the start of a matrix element's body."""
    _, _, _, at = _element(body, 0)
    _, _, _, at = _element(body, at)
    _, lo, size, at = _element(body, at)
    name = body[lo : lo + size].decode("latin-1")
    kind, lo, size, _ = _element(body, at)
    return name, TYPES.get(kind), lo, size


def mat_arrays(f) -> Iterator[tuple[str, str | None, bool, int, int]]:
    """(name, sample type, compressed, place, bytes) of the arrays of a level 5 file; for compressed ones place and size of the stream."""
    start = f.read(128)
    if start[:4] == b"\x89HDF" or b"MATLAB 7.3" in start:
        raise ValueError("MATLAB 7.3 files need an HDF5 library")
    if len(start) < 128:
        raise ValueError("not a MATLAB file")
    at = 128
    while at + 8 <= f.size():
        f.seek(at)
        peek = f.read(1024)
        kind, lo, size, end = _element(peek, 0)
        if kind == 15:
            name, dtype, _, n = _matrix(zlib.decompressobj().decompress(peek[lo:], 1024)[8:])
            yield name, dtype, True, at + lo, size
        elif kind == 14:
            name, dtype, first, n = _matrix(peek[lo:])
            yield name, dtype, False, at + lo + first, n
        at += end


def inflated(raw: bytes) -> np.ndarray:
    body = zlib.decompress(raw)[8:]
    _, dtype, lo, n = _matrix(body)
    return samples_of(body[lo : lo + n], dtype)


def samples_of(raw: bytes, dtype: str | None) -> np.ndarray:
    """Numbers as they are: arrays of unsigned bytes aren't centred."""
    if dtype is None:
        raise ValueError("an array without numbers")
    return np.frombuffer(raw, "<" + dtype).astype(float)


def planned(path: str, fs: float | None, least: float, size: int) -> Iterator[Part]:
    """The partitions of one file."""
    system, local = _fs(path)
    try:
        if path.lower().endswith(".csv"):
            yield Part(path, "csv", fs, channels=("main",)) if fs is None or fs >= least else Part(path, "problem", fs, problem="slow")
            return
        with system.open_input_file(local) as f:
            if path.lower().endswith(".wav"):
                rate, channels, dtype, at, n = wav_header(f)
                if rate < least:
                    yield Part(path, "problem", rate, problem="slow")
                    return
                names = ("main",) if channels == 1 else tuple(f"ch{k + 1}" for k in range(channels))
                frames = n // (channels * width(dtype))
                for lo in range(0, frames, size):
                    yield Part(path, "wav", rate, None, names, dtype, at, lo, min(lo + size, frames))
                if not frames:
                    yield Part(path, "problem", rate, problem="empty")
                return
            if fs is None or fs < least:
                yield Part(path, "problem", fs, problem="no sampling rate" if fs is None else "slow")
                return
            arrays = list(mat_arrays(f))
            rpm = None
            for name, dtype, packed, at, n in arrays:
                if SPEED.search(name) and dtype:
                    f.seek(at)
                    rpm = float((inflated if packed else lambda raw, d=dtype: samples_of(raw, d))(f.read(n)).mean())
            found = False
            for name, dtype, packed, at, n in arrays:
                if (m := CHANNEL.search(name)) and dtype:
                    found = True
                    if packed:
                        yield Part(path, "packed", fs, rpm, (m[1],), dtype, at, 0, n)
                    else:
                        values = n // width(dtype)
                        for lo in range(0, values, size):
                            yield Part(path, "array", fs, rpm, (m[1],), dtype, at, lo, min(lo + size, values))
            if not found:
                yield Part(path, "problem", fs, rpm, problem="no channel")
    except (ValueError, EOFError, struct.error, zlib.error, IndexError) as e:
        yield Part(path, "problem", fs, problem=str(e) or type(e).__name__)


def csv_columns(names: list[str]) -> tuple[str | None, str]:
    """The time column, if there is one beside others, and the column of samples."""
    time = next((c for c in names if "time" in c.lower() or c.lower() in TIMES), None) if len(names) >= 2 else None
    return time, next(c for c in names if c != time)


def csv_blocks(path: str, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    from pyarrow import csv

    system, local = _fs(path)
    kinds = {c: pa.float64() for c in columns or ()}
    with system.open_input_stream(local) as f:
        yield from csv.open_csv(f, convert_options=csv.ConvertOptions(include_columns=columns, column_types=kinds))


def read_csv(part: Part, least: float) -> Iterator[tuple[float | None, int, np.ndarray]]:
    """Rate, place and values of a CSV file's blocks. A time column gives the rate as the inverse of the median spacing, if none is given."""
    names = next(csv_blocks(part.path)).schema.names
    time, value = csv_columns(names)
    rate = part.fs
    if time:
        spacing, before = [], np.zeros(0)
        for block in csv_blocks(part.path, [time]):
            t = np.concatenate([before, block.column(0).to_numpy(zero_copy_only=False)])
            spacing.append(np.diff(t))
            before = t[-1:]
        median = float(np.median(np.concatenate(spacing))) if sum(map(len, spacing)) else 0.0
        inferred = 1 / median if median > 0 else None
        if rate is not None and inferred is not None and abs(inferred - rate) > 0.01 * rate:
            raise ValueError(f"{inferred:g} samples a second, not {rate:g}")
        rate = rate if rate is not None else inferred
    if rate is None or rate < least:
        raise ValueError("no sampling rate" if rate is None else "slow")
    at = 0
    for block in csv_blocks(part.path, [value]):
        yield rate, at, block.column(0).to_numpy(zero_copy_only=False)
        at += len(block)


def read_part(part: Part, least: float) -> Iterator[pa.RecordBatch]:
    def rows(channel: str | None, fs: float | None, lo: int, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(x), BLOCK):
            v = x[k : k + BLOCK]
            n = len(v)
            yield pa.RecordBatch.from_arrays([pa.array([part.path]).take(pa.array(np.zeros(n, np.int32))), pa.array([channel], pa.string()).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, fs)), pa.array([part.rpm], pa.float64()).take(pa.array(np.zeros(n, np.int32))), pa.array(np.arange(lo + k, lo + k + n)), pa.array(np.ascontiguousarray(v, np.float64)), pa.nulls(n, pa.string())], schema=ARROW)

    def trouble(why: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [part.path], "channel": [None], "fs": [part.fs], "rpm": [part.rpm], "i": [None], "x": [None], "problem": [why]}, schema=ARROW)

    wanted = [(k, c) for k, c in enumerate(part.channels) if part.wanted is None or c in part.wanted]
    if part.kind == "problem":
        yield trouble(part.problem or "unreadable")
    elif part.kind == "csv":
        try:
            for rate, lo, x in read_csv(part, least) if wanted else ():
                yield from rows("main", rate, lo, x)
        except (ValueError, StopIteration, pa.ArrowInvalid, pa.ArrowKeyError) as e:
            yield trouble(str(e).split("\n")[0] or "unreadable")
    elif wanted:
        system, local = _fs(part.path)
        block = width(part.dtype) * (len(part.channels) if part.kind == "wav" else 1)
        with system.open_input_file(local) as f:
            if part.kind == "packed":
                f.seek(part.at)
                yield from rows(part.channels[0], part.fs, 0, inflated(f.read(part.hi)))
            else:
                for lo in range(part.lo, part.hi, BLOCK):
                    n = min(BLOCK, part.hi - lo)
                    f.seek(part.at + lo * block)
                    raw = f.read(n * block)
                    x = (samples if part.kind == "wav" else samples_of)(raw, part.dtype)
                    for k, channel in wanted:
                        yield from rows(channel, part.fs, lo, x[k :: len(part.channels)] if part.kind == "wav" else x)


class _Options:
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.fs = float(options["fs"]) if options.get("fs") else None
        self.least = float(options.get("least", 1000))
        self.size = int(options.get("samples", 1 << 22))
        self.wanted: dict[str, set] = {}

    def of_file(self, path: str) -> Iterator[Part]:
        """The file's partitions that hold what the filters ask for."""
        for part in planned(path, self.fs, self.least, self.size):
            part.wanted = tuple(sorted(self.wanted["channel"])) if "channel" in self.wanted else None
            if part.wanted is None or set(part.wanted) & set(part.channels):
                yield part

    def parts(self, files: list[tuple[str, int]]) -> list[InputPartition]:
        """files: path and bytes."""
        out, few, room = [], [], 0
        for path, n in files:
            if "path" in self.wanted and path not in self.wanted["path"]:
                continue
            if n > self.size:  # a file of fewer bytes than a range has samples is small
                out += self.of_file(path)
                continue
            if few and n + OPENING > room:
                out.append(Several(few))
                few = []
            room = (room if few else TOGETHER) - n - OPENING
            few.append(path)
        return [*out, Several(few)] if few else out

    def rows(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for part in (p for path in partition.paths for p in self.of_file(path)) if isinstance(partition, Several) else (partition,):
            yield from read_part(part, self.least)


class RecordingReader(_Options, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Channels and paths asked for by name are all that is planned."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("channel",), ("path",)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                own = self.wanted.setdefault(f.attribute[0], names)
                own &= names
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return self.parts([(path, n) for _, path, n in listed(self.folder)])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition)


class RecordingStream(_Options, DataSourceStreamReader):
    """Files in order of their time of change; a file must appear whole, as by a rename."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.folder)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.parts([(p, n) for t, p, n in listed(self.folder) if (start["time"], start["path"]) < (t, p) <= (end["time"], end["path"])])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class Recordings(DataSource):
    """Options: path (a folder or file), fs (needed for MATLAB and for CSV without times), least (1000: slower ones are a problem), samples (a partition's most)."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options)

    def streamReader(self, schema) -> RecordingStream:
        return RecordingStream(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)


def load(spark: SparkSession, path: str, fs: float | None = None, **options) -> DataFrame:
    """SCHEMA rows of the WAV, MATLAB level 5 and CSV files below path.

    A file that can't be read, or is sampled too slowly, is one row with a problem. Mono files, CSV too, have the channel main, others
    ch1, ch2, ..; MATLAB files have DE, FE and BA. What is wrong with the samples themselves is signals.validate's to say.
    """
    register(spark)
    reader = spark.read.format("recordings").options(**{k: str(v) for k, v in options.items()})
    return (reader if fs is None else reader.option("fs", str(fs))).load(path)


def write_wav(signal: DataFrame, folder: str, fs: float) -> DataFrame:
    """A WAV file of 64-bit floats for each channel of (signal_id, channel, i, x), named after both: signal_id, channel, path.

    The files are written as the result is computed, each under another name first, so that a repeated task does no harm; it
    takes a channel as one row.
    """
    import pandas as pd

    from resona.operators.kernels import packed

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        for pdf in frames:
            out = []
            for s, c, xs in zip(pdf["signal_id"], pdf["channel"], pdf["xs"], strict=True):
                body = np.asarray(xs, "<f8").tobytes()
                head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 3, 1, int(fs), int(fs) * 8, 8, 64, b"data", len(body))
                path = f"{folder}/{s}_{c}.wav"
                system, local = _fs(path)
                system.create_dir(local.rpartition("/")[0], recursive=True)
                part = f"{local}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(head + body)
                system.move(part, local)
                out.append((s, c, path))
            yield pd.DataFrame(out, columns=["signal_id", "channel", "path"])

    return packed(signal).mapInPandas(each, "signal_id long, channel string, path string")
