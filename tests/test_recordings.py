"""Recordings read by ranges, by batch and by stream."""

from __future__ import annotations

import struct
import time

import numpy as np
import pytest
from test_sources import mat

from resona.sources import recordings as rec

RNG = np.random.default_rng(2)


def wav(x, kind, bits, rate=12_000, extra=b""):
    """x: frames by channels, in the file's own units."""
    if bits == 24:
        body = b"".join(int(v).to_bytes(3, "little", signed=True) for v in x.ravel())
    else:
        body = x.astype({(1, 8): "u1", (1, 16): "<i2", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}[kind, bits]).tobytes()
    n = x.shape[1]
    fmt = struct.pack("<HHIIHH", kind, n, rate, rate * n * bits // 8, n * bits // 8, bits)
    return struct.pack("<4sI4s", b"RIFF", 0, b"WAVE") + extra + struct.pack("<4sI", b"fmt ", 16) + fmt + struct.pack("<4sI", b"data", len(body)) + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("recordings")
    (f / "mono.wav").write_bytes(wav(RNG.integers(-9000, 9000, (5000, 1)), 1, 16, extra=struct.pack("<4sI", b"LIST", 5) + b"notes\0"))
    (f / "two.wav").write_bytes(wav(RNG.normal(size=(3000, 2)), 3, 32))
    (f / "deep.wav").write_bytes(wav(RNG.integers(-(1 << 23), 1 << 23, (700, 1)), 1, 24))
    (f / "byte.wav").write_bytes(wav(RNG.integers(0, 256, (300, 1)), 1, 8))
    (f / "slow.wav").write_bytes(wav(np.ones((10, 1)), 1, 16, 500))
    (f / "cut.wav").write_bytes(b"RIFF")
    (f / "odd.wav").write_bytes(wav(np.ones((4, 1)), 1, 16).replace(struct.pack("<HH", 1, 1), struct.pack("<HH", 2, 1), 1))
    x = np.sin(np.arange(4000) / 10)
    (f / "raw.mat").write_bytes(mat({"X1_DE_time": x, "X1_FE_time": x[:1500] * 2, "X1RPM": np.array([1797.0])}, False))
    (f / "packed.mat").write_bytes(mat({"X2_BA_time": x, "X2rpm": np.array([1700.0, 1800.0]), "other": x}, True))
    (f / "none.mat").write_bytes(mat({"other": x}, True))
    (f / "new.mat").write_bytes(b"MATLAB 7.3 MAT-file".ljust(200))
    (f / "timed.csv").write_text("time,acc\n" + "".join(f"{k / 2000},{k % 7}\n" for k in range(900)))
    (f / "plain.csv").write_text("acc\n" + "".join(f"{k}\n" for k in range(50)))
    (f / "notes.txt").write_text("no recording")
    return f


def read(df):
    out, problems = {}, {}
    for r in df.collect():
        name = r.path.rsplit("/", 1)[1]
        if r.problem:
            problems[name] = r.problem
        else:
            out.setdefault((name, r.channel), {})[r.i] = (r.x, r.fs, r.rpm)
    return out, problems


def test_all_formats(spark, folder):
    got, problems = read(rec.load(spark, str(folder), 12_000.0))
    sizes = {k: len(v) for k, v in got.items()}
    assert sizes == {("mono.wav", "main"): 5000, ("two.wav", "ch1"): 3000, ("two.wav", "ch2"): 3000, ("deep.wav", "main"): 700, ("byte.wav", "main"): 300, ("raw.mat", "DE"): 4000, ("raw.mat", "FE"): 1500, ("packed.mat", "BA"): 4000, ("plain.csv", "main"): 50}
    assert problems == {"slow.wav": "slow", "cut.wav": problems["cut.wav"], "odd.wav": "WAV samples of kind 2 with 16 bits", "none.mat": "no channel", "new.mat": "MATLAB 7.3 files need an HDF5 library", "timed.csv": "2000 samples a second, not 12000"}
    raw = np.frombuffer((folder / "two.wav").read_bytes()[-3000 * 8 :], "<f4").reshape(-1, 2)
    assert [got["two.wav", "ch2"][i][0] for i in range(3000)] == pytest.approx(raw[:, 1].tolist())
    mono = np.frombuffer((folder / "mono.wav").read_bytes()[-10_000:], "<i2")
    assert [got["mono.wav", "main"][i][0] for i in range(5000)] == mono.tolist()
    deep = (folder / "deep.wav").read_bytes()[-2100:]
    assert [got["deep.wav", "main"][i][0] for i in range(700)] == [int.from_bytes(deep[3 * i : 3 * i + 3], "little", signed=True) for i in range(700)]
    assert got["byte.wav", "main"][7][0] == (folder / "byte.wav").read_bytes()[-300 + 7] - 128
    assert got["raw.mat", "FE"][9][0] == pytest.approx(2 * np.sin(0.9)) and got["raw.mat", "DE"][0][2] == 1797.0 and got["packed.mat", "BA"][3][1:] == (12_000.0, 1750.0)


def test_ranges_and_pushed_filters(spark, folder):
    whole, _ = read(rec.load(spark, str(folder), 12_000.0))
    ranged = rec.load(spark, f"file://{folder}", 12_000.0, samples=333)
    assert ranged.rdd.getNumPartitions() > 40
    assert read(ranged)[0] == whole
    one = rec.load(spark, str(folder), 12_000.0).where("channel = 'ch2'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 3000
    assert rec.load(spark, str(folder), 12_000.0).where("channel in ('DE', 'FE') and i < 10").count() == 20


def test_rate_of_csv_files(spark, folder):
    got, problems = read(rec.load(spark, str(folder / "timed.csv")))
    assert len(got["timed.csv", "main"]) == 900 and got["timed.csv", "main"][8][:2] == (1.0, pytest.approx(2000))
    assert read(rec.load(spark, str(folder / "plain.csv")))[1] == {"plain.csv": "no sampling rate"}


def test_stream_is_the_batch(spark, folder, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    rec.register(spark)
    stream = spark.readStream.format("recordings").option("fs", "12000").load(str(inbox))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for name in ("mono.wav", "raw.mat", "cut.wav", "two.wav"):
            (inbox / f"{name}.part").write_bytes((folder / name).read_bytes())
            (inbox / f"{name}.part").rename(inbox / name)
            query.processAllAvailable()
            time.sleep(0.02)
    finally:
        query.stop()
    assert read(spark.read.parquet(str(tmp_path / "out"))) == read(rec.load(spark, str(inbox), 12_000.0))
