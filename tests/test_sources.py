from __future__ import annotations

import struct
import wave
import zlib

import numpy as np
import pytest

from resona.sources import signals as src


def mat(arrays: dict[str, np.ndarray], squeeze: bool) -> bytes:
    """A level 5 file with the given arrays."""

    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H2s", 0x100, b"IM")
    for name, x in arrays.items():
        inner = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", len(x), 1)) + element(1, name.encode()) + element(9, x.astype("<f8").tobytes())
        whole = element(14, inner)
        if squeeze:
            packed = zlib.compress(whole)
            whole = struct.pack("<II", 15, len(packed)) + packed
        out += whole
    return out


def test_binary_files(spark, tmp_path):
    x = np.sin(np.arange(3000) / 10)
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(12_000)
        w.writeframes((x * 1000).astype("<i2").tobytes())
    (tmp_path / "b.mat").write_bytes(mat({"X1_DE_time": x, "X1_FE_time": x * 0, "X1RPM": np.array([1797.0])}, True))
    (tmp_path / "c.mat").write_bytes(b"MATLAB 7.3 MAT-file".ljust(200))
    rows = src.load_binary(spark, f"file://{tmp_path}", 12_000.0).toPandas()
    good = rows[rows.problem.isna()]
    assert good.groupby("channel").size().to_dict() == {"DE": 3000, "main": 3000}
    assert good[good.channel == "DE"].sort_values("i").x.to_numpy() == pytest.approx(x)
    assert set(good[good.channel == "DE"].rpm) == {1797.0}
    assert sorted(rows.problem.dropna()) == ["MATLAB 7.3 files need an HDF5 library", "zero"]


def test_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("time,acc\n" + "".join(f"{k / 2000},{k % 7}\n" for k in range(100)))
    rows = src.load_csv(spark, str(tmp_path / "s.csv"))
    assert rows.count() == 100
    assert rows.first()["fs"] == pytest.approx(2000, rel=1e-6)
    assert src.primary_channel(rows).count() == 100
    (tmp_path / "v.csv").write_text("acc\n1\n2\n")
    with pytest.raises(ValueError, match="needs fs"):
        src.load_csv(spark, str(tmp_path / "v.csv"))
