"""Signal, checksums, positions and formats."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.functions import crc, signal, text


def slow_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_crc(data):
    assert crc.crc32c(data) == slow_crc(data)


def test_crc_check_value(spark):
    assert crc.crc32c(b"123456789") == 0xE3069283
    df = spark.createDataFrame([(bytearray(b"123456789"),), (None,), (bytearray(),)], "b binary")
    assert [r[0] for r in df.select(crc.crc32c_udf("b")).collect()] == [0xE3069283, None, 0]


def test_signal_values(spark):
    # Published values of frames 400000..400002.
    want = {3: [0.124645039, 0.120716095, 0.141786873], 17: [0.000532358, 0.007596261, 0.002109939]}
    v = signal.values(np.array([3, 17]), 400_000, 3)
    assert [[round(float(x), 9) for x in row] for row in v] == list(want.values())
    rows = signal.samples(spark, 18, 3, start=400_000).where("channel IN (3, 17)").orderBy("channel", "frame").collect()
    assert [round(r["value"], 9) for r in rows] == want[3] + want[17]


@pytest.mark.parametrize("dither", [True, False])
@pytest.mark.parametrize("start", [0, 2**31 + 12_345, 1_440_000_000])
def test_signal_bits(spark, dither, start):
    v = signal.values(np.arange(32), start, 50, dither)
    rows = signal.samples(spark, 32, 50, start=start, dither=dither).collect()
    assert len(rows) == 1600
    for r in rows:
        assert struct.pack("<f", r["value"]) == v[r["channel"], r["frame"] - start].tobytes()
    assert len({row.tobytes() for row in v}) == 32


def test_signal_needs_channels(spark):
    for bad in (0, -1, 1.5):
        with pytest.raises(ValueError):
            signal.samples(spark, bad, 10)


def test_fills_agree(spark):
    wide = {r["frame"]: r["values"] for r in signal.interleaved(spark, 4, 100).collect()}
    planar = signal.planar(spark, 4, 100, 30).collect()
    assert max(r["block_index"] for r in planar) == 3 and len(planar) == 16
    for r in planar:
        assert r["values"] == [wide[r["start_frame"] + j][r["channel"]] for j in range(len(r["values"]))]


def test_positions(spark):
    cases = {"12.5s": 50000, "#50000": 50000, "1:30": 360000, "250ms": 1000, "90": 360000, "2m": 480000, "1.5h": 21600000, "": None, "-2.5": -10000, "0.000125": 1}
    for spec, frame in cases.items():
        assert text.frame_of(spec, 4000) == frame
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "s string")
    assert [r[0] for r in df.select(text.position(F.col("s"), 4000)).collect()] == [*cases.values(), None]
    with pytest.raises(ValueError):
        text.frame_of("soon", 4000)
    with pytest.raises(Exception, match="not a position"):
        spark.createDataFrame([("soon",)], "s string").select(text.position(F.col("s"), 4000)).collect()


def test_channels():
    assert text.channels_of("3,1-2,3", 8) == [1, 2, 3] and text.channels_of("odd", 5) == [1, 3] and text.channels_of(None, 2) == [0, 1]
    with pytest.raises(ValueError):
        text.channels_of("7", 4)
    assert text.channels_for_download([3, 0, 3, 99, -1], 4) == [0, 3]


@settings(max_examples=200, deadline=None)
@given(st.floats(width=32, allow_nan=False, allow_infinity=False))
def test_nine_digits_bring_back_the_float(x):
    assert np.float32(text.nine_digits(x)) == np.float32(x)


def test_nine_digits():
    assert [text.nine_digits(float(np.float32(x))) for x in (0.1, -0.0, 1e-7, 1.5, 1e21)] == ["0.100000001", "0", "1.00000001e-7", "1.5", "1.00000002e+21"]
    assert text.nine_digits(float("nan")) == "NaN"


def test_sizes_round_the_exact_value(spark):
    # Keys whose size lies just beside a half of the last decimal; then halves, edges between units, the largest number, null.
    sizes = [k * k * 7919 for k in (938992, 2816976, 4610893, 4694960, 6572944, 7062248, 7459009)]
    cases = dict(zip(sizes, ("6350.3008 TiB", "57152.7076 TiB", "153123.0618 TiB", "158757.5212 TiB", "311164.7416 TiB", "359216.6389 TiB", "400712.3971 TiB")))
    for n in (1056, 1120, 1023, 1024, 2**20 - 1, 2**20, 2**20 + 2**15, 2**30 - 1, 2**40 + 3 * 2**35, 2**53 + 1, 2**63 - 1):
        unit = min(4, (n.bit_length() - 1) // 10)
        cases[n] = f"{n / 1024**unit:.4f} {text.BYTE_UNITS[unit]}" if unit else f"{n} B"
    df = spark.createDataFrame([(n,) for n in [*cases, -5, None]], "n long")
    assert [r[0] for r in df.select(text.bytes_text(F.col("n"))).collect()] == [*cases.values(), "-5 B", None]
    none = spark.sql("SELECT CAST(NULL AS LONG) AS n").select(text.duration(F.col("n")), text.fixed(F.col("n") / 4.0, 6))
    assert tuple(none.first()) == (None, None)
