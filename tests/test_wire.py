"""Wire streams: the one-stream decoder at every cut, and the parallel one against it."""

import numpy as np
import pytest

from chronoloom.sources import layout, wire

MOST = 400


def record(start, n=5, **fields):
    return layout.wire_bytes(np.full(n * 2, start, "<f4").tobytes(), start_frame=start, frame_count=n, channel_count=2, **fields)


def one_stream(data, cuts, most=MOST):
    d, got = wire.Decoder(most), []
    for a, z in zip([0, *cuts], [*cuts, len(data)]):
        got += [(h["start_frame"], bytes(p)) for h, p in d.push(data[a:z])]
    got += [(h["start_frame"], bytes(p)) for h, p in d.finish()]
    return got, d.corrupt_bytes, d.crc_failures, d.tail_bytes


def damaged(seed):
    """Records, some broken, with junk, stray magics and records inside payloads."""
    rng, out, f = np.random.default_rng(seed), b"", 0
    for _ in range(40):
        what = rng.integers(0, 10)
        if what < 5:
            out += record(f, int(rng.integers(0, 12)))
        elif what == 5:
            out += rng.integers(0, 256, int(rng.integers(1, 60)), np.uint8).tobytes()
        elif what == 6:
            bad = bytearray(record(f))
            bad[int(rng.integers(0, len(bad)))] ^= 1 << int(rng.integers(0, 8))
            out += bytes(bad)
        elif what == 7:
            out += record(f)[: int(rng.integers(1, 60))]
        elif what == 8:
            out += layout.wire_bytes(b"x" * int(rng.integers(0, 9)) + record(10_000 + f) + record(20_000 + f, 2), start_frame=f)
        else:
            out += wire._MAGIC.tobytes()[: int(rng.integers(1, 5))]
        f += 12
    return out


def test_nothing_is_lost_at_a_cut():
    data = bytes(200) + record(7)
    for cut in range(len(data) + 1):
        assert one_stream(data, [cut])[:3] == ([(7, np.full(10, 7, "<f4").tobytes())], 200, 0), cut


@pytest.mark.parametrize("seed", range(4))
def test_every_cut_gives_the_same(seed):
    data = damaged(seed)
    whole = one_stream(data, [])
    for cut in range(0, len(data) + 1, 1 if seed == 0 else 29):
        assert one_stream(data, [cut]) == whole
    assert one_stream(data, list(range(1, len(data)))) == whole
    used = sum(32 + len(p) for _, p in whole[0])
    assert used + whole[1] + whole[3] == len(data)


@pytest.mark.parametrize("span,size", [(150, 37), (64, 1000), (500, 3), (1 << 20, 200)])
def test_parallel_equals_one_stream(spark, span, size):
    streams = {f"s{k}": damaged(k) for k in range(8)} | {"none": b"", "junk": b"only junk", "cut": record(3) + record(9)[:50], "inner": layout.wire_bytes(record(5) + record(6), start_frame=4) + record(8)}
    rows = [(s, k, bytearray(d[a : a + size])) for s, d in streams.items() for k, a in enumerate(range(0, len(d), size))] + [("none", 0, None), ("s1", 10**6, None)]
    chunks = spark.createDataFrame(rows, "stream string, seq long, data binary")
    found = wire.decode(chunks, most=MOST, span=span)
    got: dict = {}
    for r in found.records.collect():
        got.setdefault(r["stream"], {})[r["seq"]] = (r["start_frame"], bytes(r["payload"]))
    stats = {r["stream"]: (r["records"], r["corrupt_bytes"], r["crc_failures"], r["tail_bytes"]) for r in found.statistics.collect()}
    for s, d in streams.items():
        records, corrupt, failures, tail = one_stream(d, [])
        mine = got.get(s, {})
        assert [mine[k] for k in sorted(mine)] == records and sorted(mine) == list(range(len(records))), s
        if d:
            assert stats[s] == (len(records), corrupt, failures, tail), s


def test_encoded_records_come_back(spark):
    rows = [("a", k, 10 * k, 10, 1, k % 3, bytearray(b"%d" % k)) for k in range(50)] + [("b", 0, 0, 1, 1, 0, None)]
    records = spark.createDataFrame(rows, "stream string, seq long, start_frame long, frame_count long, channel_count int, flags int, payload binary")
    got = sorted(tuple(r) for r in wire.decoded(wire.encoded(records)).collect())
    assert got == sorted((*r[:6], bytes(r[6] or b"")) for r in rows)
    assert wire.decoded(wire.encoded(records.where("false"))).count() == 0


def test_many_records_at_once(spark, monkeypatch):
    sizes = [*range(0, 40), 8163, 8164, 8165, 9000, 0, 20_000, 3]
    payloads = [np.random.default_rng(k).integers(0, 256, n, np.uint8).tobytes() for k, n in enumerate(sizes)]
    offsets = np.cumsum([0, *sizes])
    starts = np.arange(len(sizes)) * 2**40
    data, ends = layout.wire_many(np.frombuffer(b"".join(payloads), np.uint8), offsets, start_frame=starts)
    assert [data[a:z].tobytes() for a, z in zip(ends, ends[1:])] == [layout.wire_bytes(p, start_frame=int(s)) for p, s in zip(payloads, starts)]
    monkeypatch.setattr(wire, "GATHERED", 100)
    broken = data.copy()
    broken[ends[[3, 44, 47]] - 1] ^= 1
    marks = wire.Marks(broken.tobytes(), 1 << 16)
    own = np.isin(marks.at, ends[:-1])
    assert np.flatnonzero(marks.failed[own]).tolist() == [2, 43, 46] and marks.sound[own].sum() == len(sizes) - 3

    def alone(_):
        raise AssertionError("short records are checked together")

    monkeypatch.setattr(wire, "crc32c", alone)
    assert wire.Marks(b"".join(layout.wire_bytes(b"12345", start_frame=k) for k in range(2000)), 1 << 16).sound.sum() == 2000


def test_encoded_keeps_columns_and_refuses_nulls(spark):
    schema = "stream string, seq long, start_frame long, frame_count long, channel_count int, flags int, payload binary, more double"
    rows = [("a", 0, 5, 1, 1, 0, bytearray(b"x"), 1.5), ("a", 1, 6, 1, 1, 0, None, None)]
    got = wire.encoded(spark.createDataFrame(rows, schema), keep=("more",)).orderBy("seq").collect()
    assert [(bytes(r["data"]), r["more"]) for r in got] == [(layout.wire_bytes(r[6] or b"", start_frame=r[2], frame_count=1, channel_count=1, flags=0), r[7]) for r in rows]
    for bad in (None, -1):
        with pytest.raises(Exception):
            wire.encoded(spark.createDataFrame([("a", 0, bad, 1, 1, 0, None, 0.0)], schema)).collect()
