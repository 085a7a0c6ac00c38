"""Chains, throttling, the scheduler and the capped ledger against folds."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import chains, ledger, pacing


@pytest.mark.parametrize("chunk", [1, 3, 50, 10_000])
def test_followed_chains(spark, chunk):
    r = random.Random(chunk)
    rows, want = [], set()
    for key in ("a", "b", "c", ""):
        nodes = sorted(r.sample(range(500), 120))
        nxt = {n: r.choice([m for m in nodes[i + 1 : i + 12]] or [None]) if r.random() > 0.01 else None for i, n in enumerate(nodes)}
        root = nodes[r.randrange(5)] if key != "c" else None
        rows += [(key, n, nxt[n], n == root if r.random() > 0.5 or n == root else None) for n in nodes]
        while root is not None:
            want.add((key, root))
            root = nxt[root]
    df = spark.createDataFrame(rows, "key string, node long, next long, root boolean")
    got = [tuple(x) for x in chains.followed(df, chunk=chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert chains.followed(df.where("false"), chunk=chunk).count() == 0


@pytest.mark.parametrize("chunk,interval", [(7, 10), (100, 1), (1000, 250), (20, 5000)])
def test_throttle_equals_the_fold(spark, chunk, interval):
    r = random.Random(interval)
    log = [(r.choice(["x", "y", None]), r.choice([r.randrange(3000), r.randrange(100), None]), i) for i in range(900)]
    df = spark.createDataFrame(log, "event string, at_ms long, node long")
    got = pacing.throttled(df, interval, chunk=chunk).collect()
    want = []
    for event in ("x", "y", None):
        last = None
        for at in sorted({a for e, a, _ in log if e == event and a is not None}):
            if last is None or at - last >= interval:
                last = at
                want.append((event, at))
    assert sorted(map(repr, want)) == sorted(repr((x["event"], x["at_ms"])) for x in got)
    assert all((x["event"], x["at_ms"], x["node"]) in log for x in got)
    with pytest.raises(ValueError):
        pacing.throttled(df, 0)


def scheduler(wakes, tick, rate, start_ns, start_frame, catch_up):
    """What a scheduler with absolute deadlines does, one wake-up after the other."""
    per = max(1, int(rate * tick / 1e9 + 0.5))
    k, frame, out = 0, start_frame, []
    for now in wakes:
        behind = max(0, (now - start_ns) // tick - k + 1)
        late, skipped = max(0, behind - 1), max(0, behind - catch_up)
        resync = (frame, skipped * per) if skipped else (None, 0)
        frame, k = frame + skipped * per, k + skipped
        emitted = behind - skipped
        out.append((behind, late, emitted, frame if emitted else None, emitted * per, *resync))
        frame, k = frame + emitted * per, k + emitted
    return out


@pytest.mark.parametrize("chunk", [5, 1000])
def test_schedule_equals_the_fold(spark, chunk):
    r = random.Random(2)
    now, wakes = 1_000, []
    for _ in range(300):
        now += r.choice((0, 1_000_000, 5_000_000, 5_100_000, 40_000_000, 900_000_000, -3_000_000))
        wakes.append(now)
    df = spark.createDataFrame(list(enumerate(wakes)), "seq long, now_ns long")
    s = pacing.schedule(df, 5_000_000, 4000, start_ns=1_000, start_frame=77, chunk=chunk)
    got = [tuple(x) for x in s.orderBy("seq").select("behind", "late", "emitted", "first_frame", "frame_count", "resync_start", "resync_frames").collect()]
    want = scheduler(wakes, 5_000_000, 4000, 1_000, 77, 40)
    assert got == want
    t = pacing.schedule_totals(s).first()
    assert tuple(t) == (sum(x[2] for x in want), sum(x[4] for x in want), sum(x[1] for x in want), sum(x[6] > 0 for x in want), sum(x[6] for x in want))


def test_a_stall_of_five_seconds_is_one_resync(spark):
    df = spark.createDataFrame([(0, 0), (1, 5_000_000), (2, 5_000_000_000)], "seq long, now_ns long")
    last = pacing.schedule(df, 5_000_000, 4000).orderBy("seq").collect()[-1]
    assert (last["resync_frames"], last["resync_start"], last["emitted"]) == (19_180, 40, 40)


def fold(records, most):
    entries, truncated, dropped = [], False, 0
    for _, start, count, cause in sorted(records):
        if count <= 0:
            continue
        dropped += count
        if entries and entries[-1][2] == cause and entries[-1][0] + entries[-1][1] == start:
            entries[-1][1] += count
        elif len(entries) >= most:
            truncated = True
        else:
            entries.append([start, count, cause])
    return [(i, *e, truncated, dropped) for i, e in enumerate(entries)]


@pytest.mark.parametrize("seed", range(8))
def test_capped_ledger_equals_the_fold(spark, seed):
    r = random.Random(seed)
    records = [(i, r.randrange(30), r.choice((0, 1, 1, 2, 3)), r.choice((1, 2) if seed % 2 else (1,))) for i in range(150)]
    df = spark.createDataFrame(records, "seq long, start_frame long, frame_count long, cause_code int")
    most = (1, 2, 5, 40, 200)[seed % 5]
    got = [tuple(x) for x in ledger.capped(df, most, chunk=16).orderBy("entry").collect()]
    assert got == fold(records, most)


def test_capped_ledger_of_nothing(spark):
    df = spark.createDataFrame([(0, 5, 0, 1)], "seq long, start_frame long, frame_count long, cause_code int")
    assert ledger.capped(df, 3).collect() == []
    with pytest.raises(ValueError):
        ledger.capped(df, 0)


def test_playback_totals(spark):
    rows = [(1.0, 1_000_000, 3990, 4000, 20), (2.0, 500_000, 4015, 4000, 40)]
    df = spark.createDataFrame(rows, "speed double, elapsed_us long, emitted long, expected long, bound long")
    t = pacing.playback_totals(df).first()
    assert (t["segments"], t["emitted"], t["expected"], t["deviation"], t["largest_deviation"], t["bound"], t["within"]) == (2, 8005, 8000, 5, 15, 60, True)
    assert pacing.playback_totals(df.where("false")).first()["segments"] == 0


def test_chunks_are_as_wide_as_the_rows_allow(spark):
    rows = [("a", 100 + n) for n in range(40)] + [("a", -5000), ("b", 10_000), ("b", 70_000)]
    nodes = spark.createDataFrame(rows, "key string, node long")
    assert chains.width(nodes, most=10, least=4) == 4  # 4 numbers a chunk; 16 would hold more than 10
    assert chains.width(nodes, most=16, least=4) == 16
    assert chains.width(nodes, most=9, least=16) == 16  # the narrowest, though fuller
    assert chains.width(nodes, most=100, least=4) == 4 << 20
    assert chains.width(nodes.limit(0)) == chains.CHUNK
