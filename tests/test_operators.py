"""Operators against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import envelope, ledger, lookup, ordered, pacing, sequence, validate
from chronoloom.streaming import ingest


def blocks(spark, rows):
    return spark.createDataFrame(rows, "block_index long, ok boolean, start_frame long, frame_count long")


@pytest.mark.parametrize("chunk", [4, 1000])
def test_expected_next_is_the_fold(spark, chunk):
    r = random.Random(chunk)
    rows, at = [], 0
    for b in range(120):
        at = max(0, at + r.choice((0, 0, 0, 5, 13, -4, -20)))
        n = r.choice((10, 10, 3))
        rows.append((b, r.random() > 0.15, at, n))
        at += n
    e, want = 0, []
    for b, ok, start, n in rows:
        before, missing, duplicated = e, 0, 0
        if not ok:
            e += 10
        else:
            missing, duplicated = max(0, start - e), min(max(0, e - start), n)
            e = max(e, start + n)
        want.append((b, before, e, missing, duplicated))
    got = sequence.classified(sequence.expected_next(blocks(spark, rows), 10, chunk=chunk)).orderBy("block_index")
    assert [tuple(x) for x in got.select("block_index", "expected", "after", "missing_frames", "duplicated_frames").collect()] == want


@pytest.mark.parametrize("chunk", [3, 1000])
def test_wire_sequence_is_the_fold(spark, chunk):
    r = random.Random(chunk)
    rows, at = [], 500
    for s in range(150):
        at = max(0, at + r.choice((0, 0, 0, 20, -10, -40)))
        rows.append((s, at, 20))
        at += 20
    e, want = None, []
    for s, start, n in rows:
        new, events = ingest.step(e, start, n)
        kinds = {k: (a, c) for k, a, c in events}
        want.append((s, kinds.get("gap", (0, 0))[1], kinds.get("duplicate", (0, 0))[1], kinds.get("accepted", (0, 0))[1]))
        e = new
    df = spark.createDataFrame(rows, "seq long, start_frame long, frame_count long")
    got = sequence.wire_sequence(df, chunk=chunk).orderBy("seq").select("seq", "gap", "overlap", "tail")
    assert [tuple(x) for x in got.collect()] == want


@pytest.mark.parametrize("chunk", [5, 1000])
def test_running_by_key(spark, chunk):
    r = random.Random(1)
    rows = [(k, i, r.choice((None, r.randrange(100)))) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = ordered.running_all(df, {"top": ("max", F.col("v"), False), "total": ("sum", F.col("v"), True), "held": ("last", F.col("v"), False), "least": ("min", F.col("v"), True)}, order=["i"], keys=["k"], chunk=chunk).collect()
    for x in got:
        upto = [v for k, i, v in rows if k == x["k"] and i <= x["i"] and v is not None]
        before = [v for k, i, v in rows if k == x["k"] and i < x["i"] and v is not None]
        assert (x["top"], x["total"], x["held"], x["least"]) == (max(upto, default=None), sum(before), upto[-1] if upto else None, min(before, default=None))


def test_segments_and_blocks(spark):
    frames = [0, 1, 2, 5, 6, 7, 8, 9, 10, 11, 20]
    df = spark.createDataFrame([(f,) for f in frames], "frame long")
    assert [tuple(r) for r in sequence.gaps(df, chunk=4).orderBy("start_frame").collect()] == [(3, 2), (12, 8)]
    got = sequence.reblocked(df, 3, chunk=4).orderBy("block_index").collect()
    assert [tuple(r) for r in got] == [(0, 0, 3, 0, False), (1, 5, 3, 2, False), (2, 8, 3, 0, False), (3, 11, 1, 0, True), (4, 20, 1, 8, True)]


def test_ledger_joins_only_direct_neighbours(spark):
    rows = [(0, 0, 5, 2), (1, 5, 5, 2), (2, 10, 5, 3), (3, 15, 0, 3), (4, 15, 5, 3), (5, 0, 5, 2), (6, 5, 1, 2)]
    df = spark.createDataFrame(rows, "seq long, start_frame long, frame_count long, cause_code int")
    got = ledger.coalesced(df, chunk=2).orderBy("entry")
    assert [tuple(r) for r in got.collect()] == [(0, 0, 10, 2), (1, 10, 10, 3), (2, 0, 6, 2)]
    names = df.select(ledger.cause_name(F.lit(7)), ledger.cause_name(F.lit(9))).first()
    assert tuple(names) == ("SHUTDOWN_UNFLUSHED", "unknown(9)")


def test_envelope_ignores_lost_data(spark):
    rows = [(0, f, float("nan") if 10 <= f < 20 else float(f)) for f in range(27)]
    df = spark.createDataFrame(rows, "channel int, frame long, value float")
    got = {r["column"]: (r["lo"], r["hi"]) for r in envelope.grid_envelope(df, 0, 10).collect()}
    assert got == {0: (0.0, 9.0), 1: (None, None), 2: (20.0, 26.0)}
    assert envelope.channel_statistics(df).first()["counted"] == 17
    grid = envelope.window_grid(1000, 400, 100, 5000, live=False)
    assert grid == {"from": 800, "samples_per_column": 4, "columns": 100}
    assert envelope.window_grid(0, 400, 9999, 100, live=True)["from"] == 0


def test_a_spike_survives_any_column_width(spark):
    df = spark.createDataFrame([(0, f, 5.0 if f == 777 else 0.0) for f in range(1000)], "channel int, frame long, value float")
    for width in (1, 7, 40, 1000):
        assert envelope.grid_envelope(df, 0, width).agg(F.max("hi")).first()[0] == 5.0
    assert envelope.proportional_envelope(df, 0, 1000, 33).where("hi = 5").count() == 1


def test_find_blocks(spark):
    b = spark.createDataFrame([(0, 0, 10), (1, 10, 10), (2, 40, 10), (3, 50, 3)], "block_index long, start_frame long, frame_count long")
    t = spark.createDataFrame([(0,), (19,), (25,), (45,), (52,), (53,), (999,)], "frame long")
    got = [tuple(r) for r in lookup.find_blocks(t, b, 10).orderBy("target").collect()]
    assert got == [(0, 0, "closed-form"), (19, 1, "closed-form"), (25, 2, "after-gap"), (45, 2, "binary-search"), (52, 3, "binary-search"), (53, None, "not found"), (999, None, "not found")]


def test_levels_hold(spark):
    fills = [10, 50, 80, 60, 30, 20, 40, 90]
    df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(fills)], "seq long, used double")
    got = pacing.buffer_levels(df, 100, chunk=3)
    assert [r["level"] for r in got.orderBy("seq").collect()] == ["NORMAL", "ELEVATED", "HIGH", "HIGH", "HIGH", "NORMAL", "ELEVATED", "HIGH"]
    assert [r["seq"] for r in pacing.level_changes(got, chunk=3).orderBy("seq").collect()] == [1, 2, 5, 6, 7]


def test_five_second_stall_gives_up_what_it_cannot_make_up(spark):
    df = spark.createDataFrame([(0, 5_000_000_000)], "k long, now_ns long")
    r = pacing.due_ticks(df, 5_000_000).first()
    assert (r["due"], r["emitted"], r["skipped"]) == (1001, 40, 961)


def test_report_and_verdict(spark):
    rows = [(0, True, 0, 10, True, 0), (1, True, 10, 10, True, 0)]
    df = spark.createDataFrame(rows, "block_index long, ok boolean, start_frame long, frame_count long, payload_ok boolean, incorrect long")
    f = validate.block_findings(df, frames_per_block=10, channels=2)
    assert validate.report(f, declared=0, expected_values=40).first()["result"] == "PASS"
    assert validate.report(f, trusted=False).first()["exit_code"] == 2
    assert validate.report(f, declared=4).first()["exit_code"] == 1
    lines = [r["line"] for r in validate.result_lines(validate.report(f)).orderBy("line_number").collect()]
    assert lines == ["Expected: 40 samples", "Recorded: 40 samples", "Missing:   0", "Duplicated: 0", "Incorrect:  0", "Result: PASS"]


def test_playback_positions(spark):
    c = spark.createDataFrame([(1_000_000, True, 100, 2.0), (3_000_000, False, 7, 1.0)], "at_us long, playing boolean, anchor long, speed double")
    t = spark.createDataFrame([(0,), (1_500_000,), (2_999_999,), (9_000_000,)], "at_us long")
    got = [r["position"] for r in lookup.transport_positions(t, c, rate=1000, end_frame=3000).orderBy("at_us").collect()]
    assert got == [0, 1100, 3000, 7]


def test_running_keeps_rows_with_nulls_and_clashing_names(spark):
    rows = [("a", 1, 5, 0), (None, 1, 7, 0), (None, 9, 8, 0), ("a", None, 2, 0), ("a", 9, 1, 0)]
    df = spark.createDataFrame(rows, "key string, at long, n long, chunk long").withColumnRenamed("chunk", "value0")
    got = ordered.running(df.withColumn("chunk", F.lit(3)).withColumn("x.y", F.lit(4)), "sum", F.col("n"), "total", order=["at"], keys=["key"], chunk=4)
    assert got.columns == ["key", "at", "n", "value0", "chunk", "x.y", "total"]
    assert {(r["key"], r["at"], r["total"], r["chunk"]) for r in got.collect()} == {("a", None, 2, 3), ("a", 1, 7, 3), ("a", 9, 8, 3), (None, 1, 7, 3), (None, 9, 15, 3)}


@pytest.mark.parametrize("chunk", [7, 10_000])
def test_sessions_of_a_frequent_key(spark, chunk):
    r = random.Random(chunk)
    rows = [(r.choice(("hot", "hot", "hot", None, "rare")), r.choice((None, *range(0, 3000, 3)))) for _ in range(300)]
    want = []
    for key in ("hot", None, "rare"):
        run = []
        for at in sorted(t for k, t in rows if k == key and t is not None):
            if run and at - run[-1] > 20:
                want.append((key, run[0], run[-1], len(run)))
                run = []
            run.append(at)
        want.append((key, run[0], run[-1], len(run)))
    df = spark.createDataFrame(rows, "at string, us long")  # the key is called like a helper
    got = sequence.session_runs(df, F.col("us"), 20, keys=["at"], chunk_micros=chunk)
    assert sorted(map(tuple, got.select("at", "begin_us", "end_us", "events").collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("chunk", [5, 10_000])
def test_playback_segments_over_chunks(spark, chunk):
    rows = [(10, True, 1.0), (11, False, 1.0), (30, True, 2.0), (30, False, 1.0), (41, True, 0.5)]
    got = pacing.playback_segments(spark.createDataFrame(rows, "at_us long, playing boolean, speed double"), rate=1e6, stop_us=50, chunk=chunk)
    assert sorted(map(tuple, got.select("at_us", "until_us", "speed", "expected").collect())) == [(10, 11, 1.0, 1), (30, 41, 2.0, 22), (41, 50, 0.5, 4)]
    assert pacing.playback_segments(spark.createDataFrame([], "at_us long, playing boolean, speed double"), rate=1e6, stop_us=50).count() == 0
