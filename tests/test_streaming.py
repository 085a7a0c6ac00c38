"""Streams: ingest in state, the exactly-once sink, restarts, the signal source and telemetry."""

import glob
import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import signal
from chronoloom.plans.api import open_recording
from chronoloom.sources import generator, recording, sink
from chronoloom.streaming import ingest, telemetry

C, PER = 3, 10
RECORDS = "stream string, seq long, start_frame long, frame_count long, channel_count int, payload binary"


def record(stream, seq, start, count):
    data = signal.values(np.arange(C), start, count).T if count else np.empty((0, C))
    return stream, seq, start, count, C, bytearray(np.ascontiguousarray(data, "<f4").tobytes())


def arrivals(seed, streams=3, n=60):
    """Records with gaps, late ones, overlaps and empty ones; each stream ends with its end mark."""
    r, out = random.Random(seed), []
    for s in range(streams):
        at = r.choice((0, 25))
        for seq in range(n):
            at += r.choice((0, 0, 0, 0, 3, 17, -6, -2))
            at = max(0, at)
            count = r.choice((1, 4, 4, 9, 25, 0))
            out.append(record(f"s{s}", seq, at, count))
            at += count
        out.append((f"s{s}", n, None, None, None, None))
    return out


def fed(spark, folder, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, RECORDS).coalesce(1).write.parquet(f"{folder}/{k:04d}")
    return spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def blocks_of(spark, stream, tmp_path, name):
    q = ingest.ingested(stream, PER).writeStream.format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    q.awaitTermination()
    return spark.table(name)


def truthful(rows):
    for b in rows:
        values = np.frombuffer(bytes(b["payload"]), "<f4").reshape(C, b["frame_count"])
        assert (values == signal.values(np.arange(C), b["start_frame"], b["frame_count"])).all()


@pytest.mark.parametrize("seed,cuts,shuffle", [(1, 1, False), (2, 7, True), (3, 12, True)])
def test_ingest_equals_its_batch_twin(spark, tmp_path, seed, cuts, shuffle):
    rows = arrivals(seed)
    sent = rows[:]
    if shuffle:
        random.Random(seed).shuffle(sent)
    parts = [sent[k::cuts] for k in range(cuts)]
    got = blocks_of(spark, fed(spark, tmp_path / "in", parts), tmp_path, f"ingest{seed}").collect()
    columns = ["stream", "block_index", "start_frame", "frame_count", "preceding_gap", "short"]
    want = ingest.ingested_batch(spark.createDataFrame(rows, RECORDS).where("frame_count IS NOT NULL"), PER).select(*columns).collect()
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(tuple(r) for r in want)
    truthful(got)


def test_known_cases(spark, tmp_path):
    rows = [record("a", k, s, 20) for k, s in enumerate([*range(0, 100, 20), *range(200, 300, 20)])] + [("a", 10, None, None, None, None)]
    q = ingest.ingested(fed(spark, tmp_path / "in", [rows[:3], rows[3:]]), 100).writeStream.format("memory").queryName("known").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.table("known").select("start_frame", "preceding_gap", "frame_count", "block_index").orderBy("block_index").collect()]
    assert got == [(0, 0, 100, 0), (200, 100, 100, 1)]


def test_a_lost_record_is_given_up(spark, tmp_path):
    rows = [record("a", k, k * 10, 10) for k in range(12) if k != 2]
    stream = fed(spark, tmp_path / "in", [rows[:4], rows[4:], [("a", 12, None, None, None, None)]])
    q = ingest.ingested(stream, PER, slack=3).writeStream.format("memory").queryName("given").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.table("given").select("start_frame", "preceding_gap").orderBy("start_frame").collect()]
    assert got == [(k * 10, 10 if k == 3 else 0) for k in range(12) if k != 2]


def test_sequence_events_in_any_order(spark, tmp_path):
    ranges = [("a", 0, 20), ("a", 20, 20), ("a", 80, 20), ("a", 90, 20), ("a", 10, 5), ("b", 500, 20), ("b", 520, 20)]
    seq, rows = {"a": 0, "b": 0}, []
    for s, start, count in ranges:
        rows.append((s, seq[s], start, count, 1, None))
        seq[s] += 1
    random.Random(4).shuffle(rows)
    stream = fed(spark, tmp_path / "in", [rows[:3], rows[3:], rows[:2]])
    q = ingest.sequenced(stream).writeStream.format("memory").queryName("sequence").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("sequence").collect())
    assert got == sorted([("a", "accepted", 0, 20), ("a", "accepted", 20, 20), ("a", "gap", 40, 40), ("a", "accepted", 80, 20), ("a", "duplicate", 90, 10), ("a", "accepted", 100, 10), ("a", "duplicate", 10, 5), ("b", "accepted", 500, 20), ("b", "accepted", 520, 20)])


def test_restarted_stream_writes_every_frame_once(spark, tmp_path):
    recording.register(spark)
    log = str(tmp_path / "telemetry.ndjson")
    n = 40
    rows = [record(s, k, k * 7 + (100 if k >= 20 else 0), 7) for k in range(n) for s in ("a/1", "b")] + [(s, n, None, None, None, None) for s in ("a/1", "b")]
    parts = [rows[k : k + 14] for k in range(0, len(rows), 14)]
    for k, some in enumerate(parts):
        spark.createDataFrame(some, RECORDS).coalesce(1).write.parquet(f"{tmp_path}/in/{k:04d}")

    def run(last):
        """Reads the folders up to `last`, as if the query had been stopped there."""
        os.makedirs(tmp_path / "seen", exist_ok=True)
        for k in range(last):
            for f in glob.glob(f"{tmp_path}/in/{k:04d}/*.parquet"):
                name = f"{tmp_path}/seen/{k:04d}-{os.path.basename(f)}"
                if not os.path.exists(name):
                    os.link(f, name)
        listener = telemetry.TelemetryLog(log)
        spark.streams.addListener(listener)
        try:
            stream = spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/seen")
            q = telemetry.observed(ingest.ingested(stream, PER)).writeStream.format("recording").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination()
            time.sleep(1)
        finally:
            spark.streams.removeListener(listener)

    run(3)
    # Killed after the sink had committed a batch and before the query had noted it: the batch runs again.
    noted = sorted(glob.glob(f"{tmp_path}/c/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    for f in (noted[-1], f"{tmp_path}/c/commits/.{os.path.basename(noted[-1])}.crc"):
        if os.path.exists(f):
            os.remove(f)
    run(4)
    run(len(parts))
    made = sink.batches(str(tmp_path / "out"))
    assert [b["batch"] for b in made] == list(range(len(made)))
    named = {p["name"] for b in made for p in b["parts"]}
    assert named == set(os.listdir(tmp_path / "out" / "parts"))  # what was written twice went
    done = sink.finalise(spark, str(tmp_path / "out"), str(tmp_path / "final"), ingest.BLOCKS, rate=1000.0, frames_per_block=PER)
    assert sorted(os.listdir(tmp_path / "final")) == ["a%2F1.sigb", "b.sigb"]
    for d in done:
        r = open_recording(spark, d["path"])
        report = r.validate().first()
        assert (report["recorded"], report["missing"], report["duplicated"], report["incorrect"], report["corrupt"], report["ledger_agrees"]) == (280 * C, 100 * C, 0, 0, 0, True)
    lines = [json.loads(x) for x in open(log)]
    batch = sink.committed(spark, str(tmp_path / "out"), ingest.BLOCKS).agg(*[c.alias(k) for k, c in telemetry.counters().items()]).first()
    last = max(lines, key=lambda x: x["batch"])
    assert {k: last[f"total_{k}"] for k in telemetry.counters()} == batch.asDict()
    assert len({x["batch"] for x in lines}) == len(lines)


def test_signal_source(spark, tmp_path, monkeypatch):
    generator.register(spark)
    last = 90_000
    options = {"channels": 5, "last": last}
    batch = spark.read.format("signal").options(**options).load()
    want = signal.interleaved(spark, 5, last)
    assert batch.exceptAll(want).count() == 0 and batch.count() == last
    assert spark.read.format("signal").options(channels=2, last=0).load().count() == 0
    stream = spark.readStream.format("signal").options(**options, rate=10_000, maxframesperbatch=7001, begin=time.time()).load()
    q = stream.writeStream.format("memory").queryName("signal").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    deadline = time.time() + 120
    while time.time() < deadline and spark.table("signal").count() < last:
        time.sleep(0.5)
    sizes = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    q.stop()
    got = spark.table("signal")
    assert got.count() == last and got.exceptAll(want).count() == 0
    assert len(sizes) >= 3 and max(sizes[1:]) <= 7001
