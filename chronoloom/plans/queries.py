"""Registered queries of the recording engine, each with its SQL where SQL can express it.

`embeddings` serves as a dense recording (frame = vec_id, channel = array position), `events` as a gappy
one (frame = event_id; errors are lost frames) and as a log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal, text
from ..functions.crc import crc32c_udf
from ..operators import envelope, ledger, lookup, ordered, pacing, sequence, validate
from ..shared import scratch
from ..sources import assembly, index, recording, side, wire
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("channel", "value"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type <> 'error'").select(F.col("event_id").alias("frame"))


def lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'error'").select(F.col("event_id").alias("seq"), F.col("event_id").alias("start_frame"), F.lit(1).cast("long").alias("frame_count"), (F.floor(F.col("user_id") / 50) % 3 + 1).cast("int").alias("cause_code"))


def damaged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block per event: nominally ten frames, some shifted, some unreadable, some with a bad payload or wrong values."""
    e = events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("block_index"), (F.col("event_type") != "error").alias("ok"),
        F.greatest(F.lit(0), F.col("event_id") * 10 + F.when(F.col("user_id") % 10 == 0, F.col("user_id") % 7 - 3).otherwise(0)).alias("start_frame"),
        F.when(F.col("user_id") % 25 == 0, 4).otherwise(10).cast("long").alias("frame_count"),
        (F.col("user_id") % 40 != 1).alias("payload_ok"), F.when(F.col("user_id") % 30 == 2, F.col("event_id") % 5).otherwise(0).cast("long").alias("incorrect"),
    )


_DENSE = "d AS (SELECT vec_id AS frame, unnest(range(len(embedding)))::INTEGER AS channel, unnest(embedding) AS value FROM embeddings)"
_EVENTS = "e AS (SELECT *, epoch_us(ts) AS us FROM events)"
_RECORDED = "f AS (SELECT event_id AS frame FROM events WHERE event_type <> 'error')"
_LOST = "l AS (SELECT event_id AS seq, event_id AS start_frame, 1::BIGINT AS frame_count, (user_id // 50 % 3 + 1)::INTEGER AS cause_code FROM events WHERE event_type = 'error')"
_GAPS = _RECORDED + ", g AS (SELECT start_frame, frame - start_frame AS frame_count FROM (SELECT frame, lag(frame + 1, 1, 0::BIGINT) OVER (ORDER BY frame) AS start_frame FROM f) WHERE frame > start_frame)"
_DAMAGED = """b AS (SELECT event_id AS block_index, event_type <> 'error' AS ok,
  greatest(0, event_id * 10 + CASE WHEN user_id % 10 = 0 THEN user_id % 7 - 3 ELSE 0 END)::BIGINT AS start_frame,
  (CASE WHEN user_id % 25 = 0 THEN 4 ELSE 10 END)::BIGINT AS frame_count, user_id % 40 <> 1 AS payload_ok,
  (CASE WHEN user_id % 30 = 2 THEN event_id % 5 ELSE 0 END)::BIGINT AS incorrect FROM events),
s AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 10 END) OVER (ORDER BY block_index) AS s FROM b),
m AS (SELECT *, s + greatest(0, coalesce(max(CASE WHEN ok THEN start_frame + frame_count - s END) OVER (ORDER BY block_index), 0)) AS after FROM s),
x AS (SELECT *, coalesce(lag(after) OVER (ORDER BY block_index), 0)::BIGINT AS expected FROM m),
k AS (SELECT block_index, ok, start_frame, frame_count, expected, after::BIGINT AS after,
  (CASE WHEN ok THEN greatest(0, start_frame - expected) ELSE 0 END)::BIGINT AS missing_frames,
  (CASE WHEN ok THEN greatest(0, least(expected - start_frame, frame_count)) ELSE 0 END)::BIGINT AS duplicated_frames,
  CASE WHEN ok THEN frame_count * 4 ELSE 0 END AS recorded,
  CASE WHEN NOT ok THEN 40 WHEN NOT payload_ok THEN frame_count * 4 ELSE 0 END AS corrupt,
  CASE WHEN ok AND payload_ok THEN incorrect ELSE 0 END AS incorrect FROM x)"""
_REPORT = _DAMAGED + """, r AS (SELECT sum(recorded)::BIGINT AS recorded, sum(missing_frames * 4)::BIGINT AS missing, sum(duplicated_frames * 4)::BIGINT AS duplicated,
  sum(incorrect)::BIGINT AS incorrect, sum(corrupt)::BIGINT AS corrupt FROM k)"""
_SIGNAL = """n AS (SELECT unnest(range(len(embedding))) AS c, vec_id AS n FROM embeddings),
h0 AS (SELECT c, n, xor(((n::HUGEINT * 2654435761) % 4294967296)::BIGINT, (((c + 1)::HUGEINT * 2246822519) % 4294967296)::BIGINT) AS x FROM n),
h1 AS (SELECT c, n, ((xor(x, x >> 15)::HUGEINT * 625341585) % 4294967296)::BIGINT AS x FROM h0),
h AS (SELECT c, n, xor(x, x >> 13) AS hash FROM h1),
w AS (SELECT c, n, hash, ((n * (2 * c + 1)) % 65536)::DOUBLE / 65536::DOUBLE AS t1, ((n * (((7 * c) & 31) * 2 + 3) + c * 512) % 65536)::DOUBLE / 65536::DOUBLE AS t2 FROM h),
k AS (SELECT c, n, hash, (0.5::DOUBLE + c::DOUBLE / 64::DOUBLE) * (4::DOUBLE * abs(t1 - 0.5::DOUBLE) - 1::DOUBLE) + 0.25::DOUBLE * (2::DOUBLE * t2 - 1::DOUBLE) AS carrier FROM w),
v AS (SELECT c::INTEGER AS channel, n AS frame, hash, (carrier + c::DOUBLE / 32::DOUBLE)::FLOAT AS clean,
  (carrier + 0.03125::DOUBLE * (hash::DOUBLE / 4294967296::DOUBLE - 0.5::DOUBLE) + c::DOUBLE / 32::DOUBLE)::FLOAT AS dithered FROM k)"""


# Envelopes and statistics.

@query("envelope_grid", f"WITH {_DENSE} SELECT channel, frame // 40 AS \"column\", min(value) AS lo, max(value) AS hi FROM d GROUP BY ALL")
def envelope_grid(spark, sf_dir):
    return envelope.grid_envelope(dense(spark, sf_dir), 0, 40)


@query("envelope_proportional", f"WITH {_DENSE}, t AS (SELECT max(frame) + 1 AS n FROM d) SELECT channel, ((frame + 1) * 7 - 1) // n AS \"column\", min(value) AS lo, max(value) AS hi FROM d, t GROUP BY ALL")
def envelope_proportional(spark, sf_dir):
    n = (table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1
    return envelope.proportional_envelope(dense(spark, sf_dir), 0, n, 7)


@query("envelope_spine", f"WITH {_DENSE}, g AS (SELECT channel, frame // 100 AS col, min(value) AS lo, max(value) AS hi FROM d WHERE frame < 450 AND channel IN (3, 17) GROUP BY ALL) SELECT c.c::INTEGER AS channel, r.range AS \"column\", lo, hi FROM (VALUES (3), (17)) c(c), range(8) r LEFT JOIN g ON g.channel = c.c AND g.col = r.range")
def envelope_spine(spark, sf_dir):
    s = dense(spark, sf_dir).where("frame < 450 AND channel IN (3, 17)")
    return envelope.on_spine(envelope.grid_envelope(s, 0, 100), [3, 17], 8)


@query("channel_stats", f"WITH {_DENSE} SELECT channel, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi, round(sqrt(avg(value::DOUBLE * value::DOUBLE)), 6) AS rms, count(*) AS counted FROM d GROUP BY channel")
def channel_stats(spark, sf_dir):
    return envelope.channel_statistics(dense(spark, sf_dir)).withColumn("rms", F.round("rms", 6))


@query("flat_columns", f"WITH {_DENSE}, g AS (SELECT channel, frame // 2 AS c, min(round(value, 1)) AS lo, max(round(value, 1)) AS hi FROM d GROUP BY ALL) SELECT channel, count(*) FILTER (hi::DOUBLE - lo::DOUBLE < 1e-7) AS flat_columns FROM g GROUP BY channel")
def flat_columns(spark, sf_dir):
    s = dense(spark, sf_dir).withColumn("value", F.round(F.col("value"), 1).cast("float"))
    return envelope.flat_columns(envelope.grid_envelope(s, 0, 2))


@query("auto_fit", f"WITH {_DENSE} SELECT channel, (min(value)::DOUBLE + max(value)::DOUBLE) / 2 AS centre, greatest((max(value)::DOUBLE - min(value)::DOUBLE) / 2, 1e-6) AS half FROM d GROUP BY channel")
def auto_fit(spark, sf_dir):
    return envelope.auto_fit(dense(spark, sf_dir))


@query("window_grid", """SELECT event_id, greatest(0, b // per * per)::BIGINT AS "from", per::BIGINT AS samples_per_column, cols::BIGINT AS "columns" FROM (
  SELECT *, CASE WHEN user_id % 2 = 0 THEN 100000 - span ELSE least(event_id * 7 - span // 2, 100000 - span) END AS b FROM (
  SELECT *, greatest(1, floor(span / cols + 0.5::DOUBLE)::BIGINT) AS per FROM (SELECT event_id, user_id, (1000 + event_id % 977) AS span, greatest(1, least(event_id % 5000, 4096)) AS cols FROM events)))""")
def window_grid(spark, sf_dir):
    e = events(spark, sf_dir)
    g = envelope.window_grid_column(F.col("event_id") * 7, 1000 + F.col("event_id") % 977, F.col("event_id") % 5000, F.lit(100000), F.col("user_id") % 2 == 0)
    return e.select("event_id", g.alias("g")).select("event_id", "g.*")


# The signal.

@query("hash32", f"WITH {_SIGNAL} SELECT channel, frame, hash FROM v")
def hash32(spark, sf_dir):
    return dense(spark, sf_dir).select("channel", "frame", signal.hash32(F.col("channel"), F.col("frame")).alias("hash"))


@query("signal_dithered", f"WITH {_SIGNAL} SELECT channel, frame, dithered AS value FROM v")
def signal_dithered(spark, sf_dir):
    return dense(spark, sf_dir).select("channel", "frame", signal.value(F.col("channel"), F.col("frame")).alias("value"))


@query("signal_clean", f"WITH {_SIGNAL} SELECT channel, frame, clean AS value FROM v")
def signal_clean(spark, sf_dir):
    return dense(spark, sf_dir).select("channel", "frame", signal.value(F.col("channel"), F.col("frame"), dither=False).alias("value"))


@query("fill_interleaved", f"WITH {_SIGNAL} SELECT frame, list(dithered ORDER BY channel) AS \"values\" FROM v GROUP BY frame")
def fill_interleaved(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return signal.fill_interleaved(e.select(F.col("vec_id").alias("frame"), F.size("embedding").alias("channels"))).select("frame", "values")


@query("fill_planar", f"WITH {_SIGNAL} SELECT frame // 700 AS block_index, channel, min(frame) AS start_frame, list(dithered ORDER BY frame) AS \"values\" FROM v GROUP BY ALL")
def fill_planar(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    blocks = e.groupBy(F.floor(F.col("vec_id") / 700).alias("block_index")).agg(F.min("vec_id").alias("start_frame"), F.count("*").alias("frame_count"), F.max(F.size("embedding")).alias("channels"))
    return signal.fill_planar(blocks).select("block_index", "channel", "start_frame", "values")


# Layouts, ranges and lookups.

@query("transpose_planar", f"WITH {_DENSE} SELECT frame // 100 AS block_index, channel, min(frame) AS start_frame, list(value ORDER BY frame) AS \"values\" FROM d GROUP BY ALL")
def transpose_planar(spark, sf_dir):
    frames = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").alias("values"))
    return envelope.transposed(frames, 100)


@query("interleave_frames", f"WITH {_DENSE}, s AS (SELECT * FROM d WHERE frame % 7 <> 3) SELECT r.range + 10 AS frame, [coalesce((SELECT value FROM s WHERE s.frame = r.range + 10 AND channel = 5), 'nan'::FLOAT), coalesce((SELECT value FROM s WHERE s.frame = r.range + 10 AND channel = 0), 'nan'::FLOAT)] AS \"values\" FROM range(50) r")
def interleave_frames(spark, sf_dir):
    return envelope.dense_frames(dense(spark, sf_dir).where("frame % 7 <> 3"), 10, 60, [5, 0])


@query("range_read", f"WITH {_DENSE} SELECT frame, channel, value FROM d WHERE frame >= 100 AND frame < 300 AND channel IN (3, 17)")
def range_read(spark, sf_dir):
    from .api import open_recording

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").alias("values"))
    return open_recording(spark, _written(spark, e, 40, 100.0)).samples(100, 300, [3, 17]).select("frame", "channel", "value")


@query("block_clip", f"WITH {_GAPS}, b AS (SELECT frame // 100 AS block_index, min(frame) AS start_frame, count(*) AS frame_count FROM f GROUP BY 1) SELECT block_index, greatest(150, start_frame) AS clip_start, least(777, start_frame + frame_count) - greatest(150, start_frame) AS clip_count, greatest(150, start_frame) - start_frame AS skip, 4096 + block_index * 512064 AS byte_offset FROM b WHERE least(777, start_frame + frame_count) > greatest(150, start_frame)")
def block_clip(spark, sf_dir):
    b = recorded(spark, sf_dir).groupBy(F.floor(F.col("frame") / 100).alias("block_index")).agg(F.min("frame").alias("start_frame"), F.count("*").alias("frame_count"))
    return lookup.clipped(b, 150, 777).select("block_index", "clip_start", "clip_count", "skip", lookup.block_address(F.col("block_index"), 4096, 512064).alias("byte_offset"))


_REBLOCK = _RECORDED + """, p AS (SELECT frame, frame - row_number() OVER (ORDER BY frame) AS island FROM f),
i AS (SELECT frame, min(frame) OVER (PARTITION BY island) AS segment_start FROM p),
c AS (SELECT segment_start, (frame - segment_start) // 5 AS part, min(frame) AS start_frame, count(*) AS frame_count FROM i GROUP BY ALL),
b AS (SELECT row_number() OVER (ORDER BY start_frame) - 1 AS block_index, start_frame, frame_count,
  CASE WHEN part = 0 THEN start_frame - lag(start_frame + frame_count, 1, 0::BIGINT) OVER (ORDER BY start_frame) ELSE 0 END AS preceding_gap, frame_count < 5 AS short FROM c)"""


@query("find_blocks", f"""WITH {_REBLOCK}, t AS (SELECT event_id * 3 AS target FROM events), z AS (SELECT max(block_index) AS last_block FROM b),
h AS (SELECT target, b.block_index AS i, b.start_frame + b.frame_count > target AS inside, coalesce(b.block_index + 1, 0) AS after FROM t ASOF LEFT JOIN b ON t.target >= b.start_frame)
SELECT target, CASE WHEN inside THEN i WHEN after <= last_block THEN after END AS block_index,
  CASE WHEN inside THEN CASE WHEN i = target // 5 THEN 'closed-form' ELSE 'binary-search' END WHEN after <= last_block THEN 'after-gap' ELSE 'not found' END AS method
FROM h, z""")
def find_blocks(spark, sf_dir):
    blocks = sequence.reblocked(recorded(spark, sf_dir), 5)
    return lookup.find_blocks(events(spark, sf_dir).select((F.col("event_id") * 3).alias("frame")), blocks, 5)


@query("read_cost", "SELECT event_id, (1 + event_id % 60) * 64 + (1 + user_id % 32) * (event_id + 1) * 4 AS bytes, (1 + event_id % 60) * (2 + user_id % 32) AS calls FROM events")
def read_cost(spark, sf_dir):
    c = lookup.read_cost(1 + F.col("event_id") % 60, 1 + F.col("user_id") % 32, F.col("event_id") + 1)
    return events(spark, sf_dir).select("event_id", c.alias("c")).select("event_id", "c.bytes", "c.calls")


# Continuity and ledgers.

@query("derive_gaps", f"WITH {_GAPS} SELECT start_frame, frame_count FROM g")
def derive_gaps(spark, sf_dir):
    return sequence.gaps(recorded(spark, sf_dir))


@query("segments", f"WITH {_RECORDED}, p AS (SELECT frame, frame - row_number() OVER (ORDER BY frame) AS island FROM f) SELECT frame, dense_rank() OVER (ORDER BY island) - 1 AS segment, min(frame) OVER (PARTITION BY island) AS segment_start FROM p")
def segments(spark, sf_dir):
    return sequence.segments(recorded(spark, sf_dir))


@query("reblock", f"WITH {_REBLOCK} SELECT * FROM b")
def reblock(spark, sf_dir):
    return sequence.reblocked(recorded(spark, sf_dir), 5)


@query("expected_next", f"WITH {_DAMAGED} SELECT block_index, expected, after, missing_frames, duplicated_frames FROM k")
def expected_next(spark, sf_dir):
    b = sequence.classified(sequence.expected_next(damaged_blocks(spark, sf_dir), 10))
    return b.select("block_index", "expected", "after", "missing_frames", "duplicated_frames")


_WIRE = """w AS (SELECT event_id AS seq, greatest(0, 1000 + event_id * 20 + CASE WHEN user_id % 10 = 0 THEN (user_id % 7 - 3) * 10 ELSE 0 END)::BIGINT AS start_frame, 20::BIGINT AS frame_count FROM events),
x AS (SELECT *, coalesce(max(start_frame + frame_count) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_frame) AS expected FROM w),
y AS (SELECT seq, expected, start_frame, greatest(0, start_frame - expected) AS gap, least(greatest(0, expected - start_frame), frame_count) AS overlap,
  least(frame_count, greatest(0, start_frame + frame_count - expected)) AS tail FROM x)"""


def _wire(spark, sf_dir):
    e = events(spark, sf_dir)
    r = e.select(F.col("event_id").alias("seq"), F.greatest(F.lit(0), 1000 + F.col("event_id") * 20 + F.when(F.col("user_id") % 10 == 0, (F.col("user_id") % 7 - 3) * 10).otherwise(0)).alias("start_frame"), F.lit(20).cast("long").alias("frame_count"))
    return sequence.wire_sequence(r)


@query("wire_sequence", f"WITH {_WIRE} SELECT seq, expected, gap, overlap, tail FROM y")
def wire_sequence(spark, sf_dir):
    return _wire(spark, sf_dir).select("seq", "expected", "gap", "overlap", "tail")


@query("wire_statistics", f"WITH {_WIRE} SELECT count(*) FILTER (tail > 0) AS blocks, sum(tail)::BIGINT AS frames, count(*) FILTER (gap > 0) AS gaps, sum(gap)::BIGINT AS gap_frames, count(*) FILTER (start_frame < expected) AS duplicates, sum(overlap)::BIGINT AS duplicate_frames FROM y")
def wire_statistics(spark, sf_dir):
    return sequence.wire_statistics(_wire(spark, sf_dir))


_COALESCED = _LOST + """, q AS (SELECT *, coalesce(lag(start_frame + frame_count) OVER (ORDER BY seq) = start_frame AND lag(cause_code) OVER (ORDER BY seq) = cause_code, false) AS joined FROM l),
o AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (ORDER BY seq) - 1 AS entry FROM q),
c AS (SELECT entry::BIGINT AS entry, min(start_frame) AS start_frame, sum(frame_count)::BIGINT AS frame_count, min(cause_code) AS cause_code FROM o GROUP BY entry)"""


@query("ledger_coalesce", f"WITH {_COALESCED} SELECT * FROM c")
def ledger_coalesce(spark, sf_dir):
    return ledger.coalesced(lost(spark, sf_dir))


@query("ledger_capped", f"WITH {_COALESCED} SELECT *, (SELECT count(*) FROM c) > 40 AS truncated, (SELECT sum(frame_count) FROM l)::BIGINT AS dropped_frames FROM c WHERE entry < 40")
def ledger_capped(spark, sf_dir):
    return ledger.capped(lost(spark, sf_dir), 40)  # records that come in order of their frames never extend a full ledger


@query("lost_time", f"WITH {_COALESCED} SELECT count(*) AS gaps, round(sum(frame_count / 100::DOUBLE), 6) AS lost_seconds FROM c")
def lost_time(spark, sf_dir):
    return ledger.lost_time(ledger.markers(ledger.coalesced(lost(spark, sf_dir)), 100)).withColumn("lost_seconds", F.round("lost_seconds", 6))


_CAUSES = "CASE cause_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in ledger.CAUSES.items()) + " END"


@query("ledger_indexed", f"WITH {_COALESCED} SELECT start_frame, frame_count, start_frame * 32 AS start_value, frame_count * 32 AS value_count, start_frame / 4000::DOUBLE AS start_seconds, frame_count / 4000::DOUBLE AS duration_seconds, {_CAUSES} AS cause FROM c")
def ledger_indexed(spark, sf_dir):
    return ledger.indexed(ledger.coalesced(lost(spark, sf_dir)), 32, 4000)


@query("ledger_markers", f"WITH {_COALESCED} SELECT start_frame / 100::DOUBLE AS onset, frame_count / 100::DOUBLE AS duration, {_CAUSES} AS cause FROM c")
def ledger_markers(spark, sf_dir):
    return ledger.markers(ledger.coalesced(lost(spark, sf_dir)), 100)


@query("ledger_total", f"WITH {_LOST} SELECT sum(frame_count)::BIGINT AS dropped_frames, sum(frame_count)::BIGINT * 32 AS dropped_values, count(*) AS records FROM l")
def ledger_total(spark, sf_dir):
    return ledger.totals(lost(spark, sf_dir), 32)


@query("marker_overlap", f"WITH {_COALESCED}, m AS (SELECT start_frame / 100::DOUBLE AS onset, frame_count / 100::DOUBLE AS duration FROM c), w AS (SELECT window_id, window_id * 7::DOUBLE AS b, window_id * 7::DOUBLE + 3 AS e FROM (SELECT DISTINCT start_frame // 700 AS window_id FROM l)) SELECT window_id, greatest(onset, b) AS clip_begin, least(onset + duration, e) AS clip_end, onset, duration FROM m, w WHERE onset < e AND onset + duration > b")
def marker_overlap(spark, sf_dir):
    w = lost(spark, sf_dir).select(F.floor(F.col("start_frame") / 700).alias("window_id")).distinct()
    w = w.select("window_id", (F.col("window_id") * F.lit(7.0)).alias("begin"), (F.col("window_id") * F.lit(7.0) + 3).alias("end"))
    return ledger.markers_in(ledger.markers(ledger.coalesced(lost(spark, sf_dir)), 100), w)


@query("ledger_agreement", f"WITH {_GAPS}, {_COALESCED} SELECT coalesce(c.start_frame, g.start_frame) AS start_frame, coalesce(c.frame_count, g.frame_count) AS frame_count, CASE WHEN c.start_frame IS NULL THEN 'derived only' WHEN g.start_frame IS NULL THEN 'declared only' ELSE 'both' END AS side FROM c FULL JOIN g ON c.start_frame = g.start_frame AND c.frame_count = g.frame_count")
def ledger_agreement(spark, sf_dir):
    return ledger.agreement(ledger.coalesced(lost(spark, sf_dir)), sequence.gaps(recorded(spark, sf_dir)))


@query("conservation", "SELECT event_id AS frame, 'lost without entry' AS side FROM events WHERE event_type = 'error' AND user_id % 50 = 7")
def conservation(spark, sf_dir):
    offered = events(spark, sf_dir).select(F.col("event_id").alias("frame"))
    entries = events(spark, sf_dir).where("event_type = 'error' AND user_id % 50 <> 7").select(F.col("event_id").alias("start_frame"), F.lit(1).cast("long").alias("frame_count"))
    return ledger.unaccounted(offered, recorded(spark, sf_dir), entries)


# Validation.

def _findings(spark, sf_dir):
    return validate.block_findings(damaged_blocks(spark, sf_dir), frames_per_block=10, channels=4)


@query("block_findings", f"WITH {_DAMAGED} SELECT block_index, missing_frames * 4 AS missing, duplicated_frames * 4 AS duplicated, recorded::BIGINT AS recorded, corrupt::BIGINT AS corrupt, incorrect FROM k")
def block_findings(spark, sf_dir):
    return _findings(spark, sf_dir).select("block_index", "missing", "duplicated", "recorded", "corrupt", "incorrect")


@query("validation_report", f"WITH {_REPORT} SELECT recorded, missing, duplicated, incorrect, corrupt, missing = 1234 AS ledger_agrees, 99999::BIGINT AS expected, 1 AS exit_code, 'FAIL' AS result FROM r")
def validation_report(spark, sf_dir):
    return validate.report(_findings(spark, sf_dir), declared=1234, expected_values=99999)


@query("verdicts", """SELECT event_id, CASE WHEN event_type = 'error' OR user_id % 7 = 0 THEN 1 WHEN user_id % 3 = 0 THEN 2 ELSE 0 END AS exit_code,
  CASE WHEN event_type = 'error' OR user_id % 7 = 0 THEN 'FAIL' WHEN user_id % 3 = 0 THEN 'PASS (TRUNCATED)' ELSE 'PASS' END AS result,
  CASE WHEN event_type = 'error' OR user_id % 7 = 0 THEN 'Failed' WHEN user_id % 3 = 0 THEN 'Passed so far' ELSE 'Passed' END AS headline FROM events""")
def verdicts(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"missing": F.when(F.col("event_type") == "error", 4).otherwise(0), "duplicated": F.lit(0), "incorrect": F.lit(0), "corrupt": F.lit(0), "ledger_agrees": F.when(F.col("user_id") % 7 == 0, False)})
    e = e.withColumn("exit_code", validate.verdict(F.col("user_id") % 3 == 0))
    return e.select("event_id", "exit_code", validate.result_text(F.col("exit_code")).alias("result"), validate.headline(F.col("exit_code")).alias("headline"))


@query("first_discrepancies", f"""WITH {_DAMAGED}, z AS (
  SELECT 'missing' AS class, block_index, expected AS frame, missing_frames * 4 AS value_count FROM k WHERE missing_frames > 0
  UNION ALL SELECT 'duplicated', block_index, start_frame, duplicated_frames * 4 FROM k WHERE duplicated_frames > 0
  UNION ALL SELECT 'corrupt', block_index, start_frame, corrupt FROM k WHERE corrupt > 0)
SELECT class, block_index, frame, value_count::BIGINT AS value_count, frame * 4 AS value_index FROM z QUALIFY row_number() OVER (PARTITION BY class ORDER BY block_index) = 1""")
def first_discrepancies(spark, sf_dir):
    return validate.first_of_class(_findings(spark, sf_dir), 4)


@query("detail_lines", f"""WITH {_DAMAGED}, z AS (
  SELECT 1 AS o, 'First missing:    ' AS begin, block_index, expected AS frame, missing_frames * 4 AS n FROM k WHERE missing_frames > 0
  UNION ALL SELECT 2, 'First duplicated: ', block_index, start_frame, duplicated_frames * 4 FROM k WHERE duplicated_frames > 0
  UNION ALL SELECT 4, 'First corrupt:    ', block_index, start_frame, corrupt FROM k WHERE corrupt > 0),
f AS (SELECT *, format('value #{{:,}}  (channel 0, frame {{:,}}, t={{:.6f}}s)', frame * 4, frame, frame / 4000::DOUBLE) AS place FROM z QUALIFY row_number() OVER (PARTITION BY o ORDER BY block_index) = 1)
SELECT (o * 2 - 2)::INTEGER AS line_number, begin || CASE WHEN o = 4 THEN format('block #{{}} at byte {{:,}}', block_index, 4096 + block_index * 512064) ELSE place END AS line FROM f
UNION ALL SELECT (o * 2 - 1)::INTEGER, repeat(' ', 18) || format('{{:,}}', n::BIGINT) || ' values' FROM f WHERE o = 1""")
def detail_lines(spark, sf_dir):
    firsts = validate.first_of_class(_findings(spark, sf_dir), 4)
    none = F.lit(None)
    firsts = firsts.withColumns({"channel": none.cast("int"), "expected": none.cast("float"), "actual": none.cast("float"), "byte_offset": lookup.block_address(F.col("block_index"), 4096, 512064)})
    return validate.detail_lines(firsts, 4000)


@query("sweep_blocks", """WITH b AS (SELECT event_type, event_id AS block_index, user_id % 11 <> 5 AS ok, greatest(0, event_id * 10 + CASE WHEN user_id % 10 = 0 THEN user_id % 7 - 3 ELSE 0 END)::BIGINT AS s, user_id % 40 <> 1 AS payload_ok FROM events),
r AS (SELECT *, lag(s + 10) OVER (PARTITION BY event_type ORDER BY block_index) AS e FROM b WHERE ok),
g AS (SELECT event_type, count(*) FILTER (WHERE s > e) AS gaps, coalesce(sum(s - e) FILTER (WHERE s > e), 0)::BIGINT AS gap_frames FROM r GROUP BY event_type)
SELECT event_type, count(*) AS blocks, count(*) FILTER (WHERE NOT ok) AS bad_headers, count(*) FILTER (WHERE ok AND NOT payload_ok) AS bad_payloads, any_value(gaps) AS gaps, any_value(gap_frames) AS gap_frames FROM b JOIN g USING (event_type) GROUP BY event_type""")
def sweep_blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    shift = F.when(F.col("user_id") % 10 == 0, F.col("user_id") % 7 - 3).otherwise(0)
    b = e.select("event_type", F.col("event_id").alias("block_index"), (F.col("user_id") % 11 != 5).alias("ok"), F.greatest(F.lit(0), F.col("event_id") * 10 + shift).alias("start_frame"), F.lit(10).cast("long").alias("frame_count"), (F.col("user_id") % 40 != 1).alias("payload_ok"))
    return validate.sweep(b, keys=["event_type"])


@query("first_incorrect", f"WITH {_DENSE}, x AS (SELECT frame // 100 AS block_index, channel, frame, value AS expected, -value AS actual FROM d WHERE (frame * 64 + channel) % 1009 = 700) SELECT block_index, channel, frame, expected, actual, frame * 64 + channel AS value_index FROM x ORDER BY block_index, channel, frame LIMIT 1")
def first_incorrect(spark, sf_dir):
    d = dense(spark, sf_dir).where((F.col("frame") * 64 + F.col("channel")) % 1009 == 700)
    return validate.first_incorrect(d.select(F.floor(F.col("frame") / 100).alias("block_index"), "channel", "frame", F.col("value").alias("expected"), (-F.col("value")).alias("actual")), 64)


@query("result_lines", f"""WITH {_REPORT}, t AS (SELECT ['Expected: ' || format('{{:,}}', recorded) || ' samples', 'Recorded: ' || format('{{:,}}', recorded) || ' samples', 'Missing:   ' || format('{{:,}}', missing),
  'Duplicated: ' || format('{{:,}}', duplicated), 'Incorrect:  ' || format('{{:,}}', incorrect), 'Result: FAIL', 'Corrupt:    ' || format('{{:,}}', corrupt) || '   (CRC-failed blocks, counted separately)'] AS l FROM r)
SELECT unnest(range(7))::INTEGER AS line_number, unnest(l) AS line FROM t""")
def result_lines(spark, sf_dir):
    return validate.result_lines(validate.report(_findings(spark, sf_dir)))


@query("report_checks", f"WITH {_REPORT} SELECT unnest(['Sample values', 'Sequence', 'Checksums', 'Drop log', 'File']) AS \"check\", unnest([CASE WHEN incorrect = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN missing + duplicated = 0 THEN 'pass' ELSE 'fail' END, CASE WHEN corrupt = 0 THEN 'pass' ELSE 'fail' END, 'pending', 'warn']) AS status FROM r")
def report_checks(spark, sf_dir):
    return validate.checks(validate.report(_findings(spark, sf_dir), trusted=False))


# Timing.

_LAGS = _EVENTS + ", t AS (SELECT event_id, us - lag(us) OVER (ORDER BY event_id) AS lag_us FROM e), g AS (SELECT * FROM t WHERE lag_us IS NOT NULL), h AS (SELECT CASE WHEN lag_us < 1 THEN 0 ELSE least(63, length(bin(lag_us))) END::INTEGER AS bucket, count(*) AS n FROM g GROUP BY 1)"


def _lags(spark, sf_dir):
    e = ordered.previous(events(spark, sf_dir), F.col("us"), "before", order=["event_id"])
    return e.where("before IS NOT NULL").select("event_id", (F.col("us") - F.col("before")).alias("lag_us"))


@query("lag_histogram", f"WITH {_LAGS} SELECT * FROM h")
def lag_histogram(spark, sf_dir):
    return pacing.lag_histogram(_lags(spark, sf_dir), F.col("lag_us"))


@query("lag_quantiles", f"WITH {_LAGS}, c AS (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS cum, sum(n) OVER () AS total FROM h) SELECT q, (1::BIGINT << min(bucket)) AS upper_us FROM c, (VALUES (0.5::DOUBLE), (0.9), (0.99)) v(q) WHERE cum >= total * q GROUP BY q")
def lag_quantiles(spark, sf_dir):
    return pacing.histogram_quantiles(pacing.lag_histogram(_lags(spark, sf_dir), F.col("lag_us")), [0.5, 0.9, 0.99])


@query("lag_summary", f"WITH {_LAGS} SELECT count(*) AS samples, round(avg(lag_us), 1) AS mean_us, max(lag_us) AS max_us FROM g")
def lag_summary(spark, sf_dir):
    return pacing.lag_summary(_lags(spark, sf_dir), F.col("lag_us"))


_TICKS = "k AS (SELECT event_id AS k, event_id * 5000000 + (value * 1000)::BIGINT * (user_id % 20) * 1000 AS now_ns FROM events)"


def _ticks(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_id").alias("k"), (F.col("event_id") * 5_000_000 + F.rint(F.col("value") * 1000).cast("long") * (F.col("user_id") % 20) * 1000).alias("now_ns"))


@query("tick_lags", f"WITH {_TICKS} SELECT k, now_ns, (now_ns - k * 5000000) / 1000::DOUBLE AS lag_us FROM k WHERE now_ns > k * 5000000")
def tick_lags(spark, sf_dir):
    return pacing.tick_lags(_ticks(spark, sf_dir), 5_000_000)


@query("due_ticks", f"WITH {_TICKS}, d AS (SELECT k, now_ns, greatest(0, now_ns // 5000000 - k + 1) AS due FROM k) SELECT k, now_ns, due, greatest(0, due - 1) AS late, least(due, 40) AS emitted, greatest(0, due - 40) AS skipped FROM d")
def due_ticks(spark, sf_dir):
    return pacing.due_ticks(_ticks(spark, sf_dir), 5_000_000)


@query("frames_per_tick", "SELECT o_orderkey, greatest(1, floor(r * 5000000::DOUBLE / 1e9::DOUBLE + 0.5::DOUBLE))::BIGINT AS frames FROM (SELECT o_orderkey, o_orderkey % 48000 + 1 AS r FROM orders)")
def frames_per_tick(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", pacing.frames_per_tick((F.col("o_orderkey") % 48000 + 1).cast("int"), F.lit(5_000_000)).alias("frames"))


@query("pacing_report", f"WITH {_EVENTS}, c AS (SELECT max(us) * 1000 - min(us) * 1000 AS elapsed_ns, count(*) AS emitted FROM e), x AS (SELECT *, ((elapsed_ns::HUGEINT * 1) // 1000000000)::BIGINT AS expected FROM c) SELECT elapsed_ns, emitted, expected, emitted - expected AS deviation, round((emitted - expected) / expected::DOUBLE * 1e6, 3) AS deviation_ppm FROM x")
def pacing_report(spark, sf_dir):
    return pacing.pacing_report(events(spark, sf_dir).select((F.col("us") * 1000).alias("at_ns"), F.col("event_id").alias("frame")), 1.0)


_LEVELS = """u AS (SELECT event_id AS seq, CASE WHEN value % 100 >= 75 THEN 'HIGH' WHEN value % 100 < 25 THEN 'NORMAL' END AS sure FROM events),
v AS (SELECT seq, coalesce(sure, CASE WHEN last_value(sure IGNORE NULLS) OVER (ORDER BY seq) = 'HIGH' THEN 'HIGH' ELSE 'ELEVATED' END) AS level FROM u)"""


def _levels(spark, sf_dir):
    return pacing.buffer_levels(events(spark, sf_dir).select(F.col("event_id").alias("seq"), (F.col("value") % 100).alias("used")), 100).select("seq", "level")


@query("buffer_levels", f"WITH {_LEVELS} SELECT * FROM v")
def buffer_levels(spark, sf_dir):
    return _levels(spark, sf_dir)


@query("level_changes", f"WITH {_LEVELS} SELECT seq, level FROM v QUALIFY level <> lag(level, 1, 'NORMAL') OVER (ORDER BY seq)")
def level_changes(spark, sf_dir):
    return pacing.level_changes(_levels(spark, sf_dir))


@query("running_peak", "SELECT event_id, max(value) OVER (ORDER BY event_id) AS peak FROM events")
def running_peak(spark, sf_dir):
    return ordered.running(events(spark, sf_dir), "max", F.col("value"), "peak", order=["event_id"]).select("event_id", "peak")


@query("transport_position", f"""WITH {_EVENTS}, t0 AS (SELECT min(us) AS z FROM e), c AS (SELECT us - z AS at_us, event_id % 100 <> 0 AS playing, event_id * 3 AS anchor, 0.5 + user_id % 4 AS speed FROM e, t0 WHERE event_id % 50 = 0), t AS (SELECT us - z AS at_us FROM e, t0)
SELECT t.at_us, (CASE WHEN c.playing THEN greatest(0, least(anchor + floor((t.at_us - c.at_us) / 1e6::DOUBLE * 2::DOUBLE * speed::DOUBLE)::BIGINT, 25000)) WHEN NOT c.playing THEN least(anchor, 25000) ELSE 0 END)::BIGINT AS position FROM t ASOF LEFT JOIN c ON t.at_us >= c.at_us""")
def transport_position(spark, sf_dir):
    """Every event is a row of the clock; every fiftieth also is a command."""
    e = events(spark, sf_dir)
    e = e.crossJoin(e.agg(F.min("us").alias("z"))).withColumn("at_us", F.col("us") - F.col("z"))  # one row
    commands = e.where("event_id % 50 = 0").select("at_us", (F.col("event_id") % 100 != 0).alias("playing"), (F.col("event_id") * 3).alias("anchor"), (0.5 + F.col("user_id") % 4).cast("double").alias("speed"))
    return lookup.transport_positions(e.select("at_us"), commands, rate=2.0, end_frame=25000, chunk=3_600_000_000)


_SCHEDULE = _TICKS + """, u AS (SELECT k AS seq, now_ns, now_ns // 5000000 + 1 AS due FROM k),
p AS (SELECT *, greatest(0, coalesce(max(due) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS tick FROM u),
d AS (SELECT *, greatest(0, due - tick) AS behind FROM p)"""


@query("scheduled_wakes", f"WITH {_SCHEDULE} SELECT seq, tick, greatest(0, behind - 1) AS late, least(behind, 40) AS emitted, CASE WHEN behind > 0 THEN (tick + greatest(0, behind - 40)) * 20 END AS first_frame, least(behind, 40) * 20 AS frame_count, CASE WHEN behind > 40 THEN tick * 20 END AS resync_start, greatest(0, behind - 40) * 20 AS resync_frames FROM d")
def scheduled_wakes(spark, sf_dir):
    s = pacing.schedule(_ticks(spark, sf_dir).withColumnRenamed("k", "seq"), 5_000_000, 4000)
    return s.select("seq", "tick", "late", "emitted", "first_frame", "frame_count", "resync_start", "resync_frames")


@query("schedule_totals", f"WITH {_SCHEDULE} SELECT sum(least(behind, 40))::BIGINT AS ticks, sum(least(behind, 40) * 20)::BIGINT AS frames, sum(greatest(0, behind - 1))::BIGINT AS late_ticks, count(*) FILTER (WHERE behind > 40) AS resync_count, sum(greatest(0, behind - 40) * 20)::BIGINT AS resync_frames FROM d")
def schedule_totals(spark, sf_dir):
    return pacing.schedule_totals(pacing.schedule(_ticks(spark, sf_dir).withColumnRenamed("k", "seq"), 5_000_000, 4000))


@query("playback_totals", "WITH s AS (SELECT 0.5::DOUBLE + user_id % 4 AS speed, event_id * 7 + 1000 AS elapsed_us, event_id * 3 + user_id % 20 AS emitted, event_id * 3 + 8 AS expected, user_id % 30 AS bound FROM events) SELECT count(*) AS segments, sum(elapsed_us)::BIGINT AS elapsed_us, sum(emitted)::BIGINT AS emitted, sum(expected)::BIGINT AS expected, sum(bound)::BIGINT AS bound, max(abs(emitted - expected)) AS largest_deviation, max(speed) AS fastest, (sum(emitted) - sum(expected))::BIGINT AS deviation, abs(sum(emitted) - sum(expected)) <= sum(bound) AS within FROM s")
def playback_totals(spark, sf_dir):
    n, u = F.col("event_id"), F.col("user_id")
    return pacing.playback_totals(table(spark, sf_dir, "events").select((F.lit(0.5) + u % 4).alias("speed"), (n * 7 + 1000).alias("elapsed_us"), (n * 3 + u % 20).alias("emitted"), (n * 3 + 8).alias("expected"), (u % 30).alias("bound")))


@query("playback_segments", f"""WITH {_EVENTS}, c AS (SELECT us AS at_us, event_id % 100 <> 0 AS playing, 0.5::DOUBLE + user_id % 4 AS speed FROM e WHERE event_id % 50 = 0), s AS (SELECT *, lead(at_us) OVER (ORDER BY at_us) AS until_us FROM c)
SELECT at_us, until_us, speed, until_us - at_us AS elapsed_us, floor((until_us - at_us) / 1e6::DOUBLE * 4000::DOUBLE * speed)::BIGINT AS expected, greatest(1, floor(4000::DOUBLE * speed * 5000000 / 1e9::DOUBLE + 0.5::DOUBLE))::BIGINT AS bound FROM s WHERE playing AND until_us IS NOT NULL""")
def playback_segments(spark, sf_dir):
    c = events(spark, sf_dir).where("event_id % 50 = 0").select(F.col("us").alias("at_us"), (F.col("event_id") % 100 != 0).alias("playing"), (F.lit(0.5) + F.col("user_id") % 4).alias("speed"))
    last = c.agg(F.max("at_us")).first()[0] or 0
    return pacing.playback_segments(c, rate=4000, stop_us=last).where("elapsed_us > 0 OR until_us < " + str(last))


@query("emit_schedule", f"WITH {_RECORDED} SELECT frame, floor((frame - 100) * 1e6::DOUBLE / 8000::DOUBLE + 0.5::DOUBLE)::BIGINT AS due_us FROM f WHERE frame >= 100")
def emit_schedule(spark, sf_dir):
    return pacing.emit_schedule(recorded(spark, sf_dir).where("frame >= 100"), 100, 4000, 2.0)


@query("throttled_log", """WITH RECURSIVE e AS (SELECT DISTINCT event_type AS event, epoch_us(ts) // 1000 AS at_ms FROM events),
n AS MATERIALIZED (SELECT a.event, a.at_ms, b.at_ms AS next_ms FROM (SELECT event, at_ms, at_ms + 600000 AS due FROM e) a ASOF JOIN e b ON a.event = b.event AND a.due <= b.at_ms),
r AS (SELECT event, min(at_ms) AS at_ms FROM e GROUP BY event UNION ALL SELECT n.event, n.next_ms FROM r JOIN n ON n.event = r.event AND n.at_ms = r.at_ms)
SELECT event, at_ms FROM r""")
def throttled_log(spark, sf_dir):
    return pacing.throttled(events(spark, sf_dir).select(F.col("event_type").alias("event"), F.floor(F.col("us") / 1000).alias("at_ms")), 600_000)


@query("tumbling_events", f"WITH {_EVENTS} SELECT us // 3600000000 AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL")
def tumbling_events(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.floor(F.col("us") / 3_600_000_000).alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("session_events", f"""WITH {_EVENTS}, p AS (SELECT user_id, us, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 1800000000, false)::INTEGER AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS session FROM p) SELECT user_id, min(us) AS begin_us, max(us) AS end_us, count(*) AS events FROM s GROUP BY user_id, session""")
def session_events(spark, sf_dir):
    return sequence.session_runs(events(spark, sf_dir), F.col("us"), 1_800_000_000, keys=["user_id"])


# Scalar functions.

@query("parse_position", """SELECT event_id, (CASE WHEN user_id % 13 = 0 THEN NULL WHEN k = 0 THEN event_id WHEN k = 1 THEN event_id * 4000 + 1000 WHEN k = 2 THEN event_id * 4
  WHEN k = 3 THEN event_id * 4000 WHEN k = 4 THEN event_id * 240000 WHEN k = 5 THEN event_id * 14400000 ELSE -event_id * 4000 END)::BIGINT AS frame FROM (SELECT *, event_id % 7 AS k FROM events)""")
def parse_position(spark, sf_dir):
    n = F.col("event_id")
    forms = [F.concat(F.lit("#"), n), F.concat(n, F.lit(".25s")), F.concat(F.lit(" "), n, F.lit(" ms ")), F.concat(F.floor(n / 60), F.lit(":"), n % 60), F.concat(n, F.lit("m")), F.concat(n, F.lit("h")), F.concat(F.lit("-"), n)]
    spec = F.when(F.col("user_id") % 13 == 0, F.when(n % 2 == 0, F.lit(""))).otherwise(F.element_at(F.array(*forms), (n % 7 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", text.position(spec, 4000).alias("frame"))


@query("parse_channels", """SELECT event_id, CASE WHEN k = 0 THEN range(8) WHEN k = 1 THEN [0, 2, 4, 6] WHEN k = 2 THEN [1, 3, 5, 7] WHEN k = 3 THEN range(8) ELSE list_sort(list_distinct(list_concat([a], range(least(a, b), greatest(a, b) + 1)))) END::INTEGER[] AS channels
FROM (SELECT event_id, event_id % 5 AS k, user_id % 8 AS a, event_id // 5 % 8 AS b FROM events)""")
def parse_channels(spark, sf_dir):
    n, a, b = F.col("event_id"), F.col("user_id") % 8, F.floor(F.col("event_id") / 5) % 8
    spec = F.when(n % 5 == 0, F.lit("all")).when(n % 5 == 1, F.lit("even")).when(n % 5 == 2, F.lit("odd")).when(n % 5 == 4, F.concat(a, F.lit(" ,"), F.least(a, b), F.lit("-"), F.greatest(a, b)))
    return table(spark, sf_dir, "events").select("event_id", text.channel_list(spec, 8).alias("channels"))


@query("format_numbers", """SELECT o_orderkey, format('{:,}', o_orderkey * 98765) AS count_text,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.4f KiB', b / 1024::DOUBLE) WHEN b < 1073741824 THEN printf('%.4f MiB', b / 1048576::DOUBLE) WHEN b < 1099511627776 THEN printf('%.4f GiB', b / 1073741824::DOUBLE) ELSE printf('%.4f TiB', b / 1099511627776::DOUBLE) END AS size_text,
  printf('%02d:%02d:%06.3f', s // 3600, s // 60 % 60, (s % 60)::DOUBLE) AS duration_text, printf('%.6f', s / 4000::DOUBLE) AS seconds_text
FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 7919 AS b, o_orderkey * 13 AS s FROM orders)""")
def format_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", text.integer(k * 98765).alias("count_text"), text.bytes_text(k * k * 7919).alias("size_text"), text.duration(k * 13).alias("duration_text"), text.fixed(k * 13 / F.lit(4000.0), 6).alias("seconds_text"))


@query("iso_times", f"WITH {_EVENTS} SELECT event_id, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM e")
def iso_times(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", text.iso_time(F.col("us") * 1000).alias("iso"))


@query("clamped_speeds", "SELECT event_id, greatest(0.05::DOUBLE, least(16::DOUBLE, value / 10)) AS speed, floor((value * 4000::DOUBLE * (22 + 12 * (user_id % 32))) + 0.5::DOUBLE)::BIGINT AS csv_bytes FROM events")
def clamped_speeds(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", lookup.speed(F.col("value") / 10).alias("speed"), text.csv_size_estimate(F.col("value"), F.lit(4000.0), F.col("user_id") % 32).alias("csv_bytes"))


@query("widened_values", f"WITH {_DENSE} SELECT frame, channel, value::DOUBLE AS widened FROM d")
def widened_values(spark, sf_dir):
    return dense(spark, sf_dir).select("frame", "channel", text.widened(F.col("value")).cast("double").alias("widened"))


@query("crc32c_documents")
def crc32c_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", crc32c_udf(F.encode("text", "UTF-8")).alias("crc32c"))


# Side data.

@query("prune_recordings", "SELECT s_name AS name FROM supplier QUALIFY row_number() OVER (ORDER BY s_name DESC) > 10")
def prune_recordings(spark, sf_dir):
    return lookup.older_than_newest(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")), 10)


@query("prune_siblings", "SELECT s_name || x AS file FROM supplier, (VALUES ('.rec'), ('.json')) v(x) WHERE s_name NOT IN (SELECT s_name FROM supplier ORDER BY s_name DESC LIMIT 10)")
def prune_siblings(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(".rec")).alias("name"))
    files = n.select(F.col("name").alias("file")).unionByName(n.select(F.regexp_replace("name", r"\.rec$", ".json").alias("file")))
    return lookup.with_siblings(files, lookup.older_than_newest(n, 10))


@query("telemetry_log", "SELECT event_id AS line_number, epoch_us(ts) // 1000 AS t, event_id * 20 AS \"framesReceived\", round(value, 2) AS \"ringFillPct\", event_type AS \"ringLevel\" FROM events WHERE user_id % 10 <> 3")
def telemetry_log(spark, sf_dir):
    e = events(spark, sf_dir)
    line = F.to_json(F.struct(F.floor(F.col("us") / 1000).alias("t"), (F.col("event_id") * 20).alias("framesReceived"), F.round("value", 2).alias("ringFillPct"), F.col("event_type").alias("ringLevel")))
    torn = F.when(F.col("user_id") % 10 == 3, F.substring(line, 1, 12)).otherwise(line)
    return side.telemetry(e.select(F.col("event_id").alias("line_number"), torn.alias("value"))).select("line_number", "t", "framesReceived", "ringFillPct", "ringLevel")


@query("latest_event", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'error' ORDER BY event_id DESC LIMIT 1")
def latest_event(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "event_type", "value")
    return side.latest(e, F.col("event_type") != "error", F.col("event_id"))


@query("sidecar_match", "SELECT s_suppkey::VARCHAR AS stem, 'id' || s_suppkey AS recording_id, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN false ELSE true END AS matches FROM supplier")
def sidecar_match(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("stem"), F.concat(F.lit("id"), "s_suppkey").alias("recording_id"), "s_suppkey")
    found = s.where("s_suppkey % 5 <> 0").select("stem", F.when(F.col("s_suppkey") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("recording_id").alias("recordingId")))).alias("json"))
    return side.sidecar_matches(s.select("stem", "recording_id"), found)


@query("first_rows_per_type", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 3")
def first_rows_per_type(spark, sf_dir):
    return lookup.first_per_group(events(spark, sf_dir).select("event_type", "event_id", "value"), ["event_type"], ["event_id"], 3)


# The file format, written and read back.

def _written(spark: SparkSession, frames: DataFrame, frames_per_block: int, rate: float) -> str:
    """frames(frame, values) as one recording."""
    uri = f"{scratch(spark, 'recording')}/whole.sigb"
    assembly.write_recording(frames, uri, rate=rate, frames_per_block=frames_per_block)
    return uri


def _recorded_embeddings(spark: SparkSession, sf_dir: str) -> str:
    e = table(spark, sf_dir, "embeddings").where("vec_id % 50 <> 7").select(F.col("vec_id").alias("frame"), F.col("embedding").alias("values"))
    return _written(spark, e, 40, 100.0)


@query("recording_round_trip", f"WITH {_DENSE} SELECT frame, channel, value FROM d WHERE frame % 50 <> 7")
def recording_round_trip(spark, sf_dir):
    return recording.read(spark, _recorded_embeddings(spark, sf_dir)).select("frame", "channel", "value")


@query("recording_range", f"WITH {_DENSE} SELECT frame, channel, value FROM d WHERE frame % 50 <> 7 AND frame >= 130 AND frame < 417 AND channel IN (1, 5, 63)")
def recording_range(spark, sf_dir):
    return recording.read(spark, _recorded_embeddings(spark, sf_dir)).where("frame >= 130 AND frame < 417 AND channel IN (1, 5, 63)").select("frame", "channel", "value")


@query("recording_ledger", "SELECT start_frame, frame_count, 4 AS cause_code, 'header' AS source FROM (SELECT vec_id AS start_frame, 1::BIGINT AS frame_count FROM embeddings WHERE vec_id % 50 = 7)")
def recording_ledger(spark, sf_dir):
    return recording.read(spark, _recorded_embeddings(spark, sf_dir), "ledger").select("start_frame", "frame_count", "cause_code", "source")


@query("recording_validation", """WITH k AS (SELECT * FROM embeddings WHERE vec_id % 50 <> 7), t AS (SELECT count(*) * 64 AS recorded, ((max(vec_id) + 1) - count(*)) * 64 AS missing, (count(*) FILTER (WHERE label = 3)) AS incorrect FROM k)
SELECT recorded, missing::BIGINT AS missing, 0::BIGINT AS duplicated, incorrect, 0::BIGINT AS corrupt, true AS ledger_agrees, recorded AS expected, (missing + incorrect > 0)::INTEGER AS exit_code, CASE WHEN missing + incorrect > 0 THEN 'FAIL' ELSE 'PASS' END AS result FROM t""")
def recording_validation(spark, sf_dir):
    from .api import open_recording

    e = table(spark, sf_dir, "embeddings").where("vec_id % 50 <> 7")
    wrong = lambda i: F.when((F.col("label") == 3) & (i == F.col("vec_id") % 64), 1.0).otherwise(0.0)
    values = F.transform("embedding", lambda _, i: (signal.value(i, F.col("vec_id")) + wrong(i)).cast("float"))
    return open_recording(spark, _written(spark, e.select(F.col("vec_id").alias("frame"), values.alias("values")), 500, 1000.0)).validate()


@query("indexed_ranges", f"WITH {_DENSE}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), r AS (SELECT c_custkey AS range_id, c_custkey * 37 % n AS low, c_custkey * 37 % n + c_custkey % 9 AS high FROM customer, n) SELECT range_id, frame, channel, value FROM r JOIN d ON frame >= low AND frame < high AND channel IN (1, 5) AND frame % 50 <> 7")
def indexed_ranges(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    headers = index.build(spark, _recorded_embeddings(spark, sf_dir), scratch(spark, "index"))
    n = e.agg((F.max("vec_id") + 1).alias("n"))
    low = F.col("c_custkey") * 37 % F.col("n")
    ranges = table(spark, sf_dir, "customer").join(F.broadcast(n)).select(F.col("c_custkey").alias("range_id"), low.alias("low"), (low + F.col("c_custkey") % 9).alias("high"))
    return index.samples(headers, ranges, [1, 5]).select("range_id", "frame", "channel", "value")


# Wire streams of the events: a stream per type, a record per event, cut within records; some records are damaged.

def _wire_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    records = e.select(F.col("event_type").alias("stream"), F.col("event_id").alias("seq"), (F.col("event_id") * 10).alias("start_frame"), F.lit(10).alias("frame_count"), F.lit(1).alias("channel_count"), (F.col("user_id") % 2).cast("int").alias("flags"), F.encode(F.col("value").cast("string"), "UTF-8").alias("payload"), "user_id")
    sent = wire.encoded(records, keep=("user_id",))
    broken = F.concat(F.expr("substring(data, 1, octet_length(data) - 1)"), F.lit(b"#"))  # no value ends so
    data = F.when(F.col("user_id") % 20 == 7, broken).when(F.col("user_id") % 20 == 9, F.concat(F.lit(b"SGB1junk"), F.col("data"))).otherwise(F.col("data"))
    cut = sent.select("stream", "seq", data.alias("data")).select("stream", "seq", F.posexplode(F.array(F.expr("substring(data, 1, 21)"), F.expr("substring(data, 22, octet_length(data))"))).alias("k", "data"))
    path = scratch(spark, "wire-sent")  # it is read more than once
    cut.select("stream", (F.col("seq") * 2 + F.col("k")).alias("seq"), "data").write.parquet(path)
    return spark.read.schema("stream string, seq long, data binary").parquet(path)


@query("wire_records", "SELECT event_type AS stream, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq, event_id * 10 AS start_frame, 10::BIGINT AS frame_count, (user_id % 2)::INTEGER AS flags, value FROM events WHERE user_id % 20 <> 7")
def wire_records(spark, sf_dir):
    r = wire.decoded(_wire_chunks(spark, sf_dir), most=1 << 16, span=1 << 19)
    return r.select("stream", "seq", "start_frame", "frame_count", "flags", F.decode("payload", "UTF-8").cast("double").alias("value"))


@query("wire_totals", """WITH r AS (SELECT event_type AS stream, event_id AS seq, event_id * 10 AS s, 10 AS n FROM events WHERE user_id % 20 <> 7),
x AS (SELECT *, coalesce(max(s + n) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s) AS e FROM r),
t AS (SELECT stream, count(*) AS blocks, sum(n)::BIGINT AS frames, count(*) FILTER (WHERE s > e) AS gaps, sum(greatest(0, s - e))::BIGINT AS gap_frames FROM x GROUP BY stream),
d AS (SELECT event_type AS stream, count(*) FILTER (WHERE user_id % 20 = 7) AS crc_failures FROM events GROUP BY event_type)
SELECT stream, coalesce(blocks, 0) AS blocks, coalesce(frames, 0) AS frames, coalesce(gaps, 0) AS gaps, coalesce(gap_frames, 0) AS gap_frames, 0::BIGINT AS duplicates, 0::BIGINT AS duplicate_frames, crc_failures FROM d LEFT JOIN t USING (stream)""")
def wire_totals(spark, sf_dir):
    found = wire.decode(_wire_chunks(spark, sf_dir), most=1 << 16, span=1 << 19)
    return sequence.wire_totals(sequence.wire_sequence(found.records, keys=["stream"]), found.statistics).drop("corrupt_bytes")


@query("resident_frames", """WITH f AS (SELECT event_type, event_id AS frame FROM events), g AS (SELECT *, frame - row_number() OVER (PARTITION BY event_type ORDER BY frame) AS island FROM f),
s AS (SELECT event_type, island, count(*) AS n FROM g GROUP BY ALL) SELECT event_type, sum(n % 3)::BIGINT AS resident_frames, count(*) FILTER (WHERE n % 3 > 0) AS open_segments FROM s GROUP BY event_type""")
def resident_frames(spark, sf_dir):
    return sequence.resident(table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("frame")), 3, keys=["event_type"])


@query("frames_of_times", "SELECT event_id, floor((value - 100) * 250 + 0.5)::BIGINT AS nearest, floor((value - 100) * 250)::BIGINT AS due, trunc((value - 100) * 250)::BIGINT AS cut FROM events")
def frames_of_times(spark, sf_dir):
    t = F.col("value") - 100
    return table(spark, sf_dir, "events").select("event_id", text.frame_at(t, 250).alias("nearest"), text.frame_at(t, 250, "floor").alias("due"), text.frame_at(t, 250, "truncate").alias("cut"))


@query("wire_damage", "SELECT event_type AS stream, count(*) FILTER (WHERE user_id % 20 <> 7) AS records, count(*) FILTER (WHERE user_id % 20 = 7) AS crc_failures, count(*) FILTER (WHERE user_id % 20 IN (7, 9)) > 0 AS damaged FROM events GROUP BY event_type")
def wire_damage(spark, sf_dir):
    chunks = _wire_chunks(spark, sf_dir)
    total = chunks.groupBy("stream").agg(F.sum(F.octet_length("data")).alias("bytes"))
    found = wire.decode(chunks, most=1 << 16, span=1 << 19)
    used = found.records.groupBy("stream").agg(F.sum(F.octet_length("payload") + 32).alias("used"))
    s = found.statistics.join(total, "stream").join(used, "stream")
    whole = F.col("used") + F.col("corrupt_bytes") + F.col("tail_bytes") == F.col("bytes")  # every byte is a record's or damage
    return s.select("stream", F.when(whole, F.col("records")).alias("records"), "crc_failures", (F.col("corrupt_bytes") > 0).alias("damaged"))


@query("ingest_blocks", """WITH r AS (SELECT event_type AS stream, event_id AS seq, event_id * 4 + CASE WHEN user_id % 10 = 0 THEN user_id % 7 - 3 ELSE 0 END AS s, (CASE WHEN user_id % 5 = 0 THEN 9 ELSE 4 END) AS n FROM events),
x AS (SELECT *, coalesce(max(s + n) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s) AS e FROM r),
f AS (SELECT stream, unnest(range(greatest(s, e), s + n)) AS frame FROM x WHERE s + n > e),
p AS (SELECT *, lag(frame) OVER (PARTITION BY stream ORDER BY frame) AS prev FROM f),
g AS (SELECT *, max(CASE WHEN prev IS NULL OR frame > prev + 1 THEN frame END) OVER (PARTITION BY stream ORDER BY frame) AS b FROM p),
k AS (SELECT stream, b, (frame - b) // 7 AS part, min(frame) AS start_frame, count(*) AS frame_count FROM g GROUP BY ALL)
SELECT stream, row_number() OVER w - 1 AS block_index, start_frame, frame_count,
  CASE WHEN part = 0 THEN start_frame - coalesce(lag(start_frame + frame_count) OVER w, 0) ELSE 0 END AS preceding_gap, frame_count < 7 AS short
FROM k WINDOW w AS (PARTITION BY stream ORDER BY start_frame)""")
def ingest_blocks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    start = F.col("event_id") * 4 + F.when(F.col("user_id") % 10 == 0, F.col("user_id") % 7 - 3).otherwise(0)
    records = e.select(F.col("event_type").alias("stream"), F.col("event_id").alias("seq"), start.alias("start_frame"), F.when(F.col("user_id") % 5 == 0, 9).otherwise(4).cast("long").alias("frame_count"))
    return ingest.ingested_batch(records, 7)
