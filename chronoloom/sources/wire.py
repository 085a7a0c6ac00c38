"""Wire streams: framed records in byte chunks, found in parallel, with resynchronisation after damage.

A record is sound if its magic, header, length and checksum are right. Reading from the left, the next record
is always the first sound one that begins at or behind the end of the record before; bytes between are damage.
So which bytes are records doesn't depend on how a stream is cut.

`decoded` cuts a stream into spans. A task finds all sound records that begin in its span (it also gets the
bytes that such a record may reach into), without knowing where the span before left off. What a span does to
the reading position is a small step function; these are composed along the stream, one row per span, and say
where reading really enters each span. Only records that overlap others need more than a comparison with that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..functions.crc import crc32c, crc32c_many
from ..operators.ordered import running_all
from ..shared import scratch, ship
from . import layout

_MAGIC = np.frombuffer(np.uint32(layout.WIRE_MAGIC).tobytes(), np.uint8)
RECORDS = "seq long, start_frame long, frame_count long, channel_count int, flags int, payload binary"
#: A payload above this is taken for damage.
MOST_PAYLOAD = 1 << 24
#: Bytes of a span at least.
SPAN = 4 << 20
#: Bytes of records that are encoded or checked at once, about.
GATHERED = 4 << 20


class Marks:
    """All places of a buffer where a record may begin, ascending, and what is there.

    sound: a whole record; ends: where it would end; failed: whole, but with a wrong checksum; open: the buffer ends too
    early to tell. Other places are damage.
    """

    def __init__(self, data: bytes, most: int, limit: int | None = None):
        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        whole = np.flatnonzero((raw[: n - 3] == _MAGIC[0]) & (raw[1 : n - 2] == _MAGIC[1]) & (raw[2 : n - 1] == _MAGIC[2]) & (raw[3:] == _MAGIC[3])) if n > 3 else []
        begun = [i for i in range(max(0, n - 3), n) if data[i:] == _MAGIC[: n - i].tobytes()]  # cut off by the end of the buffer
        at = np.concatenate([whole, begun]).astype(np.int64)
        self.at = at = at if limit is None else at[at < limit]
        self.sound, self.failed, self.open = (np.zeros(len(at), bool) for _ in range(3))
        self.ends = np.zeros(len(at), np.int64)
        self.heads = np.zeros(len(at), layout.WIRE)
        told = at + layout.WIRE_HEADER <= n
        if told.any():
            self.heads[told] = raw[at[told][:, None] + np.arange(layout.WIRE_HEADER)].view(layout.WIRE)[:, 0]
        self.open[~told] = True
        like = np.flatnonzero(told & (self.heads["payload_bytes"] <= most) & (self.heads["header_bytes"] == layout.WIRE_HEADER))
        self.ends[like] = at[like] + layout.WIRE_HEADER + self.heads["payload_bytes"][like]
        self.open[like] = self.ends[like] > n
        like = like[self.ends[like] <= n]
        right = _checksums(raw, at[like], self.ends[like]) == self.heads["crc"][like]
        self.sound[like], self.failed[like] = right, ~right


def _checksums(raw: np.ndarray, ats: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The checksums of whole records: of all their bytes without the field itself. Short ones are gathered, some at a time."""
    out = np.zeros(len(ats), np.int64)
    size = ends - ats - 4
    for i in np.flatnonzero(size > 8192).tolist():
        out[i] = crc32c(np.concatenate((raw[ats[i] : ats[i] + layout.WIRE_HEADER - 4], raw[ats[i] + layout.WIRE_HEADER : ends[i]])))
    short = np.flatnonzero(size <= 8192)
    for own in np.split(short, np.flatnonzero(np.diff(np.cumsum(size[short]) // GATHERED)) + 1):
        bounds = np.concatenate(([0], np.cumsum(size[own])))
        within = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size[own])
        at = np.repeat(ats[own], size[own]) + within
        at[within >= layout.WIRE_HEADER - 4] += 4
        out[own] = crc32c_many(raw[at], bounds)
    return out


class Decoder:
    """Records of one stream, chunk by chunk. A place that may yet become a record waits for more bytes; `finish` ends the
    stream, and what waits is then damage unless nothing sound follows it: such a rest counts as tail_bytes."""

    def __init__(self, most: int = MOST_PAYLOAD):
        self.rest, self.most = b"", most
        self.corrupt_bytes = self.crc_failures = self.tail_bytes = 0

    def _read(self, data: bytes, last: bool) -> Iterator[tuple[dict, bytes]]:
        marks, at = Marks(data, self.most), 0
        waits = None
        for i, a in enumerate(marks.at.tolist()):
            if a < at:
                continue
            if marks.open[i]:
                waits = a if waits is None else waits
                if not last:
                    break
            elif marks.sound[i]:
                self.corrupt_bytes += a - at
                yield layout.as_dict(marks.heads[i]), data[a + layout.WIRE_HEADER : int(marks.ends[i])]
                at, waits = int(marks.ends[i]), None
            elif marks.failed[i]:
                self.crc_failures += 1
        keep = len(data) if waits is None else waits
        self.corrupt_bytes += keep - at
        self.rest = data[keep:]

    def push(self, chunk: bytes) -> Iterator[tuple[dict, bytes]]:
        yield from self._read(self.rest + chunk, False)

    def finish(self) -> Iterator[tuple[dict, bytes]]:
        yield from self._read(self.rest, True)
        self.tail_bytes, self.rest = len(self.rest), b""


def _steps(ats: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """The span's step function: reading that arrives at or before limits[k] (and behind limits[k - 1]) leaves at exits[k]."""
    after = np.searchsorted(ats, ends).tolist()
    exits = ends.tolist()
    for i in range(len(exits) - 1, -1, -1):
        if after[i] < len(exits):
            exits[i] = exits[after[i]]
    exits = np.array(exits, np.int64)
    last = np.flatnonzero(np.append(exits[1:] != exits[:-1], True)) if len(ats) else np.empty(0, np.int64)
    return ats[last].tolist(), exits[last].tolist()


_FOUND = "stream string, span long, at long, until long, nth long, start_frame long, frame_count long, channel_count int, flags int, payload binary, limits array<long>, exits array<long>, ats array<long>, ends array<long>, failed array<long>, open array<long>, bytes long"


def _spans(chunks: DataFrame, most: int, span: int) -> DataFrame:
    """stream, span, at, data: the pieces of every span, with what follows it as far as a record of it may reach."""
    reach = most + layout.WIRE_HEADER
    c = chunks.select(F.col("stream").cast("string").alias("stream"), F.col("seq").cast("long").alias("seq"), F.coalesce("data", F.lit(b"")).alias("data"))
    c = running_all(c, {"offset": ("sum", F.octet_length("data").cast("long"), True)}, order=["seq"], keys=["stream"])
    c = c.withColumn("stop", F.col("offset") + F.octet_length("data")).where("stop > offset")
    first = F.greatest(F.lit(0), F.floor((F.col("offset") - reach) / span))
    c = c.withColumn("span", F.explode(F.sequence(first, F.floor((F.col("stop") - 1) / span))))
    a, z = F.greatest("offset", F.col("span") * span), F.least("stop", (F.col("span") + 1) * span + reach)
    c = c.withColumns({"at": a, "size": z - a}).where("size > 0")
    return c.select("stream", "span", "at", F.expr("substring(data, CAST(at - offset + 1 AS INT), CAST(size AS INT))").alias("data"))


def _found(pieces: DataFrame, most: int, span: int) -> DataFrame:
    """The sound records that begin in each span, and a closing row per span (at null) with its summary."""

    def rows_of(stream, number, data):
        low = number * span
        marks = Marks(data, most, span)
        at, ends = marks.at[marks.sound] + low, marks.ends[marks.sound] + low
        overlaps = bool((ends[:-1] > at[1:]).any())
        failed = marks.at[marks.failed] + low
        if len(at) and not overlaps:  # those inside a record don't count
            k = np.searchsorted(at, failed, "right") - 1
            failed = failed[(k < 0) | (failed >= ends[np.maximum(k, 0)])]
        limits, exits = _steps(at, ends)
        heads = marks.heads[marks.sound]
        values = {"stream": pa.repeat(pa.scalar(stream, pa.string()), len(at)), "span": np.full(len(at), number), "at": at, "until": ends, "nth": np.arange(len(at))}
        values |= {k: pa.array(heads[k]) for k in ("start_frame", "frame_count", "channel_count", "flags")}
        values["payload"] = [data[a:e] for a, e in zip((at - low + layout.WIRE_HEADER).tolist(), (ends - low).tolist())]
        if len(at):
            yield pa.RecordBatch.from_arrays([_column(values.get(f.name), f.type, len(at)) for f in _ARROW], schema=_ARROW)
        keep = (at.tolist(), ends.tolist()) if overlaps else (None, None)
        closing = {"stream": stream, "span": number, "limits": limits, "exits": exits, "ats": keep[0], "ends": keep[1], "failed": failed.tolist(), "open": (marks.at[marks.open] + low).tolist(), "bytes": low + len(data)}
        yield pa.RecordBatch.from_pylist([closing], _ARROW)

    def run(batches):
        now, held = None, []
        for batch in batches:
            streams, numbers = batch.column("stream").dictionary_encode(), batch.column("span").to_numpy()
            codes = streams.indices.fill_null(-1).to_numpy()
            edges = np.flatnonzero((codes[1:] != codes[:-1]) | (numbers[1:] != numbers[:-1])) + 1
            raw, offsets = _bytes_of(batch.column("data"))
            for a, z in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if a == z:
                    continue
                name = (batch.column("stream")[a].as_py(), int(numbers[a]))
                if name != now:
                    if held:
                        yield from rows_of(*now, b"".join(held))
                    now, held = name, []
                held.append(raw[offsets[a] : offsets[z]].tobytes())
        if held:
            yield from rows_of(*now, b"".join(held))

    tasks = max(1, pieces.sparkSession.sparkContext.defaultParallelism)
    spread = pieces.repartition(tasks, "stream", "span").sortWithinPartitions("stream", "span", "at")
    return spread.mapInArrow(run, _FOUND)


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _FOUND.split(", ")])


def _column(values, kind: pa.DataType, n: int) -> pa.Array:
    if values is None:
        return pa.nulls(n, kind)
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _bytes_of(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the offsets of its rows in them; null is empty."""
    data = data.cast(pa.large_binary()).fill_null(b"")
    _, offsets, raw = data.buffers()
    offsets = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    return np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8), offsets


def _chain(ats, ends, entry: int) -> list[int]:
    """Of overlapping records, those that reading from `entry` takes."""
    out = []
    for a, e in zip(ats, ends):
        if a >= entry:
            out.append(a)
            entry = e
    return out


def _entered(summaries: DataFrame) -> DataFrame:
    """stream, span, entry, chosen, failures, tail: where reading enters each span; of spans whose records overlap, the ones that
    are taken; checksum failures outside records; and in a stream's last span the bytes of a record that isn't whole."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("span")
        at, out = 0, []
        last = int(pdf["bytes"].max()) if len(pdf) else 0
        for s in pdf.itertuples():
            out.append([s.stream, s.span, at, 0])
            k = int(np.searchsorted(np.asarray(s.limits, np.int64), at)) if len(s.limits) else 0
            if k < len(s.limits):
                at = int(s.exits[k])
        opens = [q for row in pdf["open"] for q in row if q >= at]
        if out and opens:
            out[-1][3] = last - min(opens)
        return pd.DataFrame(out, columns=["stream", "span", "entry", "tail"])

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s in pdf.itertuples():
                taken = _chain(s.ats, s.ends, s.entry) if s.ats is not None else None
                failed = np.asarray(s.failed, np.int64)
                failed = failed[failed >= s.entry]
                if taken and len(failed):
                    until = dict(zip(s.ats, s.ends))
                    k = np.searchsorted(taken, failed, "right") - 1
                    failed = failed[(k < 0) | (failed >= np.array([until[a] for a in taken])[np.maximum(k, 0)])]
                out.append([s.stream, s.span, s.entry, taken, len(failed), s.tail])
            yield pd.DataFrame(out, columns=["stream", "span", "entry", "chosen", "failures", "tail"])

    entries = summaries.select("stream", "span", "limits", "exits", "open", "bytes").groupBy("stream").applyInPandas(fold, "stream string, span long, entry long, tail long")
    whole = summaries.alias("s").join(entries.alias("e"), F.col("s.stream").eqNullSafe(F.col("e.stream")) & (F.col("s.span") == F.col("e.span")))
    return whole.select("s.stream", "s.span", "ats", "ends", "failed", "entry", "tail").mapInPandas(told, "stream string, span long, entry long, chosen array<long>, failures long, tail long")


class Decoded:
    """What `decode` found: records (stream, RECORDS) and statistics (stream, records, corrupt_bytes, crc_failures, tail_bytes)."""

    def __init__(self, records: DataFrame, statistics: DataFrame):
        self.records, self.statistics = records, statistics


def decode(chunks: DataFrame, *, most: int = MOST_PAYLOAD, span: int | None = None) -> Decoded:
    """The records of chunks(stream, seq, data), each stream's chunks in order of seq; see the module's text.

    What is found is written once to the shared folder. A stream's summaries, one row per span, meet in one task; records
    and bytes never do. Null and empty chunks hold nothing; seq is unique within a stream; streams without records get a row of statistics.
    """
    spark = chunks.sparkSession
    ship(spark)
    span = span or max(SPAN, 4 * (most + layout.WIRE_HEADER))
    path = scratch(spark, "wire")
    _found(_spans(chunks, most, span), most, span).write.parquet(path)
    saved = spark.read.schema(_FOUND).parquet(path)
    summaries = saved.where("at IS NULL")
    where = scratch(spark, "wire-entries")
    _entered(summaries.select("stream", "span", "limits", "exits", "ats", "ends", "failed", "open", "bytes")).write.parquet(where)
    entered = spark.read.parquet(where)
    found = saved.where("at IS NOT NULL").join(entered.select("stream", "span", "entry", "chosen"), ["stream", "span"])
    found = found.where((F.col("at") >= F.col("entry")) & (F.col("chosen").isNull() | F.array_contains("chosen", F.col("at"))))
    per = found.groupBy("stream", "span").agg(F.count("*").alias("n"), F.min("nth").alias("least"), F.sum(F.col("until") - F.col("at")).alias("used"))
    per = running_all(per, {"base": ("sum", F.col("n"), True)}, order=["span"], keys=["stream"])
    rank = F.when(F.col("chosen").isNull(), F.col("nth") - F.col("least")).otherwise(F.array_position("chosen", F.col("at")) - 1)
    records = found.join(per.select("stream", "span", "base", "least"), ["stream", "span"])
    records = records.select("stream", (F.col("base") + rank).alias("seq"), "start_frame", "frame_count", "channel_count", "flags", "payload")
    whole = summaries.groupBy("stream").agg(F.max("bytes").alias("bytes"))
    told = entered.groupBy("stream").agg(F.sum("failures").alias("crc_failures"), F.sum("tail").alias("tail_bytes"))
    used = per.groupBy("stream").agg(F.sum("n").alias("records"), F.sum("used").alias("used"))
    statistics = whole.join(told, "stream").join(used, "stream", "left").select(
        "stream", F.coalesce("records", F.lit(0)).alias("records"), (F.col("bytes") - F.coalesce("used", F.lit(0)) - F.col("tail_bytes")).alias("corrupt_bytes"), "crc_failures", "tail_bytes",
    )
    return Decoded(records, statistics)


def decoded(chunks: DataFrame, *, most: int = MOST_PAYLOAD, span: int | None = None) -> DataFrame:
    """The records alone; see decode."""
    return decode(chunks, most=most, span=span).records


def encoded(records: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """stream, seq, data: the bytes of records(stream, seq, start_frame, frame_count, channel_count, flags, payload), a record a row.

    Columns named in `keep` go along. A null payload is empty; a null in another field, or a number that its field can't hold, is an error.
    """
    ship(records.sparkSession)
    kinds = {"start_frame": pa.uint64(), "frame_count": pa.uint32(), "channel_count": pa.uint16(), "flags": pa.uint8()}

    def run(batches):
        for b in batches:
            raw, offsets = _bytes_of(b.column("payload"))
            for own in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(offsets[1:] // GATHERED)) + 1):
                if not len(own):
                    continue
                a, z = int(own[0]), int(own[-1]) + 1
                fields = {c: b.column(c).slice(a, z - a).cast(kind) for c, kind in kinds.items()}
                if bad := [c for c, v in fields.items() if v.null_count]:
                    raise ValueError(f"records with null in {bad}")
                data, ends = layout.wire_many(raw, offsets[a : z + 1], **{c: v.to_numpy() for c, v in fields.items()})
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), z - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([b.column(c).slice(a, z - a) for c in ("stream", "seq")] + [data.cast(pa.binary())] + [b.column(c).slice(a, z - a) for c in keep], ["stream", "seq", "data", *keep])

    picked = records.select(F.col("stream").cast("string").alias("stream"), F.col("seq").cast("long").alias("seq"), *kinds, "payload", *keep)
    schema = StructType([StructField("stream", StringType()), StructField("seq", LongType()), StructField("data", BinaryType()), *[records.schema[c] for c in keep]])
    return picked.mapInArrow(run, schema)
