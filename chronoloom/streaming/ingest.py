"""Stateful ingest of wire records, per stream: order, duplicates, gaps, and blocks cut from open segments.

Records are taken in order of their seq, whatever order a micro-batch has them in; one that comes before its
predecessor waits in the state. Frames that were there before are duplicates and only a record's new tail counts.
A gap closes the open segment. How the input is cut into micro-batches changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import sequence

# Fixed value: state needs this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "stream string, kind string, start_frame long, frame_count long"
BLOCKS = "stream string, block_index long, start_frame long, frame_count long, preceding_gap long, short boolean, channel_count int, payload binary"
#: Records that wait for a missing one, at most; then the missing one is given up.
SLACK = 4096


def step(expected: int | None, start: int, count: int) -> tuple[int, list[tuple[str, int, int]]]:
    """What a record means after `expected`: gap, duplicate and accepted ranges; and the frame expected next."""
    e = start if expected is None else expected
    if start >= e:
        gap = [("gap", e, start - e)] if start > e else []
        return start + count, gap + [("accepted", start, count)]
    out = [("duplicate", start, min(e - start, count))]
    if start + count > e:
        out.append(("accepted", e, start + count - e))
    return max(e, start + count), out


class InOrder(StatefulProcessor):
    """Hands a stream's records to `take` in order of seq, which counts from 0. A repeated seq is passed over."""

    fields: tuple[tuple[str, str], ...] = (("start_frame", "long"), ("frame_count", "long"))

    def __init__(self, slack: int = SLACK):
        self.slack = slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.due = handle.getValueState("due", "seq long")
        self.early = handle.getMapState("early", "seq long", ", ".join(" ".join(f) for f in self.fields))

    def ordered(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        names = [n for n, _ in self.fields]
        due = self.due.get()[0] if self.due.exists() else 0
        waiting = {int(k[0]): tuple(v) for k, v in self.early.iterator()} if self.early.exists() else {}
        kept = set(waiting)
        for pdf in rows:
            for seq, *row in zip(pdf["seq"].tolist(), *(pdf[n].tolist() for n in names)):
                if seq >= due:
                    waiting.setdefault(int(seq), tuple(row))
        while waiting:
            if due not in waiting:
                if len(waiting) <= self.slack:
                    break
                due = min(waiting)
            yield waiting.pop(due)
            due += 1
        for seq in kept - set(waiting):
            self.early.removeKey((seq,))
        for seq in set(waiting) - kept:
            self.early.updateValue((seq,), tuple(None if v is None or v != v else bytes(v) if kind == "binary" else int(v) for v, (_, kind) in zip(waiting[seq], self.fields)))
        self.due.update((due,))

    def close(self) -> None:
        pass


class Sequencer(InOrder):
    """Events of each stream's records."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.expected = handle.getValueState("expected", "frame long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        e = self.expected.get()[0] if self.expected.exists() else None
        out = []
        for start, count in self.ordered(rows):
            e, found = step(e, int(start), int(count))
            out += [(key[0], *f) for f in found]
        if e is not None:
            self.expected.update((e,))
        yield pd.DataFrame(out, columns=["stream", "kind", "start_frame", "frame_count"])


class Ingest(InOrder):
    """Blocks of each stream: whole ones as soon as they are full, a short one at a gap or at the end of the stream.

    State: the frame behind the last accepted one, the open segment's frames not yet in a block (their bytes as a
    list), the gap before them, and the number of blocks so far.
    """

    fields = (("start_frame", "long"), ("frame_count", "long"), ("channel_count", "int"), ("payload", "binary"))

    def __init__(self, frames_per_block: int, slack: int = SLACK):
        super().__init__(slack)
        self.per = frames_per_block

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.position = handle.getValueState("position", "expected long, held long, gap long, blocks long, channels int")
        self.open = handle.getListState("open", "payload binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        expected, held, gap, blocks, channels = self.position.get() if self.position.exists() else (0, 0, 0, 0, 0)
        stored = held > 0
        pieces: list[bytes] | None = None if stored else []  # the stored bytes are read only if a block needs them
        fresh: list[bytes] = []
        out = []

        def emit(n: int) -> None:
            nonlocal held, gap, blocks, pieces, fresh
            if pieces is None:
                pieces = [bytes(p[0]) for p in self.open.get()]
            data = b"".join(pieces + fresh)
            cut = n * channels * 4
            values = np.frombuffer(data[:cut], "<f4").reshape(n, channels)
            out.append((key[0], blocks, expected - held, n, gap, n < self.per, channels, np.ascontiguousarray(values.T).tobytes()))
            pieces, fresh = ([data[cut:]] if len(data) > cut else []), []
            held, gap, blocks = held - n, 0, blocks + 1

        for start, count, width, payload in self.ordered(rows):
            if count is None or count != count or count < 0:  # the end of the stream
                if held:
                    emit(held)
                continue
            start, count, width, payload = int(start), int(count), int(width), bytes(payload or b"")
            if len(payload) != count * width * 4:
                raise ValueError(f"a record of {count} frames and {width} channels has {len(payload)} bytes")
            skip = min(count, max(0, expected - start))
            if count == skip:
                continue
            if start > expected or (channels and width != channels):
                if held:
                    emit(held)
                gap += max(0, start - expected)
                expected = max(expected, start)
            channels = width
            fresh.append(payload[skip * width * 4 :])
            held += count - skip
            expected = start + count
            while held >= self.per:
                emit(self.per)
        if pieces is None:  # no block was closed: what is stored stays as it is
            for p in fresh:
                self.open.appendValue((p,))
        elif pieces or fresh:
            self.open.put([(p,) for p in pieces + fresh])
        elif stored:
            self.open.clear()
        self.position.update((expected, held, gap, blocks, channels))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def sequenced(records: DataFrame, *, slack: int = SLACK) -> DataFrame:
    """EVENTS of streaming records(stream, seq, start_frame, frame_count)."""
    use_state_store(records.sparkSession)
    return records.groupBy("stream").transformWithStateInPandas(Sequencer(slack), outputStructType=EVENTS, outputMode="append", timeMode="none")


def ingested(records: DataFrame, frames_per_block: int, *, slack: int = SLACK) -> DataFrame:
    """BLOCKS of streaming records(stream, seq, start_frame, frame_count, channel_count, payload): payloads hold a frame's
    float32 values one frame after the other, blocks one channel after the other.

    A record without frame_count ends its stream: what is open becomes a short block. seq counts from 0 without holes; if more
    than `slack` records wait for one, it is given up. A change of channel_count ends a segment.
    """
    use_state_store(records.sparkSession)
    return records.groupBy("stream").transformWithStateInPandas(Ingest(frames_per_block, slack), outputStructType=BLOCKS, outputMode="append", timeMode="none")


def ingested_batch(records: DataFrame, frames_per_block: int) -> DataFrame:
    """The batch twin of `ingested`, without payloads: stream, block_index, start_frame, frame_count, preceding_gap, short."""
    kept = sequence.wire_sequence(records.where("frame_count > 0"), keys=["stream"])  # records without frames move nothing
    frames = kept.where("tail > 0").select("stream", F.explode(F.sequence(F.col("start_frame") + F.col("frame_count") - F.col("tail"), F.col("start_frame") + F.col("frame_count") - 1)).alias("frame"))
    return sequence.reblocked(frames, frames_per_block, keys=["stream"])
