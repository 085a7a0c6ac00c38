"""One recording written in parallel: blocks numbered by prefix sums and placed where the fixed stride puts them.

A block's number says where in the file it belongs, so tasks write their blocks to the file without knowing of
each other, and a task that runs twice writes the same bytes to the same place. `commit` then adds the one header
and the one ledger and gives the file its name. Stores without random writes get part files that are joined in
order by one streaming task.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal
from ..operators import sequence
from ..shared import scratch, ship
from . import layout
from .files import locate

#: Entries of a ledger at most; dropped_frames_total counts on, and the header says that the ledger is cut short.
MOST_ENTRIES = 65_536
#: Blocks of a task's range of frames.
TASK_BLOCKS = 64


@dataclass
class Target:
    """Where a recording is being written: its name, geometry, and a name of its own until it is whole."""

    uri: str
    channels: int
    frames_per_block: int
    in_place: bool
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def stride(self) -> int:
        return layout.BLOCK_HEADER + self.frames_per_block * self.channels * 4

    @property
    def path(self) -> str:
        return locate(self.uri)[1]

    @property
    def temp(self) -> str:
        return f"{self.path}.{self.token}"

    def place(self, blocks: list[tuple[int, bytes]]) -> None:
        """Writes blocks (number, bytes) with ascending numbers, that no other call writes."""
        fs, path = locate(self.uri)
        fs.create_dir(os.path.dirname(path) or ".", recursive=True)
        if self.in_place:
            f = os.open(self.temp, os.O_WRONLY | os.O_CREAT, 0o644)
            try:
                for number, data in blocks:
                    at = layout.FILE_HEADER + number * self.stride
                    while data:
                        n = os.pwrite(f, data, at)
                        data, at = data[n:], at + n
            finally:
                os.close(f)
            return
        fs.create_dir(self.temp, recursive=True)
        name = f"{self.temp}/{blocks[0][0]:020d}"
        attempt = f"{name}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(attempt) as out:
            for _, data in blocks:
                out.write(data + bytes(self.stride - len(data)))
        fs.move(attempt, name)  # a task that runs twice replaces equal bytes

    def commit(self, spark: SparkSession, entries: list[tuple[int, int, int]], head: dict, flags: int) -> None:
        """Header and ledger around the blocks that are in place; then the file gets its name."""
        ledger = layout.ledger_bytes(entries)
        at = layout.FILE_HEADER + head["block_count"] * self.stride
        first = layout.header_bytes(flags=flags | layout.FINALISED | layout.HAS_TRAILER, **head, channel_count=self.channels, frames_per_block=self.frames_per_block, block_stride_bytes=self.stride, trailer_offset=at, trailer_bytes=len(ledger), ledger_entry_count=len(entries))
        if self.in_place:
            os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
            f = os.open(self.temp, os.O_WRONLY | os.O_CREAT, 0o644)
            try:
                os.pwrite(f, first, 0)
                os.pwrite(f, ledger, at)
                os.fsync(f)
            finally:
                os.close(f)
            os.replace(self.temp, self.path)
            return
        target = self

        def join(batches):
            for _ in batches:
                pass
            fs, path = locate(target.uri)
            whole = f"{path}.{uuid.uuid4().hex}"
            parts = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(target.temp, allow_not_found=True)) if not x.path.endswith(".tmp"))
            with fs.open_output_stream(whole) as out:
                out.write(first)
                for p in parts:
                    with fs.open_input_stream(p) as part:
                        while piece := part.read(1 << 22):
                            out.write(piece)
                out.write(ledger)
            fs.move(whole, path)
            yield pa.RecordBatch.from_pylist([{"path": path}])

        spark.range(1).repartition(1).mapInArrow(join, "path string").collect()
        fs, _ = locate(self.uri)
        if fs.get_file_info(self.temp).type == pafs.FileType.Directory:
            fs.delete_dir(self.temp)


def _target(uri: str, channels: int, frames_per_block: int, in_place: bool | None) -> Target:
    local = isinstance(locate(uri)[0], pafs.LocalFileSystem)
    return Target(uri, channels, frames_per_block, local if in_place is None else in_place)


def _block(start: int, count: int, number: int, gap: int, per: int, payload: bytes) -> bytes:
    flags = layout.SHORT_BLOCK * (count < per) | layout.PRECEDED_BY_GAP * (gap > 0)
    return layout.block_bytes(payload, start_frame=start, frame_count=count, block_index=number, flags=flags, preceding_gap_frames=min(gap, 2**32 - 1))


def _commit(target: Target, blocks: DataFrame, *, rate: float, recording_id: bytes | None, cause: int, most_entries: int, dither: bool, signal_id: str) -> dict:
    """Totals and ledger of blocks(block_index, start_frame, frame_count, preceding_gap), and with them the target's commit."""
    lost = F.col("preceding_gap") > 0
    t = blocks.agg(F.count("*").alias("n"), F.sum("frame_count").alias("frames"), F.sum("preceding_gap").alias("dropped"), F.count(F.when(lost, 1)).alias("gaps")).first()
    first = blocks.where(lost).select((F.col("start_frame") - F.col("preceding_gap")).alias("start_frame"), "preceding_gap").orderBy("start_frame").limit(most_entries).collect()
    entries = [(r["start_frame"], r["preceding_gap"], cause) for r in first]
    frames, dropped = t["frames"] or 0, t["dropped"] or 0
    flags = layout.HAD_DROPS * (dropped > 0) | layout.LEDGER_TRUNCATED * (t["gaps"] > len(entries)) | layout.DITHER_DISABLED * (not dither)
    head = dict(recording_id=recording_id or uuid.uuid4().bytes, sample_rate_hz=round(rate), sample_rate_exact_hz=rate, signal_id=signal_id, producer="chronoloom", total_frames=frames, total_values=frames * target.channels, block_count=t["n"], duration_seconds=frames / rate, dropped_frames_total=dropped)
    target.commit(blocks.sparkSession, entries, head, flags)
    return {"path": target.uri, "block_count": t["n"], "total_frames": frames, "dropped_frames": dropped, "ledger_entries": len(entries), "ledger_truncated": t["gaps"] > len(entries)}


def write_recording(frames: DataFrame, uri: str, *, rate: float, frames_per_block: int, recording_id: bytes | None = None, cause: int = 4, most_entries: int = MOST_ENTRIES, dither: bool = True, signal_id: str = signal.SIGNAL_NAME, in_place: bool | None = None) -> dict | None:
    """frames(frame, values) as one recording, written in parallel; its totals, or None (and no file) if there are no rows.

    Blocks are cut and numbered from the frame numbers alone, over chunks of them. A task then gets a range of frames, and
    behind it as many as its last block may need; the values are shuffled once. Frame numbers are unique and not negative,
    all rows have equally many values; else the write fails and leaves no file of that name. Without a recording_id it
    gets one of its own. in_place: write at offsets (stores that can), or by part files; by default as the store can.
    """
    spark = frames.sparkSession
    ship(spark)
    some = frames.select(F.size("values").alias("n")).where("n > 0").first()
    if some is None:
        return None
    target, per = _target(uri, some["n"], frames_per_block, in_place), frames_per_block
    where = scratch(spark, "blocks")
    sequence.reblocked(frames.select(F.col("frame").cast("long").alias("frame")), per).write.parquet(where)
    blocks = spark.read.parquet(where)
    step = TASK_BLOCKS * per
    part = lambda c: F.floor(F.col(c) / step)
    empty = F.lit(None)
    heads = blocks.select(part("start_frame").alias("part"), F.lit(0).alias("kind"), F.col("start_frame").alias("at"), "frame_count", F.col("block_index").alias("number"), F.col("preceding_gap").alias("gap"), empty.cast("array<float>").alias("values"))
    own = part("frame")
    parts = F.when((F.col("frame") - own * step < per - 1) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    values = frames.select(F.explode(parts).alias("part"), F.lit(1).alias("kind"), F.col("frame").cast("long").alias("at"), empty.cast("long").alias("frame_count"), empty.cast("long").alias("number"), empty.cast("long").alias("gap"), F.col("values").cast("array<float>").alias("values"))

    def run(batches):
        now, want, done, held, size = None, [], [], [], 0

        def closed():
            """Cuts the blocks that are whole off what is held."""
            nonlocal held, size
            while want and size >= want[0][1]:
                start, count, number, gap = want[0]
                at, rows = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                if at[0] != start or at[count - 1] != start + count - 1 or (np.diff(at[:count]) != 1).any():
                    raise ValueError(f"frame numbers must be unique; see block {number} at frame {start}")
                done.append((number, _block(start, count, number, gap, per, np.ascontiguousarray(rows[:count].T).tobytes())))
                want.pop(0)
                held, size = ([(at[count:], rows[count:])], size - count) if size > count and want else ([], 0)

        def finished():
            if want:
                raise ValueError(f"block {want[0][2]} lacks frames: frame numbers must be unique")
            if done:
                target.place(done)

        for batch in batches:
            p = batch.column("part").to_numpy(zero_copy_only=False)
            k = batch.column("kind").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(p) != 0) | (np.diff(k) != 0)) + 1).tolist(), len(p)]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                if p[a] != now:
                    finished()
                    now, want, done, held, size = int(p[a]), [], [], [], 0
                piece = batch.slice(a, z - a)
                at = piece.column("at").to_numpy(zero_copy_only=False)
                if k[a] == 0:
                    want += list(zip(at.tolist(), *(piece.column(c).to_pylist() for c in ("frame_count", "number", "gap"))))
                    continue
                first = want[0][0] if want else None
                if first is None:
                    continue  # these frames belong to a block of the range before
                use = at >= first
                flat = piece.column("values").flatten().to_numpy(zero_copy_only=False).astype("<f4", copy=False)
                if len(flat) != len(at) * target.channels:
                    raise ValueError(f"every frame must have {target.channels} values")
                held.append((at[use], flat.reshape(len(at), -1)[use]))
                size += int(use.sum())
                closed()
        finished()
        yield pa.RecordBatch.from_pylist([], pa.schema([("part", pa.int64())]))

    tasks = max(1, spark.sparkContext.defaultParallelism)
    spread = heads.unionByName(values).repartition(tasks, "part").sortWithinPartitions("part", "kind", "at")
    spread.mapInArrow(run, "part long").write.format("noop").mode("overwrite").save()
    return _commit(target, blocks, rate=rate, recording_id=recording_id, cause=cause, most_entries=most_entries, dither=dither, signal_id=signal_id)


def assemble(blocks: DataFrame, uri: str, *, rate: float, frames_per_block: int, recording_id: bytes | None = None, cause: int = 4, most_entries: int = MOST_ENTRIES, dither: bool = True, signal_id: str = signal.SIGNAL_NAME, in_place: bool | None = None) -> dict | None:
    """One recording of blocks(block_index, start_frame, frame_count, preceding_gap, channel_count, payload), numbered from 0."""
    spark = blocks.sparkSession
    ship(spark)
    some = blocks.select("channel_count").first()
    if some is None:
        return None
    target = _target(uri, some["channel_count"], frames_per_block, in_place)

    def run(batches):
        now, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["channel_count"] != target.channels:
                    raise ValueError("all blocks of a recording have equally many channels")
                if r["part"] != now and held:
                    target.place(held)
                    held = []
                now = r["part"]
                held.append((r["block_index"], _block(r["start_frame"], r["frame_count"], r["block_index"], r["preceding_gap"], target.frames_per_block, r["payload"])))
        if held:
            target.place(held)
        yield pa.RecordBatch.from_pylist([], pa.schema([("part", pa.int64())]))

    tasks = max(1, spark.sparkContext.defaultParallelism)
    b = blocks.withColumn("part", F.floor(F.col("block_index") / TASK_BLOCKS))
    spread = b.repartition(tasks, "part").sortWithinPartitions("part", "block_index")
    spread.mapInArrow(run, "part long").write.format("noop").mode("overwrite").save()
    return _commit(target, blocks.drop("payload"), rate=rate, recording_id=recording_id, cause=cause, most_entries=most_entries, dither=dither, signal_id=signal_id)
