"""Recordings as a Spark data source: spark.read.format("recording").option("table", ...).load(path).

Tables: header, blocks, samples, planar, ledger, findings. Filters on frame and channel reach the source:
a frame range becomes the list of blocks whose sound headers overlap it, and a list of channels becomes
one contiguous read per block and channel. A task holds one block at a time.

On damage, samples and planar give the values of every sound block: a block whose header can't be read is
left out and reading goes on behind it; a block that the file has twice gives its values twice. A pushed
filter never changes which rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from ..functions import signal
from ..functions.crc import crc32c
from ..shared import ship
from . import layout
from .files import listed, locate, sized

#: Payload bytes that one task reads: at most, and at least where there is work for more tasks.
TASK_BYTES, LEAST_TASK_BYTES = 64 << 20, 2 << 20
#: The driver reads block headers to prune a range up to so many; beyond that the tasks skip blocks themselves.
MOST_HEADERS, MOST_FILES = 65_536, 64
LEDGER_WINDOW = 2 << 20
SUFFIX = ".sigb"

_BLOCKS = "recording_id string, block_index long, byte_offset long, ok boolean, start_frame long, frame_count long, payload_bytes long, monotonic_nanos long, flags long, preceding_gap_frames long, payload_crc long, bytes_available long"
SCHEMAS = {
    "header": "recording_id string, path string, file_size long, channel_count long, sample_rate_hz long, sample_rate_exact_hz double, dtype_name string, bytes_per_value long, frames_per_block long, header_bytes long, block_header_bytes long, block_stride_bytes long, total_frames long, total_values long, block_count long, end_frame long, duration_seconds double, start_unix_nanos long, end_unix_nanos long, start_monotonic_nanos long, flags long, finalised boolean, had_drops boolean, ledger_truncated boolean, dither_disabled boolean, dropped_frames_total long, ledger_entry_count long, ring_bytes long, fsync_interval_seconds long, signal_id string, producer string, description string, header_crc long, recovered boolean, truncated_tail_bytes long",
    "blocks": _BLOCKS,
    "samples": "recording_id string, block_index long, frame long, channel int, value float, bits int",
    "planar": "recording_id string, block_index long, channel int, start_frame long, values array<float>",
    "ledger": "recording_id string, start_frame long, frame_count long, cause_code int, source string",
    "index": "path string, recording_id string, channel_count int, block_index long, start_frame long, end_frame long, payload_offset long, payload_crc long",
    "findings": _BLOCKS + ", payload_ok boolean, incorrect long, first_channel int, first_frame long, expected float, actual float",
}


class Recording:
    """One file: header, extent and blocks, read by ranges."""

    def __init__(self, uri: str):
        self.uri = uri
        fs, path = locate(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        #: A local file's bytes; of another store's, what is asked for is read.
        self.mapped = np.memmap(path, np.uint8, "r") if isinstance(fs, pafs.LocalFileSystem) and self.size else None
        self.header = layout.header_of(self.file.read_at(min(self.size, layout.FILE_HEADER), 0))
        #: Blocks that fill their stride within the file.
        self.whole = max(0, self.size - self.header["header_bytes"]) // self.header["block_stride_bytes"]
        self.extent = self._extent()
        self._index: tuple[np.ndarray, np.ndarray] | None = None

    def offset(self, block: int) -> int:
        return self.header["header_bytes"] + block * self.header["block_stride_bytes"]

    def heads(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The headers of blocks first to last - 1, as far as the file has their bytes, and which of them are sound."""
        if self.mapped is not None:
            n = max(0, min(last, (self.size - layout.BLOCK_HEADER - self.header["header_bytes"]) // self.header["block_stride_bytes"] + 1) - first) if self.size >= layout.BLOCK_HEADER else 0
            if not n:
                return np.empty(0, layout.BLOCK), np.zeros(0, bool)
            begin = self.mapped[self.offset(first) :]
            rows = np.lib.stride_tricks.as_strided(begin, (n, layout.BLOCK_HEADER), (self.header["block_stride_bytes"], 1))
            found = np.ascontiguousarray(rows).view(layout.BLOCK).ravel()
            return found, layout.sound_blocks(found)
        data = [self.file.read_at(layout.BLOCK_HEADER, self.offset(b)) for b in range(first, last) if self.offset(b) + layout.BLOCK_HEADER <= self.size]
        found = np.frombuffer(b"".join(data), layout.BLOCK)
        return found, layout.sound_blocks(found)

    def sound(self, b: int) -> dict | None:
        found, ok = self.heads(b, b + 1) if b >= 0 else ((), ())
        return layout.as_dict(found[0]) if len(found) and ok[0] else None

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """The headers of all blocks of the extent, read once."""
        if self._index is None:
            self._index = self.heads(0, self.extent["block_count"])
        return self._index

    def _extent(self) -> dict:
        """What of the file counts: the last block that is there, by its own header, and what the file header says of it.

        Of the places a block can begin at, the last sound one that is whole ends the file. A finalised header that states
        just these blocks is right about their frames; it also is when it states fewer or damaged ones, as long as they lie
        in the file, and when its last block ends the file short of its stride.
        """
        h, count, end = self.header, 0, 0
        tail = self.sound(self.whole)  # begins in the file, but doesn't fill its stride
        if tail and self.offset(self.whole) + h["block_header_bytes"] + tail["payload_bytes"] > self.size:
            tail = None
        if h["finalised"] and h["block_count"] <= self.whole + bool(tail):
            last = self.sound(h["block_count"] - 1)
            end = last["start_frame"] + last["frame_count"] if last else h["total_frames"]
            return {"block_count": h["block_count"], "total_frames": h["total_frames"], "total_values": h["total_values"], "end_frame": end, "recovered": False, "truncated_tail_bytes": 0}
        for z in range(self.whole, 0, -1024):
            found, ok = self.heads(max(0, z - 1024), z)
            if ok.any():
                k = int(np.flatnonzero(ok)[-1])
                count, end = max(0, z - 1024) + k + 1, int(found["start_frame"][k]) + int(found["frame_count"][k])
                break
        return {"block_count": count, "total_frames": end, "total_values": end * h["channel_count"], "end_frame": end, "recovered": True, "truncated_tail_bytes": max(0, self.size - self.offset(count))}

    def overlapping(self, low: int | None, high: int | None) -> np.ndarray:
        """Numbers of all sound blocks that hold a frame of low..high - 1, in whatever order the file has them."""
        found, ok = self.index()
        start = found["start_frame"].astype(np.int64)
        end = start + found["frame_count"]
        return np.flatnonzero(ok & (end > (low or 0)) & (start < (high if high is not None else 1 << 62)))

    def find(self, frame: int) -> tuple[int, str, int] | None:
        """The block of a frame, how it was found and after how many reads; None beyond the end.

        If the block of the undamaged file's closed form holds the frame, one header is enough. Otherwise a binary search
        over the headers, whose frames ascend in a sound file, finds the block that holds it, or the one behind the gap
        that the ledger says it is in. Only if neither is there (damage: unreadable headers, blocks in another order) are
        all headers read, and the first sound block in the file that holds the frame is taken, or the one whose start comes next.
        """
        count = self.extent["block_count"]
        nominal = frame // self.header["frames_per_block"]
        head = self.sound(nominal) if 0 <= nominal < count else None
        if head and head["start_frame"] <= frame < head["start_frame"] + head["frame_count"]:
            return nominal, "closed-form", 1
        reads, low, high = 1, 0, count  # the first block that ends behind the frame lies in low..high
        seen: dict[int, dict | None] = {}
        while low < high:
            mid = (low + high) // 2
            seen[mid] = head = self.sound(mid)
            reads += 1
            if head is None:
                break
            if head["start_frame"] + head["frame_count"] > frame:
                high = mid
            else:
                low = mid + 1
        else:
            head = seen.get(low) if low < count else None
            if head and head["start_frame"] <= frame:
                return low, "binary-search", reads
            entries, _ = self.ledger()
            reads += 1
            lost = (entries["start_frame"] <= frame) & (entries["start_frame"] + entries["frame_count"] > frame)
            if head and lost.any() and head["start_frame"] == int((entries["start_frame"] + entries["frame_count"])[lost].max()):
                return low, "after-gap", reads
        found, ok = self.index()
        reads += len(found)
        holding = self.overlapping(frame, frame + 1)
        if len(holding):
            return int(holding[0]), "binary-search", reads
        later = np.flatnonzero(ok & (found["start_frame"].astype(np.int64) > frame))
        if not len(later):
            return None
        return int(later[found["start_frame"][later].argmin()]), "after-gap", reads

    def ledger(self) -> tuple[np.ndarray, str]:
        """The loss ledger and where it was found: where the header says, or else the last whole one in the file's tail."""
        h = self.header
        if h["has_trailer"] and h["trailer_offset"] and h["trailer_offset"] + h["trailer_bytes"] <= self.size:
            stated = layout.ledger_of(self.file.read_at(h["trailer_bytes"], h["trailer_offset"]))
            if stated is not None:
                return stated, "header"
        tail = self.file.read_at(min(self.size, LEDGER_WINDOW), max(0, self.size - LEDGER_WINDOW))
        places, at = [], tail.find(layout.TRAILER_MAGIC)
        while at >= 0:
            places.append(at)
            at = tail.find(layout.TRAILER_MAGIC, at + 1)
        for at in reversed(places):
            entries = layout.ledger_of(tail[at:])
            if entries is not None:
                return entries, "header" if h["has_trailer"] else "backward-scan"
        return np.empty(0, layout.LEDGER), "absent"

    def run(self, b: int, head: dict, channel: int, skip: int, count: int) -> np.ndarray:
        """One channel's values of a block: one positional read. Their stride is the block's own frame count."""
        kind = layout.DTYPES[self.header["dtype_code"]][1]
        width = self.header["bytes_per_value"]
        at = self.offset(b) + self.header["block_header_bytes"] + (channel * head["frame_count"] + skip) * width
        return np.frombuffer(self.file.read_at(count * width, at), kind)


@dataclass
class Part(ds.InputPartition):
    """Blocks first to last - 1 of a file; without numbers, the share `part` of `parts` of all its blocks."""

    uri: str
    first: int | None = None
    last: int | None = None
    low: int | None = None
    high: int | None = None
    channels: list[int] | None = None
    part: int = 0
    parts: int = 1

    def blocks(self, r: Recording) -> range:
        if self.first is not None:
            return range(self.first, self.last)
        n = r.extent["block_count"]
        return range(n * self.part // self.parts, n * (self.part + 1) // self.parts)


def _block_rows(r: Recording, blocks: range) -> Iterator[dict]:
    found, ok = r.heads(blocks.start, blocks.stop)
    for b, record, sound in zip(blocks, found, ok.tolist()):
        got = max(0, min(r.header["block_stride_bytes"], r.size - r.offset(b)))
        head = layout.as_dict(record)
        yield {"recording_id": r.header["recording_id"], "byte_offset": r.offset(b), "ok": sound, "bytes_available": got} | {k: head[k] for k in ("start_frame", "frame_count", "payload_bytes", "monotonic_nanos", "flags", "preceding_gap_frames", "payload_crc")} | {"block_index": b}


def _fits(r: Recording, row: dict) -> bool:
    """Whether a block's payload is as long as its frames need."""
    return row["payload_bytes"] == row["frame_count"] * r.header["channel_count"] * r.header["bytes_per_value"]


def _finding(r: Recording, row: dict, check_crc: bool) -> dict | None:
    """A block's row, its checksum, and its values against the signal, bit by bit."""
    row |= {"payload_ok": True, "incorrect": 0, "first_channel": None, "first_frame": None, "expected": None, "actual": None}
    if not row["ok"]:
        return row
    data = r.file.read_at(row["payload_bytes"], row["byte_offset"] + r.header["block_header_bytes"])
    if len(data) < row["payload_bytes"]:
        return None  # the file ends within the block
    row["payload_ok"] = _fits(r, row) and (not check_crc or crc32c(data) == row["payload_crc"])
    if row["payload_ok"]:
        C, n = r.header["channel_count"], row["frame_count"]
        actual = np.frombuffer(data, "<f4").reshape(C, n)
        expected = signal.values(np.arange(C), row["start_frame"], n, not r.header["dither_disabled"])
        wrong = actual.view("<u4") != expected.view("<u4")
        row["incorrect"] = int(wrong.sum())
        if row["incorrect"]:
            c, j = divmod(int(wrong.ravel().argmax()), n)
            row |= {"first_channel": c, "first_frame": row["start_frame"] + j, "expected": float(expected[c, j]), "actual": float(actual[c, j])}
    return row


class RecordingReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema, table: str):
        self.uris = listed(options["path"], SUFFIX)
        self.table, self.schema = table, schema
        self.check_crc = options.get("checkcrc", "true").lower() != "false"
        self.task_bytes = int(options["taskbytes"]) if "taskbytes" in options else None
        self.parallelism = int(options.get("parallelism", 8))
        self.low: int | None = None
        self.high: int | None = None
        self.channels: list[int] | None = None

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "frame" and self.table == "samples":
                kind, v = type(f).__name__, getattr(f, "value", None)
                if kind in ("GreaterThan", "GreaterThanOrEqual", "EqualTo"):
                    self.low = max(v + (kind == "GreaterThan"), self.low if self.low is not None else v)
                if kind in ("LessThan", "LessThanOrEqual", "EqualTo"):
                    end = v + (kind != "LessThan")
                    self.high = min(end, self.high if self.high is not None else end)
            if name == "channel" and self.table in ("samples", "planar") and type(f).__name__ in ("EqualTo", "In"):
                own = set(f.value) if type(f).__name__ == "In" else {f.value}
                self.channels = sorted(own if self.channels is None else own & set(self.channels))
            yield f  # Spark applies every filter again; the source only reads less

    def partitions(self):
        if self.table in ("header", "ledger"):
            return [Part(u) for u in self.uris]
        ranged = self.low is not None or self.high is not None
        sizes = sized(self.uris)
        task = self.task_bytes or min(TASK_BYTES, max(LEAST_TASK_BYTES, sum(sizes) // self.parallelism))
        parts: list[Part] = []
        for uri, size in zip(self.uris, sizes):
            if ranged and len(self.uris) <= MOST_FILES:
                r = Recording(uri)
                if r.extent["block_count"] <= MOST_HEADERS:
                    hits = r.overlapping(self.low, self.high)
                    C = r.header["channel_count"]
                    share = (len(self.channels) if self.channels is not None else C) / C
                    step = max(1, int(task / max(1, r.header["block_stride_bytes"] * share)))
                    parts += [Part(uri, int(own[0]), int(own[-1]) + 1, self.low, self.high, self.channels) for own in (hits[a : a + step] for a in range(0, len(hits), step))]
                    continue
            # By size alone: no file is opened, and a task finds its share of the blocks.
            n = max(1, -(-size // task))
            parts += [Part(uri, None, None, self.low, self.high, self.channels, k, n) for k in range(n)]
        return parts or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        r = Recording(partition.uri)
        rows: list[dict] = []
        if self.table == "header":
            rows = [r.header | r.extent | {"path": r.uri, "file_size": r.size}]
        elif self.table == "ledger":
            entries, source = r.ledger()
            rows = [{"recording_id": r.header["recording_id"], "start_frame": int(e["start_frame"]), "frame_count": int(e["frame_count"]), "cause_code": int(e["cause_code"]), "source": source} for e in entries]
        elif self.table in ("samples", "planar"):
            yield from self._values(r, partition)
            return
        else:
            for row in _block_rows(r, partition.blocks(r)):
                if self.table == "index":
                    if not row["ok"] or not _fits(r, row):
                        continue
                    row |= {"path": r.uri, "channel_count": r.header["channel_count"], "end_frame": row["start_frame"] + row["frame_count"], "payload_offset": row["byte_offset"] + r.header["block_header_bytes"]}
                if self.table == "findings" and (row := _finding(r, row, self.check_crc)) is None:
                    break
                rows.append(row)
        yield pa.RecordBatch.from_pylist([{k: x.get(k) for k in self.schema.names} for x in rows], self.schema)

    def _values(self, r: Recording, p: Part) -> Iterator[pa.RecordBatch]:
        rid, C = r.header["recording_id"], r.header["channel_count"]
        channels = range(C) if p.channels is None else [c for c in p.channels if 0 <= c < C]
        blocks = p.blocks(r)
        for b, record, ok in zip(blocks, *r.heads(blocks.start, blocks.stop)):
            if not ok:
                continue
            head = {"start_frame": int(record["start_frame"]), "frame_count": int(record["frame_count"])}
            a = max(head["start_frame"], p.low or 0)
            z = min(head["start_frame"] + head["frame_count"], p.high if p.high is not None else 1 << 62)
            if z <= a:
                continue
            for c in channels:
                v = r.run(b, head, c, a - head["start_frame"], z - a)
                n = len(v)
                f32 = np.ascontiguousarray(v, np.float32)
                if self.table == "planar":
                    yield pa.RecordBatch.from_arrays([pa.array([rid]), pa.array([b]), pa.array([c], pa.int32()), pa.array([a]), pa.ListArray.from_arrays([0, n], pa.array(f32))], schema=self.schema)
                else:
                    same = lambda x, t: pa.array(np.full(n, x), t)
                    yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), [rid]).cast(pa.string()), same(b, pa.int64()), pa.array(np.arange(a, a + n)), same(c, pa.int32()), pa.array(f32), pa.array(f32.view(np.int32))], schema=self.schema)


class RecordingStream(ds.DataSourceStreamReader):
    """Follows recordings that grow: offsets count sound blocks per file, so a torn tail never shows."""

    def __init__(self, options: dict, schema: pa.Schema, table: str):
        self.reader = RecordingReader(options, schema, table)

    def initialOffset(self) -> dict:
        return {u: 0 for u in self.reader.uris}

    def latestOffset(self) -> dict:
        return {u: Recording(u).extent["block_count"] for u in self.reader.uris}

    def partitions(self, start: dict, end: dict):
        return [Part(u, start.get(u, 0), n) for u, n in end.items() if n > start.get(u, 0)]

    def read(self, partition: Part):
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


class RecordingWriter(ds.DataSourceArrowWriter):
    """One file per partition, of rows (frame, values) in frame order; a single partition writes a single recording."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{self.options['path'].rstrip('/')}/part-{task.partitionId():06d}{SUFFIX}"
        n = write_batches(name, (_frames_of(b) for b in iterator), rate=float(self.options.get("rate", 4000)), frames_per_block=int(self.options.get("framesperblock", 4000)), attempt=task.taskAttemptId())
        return Written(name, n)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                fs, path = locate(m.path)
                fs.delete_file(path)


@dataclass
class Written(ds.WriterCommitMessage):
    path: str
    frames: int


def _frames_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and the matrix of their values, a row per frame."""
    frames, values = batch.column("frame").to_numpy(zero_copy_only=False), batch.column("values")
    flat = values.flatten().to_numpy(zero_copy_only=False).astype("<f4", copy=False)
    return frames, flat.reshape(len(frames), -1) if len(frames) else np.empty((0, 0), "<f4")


def write_file(uri: str, rows, **options) -> int:
    """Writes (frame, values) rows in ascending frame order; see write_batches."""

    def batches():
        frames, values = [], []
        for f, v in rows:
            frames.append(f)
            values.append(v)
            if len(frames) == 4096:
                yield np.array(frames, np.int64), np.array(values, "<f4")
                frames, values = [], []
        if frames:
            yield np.array(frames, np.int64), np.array(values, "<f4")

    return write_batches(uri, batches(), **options)


def write_batches(uri: str, batches, *, rate: float, frames_per_block: int, first: int = 0, recording_id: bytes = b"\1" * 16, cause: int = 4, dither: bool = True, finalise: bool = True, signal_id: str = signal.SIGNAL_NAME, attempt: int = 0) -> int:
    """Writes batches of (frames, values) with ascending frames, `first` or later; one block is held at a time. Returns the frames written.

    A jump of the frame index ends a block and enters the ledger. Blocks stream into a side file; the header,
    which states the totals, is written once they are known, and the blocks are copied behind it. The file gets
    its name when it is whole, so a task that runs twice does no harm.
    """
    fs, path = locate(uri)
    fs.create_dir(path.rpartition("/")[0] or ".", recursive=True)
    side, temp = f"{path}.blocks{attempt}", f"{path}.attempt{attempt}"
    body = fs.open_output_stream(side)
    held: list[np.ndarray] = []
    entries: list[tuple[int, int, int]] = []
    state = {"blocks": 0, "frames": 0, "next": first, "gap": 0, "channels": 0, "bytes": 0, "held": 0, "pad": 0}

    def flush() -> None:
        n = state["held"]
        if not n:
            return
        values = np.concatenate(held)
        state["channels"] = values.shape[1]
        flags = layout.SHORT_BLOCK * (n < frames_per_block) | layout.PRECEDED_BY_GAP * (state["gap"] > 0)
        data = layout.block_bytes(np.ascontiguousarray(values.T).tobytes(), start_frame=state["next"] - n, frame_count=n, block_index=state["blocks"], flags=flags, preceding_gap_frames=state["gap"])
        # A block fills its stride only if another one follows.
        body.write(bytes(state["pad"]) + data)
        state["bytes"] += state["pad"] + len(data)
        state["pad"] = layout.BLOCK_HEADER + frames_per_block * state["channels"] * 4 - len(data)
        state["blocks"] += 1
        state["frames"] += n
        state["gap"] = state["held"] = 0
        held.clear()

    for frames, values in batches:
        if not len(frames):
            continue
        if frames[0] < state["next"] or (np.diff(frames) <= 0).any():
            raise ValueError("frames must ascend")
        cuts = np.flatnonzero(np.diff(frames) > 1) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(frames)]):
            if (jump := int(frames[a]) - state["next"]) > 0:
                flush()
                entries.append((state["next"], jump, cause))
                state["next"], state["gap"] = int(frames[a]), jump
            while a < z:
                n = min(z - a, frames_per_block - state["held"])
                held.append(np.asarray(values[a : a + n], "<f4"))
                state["held"] += n
                state["next"] += n
                a += n
                if state["held"] == frames_per_block:
                    flush()
    flush()
    C = state["channels"] or 1
    trailer = layout.ledger_bytes(entries)
    body.close()
    dropped = sum(n for _, n, _ in entries)
    head = dict(recording_id=recording_id, channel_count=C, sample_rate_hz=round(rate), sample_rate_exact_hz=rate, frames_per_block=frames_per_block, block_stride_bytes=layout.BLOCK_HEADER + frames_per_block * C * 4, signal_id=signal_id, producer="chronoloom")
    flags = layout.DITHER_DISABLED * (not dither)
    if finalise:
        flags |= layout.FINALISED | layout.HAS_TRAILER | layout.HAD_DROPS * bool(entries)
        head |= dict(total_frames=state["frames"], total_values=state["frames"] * C, block_count=state["blocks"], duration_seconds=state["frames"] / rate, trailer_offset=layout.FILE_HEADER + state["bytes"], trailer_bytes=len(trailer), dropped_frames_total=dropped, ledger_entry_count=len(entries))
    with fs.open_output_stream(temp) as out, fs.open_input_stream(side) as blocks:
        out.write(layout.header_bytes(flags=flags, **head))
        while piece := blocks.read(1 << 22):
            out.write(piece)
        if finalise:
            out.write(trailer)
    fs.delete_file(side)
    fs.move(temp, path)
    return state["frames"]


class RecordingSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def _table(self) -> str:
        table = self.options.get("table", "samples")
        if table not in SCHEMAS:
            raise ValueError(f"unknown table {table!r}; one of {', '.join(SCHEMAS)}")
        return table

    def schema(self) -> str:
        for uri in listed(self.options["path"], SUFFIX)[:1]:
            Recording(uri)  # refuses what can't be read before any task runs
        return SCHEMAS[self._table()]

    def _arrow(self, schema: StructType) -> pa.Schema:
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(schema)

    def reader(self, schema: StructType):
        return RecordingReader(dict(self.options), self._arrow(schema), self._table())

    def streamReader(self, schema: StructType):
        return RecordingStream(dict(self.options), self._arrow(schema), self._table())

    def writer(self, schema: StructType, overwrite: bool):
        return RecordingWriter(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool):
        from .sink import BlockSink

        return BlockSink(self.options["path"])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)


def read(spark: SparkSession, path: str, table: str = "samples", **options) -> DataFrame:
    register(spark)
    r = spark.read.format("recording").option("table", table).option("parallelism", max(1, spark.sparkContext.defaultParallelism))
    for k, v in options.items():
        r = r.option(k, str(v).lower() if isinstance(v, bool) else v)
    return r.load(path)
