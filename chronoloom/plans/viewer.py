"""What a viewer shows: packed envelope frames, the information sheet, transport and playback state."""

from __future__ import annotations

import json
import struct
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import envelope as env
from .api import OpenRecording

# Playback speeds.
SLOWEST, FASTEST = 0.05, 16.0


def frame_bytes(r: OpenRecording, first: int, span: int, columns: int, channels: list[int], per_column: int, **extra) -> bytes:
    """A packed window: JSON length, JSON padded to four bytes, then min and max per channel and column as floats.

    Channels keep their order, those that the recording lacks are left out; a column without data is NaN. The grid
    starts at `first`, which the caller aligns.
    """
    channels = [c for c in channels if 0 <= c < r.header["channel_count"]]
    end = r.extent["end_frame"]
    a = max(0, min(first, end))
    z = min(a + span, end)
    columns, per_column = max(1, min(columns, env.MOST_COLUMNS)), max(1, per_column)
    out = np.full((len(channels), columns, 2), np.nan, "<f4")
    if z > a:
        rows = env.grid_envelope(r.samples(a, z, sorted(set(channels))), a, per_column).where(F.col("column") < columns).collect()
        for row in rows:
            if row["lo"] is not None:
                for k, c in enumerate(channels):
                    if c == row["channel"]:
                        out[k, row["column"]] = row["lo"], row["hi"]
    info = {**extra, "from": a, "frames": z - a, "columns": columns, "samplesPerColumn": per_column, "channels": channels, "sampleRateHz": r.rate, "totalFrames": r.extent["total_frames"], "endFrame": end, "finalised": r.header["finalised"], "predictedBytes": r.predicted_bytes(a, z, len(channels)) if z > a else 0}
    text = json.dumps(info).encode()
    text += b" " * (-(4 + len(text)) % 4)
    return struct.pack("<I", len(text)) + text + out.tobytes()


def unpacked(data: bytes) -> tuple[dict, np.ndarray]:
    n = struct.unpack_from("<I", data)[0]
    info = json.loads(data[4 : 4 + n])
    return info, np.frombuffer(data, "<f4", offset=4 + n).reshape(len(info["channels"]), info["columns"], 2)


def information(r: OpenRecording) -> dict[str, object]:
    """The recording's sheet: identity, geometry, extent, recovery and loss."""
    h, e = r.header, r.extent
    entries, source = r.source.ledger()
    return {
        "file": r.path, "size": r.source.size, "recordingId": h["recording_id"], "channelCount": h["channel_count"], "sampleRateHz": r.rate,
        "dataType": h["dtype_name"], "framesPerBlock": h["frames_per_block"], "blockStrideBytes": h["block_stride_bytes"],
        "totalFrames": e["total_frames"], "totalValues": e["total_values"], "duration": e["total_frames"] / r.rate, "blockCount": e["block_count"],
        "finalised": h["finalised"], "recovered": e["recovered"], "truncatedTailBytes": e["truncated_tail_bytes"], "signalId": h["signal_id"],
        "producer": h["producer"], "ringSeconds": h["ring_bytes"] / (h["channel_count"] * r.rate * h["bytes_per_value"]),
        "droppedValues": h["dropped_frames_total"] * h["channel_count"], "ledgerEntries": len(entries), "ledgerSource": source,
        "ledger": [tuple(int(x) for x in entry.tolist()[:3]) for entry in entries[:20]],
    }


@dataclass
class Transport:
    """Play, pause, seek, speed and mode over a growing recording; the position follows from the last command."""

    now: Callable[[], float] = time.monotonic
    playing: bool = False
    mode: str = "live"
    speed: float = 1.0
    anchor: int = 0
    since: float = field(default=0.0)

    def position(self, end: int, rate: float) -> int:
        if not self.playing:
            return min(self.anchor, end)
        return max(0, min(self.anchor + int((self.now() - self.since) * rate * self.speed // 1), end))

    def apply(self, command: str, argument=None, *, end: int, rate: float) -> None:
        at = self.position(end, rate)
        if command == "seek":
            at = max(0, min(int(argument), end))
        elif command in ("play", "pause"):
            self.playing = command == "play"
        elif command == "speed":
            self.speed = max(SLOWEST, min(FASTEST, float(argument) or 1.0))
        elif command == "mode":
            self.mode = "review" if argument == "review" else "live"
            return
        else:
            raise ValueError(f"unknown command {command!r}")
        self.anchor, self.since = at, self.now()


def playback(r: OpenRecording, first: int, last: int, channels: list[int], *, frames: int = 4096) -> DataFrame:
    """start, frames, values, present: consecutive packets of a range, frame by channel as little-endian floats, NaN for
    lost frames; present: frames that were recorded. Packets are built by the tasks; a client takes them in order of start.
    """
    return packets(r.samples(first, last, sorted(set(channels))), first, last, channels, frames)


def packets(samples: DataFrame, first: int, last: int, channels: list[int], frames: int) -> DataFrame:
    """playback() over samples(frame, channel, value); a row for every packet, also for one that was lost as a whole."""
    spark = samples.sparkSession
    start = (F.col("frame") - first) - F.pmod(F.col("frame") - first, F.lit(frames)) + first
    held = samples.groupBy(start.alias("start"), "channel").agg(F.collect_list(F.struct("frame", "value")).alias("run"), F.count("*").alias("n"))
    held = held.groupBy("start").agg(F.collect_list(F.struct("channel", "run")).alias("runs"), F.max("n").alias("present"))
    spine = spark.range(first, max(first, last), frames).withColumnRenamed("id", "start")
    rows = spine.join(held, "start", "left").select("start", F.least(F.lit(frames), F.lit(last) - F.col("start")).alias("frames"), "runs", F.coalesce("present", F.lit(0)).alias("present"))
    slots = {c: [k for k, x in enumerate(channels) if x == c] for c in set(channels)}

    def run(batches):
        for batch in batches:
            data = []
            for at, n, runs in zip(batch.column("start").to_pylist(), batch.column("frames").to_pylist(), batch.column("runs")):
                out = np.full((n, len(channels)), np.nan, "<f4")
                for i in range(len(runs.values) if runs.is_valid else 0):
                    one = runs.values[i]
                    frame, value = (one["run"].values.field(k).to_numpy(zero_copy_only=False) for k in ("frame", "value"))
                    out[(frame - at)[:, None], slots[one["channel"].as_py()]] = value[:, None]
                data.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("start"), batch.column("frames"), pa.array(data, pa.binary()), batch.column("present")], ["start", "frames", "values", "present"])

    return rows.mapInArrow(run, "start long, frames long, values binary, present long")
