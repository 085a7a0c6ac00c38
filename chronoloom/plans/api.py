"""open_recording(spark, path): info, read, seek, envelope, validate, ledger, gaps, exports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from ..functions import text
from ..functions.signal import SIGNAL_NAME
from ..operators import envelope as env
from ..operators import ledger as led
from ..operators import validate as val
from ..sources import layout, side
from ..sources import recording as rec
from ..sources.files import locate

#: Seconds that one CSV download covers at most.
CSV_SECONDS = 60


class Refused(ValueError):
    """A download that can't be served now."""


class OpenRecording:
    """One recording: geometry and extent on the driver, everything else as DataFrames."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.source = rec.Recording(path)
        self.header, self.extent = self.source.header, self.source.extent
        self.rate = self.header["sample_rate_exact_hz"]
        self._kept: dict[bool, DataFrame] = {}

    def close(self) -> None:
        """Lets go of the block rows that validation has kept."""
        for kept in self._kept.values():
            kept.unpersist()
        self._kept.clear()

    def table(self, name: str, **options) -> DataFrame:
        return rec.read(self.spark, self.path, name, **options)

    def info(self) -> DataFrame:
        return self.table("header")

    def frames(self, start: str | None = None, stop: str | None = None, limit: str = "total_frames") -> tuple[int, int]:
        first = max(0, text.frame_of(start, self.rate) or 0)
        asked = text.frame_of(stop, self.rate)
        last = min(self.extent[limit], self.extent[limit] if asked is None else asked)
        if last <= first:
            raise ValueError(f"empty range {first}..{last}")
        return first, last

    def samples(self, first: int, last: int, channels: list[int]) -> DataFrame:
        """frame, channel, value and more of first..last - 1; a channel that the recording lacks raises ValueError."""
        if bad := [c for c in channels if not 0 <= c < self.header["channel_count"]]:
            raise ValueError(f"channels {bad} are outside 0..{self.header['channel_count'] - 1}")
        return self.table("samples").where((F.col("frame") >= first) & (F.col("frame") < last) & F.col("channel").isin(channels))

    def read(self, start: str | None = None, stop: str | None = None, channels=None) -> DataFrame:
        """frame, time_seconds and a column ch{c} per channel; only what was recorded."""
        cs = text.channels_of(channels, self.header["channel_count"])
        long = self.samples(*self.frames(start, stop), cs)
        wide = long.groupBy("frame").pivot("channel", cs).agg(F.first("value"))
        return wide.select("frame", (F.col("frame") / F.lit(self.rate)).alias("time_seconds"), *[F.col(str(c)).alias(f"ch{c}") for c in cs])

    def csv_lines(self, *where, **options) -> DataFrame:
        """value: header line and data lines, as text; line: its number."""
        wide = self.read(*where, **options)
        names = [c for c in wide.columns if c.startswith("ch")]
        head = self.spark.createDataFrame([(-1, ",".join(["frameIndex", "timeSeconds", *names]))], "line long, value string")
        body = wide.select(F.col("frame").alias("line"), F.concat_ws(",", F.col("frame"), text.fixed(F.col("time_seconds"), 6), *[text.widened(F.col(c)) for c in names]).alias("value"))
        return head.unionByName(body)

    def json_lines(self, *where, **options) -> DataFrame:
        wide = self.read(*where, **options)
        names = [c for c in wide.columns if c.startswith("ch")]
        return wide.select(F.col("frame").alias("line"), F.to_json(F.struct(F.col("frame").alias("frameIndex"), F.col("time_seconds").alias("timeSeconds"), F.array(*[F.col(c).cast("double") for c in names]).alias("values"))).alias("value"))

    def raw_planar(self, start=None, stop=None, channels=None) -> DataFrame:
        """block_index, channel, data: little-endian floats of the range, planar per block."""
        first, last = self.frames(start, stop)
        s = self.samples(first, last, text.channels_of(channels, self.header["channel_count"]))
        runs = s.groupBy("block_index", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda x: x["value"]).alias("values"))
        return runs.select("block_index", "channel", _pack(F.col("values")).alias("data"))

    def raw_interleaved(self, start=None, stop=None, channels=None) -> DataFrame:
        """frame, data: little-endian floats of one frame, NaN where nothing was recorded."""
        first, last = self.frames(start, stop, "end_frame")
        cs = text.channels_of(channels, self.header["channel_count"])
        dense = env.dense_frames(self.samples(first, last, cs), first, last, cs)
        return dense.select("frame", _pack(F.col("values")).alias("data"))

    def csv_download(self, from_seconds: float, seconds: float, channels: list[int]) -> DataFrame:
        """line, value: 1-based channel names, nine significant digits, at most CSV_SECONDS."""
        cs = text.channels_for_download(channels, self.header["channel_count"])
        if not cs:
            raise Refused("choose at least one channel")
        first = max(0, min(int(from_seconds * self.rate + 0.5), self.extent["end_frame"]))
        last = min(self.extent["end_frame"], first + int(min(max(seconds, 0), CSV_SECONDS) * self.rate + 0.5))
        if last <= first:
            raise Refused("the window contains no samples")
        wide = self.samples(first, last, cs).groupBy("frame").pivot("channel", cs).agg(F.first("value"))
        head = self.spark.createDataFrame([(-1, ",".join(["time_s", "frame", *[f"channel_{c + 1}" for c in cs]]))], "line long, value string")
        body = wide.select(F.col("frame").alias("line"), F.concat_ws(",", text.fixed(F.col("frame") / F.lit(self.rate), 6), F.col("frame"), *[text.nine_digits_udf(F.col(str(c))) for c in cs]).alias("value"))
        return head.unionByName(body)

    def file_download(self) -> str:
        if not self.header["finalised"]:
            raise Refused("the recording is still being written")
        return self.path

    def seek(self, targets: str) -> list[dict]:
        out = []
        for t in targets.split(","):
            frame = text.frame_of(t, self.rate) or 0
            hit = self.source.find(frame)
            out.append({"frame": frame, "seconds": frame / self.rate, "block": hit[0] if hit else None, "method": hit[1] if hit else "not found", "probes": hit[2] if hit else 0, "bytes": (hit[2] if hit else 0) * layout.BLOCK_HEADER})
        return out

    def predicted_bytes(self, first: int, last: int, channels: int) -> int:
        blocks = (last - 1) // self.header["frames_per_block"] - first // self.header["frames_per_block"] + 1
        return blocks * self.header["block_header_bytes"] + channels * (last - first) * self.header["bytes_per_value"]

    def ledger(self) -> DataFrame:
        return self.table("ledger")

    def markers(self) -> DataFrame:
        return led.markers(self.ledger(), self.rate)

    def gaps(self) -> DataFrame:
        """Gaps by the block headers alone."""
        from ..operators.sequence import classified, expected_next

        b = classified(expected_next(self.table("blocks"), self.header["frames_per_block"]))
        return b.where("missing_frames > 0").select(F.col("expected").alias("start_frame"), F.col("missing_frames").alias("frame_count"), "block_index")

    def envelope(self, first: int, span: int, columns: int, channels=None) -> DataFrame:
        """channel, column, lo, hi: the window's min/max per column on the absolute grid, null where nothing was recorded."""
        cs = text.channels_of(channels, self.header["channel_count"])
        grid = env.window_grid(first + span // 2, span, columns, self.extent["end_frame"], live=False)
        begin, per = grid["from"], grid["samples_per_column"]
        last = min(begin + span, self.extent["end_frame"])
        return env.on_spine(env.grid_envelope(self.samples(begin, last, cs), begin, per), cs, min(grid["columns"], max(1, -(-(last - begin) // per))))

    def findings(self, check_crc: bool = True) -> DataFrame:
        if self.header["signal_id"] != SIGNAL_NAME:
            raise layout.Unreadable(f"unknown signal {self.header['signal_id']!r}")
        if self.header["dtype_code"] != 1:
            raise layout.Unreadable("only float32 recordings can be verified")
        # A row per block: kept, so that the file is read once however often the rows are used.
        raw = self._kept.get(check_crc) or self._kept.setdefault(check_crc, self.table("findings", checkcrc=check_crc).persist())
        return val.block_findings(raw, frames_per_block=self.header["frames_per_block"], channels=self.header["channel_count"])

    def validate(self, check_crc: bool = True) -> DataFrame:
        """One row: counters and verdict. Blocks are checked in parallel; only their rows meet."""
        h, C = self.header, self.header["channel_count"]
        trusted = h["finalised"] and not self.extent["recovered"]
        names = ("recorded", "missing", "duplicated", "incorrect", "corrupt")
        sums = self.findings(check_crc).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names], F.count("*").alias("n"), F.max("after").alias("after")).first()
        trailing = 0
        if trusted:
            entries, _ = self.source.ledger()  # at most 65,536
            trailing = int(entries["frame_count"][entries["start_frame"] >= (sums["after"] or 0)].sum()) * C
        one = self.spark.createDataFrame([tuple(sums[c] for c in names)], ", ".join(f"{c} long" for c in names))
        return val.report(one, trailing_missing=trailing, declared=h["dropped_frames_total"] * C if trusted else None, expected_values=(h if trusted else self.extent)["total_values"], trusted=trusted, truncated=sums["n"] < self.extent["block_count"])

    def first_discrepancies(self, check_crc: bool = True) -> DataFrame:
        C = self.header["channel_count"]
        found = self.findings(check_crc)
        wrong = found.where("incorrect > 0").agg(F.min_by(F.struct("block_index", F.col("first_frame").alias("frame"), F.col("incorrect").alias("value_count"), (F.col("first_frame") * C + F.col("first_channel")).alias("value_index")), "block_index").alias("f"))
        wrong = wrong.where("f IS NOT NULL").select(F.lit("incorrect").alias("class"), "f.*")
        return val.first_of_class(found, C).unionByName(wrong)

    def details(self, check_crc: bool = True) -> DataFrame:
        """line_number, line: the first discrepancy of each class, and what ledger and gaps say of each other."""
        h = self.header
        offset = F.col("byte_offset") + h["block_header_bytes"] + (F.col("first_channel") * F.col("frame_count") + F.col("first_frame") - F.col("start_frame")) * h["bytes_per_value"]
        firsts = self.first_discrepancies(check_crc)
        raw = self.table("findings", checkcrc=check_crc).select("block_index", F.col("first_channel").alias("channel"), F.col("expected").cast("float").alias("expected"), "actual", offset.alias("wrong_at"), F.col("byte_offset").alias("block_at"), F.col("incorrect").alias("n"))
        rows = firsts.join(raw, "block_index", "left")  # four rows at most
        is_wrong = F.col("class") == "incorrect"
        rows = rows.select("class", "block_index", "frame", "value_count", "value_index", *[F.when(is_wrong, F.col(c)).alias(c) for c in ("channel", "expected", "actual")], F.when(is_wrong, F.col("wrong_at")).otherwise(F.col("block_at")).alias("byte_offset"))
        lines = val.detail_lines(rows, self.rate)
        declared = F.lit(h["dropped_frames_total"] * h["channel_count"]).cast("long")
        last = self.validate(check_crc).select(F.lit(8).alias("line_number"), val.ledger_line(declared, F.col("missing"), F.col("ledger_agrees")).alias("line")).where("line IS NOT NULL")
        return lines.unionByName(last)

    def check(self) -> DataFrame:
        """One row: the sweep over all blocks (validate.sweep), the ledger's frames, and whether the two agree and all is sound."""
        swept = val.sweep(self.table("findings").withColumn("payload_ok", F.coalesce("payload_ok", F.lit(False))))
        entries, _ = self.source.ledger()  # at most 65,536
        stated = int(entries["frame_count"].sum()) if len(entries) else 0
        s = swept.withColumn("ledger_frames", F.lit(stated).cast("long")).withColumn("agrees", F.col("gap_frames") == F.col("ledger_frames"))
        return s.withColumn("sound", F.col("agrees") & (F.col("bad_headers") == 0) & (F.col("bad_payloads") == 0))

    def write_sidecar(self, config: side.Config | None = None) -> str:
        """Writes the sidecar beside the recording, whole or not at all; returns its path. On conflict the header counts."""
        entries, _ = self.source.ledger()
        rows = [{"startFrameIndex": int(e["start_frame"]), "frameCount": int(e["frame_count"]), "startValueIndex": int(e["start_frame"]) * self.header["channel_count"], "valueCount": int(e["frame_count"]) * self.header["channel_count"], "startSeconds": int(e["start_frame"]) / self.rate, "durationSeconds": int(e["frame_count"]) / self.rate, "cause": led.CAUSES.get(int(e["cause_code"]), f"unknown({int(e['cause_code'])})")} for e in entries]
        fs, path = locate(self.path)
        name = path.removesuffix(rec.SUFFIX) + ".json"
        with fs.open_output_stream(f"{name}.tmp") as out:
            out.write((side.sidecar(self.header, rows, config or side.Config()) + "\n").encode())
        fs.move(f"{name}.tmp", name)
        return name

    def metadata(self) -> bytes:
        """The sidecar as it lies there, for download; refused where there is none."""
        fs, path = locate(self.path)
        name = path.removesuffix(rec.SUFFIX) + ".json"
        if fs.get_file_info(name).type != pafs.FileType.File:
            raise Refused("the recording has no sidecar")
        return fs.open_input_stream(name).read()

    def hexdump(self) -> list[tuple[int, int, str, str]]:
        return layout.hexdump(self.source.file.read_at(layout.FILE_HEADER, 0))


@arrow_udf(BinaryType())
def _pack(values: pa.Array) -> pa.Array:
    """Little-endian single-precision bytes of each array: its own memory, with four bytes a value."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    flat = values.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f4", copy=False)
    ends = np.concatenate(([0], np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64) * 4
    valid = values.is_valid()
    out = pa.Array.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
    return out if not values.null_count else pa.compute.if_else(valid, out, pa.scalar(None, pa.binary()))


def open_recording(spark: SparkSession, path: str) -> OpenRecording:
    return OpenRecording(spark, path)
