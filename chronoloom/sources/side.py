"""What accompanies a recording: sidecar, telemetry log, configuration."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Telemetry fields in the order they are logged.
TELEMETRY = "t long, elapsedSeconds double, framesReceived long, valuesReceived long, blocksWritten long, bytesWritten long, ringFillPct double, ringPeakPct double, ringHeadroomSeconds double, ringLevel string, queuedBlocks long, writeLatencyMaxMs double, fsyncCount long, fsyncMaxMs double, gapFrames long, duplicateFrames long, crcFailures long, droppedFrames long, droppedRanges long, rssBytes long"


def sidecar_matches(headers: DataFrame, sidecars: DataFrame) -> DataFrame:
    """headers(recording_id, stem) with matches: true, false, or null where no sidecar(stem, json) exists. A broken one doesn't match."""
    s = sidecars.select("stem", F.coalesce(F.get_json_object("json", "$.recordingId"), F.lit("")).alias("stated"))
    return headers.join(s, "stem", "left").withColumn("matches", F.col("stated") == F.col("recording_id")).drop("stated")


def telemetry(lines: DataFrame) -> DataFrame:
    """Parsed telemetry of lines(line_number, value); a torn or foreign line gives no row."""
    parsed = lines.select("line_number", F.from_json("value", TELEMETRY, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.where(F.col("r.t").isNotNull()).select("line_number", "r.*")


def latest(lines: DataFrame, ok: Column, order: Column) -> DataFrame:
    """The last line that can be read, as one row."""
    return lines.where(ok).agg(F.max_by(F.struct(*lines.columns), order).alias("r")).select("r.*")


def sidecar(header: dict, ledger: list[dict], config: "Config") -> str:
    """The sidecar's JSON; on conflict the header counts."""
    return json.dumps({
        "recordingId": header["recording_id"], "headerCrc32c": header["header_crc"],
        "acquisition": {"channelCount": header["channel_count"], "sampleRateHz": header["sample_rate_exact_hz"], "totalFrames": header["total_frames"], "signalId": header["signal_id"]},
        "drops": {"ledgerTruncated": header["ledger_truncated"], "totalDroppedFrames": header["dropped_frames_total"], "entries": ledger},
        "config": {k: {"value": getattr(config, k), "source": s} for k, s in config.sources.items()},
    }, indent=2)


@dataclass(frozen=True)
class Config:
    """Settings from command line, environment, file or default, each with its source; and what follows from them."""

    channel_count: int = 32
    sample_rate_hz: float = 4000
    dither: bool = True
    tick_nanos: int = 5_000_000
    frames_per_block: int = 4000
    ring_bytes: int = 64 << 20
    generator_ring_blocks: int = 1024
    fsync_interval_seconds: float = 10
    stats_interval_seconds: float = 10
    duration: float = 0
    description: str = ""
    sources: dict = field(default_factory=dict)

    def __post_init__(self):
        whole = lambda x: float(x).is_integer()
        rules = {
            "channel_count": lambda v: whole(v) and 1 <= v <= 4096, "sample_rate_hz": lambda v: 0 < v <= 1e6,
            "tick_nanos": lambda v: 100_000 <= v <= 100_000_000, "frames_per_block": lambda v: whole(v) and v >= 1,
            "ring_bytes": lambda v: whole(v) and v >= 1 << 20, "generator_ring_blocks": lambda v: whole(v) and v >= 2,
            "fsync_interval_seconds": lambda v: v >= 0, "stats_interval_seconds": lambda v: v >= 0, "duration": lambda v: v >= 0,
        }
        for name, ok in rules.items():
            if not ok(getattr(self, name)):
                raise ValueError(f"invalid {name}={getattr(self, name)!r} (from {self.sources.get(name, 'default')})")

    bytes_per_value = 4

    @property
    def bytes_per_frame(self) -> int:
        return self.channel_count * self.bytes_per_value

    @property
    def frames_per_tick(self) -> int:
        return max(1, int(self.sample_rate_hz * self.tick_nanos / 1e9 + 0.5))

    @property
    def block_stride_bytes(self) -> int:
        return 64 + self.frames_per_block * self.bytes_per_frame

    @property
    def wire_block_bytes(self) -> int:
        return 32 + self.frames_per_tick * self.bytes_per_frame

    @property
    def ring_seconds(self) -> float:
        return self.ring_bytes / (self.bytes_per_frame * self.sample_rate_hz)


def resolve(cli: dict | None = None, env: dict | None = None, path: str | None = None, prefix: str = "CHRONOLOOM_") -> Config:
    """Command line before environment before file before default."""
    env = os.environ if env is None else env
    stated = {}
    if path:
        with open(path) as f:
            stated = json.load(f)
    base, values, sources = Config(), {}, {}
    for name in Config.__dataclass_fields__:
        if name == "sources":
            continue
        kind = type(getattr(base, name))
        for value, source in (((cli or {}).get(name), "cli"), (env.get(prefix + name.upper()), f"env:{prefix}{name.upper()}"), (stated.get(name), f"file:{os.path.basename(path or '')}")):
            if value is not None:
                values[name] = str(value).lower() not in ("false", "0") if kind is bool else float(value) if kind in (int, float) and not float(value).is_integer() else kind(value)
                sources[name] = source
                break
        else:
            sources[name] = "default"
    return replace(base, **values, sources=sources)


def config_table(spark: SparkSession, config: Config) -> DataFrame:
    return spark.createDataFrame([(k, str(getattr(config, k)), s) for k, s in config.sources.items()], "key string, value string, source string")
