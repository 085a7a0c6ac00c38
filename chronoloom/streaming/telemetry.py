"""Counters of a running stream: observed metrics of every micro-batch, appended to a log of JSON lines."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: The name under which the counters are observed.
NAME = "ingest"


def counters() -> dict[str, Column]:
    """The counters of accepted blocks (see ingest.BLOCKS), each a sum over a micro-batch."""
    n = lambda c: F.count(F.when(c, 1))
    return {
        "blocks": F.count(F.lit(1)), "frames": F.coalesce(F.sum("frame_count"), F.lit(0)), "values": F.coalesce(F.sum(F.col("frame_count") * F.col("channel_count")), F.lit(0)),
        "gaps": n(F.col("preceding_gap") > 0), "gap_frames": F.coalesce(F.sum("preceding_gap"), F.lit(0)), "short_blocks": n(F.col("short")), "bytes": F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)),
    }


def observed(blocks: DataFrame, name: str = NAME) -> DataFrame:
    """The same rows, counted as they pass."""
    return blocks.observe(name, *[c.alias(k) for k, c in counters().items()])


class TelemetryLog(StreamingQueryListener):
    """Appends a line per micro-batch to a local file of the driver: time, query, batch, input rows, the batch's counters
    and, as total_..., their sums over the log. A batch that the log has already is not counted again, so a restarted
    query goes on where it was."""

    def __init__(self, path: str, name: str = NAME):
        self.path, self.name = path, name
        self.totals: dict[str, int] = {}
        self.seen: set[int] = set()
        if os.path.exists(path):
            with open(path) as f:
                for line in f:
                    try:
                        old = json.loads(line)
                    except ValueError:
                        continue  # torn by a crash
                    self.seen.add(old["batch"])
                    self._add(old)

    def _add(self, line: dict) -> None:
        for k in counters():
            self.totals[k] = self.totals.get(k, 0) + int(line.get(k, 0))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name not in p.observedMetrics or p.batchId in self.seen:
            return
        self.seen.add(p.batchId)
        row = p.observedMetrics[self.name].asDict()
        line = {"t": p.timestamp, "query": p.name, "batch": p.batchId, "input_rows": p.numInputRows} | {k: int(row[k] or 0) for k in counters()}
        self._add(line)
        line |= {f"total_{k}": v for k, v in self.totals.items()}
        with open(self.path, "a") as f:
            f.write(json.dumps(line) + "\n")
