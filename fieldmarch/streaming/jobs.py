"""Structured Streaming jobs: typed ingest with quarantine, stateful alarms, newest state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.asof import STALE_AFTER_S
from ..sources.telemetry import route_lines


def ingest(lines: DataFrame, path: str, checkpoint: str, **trigger):
    """Write routed lines as one table partitioned by kind: typed rows and the quarantine in one pass.

    The file sink commits each micro-batch once, so a restart neither loses nor repeats lines.
    """
    out = route_lines(lines).writeStream.format("parquet").partitionBy("kind").option("path", path)
    return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def once(df: DataFrame, event_time: str = "recv_ts", late: str = "10 minutes") -> DataFrame:
    """Drop repeated frames; a boot is part of the key, so counters may start over."""
    return df.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["device_id", "boot_id", "seq"])


class Newest(StatefulProcessor):
    """Emits each device's newest reading, and an invalid one when nothing has come for three seconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", "t_s double, value double, timer long")

    def handleInputRows(self, key, rows, timerValues):
        best = max(((float(r.t_s), float(r.value)) for f in rows for r in f.itertuples()), key=lambda x: x[0])
        old = self.state.get() if self.state.exists() else None
        if old is not None and old[0] > best[0]:
            best = (old[0], old[1])
        if old is not None:
            self.handle.deleteTimer(old[2])
        due = timerValues.getCurrentProcessingTimeInMs() + int(STALE_AFTER_S * 1000)
        self.handle.registerTimer(due)
        self.state.update((best[0], best[1], due))
        yield pd.DataFrame({"device_id": [key[0]], "t_s": [best[0]], "value": [best[1]], "valid": [True]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        t, value, _ = self.state.get()
        yield pd.DataFrame({"device_id": [key[0]], "t_s": [t], "value": [value], "valid": [False]})

    def close(self) -> None:
        pass


def newest(df: DataFrame) -> DataFrame:
    """``device_id, t_s, value`` to the newest row of each device, with staleness on a processing-time timer."""
    return df.groupBy("device_id").transformWithStateInPandas(
        Newest(), outputStructType="device_id long, t_s double, value double, valid boolean", outputMode="update", timeMode="processingTime")


def open_sessions(df: DataFrame, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Segments counted per conversation, where ``gap`` without speech ends one."""
    return df.withWatermark("ts", late).groupBy("device_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n_segments"))
