"""SM-02: the exponential moving average of each series as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, Config

#: Frames whose rows wait in one entry of the state.
BLOCK = 1024
OUTPUT = "series_id long, frame_no long, filtered double"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SeriesAverage(StatefulProcessor):
    """One series.  Rows wait by blocks of frames, each with a timer at its end; when the
    watermark is there, the block is sorted and put behind the last value.  Timers come in
    the order of their times.  Without a newer row for idle_frames, the value is dropped
    and the series starts anew."""

    def __init__(self, keep: float, idle_frames: int | None) -> None:
        self.keep, self.idle = keep, idle_frames

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "filtered double, block long")
        self.waiting = handle.getMapState("waiting", "block long", "frames array<bigint>, depths array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names that Spark calls
        for batch in rows:
            frames, depths = batch["frame_no"].to_numpy(np.int64), batch["depth_cm"].to_numpy(float)
            order = np.argsort(frames, kind="stable")
            blocks = frames[order] // BLOCK
            starts = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1))
            for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
                block, at = int(blocks[a]), order[a:b]
                old = self.waiting.getValue((block,))
                if old is None:
                    self.handle.registerTimer((block + 1) * BLOCK * 1000)
                more = [None if np.isnan(d) else d for d in depths[at].tolist()]
                self.waiting.updateValue((block,), (([*old[0]] if old else []) + frames[at].tolist(), ([*old[1]] if old else []) + more))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at % 1000:  # the end of an idle time
            last = self.last.get()
            if last is not None and self._idle_end(last[1]) == at and not self.waiting.exists():
                self.last.clear()
            return
        block = at // 1000 // BLOCK - 1
        frames, depths = (list(x) for x in self.waiting.getValue((block,)))
        self.waiting.removeKey((block,))
        before, out = self.last.get(), []
        f = before[0] if before is not None else None
        rows = sorted(zip(frames, depths, strict=True), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        for _, d in rows:
            f = f if d is None else d if f is None else self.keep * d + (1 - self.keep) * f
            out.append(f)
        self.last.update((f, block))
        if self.idle is not None:
            self.handle.registerTimer(self._idle_end(block))
        yield pd.DataFrame({"series_id": key[0], "frame_no": [r[0] for r in rows], "filtered": out})

    def _idle_end(self, block: int) -> int:
        return ((block + 1) * BLOCK + self.idle) * 1000 + 1

    def close(self) -> None:
        pass


def stream_ema(df: DataFrame, cfg: Config = DEFAULT, delay: str = "0 seconds", idle_frames: int | None = None) -> DataFrame:
    """df (series_id, frame_no from 0 on, depth_cm): filtered by frame, in the order of
    frames whatever the order of arrival.

    Frames are seconds of event time, from second 1 on (a row at the watermark, which
    starts at 0, is late).  Rows of a block come out when the watermark, the
    highest frame of all series less the delay, has passed its end; a row that comes later
    than the watermark is dropped.  Values that are missing leave the average as it is.
    The state is one value of a series and the rows that wait; a micro-batch passes
    through in pieces, so that its size is no matter.  Needs the store of state_store()."""
    timed = df.select("series_id", "frame_no", F.col("depth_cm").cast("double").alias("depth_cm"), F.timestamp_seconds(F.col("frame_no") + 1).alias("at")).withWatermark("at", delay)
    return timed.groupBy("series_id").transformWithStateInPandas(SeriesAverage(cfg.ema_keep, idle_frames), OUTPUT, "append", "eventtime")


@contextmanager
def state_store(spark: SparkSession):
    """While a stream with timers and several states starts, the store that holds them."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
