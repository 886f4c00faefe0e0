"""Training histories as streams: metrics appended as they come, and state across epochs for each run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

KEEP = 0.9


class RunState(StatefulProcessor):
    """Best score, score before, and moving average of each run; a row out for each epoch in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "best double, last double, ema double, epochs bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("epoch")
        best, last, ema, n = self.state.get() if self.state.exists() else (float("inf"), None, None, 0)
        out = []
        for epoch, score in zip(pdf["epoch"], pdf["score"], strict=True):
            change = None if last is None else abs(score - last) / max(abs(last), 1e-12)
            ema = score if ema is None else KEEP * ema + (1 - KEEP) * score
            best, last, n = (score if score < best - 1e-12 else best), score, n + 1
            out.append((key[0], int(epoch), float(score), float(best), change, float(ema)))
        self.state.update((best, last, ema, n))
        yield pd.DataFrame(out, columns=["run", "epoch", "score", "best", "change", "ema"])

    def close(self) -> None:
        pass


def follow(history: DataFrame) -> DataFrame:
    """A stream of history(run, epoch, score) with the state of its run after each epoch."""
    return history.groupBy("run").transformWithStateInPandas(RunState(), "run bigint, epoch bigint, score double, best double, change double, ema double", "Append", "None")


def append_metrics(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch into its own folder, overwritten if the batch is repeated after a failure: exactly once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events for each window and kind, with a bound on how late they may come."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
