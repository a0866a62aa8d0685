"""Day-to-date use and run length per meter as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loadweave.functions.timeparts import NTZ

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUTPUT = "id string, ts timestamp_ntz, y double, today_kwh double, run_rows bigint, late_rows bigint"


class DayAndRun(StatefulProcessor):
    """Running total of the day and length of the current run over a limit.

    Rows of a batch are put in time order; a row not later than the last one
    seen is dropped and counted.
    """

    def __init__(self, limit: float) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "meter", "last timestamp_ntz, day string, total double, run bigint, late bigint"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        last, day, total, run, late = self.state.get() if self.state.exists() else (None, None, 0.0, 0, 0)
        # One row per meter and hour reaches this operator, so a batch is short.
        batch = pd.concat(rows).sort_values("ts")
        out = []
        for ts, y in zip(batch["ts"], batch["y"]):
            if last is not None and ts <= pd.Timestamp(last):
                late += 1
                continue
            today = str(ts.date())
            total = (total if today == day else 0.0) + y
            run = run + 1 if y > self.limit else 0
            last, day = ts, today
            out.append((key[0], ts, y, total, run, late))
        self.state.update((None if last is None else pd.Timestamp(last).to_pydatetime(), day, total, run, late))
        yield pd.DataFrame(out, columns=["id", "ts", "y", "today_kwh", "run_rows", "late_rows"])

    def close(self) -> None:
        pass


def day_and_run(hourly: DataFrame, limit: float) -> DataFrame:
    """Keyed state over the hourly stream (id, ts, kwh).

    Hourly totals come first: the keyed step is sequential per meter, and the
    aggregation ahead of it bounds what one meter sends per batch.
    """
    hourly.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = hourly.select("id", F.col("ts").cast(NTZ).alias("ts"), F.col("kwh").alias("y"))
    return rows.groupBy("id").transformWithStateInPandas(
        statefulProcessor=DayAndRun(limit), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )
