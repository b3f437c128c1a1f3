"""The ledger of jobs as a stateful stream: each change of a job's state is appended once, and a job that never ends times out."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a job's state store must be.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "job string, state string, at timestamp, output string"
ACTIVE, FINISHED, TIMED_OUT = "active", "finished", "timed out"


class Ledger(StatefulProcessor):
    """Events (job, at, done, output) of a job to its changes of state.

    The first event makes a job active. The first one that is done within ``patience`` of it finishes the job, with its output; otherwise the job times out at that moment: when a
    later event tells that it has passed, or when the watermark does. Events of a job that has ended change nothing, and neither do events that come again.
    """

    def __init__(self, patience: timedelta) -> None:
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, deadline long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "done", "output"], ascending=[True, False, True])
        out, state, deadline = [], None, None
        if self.job.exists():
            state, deadline = self.job.get()
        for at, done, output in zip(events["at"], events["done"], events["output"]):
            if state is None:
                state, deadline = ACTIVE, microseconds(at + self.patience)
                out.append((key[0], ACTIVE, at, None))
                self.handle.registerTimer(-(-deadline // 1000))  # timers are in milliseconds
            if state != ACTIVE:
                break
            if microseconds(at) > deadline:
                state = TIMED_OUT
                out.append((key[0], TIMED_OUT, moment(deadline), None))
            elif done:
                state = FINISHED
                out.append((key[0], FINISHED, at, output))
        self.job.update((state, deadline))
        yield pd.DataFrame(out, columns=["job", "state", "at", "output"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, deadline = self.job.get() if self.job.exists() else (None, None)
        rows = []
        if state == ACTIVE:
            self.job.update((TIMED_OUT, deadline))
            rows = [(key[0], TIMED_OUT, moment(deadline), None)]
        yield pd.DataFrame(rows, columns=["job", "state", "at", "output"])

    def close(self) -> None:
        pass


def microseconds(at: pd.Timestamp) -> int:
    return int(pd.Timestamp(at).as_unit("ns").value // 1000)


def moment(at: int) -> pd.Timestamp:
    return pd.Timestamp(at, unit="us")


def changes(stream: DataFrame, patience: timedelta, lateness: str = "1 hour") -> DataFrame:
    """CHANGES of a stream of events (job string, at timestamp, done boolean, output string).

    State is one row a job, in RocksDB on the executors and in the query's checkpoint, so a query that is started again goes on with the jobs that it knows. Events later than
    ``lateness`` behind the watermark are dropped, as Spark does.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    known = stream.select("job", "at", "done", "output").where("job is not null and at is not null").withWatermark("at", lateness)
    return known.groupBy("job").transformWithStateInPandas(Ledger(patience), outputStructType=CHANGES, outputMode="append", timeMode="eventTime")


def current(spark: SparkSession, target: str) -> DataFrame:
    """(job, state, at, output): the last state of each job in a folder of appended changes."""
    from pyspark.sql import functions as F

    rows = spark.read.schema(CHANGES).parquet(target)
    # a job becomes active first and ends once
    return rows.groupBy("job").agg(F.max_by(F.struct("state", "at", "output"), F.col("state") != ACTIVE).alias("last")).select("job", "last.*")
