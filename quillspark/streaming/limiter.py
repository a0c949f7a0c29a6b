"""The rate limiter as a running service: a token bucket for each key, kept as the state of a streaming query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from quillspark.streaming.upserts import SECURE_PER_MINUTE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Bucket(StatefulProcessor):
    """held tokens and the time of the last event. When the watermark passes the time at which it is full again, the state goes: a new bucket is full too."""

    def __init__(self, key: str, seconds: str, order: str, most: float, rate: float):
        self.key, self.seconds, self.order, self.most, self.rate = key, seconds, order, most, rate

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "held double, last double, full long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(rows).sort_values([self.seconds, self.order], kind="stable")  # what one micro-batch has of the key
        held, last, full = self.state.get() if self.state.exists() else (self.most, None, None)
        out = []
        for now in pdf[self.seconds].tolist():
            held = self.most if last is None else min(self.most, held + max(0.0, now - last) * self.rate)
            last = now if last is None else max(now, last)
            out.append(held >= 1.0)
            held -= held >= 1.0
        if full is not None:
            self.handle.deleteTimer(full)
        full = int((last + (self.most - held) / self.rate) * 1000) + 1
        self.handle.registerTimer(full)
        self.state.update((held, last, full))
        yield pdf[[self.key, self.seconds, self.order]].assign(allowed=out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limited_stream(events: DataFrame, key: str, seconds: str, order: str, per_minute: float, burst: int = 0, secure: bool = False, delay: str = "1 minute") -> DataFrame:
    """The stream `events` with allowed, as rate_limited() gives it for all of them at once.

    A key's events may come in any order within a micro-batch (which the source bounds), and follow each other from batch to batch;
    one that is late there finds the bucket as it is. Events later than the watermark (`delay`) are left out by Spark. Null keys
    share one bucket. A query that is restarted from its checkpoint goes on with the buckets as they were.
    """
    rows = events.select(key, seconds, order)
    per_minute = per_minute or (SECURE_PER_MINUTE if secure else 0)
    if not per_minute:
        return rows.withColumn("allowed", F.lit(True))
    if events.sparkSession.conf.get(PROVIDER, "") != ROCKS:
        raise ValueError(f"{PROVIDER} must be {ROCKS} for state of this kind")
    schema = T.StructType([*rows.schema.fields, T.StructField("allowed", T.BooleanType())])
    named = F.when(F.col(key).isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), F.col(key).cast("string")))
    keyed = rows.withColumn("__key", named).withColumn("__at", F.timestamp_seconds(seconds)).withWatermark("__at", delay)
    return keyed.groupBy("__key").transformWithStateInPandas(Bucket(key, seconds, order, float(max(1, burst or per_minute)), per_minute / 60.0), schema, "Append", "EventTime")
