"""Versions of documents: the newest wins, deletions are tombstones; a live index; and a token bucket for each key."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import summarize
from quillspark.operators import index
from quillspark.plans.store import IndexBusy, Store

#: Requests a minute where a secure server names none.
SECURE_PER_MINUTE = 60


def resolve(versions: DataFrame, key: str = "doc_id") -> DataFrame:
    """The newest version by seq of each key, without those that are deleted. Partial aggregation: no sort of a hot key's versions."""
    rest = [c for c in versions.columns if c != key]
    newest = versions.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("v"))
    return newest.select(key, "v.*").where(~F.col("deleted"))


def apply_changes(stream: DataFrame, path: str, checkpoint: str):
    """Streaming query that appends each batch of changes as versions (doc_id, body, seq, deleted) below `path`; one folder a batch, so a repeated batch writes the same."""

    def put(batch: DataFrame, number: int) -> None:
        body = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit(""))
        batch.select(F.col("rel_path").alias("doc_id"), body.alias("body"), "seq", (F.col("op") == "delete").alias("deleted")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()


def keep_fresh(store: Store, stream: DataFrame, checkpoint: str, every: str = "1 second"):
    """Streaming query that commits each batch of changes (op, rel_path, content, seq) to the index that searches read.

    The manifest holds the number of the last batch, so a batch that is repeated after a failure changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        if store.manifest().get("marks", {}).get(checkpoint, -1) >= number:
            return
        newest = batch.groupBy("rel_path").agg(F.max_by(F.struct("op", "content"), "seq").alias("v")).select("rel_path", "v.*").persist()
        try:
            if newest.isEmpty():
                return
            docs = index.docs_table(newest.where("op = 'upsert'").select("rel_path", "content"), summarize("body"))
            gone = newest.where("op = 'delete'").select(F.col("rel_path").alias("doc_id"))
            for wait in (0.2, 0.5, 1, 2, 5, None):
                try:
                    store.change(docs, gone, {checkpoint: number})
                    return
                except IndexBusy:
                    if wait is None:
                        raise
                    time.sleep(wait)
        finally:
            newest.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def rate_limited(events: DataFrame, key: str, seconds: str, order: str, per_minute: float, burst: int = 0, secure: bool = False) -> DataFrame:
    """events with allowed: a bucket for each key holds max(1, burst or per_minute), refills per_minute / 60 a second; an event takes one token if there is one.

    A secure limiter without a rate takes SECURE_PER_MINUTE; another one without a rate allows all. Keys are
    dealt to tasks and read in order as a stream, so a key's history is never held, only its bucket. Null keys share one.
    """
    rows = events.select(key, seconds, order)
    per_minute = per_minute or (SECURE_PER_MINUTE if secure else 0)
    if not per_minute:
        return rows.withColumn("allowed", F.lit(True))
    most, rate = float(max(1, burst or per_minute)), per_minute / 60.0
    schema = T.StructType([*rows.schema.fields, T.StructField("allowed", T.BooleanType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now_key, held, last = object(), most, None
        for pdf in parts:
            out = []
            for k, now in zip(pdf[key].tolist(), pdf[seconds].tolist()):
                if k != now_key and not (pd.isna(k) and isinstance(now_key, float)):
                    now_key, held, last = (float("nan") if pd.isna(k) else k), most, None
                held = most if last is None else min(most, held + (now - last) * rate)
                last = now
                out.append(held >= 1.0)
                held -= held >= 1.0
            yield pdf.assign(allowed=out)

    return rows.repartition(key).sortWithinPartitions(key, seconds, order).mapInPandas(run, schema)
