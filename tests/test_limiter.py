"""The limiter as a stream: the batch query's answers over several micro-batches and a restart."""

import random

import pytest

from quillspark.streaming import limiter
from quillspark.streaming.upserts import rate_limited


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(limiter.PROVIDER)
    spark.conf.set(limiter.PROVIDER, limiter.ROCKS)
    yield
    spark.conf.set(limiter.PROVIDER, before)


def test_stream_equals_batch(spark, tmp_path, rocks):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), float(rng.randrange(4000)) / 4, i) for i in range(240)]
    rows.sort(key=lambda r: (r[1], r[2]))
    schema = "k string, s double, i long"
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    batch = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(source)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        q = limiter.rate_limited_stream(stream, "k", "s", "i", 12, 3).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return q

    for part in (rows[:80], rows[80:120]):
        batch(part)
    run()
    batch(rows[120:])
    run()  # from the checkpoint
    got = {r.i: r.allowed for r in spark.read.parquet(out).collect()}
    want = {r.i: r.allowed for r in rate_limited(spark.createDataFrame(rows, schema), "k", "s", "i", 12, 3).collect()}
    assert got == want and set(got.values()) == {True, False}


def test_settings(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value k", "cast(value as double) s", "value i")
    assert limiter.rate_limited_stream(stream, "k", "s", "i", 0).columns == ["k", "s", "i", "allowed"]
    if spark.conf.get(limiter.PROVIDER) != limiter.ROCKS:
        with pytest.raises(ValueError, match="providerClass"):
            limiter.rate_limited_stream(stream, "k", "s", "i", 5)
