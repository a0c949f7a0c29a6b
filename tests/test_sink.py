"""The log sink: nothing of a failed job, nothing twice, and every change is found."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quillspark.sources import sink


@pytest.fixture
def log(spark, tmp_path):
    sink.register(spark)
    return str(tmp_path / "log")


def put(df, path, mode="append"):
    df.write.format("quilllog").option("path", path).mode(mode).save()


def rows(spark, path):
    return sorted((json.loads(r.row)["id"], r.segment) for r in sink.records(spark, path).collect())


def test_batches(spark, log):
    put(spark.range(5).repartition(3), log)
    put(spark.range(5, 7), log)
    assert rows(spark, log) == [(i, f"job-{i // 5:012d}") for i in range(7)]
    assert {tuple(r) for r in sink.verify_log(spark, log).collect()} == {("job-000000000000", True), ("job-000000000001", True)}

    @F.udf("long")
    def breaks(i):
        if i == 9:
            raise ValueError("no")
        return i

    before = sorted(sink.Place(log).names("parts"))
    with pytest.raises(Exception, match="no"):
        put(spark.range(8, 12, 1, 4).select(breaks("id").alias("id")), log)
    assert len(rows(spark, log)) == 7 and before == [x for x in sorted(sink.Place(log).names("parts")) if x in before]
    time.sleep(1)
    assert sink.sweep(log, 3600) == 0
    sink.sweep(log, 0)
    assert sorted(sink.Place(log).names("parts")) == before
    put(spark.range(2), log, "overwrite")
    assert [i for i, _ in rows(spark, log)] == [0, 1] and {r.intact for r in sink.verify_log(spark, log).collect()} == {True}
    put(spark.range(0), log)
    assert sink.verify_log(spark, log).where("intact").count() == 2


def test_changes_are_found(spark, log):
    for i in range(3):
        put(spark.range(10 * i, 10 * i + 4).coalesce(1), log)
    place = sink.Place(log)
    part = json.loads(place.read("manifests/job-000000000001.json"))["parts"][0]["name"]
    text = place.read(f"parts/{part}")
    intact = lambda: {r.segment[-1]: r.intact for r in sink.verify_log(spark, log).collect()}
    for other in (text.replace(":12}", ":13}").replace(": 12}", ": 13}"), text.split("\n", 1)[1], text[: text.rstrip().rindex("\n") + 1]):
        assert other != text
        place.write(f"parts/{part}", other)
        assert intact() == {"0": True, "1": False, "2": True}
    place.write(f"parts/{part}", text)
    assert intact() == {"0": True, "1": True, "2": True}
    place.drop("manifests/job-000000000001.json")
    assert intact() == {"0": True, "2": False}


def test_stream(spark, log, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")

    def run():
        q = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(source).writeStream.format("quilllog").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    for part in ((0, 3), (3, 5)):
        spark.range(*part).coalesce(1).write.mode("append").json(source)
    run()
    assert [i for i, _ in rows(spark, log)] == [0, 1, 2, 3, 4]
    (tmp_path / "checkpoint" / "commits" / "1").unlink()  # as after a failure between the sink's commit and Spark's
    for crc in (tmp_path / "checkpoint" / "commits").glob(".1*"):
        crc.unlink()
    spark.range(5, 6).coalesce(1).write.mode("append").json(source)
    run()
    assert [i for i, _ in rows(spark, log)] == [0, 1, 2, 3, 4, 5] and {r.intact for r in sink.verify_log(spark, log).collect()} == {True}
