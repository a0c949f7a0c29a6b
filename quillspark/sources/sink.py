"""A sink with a commit protocol for reports and audit records: format('quilllog'), batch and stream.

Tasks write parts that nobody reads yet; the commit writes one small manifest that names them, so a failed job shows
nothing and a repeated micro-batch writes nothing twice. Records of a part are chained by
their hashes, and manifests by theirs, so a record or a segment that is changed, taken out or added is found.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from quillspark.shipping import ship

#: Age in seconds from which on unnamed parts may go.
ORPHANS = 86_400
MANIFEST = "segment string, before string, before_hash string, parts array<struct<name:string,rows:bigint,tail:string>>, hash string"
RECORD = "n bigint, row string, prev string, hash string"


class Place:
    """Small files below a path, by pyarrow's file systems."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.kinds = fs

    def at(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(self.kinds.FileSelector(self.at(folder), allow_not_found=True))
        return sorted(x.base_name for x in found if x.type == self.kinds.FileType.File)

    def read(self, name: str) -> str:
        with self.fs.open_input_stream(self.at(name)) as f:
            return f.read().decode()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all, where the file system moves files at once."""
        part = f"{name}.{uuid.uuid4().hex[:8]}.tmp"
        self.fs.create_dir(self.at(name).rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(self.at(part)) as f:
            f.write(text.encode())
        self.fs.move(self.at(part), self.at(name))

    def drop(self, name: str) -> None:
        if self.fs.get_file_info(self.at(name)).type != self.kinds.FileType.NotFound:
            self.fs.delete_file(self.at(name))


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    tail: str


def link(prev: str, row: str) -> str:
    return hashlib.sha256(f"{prev}|{row}".encode()).hexdigest()


def write_part(path: str, rows: Iterator) -> Part:
    """A chain of its own for each task, written as it comes; what a failing task has begun goes."""
    place, name, n, prev = Place(path), f"{uuid.uuid4().hex}.jsonl", 0, ""
    place.fs.create_dir(place.at("parts"), recursive=True)
    try:
        with place.fs.open_output_stream(place.at(f"parts/{name}")) as f:
            for r in rows:
                row = json.dumps(r.asDict(recursive=True), default=str, sort_keys=True)
                own = link(prev, row)
                f.write((json.dumps({"n": n, "row": row, "prev": prev, "hash": own}) + "\n").encode())
                n, prev = n + 1, own
    except BaseException:
        place.drop(f"parts/{name}")
        raise
    return Part(name, n, prev)


def commit_parts(path: str, segment: str, parts: list[Part], replace: bool = False) -> None:
    """Name the parts in a manifest that follows the newest; a segment that is there already stays, and its new parts go. One writer at a time is expected."""
    place = Place(path)
    old = [x for x in place.names("manifests") if x.endswith(".json")]
    if f"{segment}.json" in old:
        drop_parts(path, parts)
        return
    last = None if replace or not old else json.loads(place.read(f"manifests/{old[-1]}"))
    body = {"segment": segment, "before": last["segment"] if last else "", "before_hash": last["hash"] if last else "", "parts": [{"name": p.name, "rows": p.rows, "tail": p.tail} for p in parts if p.rows]}
    place.write(f"manifests/{segment}.json", json.dumps({**body, "hash": manifest_hash(body)}))
    if replace:
        for x in old:
            gone = json.loads(place.read(f"manifests/{x}"))["parts"]
            place.drop(f"manifests/{x}")
            for p in gone:
                place.drop(f"parts/{p['name']}")
    drop_parts(path, [p for p in parts if not p.rows])


def manifest_hash(body: dict) -> str:
    return link(body["before_hash"], "|".join([body["segment"], body["before"], *(f"{p['name']}:{p['rows']}:{p['tail']}" for p in body["parts"])]))


def drop_parts(path: str, parts: list[Part]) -> None:
    for p in parts:
        if p is not None:
            Place(path).drop(f"parts/{p.name}")


def sweep(path: str, seconds: float = ORPHANS) -> int:
    """Delete parts that no manifest names and that are older than so many seconds (what killed tasks left); returns how many. No job that takes longer should be writing."""
    place = Place(path)
    named = {p["name"] for x in place.names("manifests") if x.endswith(".json") for p in json.loads(place.read(f"manifests/{x}"))["parts"]}
    found = place.fs.get_file_info(place.kinds.FileSelector(place.at("parts"), allow_not_found=True))
    old = [x.base_name for x in found if x.base_name not in named and time.time() - x.mtime.timestamp() >= seconds]
    for name in old:
        place.drop(f"parts/{name}")
    return len(old)


class LogSink(DataSource):
    """option('path'): a folder that tasks and driver share. mode('overwrite') replaces all segments, append adds one."""

    @classmethod
    def name(cls) -> str:
        return "quilllog"

    def schema(self) -> str:
        return RECORD

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator) -> Part:
        return write_part(self.path, iterator)

    def commit(self, messages) -> None:
        last = [int(x.split(".")[0].split("-")[1]) for x in Place(self.path).names("manifests") if x.startswith("job-") and x.endswith(".json")]
        commit_parts(self.path, f"job-{max(last, default=-1) + 1:012d}", [m for m in messages if m is not None], self.overwrite)

    def abort(self, messages) -> None:
        drop_parts(self.path, messages)


class _StreamWriter(DataSourceStreamWriter):
    """A segment a micro-batch, named by its number."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Part:
        return write_part(self.path, iterator)

    def commit(self, messages, batchId: int) -> None:
        commit_parts(self.path, f"stream-{batchId:012d}", [m for m in messages if m is not None])

    def abort(self, messages, batchId: int) -> None:
        drop_parts(self.path, messages)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    ship(spark)
    spark.dataSource.register(LogSink)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifests/*.json")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(segment, part, n, row, prev, hash) of what is committed; row is the record as JSON. Parts that no manifest names don't count."""
    named = manifests(spark, path).select("segment", F.explode("parts.name").alias("part"))
    held = spark.read.schema(RECORD).json(f"{path}/parts").withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return held.join(named, "part").select("segment", "part", "n", "row", "prev", "hash")


def verify_log(spark: SparkSession, path: str) -> DataFrame:
    """(segment, intact) of each segment: its own hash, the one before it, and every part's chain from its first record to its tail."""
    m = manifests(spark, path)
    text = F.concat_ws("|", "segment", "before", F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["name"], p["rows"].cast("string"), p["tail"])), "|"))
    body = F.when(F.size("parts") > 0, text).otherwise(F.concat_ws("|", "segment", "before"))
    own = F.sha2(F.concat(F.col("before_hash"), F.lit("|"), body), 256) == F.col("hash")
    earlier = m.select(F.col("segment").alias("before"), F.col("hash").alias("theirs"))
    chained = m.join(earlier, "before", "left").select("segment", "parts", (own & F.coalesce(F.col("theirs") == F.col("before_hash"), (F.col("before") == "") & (F.col("before_hash") == ""))).alias("whole"))
    w = Window.partitionBy("part").orderBy("n")
    links = records(spark, path).withColumn("ok", (F.col("prev") == F.coalesce(F.lag("hash").over(w), F.lit(""))) & (F.sha2(F.concat("prev", F.lit("|"), "row"), 256) == F.col("hash")))
    parts = links.groupBy("part").agg(F.min("ok").alias("ok"), F.count("*").alias("have"), F.max_by("hash", "n").alias("end"))
    said = chained.select("segment", "whole", F.explode_outer("parts").alias("p")).select("segment", "whole", F.col("p.name").alias("part"), F.col("p.rows").alias("rows"), F.col("p.tail").alias("tail"))
    fine = F.col("part").isNull() | F.coalesce(F.col("ok") & (F.col("have") == F.col("rows")) & (F.col("end") == F.col("tail")), F.lit(False))
    return said.join(parts, "part", "left").groupBy("segment").agg(F.min(F.col("whole") & fine).alias("intact"))
