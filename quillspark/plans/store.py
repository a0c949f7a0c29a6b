"""The index on disk: segments of Parquet tables in folders, and manifests that name the ones that are read.

A commit writes one segment: the changed documents, their postings in blocks, a dictionary whose counts are what the
commit adds and takes away, and the ids that it makes dead in older segments. Segments are merged by size, a tail of small ones at a time,
so a document is written again once a size class. Readers hold a lease on the version that they opened: its
segments stay until the lease is given back or runs out.
"""

from __future__ import annotations

import fcntl
import json
import math
import re
import threading
import time
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial, reduce
from itertools import accumulate
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import summarize
from quillspark.operators import index, query
from quillspark.plans.search import Corpus

#: Segments of a size class that are merged, and the factor from class to class.
FAN = 4
#: Seconds that a reader's lease and a writer's lock last without being renewed.
LEASE_SECONDS, LOCK_SECONDS = 900, 60
#: Changed ids that are looked up by a list in the scan, and dead ones that are broadcast (some 50 MB); beyond that they are joined.
FEW_IDS, MANY_DEAD = 1000, 500_000
DOCS = "doc_id string, rel_path string, body string, summary string, token_estimate bigint"
TABLES = {
    "docs": f"{DOCS}, range bigint",
    "postings": "field string, term string, range bigint, n bigint, cf bigint, sky array<struct<tf:int,dl:bigint>>, ids array<string>, tfs array<int>, dls array<bigint>, positions array<array<int>>",
    "terms": "field string, term string, df bigint, cf bigint",
    "dead": "doc_id string",
}


class MissingIndex(FileNotFoundError):
    pass


class IndexBusy(RuntimeError):
    """Another writer holds the index; reading goes on."""


def tail_to_merge(segments: list[dict]) -> int | None:
    """The place from which on segments are merged, oldest first; None if none are due.

    FAN segments of one size class at the end, with nothing larger between, become one; so do all when half of what they hold is dead.
    """
    sizes = [max(1, s["docs"] + s["dead"]) for s in segments]
    if len(segments) > 1 and 2 * sum(s["dead"] for s in segments[1:]) >= max(2, sum(s["docs"] for s in segments)):
        return 0
    classes = [int(math.log(n, FAN) + 1e-9) for n in sizes]
    for c in sorted({*classes}):
        start = len(classes)
        while start and classes[start - 1] <= c:
            start -= 1
        if classes[start:].count(c) >= FAN:
            return start
    return None


class Folder:
    """Small files of a folder through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(self.conf)
        self.path = self.fs.makeQualified(self.path)
        self.local = self.path.toUri().getPath() if self.fs.getScheme() == "file" else None

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def make(self) -> None:
        """Only its owner may enter it."""
        mode = self.jvm.org.apache.hadoop.fs.permission.FsPermission("700")
        if not self.fs.exists(self.path):
            self.fs.mkdirs(self.path, mode)
        self.fs.setPermission(self.path, mode)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path)] if self.fs.exists(self.path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: another name first."""
        part = self.at(f".{name}.{uuid.uuid4().hex[:8]}.tmp")
        stream = self.fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(part, self.at(name)) or self.read(name) != text:
            raise IndexBusy(f"{name} is there already")

    def create(self, name: str, text: str) -> bool:
        """Whether the file is new; one that is there stays as it is."""
        try:
            stream = self.fs.create(self.at(name), False)
        except Py4JJavaError:
            return False
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def put(self, name: str, text: str) -> None:
        stream = self.fs.create(self.at(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def move(self, name: str, to: str) -> bool:
        try:
            return bool(self.fs.rename(self.at(name), self.at(to)))
        except Py4JJavaError:
            return False

    def size(self) -> int:
        return self.fs.getContentSummary(self.path).getLength()

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class Lock:
    """A file that names its owner and when it runs out. The owner renews it; one that has run out is moved away by the next writer, and only one can move it."""

    def __init__(self, folder: Folder, seconds: float | None = None):
        self.folder, self.seconds, self.me, self.done = folder, LOCK_SECONDS if seconds is None else seconds, uuid.uuid4().hex, threading.Event()

    def _text(self) -> str:
        return json.dumps({"owner": self.me, "until": time.time() + self.seconds})

    def holder(self) -> dict | None:
        try:
            return json.loads(self.folder.read("writer.lock"))
        except (Py4JJavaError, ValueError):  # gone, or not written yet
            return None

    def acquire(self) -> None:
        if not self.folder.create("writer.lock", self._text()):
            held = self.holder()
            if held is None or held["until"] > time.time():
                raise IndexBusy("another process writes to the index")
            if not self.folder.move("writer.lock", f"stale-{held['owner']}.lock") or not self.folder.create("writer.lock", self._text()):
                raise IndexBusy("another process took over a lock that had run out")
        self.check()
        threading.Thread(target=self._renew, daemon=True).start()

    def _renew(self) -> None:
        while not self.done.wait(self.seconds / 3):
            held = self.holder()
            if held is not None and held["owner"] == self.me and not self.done.is_set():
                self.folder.put("writer.lock", self._text())

    def check(self) -> None:
        held = self.holder()
        if held is None or held["owner"] != self.me:
            raise IndexBusy("the lock has been taken over")

    def release(self) -> None:
        self.done.set()
        held = self.holder()
        if held is not None and held["owner"] == self.me:
            self.folder.drop("writer.lock")


class Store:
    def __init__(self, spark: SparkSession, state_dir: str):
        self.spark, self.dir, self.folder = spark, str(state_dir).rstrip("/"), Folder(spark, str(state_dir))
        self.me, self.leases, self.lock = uuid.uuid4().hex[:12], {}, None

    def _manifests(self) -> list[int]:
        return sorted(int(m[1]) for x in self.folder.names() if (m := re.fullmatch(r"manifest-(\d+)\.json", x)))

    def manifest(self, version: int | None = None) -> dict:
        """The newest, or that of a version that is still held."""
        done = self._manifests()
        if not done or version is not None and version not in done:
            raise MissingIndex(f"index not found in {self.dir}")
        return json.loads(self.folder.read(f"manifest-{done[-1] if version is None else version:08d}.json"))

    def lease(self, version: int, seconds: float | None = None) -> None:
        """Hold a version for so long; a store holds each version once, and renews what it holds when half of its time is over."""
        seconds = LEASE_SECONDS if seconds is None else seconds
        if self.leases.get(version, 0) > time.time() + seconds / 2:
            return
        until = time.time() + seconds
        try:
            self.folder.put(f"lease-{version:08d}-{self.me}.json", json.dumps({"until": until}))
        except Py4JJavaError:  # a reader that may not write: the last two versions stay anyway
            return
        self.leases[version] = until

    def release(self, version: int | None = None) -> None:
        """Give back one version, or all that this store holds."""
        for v in [version] if version is not None else list(self.leases):
            if self.leases.pop(v, None):
                self.folder.drop(f"lease-{v:08d}-{self.me}.json")

    def _held(self) -> set[int]:
        """Versions under a lease; those that have run out are deleted."""
        out = set()
        for x in self.folder.names():
            if m := re.fullmatch(r"lease-(\d+)-\w+\.json", x):
                try:
                    until = json.loads(self.folder.read(x))["until"]
                except (Py4JJavaError, ValueError):  # given back or being written
                    until = math.inf
                if until > time.time():
                    out.add(int(m[1]))
                else:
                    self.folder.drop(x)
        return out

    @contextmanager
    def writing(self) -> Iterator[None]:
        """One writer at a time: by a lock that ends with its process in a local folder, elsewhere by a lease that its writer renews."""
        self.folder.make()
        if self.folder.local:
            with (Path(self.folder.local) / "writer.lock").open("w") as f:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                except OSError:
                    raise IndexBusy(f"another process writes to {self.dir}") from None
                yield
            return
        self.lock = Lock(self.folder)
        self.lock.acquire()
        try:
            yield
        finally:
            self.lock.release()
            self.lock = None

    def _segment(self, docs: DataFrame, seq: int) -> str:
        """Write documents and postings of a segment; docs are tokenized once they lie there. Returns its name, which no failed attempt shares."""
        name = f"seg-{seq:08d}-{uuid.uuid4().hex[:8]}"
        index.ranged(docs.select("doc_id", "rel_path", "body", "summary", "token_estimate")).write.parquet(f"{self.dir}/{name}/docs")
        # By range of documents too, so that a frequent term's blocks are many tasks and files.
        index.blocks(self._read(name, "docs"), query.FIELDS).write.partitionBy("field").parquet(f"{self.dir}/{name}/postings")
        return name

    def _dictionary(self, name: str, others: list[DataFrame]) -> dict[str, int]:
        """Write what the segment's postings and `others` (field, term, df, cf) come to, and return the sums of cf by field."""
        own = self._read(name, "postings").groupBy("field", "term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))
        rows = own
        if others:
            rows = reduce(DataFrame.unionByName, [own, *others]).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df <> 0 or cf <> 0")
        self._put_terms(name, rows)
        return {r.field: r.cf for r in self._read(name, "terms").groupBy("field").agg(F.sum("cf").alias("cf")).collect()}  # a row a field

    def _put_terms(self, name: str, rows: DataFrame) -> None:
        rows.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.partitionBy("field").parquet(f"{self.dir}/{name}/terms")

    def _commit(self, seq: int, segments: list[dict], stats: dict, marks: dict) -> dict:
        if self.lock:
            self.lock.check()
        old = self._manifests()
        m = {"version": seq, "segments": segments, "stats": stats, "num_docs": sum(s["docs"] for s in segments) - sum(s["dead"] for s in segments), "marks": marks, "commit_ms": int(time.time() * 1000), "writer": self.me}
        self.folder.write(f"manifest-{seq:08d}.json", json.dumps(m))
        stay = {seq, *old[-1:], *(self._held() & {*old})}
        named = {s["name"] for s in segments}
        for v in stay - {seq}:
            named |= {s["name"] for s in json.loads(self.folder.read(f"manifest-{v:08d}.json"))["segments"]}
        for v in old:
            if v not in stay:
                self.folder.drop(f"manifest-{v:08d}.json")
        for name in self.folder.names():
            if name.startswith("seg-") and name not in named or name.startswith("stale-"):
                self.folder.drop(name)
        return m

    def write(self, docs: DataFrame, marks: dict | None = None) -> dict:
        """A new index of docs (doc_id, rel_path, body, summary, token_estimate)."""
        with self.writing():
            seq = (self._manifests() or [0])[-1] + 1
            name = self._segment(docs, seq)
            totals, own = self._dictionary(name, []), self._entry(name, seq, False)
            return self._commit(seq, [own], {f: [own["docs"], totals.get(f, 0)] for f in query.FIELDS}, marks or {})

    def reindex(self, files: DataFrame) -> dict:
        return self.write(index.docs_table(files, summarize("body")))

    def update(self, files: DataFrame | None, deleted: list[str] = (), marks: dict | None = None) -> dict:
        """Upserts and deletions in one commit; a key that isn't there is no error."""
        gone = self.spark.createDataFrame([(d,) for d in deleted], "doc_id string") if deleted else None
        return self.change(None if files is None else index.docs_table(files, summarize("body")), gone, marks)

    def _replaced(self, m: dict, ids: DataFrame) -> DataFrame:
        """Live documents with one of the ids: a list in the scan for few, a join within their bounds else. Tables lie in the order of doc_id, so files and pages beside them aren't read."""
        n, low, high = ids.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
        if n <= FEW_IDS:
            among = [r.doc_id for r in ids.collect()]
            return self._open(m, "docs", lambda df: df.where(F.col("doc_id").isin(among)))
        return self._open(m, "docs", lambda df: df.where(F.col("doc_id").between(low, high))).join(ids, "doc_id", "left_semi")

    def change(self, docs: DataFrame | None, gone: DataFrame | None, marks: dict | None = None) -> dict:
        """docs replace those of equal ids, ids of `gone` go: one segment with them and the ids that are dead in older ones. One row a doc_id is expected.

        Of the older segments only the documents that change are read; what they counted for is taken off in the new segment's dictionary.
        """
        with self.writing():
            m = self.manifest()
            seq = m["version"] + 1
            name = self._segment(self.spark.createDataFrame([], DOCS) if docs is None else docs, seq)
            own = self._read(name, "docs").select("doc_id")
            self._write_ids(name, "changed", own if gone is None else own.unionByName(gone.select("doc_id")).distinct())
            old = self._replaced(m, self.spark.read.schema(TABLES["dead"]).parquet(f"{self.dir}/{name}/changed"))
            self._write_ids(name, "dead", old.select("doc_id"))
            less = index.term_stats(old, query.FIELDS, unique=True).select("field", "term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
            entry = self._entry(name, seq)
            totals = self._dictionary(name, [less] if entry["dead"] else [])
            stats = {f: [m["stats"].get(f, [0, 0])[0] + entry["docs"] - entry["dead"], m["stats"].get(f, [0, 0])[1] + totals.get(f, 0)] for f in query.FIELDS}
            out = self._commit(seq, [*m["segments"], entry], stats, {**m.get("marks", {}), **(marks or {})})
            while (start := tail_to_merge(out["segments"])) is not None:
                out = self._merge(out, start)
            return out

    def _write_ids(self, name: str, what: str, ids: DataFrame) -> None:
        ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(f"{self.dir}/{name}/{what}")

    def _merge(self, m: dict, start: int) -> dict:
        """One segment of the live documents of those from `start` on, with all that they made dead in older ones."""
        seq, tail = m["version"] + 1, m["segments"][start:]
        name = self._segment(self._open({**m, "segments": tail}, "docs"), seq)
        if start:
            ids = reduce(DataFrame.unionByName, [self._read(s["name"], "dead") for s in tail if s["dead"]] or [self.spark.createDataFrame([], "doc_id string")]).distinct()
            older = self._replaced({**m, "segments": m["segments"][:start]}, ids)
            self._write_ids(name, "dead", older.select("doc_id"))
            rows = reduce(DataFrame.unionByName, [self._read(s["name"], "terms") for s in tail])
            self._put_terms(name, rows.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df <> 0 or cf <> 0"))
        else:
            self._dictionary(name, [])
        return self._commit(seq, [*m["segments"][:start], self._entry(name, seq, start > 0)], m["stats"], m.get("marks", {}))

    def _entry(self, name: str, seq: int, with_dead: bool = True) -> dict:
        """A segment in a manifest: how many documents and dead ids it has, and the first id and the rows of each of their files."""
        files = {}
        for what, of in (("docs", F.shiftright("range", 33 - index.RANGE_BITS)), ("dead", F.input_file_name())):
            rows = self._read(name, what).groupBy(of.alias("f")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).collect() if what == "docs" or with_dead else []
            files[what] = sorted([r["first"], r["n"]] for r in rows)  # a row a file
        return {"name": name, "seq": seq, "docs": sum(n for _, n in files["docs"]), "dead": sum(n for _, n in files["dead"]), "files": files}

    def page(self, offset: int, limit: int, version: int | None = None) -> DataFrame:
        """Documents offset + 1 to offset + limit in the order of doc_id. Only files that may hold some of them are read, and one more a table for what lies before.

        The documents below an id are the segments' documents below it less their dead ids below it, which the files' first ids and
        counts in the manifest bound: the page lies between the last id with certainly no more than `offset` before it and the first with certainly
        enough.
        """
        m = self.manifest(version)
        tables = []  # (segment, table, sign, first ids, rows before each file and in all)
        for s in m["segments"]:
            for what, sign in (("docs", 1), ("dead", -1)):
                if s["files"][what]:
                    tables.append((s, what, sign, [f for f, _ in s["files"][what]], [0, *accumulate(n for _, n in s["files"][what])]))

        def below(x: str, upper: bool) -> int:
            """No fewer (upper) or no more documents than are below x."""
            return sum(sign * cum[bisect_left(firsts, x) if upper == (sign > 0) else max(0, bisect_right(firsts, x) - 1)] for *_, sign, firsts, cum in tables)

        cuts = sorted({f for _, what, _, firsts, _ in tables if what == "docs" for f in firsts})
        low = max((x for x in cuts if below(x, True) <= offset), default="")
        high = min((x for x in cuts if x > low and below(x, False) >= offset + limit), default=None)
        before, unsure = 0, []
        for s, what, sign, firsts, cum in tables:
            k = max(0, bisect_right(firsts, low) - 1)
            before += sign * cum[k]
            if cum[k] != cum[bisect_left(firsts, low)]:  # in the middle of a file
                unsure.append(self._read(s["name"], what).where((F.col("doc_id") >= firsts[k]) & (F.col("doc_id") < low)).select(F.lit(sign).alias("sign")))
        if unsure:
            before += reduce(DataFrame.unionByName, unsure).agg(F.sum("sign")).first()[0] or 0
        inside = lambda df: df.where(F.col("doc_id") >= low) if high is None else df.where((F.col("doc_id") >= low) & (F.col("doc_id") < high))
        return self._open(m, "docs", inside).orderBy("doc_id").offset(max(0, offset - before)).limit(limit)

    def _read(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.dir}/{segment}/{name}")

    def _rows(self, m: dict, name: str, within=lambda df: df) -> DataFrame:
        return reduce(DataFrame.unionByName, [within(self._read(s["name"], name)).withColumn("seg", F.lit(s["seq"]).cast("int")) for s in m["segments"]])

    def _live(self, m: dict, rows: DataFrame) -> DataFrame:
        """rows (seg, doc_id, ...) without those whose id a later segment names as dead."""
        dead = [self._read(s["name"], "dead").select(F.col("doc_id").alias("dead_id"), F.lit(s["seq"]).cast("int").alias("dead_at")) for s in m["segments"] if s["dead"]]
        if not dead:
            return rows
        last = reduce(DataFrame.unionByName, dead).groupBy("dead_id").agg(F.max("dead_at").alias("dead_at"))
        last = F.broadcast(last) if sum(s["dead"] for s in m["segments"]) <= MANY_DEAD else last
        return rows.join(last, (F.col("doc_id") == F.col("dead_id")) & (F.col("seg") < F.col("dead_at")), "left_anti")

    def _open(self, m: dict, name: str, within=lambda df: df) -> DataFrame:
        """A table's live rows. Filters reach each segment's files."""
        return self._live(m, self._rows(m, name, within)).drop("seg", "range")

    def corpus(self, version: int | None = None, seconds: float | None = None) -> Corpus:
        """What is searched: the newest version, or an older one that is held. It is leased for `seconds`; release(corpus.version) gives it back."""
        for _ in range(3):
            m = self.manifest(version)
            self.lease(m["version"], seconds)
            if m["version"] in self._manifests():
                break  # else it went before the lease was there
        rows = [(f, n, t, t / n if n else None) for f, (n, t) in sorted(m["stats"].items())]
        stats = self.spark.createDataFrame(rows, "field string, n_docs long, total_tokens long, avgdl double")
        terms = self._rows(m, "terms").groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
        return Corpus.of_blocks(self._open(m, "docs"), self._rows(m, "postings"), terms, stats, partial(self._live, m), m["version"], sum(s["docs"] for s in m["segments"]))

    def stats(self) -> dict:
        m = self.manifest()
        size = self.folder.size()
        return {"num_docs": m["num_docs"], "state_dir": self.dir, "index_size_bytes": size, "segments": len(m["segments"]), "avg_bytes_per_doc": size // m["num_docs"] if m["num_docs"] else None, "last_updated_epoch_ms": m["commit_ms"]}
