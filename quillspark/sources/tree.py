"""Document trees as Spark sources: a batch scan, and a stream of changes found by comparing listings."""

from __future__ import annotations

import hashlib
import json
import os
import stat
import time
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillspark.sources.config import EXTENSIONS, Config

CHUNK = 256


def path_wanted(path: Column, config: Config) -> Column:
    """The scan's rule as a column, for paths that are already in a table."""
    low = F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", ""))
    name = F.element_at(F.split(low, "/"), -1)
    kind = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    ok = ~F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, config.names))) & kind.isin(list(EXTENSIONS))
    for p in config.prefixes:
        ok = ok & ~low.startswith(p)
    return ok


def listing(root: str, config: Config) -> dict[str, tuple[float, int]]:
    """rel_path -> (mtime, size); excluded folders aren't entered, links aren't followed."""
    found = {}
    for d, dirs, names in os.walk(root):
        rel = os.path.relpath(d, root)
        rel = "" if rel == "." else rel.replace(os.sep, "/") + "/"
        dirs[:] = sorted(x for x in dirs if config.wanted_dir(rel + x))
        for n in sorted(names):
            p = os.path.join(d, n)
            if config.wanted(rel + n) and os.path.isfile(p) and not os.path.islink(p):
                st = os.stat(p)
                found[rel + n] = (st.st_mtime, st.st_size)
    return found


def read_file(root: str, rel: str) -> bytes | None:
    """None for a file that is gone, nothing for one that can't be read."""
    try:
        return (Path(root) / rel).read_bytes()
    except FileNotFoundError:
        return None
    except OSError:
        return b""


def contents(paths: DataFrame, root: str) -> DataFrame:
    """paths (rel_path, ...) + content, read by the tasks; null where the file is gone."""

    @F.pandas_udf("binary")
    def content(rel: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else read_file(root, r) for r in rel], dtype=object)

    return paths.withColumn("content", content("rel_path"))


def _config(options: dict) -> Config:
    return Config.of(json.loads(options.get("names", "[]")), json.loads(options.get("prefixes", "[]")), options.get("stateDir", ".quillspark"))


class _Part(InputPartition):
    def __init__(self, paths):
        self.paths = paths


class TreeSource(DataSource):
    """format('doctree').option('path', root): rel_path, content, mtime, size. Hidden and empty files are there, as opposed to Spark's file sources."""

    @classmethod
    def name(cls) -> str:
        return "doctree"

    def schema(self) -> str:
        return "rel_path string, content binary, mtime double, size bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], _config(self.options))


class _Reader(DataSourceReader):
    def __init__(self, root, config):
        self.root, self.config = root, config

    def partitions(self):
        paths = list(listing(self.root, self.config).items())
        return [_Part(paths[i : i + CHUNK]) for i in range(0, len(paths), CHUNK)] or [_Part([])]

    def read(self, partition):
        for rel, (mtime, size) in partition.paths:
            content = read_file(self.root, rel)
            if content is not None:
                yield rel, content, mtime, size


class ChangeSource(TreeSource):
    """format('docchanges') as a stream: op (upsert or delete), rel_path, seq; option('listing') is a folder that driver and tasks share."""

    @classmethod
    def name(cls) -> str:
        return "docchanges"

    def schema(self) -> str:
        return "op string, rel_path string, seq bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(self.options["path"], self.options["listing"], _config(self.options))


#: Folders of the second level that a task compares; seconds for which a folder's time says too little to rely on it; versions' bits in a running number.
SUBTREES, GRAIN, SEQ_BITS = 64, 2.0, 32


def write_json(path: Path, what: dict) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f"{path.name}.{uuid.uuid4().hex[:8]}.tmp")
    part.write_text(json.dumps(what))
    part.replace(path)


def read_json(path: Path) -> dict | None:
    try:
        return json.loads(path.read_text())
    except FileNotFoundError:
        return None


def subtree_listing(root: str, subtree: str, deep: bool, old: dict, config: Config) -> dict:
    """{dirs: rel -> time, files: rel -> [time, size, number]} below a folder, or just in it. A folder whose time is the old one isn't listed: its known files are looked at."""
    dirs, files, stack = {}, {}, [subtree]
    inside: dict[str, tuple[list, list]] = {}
    for kind, rels in ((0, old["files"]), (1, old["dirs"])):
        for rel in rels:
            inside.setdefault(rel.rpartition("/")[0], ([], []))[kind].append(rel)
    while stack:
        d = stack.pop()
        try:
            st = os.stat(os.path.join(root, d))
            known = d in old["dirs"] and old["dirs"][d] == st.st_mtime_ns
            own, below = inside.get(d, ([], [])) if known else ([], [])
            if not known:
                with os.scandir(os.path.join(root, d)) as entries:
                    for x in entries:
                        rel = f"{d}/{x.name}" if d else x.name
                        if x.is_dir(follow_symlinks=False):
                            below.append(rel) if config.wanted_dir(rel) else None
                        elif x.is_file(follow_symlinks=False) and config.wanted(rel):
                            own.append(rel)
        except OSError:  # it went, or can't be read
            continue
        fresh = time.time() - st.st_mtime < GRAIN  # another entry may still come within the clock's grain
        dirs[d] = -1 if fresh else st.st_mtime_ns
        for rel in own:
            try:
                f = os.stat(os.path.join(root, rel), follow_symlinks=False)
            except OSError:
                continue
            if stat.S_ISREG(f.st_mode):
                files[rel] = [f.st_mtime_ns, f.st_size, f.st_ino]
        stack += [x for x in below if x != d] if deep else []
    return {"dirs": dirs, "files": files}


class _Subtrees(InputPartition):
    def __init__(self, start: int, end: int, number: int, trees: list[tuple[str, bool]]):
        self.start, self.end, self.number, self.trees = start, end, number, trees


class _Changes(DataSourceStreamReader):
    """Offset: the number of a listing. The listing is a table in a shared folder: a file for each subtree and each version in which it changed, written by the
    task that compares it, and one for each partition that says which did. A repeated task finds these and gives the same rows. The driver lists two levels of
    folders. A rename is a delete and an upsert."""

    def __init__(self, root: str, listing: str, config: Config):
        self.root, self.listing, self.config = root, Path(listing), config

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        """One version after the newest that a batch has begun."""
        return {"version": max(map(version_of, (self.listing / "versions").glob("*.json")), default=0) + 1}

    def _subfolders(self, rel: str) -> list[str]:
        try:
            with os.scandir(os.path.join(self.root, rel)) as entries:
                found = [f"{rel}/{x.name}" if rel else x.name for x in entries if x.is_dir(follow_symlinks=False)]
        except OSError:
            return []
        return sorted(x for x in found if self.config.wanted_dir(x))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The subtrees there are now, and those that there were: the root and its folders by themselves, and all below them."""
        at = self.listing / "versions" / f"{end['version']}.json"
        plan = read_json(at)
        if plan is None:
            before = (read_json(self.listing / "versions" / f"{start['version']}.json") or {"trees": []})["trees"]
            tops = self._subfolders("")
            trees = {("", False), *((x, False) for x in tops), *((y, True) for x in tops for y in self._subfolders(x))}
            plan = {"trees": sorted(trees), "gone": sorted({(t, d) for t, d in before} - trees)}
            write_json(at, plan)
        trees = [(t, d) for t, d in (*plan["trees"], *plan["gone"])]
        return [_Subtrees(start["version"], end["version"], i, trees[i : i + SUBTREES]) for i in range(0, len(trees), SUBTREES)]

    def _folder(self, subtree: str, deep: bool) -> Path:
        return self.listing / "subtrees" / hashlib.sha256(f"{int(deep)}{subtree}".encode()).hexdigest()[:24]

    def read(self, partition: _Subtrees):
        n, mark = partition.end << SEQ_BITS, self.listing / "done" / f"{partition.end}-{partition.number}.json"
        done, changed = read_json(mark), []
        for t, deep in partition.trees:
            if done is not None and [t, deep] not in done:
                continue
            at = self._folder(t, deep)
            held = sorted(map(version_of, at.glob("*.json")))
            last = max((v for v in held if v <= partition.start), default=None)
            old = {"dirs": {}, "files": {}} if last is None else read_json(at / f"{last}.json")
            now = read_json(at / f"{partition.end}.json")
            if now is None:
                now = subtree_listing(self.root, t, deep, old, self.config)
                if now == old:
                    continue
                write_json(at / f"{partition.end}.json", now)
            changed.append((t, deep))
            for v in held:
                if last is not None and v < last:
                    (at / f"{v}.json").unlink(missing_ok=True)
            for rel in sorted(old["files"].keys() - now["files"].keys()):
                yield "delete", rel, n
            for rel in sorted(now["files"]):
                if old["files"].get(rel) != now["files"][rel]:
                    yield "upsert", rel, n
        if done is None:
            write_json(mark, changed)

    def commit(self, end: dict) -> None:
        """Plans and marks of batches before `end` aren't asked for again; subtrees' listings go as newer ones follow."""
        for p in (*(self.listing / "versions").glob("*.json"), *(self.listing / "done").glob("*.json")):
            if version_of(p) < end["version"]:
                p.unlink(missing_ok=True)


def version_of(p: Path) -> int:
    return int(p.name.partition(".")[0].partition("-")[0])


def scan(spark: SparkSession, root: str, names=(), prefixes=(), state_dir: str = ".quillspark") -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("doctree").option("path", root).option("names", json.dumps(list(names))).option("prefixes", json.dumps(list(prefixes))).option("stateDir", state_dir).load()


def changes(spark: SparkSession, root: str, names=(), prefixes=(), state_dir: str = ".quillspark", listing: str | None = None) -> DataFrame:
    """The stream op, rel_path, content, seq; contents are read by the tasks, and a file that is gone by then is left to the deletion that follows.

    listing: the folder of the listings, one for each query; below state_dir if none is given. A query that goes on from its checkpoint needs the folder that it had.
    """
    spark.dataSource.register(ChangeSource)
    at = listing or str(Path(root) / state_dir / "listing" / uuid.uuid4().hex)
    found = spark.readStream.format("docchanges").option("path", root).option("listing", at).option("names", json.dumps(list(names))).option("prefixes", json.dumps(list(prefixes))).option("stateDir", state_dir).load()
    read = contents(found, root).withColumn("content", F.when(F.col("op") == "upsert", F.col("content")))
    return read.where("op = 'delete' or content is not null").select("op", "rel_path", "content", "seq")
