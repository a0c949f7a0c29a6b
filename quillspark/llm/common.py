"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow mapping, component labels."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from itertools import count
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parents[2]
#: The words of every contract: runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes (a session that has smaller bounds keeps them), and ship this package where executors don't have it on their path."""
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):
        held = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    on_path = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    sc = spark.sparkContext
    if on_path or getattr(sc, "_quillspark_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "quillspark_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "quillspark").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._quillspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named and all runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = Path(tempfile.mkdtemp(prefix="quillspark-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder: call it when the results that operators returned are written."""
    fs, p = hadoop_path(spark, f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}")
    fs.delete(p, True)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = scratch(session(df), name)
    df.write.parquet(path)
    out = session(df).read.schema(df.schema).parquet(path)
    out._quillspark_path = path
    return out


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def make_dir(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.mkdirs(p)


def drop(*frames: DataFrame) -> None:
    """Delete tables made by save() that no later plan reads."""
    for df in frames:
        fs, p = hadoop_path(session(df), df._quillspark_path)
        fs.delete(p, True)


def map_rows(df: DataFrame, start: Callable[[], Callable[[dict], dict]], fields: str, keep: list[str]) -> DataFrame:
    """Arrow map: start() runs once a task and gives fn(columns as lists) -> new columns; `keep` passes through."""
    added = T._parse_datatype_string(fields)
    schema = T.StructType([df.schema[c] for c in keep] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        fn = start()
        for b in batches:
            new = fn(b)
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            cols += [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, to_arrow_type(f.dataType)) for f, x in ((f, new[f.name]) for f in added.fields)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(f.name for f in added.fields)])

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Null texts read as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of the texts; null reads as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


#: Tasks that the rows of one hot key are dealt to in dealt_join().
SALTS = 8


def dealt_join(df: DataFrame, on: str, small: DataFrame, by: str) -> DataFrame:
    """df left joined with `small`, which has a row for each `on` at most: rows of one key are dealt by a hash of `by` to SALTS tasks, each with a copy of small's row."""
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [on, "__salt"], "left").drop("__salt")


def hung(found: DataFrame, name: str) -> DataFrame:
    """(key, lows, ...) -> (key, component, ...): components of the graph that links each key with each of its `lows`, a non-empty array.

    A key hangs on the least of its lows, and so do its other lows, so just these few are
    nodes of the graph whose components are sought, and only the labels that move are joined back.
    """
    low = found.withColumn("__low", F.array_min("lows"))
    edges = low.where(F.size("lows") > 1).select(F.explode("lows").alias("a"), F.col("__low").alias("b")).where("a <> b").distinct()
    moved = components(edges, name).where("component <> node").select(F.col("node").alias("__low"), "component")
    out = dealt_join(low.drop("lows"), "__low", moved, "key")
    return out.withColumn("component", F.coalesce("component", "__low")).drop("__low")


def components(nodes_edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b) as (node, component), component = the least node.

    A round hooks each node, and the node it is labelled with, to the least label of a
    label among its neighbours, and short-cuts labels to their own labels, so whole trees
    merge and rounds grow with the logarithm of a component's size, not with its diameter.
    Labels only fall, and rounds go on until none does; they are written to the shared
    folder, and only whether one changed reaches the driver. Self edges keep a node; null
    ends are not expected.
    """
    sym = nodes_edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    sym = save(sym.union(sym.select(F.col("y"), F.col("x"))).distinct(), f"{name}-edges")
    labels = save(sym.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("component")), f"{name}-0")
    for i in count(1):
        up = labels.join(labels.select(F.col("node").alias("n2"), F.col("component").alias("jump")), F.col("component") == F.col("n2")).drop("n2")
        near = sym.join(up, sym.y == up.node).groupBy("x").agg(F.min("jump").alias("low"))
        met = save(up.join(near, up.node == near.x).select("node", "component", "jump", "low"), f"{name}-met-{i}")
        hooks = met.groupBy(F.col("component").alias("root")).agg(F.min("low").alias("hook"))
        new = met.join(hooks, met.node == hooks.root, "left").select("node", F.least("component", "jump", "low", "hook").alias("component"), F.col("component").alias("was"))
        new = save(new, f"{name}-{i}")
        changed = new.where("component <> was").limit(1).count()
        drop(labels, met)
        labels = new.drop("was")
        labels._quillspark_path = new._quillspark_path
        if not changed:
            break
    drop(sym)
    return labels
