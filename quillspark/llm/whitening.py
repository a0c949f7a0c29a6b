"""Embedding whitening: covariances by generated column aggregates, decomposed with LAPACK.

One aggregation holds a sum for each pair of dimensions (the upper triangle) of centred
products. Entries are whole numbers, and so are the sums: reruns and other partitions give
the same covariance to the bit. Only sums and the matrix, as large as the number of
dimensions makes it, reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import map_rows, prepare, save, table

#: x = floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries of this size or more don't fit and count as non-finite.
TOO_LARGE = float(2**52)
LONG = 2**63 - 1
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def finite(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): without null vectors and those with null, non-finite or too large entries."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < TOO_LARGE))
    return v.where(F.coalesce(fine, F.lit(False)))


def whole(v: str) -> F.Column:
    return F.transform(v, lambda c: F.floor(c * SCALE) + SHIFT)


@dataclass
class Fit:
    """n vectors: sums of each dimension, their means rounded to whole numbers, eigenvalues falling, eigenvectors as columns."""

    n: int
    sums: list[int]
    means: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    most: int

    def rest(self) -> list[int]:
        """What the rounded means leave of the sums."""
        return [s - self.n * m for s, m in zip(self.sums, self.means)]


def totals(x: DataFrame, dim: int) -> tuple[int, list[int], list[int], list[int]]:
    """(rows, sums, least, greatest) of each dimension of the array column x, exact."""
    each = lambda f: [f(F.get("x", F.lit(i))) for i in range(dim)]
    ask = lambda add: [*x.agg(F.count("*"), *each(add), *each(F.min), *each(F.max)).first()]  # noqa: E731  one row
    got = ask(F.try_sum)
    if got[0] and None in got:  # a sum beyond a long
        got = ask(lambda c: F.sum(c.cast("decimal(19,0)")))
    parts = [[int(v) if v is not None else 0 for v in got[1 + k * dim : 1 + (k + 1) * dim]] for k in range(3)]
    return got[0], *parts


def pair_sums(df: DataFrame, cols: list[F.Column], wide: bool = False) -> list:
    """Sums of the products of every two of `cols` (i <= j, row by row), in one aggregation; wide: beyond a long."""
    named = df.select(*(c.alias(f"d{i}") for i, c in enumerate(cols)))
    left = "CAST(d{} AS DECIMAL(19,0))" if wide else "d{}"
    pairs = [F.expr(f"sum({left.format(i)} * {left.format(j)})") for i in range(len(cols)) for j in range(i, len(cols))]
    return [*named.agg(*pairs).first()]  # one row


def fit(x: DataFrame, dim: int) -> Fit | None:
    """x: rows with an array column x of `dim` longs, all of which are the fit list; None without rows."""
    n, sums, least, most = totals(x, dim)
    if not n:
        return None
    means = [round(s / n) if abs(s) < 2**53 else (2 * s + n) // (2 * n) for s in sums]
    far = max(max(abs(lo - m), abs(hi - m)) for m, lo, hi in zip(means, least, most))
    products = iter(pair_sums(x, [F.get("x", F.lit(i)) - F.lit(m) for i, m in enumerate(means)], wide=far * far * n > LONG))
    out = Fit(n, sums, means, np.zeros(0), np.zeros((0, 0)), 0.0, far)
    rest = out.rest()
    v = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            v[i, j] = v[j, i] = (n * int(next(products)) - rest[i] * rest[j]) / n**2  # whole numbers, divided once
    values, vectors = np.linalg.eigh(v)  # LAPACK, rising
    out.values, out.vectors, out.trace = values[::-1].copy(), vectors[:, ::-1].copy(), float(np.trace(v))
    return out


def projection(f: Fit, components: int) -> tuple[np.ndarray, list[float]]:
    """(dim x components matrix that whitens centred rows, shares of the trace). A component without variance is a column of zeros."""
    values = f.values[:components]
    some = values > max(f.values[0], 0) * len(f.values) * np.finfo(float).eps
    scale = np.where(some, 1 / np.sqrt(np.where(some, values, 1.0)), 0.0)
    return f.vectors[:, : len(values)] * scale, [float(e / f.trace) if ok else 0.0 for e, ok in zip(values, some)]


def rows_out(x: DataFrame, f: Fit, w: np.ndarray) -> DataFrame:
    """(vec_id, deviation, w): the exact deviation and the whitened components of each row."""
    n, means, rest = f.n, f.means, f.rest()
    fits = len(means) * (n * f.most + max(map(abs, rest))) ** 2 <= LONG

    def start():
        m, r = np.array(means, np.int64), np.array(rest, object if not fits else np.int64)
        off = np.array([v / n for v in rest])

        def fn(b: pa.RecordBatch) -> dict:
            d = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) - m
            y = (d if fits else d.astype(object)) * n - r
            total = [int(t) if t <= LONG else None for t in (y * y).sum(1)]
            flat = ((d - off) @ w).ravel()
            return {"deviation": total, "w": pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, w.shape[1], np.int32), pa.array(flat))}

        return fn

    return map_rows(x.select("vec_id", "x"), start, "deviation long, w array<double>", ["vec_id"])


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): up to `components` rows a vector.

    Vectors that are null, or hold null, non-finite or too large (2^52) entries, are left out, and so are those whose
    length isn't the most common one (of equally common ones the longest). Null and repeated ids are rows like others, other
    columns are ignored. deviation is null where it doesn't fit a long. A component without
    variance (all vectors equal, fewer vectors than dimensions) has whitened 0 and explained 0, and isn't part of
    identity_error, which is measured on the rows that are returned. Empty table, or vectors
    without entries: no rows. The sums are one expression for each pair of dimensions, d * (d + 1) / 2: meant for some hundred dimensions.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = finite(vectors)
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dims is None or not dims["d"]:
        return spark.createDataFrame([], SCHEMA)
    x = v.where(F.size("v") == dims["d"]).select("vec_id", whole("v").alias("x"))
    f = fit(x, dims["d"])
    w, shares = projection(f, components)
    out = save(rows_out(x, f, w), "whitened")
    real = [k for k, s in enumerate(shares) if s > 0]
    error = identity_error(out, real) if real else 0.0
    rows = out.select("vec_id", F.lit(f.n).cast("long").alias("n"), "deviation", F.posexplode("w").alias("k", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, shares)), F.col("k") + 1)
    return rows.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(rows: DataFrame, components: list[int]) -> float:
    """Largest entry of the whitened rows' covariance minus the identity."""
    at = [F.get("w", F.lit(k)) for k in components]
    mean = [*rows.agg(*map(F.avg, at)).first()]
    n = rows.count()
    sums = iter(pair_sums(rows, [c - F.lit(m) for c, m in zip(at, mean)]))
    worst = [abs(next(sums) / n - (i == j)) for i in range(len(at)) for j in range(i, len(at))]
    return float(max(worst)) if all(map(math.isfinite, worst)) else math.inf


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
