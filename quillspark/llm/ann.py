"""Approximate nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking.

Coarse and product centroids are fitted in numpy on a bounded sample; every row is
indexed. Neighbouring cells form groups, a query is sent once to each group in which it
probes cells, with what its nearest must reach by a known sample, and a group's vectors and queries are dealt into blocks, so a cell that holds a
third of all rows is many small units. In a unit, asymmetric distance tables give each
query a short list from the cells it probes (of equal codes the smallest ids), which is
reranked at once with the original vectors that lie beside the codes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import map_rows, prepare, save, table

K, EVERY = 20, 20
#: Bound of the sample that centroids are fitted on.
SAMPLE = 30_000
SUBSPACES, CODEWORDS = 32, 256
#: Share of the true neighbours, by brute force within the sample, whose cells the probes must cover; queries taken for it;
#: and candidates that the probed cells must hold for each wanted neighbour.
COVER, COVER_QUERIES, LEAST_FACTOR = 0.9, 400, 16
SHORT_LIST = 192
#: Cells are FINE times the square root of the rows, at most MOST_CELLS; a group of cells should hold GROUP vectors, or as many as FINE times that root.
FINE, MOST_CELLS, GROUP = 8, 4096, 1024
#: Vectors that the product's codewords are fitted on, and rounds.
BOOK_SAMPLE, ROUNDS = 8192, 6
BLOCK, QUERY_BLOCK, AT_ONCE = 4096, 4096, 64


@dataclass
class Index:
    """coarse: cells x dim; books: subspaces x codewords x width; bounds: the subspaces' ends; probes: cells a query visits;
    group: that of each cell; scale: length of a cell's residuals, by which they are divided before they are quantised, so that dense cells are resolved as well."""

    coarse: np.ndarray
    books: list[np.ndarray]
    bounds: list[int]
    probes: int
    group: np.ndarray
    scale: np.ndarray

    def cells(self, v: np.ndarray) -> np.ndarray:
        """Nearest coarse centroid by Euclidean distance."""
        return (((self.coarse**2).sum(1)[None, :]) - 2 * v @ self.coarse.T).argmin(1)

    def codes(self, v: np.ndarray, cell: np.ndarray) -> np.ndarray:
        r = (v - self.coarse[cell]) / self.scale[cell, None]
        return np.stack([nearest(r[:, a:b], book) for a, b, book in zip(self.bounds, self.bounds[1:], self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with the codewords: queries x subspaces x codewords."""
        return np.stack([np.pad(q[:, a:b] @ book.T, ((0, 0), (0, CODEWORDS - len(book)))) for a, b, book in zip(self.bounds, self.bounds[1:], self.books)], 1)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1)[None, :] - 2 * x @ centers.T).argmin(1)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    u = np.unique(x, axis=0)
    if len(u) <= k:
        return u
    c = u[rng.choice(len(u), k, replace=False)]
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        s = np.stack([np.bincount(at, x[:, j], k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def probes_for(apart: np.ndarray, coarse: np.ndarray, k: int, cover: float) -> int:
    """Cells to visit in order of the query's inner product with their centroids, measured by brute force within rows that no centroid was fitted on."""
    own = np.arange(0, len(apart), max(1, len(apart) // COVER_QUERIES))
    q = apart[own]
    score = q @ apart.T
    score[np.arange(len(q)), own] = -np.inf
    k = min(k, len(apart) - 1)
    if k < 1:
        return 1
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ coarse.T), axis=1, kind="stable"), axis=1)
    at = np.sort(np.take_along_axis(place, nearest(apart, coarse)[top], 1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(cover * len(at))) - 1)]) + 1


def fit(sample: np.ndarray, n_rows: int, k: int = K, cover: float = COVER, seed: int = 5) -> Index:
    """sample: bounded, in random order; the number of cells follows the square root of all rows, at most MOST_CELLS.

    A third of it is kept apart to set the number of probes, with as many neighbours as it should hold of the k in all rows.
    """
    rng = np.random.default_rng(seed)
    apart, sample = sample[: len(sample) // 3].astype(np.float64), sample[len(sample) // 3 :].astype(np.float64)
    k = max(2, round(k * len(apart) / n_rows))
    cells = int(min(MOST_CELLS, max(1, len(sample) // 8), max(1, round(FINE * n_rows**0.5))))
    coarse = kmeans(sample, cells, ROUNDS, rng)
    dim = sample.shape[1]
    parts = min(SUBSPACES, dim)
    bounds = [round(i * dim / parts) for i in range(parts + 1)]
    at = nearest(sample, coarse)
    r = sample - coarse[at]
    own = (r**2).sum(1)
    # A little of all rows' scale stands in for a cell of a single row.
    scale = np.sqrt((np.bincount(at, own, len(coarse)) + 1e-3 * own.mean()) / (np.bincount(at, minlength=len(coarse)) + 0.1))
    scale = np.where(scale > 0, scale, 1.0)
    r = r / scale[at, None]
    books = [kmeans(r[:BOOK_SAMPLE, a:b], CODEWORDS, ROUNDS, rng) for a, b in zip(bounds, bounds[1:])]
    group = nearest(coarse, kmeans(coarse, max(1, min(len(coarse), n_rows // max(GROUP, int(FINE * n_rows**0.5)))), ROUNDS, rng))
    return Index(coarse, books, bounds, probes_for(apart, coarse, k, cover) if len(apart) else len(coarse), group, scale)


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """(vec_id, v): without null ids, and null, zero or non-finite vectors; components are floats or doubles as given, and computed with in double precision."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.coalesce(fine, F.lit(False)))
    return v if dim is None else v.where(F.size("v") == dim)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def search(vectors: DataFrame, k: int = K, every: int = EVERY, sample: int = SAMPLE, cover: float = COVER) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by inner product, ties to the smaller vec_id.

    Queries: rows whose vec_id is divisible by `every`; candidates: all rows of another vec_id.
    Null ids, null, zero or non-finite vectors take no part, nor do vectors of another length
    than the most frequent one (the longest, if several are). Repeated rows are candidates each; an id that is
    repeated is one query, by the least of its vectors. A query whose cells hold
    fewer than k candidates probes on, so it gets k or all there are. Empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    prepare(spark)
    dims = usable(vectors).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    n, dim = dims["count"], dims["d"]
    rows = usable(vectors, dim)
    chosen = rows.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).select("v", "vec_id").toArrow()
    taken = matrix(chosen.column("v").combine_chunks())
    index = fit(taken, n, k, cover)
    third = max(1, len(taken) // 3)
    shared = spark.sparkContext.broadcast(index)
    known = spark.sparkContext.broadcast((chosen.column("vec_id").to_numpy()[:third], taken[:third]))  # a third of the bounded sample

    def place():
        ix = shared.value

        def fn(batch):
            v = matrix(batch.column(batch.schema.get_field_index("v")))
            cell = ix.cells(v) if len(v) else np.zeros(0, int)
            codes = ix.codes(v, cell) if len(v) else np.zeros((0, len(ix.books)), np.uint8)
            return {"cell": pa.array(cell, pa.int32()), "code": pa.array([c.tobytes() for c in codes], pa.binary())}

        return fn

    indexed = save(map_rows(rows, place, "cell int, code binary", ["vec_id", "v"]), "ann-index")
    sizes = {r.cell: r["count"] for r in indexed.groupBy("cell").count().collect()}  # MOST_CELLS rows at most
    cells = np.array([sizes.get(c, 0) for c in range(len(index.coarse))])
    probes, group = index.probes, index.group
    least = min(n, LEAST_FACTOR * k)

    def route():
        ix, (ids, some) = shared.value, known.value

        def fn(batch):
            v = matrix(batch.column(batch.schema.get_field_index("v")))
            own = batch.column(batch.schema.get_field_index("vec_id")).to_numpy()
            out, bounds_, mosts = [], [], []
            for s in range(0, len(v), AT_ONCE):
                q = v[s : s + AT_ONCE]
                # What k known vectors reach is reached by the k nearest of all.
                score = np.where(ids[None, :] == own[s : s + AT_ONCE, None], -np.inf, q @ some.T)
                reach = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) >= k else np.full(len(q), -np.inf)
                bounds_.append(reach - 1e-9 * np.abs(np.where(np.isinf(reach), 0, reach)))
                for o in np.argsort(-(q @ ix.coarse.T), axis=1, kind="stable"):
                    enough = int(np.searchsorted(np.cumsum(cells[o]), least)) + 1
                    visit = o[: max(probes, enough)]
                    visit = np.sort(visit[cells[visit] > 0])
                    of, place = np.unique(group[visit], return_inverse=True)
                    size = np.bincount(place, cells[visit])
                    most = 1  # from each group, so that k are found however few reach the bound
                    while most < k and np.minimum(most, size).sum() < k + 1:
                        most += 1
                    out.append([{"group": int(g), "cells": visit[place == i].tolist()} for i, g in enumerate(of)])
                    mosts.append(most)
            return {"visits": out, "bound": np.concatenate([[], *bounds_]).tolist(), "least": mosts}

        return fn

    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = queries.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    routed = map_rows(queries, route, "visits array<struct<group:int,cells:array<int>>>, bound double, least int", ["vec_id", "v"])
    routed = save(routed.select(F.col("vec_id").alias("query_id"), "v", "bound", "least", F.explode("visits").alias("x")).select("query_id", "v", "bound", "least", "x.group", "x.cells"), "ann-queries")
    load = {r.group: r["count"] for r in routed.groupBy("group").count().collect()}
    held = np.bincount(group, cells, len(cells)).astype(int)
    shape = spark.createDataFrame([(c, int(g), max(1, -(-int(held[g]) // BLOCK)), -(-load.get(int(g), 0) // QUERY_BLOCK)) for c, g in enumerate(group)], "cell int, group int, vb int, qb int")
    # MOST_CELLS rows at most
    by_cell, by_group = F.broadcast(shape), F.broadcast(shape.drop("cell").distinct())
    part = lambda x, m: F.pmod(F.xxhash64(x), F.col(m).cast("long")).cast("int")
    v_units = indexed.join(by_cell, "cell").where("qb > 0").select("group", part("vec_id", "vb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("j"), "vec_id", "v", "code", "cell")
    q_units = routed.join(by_group, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)).alias("i"), part("query_id", "qb").alias("j"), "query_id", F.col("v").alias("qv"), "cells", "bound", "least")

    def unit(q: pa.Table, c: pa.Table) -> pa.Table:
        ix = shared.value
        if not q.num_rows or not c.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        c = c.sort_by("vec_id")
        ids, qids = c.column("vec_id").to_numpy(), q.column("query_id").to_numpy()
        v, qv = matrix(c.column("v").combine_chunks()), matrix(q.column("qv").combine_chunks())
        codes = np.frombuffer(b"".join(c.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        own, cell = np.unique(c.column("cell").to_numpy(), return_inverse=True)
        visits = q.column("cells").combine_chunks()
        flat, size = visits.flatten().to_numpy(), np.diff(visits.offsets.to_numpy())
        probed = np.zeros((len(qids), len(ix.coarse)), bool)
        probed[np.repeat(np.arange(len(qids)), size), flat] = True
        probed = probed[:, own]
        bound, fewest = q.column("bound").to_numpy(), q.column("least").to_numpy()
        places = np.arange(len(ids) - 1, -1, -1, dtype=np.int64)
        short = min(SHORT_LIST, len(ids))
        out = []
        for s in range(0, len(qids), AT_ONCE):
            now = slice(s, s + AT_ONCE)
            tables = ix.tables(qv[now])
            near = tables[:, 0, :][:, codes[:, 0]]
            for j in range(1, codes.shape[1]):
                near += tables[:, j, :][:, codes[:, j]]
            near = near * ix.scale[own][cell] + (qv[now] @ ix.coarse[own].T)[:, cell]
            near[~probed[now][:, cell] | (ids[None, :] == qids[now, None])] = -np.inf
            # One whole number that orders by the estimate, and equal ones by the smaller id.
            bits = near.astype(np.float32).view(np.int32)
            key = (np.where(bits < 0, bits ^ 0x7FFFFFFF, bits).astype(np.int64) << 31) | places
            best = np.argpartition(key, len(ids) - short, axis=1)[:, len(ids) - short :]
            score = np.einsum("qsd,qd->qs", v[best], qv[now])
            score[np.isinf(np.take_along_axis(near, best, 1))] = -np.inf
            order = np.lexsort((ids[best], -score), axis=1)[:, :k]
            score = np.take_along_axis(score, order, 1)
            fine = ~np.isinf(score) & ((score >= bound[now, None]) | (np.arange(score.shape[1])[None, :] < fewest[now, None]))
            found = np.take_along_axis(ids[best], order, 1)
            out.append((np.repeat(qids[now], fine.sum(1)), found[fine], score[fine]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    units = q_units.groupBy("group", "i", "j").cogroup(v_units.groupBy("group", "i", "j")).applyInArrow(unit, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return units.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
