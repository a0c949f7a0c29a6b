"""N-gram Jaccard join by MinHash banding: candidates share a band, pairs are verified on full n-gram sets.

Texts with equal shingle sets are one set with a weight, so copies never meet each
other. Sets that share a band hash are linked through the least set of the bucket, never
pairwise; a set then hangs on the least of these, and the few others on that one, before
connected buckets are joined to clusters. A cluster is dealt by hash into blocks that are
bounded in sets and bytes, and each pair of blocks is one task unit that compares all its
pairs exactly and gives back one row a set: its links, and the least set it is connected
to. No pair is ever a row, no cluster is ever in one task, and no link is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import dealt_join, drop, hung, map_rows, prepare, raw_texts, save, table
from quillspark.llm.shingles import Shingler, mixed

WIDTH, SIMILARITY, RECALL = 5, 0.8, 0.998
#: Sets and bytes of shingles that a block should hold.
BLOCK_SETS, BLOCK_BYTES = 2048, 16 << 20
#: Shingles that so many sets of a unit share are counted by a matrix product, others pair by pair; cells of one matrix.
DENSE, CELLS = 24, 1 << 23
SEED = 20_24


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows a band, thus the fewest false candidates, whose recall at the threshold holds with `most` hashes."""
    for rows in range(most, 0, -1):
        bands = 1
        while 1 - (1 - similarity**rows) ** bands < recall and bands * rows <= most:
            bands += 1
        if bands * rows <= most and 1 - (1 - similarity**rows) ** bands >= recall:
            return bands, rows
    return most, 1


class MinHash:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(SEED)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**64, (bands * rows, 1), np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**64, (bands * rows, 1), np.uint64)
        self.at = mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """One 64-bit value a band."""
        low = None
        for i in range(0, len(s), 4096):
            m = (self.a * s[i : i + 4096][None, :] + self.b).min(axis=1)
            low = m if low is None else np.minimum(low, m)
        h = self.at.copy()
        for col in low.reshape(self.bands, self.rows).T:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + col)
        return h.view(np.int64)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, similarity: Fraction) -> np.ndarray:
    """Truth for each pair of sets (within a if b is None): Jaccard >= similarity, exactly."""
    sets = a if b is None else a + b
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = often[code] > 1
    owner, code = owner[keep], code[keep]
    rows, cols = (len(a), len(a)) if b is None else (len(a), len(b))
    both = np.zeros((rows, cols), np.int32)
    order = np.argsort(code, kind="stable")  # owners of a shingle stay in ascending order
    owner, code = owner[order], code[order]
    _, first, often = np.unique(code, return_index=True, return_counts=True)
    for k in range(2, DENSE):
        at = first[often == k]
        if not len(at):
            continue
        own = owner[at[:, None] + np.arange(k)]
        for i in range(k - 1):
            for j in range(i + 1, k):
                x, y = own[:, i], own[:, j]
                if b is None:
                    np.add.at(both, (x, y), 1)
                    np.add.at(both, (y, x), 1)
                else:
                    cross = (x < rows) & (y >= rows)
                    np.add.at(both, (x[cross], y[cross] - rows), 1)
    dense = often >= DENSE
    some = np.repeat(dense, often)
    owner, code = owner[some], np.repeat(np.arange(int(dense.sum())), often[dense])
    width = max(64, CELLS // len(sets))
    for s in range(0, int(dense.sum()), width):
        lo, hi = np.searchsorted(code, (s, s + width))
        m = np.zeros((len(sets), width), np.float32)
        m[owner[lo:hi], code[lo:hi] - s] = 1
        both += (m[:rows] @ (m if b is None else m[rows:]).T).astype(np.int32)  # exact: a slice has less than 2 ** 24 columns
    num, den = similarity.numerator, similarity.denominator
    out = np.empty((rows, cols), bool)
    right = n if b is None else n[rows:]
    for s in range(0, rows, 256):
        inter = both[s : s + 256].astype(np.int64)
        out[s : s + 256] = inter * (den + num) >= num * (n[s : min(s + 256, rows), None] + right[None, :])
    if b is None:
        np.fill_diagonal(out, False)
    return out


def roots(links: np.ndarray) -> np.ndarray:
    """Least reachable index of each node of a symmetric truth matrix."""
    label = np.full(len(links), -1)
    for i in range(len(links)):
        if label[i] < 0:
            label[i], reach = i, np.array([i])
            while len(reach):
                reach = np.flatnonzero(links[reach].any(0) & (label < 0))
                label[reach] = i
    return label


def _verify(similarity: float):
    exact = Fraction(str(similarity))

    def group(rows: list[tuple]) -> Iterator[tuple]:
        # rows: (p, q, block, key, weight, set bytes)
        seen = {r[3]: r for r in rows}
        p, q = rows[0][0], rows[0][1]
        left = [r for r in seen.values() if r[2] == p]
        right = [r for r in seen.values() if r[2] == q] if p != q else []
        if not left or (p != q and not right):
            return
        mine = left + right
        sets = [np.frombuffer(r[5], np.uint64) for r in mine]
        n = len(left)
        part = linked(sets[:n], sets[n:] if right else None, exact)
        if right:
            full = np.zeros((len(mine), len(mine)), bool)
            full[:n, n:] = part
            full[n:, :n] = part.T
        else:
            full = part
        weight = np.array([r[4] for r in mine])
        docs = np.concatenate([full[s : s + 256] @ weight for s in range(0, len(mine), 256)])
        for r, text_links, doc_links, to in zip(mine, full.sum(1), docs, roots(full)):
            if text_links:
                yield r[3], int(text_links), int(doc_links), mine[to][3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, out = [], None, []

        def batch():
            cols = list(zip(*out)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["key", "text_links", "doc_links", "root"])

        for b in batches:
            cluster, p, q, block, key, weight, s = (b.column(i).to_pylist() for i in range(7))
            for i in range(len(p)):
                at = (cluster[i], p[i], q[i])
                if at != now:
                    if held:
                        out.extend(group(held))
                    held, now = [], at
                held.append((p[i], q[i], block[i], key[i], weight[i], s[i]))
            if out:
                yield batch()
                out = []
        if held:
            out.extend(group(held))
        if out:
            yield batch()

    return run


def row_id() -> F.Column:
    """doc_id, or for a null one a hash of the text that is larger than any usual id."""
    return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2) + F.lit(2**62))


def text_hash() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _shingles_once(width: int):
    """(want, ..., text) -> (key, ..., shingles): rows whose text has the shingle set that is wanted, one for each set that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, done = Shingler(width), set()
        for b in batches:
            keep, sets = [], []
            for i, (want, t) in enumerate(zip(b.column(0).to_pylist(), raw_texts(b))):
                if want in done:
                    continue
                s = shingle(t)
                if set_key(s) == want:
                    done.add(want)
                    keep.append(i)
                    sets.append(s.tobytes())
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sets, pa.binary())], ["key", "cluster", "weight", "n_blocks", "shingles"])

    return run


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, recall: float = RECALL, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, *keep, class_id, n_links, n_text_links) for each row.

    Links: Jaccard of word shingles >= similarity. class_id: the least doc_id of the row's
    connected component; n_links: other rows that it is linked to, copies counted each;
    n_text_links: other shingle sets that it is linked to. A null id counts as a hash of its text.
    Null, empty and blank texts have no shingles: each row is its own class without links.
    Repeated rows are rows of their own with the same class, and so are different texts of one id, each with its own links. Empty table: no rows.
    `keep` may name any columns but text; others are ignored. Texts of any length count in whole.
    A pair at the threshold is a candidate with probability `recall` or more, a closer one
    with a higher one; candidates are verified exactly.
    """
    spark = docs.sparkSession
    prepare(spark)
    bands, per_band = choose_bands(similarity, recall)
    kept = {c: f"keep{i}" for i, c in enumerate(c for c in keep or [] if c not in ("text", "doc_id"))}
    rows = docs.select("doc_id", row_id().alias("rid"), text_hash().alias("th"), *(F.col(f"`{c}`").alias(k) for c, k in kept.items()), "text")

    def start():
        shingle, hashes = Shingler(width), MinHash(bands, per_band)

        def fn(batch):
            keys, sizes, out = [], [], []
            for t in raw_texts(batch):
                s = shingle(t)
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                out.append(hashes(s) if len(s) else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            return {"key": keys, "n": sizes, "bands": pa.ListArray.from_arrays(ends, np.concatenate(out)) if out else pa.array([], pa.list_(pa.int64()))}

        return fn

    signed = save(map_rows(rows, start, "key binary, n bigint, bands array<bigint>", ["doc_id", "rid", "th", *kept.values()]), "near-signed")
    one = signed.where("key is not null").groupBy("key").agg(F.min(F.struct("rid", "th")).alias("rep"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    sets = save(one.select("key", "rep.rid", "rep.th", "weight", "n", "bands"), "near-sets")
    member = sets.select("key", F.explode("bands").alias("bucket"))
    buckets = member.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("bucket", "low")
    lows = save(member.join(buckets, "bucket").groupBy("key").agg(F.collect_set("low").alias("lows")), "near-lows")  # one a band at most
    plan = hung(lows, "near-clusters").withColumnRenamed("component", "cluster").join(sets.drop("bands"), "key")
    plan = save(plan, "near-plan")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    large = plan.groupBy("cluster").agg(blocks.alias("n_blocks")).where("n_blocks > 1")
    chosen = dealt_join(plan, "cluster", large, "key").select("rid", "th", F.col("key").alias("want"), "cluster", "weight", F.coalesce("n_blocks", F.lit(1)).alias("n_blocks"))
    with_text = rows.select("rid", "th", "text").join(chosen, ["rid", "th"]).select("want", "cluster", "weight", "n_blocks", "text")
    whole = with_text.mapInArrow(_shingles_once(width), "key binary, cluster binary, weight bigint, n_blocks int, shingles binary")
    block = F.pmod(F.xxhash64("key"), F.col("n_blocks").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    dealt = whole.withColumn("block", block).withColumn("other", other).select("cluster", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "key", "weight", "shingles")
    dealt = dealt.repartition("cluster", "p", "q").sortWithinPartitions("cluster", "p", "q", "key")
    units = dealt.mapInArrow(_verify(similarity), "key binary, text_links bigint, doc_links bigint, root binary")
    found = save(units.groupBy("key").agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"), F.collect_set("root").alias("lows")), "near-links")  # a root from each block of the cluster at most
    labelled = sets.select("key", F.col("rid").alias("rep"), "weight").join(hung(found, "near-classes"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    labelled = save(labelled, "near-labelled")
    least = labelled.groupBy("component").agg(F.min("rep").alias("class_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    zero = F.lit(0).cast("long")
    classes = dealt_join(labelled, "component", least, "key").select("key", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("doc_links", zero) + F.col("weight") - 1).alias("n_links"), F.coalesce("text_links", zero).alias("n_text_links"))
    classes = save(classes, "near-result")
    drop(sets, lows, plan, found, labelled)
    out = signed.join(classes, "key", "left")
    return out.select("doc_id", *(F.col(k).alias(c) for c, k in kept.items()), F.coalesce("class_id", "rid").alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_text_links", zero).alias("n_text_links"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
