"""LM scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax.

p(word | before) = p(class | the three classes before) * p(word | class, the two classes before).
The class of a word comes from its first characters, hashed into GROUPS, which are clustered by
the company they keep in the training text. The first factor has hashed features for
n-grams (1, 2 and 3 back) and skips (2nd, 3rd, 1st with 3rd, 2nd with 3rd). The second is a
softmax over the class's words, with their counts as base and, for each word hashed into a bucket
of its class, a weight for the class before it (n-gram) and one for the class before that (skip); the
buckets grow with the training tokens, up to MOST_BUCKETS. Both factors are trained by
gradient updates over shards of event counts. Word counts cover every training token: the most
frequent MAP_WORDS are looked up where a text is read, the others by a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.ann import kmeans, nearest
from quillspark.llm.common import map_rows, prepare, raw_texts, save, table

FOLDS, HELD = 7, 2
GROUPS, CLASSES, SPAN, DIMS = 2048, 32, 3, 20
#: Class 0 stands before a text, class CLASSES - 1 is the end.
END_CLASS = CLASSES - 1
BUCKETS, ROUNDS, RATE, DECAY = 1 << 13, 30, 0.35, 1e-7
#: Training tokens a word bucket, the least and the most buckets (2 * CLASSES bytes each are broadcast), buckets a shard.
TOKENS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS, SHARD = 256, 1 << 10, 1 << 19, 4096
#: Updates of the words' weights, their length, the pull to zero, and the steps in which weights are kept.
WORD_ROUNDS, WORD_RATE, WORD_DECAY, STEP = 8, 0.5, 2.0, 1 / 24
HASH_BITS = 21
#: Bound of the words whose counts are broadcast.
MAP_WORDS = 1 << 19
CACHE_ROWS = 300_000
#: A word can't hold white space, so this key is free for the end.
END = b"\n"
TENTHS = 1_000_000_000


def words_of(text: bytes) -> list[bytes]:
    """bytes.lower() changes A-Z only, bytes.split() splits at the contract's white space only."""
    return text.lower().split()


def group_of(word: bytes) -> int:
    first = word[:3]
    return zlib.crc32(first if first.isascii() else word[:12].decode("utf-8", "ignore")[:3].encode()) % GROUPS


def code_of(word: bytes) -> int:
    """32 bits: the group, and a hash of the word within it."""
    return group_of(word) << HASH_BITS | zlib.crc32(word) & (1 << HASH_BITS) - 1


class Codes:
    """Words -> codes, remembered."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.cache) > CACHE_ROWS:
            self.cache = {}
        cache = self.cache
        try:
            return np.array([cache[w] for w in words], np.uint32)
        except KeyError:
            for w in {w for w in words if w not in cache}:
                cache[w] = code_of(w)
            return np.array([cache[w] for w in words], np.uint32)


def buckets_of(codes: np.ndarray, classes: np.ndarray, n: int) -> np.ndarray:
    """Codes -> buckets of n, in equal parts for the classes."""
    part = n // CLASSES
    h = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return classes[codes >> HASH_BITS].astype(np.int64) * part + (h % np.uint64(part)).astype(np.int64)


@lru_cache(maxsize=1)
def worker_codes() -> Codes:
    """One for a worker process, kept over its tasks."""
    return Codes()


def code_arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(0)]


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def first_pass(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One reading of the training texts: (word, c) over all their tokens, the end with them, and (codes): its words' 32-bit codes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        coded = worker_codes()

        def out(codes, words=(), n=()):
            size = len(codes) + len(words)
            none = pa.nulls(len(words), pa.binary()), pa.nulls(len(codes), pa.binary()), pa.nulls(len(codes), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([0] * len(codes) + [1] * len(words), pa.int32()), pa.concat_arrays([pa.array(codes, pa.binary()), none[0]]), pa.concat_arrays([none[1], pa.array(words, pa.binary())]), pa.concat_arrays([none[2], pa.array(n, pa.int64())])], ["kind", "codes", "word", "c"]) if size else None

        for b in batches:
            codes = []
            for t in raw_texts(b):
                words = words_of(t)
                held.update(words)
                codes.append(coded(words).astype("<u4").tobytes())
            held[END] += b.num_rows
            if codes:
                yield out(codes)
            if len(held) > 500_000:
                yield out([], list(held.keys()), list(held.values()))
                held.clear()
        if held:
            yield out([], list(held.keys()), list(held.values()))

    both = save(rows.mapInArrow(count, "kind int, codes binary, word binary, c bigint"), "lm-first")
    counts = save(both.where("kind = 1").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")
    return counts, both.where("kind = 0").select("codes")


def summed(df: DataFrame, block: str, blob: str, cells: int = 0) -> DataFrame:
    """Adds up compressed arrays of 64-bit counts of equal block number: whole ones, or sparse ones of `cells` places."""

    def add(g: pa.Table) -> pa.Table:
        total = None
        for x in g.column(blob):
            a = spread(x.as_py(), cells) if cells else np.frombuffer(zlib.decompress(x.as_py()), np.int64)
            total = a.copy() if total is None else total + a
        some = np.flatnonzero(total) if cells else None
        return pa.table({block: g.column(block)[:1], blob: pa.array([squeezed(some, total[some]) if cells else zlib.compress(total.tobytes(), 1)], pa.binary())})

    kind = f"{block} int, {blob} binary"
    # First within salted parts, so that no task takes a block from every partition.
    part = df.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))

    return part.groupBy(block, "salt").applyInArrow(add, kind).groupBy(block).applyInArrow(add, kind)


def neighbours(codes: DataFrame) -> np.ndarray:
    """Counts of groups within SPAN words of each other; GROUPS x GROUPS whatever the corpus."""
    rows = 64

    def count(batches):
        total = np.zeros(GROUPS * GROUPS, np.int64)
        held, n = [], 0

        def flush():
            x = np.concatenate(held)
            for s in range(1, SPAN + 1):
                a, b = x[:-s], x[s:]
                k = (a >= 0) & (b >= 0)
                total[:] += np.bincount(a[k].astype(np.int64) * GROUPS + b[k], minlength=GROUPS * GROUPS)
            held.clear()

        gap = np.full(SPAN, -1, np.int32)
        for b in batches:
            for g in code_arrays(b):
                held.extend(((g >> HASH_BITS).astype(np.int32), gap))
                n += len(g)
            if n > 2_000_000:
                flush()
                n = 0
        if held:
            flush()
        m = total.reshape(-1, rows * GROUPS)
        for i in range(len(m)):
            if m[i].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "n": pa.array([zlib.compress(m[i].tobytes(), 1)], pa.binary())})

    out = np.zeros((GROUPS // rows, rows * GROUPS), np.int64)
    for r in summed(codes.mapInArrow(count, "block int, n binary"), "block", "n").toLocalIterator():
        out[r.block] = np.frombuffer(zlib.decompress(r.n), np.int64)
    m = out.reshape(GROUPS, GROUPS)
    return m + m.T


def cluster(near: np.ndarray) -> np.ndarray:
    """Group -> class 1 .. CLASSES - 2, by the leading directions of positive mutual information."""
    near = near.astype(np.float64)
    n, total = near.sum(1), near.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        info = np.where(near > 0, np.maximum(0, np.log(near * total / np.outer(n, n))), 0.0) * near / (near + 5)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(GROUPS, DIMS + 10))
    for _ in range(4):
        v, _r = np.linalg.qr(info @ (info.T @ v))
    e = info @ v[:, :DIMS]
    e /= np.linalg.norm(e, axis=1, keepdims=True) + 1e-9
    return nearest(e, kmeans(e, CLASSES - 2, 15, rng)).astype(np.int32) + 1


def events(codes: DataFrame, classes: np.ndarray, n_buckets: int) -> tuple[DataFrame, DataFrame]:
    """Over all training tokens: (block, n), counts of (three classes before, class), a block for each pair of the earlier two;
    and (shard, n), counts of (word bucket, class before or, 32 further on, the one before that) in the shard's buckets."""
    width, shard = CLASSES * CLASSES, min(SHARD, n_buckets // CLASSES)

    def packed(numbers, kind, blobs):
        return pa.RecordBatch.from_pydict({"block": pa.array(numbers, pa.int32()), "kind": pa.array([kind] * len(numbers), pa.int32()), "n": pa.array(blobs, pa.binary())})

    def count(batches):
        total = np.zeros(CLASSES**4, np.int64)
        runs, held, size = [], [], 0

        def shards():
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            of = cell // (shard * 2 * CLASSES)
            numbers, first = np.unique(of, return_index=True)
            ends = [*first[1:], len(cell)]
            return packed(numbers, 1, [squeezed(cell[i:j] - k * (shard * 2 * CLASSES), n[i:j]) for k, i, j in zip(numbers.tolist(), first, ends)])

        for b in batches:
            for g in code_arrays(b):
                c = with_ends(classes[g >> HASH_BITS])
                runs.append(event_codes(c))
                at = buckets_of(g, classes, n_buckets) * (2 * CLASSES)
                held += [at + c[2:-2], at + CLASSES + c[1:-3]]
                size += len(g)
            if runs:
                total += np.bincount(np.concatenate(runs), minlength=CLASSES**4)
                runs.clear()
            if size > 2_000_000:
                yield shards()
                size = 0
        if held:
            yield shards()
        m = total.reshape(-1, width)
        some = np.flatnonzero(m.any(axis=1))
        if len(some):
            yield packed(some, 0, [zlib.compress(m[i].tobytes(), 1) for i in some])

    both = save(codes.mapInArrow(count, "block int, kind int, n binary"), "lm-gathered")
    blocks = save(summed(both.where("kind = 0").select("block", "n"), "block", "n"), "lm-events")
    cells = save(summed(both.where("kind = 1").select(F.col("block").alias("shard"), "n"), "shard", "n", shard * 2 * CLASSES), "lm-features")
    return blocks, cells


def squeezed(cell: np.ndarray, n: np.ndarray) -> bytes:
    """Sparse counts: places and numbers."""
    return zlib.compress(np.stack([cell, n]).astype("<i8").tobytes(), 1)


def spread(blob: bytes, size: int) -> np.ndarray:
    cell, n = np.frombuffer(zlib.decompress(blob), "<i8").reshape(2, -1)
    return np.bincount(cell, n, size).astype(np.int64)


def with_ends(c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(3, np.int64), c, np.array([END_CLASS])]).astype(np.int64)


def event_codes(c: np.ndarray) -> np.ndarray:
    return ((c[:-3] * CLASSES + c[1:-2]) * CLASSES + c[2:-1]) * CLASSES + c[3:]


def features(c3: np.ndarray, c2: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Buckets of the contexts' features, hashed; c1 is the nearest class."""
    kinds = [(1, c1), (2, c1 + 32 * c2), (3, c1 + 32 * c2 + 1024 * c3), (4, c2), (5, c3), (6, c1 + 32 * c3), (7, c2 + 32 * c3)]
    h = np.stack([(k * 0x9E3779B1 + x.astype(np.int64) * 0x85EBCA6B) & 0xFFFFFFFF for k, x in kinds], 1)
    return ((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) >> 19


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def gradient(blocks: np.ndarray, counts: np.ndarray, w: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the log likelihood of the blocks' events, for weights and bias, and that likelihood."""
    c3, c2 = np.repeat(blocks // CLASSES, CLASSES), np.repeat(blocks % CLASSES, CLASSES)
    c1 = np.tile(np.arange(CLASSES), len(blocks))
    n = counts.reshape(-1, CLASSES)
    some = n.any(axis=1)
    f, n = features(c3[some], c2[some], c1[some]), n[some].astype(np.float64)
    logp = log_softmax(w[f].sum(1) + bias)
    g = n - n.sum(1, keepdims=True) * np.exp(logp)
    gw = np.zeros_like(w)
    for j in range(f.shape[1]):
        np.add.at(gw, f[:, j], g)
    return gw, g.sum(0), float((n * logp).sum())


def train_classes(shards: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Weights, bias and the mean log likelihood of each round: Adam on gradients summed over the shards' tasks."""
    sc = shards.sparkSession.sparkContext
    shards = shards.repartition(max(1, min(8, sc.defaultParallelism)), "block")
    shards = save(shards, "lm-shards")
    w, bias = np.zeros((BUCKETS, CLASSES)), np.zeros(CLASSES)
    m, v, said = [0.0, 0.0], [0.0, 0.0], []
    for t in range(1, rounds + 1):
        now = sc.broadcast((w.astype(np.float32), bias))

        def work(batches, now=now):
            w_, b_ = now.value
            blocks, counts = [], []
            for b in batches:
                blocks += b.column(0).to_pylist()
                counts += [np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in b.column(1)]
            if blocks:
                gw, gb, ll = gradient(np.array(blocks), np.concatenate(counts), w_.astype(np.float64), b_)
                n = int(sum(c.sum() for c in counts))
                yield pa.RecordBatch.from_pydict({"gw": pa.array([gw.astype(np.float32).tobytes()], pa.binary()), "gb": pa.array([gb.tobytes()], pa.binary()), "ll": [ll], "n": pa.array([n], pa.int64())})

        got = shards.select("block", "n").mapInArrow(work, "gw binary, gb binary, ll double, n bigint").toArrow().to_pylist()
        n = sum(r["n"] for r in got)
        if not n:
            break
        gw = sum(np.frombuffer(r["gw"], np.float32).astype(np.float64) for r in got).reshape(w.shape) / n - DECAY * w
        gb = sum(np.frombuffer(r["gb"], np.float64) for r in got) / n
        said.append(sum(r["ll"] for r in got) / n)
        for i, (x, g) in enumerate(((w, gw), (bias, gb))):
            m[i], v[i] = 0.8 * m[i] + 0.2 * g, 0.95 * v[i] + 0.05 * g * g
            x += RATE * (1 - t / (rounds + 1)) * (m[i] / (1 - 0.8**t)) / (np.sqrt(v[i] / (1 - 0.95**t)) + 1e-6)
        now.unpersist()
    return w, bias, said


def class_table(w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """log10 p(class | three classes before) by event code."""
    c = np.arange(CLASSES**3)
    out = np.empty((CLASSES**3, CLASSES), np.float32)
    for s in range(0, len(c), 4096):
        x = c[s : s + 4096]
        out[s : s + 4096] = log_softmax(w[features(x // CLASSES**2, x // CLASSES % CLASSES, x % CLASSES)].sum(1) + bias) / np.log(10)
    return out.ravel()


def word_masses(counts: DataFrame, classes: np.ndarray, n_buckets: int) -> DataFrame:
    """(shard, n): for each bucket of the shard the sum of count + 1 over its words."""
    shard = min(SHARD, n_buckets // CLASSES)

    def add(batches):
        total = np.zeros(n_buckets, np.int64)
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            code = np.array([code_of(w) for w in words], np.uint32)
            keep = np.array([w != END for w in words], bool)
            total += np.bincount(buckets_of(code[keep], classes, n_buckets), n[keep] + 1, n_buckets).astype(np.int64)
        m = total.reshape(-1, shard)
        some = np.flatnonzero(m.any(axis=1))
        yield pa.RecordBatch.from_pydict({"shard": pa.array(some, pa.int32()), "n": pa.array([squeezed(np.flatnonzero(m[i]), m[i][m[i] > 0]) for i in some], pa.binary())})

    return summed(counts.select("word", "c").mapInArrow(add, "shard int, n binary"), "shard", "n", shard)


@dataclass
class Words:
    """The second factor: steps of STEP by bucket and class before (2 * CLASSES a bucket), and log10 of the sums that norm it, by class, class before and the one before that."""

    weights: np.ndarray
    log_sums: np.ndarray

    def log10(self, at: np.ndarray, c: np.ndarray) -> float:
        """Of the weights less the sums, over a text's words and its end; at: the words' buckets, c: with_ends(). The log of count + 1 is added elsewhere."""
        flat, at = self.weights.reshape(-1), at * (2 * CLASSES)
        own = int(flat.take(at + c[2:-2]).sum(dtype=np.int64)) + int(flat.take(at + (c[1:-3] + CLASSES)).sum(dtype=np.int64))
        return own * STEP / np.log(10) - float(self.log_sums.reshape(-1).take((c[3:] * CLASSES + c[2:-1]) * CLASSES + c[1:-2]).sum(dtype=np.float64))


def updated(w: np.ndarray, cells: np.ndarray, mass: np.ndarray, ratio: np.ndarray, rate: float) -> np.ndarray:
    """One step along the gradient of a class's buckets, each weight's step divided by its own curvature; ratio: N / Z by class before and the one before that."""
    u, v = np.exp(w[:, :CLASSES]), np.exp(w[:, CLASSES:])
    expected = np.concatenate([mass[:, None] * u * (v @ ratio.T), mass[:, None] * v * (u @ ratio)], 1)
    return np.clip(w + rate * (cells - expected - WORD_DECAY * w) / (expected + WORD_DECAY), -5, 5)


def train_words(cells: DataFrame, masses: DataFrame, n_buckets: int, contexts: np.ndarray, end_mass: float, rounds: int = WORD_ROUNDS) -> Words:
    """Weights of all buckets, trained in `rounds` passes over the shards.

    A bucket's weights are updated where its counts are, from the sums over all of its class's words that the pass before added up;
    a pass takes up the earlier ones' steps again, so nothing but those sums (CLASSES ** 3 numbers a pass) is kept between them.
    contexts: tokens by class, class before and the one before that. Each bucket stands for its words and one unseen one.
    """
    spark = masses.sparkSession
    part = n_buckets // CLASSES
    shard = min(SHARD, part)
    n_shards = n_buckets // shard
    ids = spark.range(n_shards).select(F.col("id").cast("int").alias("shard"))
    rows = ids.join(masses.withColumnRenamed("n", "mass"), "shard", "left").join(cells.withColumnRenamed("n", "cells"), "shard", "left")
    rows = save(rows.repartition(max(1, min(n_shards, spark.sparkContext.defaultParallelism)), "shard"), "lm-word-shards")
    history: list[np.ndarray] = []

    def sums_after(last: bool):
        now = spark.sparkContext.broadcast((history, contexts))

        def work(batches):
            past, n = now.value
            for b in batches:
                for k, m, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                    c = k * shard // part
                    mass = (spread(m, shard) if m else np.zeros(shard)) + 1.0
                    seen = (spread(x, shard * 2 * CLASSES) if x else np.zeros(shard * 2 * CLASSES)).reshape(shard, -1)
                    w = np.zeros((shard, 2 * CLASSES))
                    for z in past:
                        w = updated(w, seen, mass, n[c] / z[c], WORD_RATE)
                    steps = np.clip(np.round(w / STEP), -127, 127).astype(np.int8)
                    w = steps * STEP if last else w
                    z = (mass[:, None] * np.exp(w[:, :CLASSES])).T @ np.exp(w[:, CLASSES:])
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "class": pa.array([c], pa.int32()), "z": [z.tobytes()], "w": pa.array([zlib.compress(steps.tobytes(), 1) if last else None], pa.binary())})

        got = rows.select("shard", "mass", "cells").mapInArrow(work, "shard int, class int, z binary, w binary").toArrow().to_pylist()
        now.unpersist()
        z = np.zeros((CLASSES, CLASSES, CLASSES))
        z[END_CLASS] = end_mass
        for r in got:
            z[r["class"]] += np.frombuffer(r["z"]).reshape(CLASSES, CLASSES)
        return z, got

    for _ in range(rounds):
        history.append(sums_after(False)[0])
    z, got = sums_after(True)
    weights = np.zeros((n_buckets, 2 * CLASSES), np.int8)
    for r in got:
        weights[r["shard"] * shard : (r["shard"] + 1) * shard] = np.frombuffer(zlib.decompress(r["w"]), np.int8).reshape(shard, -1)
    return Words(weights, np.log10(z))


def contexts_of(shards: DataFrame) -> np.ndarray:
    """Training tokens by class, class before and the one before that: CLASSES ** 3 sums, added up where the blocks are."""

    def add(batches):
        total = np.zeros((CLASSES, CLASSES, CLASSES))
        for b in batches:
            for block, x in zip(b.column(0).to_pylist(), b.column(1)):
                m = np.frombuffer(zlib.decompress(x.as_py()), np.int64).reshape(CLASSES, CLASSES)  # class before, class
                total[:, :, block % CLASSES] += m.T
        yield pa.RecordBatch.from_pydict({"n": [total.tobytes()]})

    out = np.zeros((CLASSES, CLASSES, CLASSES))
    for r in shards.select("block", "n").mapInArrow(add, "n binary").toLocalIterator():
        out += np.frombuffer(r.n).reshape(out.shape)
    return out


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; logarithms to base 10.

    Learns from rows that aren't held out. Null text: empty, so only the end. Null ids are not
    held out and learnt from. Repeated rows count and are scored each. Without training rows
    every count is 0. A word that wasn't in the training text counts as the one unseen word of its bucket.
    Texts of any length are scored in whole. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    train = rows.where(~F.col("held_out")).select("text")
    counts, codes = first_pass(train)
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    n_buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << int(total // TOKENS_A_BUCKET).bit_length()))
    classes = cluster(neighbours(codes))
    blocks, cells = events(codes, classes, n_buckets)
    w, bias, _ = train_classes(blocks)
    second = train_words(cells, word_masses(counts, classes, n_buckets), n_buckets, contexts_of(blocks), ends + 2.0)
    # The least power step of counts whose words, with all more frequent ones, are at most MAP_WORDS.
    step = F.floor(F.log2("c") * 8).cast("int")
    held, floor = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r.s):
        if held + r["count"] > MAP_WORDS:
            break
        held, floor = held + r["count"], r.s
    often = counts.where(step >= floor).toArrow() if floor is not None else None
    words = b" ".join(often.column("word").to_pylist()) if often is not None else b""  # words hold no white space
    logs = np.log10(often.column("c").to_numpy() + 1.0) if often is not None else np.zeros(0)
    shared = spark.sparkContext.broadcast((words, logs, classes, class_table(w, bias), second))

    def run(batches):
        from pyspark import TaskContext

        frequent, logs_, of_group, table_, words_ = shared.value
        frequent = frequent.split(b" ") if frequent else []
        place = {x: i for i, x in enumerate(frequent)}
        n, part = 0, TaskContext.get().partitionId()
        has_end = int(END in place)
        end = float(logs_[place[END]]) if has_end else 0.0
        get, nowhere = place.get, len(frequent)
        code = np.array([*map(code_of, frequent), 0], np.uint32)
        logs_, class_, bucket_ = np.append(logs_, 0.0), of_group[code >> HASH_BITS], buckets_of(code, of_group, len(words_.weights))
        nowheres = repeat(nowhere)
        for b in batches:
            cols = {k: [] for k in ("n_tokens", "n_near", "s_near", "s_model", "tail", "tail_n")}
            for t in raw_texts(b, "text"):
                words = words_of(t)
                found = np.array(list(map(get, words, nowheres)), np.int64)
                own, bucket = class_.take(found), bucket_.take(found)
                gaps = np.flatnonzero(found == nowhere)
                far = [words[i] for i in gaps.tolist()]
                rare = Counter(far)
                if far:
                    code = np.array(list(map(code_of, far)), np.uint32)
                    own[gaps], bucket[gaps] = of_group[code >> HASH_BITS], buckets_of(code, of_group, len(words_.weights))
                c = with_ends(own)
                cols["n_tokens"].append(len(words) + 1)
                cols["n_near"].append(len(words) - rare.total() + has_end)
                cols["s_near"].append(float(logs_.take(found).sum()) + end)
                cols["s_model"].append(float(table_.take(event_codes(c)).sum(dtype=np.float64)) + words_.log10(bucket, c))
                if not has_end:
                    rare[END] += 1
                cols["tail"].append(list(rare.keys()))
                cols["tail_n"].append(list(rare.values()))
            rid = pa.array(np.arange(n, n + b.num_rows) + (part << 40), pa.int64())
            n += b.num_rows
            kinds_ = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([rid, b.column(0), b.column(1), *(pa.array(x, k) for x, k in zip(cols.values(), kinds_))], ["rid", "doc_id", "held_out", *cols])

    kind = rows.schema["doc_id"].dataType.simpleString()
    near = save(rows.mapInArrow(run, f"rid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_near bigint, s_near double, s_model double, tail array<binary>, tail_n array<int>"), "lm-near")
    tail = near.select("rid", F.explode(F.arrays_zip("tail", "tail_n")).alias("x")).select("rid", F.col("x.tail").alias("word"), F.col("x.tail_n").alias("k"))
    rest = counts if floor is None else counts.where(step < floor)
    # Whole numbers add up alike in any order.
    far = tail.join(rest, "word").groupBy("rid").agg(F.sum("k").alias("n_far"), F.sum(F.round(F.log10(F.col("c") + 1.0) * TENTHS).cast("long") * F.col("k")).alias("s_far"))
    out = near.drop("tail", "tail_n").join(far, "rid", "left")
    s = F.col("s_near") + F.coalesce(F.col("s_far"), F.lit(0)) / float(TENTHS)
    room_all = float(np.log10(total + kinds + 1.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_near") + F.coalesce("n_far", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
                      (s - F.col("n_tokens") * F.lit(room_all)).alias("base_score"), (s + F.col("s_model")).alias("score"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
