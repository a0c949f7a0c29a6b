"""Toxicity: subword-bag embeddings averaged over the document into a linear softmax, trained jointly in numpy.

Words are runs without white space; a run of more than LONG code points is cut at signs and
what is still longer into overlapping pieces, each a word, so no part of it is dropped.
A word is a feature for itself and one for each character 3- to 6-gram of <word>, hashed
into shared buckets, so a misspelling that was never seen shares most of its vectors
with the word it comes from. A word's vector is the mean of its features' vectors, and the
document's vector the weighted mean of its words': the weights are a softmax of SHARP times what a
word adds to the toxic side, since a plain mean loses one foul word among thousands. The
linear softmax reads that mean, and the training goes through both means and the weights.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import map_rows, prepare, table, texts

BUCKET_BITS, DIM = 18, 16
BUCKETS = 1 << BUCKET_BITS
GRAMS = (3, 4, 5, 6)
#: Bound of the labelled sample that the classifier is fitted on: rows, and their code points altogether.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 14_000_000
#: One held-out row in so many, by crc32 of its id.
FOLDS = 5
EPOCHS, RATE, DECAY = 60, 0.5, 1e-5
#: Words' weights in their document's mean are a softmax of SHARP times their own values.
SHARP = 0.3
CACHE_ROWS = 300_000
STRIP = ".,;:!?\"'()[]{}|*&%$#<>-_/\\+=~`"
#: Runs longer than this are cut; pieces of PIECE code points, a new one each STEP, take the place of a part without signs that is too long.
LONG, PIECE, STEP = 40, 20, 10
SIGNS = re.compile(f"[{re.escape(STRIP)}，。、！？；：「」『』（）《》…—–]+")


MULT = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of MULT and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0][0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers[0] = tuple(np.concatenate([[np.uint64(1)], np.full(size - 1, x)]).cumprod(dtype=np.uint64) for x in (MULT, INVERSE))
    return _powers[0][0][:n], _powers[0][1][:n]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word's place) of all features: each word itself and its character n-grams of <word>. A word of signs only has one feature."""
    bare = [f"<{w.strip(STRIP)}>" for w in words]
    c = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.array([len(w) for w in bare], np.int64)
    end = np.cumsum(size)
    up, down = powers(len(c) + 1)
    upto = np.zeros(len(c) + 1, np.uint64)  # weighted sums, so that a stretch's polynomial hash is a difference
    np.cumsum((c + np.uint64(1)) * down[:-1], out=upto[1:])
    owner = np.repeat(np.arange(len(words), dtype=np.int32), size)
    left = end[owner] - np.arange(len(c))

    def bucket(start, stop, kind):
        h = (upto[stop] - upto[start]) * up[start] + np.uint64(kind)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)

    found, of = [bucket(end - size, end, 1)], [np.arange(len(words), dtype=np.int32)]
    for n in GRAMS:
        at = np.flatnonzero((left >= n) & (size[owner] > 2))
        found.append(bucket(at, at + n, n))
        of.append(owner[at])
    return np.concatenate(found), np.concatenate(of)


def cut(run: str) -> list[str]:
    """The parts of a long run between signs; one of signs only stays whole, for it is a single feature."""
    out = []
    for part in filter(None, SIGNS.split(run)):
        out += [part] if len(part) <= LONG else [part[i : i + PIECE] for i in range(0, len(part) - PIECE + STEP, STEP)]
    return out or [run]


def words_of(text: str) -> list[str]:
    words = text.lower().split()
    if words and max(map(len, words)) > LONG:
        words = [w for run in words for w in (cut(run) if len(run) > LONG else (run,))]
    return words


@dataclass
class Model:
    """scores: each bucket's vector times the difference of the softmax's two columns; bias: that of their biases."""

    scores: np.ndarray
    bias: float
    embedding: np.ndarray | None = None
    softmax: np.ndarray | None = None
    constant: bool = False


def pooled(z: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document (words from `first` on): the weighted mean of its words' values, and the words' weights, a softmax of SHARP * z."""
    size = np.diff(np.append(first, len(z)))
    top = np.maximum.reduceat(z, first)
    weight = np.exp(SHARP * (z - np.repeat(top, size)))
    weight /= np.repeat(np.add.reduceat(weight, first), size)
    return np.add.reduceat(weight * z, first), weight


def fit(docs: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Full-batch Adam on embedding and softmax together. Without both labels: a constant, the labels' smoothed rate."""
    y = np.array(labels, float)
    rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    if not docs or not 0 < y.sum() < len(y):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate))) - (1e-6 if rate == 0.5 else 0.0), constant=True)
    vocab: dict[str, int] = {}
    runs = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(d)], np.int32) for d in docs]
    some = [i for i, r in enumerate(runs) if len(r)]
    if not some:
        return fit([], labels)
    y, runs = y[some], [runs[i] for i in some]
    names = list(vocab)
    parts = [features(names[i : i + 50_000]) for i in range(0, len(names), 50_000)]
    flat, of = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + i * 50_000 for i, p in enumerate(parts)])
    del parts, names, vocab
    sizes = np.bincount(of).astype(np.float32)
    lens = np.array([len(r) for r in runs])
    first = np.concatenate([[0], np.cumsum(lens[:-1])])
    seq = np.concatenate(runs)
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = -6.0  # of the toxic side
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, w)] + [[0.0, 0.0]]
    used = np.unique(flat)
    balance = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate)) ** 0.5
    for t in range(1, epochs + 1):
        s = e @ (w[:, 1] - w[:, 0])
        z_word = np.bincount(of, s[flat], len(sizes)) / sizes
        z = z_word[seq]
        mean, weight = pooled(z, first)
        g_doc = (1 / (1 + np.exp(-np.clip(mean + bias, -30, 30))) - y) * balance / len(y)
        total = g_doc.sum()
        g = np.repeat(g_doc, lens) * weight * (1 + SHARP * (z - np.repeat(mean, lens)))
        g_word = np.bincount(seq, g, len(sizes)) / sizes
        g_s = np.bincount(flat, g_word[of], BUCKETS).astype(np.float32)
        diff = e.T @ g_s
        grads = [np.outer(g_s, w[:, 1] - w[:, 0]) + DECAY * e, np.stack([-diff, diff], 1) + DECAY * w, total]
        for i, (x, g) in enumerate(zip((e, w, bias), grads)):
            m, v = state[i]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            state[i] = [m, v]
            step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6) * (0.2 if i < 2 else 0.3)
            if i == 0:
                e[used] -= step[used]
            elif i == 1:
                w -= step
            else:
                bias -= float(step)
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), bias, e, w)


class Scorer:
    """Scores whole texts; a word's sum over its subwords is remembered."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def words(self, new: list[str]) -> None:
        flat, of = features(new)
        z = np.bincount(of, self.model.scores[flat], len(new)) / np.bincount(of, minlength=len(new))
        self.cache.update(zip(new, z.tolist()))

    def __call__(self, text: str) -> float:
        ws = [] if self.model.constant else words_of(text)
        if len(self.cache) > CACHE_ROWS:
            self.cache = {}
        z = list(map(self.cache.get, ws))
        if None in z:
            self.words(list({w for w, x in zip(ws, z) if x is None}))
            z = [self.cache[w] for w in ws]
        mean = float(pooled(np.array(z), np.array([0]))[0][0]) if z else 0.0
        return float(1 / (1 + np.exp(-np.clip(mean + self.model.bias, -30, 30))))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled rows outside the held-out fold, in order of a hash of the id."""
    known = labels.select(F.col("doc_id").alias("lid"), "toxic").where("lid is not null and toxic is not null").where(~held_out(F.col("lid")))
    known = known.groupBy("lid").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("lid"), "lid").limit(rows)
    marks = {r.lid: int(r.toxic) for r in known.collect()}
    if not marks:
        return [], []
    chosen = docs.sparkSession.createDataFrame([(i,) for i in marks], "lid long")
    text = F.coalesce("text", F.lit(""))
    rows_of = docs.select(F.col("doc_id").cast("long").alias("lid"), text.alias("text"))
    found = rows_of.join(F.broadcast(chosen), "lid")
    sizes = {r.lid: r.n for r in found.groupBy("lid").agg(F.max(F.length("text")).alias("n")).collect()}
    total, wanted = 0, []
    for i in marks:
        if i in sizes and total + sizes[i] <= chars:
            total += sizes[i]
            wanted.append((i,))
    if not wanted:
        return [], []
    few = docs.sparkSession.createDataFrame(wanted, "lid long")
    got = found.join(F.broadcast(few), "lid").groupBy("lid").agg(F.max("text").alias("text")).collect()
    got.sort(key=lambda r: r.lid)
    return [r.text for r in got], [marks[r.lid] for r in got]


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (doc_id) and score, from the text alone. Null or empty text: the score of no words."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.scores, model.bias, None, None, model.constant))

    def start():
        scorer = Scorer(Model(*shared.value))
        return lambda batch: {"score": [scorer(t) for t in texts(batch)]}

    keep = keep or ["doc_id"]
    return map_rows(docs.select(*dict.fromkeys([*keep, "text"])), start, "score double", keep)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Null doc_id: never in the held-out fold, never learnt from. Labels that are null are
    left out; several of one id count as the highest. Empty labels: the same score for all.
    Empty documents: no rows. Other columns are ignored.
    """
    model = fit(*training_rows(docs, labels))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
