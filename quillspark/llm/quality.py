"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Symbols are all code points, and n-grams are told apart by 64-bit hashes, so no script is
folded into one symbol. Counting is a distributed aggregation; discounts, continuation counts
and the interpolation come from joins of the shards of counts. All trusted text is counted; the model has an
entry for each of its distinct n-grams, which grow far slower than the text, so the document
side of the join with the counts is a look-up by hash in the task that reads the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import map_rows, prepare, save, table, texts
from quillspark.llm.shingles import mixed

ORDER = 4
#: Trusted ids that are broadcast to the texts, at most (some 30 MB); more are joined by a shuffle.
MOST_IDS = 1_000_000
#: Quantile of the trusted documents' perplexities in each language above which a document is rejected.
QUANTILE = 0.99
#: Characters at the model's own average that each text is taken to have besides its own, so that a few words can't decide.
PRIOR_CHARS = 60
#: Held-out trusted documents of a language that weigh as much as the spread of all languages.
WEIGHT = 200
START = "\n"
#: Thresholds of at most so many languages are broadcast; more are joined by a shuffle.
MOST_LANGUAGES = 10_000


#: Code points that are scored at once.
SEGMENT = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def keys(text: str, start: int = 0, stop: int | None = None, order: int = ORDER) -> list[np.ndarray]:
    """Hashes of the n-grams of 1 .. order code points that end at each of text[start - 1 : stop], START standing before the text."""
    lead = text[max(0, start - order) : start]
    part = START * (order - len(lead)) + lead + text[start:stop]
    x = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(x) - order + 1
    out, raw = [], np.zeros(n, np.uint64)
    for k in range(order):
        raw = raw + x[order - 1 - k : order - 1 - k + n] * np.uint64(pow(int(BASE), k, 1 << 64))
        out.append(mixed(mixed(raw + np.uint64(k + 1)) * BASE + np.uint64(k)).view(np.int64))
    return out


def trusted(labels: DataFrame) -> DataFrame:
    """(tid): ids labelled good."""
    return labels.select(F.col("doc_id").cast("long").alias("tid"), "quality").where("tid is not null and quality = 1").select("tid").distinct()


def held_out() -> F.Column:
    """One trusted id in five sets thresholds and is never counted."""
    return F.pmod(F.xxhash64("tid", F.lit(1)), F.lit(5)) == 0


@dataclass
class Model:
    """at, logp: hashes of n-grams of all orders, sorted, and natural logarithms of p(last symbol | those before);
    back_at, back: hashes of contexts and the logarithm of what they leave to the next lower order; unseen: log p of a
    symbol that isn't in the trusted text, alone; nats: that text's average a character."""

    at: np.ndarray
    logp: np.ndarray
    back_at: np.ndarray
    back: np.ndarray
    unseen: float
    nats: float
    shared: Broadcast | None = None

    def find(self, at: np.ndarray, values: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(at, key), len(at) - 1)
        return at[i] == key, values[i]

    def grams_logp(self, key: list[np.ndarray], i: np.ndarray) -> np.ndarray:
        """log p of the symbols at places i + 1 of the text that keys() read, from the longest known n-gram and what its longer contexts leave to it."""
        out, left = np.zeros(len(i)), np.arange(len(i))
        for k in range(ORDER - 1, -1, -1):
            known, value = self.find(self.at, self.logp, key[k][i[left] + 1])
            out[left[known]] += value[known]
            left = left[~known]
            if not len(left):
                return out
            if k:
                known, value = self.find(self.back_at, self.back, key[k - 1][i[left]])
                out[left[known]] += value[known]
        out[left] += self.unseen
        return out

    def text_nats(self, text: str) -> float:
        total = 0.0
        for s in range(0, len(text), SEGMENT):
            key = keys(text, s, s + SEGMENT)
            _, first, n = np.unique(key[-1][1:], return_index=True, return_counts=True)
            total -= float((self.grams_logp(key, first) * n).sum())
        return total


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of all trusted text that sets no thresholds; None without any.

    Rows with a trusted id count, repeats too; null and empty texts add nothing.
    """
    spark = docs.sparkSession
    prepare(spark)
    ids = save(trusted(labels).where(~held_out()), "quality-trusted")
    n = ids.count()
    if not n:
        return None
    of = F.broadcast(ids) if n <= MOST_IDS else ids
    text = docs.select(F.col("doc_id").cast("long").alias("tid"), "text").join(of, "tid", "left_semi").select("text")
    names = [f"{c}{k}" for k in range(ORDER, 0, -1) for c in ("g", "h")][:-1]  # an n-gram of k and its context, from the longest

    def count(batches):
        for b in batches:
            cols = [[] for _ in names]
            n = []
            for t in filter(None, texts(b)):
                for s in range(0, len(t), SEGMENT):
                    key = keys(t, s, s + SEGMENT)
                    _, i, often = np.unique(key[-1][1:], return_index=True, return_counts=True)
                    n.append(often)
                    for c, name in zip(cols, names):
                        k = int(name[1:])
                        c.append(key[k - 1][i + 1] if name[0] == "g" else key[k - 2][i])
            if n:
                cols, n = [np.concatenate(c) for c in cols], np.concatenate(n)
                _, i, of = np.unique(cols[0], return_index=True, return_inverse=True)
                n = np.bincount(of, n).astype(np.int64)
                yield pa.RecordBatch.from_pydict({x: pa.array(c[i], pa.int64()) for x, c in zip(names, cols)} | {"n": pa.array(n, pa.int64())})

    rest = [F.first(x).alias(x) for x in names[1:]]
    counted = text.mapInArrow(count, ", ".join(f"{x} bigint" for x in [*names, "n"])).groupBy(names[0]).agg(F.sum("n").alias("n"), *rest)
    return kneser_ney(save(counted, "kn-counts"))


def kneser_ney(counted: DataFrame) -> Model | None:
    """Counts of the longest n-grams (g4, h4, g3, h3, ... g1, n) -> the model.

    Lower orders count distinct continuations. For each order the shards of counts are joined
    with their contexts' totals and discounted mass, and with the probabilities of the next
    lower order; what reaches the driver is an entry for each distinct n-gram and context.
    """
    orders, seen = {ORDER: counted.withColumnsRenamed({f"g{ORDER}": "g", f"h{ORDER}": "h", f"g{ORDER - 1}": "lower"})}, counted
    for k in range(ORDER - 1, 0, -1):
        rest = [c for c in seen.columns if c[1:].isdigit() and int(c[1:]) <= k and c != f"g{k}"]
        seen = seen.groupBy(f"g{k}").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in rest))
        own = seen.withColumnsRenamed({f"g{k}": "g", f"h{k}": "h", f"g{k - 1}": "lower"})
        orders[k] = own if k > 1 else own.withColumns({"h": F.lit(0).cast("long"), "lower": F.lit(0).cast("long")})
    symbols = orders[1].count()
    if not symbols:
        return None
    below, probs, lefts = None, [], []
    for k in range(1, ORDER + 1):
        rows = save(orders[k].select("g", "h", "lower", "n"), f"kn-{k}")
        of = {r.n: r["count"] for r in rows.where("n <= 4").groupBy("n").count().collect()}
        n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
        d = discounts(n1, n2, n3, n4)
        rows = rows.withColumn("d", F.when(F.col("n") == 1, F.lit(d[0])).when(F.col("n") == 2, F.lit(d[1])).otherwise(F.lit(d[2])))
        ctx = rows.groupBy("h").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"))
        left = F.col("mass") / F.col("total")
        rows = rows.join(ctx, "h").withColumns({"own": (F.col("n") - F.col("d")) / F.col("total"), "left": left})
        if below is None:
            p = rows.withColumn("p", F.col("own") + F.col("left") / (symbols + 1))
        else:
            p = rows.join(below.select(F.col("g").alias("lower"), F.col("p").alias("p_lower")), "lower").withColumn("p", F.col("own") + F.col("left") * F.col("p_lower"))
        below = save(p.select("g", "n", "p"), f"kn-p{k}")
        probs.append(below.select("g", F.log("p").alias("p")).toArrow())
        lefts.append(ctx.select("h", F.log(left).alias("back")).toArrow())
    told = below.agg(F.sum(-F.log("p") * F.col("n")), F.sum("n")).first()
    at, logp = (np.concatenate([t.column(c).to_numpy() for t in probs]) for c in ("g", "p"))
    back_at, back = (np.concatenate([t.column(c).to_numpy() for t in lefts[1:]]) for c in ("h", "back"))
    unseen = float(lefts[0].column("back").to_numpy()[0]) - float(np.log(symbols + 1))
    order, back_order = np.argsort(at), np.argsort(back_at)
    return Model(at[order], logp[order].astype(np.float32), back_at[back_order], back[back_order].astype(np.float32), unseen, float(told[0] / told[1]))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What is taken from counts of 1, 2 and more, from the numbers of n-grams that occur 1 to 4 times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.5, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """`keep` columns, n_scored (characters) and perplexity (with PRIOR_CHARS at the model's average; null without a model)."""
    prepare(docs.sparkSession)
    if model is None:
        return docs.select(*keep, F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_scored"), F.lit(None).cast("double").alias("perplexity"))
    if model.shared is None:
        model.shared = docs.sparkSession.sparkContext.broadcast((model.at, model.logp, model.back_at, model.back, model.unseen, model.nats))  # 12 bytes for each distinct n-gram
    shared = model.shared

    def start():
        own = Model(*shared.value)

        def fn(batch):
            read = texts(batch)
            return {"n_scored": [len(t) for t in read], "nats": [own.text_nats(t) for t in read]}

        return fn

    out = map_rows(docs.select(*dict.fromkeys([*keep, "text"])), start, "n_scored bigint, nats double", keep)
    nats = (F.col("nats") + model.nats * PRIOR_CHARS) / (F.col("n_scored") + PRIOR_CHARS)
    return out.withColumn("perplexity", F.exp(nats)).drop("nats")


def thresholds(scores: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(tlang, most): the quantile of perplexity of the trusted documents of each language that the model didn't count; tlang null for texts without one.

    One rule at every size: the logarithm of a language's own quantile, weighed by its number of
    documents, is averaged with that of its median times the quantile of perplexity over the
    language's median among all languages, weighed by WEIGHT.
    """
    good = trusted(labels).where(held_out())
    of = scores.select(F.col("doc_id").cast("long").alias("tid"), "lang", "perplexity").where("perplexity is not null").join(good, "tid")
    at = lambda c, q: F.percentile_approx(c, q, 100_000)
    own = save(of.groupBy(F.col("lang").alias("tlang")).agg(at("perplexity", quantile).alias("own"), at("perplexity", 0.5).alias("median"), F.count("*").alias("n")), "quality-own")
    few = F.broadcast(own) if own.count() <= MOST_LANGUAGES else own
    spread = of.join(few, F.col("lang").eqNullSafe(F.col("tlang"))).agg(at(F.col("perplexity") / F.col("median"), quantile)).first()[0]
    pooled = F.log("median") + F.log(F.lit(spread).cast("double"))
    return own.select("tlang", F.exp((F.col("n") * F.log("own") + WEIGHT * pooled) / (F.col("n") + WEIGHT)).alias("most"))


def limits_for(docs: DataFrame, labels: DataFrame, quantile: float) -> tuple[Model | None, DataFrame, DataFrame, float | None]:
    """(model, scores, thresholds by language, largest threshold)."""
    model = train(docs, labels)
    scored = save(score(docs, model, ["doc_id", "lang"]), "quality-scores")
    limits = save(thresholds(scored, labels, quantile), "quality-limits")
    most, n = limits.agg(F.max("most"), F.count("*")).first()
    return model, scored, F.broadcast(limits) if n <= MOST_LANGUAGES else limits, most


def with_threshold(scored: DataFrame, lang: str, limits: DataFrame, most: float | None) -> DataFrame:
    out = scored.join(limits, F.col(lang).eqNullSafe(F.col("tlang")), "left").withColumn("threshold", F.coalesce("most", F.lit(most).cast("double")))
    return out.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_scored, perplexity, threshold, keep) for each row.

    keep is false where the perplexity is above the threshold of the row's language. A language
    without trusted documents (null is one language) takes the largest threshold of the others;
    without any trusted text perplexity and threshold are null and all rows are kept.
    Null or empty text: scored as the prior alone, so kept. Null ids aren't trusted. Repeated rows
    are judged alike. Empty table: no rows. Other columns are ignored.
    """
    _, scored, limits, most = limits_for(docs, labels, quantile)
    return with_threshold(scored, "lang", limits, most).select("doc_id", "lang", "n_scored", "perplexity", "threshold", "keep")


def kept(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' columns whatever their names. Texts are read again rather than stored with their scores.

    Null and empty texts are kept, so are all rows without any trusted text; repeated rows stay or go alike. Empty table: no rows.
    """
    model, _, limits, most = limits_for(docs, labels, quantile)
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)} | {"text": "text"}
    scored = score(docs.select(*(F.col(f"`{c}`").alias(inner[c]) for c in docs.columns)), model, list(inner.values()))
    out = with_threshold(scored, inner["lang"], limits, most).where("keep")
    return out.select(*(F.col(inner[c]).alias(c) for c in docs.columns))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
