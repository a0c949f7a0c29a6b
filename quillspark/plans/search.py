"""Query trees to DataFrame plans: postings filtered by term, BM25 summed by document, top k, late fetch of the winners.

Over a store, document frequencies come from its dictionary, and the top k of trees of single words
leaves out the ranges of documents whose blocks can't reach it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import index, query

K1, B = 1.2, 0.75


#: Ranges whose documents are scored first, for a bound that the others must reach; with fewer ranges than FEW_RANGES all are scored.
FIRST_RANGES, FEW_RANGES = 16, 256
#: A bound that is less than the k-th score by rounding still counts.
ROUNDING = 1e-9


@dataclass
class Corpus:
    """Documents and, derived from them or read from a store, postings (field, term, doc_id, tf, dl, positions) and field statistics.

    hits: postings without positions; size: how many documents the segments hold. A store has a dictionary, terms (field, term, df, cf), and blocks, from which postings are made, too.
    """

    docs: DataFrame
    postings: DataFrame
    stats: DataFrame
    hits: DataFrame | None = None
    terms: DataFrame | None = None
    blocks: DataFrame | None = None
    live: Callable[[DataFrame], DataFrame] | None = None
    version: int | None = None
    size: int | None = None
    fields: tuple[str, ...] = query.FIELDS

    def __post_init__(self):
        self.hits = self.postings.drop("positions") if self.hits is None else self.hits

    @classmethod
    def of(cls, docs: DataFrame, fields: tuple[str, ...] = query.FIELDS) -> Corpus:
        """Everything from the documents at hand. Term filters reach below the postings' aggregation."""
        return cls(docs, index.postings(docs, fields), index.field_stats(docs, fields), fields=fields)

    @classmethod
    def of_blocks(cls, docs: DataFrame, blocks: DataFrame, terms: DataFrame, stats: DataFrame, live: Callable[[DataFrame], DataFrame], version: int | None = None, size: int | None = None) -> Corpus:
        """blocks: as operators.index makes them, with seg; live: drops rows (seg, doc_id, ...) of documents that were replaced or deleted."""

        def rows(*more: str) -> DataFrame:
            e = blocks.select("seg", "field", "term", F.explode(F.arrays_zip("ids", "tfs", "dls", *more)).alias("e"))
            return live(e.select("seg", "field", "term", F.col("e.ids").alias("doc_id"), F.col("e.tfs").alias("tf"), F.col("e.dls").alias("dl"), *(F.col(f"e.{x}").alias(x) for x in more))).drop("seg")

        return cls(docs, rows("positions"), stats, rows(), terms, blocks, live, version, size)

    def only(self, ranges: DataFrame) -> Corpus:
        """The same statistics, but only the documents of these ranges (seg, range)."""
        return self.of_blocks(self.docs, self.blocks.join(ranges, ["seg", "range"], "left_semi"), self.terms, self.stats, self.live, self.version, self.size)

    def frequencies(self, field: str, words: list[str]) -> dict[str, int]:
        """Documents that hold each word; a row a word reaches the driver."""
        wanted = lambda df: df.where((F.col("field") == field) & F.col("term").isin(words))
        rows = wanted(self.hits).groupBy("term").agg(F.count("*").alias("df")) if self.terms is None else wanted(self.terms)
        return {r.term: r.df for r in rows.select("term", "df").collect()}


def _within(p, j: int, slop: int):
    return lambda q: (q >= p + j) & (q <= p + j + slop)


def _phrase(c: Corpus, t: query.Term, f: str) -> DataFrame:
    """(doc_id, tf, dl) of documents that hold the words in order, each at most slop places further than next to the one before."""
    words = t.words
    rows = c.postings.where((F.col("field") == f) & F.col("term").isin(list(set(words)))).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.max("dl").alias("dl"))
    at = [F.coalesce(F.element_at("at", w), F.array().cast("array<int>")) for w in words]

    def follows(p):
        near = (F.array_contains(at[j], p + j) if t.slop == 0 else F.size(F.filter(at[j], _within(p, j, t.slop))) > 0 for j in range(1, len(words)))
        return reduce(lambda a, b: a & b, near)

    hits = F.filter(at[0], lambda p: follows(p))
    return rows.withColumn("tf", F.size(hits)).where("tf > 0").select("doc_id", "tf", "dl")


def _bm25() -> Column:
    """From tf, df, dl, n_docs, avgdl and boost."""
    d = lambda x: F.col(x).cast("double")
    idf = F.log(F.lit(1.0).cast("double") + (d("n_docs") - d("df") + F.lit(0.5).cast("double")) / (d("df") + F.lit(0.5).cast("double")))
    norm = F.lit(K1).cast("double") * (F.lit(1 - B).cast("double") + F.lit(B).cast("double") * d("dl") / d("avgdl"))
    return idf * d("tf") * F.lit(K1 + 1).cast("double") / (d("tf") + norm) * F.col("boost")


def _scored(c: Corpus, hits: DataFrame, f: str, boost: float) -> DataFrame:
    """BM25 of (doc_id, tf, dl), with df = the hits' number."""
    st = c.stats.where(F.col("field") == f).select("n_docs", "avgdl", F.lit(float(boost)).alias("boost"))
    one = F.broadcast(st.join(F.broadcast(hits.agg(F.count("*").alias("df")))))  # one row
    return hits.join(one).select("doc_id", _bm25().alias("score"))


def _plain(tree) -> bool:
    return isinstance(tree, query.Term) and len(tree.words) <= 1


def _asked(terms: list[query.Term]) -> list[tuple]:
    return [(i, f, t.raw if f == "rel_path" else t.words[0], t.boost) for i, t in enumerate(terms) for f in t.fields if f == "rel_path" or t.words]


def _wanted(asked: list[tuple]) -> Column:
    fields = sorted({f for _, f, _, _ in asked})
    return reduce(lambda a, b: a | b, ((F.col("field") == f) & F.col("term").isin(sorted({w for _, g, w, _ in asked if g == f})) for f in fields))


def _facts(c: Corpus, asked: list[tuple]) -> DataFrame:
    """(field, term, clause, boost, df, n_docs, avgdl): a row for each word asked that the index has."""
    words = F.inline(F.array(*(F.struct(F.lit(i).alias("clause"), F.lit(f).alias("field"), F.lit(w).alias("term"), F.lit(float(x)).alias("boost")) for i, f, w, x in asked)))
    if c.terms is None:
        df = c.hits.where(_wanted(asked)).groupBy("field", "term").agg(F.count("*").alias("df"))
    else:
        df = c.terms.where(_wanted(asked)).select("field", "term", "df")
    facts = c.docs.sparkSession.range(1).select(words).join(df, ["field", "term"])
    return F.broadcast(facts.join(c.stats.select("field", "n_docs", "avgdl"), "field"))


def _plain_scores(c: Corpus, terms: list[query.Term]) -> DataFrame:
    """(doc_id, clause, score) for terms of one word, all in one pass over the postings; clause is the term's place in the list."""
    asked = _asked(terms)
    if not asked:
        return c.docs.select("doc_id", F.lit(0).alias("clause"), F.lit(0.0).alias("score")).where(F.lit(False))
    hits = c.hits.where(_wanted(asked)).select("field", "term", "doc_id", "tf", "dl")
    out = hits.join(_facts(c, asked), ["field", "term"]).select("doc_id", "clause", _bm25().alias("score"))
    if any(len(t.fields) > 1 for t in terms):
        out = out.groupBy("doc_id", "clause").agg(F.sum("score").alias("score"))
    return out


def _leaves(tree) -> list | None:
    """The words that add to the score of a tree of single words; None for a tree with anything else in it."""
    if _plain(tree):
        return [tree]
    if not isinstance(tree, query.Bool) or any(_leaves(x) is None for x in tree.never):
        return None
    parts = [_leaves(x) for x in (*tree.must, *tree.should)]
    return None if None in parts else [t for p in parts for t in p]


def bounds(c: Corpus, terms: list[query.Term]) -> DataFrame:
    """(seg, range, bound): what no document's score exceeds, from the blocks' best pairs of tf and dl. Reads no entries."""
    asked = _asked(terms)
    b = c.blocks.where(_wanted(asked)).select("seg", "range", "field", "term", "sky").join(_facts(c, asked), ["field", "term"])
    pairs = b.select("seg", "range", "field", "clause", "term", "df", "n_docs", "avgdl", "boost", F.inline("sky"))
    most = pairs.groupBy("seg", "range", "field", "clause", "term").agg(F.max(_bm25()).alias("w"))
    return most.groupBy("seg", "range").agg((F.sum(F.greatest("w", F.lit(0.0))) * (1 + ROUNDING)).alias("bound"))


def reaching(c: Corpus, tree, k: int) -> DataFrame | None:
    """The ranges (seg, range) that the best k documents of the tree lie in, or None where all have to be scored.

    A few ranges with the largest bounds are scored first; what their k-th document has, the others must be able to reach. Equal
    scores can be reached too, so ties come out the same. At most FEW_RANGES rows and k scores reach the driver.
    """
    terms = _leaves(tree)
    if c.blocks is None or not terms or not _asked(terms) or c.size is not None and c.size < FEW_RANGES << index.RANGE_BITS - 1:
        return None
    per_range = bounds(c, terms)
    best = per_range.orderBy(F.desc("bound"), "seg", "range").limit(FEW_RANGES).collect()
    if len(best) < FEW_RANGES:
        return None
    first = c.docs.sparkSession.createDataFrame([(r.seg, r["range"]) for r in best[: max(FIRST_RANGES, 2 * k >> index.RANGE_BITS)]], "seg int, range long")
    top = matches(c.only(F.broadcast(first)), tree).orderBy(F.desc("score"), "doc_id").limit(k).collect()
    if len(top) < k:
        return None
    least = top[-1].score
    if best[-1].bound < least:  # all that can reach it are at hand
        rows = [(r.seg, r["range"]) for r in best if r.bound >= least]
        return F.broadcast(c.docs.sparkSession.createDataFrame(rows, "seg int, range long"))
    return per_range.where(F.col("bound") >= least).select("seg", "range")


def _sum(parts: list[DataFrame]) -> DataFrame:
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.sum("score").alias("score"))


def _clauses(c: Corpus, must: tuple, should: tuple) -> DataFrame:
    """(doc_id, score) of documents that fit every must clause, or with none of those any should clause: one aggregation over all clauses' rows."""
    every = [(t, 1) for t in must] + [(t, 0) for t in should]
    plain = [(t, n) for t, n in every if _plain(t)]
    parts = [matches(c, t).select("doc_id", "score", F.lit(n).alias("must")) for t, n in every if not _plain(t)]
    if plain:
        n_must = sum(n for _, n in plain)  # they come first
        parts.append(_plain_scores(c, [t for t, _ in plain]).select("doc_id", "score", (F.col("clause") < n_must).cast("int").alias("must")))
    out = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.sum("score").alias("score"), F.sum("must").alias("n"))
    return (out.where(F.col("n") == len(must)) if must else out).select("doc_id", "score")


def matches(c: Corpus, tree) -> DataFrame:
    """(doc_id, score) of the documents that the tree fits, one row each."""
    if isinstance(tree, query.All):
        return c.docs.select("doc_id", F.lit(1.0).cast("double").alias("score"))
    if _plain(tree):
        return _plain_scores(c, [tree]).select("doc_id", "score")
    if isinstance(tree, query.Term):
        path = [_plain_scores(c, [replace(tree, words=(), fields=("rel_path",))]).select("doc_id", "score")] if "rel_path" in tree.fields else []
        return _sum(path + [_scored(c, _phrase(c, tree, f), f, tree.boost) for f in tree.fields if f != "rel_path"])
    if isinstance(tree, (query.Range, query.Among)):
        t = F.col("term")
        if isinstance(tree, query.Among):
            test = t.isin(list(tree.values))
        else:
            test = F.lit(True)
            if tree.low is not None:
                test = test & (t >= tree.low if tree.low_in else t > tree.low)
            if tree.high is not None:
                test = test & (t <= tree.high if tree.high_in else t < tree.high)
        return c.postings.where((F.col("field") == tree.field) & test).select("doc_id").distinct().select("doc_id", F.lit(1.0).cast("double").alias("score"))
    all_of = _clauses(c, tree.must, tree.should)
    for x in tree.never:
        all_of = all_of.join(matches(c, x).select("doc_id"), "doc_id", "left_anti")
    return all_of


def search(c: Corpus, text: str, limit: int = 8, fields: tuple[str, ...] = query.FIELDS, max_tokens: int | None = None, with_docs: bool = True) -> DataFrame:
    """The best `limit` documents, ties by doc_id; max_tokens filters after the limit."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    tree = query.understand(text, fields)
    ranges = reaching(c, tree, limit)
    top = matches(c if ranges is None else c.only(ranges), tree).orderBy(F.desc("score"), "doc_id").limit(limit)
    if not with_docs:
        return top
    out = F.broadcast(top).join(c.docs, "doc_id")  # `limit` rows at most
    return out if max_tokens is None else out.where(F.col("token_estimate") <= max_tokens)
