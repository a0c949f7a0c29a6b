"""Index tables: documents, postings with positions, lengths and statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import estimate_tokens
from quillspark.shipping import ship

#: Tokens of this many bytes or more are left out.
LONGEST = 40
TOKEN = r"[\p{IsAlphabetic}\p{N}]+"


def tokens(text: F.Column) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def docs_table(files: DataFrame, summary: F.Column | None = None) -> DataFrame:
    """(rel_path, content) -> (doc_id, rel_path, body, summary, token_estimate). Bytes that aren't UTF-8 read as an empty body."""
    body = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit(""))
    d = files.select(F.col("rel_path").alias("doc_id"), "rel_path", body.alias("body"))
    return d.withColumn("summary", F.lit("") if summary is None else summary).withColumn("token_estimate", estimate_tokens(F.col("body")))


def occurrences(docs: DataFrame, fields: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """(field, doc_id, term, pos, dl, *keep); dl: the document's words in the field. rel_path is one untokenized term; the others are split into lower-case words."""
    out = None
    for f in fields:
        if f == "rel_path":
            part = docs.select(F.lit(f).alias("field"), "doc_id", F.col(f).alias("term"), F.lit(0).alias("pos"), F.lit(1).cast("long").alias("dl"), *keep)
        else:
            own = docs.select("doc_id", tokens(F.col(f)).alias("all"), *keep).withColumn("dl", F.size(F.filter("all", _short)).cast("long"))
            part = own.select(F.lit(f).alias("field"), "doc_id", "dl", F.posexplode("all").alias("pos", "term"), *keep).where(_short(F.col("term"))).select("field", "doc_id", "term", "pos", "dl", *keep)
        out = part if out is None else out.unionByName(part)
    return out


def _short(t: F.Column) -> F.Column:
    return F.octet_length(t) < LONGEST


def postings(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, term, doc_id, tf, dl, positions)."""
    return _by_document(occurrences(docs, fields), ("field", "term", "doc_id"))


def _by_document(found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return found.groupBy(*keys).agg(F.count("*").cast("int").alias("tf"), F.max("dl").alias("dl"), F.array_sort(F.collect_list("pos")).alias("positions"))


#: Documents in a range, so the most entries of a block are 2 to this.
RANGE_BITS = 7


def ranged(docs: DataFrame) -> DataFrame:
    """docs sorted by doc_id, with `range`: the number of a run of at most 2 ** RANGE_BITS neighbours. To be written before it is used twice."""
    return docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("range", F.shiftright(F.monotonically_increasing_id(), RANGE_BITS))


def blocks(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Postings in blocks, one for each term and range: (field, term, range, n, cf, sky, ids, tfs, dls, positions), sorted, the arrays by document.

    sky: the pairs of tf and dl that no other of the block is better than in both, from which the block's largest
    weight follows whatever the mean length is. Entries are made where the texts are read, a row for each word and range of a
    batch, and these move in one shuffle by range of (field, term, range). One row a doc_id is expected.
    """
    ship(docs.sparkSession)
    entry = "array<struct<doc_id:string,tf:int,dl:bigint,positions:array<int>>>"
    parts = []
    for f in fields:
        read = docs.select("doc_id", "range", F.array_compact(F.array(f)).alias("w") if f == "rel_path" else tokens(F.col(f)).alias("w"))
        parts.append(read.mapInArrow(_entries(f == "rel_path"), f"term string, range bigint, e {entry}").select(F.lit(f).alias("field"), "term", "range", "e"))
    laid = reduce(DataFrame.unionByName, parts).repartitionByRange("field", "term", "range")
    whole = laid.groupBy("field", "term", "range").agg(F.sort_array(F.flatten(F.collect_list("e"))).alias("e"))
    best = F.sort_array(F.transform("e", lambda x: F.struct((-x["tf"]).alias("t"), x["dl"].alias("dl"))))
    last = lambda acc: F.get(acc, F.size(acc) - 1)["dl"]
    sky = F.aggregate(best, F.array().cast("array<struct<tf:int,dl:bigint>>"), lambda acc, x: F.when((F.size(acc) == 0) | (x["dl"] < last(acc)), F.concat(acc, F.array(F.struct((-x["t"]).alias("tf"), x["dl"].alias("dl"))))).otherwise(acc))
    part = lambda k: F.transform("e", lambda x: x[k])
    cf = F.aggregate("e", F.lit(0).cast("long"), lambda acc, x: acc + x["tf"])
    return whole.select("field", "term", "range", F.size("e").cast("long").alias("n"), cf.alias("cf"), sky.alias("sky"), part("doc_id").alias("ids"), part("tf").alias("tfs"), part("dl").alias("dls"), part("positions").alias("positions")).sortWithinPartitions("field", "term", "range")


def doc_lengths(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, doc_id, dl) for every document, from arrays: no row for each token."""
    out = None
    for f in fields:
        n = F.lit(1) if f == "rel_path" else F.size(F.filter(tokens(F.col(f)), lambda t: F.octet_length(t) < LONGEST))
        part = docs.select(F.lit(f).alias("field"), "doc_id", n.cast("long").alias("dl"))
        out = part if out is None else out.unionByName(part)
    return out


def term_stats(docs: DataFrame, fields: tuple[str, ...], unique: bool = False) -> DataFrame:
    """(field, term, df, cf); unique: no two rows share an id. Words are counted by batches of documents where the texts are read; what is shuffled is a row for each word of a batch."""
    ship(docs.sparkSession)
    once, again = _by_repeats(docs, unique)
    parts = []
    for f in fields:
        read = once.select(F.array_compact(F.array(f)).alias("w") if f == "rel_path" else tokens(F.col(f)).alias("w"))
        parts.append(read.mapInArrow(_count_words(f == "rel_path"), "term string, df bigint, cf bigint").select(F.lit(f).alias("field"), "term", "df", "cf"))
    if again is not None:
        per = occurrences(again, fields).groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"))
        parts.append(per.select("field", "term", F.lit(1).cast("long").alias("df"), F.col("tf").alias("cf")))
    return reduce(DataFrame.unionByName, parts).groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def term_counts(docs: DataFrame, field: str) -> DataFrame:
    """(term, doc_id, tf) of a field of words, made where the texts are read: words aren't shuffled."""
    ship(docs.sparkSession)
    once, again = _by_repeats(docs)
    rows = once.select("doc_id", tokens(F.col(field)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, code, row, tf = _counted(b.column(1), False)
            for k in range(0, len(tf), _ROWS):
                part = [words.take(pa.array(code[k : k + _ROWS])), b.column(0).take(pa.array(row[k : k + _ROWS])), pa.array(tf[k : k + _ROWS], pa.int64())]
                yield pa.RecordBatch.from_arrays(part, names=["term", "doc_id", "tf"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"term string, doc_id {id_type}, tf bigint")
    return out if again is None else out.unionByName(occurrences(again, (field,)).groupBy("term", "doc_id").agg(F.count("*").alias("tf")))


#: Rows of a batch of results.
_ROWS = 1 << 16


#: Ids of several rows that are broadcast, at most; more are joined by a shuffle.
MANY_REPEATS = 500_000


def _by_repeats(docs: DataFrame, unique: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """docs whose id is one row's, and those with an id that several rows have, whose words count together; None if there are none, which a pass over the ids tells."""
    twice = docs.groupBy(F.col("doc_id").alias("twice")).agg(F.count("*").alias("n")).where("n > 1").select("twice")
    n = 0 if unique else twice.count()
    if not n:
        return docs, None
    twice = F.broadcast(twice) if n <= MANY_REPEATS else twice
    same = F.col("doc_id").eqNullSafe(F.col("twice"))
    return docs.join(twice, same, "left_anti"), docs.join(twice, same, "left_semi")


def _counted(lists: pa.Array, any_length: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lists of words -> the distinct words, and for each pair of word and list: the word's place, the list's, how often."""
    d = lists.flatten().dictionary_encode()
    code, row = d.indices.to_numpy().astype(np.int64), pc.list_parent_indices(lists).to_numpy()
    if not any_length:
        short = pc.less(pc.binary_length(d.dictionary), LONGEST).to_numpy(zero_copy_only=False)[code]
        code, row = code[short], row[short]
    key, tf = np.unique(code * len(lists) + row, return_counts=True)
    return d.dictionary, key // max(1, len(lists)), key % max(1, len(lists)), tf


def _entries(any_length: bool):
    """Batches of (doc_id, range, words) -> (term, range, entries by document) for each word and range of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ranges, lists = b.column(0), b.column(1).to_numpy(), b.column(2)
            n = len(b)
            d = lists.flatten().dictionary_encode()
            code, row = d.indices.to_numpy().astype(np.int64), pc.list_parent_indices(lists).to_numpy()
            place = np.arange(len(row)) - np.searchsorted(row, row)
            if not any_length:
                short = pc.less(pc.binary_length(d.dictionary), LONGEST).to_numpy(zero_copy_only=False)[code]
                code, row, place = code[short], row[short], place[short]
            if not len(code):
                continue
            dl = np.bincount(row, minlength=n)
            near = np.argsort(ranges, kind="stable")  # rows by range; they come so unless a task reads several files
            rank = np.empty(n, np.int64)
            rank[near] = np.arange(n)
            key = code * n + rank[row]
            order = np.argsort(key, kind="stable")
            key, begin, tf = np.unique(key[order], return_index=True, return_counts=True)
            code, row, place = key // n, near[key % n], place[order]
            new = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (ranges[row][1:] != ranges[row][:-1])])
            for k in range(0, len(new), _BLOCKS):
                at = new[k : k + _BLOCKS]
                i, j = at[0], new[k + _BLOCKS] if k + _BLOCKS < len(new) else len(key)
                lo, hi = begin[i], begin[j - 1] + tf[j - 1]
                positions = pa.ListArray.from_arrays(pa.array(np.r_[begin[i:j], hi] - lo, pa.int32()), pa.array(place[lo:hi], pa.int32()))
                e = pa.StructArray.from_arrays([ids.take(pa.array(row[i:j])), pa.array(tf[i:j], pa.int32()), pa.array(dl[row[i:j]], pa.int64()), positions], names=["doc_id", "tf", "dl", "positions"])
                e = pa.ListArray.from_arrays(pa.array(np.r_[at, j] - i, pa.int32()), e)
                yield pa.RecordBatch.from_arrays([d.dictionary.take(pa.array(code[at])), pa.array(ranges[row[at]], pa.int64()), e], names=["term", "range", "e"])

    return run


#: Blocks of a batch of results.
_BLOCKS = 1 << 14


def _count_words(any_length: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, code, _, tf = _counted(b.column(0), any_length)
            at, begin, df = np.unique(code, return_index=True, return_counts=True)
            if len(at):
                yield pa.RecordBatch.from_arrays([words.take(pa.array(at)), pa.array(df, pa.int64()), pa.array(np.add.reduceat(tf, begin), pa.int64())], names=["term", "df", "cf"])

    return run


def field_stats(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, n_docs, total_tokens, avgdl)."""
    return doc_lengths(docs, fields).groupBy("field").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total_tokens")).withColumn("avgdl", F.col("total_tokens").cast("double") / F.col("n_docs"))
