"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A template of w words belongs to the class of the least power of two L >= w; a text's blocks of that class
are its runs of 2 * L words that start at every L-th word, so each run of L words lies within one. The join finds
every block that holds at least THRESHOLD of a template's distinct words. Words are ordered by how
often they occur in all texts, rarest first: a block that fits must hold one of a template's first
few words (prefix filter), enough words (length filter), and enough of them behind the word
in common (positional filter). What passes is verified on the whole sets.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bare_words import BARE_WORD, bare_words
from quillspark.llm.common import map_rows, prepare, raw_texts, save, table

#: Share of a template's distinct words that a block must hold, in hundredths.
THRESHOLD = 80
LEAST_CLASS = 4
#: Phrases of the base scan and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Labels, and the wording of public license notices as lower-case words.
TEMPLATES = [
    ("apache", "under the apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]
    size: int

    @property
    def length(self) -> int:
        """The class L."""
        return max(LEAST_CLASS, 1 << (self.size - 1).bit_length())

    @property
    def needs(self) -> int:
        return -(-len(self.words) * THRESHOLD // 100)

    @property
    def prefix(self) -> int:
        """So many of its rarest words: a set without one of them can't hold `needs`."""
        return len(self.words) - self.needs + 1

    def ordered(self, rank: dict[str, int]) -> list[int]:
        return sorted(rank[w] for w in self.words)


def templates_of(given: list[tuple[str, str]]) -> list[Template]:
    return [Template(i, label, tuple(sorted(set(t.split()))), len(t.split())) for i, (label, t) in enumerate(given)]


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the templates stands in all texts; a row a word reaches the driver."""

    def run(batches):
        at = {w.encode(): i for i, w in enumerate(vocabulary)}
        n = np.zeros(len(at) + 1, np.int64)
        for b in batches:
            for raw in raw_texts(b):
                own = bare_words(raw)
                n += np.bincount(np.fromiter(map(at.get, own, repeat(len(at))), np.int64, len(own)), minlength=len(n))
        yield pa.RecordBatch.from_pydict({"word": vocabulary, "n": n[:-1]})

    rows = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word: r.n for r in rows}


class Scanner:
    """Bytes of a text -> its number of words, places and labels of phrases, and the blocks that hold a template's prefix word and enough words.

    A block is (class, number, its words of the class's templates as ranks, rising); rank 0 is the rarest word.
    """

    def __init__(self, rank: dict[str, int], templates: list[Template]):
        self.at = {w.encode(): r for w, r in rank.items()}
        self.other = len(rank)
        self.phrases = [([self.at[w.encode()] for w in p.split()], label) for p, label in PHRASES.items()]
        self.classes = []
        for length in sorted({t.length for t in templates}):
            own = [t for t in templates if t.length == length]
            known, first = np.zeros(self.other + 1, bool), np.zeros(self.other + 1, bool)
            for t in own:
                known[t.ordered(rank)] = True
                first[t.ordered(rank)[: t.prefix]] = True
            self.classes.append((length, known, first, min(t.needs for t in own)))

    def places(self, ids: np.ndarray) -> list[tuple[np.ndarray, str]]:
        out = []
        for words, label in self.phrases:
            n = len(ids) - len(words) + 1
            if n > 0:
                fit = ids[:n] == words[0]
                for k, w in enumerate(words[1:], 1):
                    fit &= ids[k : n + k] == w
                out.append((np.flatnonzero(fit), label))
        return out

    def blocks(self, ids: np.ndarray) -> list[dict]:
        out = []
        for length, known, first, least in self.classes:
            at = np.flatnonzero(first[ids]) // length
            for block in np.union1d(at, at[at > 0] - 1).tolist():
                part = ids[block * length : (block + 2) * length]
                part = np.unique(part[known[part]])
                if len(part) >= least:
                    out.append({"length": length, "block": block, "words": part.tolist()})
        return out

    def __call__(self, raw: bytes) -> tuple:
        words = bare_words(raw)
        ids = np.fromiter(map(self.at.get, words, repeat(self.other)), np.int64, len(words))
        found = [(at, label) for at, label in self.places(ids) if len(at)]
        first = min((int(at[0]) for at, _ in found), default=None)
        last = max((int(at[-1]) for at, _ in found), default=None)
        return len(words), sum(len(at) for at, _ in found), first, last, sorted({label for _, label in found}), self.blocks(ids)


FIELDS = "n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<length: int, block: long, words: array<int>>>"


def index_of(spark: SparkSession, rank: dict[str, int], templates: list[Template]) -> DataFrame:
    """A row for each prefix word of each template."""
    rows = [(t.length, w, place, t.number, t.label, len(t.words), t.needs, t.ordered(rank)) for t in templates for place, w in enumerate(t.ordered(rank)[: t.prefix])]
    return spark.createDataFrame(rows, "length int, word int, place int, template int, label string, size int, needs int, whole array<int>")


def joined(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """blocks (rid, length, block, words) -> (rid, block, template, label, held): every block with at least `needs` of a template's words, and how many."""
    tokens = blocks.select("rid", "length", "block", "words", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    pairs = tokens.join(F.broadcast(index), ["length", "word"])  # a few rows a template
    pairs = pairs.where((F.col("n") >= F.col("needs")) & (F.col("at") <= F.col("n") - F.col("needs")))
    pairs = pairs.where(1 + F.least(F.col("size") - 1 - F.col("place"), F.col("n") - 1 - F.col("at")) >= F.col("needs"))
    held = F.size(F.array_intersect("words", "whole"))
    found = pairs.withColumn("held", held).where("held >= needs")
    return found.select("rid", "length", "block", "template", "label", "held", "size").distinct()


def scan(docs: DataFrame, given: list[tuple[str, str]] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(documents with their phrases, blocks that hold a template), both with rid, a number for each row of docs.

    documents: rid, doc_id, n_words, n_base, first_word, last_word, base; blocks: rid, length, block, template, label, held, size.
    The block's words are those from block * length on, 2 * length of them.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", "text")
    templates = templates_of(given)
    vocabulary = sorted({w for t in templates for w in t.words} | {w for p in PHRASES for w in p.split()})
    often = frequencies(docs, vocabulary)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}

    def start():
        own = Scanner(rank, templates)
        names = [f.split(" ")[0] for f in ("n_words", "n_base", "first_word", "last_word", "base", "blocks")]
        return lambda b: dict(zip(names, map(list, zip(*map(own, raw_texts(b)))))) if len(b) else {n: [] for n in names}

    rows = save(map_rows(docs, start, FIELDS, ["doc_id"]).withColumn("rid", F.monotonically_increasing_id()), "licenses")
    blocks = rows.where(F.size("blocks") > 0).select("rid", F.inline("blocks"))
    return rows.drop("blocks"), joined(blocks, index_of(spark, rank, templates))


def license_scan(docs: DataFrame, given: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row.

    score: the largest share of a template's words that one block holds, at least THRESHOLD hundredths; 1 with a phrase; else 0.
    Null text: empty, no words, labels '' and score 0. Null and repeated ids are rows like others. Empty table: no
    rows. Texts count in whole, other columns are ignored.
    """
    rows, found = scan(docs, given)
    per = found.groupBy("rid").agg(F.collect_set("label").alias("more"), F.max(F.col("held") / F.col("size")).alias("share"))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", none)))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return rows.join(per, "rid", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_T = templates_of(TEMPLATES)
#: All blocks against all templates, without filters.
OP12_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BARE_WORD}') AS ws FROM documents),
p AS (SELECT rid, CAST(generate_subscripts(ws, 1) - 1 AS BIGINT) AS i, unnest(ws) AS w FROM t),
q AS (SELECT *, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
base AS (SELECT rid, i, CASE WHEN w = 'cc' AND w2 = 'by' THEN 'cc-by' WHEN w = 'general' AND w2 = 'public' AND w3 = 'license' THEN 'gpl' WHEN w = 'all' AND w2 = 'rights' AND w3 = 'reserved' THEN 'reserved' END AS label FROM q),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM base WHERE label IS NOT NULL GROUP BY rid),
m(template, label, length, size, needs) AS (VALUES {_values((t.number, t.label, t.length, len(t.words), t.needs) for t in _T)}),
mw(template, w) AS (VALUES {_values((t.number, w) for t in _T for w in t.words)}),
held AS (SELECT DISTINCT rid, template, m.label, size, needs, i // length - s AS block, w FROM p JOIN mw USING (w) JOIN m USING (template), (VALUES (0), (1)) AS shift(s) WHERE i // length - s >= 0),
found AS (SELECT rid, label, count(*) / max(size) AS share FROM held GROUP BY rid, template, label, block HAVING count(*) >= max(needs)),
labels AS (SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base WHERE label IS NOT NULL UNION SELECT rid, label FROM found) GROUP BY rid),
based AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base WHERE label IS NOT NULL GROUP BY rid),
s AS (SELECT rid, max(share) AS share FROM found GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM t LEFT JOIN b USING (rid) LEFT JOIN based USING (rid) LEFT JOIN labels USING (rid) LEFT JOIN s USING (rid)
"""
