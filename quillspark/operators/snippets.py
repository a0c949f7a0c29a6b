"""Snippets: the best stretch of a document for some terms, marked up, and previews of its first lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import SNIPPET_CHARS, condense, condense_cuts, lines
from quillspark.sources.config import PREVIEW_LINES, WINDOW_LEAST, WINDOW_MOST

SPLIT = r"[\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+"
NO_WORD_ENDS = r"[^\p{IsAlphabetic}\p{N}]+$"


def window_lines(asked: int) -> int:
    return max(WINDOW_LEAST, min(WINDOW_MOST, asked))


def preview(body: Column, n: int = PREVIEW_LINES) -> Column:
    return condense(F.slice(lines(body), 1, n))


def preview_truncated(body: Column, n: int = PREVIEW_LINES) -> Column:
    """Whether the body has more than n lines, or its first n make more than a preview holds."""
    return (F.size(lines(body)) > n) | condense_cuts(F.slice(lines(body), 1, n))


def preview_lines(body: Column, n: int = PREVIEW_LINES) -> Column:
    """struct(line_start, line_end): the first and the last line of the preview's window that isn't blank; nulls without one."""
    at = F.filter(F.transform(F.slice(lines(body), 1, n), lambda x, i: F.when(x.rlike(r"(?U)\S"), i + 1)), lambda i: i.isNotNull())
    return F.struct(F.array_min(at).alias("line_start"), F.array_max(at).alias("line_end"))


def fragments(docs: DataFrame, most: int = SNIPPET_CHARS) -> DataFrame:
    """(doc_id, frag, text), a row a stretch: the runs of words and of what is between, dealt greedily into stretches of at most `most` bytes that begin with a word."""
    runs = F.regexp_extract_all(F.col("body"), F.lit(SPLIT), F.lit(0))

    @F.pandas_udf("array<string>")
    def stretches(all_runs: pd.Series) -> pd.Series:
        import regex

        word = regex.compile(r"[\p{Alphabetic}\p{N}]")

        def deal(own):
            used, held, out = 0, [], []
            for run in own if own is not None else ():
                n = len(run.encode())
                if used and used + n > most and word.match(run):
                    out.append("".join(held))
                    used, held = 0, []
                used += n
                held.append(run)
            return [*out, "".join(held)] if held else out

        return all_runs.map(deal)

    return docs.select("doc_id", F.posexplode(stretches(runs)).alias("frag", "text"))


def escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def best_fragments(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """(doc_id, snippet, html) of few documents (the winners of a search): the stretch with the largest sum of 1 / (1 + df) over `terms` (term -> df), the earliest on ties; none without a term."""
    weights = F.create_map(*[x for t, df in terms.items() for x in (F.lit(t), F.lit(1.0 / (1 + df)))])
    weight = lambda run: F.coalesce(F.try_element_at(weights, F.lower(run)), F.lit(0.0))
    runs = F.regexp_extract_all("text", F.lit(SPLIT), F.lit(0))
    score = F.round(F.aggregate(runs, F.lit(0.0), lambda acc, run: acc + weight(run)), 12)
    best = fragments(docs).withColumn("score", score).where("score > 0").groupBy("doc_id").agg(F.max_by("text", F.struct("score", -F.col("frag"))).alias("text"))
    best = best.withColumn("text", F.regexp_replace("text", NO_WORD_ENDS, ""))  # up to its last word
    marked = F.array_join(F.transform(runs, lambda run: F.when(weight(run) > 0, F.concat(F.lit("<b>"), escape(run), F.lit("</b>"))).otherwise(escape(run))), "")
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return best.select("doc_id", trimmed(F.col("text")).alias("snippet"), trimmed(marked).alias("html"))
