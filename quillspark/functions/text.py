"""Text functions of the index: white space, length limits, Markdown lines, summaries, previews, line slices. All but summarize() are native columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUMMARY_CHARS, SUMMARY_SEGMENTS, SUMMARY_WORDS, SNIPPET_CHARS = 360, 4, 60, 420


def bound(x: Column, f) -> Column:
    """f(x), where x is worked out once however often f names it; an expression that is only repeated is worked out each time."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def collapse_whitespace(s: Column) -> Column:
    """Each run of Unicode white space to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), "^ | $", "")


def truncate_to_limit(s: Column, n: int) -> Column:
    """At most n code points; a longer text keeps n - 1, loses white space at the end and gets an ellipsis."""
    if n == 0:
        return F.when(s.isNotNull(), F.lit(""))
    cut = F.concat(F.regexp_replace(F.substring(s, 1, n - 1), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.length(s) <= n, s).otherwise(cut)


def estimate_tokens(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"(?U)\S+")).cast("long")


def strip_front_matter(s: Column) -> Column:
    """Drops byte order marks, then a block between two lines of three dashes at the very start; an open block stays."""
    bare = F.regexp_replace(s, "^﻿+", "")
    return F.regexp_replace(bare, r"\A[^\S\n]*---[^\S\n]*\n(?s:.*?\n)??[^\S\n]*---[^\S\n]*(?:\r?\n[\r\n]*|\z)", "")


def strip_links(s: Column) -> Column:
    return F.regexp_replace(s, r"\[([^\]]+)\]\([^)]+\)", "$1")


def strip_code(s: Column) -> Column:
    return F.regexp_replace(s, "`([^`]+)`", "$1")


def strip_tags(s: Column) -> Column:
    return F.regexp_replace(s, "<[^>]+>", "")


def strip_list_prefix(s: Column) -> Column:
    """One task box, else one bullet, else numbers with dots or brackets (no space is needed after them)."""
    box, bullet = r"^[-*+] \[[ xX]\]\s*", r"^[-*+]\s+"
    return F.when(s.rlike(box), F.regexp_replace(s, box, "")).when(s.rlike(bullet), F.regexp_replace(s, bullet, "")).otherwise(F.regexp_replace(s, r"(?U)^(?:\d+[.)])+\s*", ""))


def is_code_fence(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+", "").rlike("^(```|~~~)")


def normalize_line(s: Column) -> Column:
    """A Markdown line as plain text; null if nothing is left."""
    plain = lambda x: F.when(x.startswith("#"), F.regexp_replace(x, r"^#+\s*", "")).otherwise(bound(F.regexp_replace(x, r"^(?:>\s*)+", ""), strip_list_prefix))
    x = bound(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), plain)
    return bound(collapse_whitespace(F.replace(strip_tags(strip_code(strip_links(x))), F.lit("`"), F.lit(""))), lambda y: F.when(y != "", y))


def lines(body: Column) -> Column:
    """Lines without their ends; no empty one after a last line end."""
    parts = F.split(body, "\r?\n")
    trimmed = F.when(body.endswith("\n"), bound(parts, lambda p: F.slice(p, 1, F.size(p) - 1))).otherwise(parts)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(trimmed)


def _sentences(text_lines: Column, n: int) -> Column:
    """Lines joined, and of that the sentences (less their end signs) until n code points are reached."""
    bare = F.filter(F.transform(text_lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    sentences = F.split(collapse_whitespace(F.array_join(bare, " ")), r"[.!?]+\s+")
    return F.aggregate(sentences, F.lit(""), lambda a, x: F.when(F.length(a) >= n, a).when(a == "", x).otherwise(F.concat_ws(" ", a, x)))


def condense(text_lines: Column, n: int = SNIPPET_CHARS) -> Column:
    """The first sentences of the lines, cut to n code points."""
    return truncate_to_limit(_sentences(text_lines, n), n)


def condense_cuts(text_lines: Column, n: int = SNIPPET_CHARS) -> Column:
    """Whether condense() cuts its last sentence."""
    return F.length(_sentences(text_lines, n)) > n


def line_range(body: Column, fragment: Column) -> Column:
    """struct(line_start, line_end) of the fragment's first place in the body, else from the first line that holds the fragment's first line
    that isn't blank to the first one from there that holds its last (that line alone, if none does); null if there is none."""
    at = F.instr(body, fragment)
    start = F.length(F.regexp_replace(F.substring(body, F.lit(1), at - 1), "[^\n]", "")) + 1
    whole = F.struct(start.alias("line_start"), (start + F.greatest(F.size(lines(fragment)), F.lit(1)) - 1).alias("line_end"))
    parts = F.filter(lines(fragment), lambda x: x.rlike(r"(?U)\S"))
    first, last = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
    holds = lambda x: F.filter(F.transform(lines(body), lambda y, i: F.when(F.contains(y, x), i + 1)), lambda i: i.isNotNull())
    begin = F.array_min(holds(first))
    end = F.coalesce(F.array_min(F.filter(holds(last), lambda i: i >= begin)), begin)
    near = F.when(begin.isNotNull(), F.struct(begin.alias("line_start"), end.alias("line_end")))
    return F.when(F.length(fragment) > 0, F.when(at > 0, whole).otherwise(near))


def line_slice(body: Column, start: int | None = None, end: int | None = None) -> Column:
    """Lines start..end (from 1), joined; out-of-range bounds raise in the API, here they give what is there."""
    s = max(1, start or 1)
    ls = lines(body)
    n = F.size(ls) if end is None else F.least(F.size(ls), F.lit(end))
    return F.when(n < s, F.lit("")).otherwise(F.array_join(F.slice(ls, s, F.greatest(n - s + 1, F.lit(0))), "\n"))


_MARK = [(re.compile(r"\[([^\]]+)\]\([^)]+\)"), r"\1"), (re.compile("`([^`]+)`"), r"\1"), (re.compile("<[^>]+>"), ""), (re.compile("`"), "")]
_FRONT = re.compile(r"\A[^\S\n]*---[^\S\n]*\n(?:.*?\n)??[^\S\n]*---[^\S\n]*(?:\r?\n[\r\n]*|\Z)", re.S)


def plain_line(line: str) -> tuple[str, bool]:
    """(text, is it a heading) of a Markdown line."""
    x = line.strip()
    heading = x.startswith("#")
    if heading:
        x = x.lstrip("#").lstrip()
    else:
        x = re.sub(r"^(?:>\s*)+", "", x)
        for p in (r"^[-*+] \[[ xX]\]\s*", r"^[-*+]\s+", r"^(?:\d+[.)])+\s*"):
            if re.match(p, x):
                x = re.sub(p, "", x, count=1)
                break
    for p, to in _MARK:
        x = p.sub(to, x)
    return " ".join(x.split()), heading


def cut(text: str, n: int) -> str:
    return text if len(text) <= n else text[: n - 1].rstrip() + "…"


def summary_of(body: str | None) -> str:
    """The first segments (headings, paragraphs) of a Markdown text, at most SUMMARY_CHARS code points."""
    text = _FRONT.sub("", (body or "").lstrip("﻿"), count=1)
    segments: list[tuple[str, bool]] = []
    held: list[str] = []
    fenced = False

    def flush():
        joined = " ".join(" ".join(held).split())
        held.clear()
        if joined and len(segments) < SUMMARY_SEGMENTS:
            segments.append((joined, False))

    for line in text.split("\n"):
        if len(segments) >= SUMMARY_SEGMENTS:
            break
        if line.strip().startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if fenced:
            continue
        if not line.strip():
            flush()
            continue
        plain, heading = plain_line(line)
        if not plain:
            continue
        if heading:
            flush()
            if len(segments) < SUMMARY_SEGMENTS:
                segments.append((plain, True))
        else:
            held.append(plain)
    flush()
    out = ""
    for i, (s, _) in enumerate(segments):
        out += s if i == 0 else (" — " if i == 1 and segments[0][1] else " ") + s
        if len(out) >= SUMMARY_CHARS:
            break
    out = cut(out or " ".join(text.split()), SUMMARY_CHARS)
    return out if out.strip() else " ".join((body or "").split()[:SUMMARY_WORDS])


@F.pandas_udf(T.StringType())
def summarize(body: pd.Series) -> pd.Series:
    return body.map(summary_of)
