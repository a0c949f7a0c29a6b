"""Query strings to trees: words, "phrases"~slop, field:…, ^boost, ranges, IN sets, *, + - AND OR NOT and brackets, and the fallback ladder."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import regex

FIELDS = ("body", "summary", "rel_path")
#: The index's words (operators/index.py): letters with their marks, and numbers.
WORD = regex.compile(r"[\p{Alphabetic}\p{N}]+")


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    """Words in order; more than one is a phrase."""

    words: tuple[str, ...]
    fields: tuple[str, ...]
    slop: int = 0
    boost: float = 1.0
    raw: str = ""


@dataclass(frozen=True)
class Range:
    field: str
    low: str | None
    high: str | None
    low_in: bool = True
    high_in: bool = True


@dataclass(frozen=True)
class Among:
    field: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class Bool:
    should: tuple = ()
    must: tuple = ()
    never: tuple = field(default=())


_LEX = re.compile(r'\s*(?:(?P<q>"(?:[^"\\]|\\.)*")(?:~(?P<slop>\d+))?|(?P<p>[()])|(?P<s>[+-])(?=\S)|(?P<r>(?P<rf>\w+):(?P<ro>[\[{])(?P<rl>\S+)\s+TO\s+(?P<rh>[^\]}\s]+)(?P<rc>[\]}]))|(?P<i>(?P<if>\w+):\s*IN\s*\[(?P<iv>[^\]]*)\])|(?P<f>\w+):(?=\S)|(?P<b>\^(?P<bv>\d+(?:\.\d+)?))|(?P<w>[^\s()"^:\[\]{}]+))')


def words_in(text: str) -> tuple[str, ...]:
    return tuple(w for w in WORD.findall(text.lower()) if len(w.encode()) < 40)


def parse(text: str, fields: tuple[str, ...] = FIELDS):
    """The tree of a query; QueryError where it isn't one, or holds nothing but exclusions."""
    items, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"at {at}: {text[at:at + 10]!r}")
        items.append(m)
        at = m.end()
    tree, k = _either(items, 0, fields)
    if k != len(items):
        raise QueryError("a bracket is closed that wasn't opened")
    if isinstance(tree, Bool) and not tree.should and not tree.must:
        raise QueryError("only exclusions" if tree.never else "empty")
    return tree


def _either(items, k, fields):
    """Clauses up to a closing bracket; AND binds its two neighbours as musts."""
    clauses: list[list] = []  # [mark, tree]
    joined = None
    while k < len(items) and items[k]["p"] != ")":
        m = items[k]
        if m["w"] in ("AND", "OR") and clauses:
            joined, k = m["w"], k + 1
            continue
        mark = ""
        if m["s"]:
            mark, k = m["s"], k + 1
        elif m["w"] == "NOT":
            mark, k = "-", k + 1
        if k >= len(items):
            raise QueryError("a sign without a clause")
        tree, k = _one(items, k, fields)
        if joined == "AND":
            clauses[-1][0] = clauses[-1][0] or "+"
            mark = mark or "+"
        joined = None
        if tree is not None:
            clauses.append([mark, tree])
    if joined:
        raise QueryError("nothing after AND or OR")
    if len(clauses) == 1 and not clauses[0][0]:
        return clauses[0][1], k
    return Bool(*(tuple(t for s, t in clauses if s == x) for x in ("", "+", "-"))), k


def _one(items, k, fields):
    m = items[k]
    known = set(FIELDS)
    if m["p"] == "(":
        tree, k = _either(items, k + 1, fields)
        if k >= len(items):
            raise QueryError("an open bracket")
        return _boosted(tree, items, k + 1)
    if m["f"]:
        if m["f"] not in known:
            raise QueryError(f"no field {m['f']}")
        if k + 1 >= len(items):
            raise QueryError("a field without a term")
        return _one(items, k + 1, (m["f"],))
    if m["r"]:
        if m["rf"] not in known:
            raise QueryError(f"field {m['rf']} isn't indexed")
        low, high = (None if x == "*" else _as_indexed(m["rf"], x) for x in (m["rl"], m["rh"]))
        return Range(m["rf"], low, high, m["ro"] == "[", m["rc"] == "]"), k + 1
    if m["i"]:
        if m["if"] not in known:
            raise QueryError(f"no field {m['if']}")
        return Among(m["if"], tuple(_as_indexed(m["if"], v.strip('"')) for v in m["iv"].split())), k + 1
    if m["w"] == "*":
        return All(), k + 1
    if m["q"] or m["w"]:
        raw = m["q"][1:-1] if m["q"] else m["w"]
        words = words_in(raw)
        tree = Term(words, fields, int(m["slop"] or 0), raw=raw) if words or "rel_path" in fields else None
        return _boosted(tree, items, k + 1)
    raise QueryError(f"{m[0]!r} isn't expected here")


def _as_indexed(field_name: str, value: str) -> str:
    """Words of tokenized fields are lower-case in the index; a path is one term as it stands."""
    return value if field_name == "rel_path" else value.lower()


def _boosted(tree, items, k):
    if k < len(items) and items[k]["b"]:
        tree, k = _times(tree, float(items[k]["bv"])), k + 1
    return tree, k


def _times(t, x):
    if isinstance(t, Term):
        return Term(t.words, t.fields, t.slop, t.boost * x, t.raw)
    if isinstance(t, Bool):
        return Bool(*(tuple(_times(c, x) for c in part) for part in (t.should, t.must)), t.never)
    return t


def sanitize(text: str) -> str:
    """Letters with their marks, numbers, white space and _ stay, all else is a space; runs of space are one."""
    return " ".join("".join(c if c == "_" or c.isspace() or WORD.match(c) else " " for c in text).split())


def understand(text: str, fields: tuple[str, ...] = FIELDS):
    """The ladder: as written, else sanitized, else every document."""
    for attempt in (text, sanitize(text)):
        try:
            if attempt.strip():
                return parse(attempt, fields)
        except QueryError:
            continue
    return All()
