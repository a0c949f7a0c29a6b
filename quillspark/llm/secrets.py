"""Secret scans: fixed patterns, and strings that a dictionary-primed zstandard can't shorten in a sensitive context.

The dictionary is what stands around a candidate and the names that the corpus itself assigns values to
most often, counted over all documents.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter
from functools import lru_cache
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import map_rows, prepare, table, texts

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates of the novelty scan: unbroken strings of at least this length.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}(?:\.[A-Za-z0-9+/_=-]{6,})*")
#: Names before a colon or an equals sign; the dictionary takes the MOST_NAMES that are in most documents, LEAST_DOCS at least.
NAME = re.compile(r"""(?<![A-Za-z0-9_-])([A-Za-z_][A-Za-z0-9_-]{2,39})["']?[ \t]*[:=]""")
MOST_NAMES, LEAST_DOCS = 512, 5
SENSITIVE = re.compile(r"(?i:secret|token|passw|passphrase|pwd|credential|auth|bearer|api|key|private|signature|session|cookie|access)", re.A)
#: Code points before a candidate in which a sensitive word must stand, and around it that count as its surroundings.
BEFORE, AROUND = 48, 2048
#: What may stand between the candidates of one run, such as the lines of a key.
GAP = re.compile(r"""[\s"'`\\,;|>#*/.+]{1,24}""")
#: The last, shorter line of a key block.
TAIL = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_=-]{1,15})(?=[ \t]*(?:\r?\n|\Z))")
END = re.compile(r"\s*-----END")
#: Least marginal compressed bytes a character of the candidate, and the share of what a random string of its alphabet and length costs that is enough if that is less.
NOVEL, SHARE = 0.7, 0.9
#: Alphabets of random strings, least first; + / _ = - count besides as they occur.
ALPHABETS = sorted((string.digits, "0123456789abcdef", "0123456789ABCDEF", string.ascii_lowercase, string.ascii_uppercase, "234567" + string.ascii_uppercase, string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase, string.ascii_letters, string.digits + string.ascii_letters), key=len)
#: Names that count besides those of the corpus.
IDENTIFIERS = "access_key access_token account admin api_key apikey auth authorization bearer client client_id client_secret config connection cookie credential database default endpoint environment function header host import instance key localhost login name null password passwd port private_key production public_key refresh_token request response return secret secret_key server service session signature string token url user username value version"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, code points, end exclusive."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novelty(candidate: str, around: str, names: str = "") -> float:
    """Marginal bytes a character: compressed size of the candidate less that of nothing, primed with its surroundings and the identifiers."""
    primer = zstandard.ZstdCompressionDict(f"{names} {IDENTIFIERS} {around}".encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=6, dict_data=primer, write_content_size=False)
    return (len(squeeze.compress(candidate.encode())) - len(squeeze.compress(b""))) / len(candidate)


@lru_cache(4096)
def random_cost(alphabet: str, length: int) -> float:
    """novelty() of random strings, their mean."""
    rng = random.Random(length)
    return sum(novelty("".join(rng.choices(alphabet, k=length)), "") for _ in range(8)) / 8


def enough(candidate: str) -> float:
    """Least novelty that makes the candidate a find."""
    signs = "".join(sorted(set(candidate.rstrip("=")) & set("+/_=-.")))
    rest = set(candidate) - set("+/_=-.")
    alphabet = next(a for a in ALPHABETS if rest <= set(a)) + signs
    n = len(candidate)
    return min(NOVEL, SHARE * random_cost(alphabet, n if n < 256 else min(1 << n.bit_length() - 1, 1 << 14)))


def unlike_words(candidate: str, around: str, names: str = "") -> bool:
    """Whether pairs of letters as common as in the surroundings and the identifiers would spell the candidate in no fewer bits than equally likely letters."""
    known, own = re.findall("[a-z]+", f"{names} {IDENTIFIERS} {around}".lower()), re.findall("[a-z]+", candidate.lower())
    one, two = Counter("".join(known)), Counter(a + b for w in known for a, b in zip(w, w[1:]))
    first, total = Counter("".join(w[:-1] for w in known)), sum(one.values())
    p = {c: (one[c] + 0.5) / (total + 13) for c in string.ascii_lowercase}
    bits = sum(-log2(p[w[0]]) - sum(log2((two[a + b] + 8 * p[b]) / (first[a] + 8)) for a, b in zip(w, w[1:])) for w in own)
    return bits >= log2(26) * sum(map(len, own))


def novel_spans(text: str, base: list[tuple[int, int, int]], names: str = "") -> list[tuple[int, int, int]]:
    """Strings outside the base spans, in a sensitive context, that stay long when compressed.

    A candidate is in the context of the one before if only a GAP parts them, so the context
    reaches over all lines of a key. One without a digit must also be unlike_words(), which
    knows a language from the surroundings alone: a long word of another language counts. Finds that only a GAP parts are one span, and a
    shorter last line belongs to a block of several lines or one closed by -----END.
    """
    out: list[tuple[int, int, int]] = []
    last, sensitive = 0, False
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        sensitive = bool(SENSITIVE.search(text, max(0, s - BEFORE), s)) or (sensitive and bool(GAP.fullmatch(text, last, s)))
        based = any(b < e and s < z for b, _, z in base)
        sensitive, last = sensitive or based, e
        if based or not sensitive:
            continue
        around = text[max(0, s - AROUND) : s] + " " + text[e : e + AROUND]
        if novelty(m[0], around, names) < enough(m[0]) or not (re.search("[0-9]", m[0]) or unlike_words(m[0], around, names)):
            continue
        joined = bool(out) and bool(GAP.fullmatch(text, out[-1][2], s))
        if joined:
            s = out.pop()[0]
        tail = TAIL.match(text, e)
        if tail and (END.match(text, tail.end()) or joined and "\n" in text[s:e]):
            if not any(b < tail.end() and tail.start(1) < z for b, _, z in base):
                e = tail.end()
        out.append((s, 3, e))
    return out


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(text: str, names: str = "") -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text."""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base, names))


def corpus_names(docs: DataFrame, most: int = MOST_NAMES, least: int = LEAST_DOCS) -> str:
    """The names that most documents assign a value to, at most `most` in order, as one string: counted over all documents, pre-aggregated in each task."""

    def count(batches):
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_pydict({"name": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
        for b in batches:
            for t in texts(b):
                held.update({m[1] for m in NAME.finditer(t)} if ":" in t or "=" in t else ())
            if len(held) > 200_000:
                yield out()
                held.clear()
        yield out()

    prepare(docs.sparkSession)
    found = docs.select("text").mapInArrow(count, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return " ".join(r.name for r in found.orderBy(F.desc("n"), "name").limit(most).collect())


def _start(names: str):
    def fn(batch: pa.RecordBatch) -> dict:
        cols = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "n_novel": []}
        for t in texts(batch):
            base, every = scan(t, names)
            kinds = [k for _, k, _ in every]
            for name, k in (("n_assign", 0), ("n_access", 1), ("n_hex", 2), ("n_novel", 3)):
                cols[name].append(kinds.count(k))
            cols["base_sha256"].append(hashlib.sha256(spell(base).encode()).hexdigest())
            cols["spans"].append(spell(every))
        return cols

    return fn


def find_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (doc_id) with n_assign, n_access, n_hex, base_sha256, spans, n_novel.

    Each row on its own: null or empty text has no spans; null ids, repeated rows and
    empty tables pass through; other columns are ignored. Texts of any length are read in whole.
    """
    names = corpus_names(docs)
    keep = keep or ["doc_id"]
    fields = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint"
    return map_rows(docs.select(*dict.fromkeys([*keep, "text"])), lambda: _start(names), fields, keep)


def mask(text: str | None, names: str = "") -> str | None:
    """The text with each span written over by its kind: [assign], [access], [hex] or [novel]."""
    if not text:
        return text
    out, at = [], 0
    for s, k, e in scan(text, names)[1]:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if at else text


def masked(docs: DataFrame) -> DataFrame:
    """docs with the same columns, secrets in `text` masked; n_chars, where there is one, is that of the new text.

    Null texts stay null, empty ones empty; null ids and repeated rows are rows like others. Empty table: no rows. Other columns pass through.
    """
    names_of = corpus_names(docs)
    schema = docs.schema
    i, names = docs.columns.index("text"), docs.columns

    def run(batches):
        for b in batches:
            old = b.column(i).to_pylist()
            new = [mask(t, names_of) for t in old]
            b = b.set_column(i, names[i], pa.array(new, b.column(i).type))
            if "n_chars" in names:
                j = names.index("n_chars")
                n = [v if a == c else len(c) for a, c, v in zip(old, new, b.column(j).to_pylist())]
                b = b.set_column(j, "n_chars", pa.array(n, b.column(j).type))
            yield b

    return docs.mapInArrow(run, schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
