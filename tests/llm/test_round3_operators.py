"""Whitening, license scans and importance resampling: edge rows, and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from quillspark.llm import importance, licenses, whitening
from quillspark.llm.bare_words import bare_words

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_row(rows):
    return sorted(map(repr, rows))


# --- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, n int, deviation int")


def test_whitening_is_numpys(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(200, 12)) @ rng.normal(size=(12, 12))
    rows = [(i, list(map(float, v))) for i, v in enumerate(m)]
    got = whitening.whiten(vectors(spark, rows), 5).toPandas()
    x = np.floor(64 * m).astype(int) + 1_000_000
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    e, u = e[::-1], u[:, ::-1]
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(wide), np.abs(c @ u[:, :5] / np.sqrt(e[:5])), atol=1e-9)
    assert np.allclose(got[got.vec_id == 0].sort_values("component").explained, e[:5] / e.sum(), rtol=1e-12)
    s = x.sum(0)
    assert got[got.component == 1].sort_values("vec_id").deviation.tolist() == [sum((200 * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    assert got.identity_error.max() < 1e-9 and set(got.n) == {200}


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0, -2.0]), (2, [0.25, 0.5, 3.0]), (2, [0.25, 0.5, 3.0]), (None, [1.0, -1.0, 0.0]), (5, [9.0, 9.0, 9.5]), (6, [0.0, 0.0, 0.0])]
    bad = [(7, None), (8, [1.0, None, 2.0]), (9, [nan, 1.0, 1.0]), (10, [1.0, inf, 1.0]), (11, [1.0, 2.0]), (12, []), (13, [1e300, 0.0, 0.0])]
    got = whitening.whiten(vectors(spark, good + bad)).collect()
    assert Counter(r.vec_id for r in got) == Counter(3 * [i for i, _ in good]) and {r.n for r in got} == {len(good)}
    assert {r.component for r in got} == {1, 2, 3} and max(r.identity_error for r in got) < 1e-9
    one = whitening.whiten(vectors(spark, [(4, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == 2 * [(4, 0, 0.0, 0.0, 0.0)]
    assert whitening.whiten(vectors(spark, [])).count() == 0 and whitening.whiten(vectors(spark, [(1, []), (2, None)])).count() == 0


def test_whitening_of_large_entries(spark):
    """Sums and products beyond a long are still exact."""
    big = 2.0**50
    rows = [(i, [big * (-1) ** i, float(i)]) for i in range(40)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert max(r.identity_error for r in got) < 1e-4 and all(r.deviation is None for r in got) and len(got) == 80


# --- license scans


def brute_scan(text):
    ws = words(text)
    base = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    labels, share = {label for _, label in base}, 1.0 if base else 0.0
    for t in licenses.templates_of(licenses.TEMPLATES):
        for at in range(0, max(1, len(ws)), t.length):
            held = len(set(ws[at : at + 2 * t.length]) & set(t.words))
            if held * 100 >= len(t.words) * licenses.THRESHOLD:
                labels.add(t.label)
                share = max(share, held / len(t.words))
    at = [i for i, _ in base]
    return len(ws), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)), share


def license_texts():
    rng = random.Random(5)
    own = [w for _, t in licenses.TEMPLATES for w in t.split()]
    out = [None, "", " \n", "CC-BY, cc by.nc 4.0", "General  PUBLIC license", "all rights reserved; All Rights\nReserved", "ALL RİGHTS RESERVED", "éé cc by", "cc", "x" * 200_000, "the " * 50_000]
    for _, t in licenses.TEMPLATES:
        ws = t.split()
        for drop in (0, 0.1, 0.25):
            kept = [w for w in ws if rng.random() >= drop]
            lead = [rng.choice(own) for _ in range(rng.randrange(90))]
            out.append(" ".join([*lead, *kept, *(rng.choice(("zz", "the", "license")) for _ in range(rng.randrange(60)))]).replace("license", "License,"))
    return out + ["the software " * 40_000 + "Released under the MIT License. " + "of the " * 1000] * 2


def test_licenses_against_brute_force(spark):
    rows = [(i if i % 7 else None, t, 1, "m") for i, t in enumerate(license_texts())]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, blocks int, label string")).collect()
    assert by_row(map(tuple, got)) == by_row((i, *brute_scan(t)) for i, t, *_ in rows)
    assert any(r.labels == "mit" for r in got) and any(r.n_base for r in got)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.license_scan(none).count() == 0


def test_filters_lose_no_block(spark):
    """Random sets over few words, where each filter is at its bound."""
    rng = random.Random(8)
    given = [(f"t{i}", " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9)))) for i in range(25)]
    rows = [(i, " ".join(rng.choice("abcdefghijklmn") for _ in range(rng.randrange(40)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scanned, found = licenses.scan(docs, given)
    got = {(r.doc_id, r.length, r.block, r.template, r.held) for r in found.join(scanned.select("rid", "doc_id"), "rid").collect()}
    want = set()
    for i, text in rows:
        ws = text.split()
        for t in licenses.templates_of(given):
            for at in range(0, len(ws), t.length):
                held = len(set(ws[at : at + 2 * t.length]) & set(t.words))
                if held >= t.needs:
                    want.add((i, t.length, at // t.length, t.number, held))
    assert got == want and want


# --- importance resampling


def brute_resample(docs, target):
    def grams(text):
        ws = words(text)
        return [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in grams(t))
    t = Counter(bucket(f) for x in target for f in grams(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows = []
    for i, text in docs:
        fs = grams(text)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


def corpus(n=130):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 5))) for _ in range(60)] + ["É", "ß9", "日本"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    docs = [(i, text(rng.randrange(60)).title()) for i in range(n)]
    docs += [(7, docs[7][1]), (None, text(30)), (None, text(30)), (500, None), (501, ""), (502, "--- !"), (503, "one"), (504, text(60_000)), (505, "same " * 40_000)]
    return docs, [text(40), None, "", text(5), "É É É"]


def test_resampling_against_brute_force(spark, monkeypatch):
    docs, target = corpus()
    frame = spark.createDataFrame([(i, t, 5, 1) for i, t in docs], "doc_id long, text string, score long, rank long").repartition(5)
    other = spark.createDataFrame([(t,) for t in target], "text string")
    want = by_row(brute_resample(docs, target))
    assert by_row(map(tuple, importance.resample(frame, other).collect())) == want
    monkeypatch.setattr(importance, "BLOCK_BYTES", 700)
    monkeypatch.setattr(importance, "SHARD_BYTES", 50_000)
    assert by_row(map(tuple, importance.resample(frame, other).collect())) == want


def test_resampling_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs, _ = corpus(40)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert importance.resample(none, frame).count() == 0
    assert by_row(map(tuple, importance.resample(frame, none).collect())) == by_row(brute_resample(docs, []))
    same = spark.createDataFrame([(None, "w " * 30)] * 90, "doc_id long, text string")
    assert sorted(r["rank"] for r in importance.resample(same, none).collect() if r["rank"]) == [1, 2, 3, 4]


def test_a_string_is_hashed_and_packed_whole():
    block = importance.Block([b"a b a", b"", b"A-b c \xc3\xa9"])
    assert [x[0].to_pylist() for x in block.grams()][::2] == [[b"a\n", b"b\n", b"c\n", b"\xc3\xa9\n"], [b"a b a\n", b"a b c\n", b"b c \xc3\xa9\n"]]
    few = [(s.to_pylist(), k.tolist(), n.tolist()) for s, k, n in block.counted()]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(importance, "BITS", 1)
        assert [(s.to_pylist(), k.tolist(), n.tolist()) for s, k, n in block.counted()] == few
    got = Counter()
    for _, blob in block.shards(3):
        for s, n in zip(*importance.unpacked(blob)):
            got[s.as_py()[:-1]] += int(n)
    assert got == Counter({b"a": 3, b"b": 2, b"c": 1, b"\xc3\xa9": 1, b"a b": 2, b"b a": 1, b"b c": 1, b"c \xc3\xa9": 1, b"a b a": 1, b"a b c": 1, b"b c \xc3\xa9": 1})
    assert bare_words("É_x\x00Yß".encode()) == ["É".encode(), b"x", "yß".encode()]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["op12_license_scan", "op13_importance_resampling"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    other = con.sql(entry.oracle_sql()[name])
    mine = entry.queries()[name](spark, DATA)
    assert by_row(map(tuple, mine.select(*other.columns).collect())) == by_row(other.fetchall())
