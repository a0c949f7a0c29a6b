import corpus_pipeline as P
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = P.STAGES[0][1](spark, docs, DATA)
    assert first.columns == docs.columns and 0.7 * docs.count() < first.count() < docs.count()
    once = P.one_of_each(docs)
    assert once.columns == docs.columns
    assert once.select("text").distinct().count() == once.count()
    assert P.one_of_each(docs.limit(0)).count() == 0


def test_one_of_equal_rows(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(str(r.doc_id) for r in P.one_of_each(d).collect())
    assert len([x for x in got if x in ("1", "None")]) == 1 and {"2", "3"} <= set(got)


def test_run(spark):
    out = P.run(spark, DATA).cache()
    assert out.count() > 0 and out.where(~F.col("round_trip")).count() == 0


def test_stages_by_their_content(spark):
    """What the stages after the first do to rows that are made for it; clashing names; null, empty and repeated rows; empty tables."""
    from quillspark.llm.secrets import scan

    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 9 : i * 9 + 60]), "en", "ab"[i % 2], 0) for i in range(30)]
    rows += [(100, rows[3][1], "en", "a", 0), (101, rows[3][1], None, None, 0), (102, None, "en", "a", 0), (103, "", "en", None, 0), (None, rows[5][1], "en", "b", 0), (104, "w1 api_key = abcdef123456 w2", "en", "a", 0), (104, "w1 api_key = abcdef123456 w2", "en", "a", 0)]
    docs = spark.createDataFrame([(*r[:4], len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int").withColumns({"r": F.lit(1), "h": F.lit(2), "key": F.lit(3), "take": F.lit(4)})
    first, second, third, fourth, last = (f for _, f in P.STAGES)
    assert first(spark, docs, DATA).columns == docs.columns and first(spark, docs.limit(0), DATA).count() == 0
    once = second(spark, docs, DATA)
    left = sorted((str(r.doc_id), r.text or "") for r in once.collect())
    want = sorted([(str(r[0]), r[1] or "") for r in rows[:30]] + [("102", ""), ("103", ""), ("104", rows[-1][1])])
    assert once.columns == docs.columns and left == want
    hidden = third(spark, once, DATA).collect()
    assert not any(scan(r.text or "")[0] for r in hidden) and [r.text for r in hidden if r.doc_id == 104] == ["w1 [assign] w2"]
    assert [(r.n_chars, len(r.text)) for r in hidden if r.doc_id == 104] == [(14, 14)] and [r.text for r in hidden if r.doc_id == 102] == [None]
    mixed = fourth(spark, third(spark, once, DATA), DATA)
    size = {r.doc_id: len((r.text or "").split()) for r in hidden}
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len((r.text or "").split())
    assert mixed.columns == docs.columns and all(n <= 3 * size[i] for i, n in taken.items()) and abs(sum(taken.values()) - sum(size.values())) <= 3
    ids = last(spark, mixed, DATA)
    assert ids.count() == mixed.count() and ids.where(~F.col("round_trip")).count() == 0
    for f in (second, third, fourth, last):
        assert f(spark, docs.limit(0), DATA).count() == 0
