"""Stored queries give what each of them gives alone."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import query as Q
from quillspark.plans import percolate as percolation
from quillspark.plans.percolate import nodes_of, percolate, trees
from quillspark.plans.search import Corpus, matches

ASKED = ["a", "a b", "+a -b", '"a b" c', "(a OR d) AND c", "+(c -b) +x", '+"b c" -(d OR "c a")', "body:a", "rel_path:2", "absent", "+absent a", "((a AND (b OR c)) OR x) -y", "a AND b AND c"]


def test_as_each_alone(spark):
    rows = [(str(i), str(i), b, b.split()[0]) for i, b in enumerate(("a b c", "a b", "b c a-b", "c", "x a b y", "d c", "c x", "a a a"))]
    c = Corpus.of(spark.createDataFrame(rows, "doc_id string, rel_path string, body string, summary string"))
    asked = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(ASKED)] + [("blank", " "), ("null", None)], "query string, text string")
    got = {tuple(r) for r in percolate(c, trees(asked)).collect()}
    want = {(f"q{i}", r.doc_id) for i, t in enumerate(ASKED) for r in matches(c, Q.understand(t)).collect()}
    assert got == want and len(got) == percolate(c, trees(asked)).count()


def test_size_of_the_plan(spark):
    """It doesn't grow with the queries."""
    c = Corpus.of(spark.createDataFrame([("1", "1", "a b", "")], "doc_id string, rel_path string, body string, summary string"))
    plan = lambda n: percolate(c, trees(spark.range(n).select(F.col("id").alias("query"), F.concat(F.lit("+a -w"), "id").alias("text")), ("body",)))._jdf.queryExecution().optimizedPlan().toString()
    assert abs(len(plan(10)) - len(plan(1000))) < 200


def test_what_cannot_be_stored():
    for text in ("*", "body:[a TO b]", '"a b"~2'):
        with pytest.raises(Q.QueryError):
            nodes_of(Q.parse(text))


def test_batches_of_documents(spark, monkeypatch):
    """Several batches of documents and passes of queries, phrases of three words, words of 40 bytes and more; nothing is shuffled but what the result is grouped by."""
    letters = "abcdx"
    body = lambda i: " ".join(letters[(i * 7 + j * j * (1 + i % 3)) % 5] for j in range(i % 9))
    rows = [(str(i), str(i), body(i) + " " + "y" * (38 + i % 4), "") for i in range(150)] + [("none", "none", None, "")]
    c = Corpus.of(spark.createDataFrame(rows, "doc_id string, rel_path string, body string, summary string").repartition(2))
    texts = [*ASKED, '"a b c"', '"a b a" OR "x a"', '+"b a c" -d', "y" * 39, "y" * 40, "a OR " + "y" * 41, "-a"]
    asked = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query string, text string")
    want = sorted((f"q{i}", r.doc_id) for i, t in enumerate(texts) for r in matches(c, Q.understand(t)).collect())
    for nodes in (percolation.MOST_NODES, 20):
        monkeypatch.setattr(percolation, "MOST_NODES", nodes)
        got = percolate(c, trees(asked))
        assert sorted(tuple(r) for r in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" not in plan and "Join" not in plan
