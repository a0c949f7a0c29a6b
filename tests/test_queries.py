"""Each query with SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.operators import index
from quillspark.plans import queries as engine

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    mine = entry.queries()[name](spark, DATA).toPandas()
    other = con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(other.columns)
    rows = lambda x: sorted(map(str, x[cols].astype(object).where(x[cols].notna(), None).values.tolist()))
    assert rows(mine) == rows(other)


@pytest.mark.parametrize("name", sorted(engine.QUERIES.keys() - engine.SQL.keys()))
def test_runs(spark, name):
    assert engine.QUERIES[name](spark, DATA).count() >= 0


def test_lines_are_normalized_once(spark):
    """No expression stands in the plan more often than it is needed: 92 regular expressions before, with those of the filter."""
    plan = engine.md_line_normalize(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") + plan.lower().count("rlike") < 40


def test_words_are_counted_where_they_are_read(spark):
    """As occurrences give them, rows that share an id together, long words left out; words of other rows make no row of a shuffle each."""
    rows = [(1, "a b a"), (2, "b " + "y" * 39), (2, "b c"), (3, ""), (4, None), (None, "a c"), (None, "a"), (5, "z" * 40 + " a é")]
    d = spark.createDataFrame(rows, "doc_id long, body string").repartition(3)
    per = index.postings(d, ("body",)).select("term", "doc_id", F.col("tf").cast("long"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(index.term_counts(d, "body")) == key(per)
    assert key(index.term_stats(d, ("body",)).select("term", "df", "cf")) == key(per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
    plan = index.term_counts(d.where("doc_id > 2"), "body")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan


def test_blocks_without_a_row_for_each_word(spark):
    """Entries as postings give them; a word and range of a batch is a row, so the plan has no row for each word."""
    rows = [(f"{i:03d}", f"p{i:03d}", " ".join("abcd"[(i * j) % 4] for j in range(i % 7)) + " " + "y" * (38 + i % 4), "") for i in range(300)]
    d = index.ranged(spark.createDataFrame(rows, "doc_id string, rel_path string, body string, summary string")).localCheckpoint()
    fields = ("body", "summary", "rel_path")
    b = index.blocks(d, fields)
    flat = b.select("field", "term", F.inline(F.arrays_zip("ids", "tfs", "dls", "positions"))).toDF("field", "term", "doc_id", "tf", "dl", "positions")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(flat) == key(index.postings(d, fields).select(*flat.columns))
    assert b.groupBy("field", "term", "range").count().where("count > 1").isEmpty()
    assert "posexplode" not in b._jdf.queryExecution().optimizedPlan().toString()
