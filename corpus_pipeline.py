"""A training corpus from `documents`: five stages, each written as Parquet and reread by the next.

quality drops documents above their language's perplexity threshold; near_duplicates keeps
the document with the least id of each group; secrets masks what it finds; mixture takes
documents as often as the source weights say; pieces encodes what is left.
All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import save, table
from quillspark.llm.mixing import mixed_rows
from quillspark.llm.near_dups import near_duplicates, row_id, text_hash
from quillspark.llm.quality import kept
from quillspark.llm.secrets import masked
from quillspark.llm.sentencepieces import encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold, all columns kept. Null and empty texts, nulls elsewhere, repeated rows and empty tables: as kept() says."""
    return kept(docs, table(spark, sf_dir, "labels"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row with the least id (then the least hash of its text) of each class; one of equal rows; docs' columns, whatever their names.

    Rows without words (null, empty or blank text) are classes of their own and all stay, but for
    repeats of an id. A null id counts as a hash of its text. Empty table: no rows.
    """
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    marked = docs.select(row_id().alias("r"), text_hash().alias("h"), *(F.col(f"`{c}`").alias(k) for c, k in inner.items()))
    flags = near_duplicates(docs.select("doc_id", "text", row_id().alias("r"), text_hash().alias("h")), keep=["r", "h"])
    flags = save(flags.groupBy("class_id", "r", "h").agg(F.count("*").alias("n")), "pipeline-flags")
    stay = flags.groupBy("class_id").agg(F.min(F.struct("r", "h")).alias("x")).select("x.r", "x.h").distinct()
    out = marked.join(stay, ["r", "h"], "left_semi")
    if flags.where("n > 1").limit(1).count():
        out = out.dropDuplicates(["r", "h"])
    return out.select(*(F.col(k).alias(c) for c, k in inner.items()))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (one_of_each). Documents without near copies all stay."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with what the scan finds masked (masked); rows without findings are unchanged."""
    return masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: rows as often as it takes them, the last one of a source in part (mixed_rows)."""
    return mixed_rows(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text; the last stage, so it returns its own columns (encode)."""
    return encode(docs, with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates_out), ("secrets", secrets), ("mixture", mixture), ("pieces", pieces)]

#: Neither the language model nor the n-gram join can be put in SQL; the stages' operators are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
