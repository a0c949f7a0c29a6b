"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Keys are uniform, so equal ranges of the key's
first 12 bits are a range partitioning that is balanced by construction, however
hot a source is; each (source, range) is sorted on its own, and prefix sums are
put together from the ranges' totals. Each source is cut at its exact budget:
whole epochs first, then rows in key order, the last one only in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, save, table

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def word_count(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(skey, source_size) -> + weight, target, budget. One row a source.

    Shares of the whole by weight; a target above cap times its source's size stops
    there, and its excess goes to the others by weight: the level at which the
    targets fill the total is found from prefix sums in order of cap/weight.
    """
    by_name, by_level = Window.orderBy("skey"), Window.orderBy(F.col("level"), F.col("skey"))
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("place")).cast("long")
    s = sizes.withColumn("place", (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).withColumn("weight", w)
    s = s.withColumn("most", F.col("source_size") * cap).withColumn("level", F.col("most").cast("double") / F.col("weight"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (s.withColumn("total", F.sum("source_size").over(whole))
         .withColumn("cap_before", F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("most"))
         .withColumn("weight_from", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    s = s.withColumn("capped", F.col("most") * F.col("weight_from") <= (F.col("total") - F.col("cap_before")) * F.col("weight"))
    s = (s.withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(whole), F.lit(0)))
         .withColumn("open", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)))
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("left").cast("double") / F.col("open") * F.col("weight"))
    s = s.withColumn("target", target).withColumn("budget", F.least(F.col("most"), F.floor(F.col("target") + 0.5)).cast("long"))
    return s.select("skey", "source_size", "weight", "target", "budget")


def identity() -> tuple[F.Column, F.Column, F.Column]:
    """(id and text, source key, digest of all three) of a row; the first and the last tell rows apart that aren't equal."""
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.lit("|"), F.md5(F.coalesce("text", F.lit(""))))
    skey = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    return own, skey, F.md5(F.concat_ws("|", own, skey))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, epochs, part, mkey) for each row.

    taken = epochs * size + part: the row goes in whole `epochs` times and once more
    with its first `part` words (0 for most rows). mkey is a digest of id, source and text that
    tells rows apart; equal rows share it. Keys come from id and text, so rows of one id, null too, lie apart. Null source: a source of its own, last.
    Null or empty text: size 0, taken 0. Repeated
    rows are separate rows with the same key, and which of two equal ones comes first
    doesn't show. Empty table: no rows. Other columns are ignored. Texts of any length count in whole.
    Sources are numbered and their targets worked out in one task: a row for each source, not for each document.
    """
    own, skey, mkey = identity()
    base = docs.select("doc_id", skey.alias("skey"), word_count(F.col("text")).alias("size"), F.md5(F.concat(F.lit(f"{seed}|"), own)).alias("key"), mkey.alias("mkey"))
    base = save(base, "mix").withColumn("range", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    ranges = base.groupBy("skey", "range").agg(F.sum("size").alias("range_size"))
    before = F.sum("range_size").over(Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("range_size")
    ranges_at = ranges.select(F.col("skey").alias("rs"), F.col("range").alias("rr"), before.alias("before"))
    targets = source_targets(ranges.groupBy("skey").agg(F.sum("range_size").alias("source_size")), weights, cap).withColumnRenamed("skey", "ts")
    inside = Window.partitionBy("skey", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "mkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = base.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(ranges_at, (rows.skey == ranges_at.rs) & (rows.range == ranges_at.rr)).join(targets, F.col("skey") == F.col("ts"))
    some = F.col("source_size") > 0
    epochs = F.when(some, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("epochs", epochs)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before") - F.col("inside")
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest)).cast("long"))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).alias("taken")
    return rows.select("doc_id", "size", "source_size", "target", taken, "epochs", "part", "mkey")


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The mixture itself: docs' rows with docs' columns, each as often as the mix takes it.

    A row whose last copy is cut keeps that copy's first `part` words with the white
    space before them. Rows that are equal in id, source and text get their takes
    summed and dealt out as whole copies of one of them. n_chars, where there is one,
    is that of the new text. Null and empty texts, which have no words, go as often as their source has whole epochs. Null ids and
    sources are rows like others. Empty table: no rows. docs may hold columns of any names.
    """
    inner = {c: c if c in ("doc_id", "source", "text", "n_chars") else f"c{i}" for i, c in enumerate(docs.columns)}
    docs_ = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in inner.items()))
    plan = mix(docs_, **settings).groupBy("mkey").agg(F.sum("epochs").alias("e"), F.sum("part").alias("p"), F.max("size").alias("s"), F.count("*").alias("n"))
    plan = save(plan, "mix-plan")
    repeated = plan.where("n > 1").limit(1).count() > 0
    plan = plan.where("e > 0 or p > 0")
    whole = F.col("e") + F.when(F.col("s") > 0, F.floor(F.col("p") / F.col("s"))).otherwise(F.lit(0))
    plan = plan.select("mkey", whole.cast("int").alias("w"), F.when(F.col("s") > 0, F.col("p") % F.col("s")).otherwise(F.lit(0)).cast("int").alias("cut"))
    equal = docs_.withColumn("mkey", identity()[2])
    if repeated:
        equal = equal.dropDuplicates(["mkey"])
    copies = F.filter(F.concat(F.when(F.col("w") > 0, F.array_repeat(F.lit(-1), F.col("w"))).otherwise(F.array().cast("array<int>")), F.array("cut")), lambda x: x != 0)
    out = equal.join(plan, "mkey").withColumn("take", F.explode(copies))
    pieces = F.split(F.col("text"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("take") > 0, F.array_join(F.slice(pieces, 1, F.greatest(F.col("take"), F.lit(1))), "")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("take") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(k).alias(c) for c, k in inner.items()))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents),
s0 AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY skey),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS most FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () AS total,
         sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / weight, skey ROWS UNBOUNDED PRECEDING) - most AS cap_before,
         sum(weight) OVER (ORDER BY CAST(most AS DOUBLE) / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from FROM s1),
s3 AS (SELECT *, most * weight_from <= (total - cap_before) * weight AS capped FROM s2),
s4 AS (SELECT *, total - coalesce(sum(CASE WHEN capped THEN most END) OVER (), 0) AS rest, sum(CASE WHEN NOT capped THEN weight END) OVER () AS open FROM s3),
s5 AS (SELECT skey, source_size, most, CASE WHEN capped THEN CAST(most AS DOUBLE) ELSE CAST(rest AS DOUBLE) / CAST(open AS DOUBLE) * weight END AS target FROM s4),
s6 AS (SELECT *, CAST(least(most, floor(target + 0.5)) AS BIGINT) AS budget FROM s5),
r AS (SELECT base.*, CAST(sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before FROM base)
SELECT r.doc_id, r.size, s6.source_size, s6.target,
  CAST(CASE WHEN s6.source_size > 0 THEN (s6.budget // s6.source_size) * r.size
    + greatest(0, least(r.size, s6.budget - (s6.budget // s6.source_size) * s6.source_size - r.before)) ELSE 0 END AS BIGINT) AS taken
FROM r JOIN s6 USING (skey)
"""
