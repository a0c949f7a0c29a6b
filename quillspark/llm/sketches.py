"""Document fingerprints: a threshold-scaled sketch of word shingles, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import table

WIDTH = 5
#: One shingle hash in so many is kept: those in the lowest part of the 64-bit range.
SCALE = 4
SPACE = " \t\n\x0b\x0c\r"
#: Rows a range of doc_id should hold, and the most ranges whose bounds the driver handles: beyond that ranges are longer, and Spark
#: sorts and reads them through disk. A range of one id, or of none, that is SPLIT times as long is parted by hashes of the texts.
RANGE_ROWS, MOST_RANGES, FAN, SPLIT = 64, 65536, 256, 4


def word_hashes(text: F.Column) -> F.Column:
    """xxhash64 of each word; null or blank text: an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(wh: F.Column, width: int = WIDTH) -> F.Column:
    """Hashes of runs of `width` words from a column of word hashes; a shorter text is one shingle."""
    n = F.size(wh)
    runs = F.transform(F.slice(wh, 1, F.greatest(n - (width - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *(F.get(wh, i + k) for k in range(1, width))))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, F.array(F.xxhash64(wh))).otherwise(runs)


def retained(shingles: F.Column, scale: int = SCALE) -> F.Column:
    """The sketch: distinct hashes below the fixed threshold, sorted. Sketches merge by union."""
    return F.array_sort(F.array_distinct(F.filter(shingles, lambda h: h < F.lit(-(2**63) + 2**64 // scale))))


def with_sketch(df: DataFrame, text: str, out: str, scale: int = SCALE) -> DataFrame:
    """Adds `out` (sketch) and `out`_tag: for a text whose sketch came out empty, a digest of all its shingles, else null."""
    df = df.withColumn(f"__w_{out}", word_hashes(F.col(text)))
    df = df.withColumn(f"__s_{out}", shingle_hashes(F.col(f"__w_{out}"))).withColumn(out, retained(F.col(f"__s_{out}"), scale))
    tag = F.when((F.size(out) == 0) & (F.size(f"__s_{out}") > 0), F.hex(F.xxhash64(f"__s_{out}")))
    return df.withColumn(f"{out}_tag", tag).drop(f"__w_{out}", f"__s_{out}")


def fingerprint(sketch: str) -> F.Column:
    """Comma-joined hex of the kept hashes; `-` and the tag where none was kept; empty for a text without words."""
    body = F.array_join(F.transform(F.col(sketch), lambda h: F.lower(F.hex(h))), ",")
    return F.when(F.col(f"{sketch}_tag").isNotNull(), F.concat(F.lit("-"), F.lower(f"{sketch}_tag"))).otherwise(body)


def shared(a: str, b: str) -> F.Column:
    return F.size(F.array_intersect(F.col(a), F.col(b)))


def same(a: str, b: str) -> F.Column:
    return (F.col(a) == F.col(b)) & F.col(f"{a}_tag").eqNullSafe(F.col(f"{b}_tag"))


def containment(a: str, b: str) -> F.Column:
    """Estimated share of the smaller text's shingles that the other has: 1 for equal sketches, 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(same(a, b), F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(shared(a, b) / least)


def jaccard(a: str, b: str) -> F.Column:
    both = F.size(a) + F.size(b) - shared(a, b)
    return F.when(same(a, b), F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(shared(a, b) / both)


def id_ranges(ids: DataFrame) -> tuple[list[int], DataFrame]:
    """Bounds of about equal ranges of doc_id: at most FAN coarse ones as a list, and the fine ones within as a table."""
    spark = ids.sparkSession
    n = max(1, min(MOST_RANGES, ids.count() // RANGE_ROWS))
    cuts = sorted({int(x) for x in ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n))}) if n > 1 else []
    step = max(1, -(-len(cuts) // FAN))
    coarse = cuts[::step]
    rows = [(0, [])] + [(i + 1, cuts[i * step + 1 : (i + 1) * step]) for i in range(len(coarse))]
    return coarse, spark.createDataFrame([(i, i * (step + 1), f) for i, f in rows], "coarse int, first int, fine array<bigint>")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, and likeness to the edited text's and the next document's.

    Next: ascending doc_id, null ids last, equal ids by a hash of the text, then the text; after the last the first.
    A single row is its own next. Null text: empty. A text without words has the empty
    fingerprint; two such are alike (1.0). Repeated rows are rows each. Empty table: no rows. Other columns are ignored.
    Texts move in one shuffle by range of doc_id; the range bounds are computed first, so a
    lost task is redone with the same ones.
    """
    hashed = F.shiftrightunsigned(F.xxhash64("text"), 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", hashed)
    coarse, fine = id_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null"))
    at = F.size(F.filter(F.array(*map(F.lit, coarse)).cast("array<bigint>"), lambda b: b <= F.col("doc_id")))
    ids_in = lambda df: (df.withColumn("coarse", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at)).join(F.broadcast(fine), "coarse", "left")
                         .withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(2**31 - 1)).otherwise(F.col("first") + F.size(F.filter("fine", lambda b: b <= F.col("doc_id"))))).drop("coarse", "first", "fine"))
    length = max(RANGE_ROWS, docs.count() // MOST_RANGES)
    whole = F.when(F.min("doc_id").eqNullSafe(F.max("doc_id")), F.ceil(F.count("*") / length)).otherwise(F.lit(1)).cast("long")
    long_ = ids_in(rows.select("doc_id")).groupBy("range").agg(F.count("*").alias("n"), whole.alias("parts")).where(F.col("n") > SPLIT * length).select("range", "parts").where("parts > 1")
    many = F.broadcast(long_)  # a row for each range, MOST_RANGES + 2 at most
    part = F.shiftright(F.shiftright("hash", 32) * F.coalesce("parts", F.lit(1).cast("long")), 31).cast("int")
    placed = lambda df: ids_in(df).join(many, "range", "left").withColumn("part", part).drop("parts")
    order = Window.orderBy("range", "part")
    last = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = placed(rows.select("doc_id", "hash")).groupBy("range", "part").agg(F.min(F.struct("doc_id", "hash")).alias("f"))
    here = F.struct("range", "part")
    firsts = firsts.withColumn("of", F.coalesce(F.lag(here).over(order), F.max(here).over(last))).select("of", F.col("f.doc_id").alias("first_id"), F.col("f.hash").alias("first_hash"))
    firsts = F.broadcast(firsts)  # a row for each part, 2 * MOST_RANGES + 2 at most
    heads = rows.join(firsts, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))).groupBy("of").agg(F.min("text").alias("head"))
    heads = with_sketch(heads, "head", "head_sk").select(F.col("of.range").alias("hr"), F.col("of.part").alias("hp"), "head", "head_sk", "head_sk_tag")
    main = with_sketch(placed(rows).repartition("range", "part"), "text", "sk")  # texts move alone, sketches are made after
    w = Window.partitionBy("range", "part").orderBy(F.col("doc_id").asc_nulls_last(), "hash", "text")
    main = main.withColumn("nx", F.lead(F.struct("text", "sk", "sk_tag")).over(w))
    main = main.join(heads, (F.col("range") == F.col("hr")) & (F.col("part") == F.col("hp")), "left")
    head = F.struct(F.col("head").alias("text"), F.col("head_sk").alias("sk"), F.col("head_sk_tag").alias("sk_tag"))
    main = main.withColumn("nx", F.coalesce("nx", head)).select("doc_id", "text", "sk", "sk_tag", F.col("nx.text").alias("next_text"), F.col("nx.sk").alias("next_sk"), F.col("nx.sk_tag").alias("next_sk_tag"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    main = main.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    main = with_sketch(main, "edited", "ed")
    return main.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("sk").alias("fingerprint"), fingerprint("ed").alias("edited_fingerprint"),
                       containment("sk", "ed").alias("near_edited"), containment("sk", "next_sk").alias("near_next"), jaccard("sk", "ed").alias("jaccard_edited"), jaccard("sk", "next_sk").alias("jaccard_next"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
