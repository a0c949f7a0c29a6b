"""Target-distribution importance resampling with a dictionary of distinct n-gram strings.

Blocks of texts give each distinct n-gram string with its count; strings are dealt to shards by their
words, a shard counts each string over all texts, hashes it once and sums its counts by bucket. Gains
follow from the buckets of both tables. On the documents' side a block's distinct strings are
looked up once each, and gains are joined to the documents' counts of them.
Drawing is a sort by range of the scores; ranks come from the ranges' counts.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bare_words import BARE_WORD, TABLE
from quillspark.llm.common import prepare, raw_texts, save, table

BUCKETS, WIDTH, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of text that a task counts at once (a longer text is a block by itself), and that a shard stands for.
BLOCK_BYTES, SHARD_BYTES = 12 << 20, 8 << 20
#: Bits that each word of an n-gram takes in one number.
BITS = 63 // WIDTH
#: Strings that are Python objects at once.
AT_ONCE = 100_000
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Place of a row within its partition in monotonically_increasing_id().
ROW_BITS = 33


class Block:
    """The words of some texts: `bare`, the distinct ones in order, `words`, the place among them of each, and `of`, the text that it is in."""

    def __init__(self, raws: list[bytes]):
        text = np.frombuffer(b" ".join(raws).translate(TABLE), np.uint8)
        inside = text != 32
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], np.concatenate([[0], np.cumsum(edges[1::2] - edges[::2])]).astype(np.int32)
        every = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(text[inside].tobytes())]).dictionary_encode()
        self.of = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), starts, "right").astype(np.int32)
        self.sizes = np.bincount(self.of, minlength=len(raws)).astype(np.int64)
        order = pc.sort_indices(every.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        self.bare, self.words = every.dictionary.take(order), rank[every.indices.to_numpy()]

    def grams(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """For each width: the distinct n-grams as strings that end in a new line (no word holds one), by the rank of their words; a number that follows
        from each one's words; the place among them of each run; and the text that it is of. One width is held at a time."""
        strings = pc.binary_join_element_wise(self.bare, b"", b"\n")
        ended, word = strings, crcs(strings).astype(np.uint64) * MULT
        key, run, of = word, self.words, self.of
        yield strings, key, run, of
        before, start = self.bare, np.ones(len(of), bool)
        for width in range(2, WIDTH + 1):
            here = np.zeros(len(self.of), bool)  # where a run of this width begins
            here[: max(0, len(here) - width + 1)] = self.of[: max(0, len(here) - width + 1)] == self.of[width - 1 :]
            last = self.words[np.flatnonzero(here) + width - 1]
            pairs, run = np.unique((run[here[start]] << np.int64(32)) | last, return_inverse=True)
            left, right, run = pairs >> np.int64(32), pairs & np.int64(2**32 - 1), run.ravel()
            start, of, first = here, self.of[here], before.take(pa.array(left))
            strings = pc.binary_join_element_wise(first, ended.take(pa.array(right)), b" ")
            key = (key[left] ^ (key[left] >> np.uint64(29))) * MULT + word[right]
            before = pc.binary_join_element_wise(first, self.bare.take(pa.array(right)), b" ") if width < WIDTH else None
            del first, pairs, left, right, last
            yield strings, key, run, of

    def counted(self) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """The strings of grams(), their numbers and their counts, without the places of the runs."""
        if len(self.bare) >> BITS:  # so many words don't fit into one number
            for strings, key, run, _ in self.grams():
                yield strings, key, np.bincount(run, minlength=len(strings))
            return
        ended = pc.binary_join_element_wise(self.bare, b"", b"\n")
        word = crcs(ended).astype(np.uint64) * MULT
        for width in range(1, WIDTH + 1):
            n = max(0, len(self.words) - width + 1)
            at = np.flatnonzero(self.of[:n] == self.of[width - 1 :][:n])
            runs = self.words[at]
            for k in range(1, width):
                runs = (runs << np.int64(BITS)) | self.words[at + k]
            runs, counts = np.unique(runs, return_counts=True)
            parts = [(runs >> np.int64(BITS * k)) & np.int64((1 << BITS) - 1) for k in range(width - 1, -1, -1)]
            key = word[parts[0]]
            for p in parts[1:]:
                key = (key ^ (key >> np.uint64(29))) * MULT + word[p]
            strings = pc.binary_join_element_wise(*(self.bare.take(pa.array(p)) for p in parts[:-1]), ended.take(pa.array(parts[-1])), b" ")
            del at, runs, parts
            yield strings, key, counts

    def shards(self, n: int) -> Iterator[tuple[int, bytes]]:
        """(shard, packed strings with their counts), for each width and each shard that gets some."""
        for strings, key, counts in self.counted():
            to = ((key ^ (key >> np.uint64(32))) * MULT >> np.uint64(33)).astype(np.int64) % n
            order = np.argsort(to.astype(np.uint16) if n <= 1 << 16 else to, kind="stable")
            counts, strings, ends = counts[order], strings.take(pa.array(order)), np.searchsorted(to[order], np.arange(n + 1))
            del order, to, key
            for shard in np.flatnonzero(np.diff(ends)).tolist():
                own = slice(ends[shard], ends[shard + 1])
                yield shard, packed(strings[own], counts[own])

    def sums(self, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(runs, sum of the gains of all runs' buckets) of each text. Each distinct string is hashed once."""
        n, total = np.zeros(len(self.sizes), np.int64), np.zeros(len(self.sizes), np.int64)
        for strings, _, run, of in self.grams():
            n += np.bincount(of, minlength=len(n))
            np.add.at(total, of, gain[crcs(strings) % BUCKETS][run])
        return n, total


def raw(strings: pa.Array) -> bytes:
    if not len(strings):
        return b""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return memoryview(strings.buffers()[2])[ends[0] : ends[-1]].tobytes() if ends[-1] > ends[0] else b""


def crcs(strings: pa.Array) -> np.ndarray:
    """crc32 of each string without its new line."""
    out = np.empty(len(strings), np.int64)
    for k in range(0, len(out), AT_ONCE):
        out[k : k + AT_ONCE] = list(map(zlib.crc32, raw(strings[k : k + AT_ONCE]).split(b"\n")[:-1]))
    return out


def packed(strings: pa.Array, counts: np.ndarray) -> bytes:
    """Counts by planes of bytes, most of which are zeros, and the strings."""
    planes = counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return struct.pack("<q", len(counts)) + zstandard.ZstdCompressor(level=5).compress(planes + raw(strings))


def unpacked(blob: bytes) -> tuple[pa.Array, np.ndarray]:
    (n,) = struct.unpack_from("<q", blob)
    data = zstandard.ZstdDecompressor().decompress(blob[8:])
    counts = np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n).reshape(8, n).T).view("<i8").ravel()
    ends = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8, offset=8 * n) == 10) + 1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[8 * n :])]), counts


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Rows of a task in blocks of about `most` bytes of text."""
    held, raws, size = [], [], 0
    for b in batches:
        at = 0
        for k, raw in enumerate(own := raw_texts(b)):
            size += len(raw)
            if size >= most:
                yield [*held, b.slice(at, k + 1 - at)], raws + own[at : k + 1]
                held, raws, size, at = [], [], 0, k + 1
        if at < len(b):
            held.append(b.slice(at))
            raws += own[at:]
    if held:
        yield held, raws


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Runs in each bucket over all rows' `text`. At most BUCKETS rows reach the driver."""
    prepare(texts.sparkSession)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-size // SHARD_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raws in blocks(batches, BLOCK_BYTES):
            for shard, blob in Block(raws).shards(n):
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "blob": pa.array([blob], pa.binary())})

    def gather(group: pa.Table) -> pa.Table:
        parts = [unpacked(b.as_py()) for b in group.column("blob")]
        counted = pa.table({"s": pa.chunked_array([s for s, _ in parts]), "n": np.concatenate([c for _, c in parts])}).group_by("s").aggregate([("n", "sum")])
        held = np.zeros(BUCKETS, np.int64)
        for s, c in zip(counted["s"].chunks, counted["n_sum"].chunks):
            np.add.at(held, crcs(s) % BUCKETS, c.to_numpy())
        some = np.flatnonzero(held)
        del parts, counted
        pa.default_memory_pool().release_unused()
        return pa.table({"bucket": some, "n": held[some]})

    dealt = texts.select("text").mapInArrow(deal, "shard long, blob binary")
    rows = dealt.groupBy("shard").applyInArrow(gather, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_features, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, raws in blocks(batches, BLOCK_BYTES):
            block = Block(raws)
            n, weight = block.sums(gain)
            ids = pa.concat_arrays([b.column(0) for b in held])
            pa.default_memory_pool().release_unused()
            for k in range(0, len(ids), 10_000):
                s = slice(k, k + 10_000)
                yield pa.RecordBatch.from_arrays([ids[s], *map(pa.array, (block.sizes[s], n[s], weight[s]))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED) -> F.Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """rows + rank of those drawn: sorted by range, a range's rows numbered where they lie, and what stands in the ranges before added."""
    rows = rows.withColumn("fit", F.col("n_words") >= least_words).withColumn("tie", F.monotonically_increasing_id())
    rows = save(rows, "weighed")  # the tie stays the same from here on
    drawn = rows.where("fit").count() * percent // 100
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), "tie"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    laid = save(laid, "ranked").withColumn("range", F.shiftright("at", ROW_BITS))
    before, starts = 0, []
    for r in sorted(laid.groupBy("range").count().collect()):  # a row for each partition
        starts.append((r["range"], before))
        before += r["count"]
    starts = laid.sparkSession.createDataFrame(starts or [(0, 0)], "range long, before long")
    rank = F.col("before") + F.col("at") - F.shiftleft("range", ROW_BITS) + 1
    out = laid.join(F.broadcast(starts), "range")
    return out.withColumn("rank", F.when(F.col("fit") & (rank <= drawn), rank))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs; target: rows with `text`.

    Null and empty texts have no features: weight 0, never drawn. A null id hashes as an empty string and sorts last; repeated rows are
    rows each, and of rows equal in all that is returned any comes first. Texts count in whole; other columns are ignored. Empty table: no rows; empty
    target: all gains come from docs alone.
    """
    prepare(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = weighed(docs, gain).withColumn("score", F.col("weight") + noise(seed))
    return ranked(rows, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BARE_WORD}')"
_GRAMS = "list_transform(ws, lambda w, i: w) || list_transform(ws[2:], lambda w, i: ws[i] || ' ' || w) || list_transform(ws[3:], lambda w, i: ws[i] || ' ' || ws[i + 1] || ' ' || w)"
_CRC_ROW = "list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, x)"
#: Bytes as numbers from the hexadecimal form, through the usual table made by its rule.
_CRC = "xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT), lambda c, b: xor(tab[xor(c & 255, b) + 1], c >> 8), 4294967295::BIGINT), 4294967295)"
OP13_SQL = rf"""
WITH tabs AS (SELECT list_transform(range(256), lambda x: {_CRC_ROW}) AS tab),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT {_WORDS} AS ws FROM benchmark),
df AS (SELECT rid, f, count(*) AS n FROM (SELECT rid, unnest({_GRAMS}) AS f FROM d) GROUP BY rid, f),
bf AS (SELECT f, count(*) AS n FROM (SELECT unnest({_GRAMS}) AS f FROM b) GROUP BY f),
dictionary AS MATERIALIZED (SELECT f, ({_CRC}) % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf), tabs),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN dictionary USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bf JOIN dictionary USING (f) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM df) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM bf) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM df JOIN dictionary USING (f) JOIN gain USING (bucket) GROUP BY rid),
scored AS (SELECT rid, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8))::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (rid)),
drawn AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 5 // 100 FROM drawn) THEN rank END AS rank FROM scored LEFT JOIN drawn USING (rid)
"""
