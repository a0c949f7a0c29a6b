"""Token-ID / binary output: shard files of ids as shuffled byte or bit planes, with a chunk index.

File: magic, then chunks of at most BLOCK ids (per plane a length and a zstandard
frame), then a footer with the chunk index (offset, ids, crc32) and the documents
(id, has id, ids), then the footer's place and the magic again. All little-endian.
A reader needs the footer and only the chunks that a range of ids touches.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import make_dir, prepare, save, scratch, table

MAGIC = b"QTOKENS1"
BLOCK, SHARD_IDS = 1 << 16, 1 << 22
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Most remembered pieces of text in each of two generations, and the longest kept.
CACHE_ROWS, CACHE_LONGEST = 350_000, 48
#: Lower-case Latin words without anything that normalization could change.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """32-bit ids -> 4 byte planes or 32 bit planes (bit i of all ids, packed)."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little", count=n) for p in planes], 1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def write_shard(docs: list[tuple[int | None, bytes]], kind: str = "byte", block: int = BLOCK, level: int = 3) -> bytes:
    """docs: (id, its ids as little-endian u32 bytes) in order."""
    z = zstandard.ZstdCompressor(level=level)
    ids = np.frombuffer(b"".join(b for _, b in docs), "<u4")
    out, index, at = [MAGIC], [], len(MAGIC)
    for s in range(0, len(ids), block):
        part = ids[s : s + block]
        frames = [z.compress(p) for p in to_planes(part, kind)]
        chunk = b"".join(struct.pack("<I", len(f)) + f for f in frames)
        index.append((at, len(part), zlib.crc32(part.tobytes())))
        out.append(chunk)
        at += len(chunk)
    table_ = np.array([(-1 if d is None else d, d is not None, len(b) // 4) for d, b in docs], "<i8").reshape(-1, 3)
    foot = struct.pack("<BIQQ", 4 if kind == "byte" else 32, block, len(index), len(docs)) + np.array(index, "<u8").tobytes()
    foot += z.compress(table_.tobytes())
    return b"".join([*out, foot, struct.pack("<Q", at), MAGIC])


class Shard:
    """Reads a shard file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a token shard")
        self.data, at = data, struct.unpack("<Q", data[-16:-8])[0]
        self.planes, self.block, chunks, docs = struct.unpack_from("<BIQQ", data, at)
        at += struct.calcsize("<BIQQ")
        self.index = np.frombuffer(data, "<u8", chunks * 3, at).reshape(-1, 3)
        self.docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at + chunks * 24 : -16], max_output_size=max(1, docs * 24)), "<i8").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.docs[:, 2])])

    def chunk(self, k: int) -> np.ndarray:
        at, n, crc = (int(x) for x in self.index[k])
        z, planes = zstandard.ZstdDecompressor(), []
        for _ in range(self.planes):
            (m,) = struct.unpack_from("<I", self.data, at)
            planes.append(z.decompress(self.data[at + 4 : at + 4 + m]))
            at += 4 + m
        ids = from_planes(planes, n)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the shard, from the chunks they touch."""
        if start >= stop:
            return np.zeros(0, "<u4")
        a, b = start // self.block, (stop - 1) // self.block
        return np.concatenate([self.chunk(k) for k in range(a, b + 1)])[start - a * self.block : stop - a * self.block]


class Encoder:
    """Whole texts to ids by the tokenizers library.

    This tokenizer drops white space, lowers case and joins nothing across ASCII white space,
    so the pieces between are encoded once and remembered, in two generations of bounded size
    that live as long as the worker. Plain words are one token of its pre-tokenizer each, so many are
    encoded in one call and told apart by the end-of-word mark of their last ids; a full stop
    or comma after a letter is a token of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.new, self.old = Tokenizer.from_file(path), {b"": b""}, {}
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.signs = {x: self.one(chr(x)) for x in b".,"}

    def one(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode_new(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that aren't remembered."""
        out, signed, plain, odd = {}, [], set(), []
        for p in pieces:
            core = p
            if p[-1] in self.signs and len(p) > 1 and 97 <= p[-2] <= 122:
                core = p[:-1]
                signed.append(p)
                v = self.new.get(core) or self.old.get(core)
                if v is not None:
                    out[core] = v
                    continue
            if (core.isalpha() and core.islower()) or PLAIN.fullmatch(core.decode()):
                plain.add(core)
            else:
                odd.append(core)
        plain = list(plain)
        for s in range(0, len(plain), 2000):
            part = plain[s : s + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            at = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(at) == len(part):
                raw = ids.tobytes()
                out.update(zip(part, [raw[i:j] for i, j in zip([0, *at], at)]))
            else:
                odd += part
        out.update(zip(odd, [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)]))
        for p in signed:
            out[p] = out[p[:-1]] + self.signs[p[-1]]
        return out

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, remembered or new."""
        if len(self.new) > CACHE_ROWS:
            self.new, self.old = {b"": b""}, self.new
        found = list(map(self.new.get, pieces))
        gaps = [k for k, v in enumerate(found) if v is None]
        if gaps:
            fill = {p: v for k in gaps if (v := self.old.get(p := pieces[k])) is not None}
            fill |= self.encode_new([pieces[k] for k in gaps if pieces[k] not in fill])
            for k in gaps:
                found[k] = fill[pieces[k]]
            self.new.update((p, v) for p, v in fill.items() if len(p) <= CACHE_LONGEST)
        return found

    def __call__(self, column: pa.Array) -> list[bytes]:
        """Ids of each text of a binary column without nulls. Pieces are cut, told apart and put back by Arrow, so Python sees each distinct one of a batch once."""
        text = column.view(pa.string())
        lower = pc.ascii_lower(text)
        # A mark of a special token may be written in capitals, when it isn't one.
        marked = pc.match_substring(text, "<|")
        if pc.any(marked).as_py():
            lower = pc.if_else(marked, text, lower)
        cut = pc.ascii_split_whitespace(lower)
        coded = cut.flatten().dictionary_encode()
        known = pa.array(self.ids_of(coded.dictionary.view(pa.binary()).to_pylist()), pa.large_binary())
        whole = known.take(coded.indices)
        ends = np.frombuffer(whole.buffers()[1], "<i8")[whole.offset : whole.offset + len(whole) + 1]
        at = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
        raw = whole.buffers()[2]
        view = memoryview(raw) if raw is not None else b""
        return [bytes(view[s:e]) for s, e in zip(at, at[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for a worker process, kept over its tasks. Its long lists hold no cycles, so the collector looks at them seldom."""
    gc.set_threshold(200_000, 20, 20)
    return Encoder(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def put(uri: str, data: bytes) -> None:
    """Write under another name first, then move: a repeated or parallel attempt leaves the same whole file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def write_token_files(docs: DataFrame, out_dir: str, end_id: int = END_ID, kind: str = "byte", block: int = BLOCK, shard_ids: int = SHARD_IDS, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write shards in ascending doc_id order (null ids first, equal ids by a digest of the text); returns the manifest (part, seq, file, n_docs, n_ids, n_bytes, base).

    Null text: empty, so only the end id. Repeated rows stay separate documents. Empty
    table: no shards. A shard closes when it holds shard_ids ids. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    make_dir(spark, out_dir)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        encode = encoder(tokenizer_path(tokenizer))

        def flush():
            nonlocal seq, held, size
            data = write_shard(held, kind, block)
            name = f"part-{part:06d}-{seq:06d}.tok"
            put(f"{out_dir}/{name}", data)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "n_docs": pa.array([len(held)], pa.int64()), "n_ids": pa.array([size], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64())})
            seq, held, size = seq + 1, [], 0
            return row

        for b in batches:
            for d, ids in zip(b.column(0).to_pylist(), encode(b.column(1))):
                held.append((d, ids + end))
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    manifest = save(rows.mapInArrow(run, "part int, seq int, file string, n_docs bigint, n_ids bigint, n_bytes bigint"), "manifest")
    upto = Window.unboundedPreceding, Window.currentRow
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    parts = parts.select("part", (F.sum("part_ids").over(Window.orderBy("part").rowsBetween(*upto)) - F.col("part_ids")).alias("part_base"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*upto)) - F.col("n_ids")
    return manifest.withColumn("inside", inside).join(parts, "part").withColumn("base", F.col("part_base") + F.col("inside")).drop("inside", "part_base")


def read_token_files(spark: SparkSession, out_dir: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files that the manifest lists.

    Null ids come back as null, repeated documents as often as they were written. An empty manifest: no rows.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(out_dir).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                shard = Shard(data.as_py())
                held = {}
                crcs = []
                for s, e in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist()):
                    crc = 0
                    for k in range(s // shard.block, (e - 1) // shard.block + 1):
                        if k not in held:
                            held = {k: shard.chunk(k)}
                        crc = zlib.crc32(held[k][max(0, s - k * shard.block) : e - k * shard.block].tobytes(), crc)
                    crcs.append(crc)
                ids = shard.docs
                yield pa.RecordBatch.from_pydict({
                    "name": pa.array([name] * len(ids), pa.string()), "doc_id": pa.array(ids[:, 0], pa.int64(), mask=ids[:, 1] == 0),
                    "inside": pa.array(shard.starts[:-1], pa.int64()), "n_tokens": pa.array(ids[:, 2], pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    docs = files.mapInArrow(run, "name string, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint")
    at = manifest.select(F.col("file").alias("name"), "base")
    return docs.join(at, "name").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    manifest = write_token_files(table(spark, sf_dir, "documents"), out)
    return read_token_files(spark, out, manifest)
