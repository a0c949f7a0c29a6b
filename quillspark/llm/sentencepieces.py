"""SentencePiece encoding and decoding by a max-plus scan over boundary states.

The model is a BPE one. A sequence of pieces is the library's encoding exactly if
encoding each two neighbours alone gives those two back, so encoding is a best path:
an edge is a piece, a step between neighbours that don't agree weighs minus infinity,
any other -1, and just one path is left. States at a cut of the text are the pieces that
end at it or cross it. A chunk yields its transfer matrix between the states of its two cuts;
matrices combine by the max-plus product, which is associative, so they are combined up a tree of
FAN children a node, the states at the cuts come down it again, and
with them each chunk is traced back on its own. No piece holds white space after
another character, so such a place is a cut with one state: short texts are cut there
alone, and equal words share one trace.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import map_rows, prepare, save, table, texts

MODEL = "piece_bpe_32k.model"
GIANT, CHUNK, FAN = 1 << 16, 1 << 14, 8
SPACE = "▁"
WORDS_KEPT, PAIRS_KEPT = 300_000, 500_000
#: States before the first piece and after the last.
FIRST, LAST = (0, 0, None), "end"
State = tuple


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """One for a worker process, kept over its tasks."""
    return Pieces(path)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The model's vocabulary, encoder and decoder. Tokens within are ids, or -1 - code point for a character that isn't in it."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.name != "identity" or any(p.type == 4 for p in proto.pieces):
            raise ValueError("a BPE model without normalization or user-defined pieces is expected")
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.text = [p.piece if p.type == 1 else "" for p in proto.pieces]
        self.surface = [p.piece.replace(SPACE, " ").encode() if p.type == 1 else bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else b"" for p in proto.pieces]
        self.longest = max(map(len, self.id))
        self.prefixes = {p[:k] for p in self.id for k in range(1, len(p) + 1)}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces with white space inside")
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}  # stretches after a white space, without it, in two generations
        self.old: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.adjacent = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}

    def merge(self, s: str) -> list[str]:
        """BPE by its definition: join the best-scored neighbours, leftmost first, until none is a piece."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = self.score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def agree(self, a: int | None, b: int) -> bool:
        """May b follow a?"""
        if a is None or a < 0 or b < 0:
            return True
        k = a * 65536 + b
        ok = self.pairs.get(k)
        if ok is None:
            if len(self.pairs) > PAIRS_KEPT:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            ok = self.pairs[k] = (y[0] == SPACE and x[-1] != SPACE) or self.merge(x + y) == [x, y]
        return ok

    @lru_cache(maxsize=65536)  # noqa: B019
    def agree_alone(self, piece: str) -> bool:
        return self.merge(piece) == [piece]

    def paths(self, text: str, start: int, prev: int | None, stop: int, cross: bool) -> dict[int, tuple[int, int]]:
        """End -> (token, its start) of the pieces reached from `start` after `prev`; pieces start before stop and end by it, or cross it."""
        got: dict[int, tuple[int, int]] = {}
        ids, prefixes, pairs = self.id, self.prefixes, self.pairs
        most = len(text) if cross else stop
        for i in range(start, stop):
            if i == start:
                p = prev
            elif i in got:
                p = got[i][0]
            else:
                continue
            j = i + 1
            t = ids.get(text[i])
            if t is None:
                got[j] = (-1 - ord(text[i]), i)
            while j <= most:
                piece = text[i:j]
                if piece not in prefixes:
                    break
                t = ids.get(piece)
                if t is not None and j not in got:
                    if p is None or p < 0:
                        ok = self.agree_alone(piece)
                    else:
                        ok = pairs.get(p * 65536 + t)
                        if ok is None:
                            ok = self.agree(p, t) and self.agree_alone(piece)
                            pairs[p * 65536 + t] = ok
                    if ok:
                        got[j] = (t, i)
                j += 1
        return got

    def trace(self, got: dict[int, tuple[int, int]], end: int, start: int) -> list[int]:
        out = []
        while end > start:
            t, end = got[end]
            out.append(t)
        return out[::-1]

    def spell(self, tokens: list[int]) -> list[int]:
        """Tokens -> ids: characters outside the vocabulary become their UTF-8 bytes."""
        out = []
        for t in tokens:
            if t >= 0:
                out.append(t)
            else:
                out += [self.byte.get(b, self.unknown) for b in chr(-1 - t).encode("utf-8", "surrogatepass")]
        return out

    def word(self, w: str) -> bytes:
        """Ids (little-endian u32) of a stretch of the normalized text between two cuts with one state."""
        got = self.paths(w, 0, None, len(w), False)
        ids = self.spell(self.trace(got, len(w), 0))
        return struct.pack(f"<{len(ids)}I", *ids)

    def begin(self, part: str) -> bytes:
        """Ids of a white space and the unbroken stretch after it. A last sign that no piece holds after the character before it is cut off: a state of its own."""
        if len(part) > 1 and part[-1] in ".,;:!?|" and part[-2:] not in self.adjacent:
            core = part[:-1]
            v = self.words.get(core) or self.old.get(core)
            if v is None:
                v = self.words[core] = self.word(SPACE + core)
            return v + self.sign(part[-1])
        return self.word(SPACE + part)

    def sign(self, c: str) -> bytes:
        if c not in self.signs:
            self.signs[c] = self.word(c)
        return self.signs[c]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian u32 bytes: each stretch between white space is traced on its own."""
        if not text:
            return b""
        parts = text.split(" ")
        if "" in parts or SPACE in text:
            return b"".join(map(self.word, stretches(normalized(text))))
        if len(self.words) > WORDS_KEPT:
            self.words, self.old = {}, self.words
        words = self.words
        found = list(map(words.get, parts))
        try:
            return b"".join(found)
        except TypeError:  # some stretch isn't known
            k = -1
            try:
                while True:
                    k = found.index(None, k + 1)
                    p = parts[k]
                    v = words.get(p) or self.old.get(p) or self.begin(p)
                    found[k] = v
                    if len(p) <= 64:
                        words[p] = v
            except ValueError:
                return b"".join(found)

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.surface.__getitem__, memoryview(ids).cast("I")))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")

    # Giant texts: chunks of the normalized text. `text` has up to `longest` characters before place p and after place q.

    def states(self, text: str, p: int) -> list[State]:
        """(start - p, end - p, token) of the pieces that end at p or cross it."""
        out = []
        for s in range(max(0, p - self.longest), p):
            if s == p - 1 and text[s] not in self.id:
                out.append((-1, 0, -1 - ord(text[s])))
            for e in range(p, min(len(text), s + self.longest) + 1):
                t = self.id.get(text[s:e])
                if t is not None and self.agree_alone(text[s:e]):
                    out.append((s - p, e - p, t))
        return out

    def cuts(self, text: str, p: int, q: int) -> list[int]:
        """Places strictly within the chunk that have one state."""
        return [m.start() for m in _CUT.finditer(text, p + 1, q) if text[m.start() - 1] != SPACE]

    def transfer(self, text: str, p: int, q: int, first: bool, last: bool) -> dict[tuple, int]:
        """(state at p, state at q) -> weight of the best path, absent for minus infinity."""
        cuts = self.cuts(text, p, q)
        starts = [FIRST] if first else self.states(text, p)

        def ends(start: int, prev: int | None) -> dict[State, int]:
            got = self.paths(text, start, prev, q, not last)
            return {(LAST if last else (s - q, e - q, t)): -self.steps(got, e, start) for e, (t, s) in got.items() if (e == q if last else e >= q)}

        out = {}
        if not cuts:
            for a in starts:
                if not last and p + a[1] >= q:
                    out[a, (a[0] + p - q, a[1] + p - q, a[2])] = 0
                    continue
                if last and p + a[1] == q:
                    out[a, LAST] = 0
                    continue
                out.update(((a, b), w) for b, w in ends(p + a[1], a[2]).items())
            return out
        middle = -sum(len(self._ids(w)) for w in stretches(text[cuts[0] : cuts[-1]])) if cuts[-1] > cuts[0] else 0
        tail = ends(cuts[-1], None)
        for a in starts:
            e = p + a[1]
            if e == cuts[0]:
                head = 0
            else:
                got = self.paths(text, e, a[2], cuts[0], False)
                if cuts[0] not in got:
                    continue
                head = -self.steps(got, cuts[0], e)
            out.update(((a, b), head + middle + w) for b, w in tail.items())
        return out

    def steps(self, got: dict, end: int, start: int) -> int:
        return len(self.trace(got, end, start))

    def _ids(self, w: str) -> list[int]:
        return self.trace(self.paths(w, 0, None, len(w), False), len(w), 0)

    def chunk(self, text: str, p: int, q: int, a: State, b: State) -> list[int]:
        """The ids of the pieces that start in the chunk, between its two states."""
        start = p + a[1]
        end = q if b == LAST else q + b[1]
        if start >= q:
            return []
        cuts = self.cuts(text, p, q)
        if not cuts:
            return self.spell(self.trace(self.paths(text, start, a[2], q, b != LAST), end, start))
        tokens = self.trace(self.paths(text, start, a[2], cuts[0], False), cuts[0], start) if start < cuts[0] else []
        for w in stretches(text[cuts[0] : cuts[-1]]):
            tokens += self._ids(w)
        tokens += self.trace(self.paths(text, cuts[-1], None, q, b != LAST), end, cuts[-1])
        return self.spell(tokens)


_CUT = re.compile(SPACE)
_STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def stretches(normal: str) -> list[str]:
    return _STRETCH.findall(normal)


def normalized(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def product(a: dict[tuple, int], b: dict[tuple, int]) -> dict[tuple, int]:
    """Max-plus product of two transfer matrices."""
    by: dict = {}
    for (y, z), w in b.items():
        by.setdefault(y, []).append((z, w))
    out: dict[tuple, int] = {}
    for (x, y), v in a.items():
        for z, w in by.get(y, ()):
            if v + w > out.get((x, z), -(1 << 62)):
                out[x, z] = v + w
    return out


def settle(matrices: list[dict[tuple, int]], begin: State = FIRST, end: State = LAST) -> list[tuple[State, State]]:
    """The states at both cuts of each matrix on the best path from `begin` to `end`."""
    upto = [{begin: 0}]
    for m in matrices:
        upto.append({z: w for (_, z), w in product({(begin, y): v for y, v in upto[-1].items()}, m).items()})
    at, out = end, []
    for m, before in zip(reversed(matrices), reversed(upto[:-1])):
        came = max((before[x] + w, repr(x), x) for (x, z), w in m.items() if z == at and x in before)[2]
        out.append((came, at))
        at = came
    return out[::-1]


def tree_states(leaves: DataFrame, fan: int = FAN) -> DataFrame:
    """(uid, k, matrix) -> (uid, k, states): products of `fan` neighbours, level by level, up to one matrix a text; then from the root down, each node's states to its children.

    A group is `fan` matrices, so no task holds a whole text's, and the levels grow with the logarithm of its chunks.
    """
    levels = [leaves]
    parent = F.floor(F.col("k") / fan).cast("int")

    def combine(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        m, *rest = map(_unpack, group.column("matrix").to_pylist())
        for x in rest:
            m = product(m, x)
        return pa.table({"uid": group.column("uid")[:1], "k": group.column("up")[:1], "matrix": pa.array([_pack(m)], pa.binary())})

    while levels[-1].where("k > 0").limit(1).count():
        up = levels[-1].withColumn("up", parent)
        levels.append(save(up.groupBy("uid", "up").applyInArrow(combine, "uid bigint, k int, matrix binary"), f"piece-level-{len(levels)}"))

    def deal(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        states = settle([_unpack(m) for m in group.column("matrix").to_pylist()], *_unpack(group.column("outer")[0].as_py()))
        return pa.table({"uid": group.column("uid"), "k": group.column("k"), "states": pa.array([_pack(s) for s in states], pa.binary())})

    whole = _pack((FIRST, LAST))
    states = levels[-1].select("uid", "k", F.lit(whole).alias("states"))
    for level in reversed(levels[:-1]):
        outer = states.select("uid", F.col("k").alias("up"), F.col("states").alias("outer"))
        states = level.withColumn("up", parent).join(outer, ["uid", "up"]).groupBy("uid", "up").applyInArrow(deal, "uid bigint, k int, states binary")
    return states


def split(text: str, longest: int, size: int = CHUNK) -> list[tuple[str, int, int, bool, bool]]:
    """Chunks of the normalized text with what stands around them: (text, p, q, first, last)."""
    normal = normalized(text)
    out = []
    for s in range(0, len(normal), size):
        e = min(len(normal), s + size)
        lo, hi = max(0, s - longest), min(len(normal), e + longest)
        out.append((normal[lo:hi], s - lo, e - lo, s == 0, e == len(normal)))
    return out


def encode_chunked(pieces: Pieces, text: str, size: int = CHUNK) -> list[int]:
    """The scan in one process, for tests and small uses."""
    if not text:
        return []
    chunks = split(text, pieces.longest, size)
    states = settle([pieces.transfer(*c) for c in chunks])
    return [i for c, (a, b) in zip(chunks, states) for i in pieces.chunk(*c[:3], a, b)]


def _pack(m: dict[tuple, int]) -> bytes:
    import pickle

    return pickle.dumps(m)


def _unpack(b: bytes) -> dict[tuple, int]:
    import pickle

    return pickle.loads(b)


def encode(docs: DataFrame, model: str = MODEL, giant: int = GIANT, size: int = CHUNK, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip[, token_ids]) for each row.

    ids_crc32: of the ids as little-endian unsigned 32-bit integers; round_trip: decoding them
    gives the text. Null or empty text: no ids, round_trip true. Texts longer than `giant` are cut into
    chunks that are scanned and traced in different tasks. Null ids and repeated rows are rows
    like others. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fields = "n_tokens bigint, ids_crc32 bigint, round_trip boolean" + ", token_ids array<int>" * with_ids

    def small():
        pieces = pieces_of(model_path(model))

        def fn(batch):
            own = texts(batch)
            ids = [pieces.encode(t) for t in own]
            out = {"n_tokens": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids], "round_trip": [pieces.decode(x) == t for x, t in zip(ids, own)]}
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                out["token_ids"] = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), "<i4"))
            return out

        return fn

    near = map_rows(rows.where(F.length("text") <= giant), small, fields, ["doc_id"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, n, part = pieces_of(model_path(model)), 0, TaskContext.get().partitionId()
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                uid = (part << 32) + n
                n += 1
                chunks = split(t, pieces.longest, size)
                yield pa.RecordBatch.from_pydict({
                    "uid": pa.array([uid] * len(chunks), pa.int64()), "doc_id": pa.array([d] * len(chunks), pa.int64()), "k": pa.array(range(len(chunks)), pa.int32()),
                    "chunk": [c[0] for c in chunks], "p": pa.array([c[1] for c in chunks], pa.int32()), "q": pa.array([c[2] for c in chunks], pa.int32()), "first": [c[3] for c in chunks], "last": [c[4] for c in chunks], "plain": [SPACE not in t] * len(chunks)})

    big = rows.where(F.length("text") > giant).withColumn("doc_id", F.col("doc_id").cast("long"))
    chunks = save(big.mapInArrow(cut, "uid bigint, doc_id bigint, k int, chunk string, p int, q int, first boolean, last boolean, plain boolean"), "piece-chunks")
    chunks = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uid", "k")  # by number: not put together again

    def scan():
        pieces = pieces_of(model_path(model))

        def fn(batch):
            c = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("chunk", "p", "q", "first", "last")]
            return {"matrix": [_pack(pieces.transfer(*x)) for x in zip(*c)]}

        return fn

    matrices = save(map_rows(chunks, scan, "matrix binary", ["uid", "k"]), "piece-level-0")

    ready = chunks.join(tree_states(matrices), ["uid", "k"])

    def back():
        pieces = pieces_of(model_path(model))

        def fn(batch):
            c = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("chunk", "p", "q", "states", "plain")]
            out, same = [], []
            for text, p, q, s, plain in zip(*c):
                a, b = _unpack(s)
                ids = pieces.chunk(text, p, q, a, b)
                out.append(struct.pack(f"<{len(ids)}I", *ids))
                raw = b"".join(map(pieces.surface.__getitem__, ids))
                end = q if b == LAST else q + b[1]
                same.append(plain and raw == text[p + a[1] : end].replace(SPACE, " ").encode("utf-8", "surrogatepass"))
            return {"ids": out, "same": same}

        return fn

    traced = map_rows(ready, back, "ids binary, same boolean", ["uid", "doc_id", "k"])

    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        ids = b"".join(group.column("ids").to_pylist())
        out = {"doc_id": group.column("doc_id")[:1], "n_tokens": pa.array([len(ids) // 4], pa.int64()), "ids_crc32": pa.array([zlib.crc32(ids)], pa.int64()), "round_trip": pa.array([all(group.column("same").to_pylist())])}
        if with_ids:
            out["token_ids"] = pa.array([np.frombuffer(ids, "<i4").tolist()], pa.list_(pa.int32()))
        return pa.table(out)

    far = traced.groupBy("uid").applyInArrow(join, f"doc_id bigint, {fields}")
    return near.withColumn("doc_id", F.col("doc_id").cast("long")).unionByName(far)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
