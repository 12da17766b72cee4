"""SentencePiece encoding and decoding, with a max-plus scan over the chunks of giant documents.

Texts of up to ``CHUNK`` characters are encoded as they are. A longer one is cut every ``CHUNK`` characters, in the middle
of words or of runs without any white space. A boundary's states are the pieces that may cover the character before it.
Each chunk yields a matrix from the states of its left boundary to those of its right one: the summed scores of the path
between them, or minus infinity. Matrices combine by max-plus products, which are associative: ``FAN`` neighbours are
multiplied by a task, their products again, until a document has one matrix, which gives the states at its ends; the way
back down gives the states inside each group of ``FAN``. Then every chunk is backtraced on its own between its two states.
No task holds more than ``FAN`` matrices or one chunk.

The public model merges pairs (BPE), so its segmentation is not the best-scored one, and paths carry the constraint that
makes them its own: a piece may follow another only if merging the two from characters leaves exactly these two. Every
text has one path that obeys this, the one that merging finds, because merges on either side of a lasting seam do not
depend on what lies beyond it. A transition that breaks the rule weighs minus infinity. Where a space follows other
text, no piece of the vocabulary crosses (this is checked when the model is loaded), so all paths meet there: the stretch
between the first and last such place of a chunk is encoded by the library, whose pieces' scores count like the others,
and its matrix is an outer sum.

Decoding goes through the ids ``DECODE`` at a time, with a decoder that holds a character cut in two, and drops the space
that the encoder put first.

A null text is encoded as empty: no ids. As in the library, U+2581 stands for the space and comes back as one. Repeated
rows give equal results of their own; columns other than the id are not needed. An empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

#: Characters of a chunk; longer texts are scanned.
CHUNK = 1 << 15
#: Matrices that a task multiplies.
FAN = 64
#: Ids that are decoded together.
DECODE = 1 << 14
MARK = "▁"
NEVER = float("-inf")


class Model:
    """A public BPE model: pieces, scores, and which pieces may be neighbours."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        kinds = [(i, lib.id_to_piece(i)) for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i))]
        self.byte = {int(p[3:5], 16): i for i, p in kinds if lib.is_byte(i)}
        self.piece = {p: i for i, p in kinds if not lib.is_byte(i)}
        self.score = {p: lib.get_score(i) for p, i in self.piece.items()}
        self.longest = max(map(len, self.piece))
        if any(MARK in p.lstrip(MARK) for p in self.piece):
            raise ValueError("pieces of this model cross from text to a space; its chunks have no safe places")
        self.score_of = np.zeros(lib.get_piece_size())
        for p, i in self.piece.items():
            self.score_of[i] = self.score[p]
        self.bytes_of = [b""] * lib.get_piece_size()
        for p, i in self.piece.items():
            self.bytes_of[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        self.follows = functools.lru_cache(1 << 18)(self._follows)
        self.whole = functools.lru_cache(1 << 16)(self._whole)

    def merge(self, text: str) -> list[str]:
        """The pieces that merging leaves of a short text: the best-scored pair first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            pairs = [(self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score]
            if not pairs:
                return parts
            k = -max(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _whole(self, piece: str) -> bool:
        """Whether merging makes this piece of its characters; a character outside the vocabulary is one by itself."""
        return len(piece) == 1 or (piece in self.score and self.merge(piece) == [piece])

    def _follows(self, a: str, b: str) -> bool:
        return self.merge(a + b) == [a, b]

    def weight(self, piece: str) -> float:
        return self.score.get(piece, 0.0)

    def ids(self, piece: str) -> list[int]:
        i = self.piece.get(piece)
        return [i] if i is not None else [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def segment(self, marked: str) -> list[int]:
        """Ids of a stretch that starts with a space and follows other text or nothing: the library adds that space."""
        return self.library.encode(marked[1:]) if marked else []

    def decode_parts(self, ids):
        """The text of a document's ids, part by part."""
        table, text = self.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")
        for a in range(0, len(ids), DECODE):
            part = text.decode(b"".join([table[i] for i in ids[a : a + DECODE]]), a + DECODE >= len(ids))
            yield part if a else part[1:]

    def decode(self, ids) -> str:
        return "".join(self.decode_parts(ids))


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """This worker's model."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def states(m: Model, s: str, at: int, base: int, final: bool) -> list[tuple[int, int]]:
    """Pieces ``(begin, end)`` that may cover the character before ``at``, in positions of the document. ``s`` is the
    document from ``base`` on, with ``longest`` characters around the boundary. At the end of the text (``final``) they
    end there; at its start there is one empty state."""
    if at == 0:
        return [(0, 0)]
    out = []
    for begin in range(max(0, at - m.longest, base), at):
        for end in range(at, (at if final else min(begin + m.longest, base + len(s))) + 1):
            if end - begin <= m.longest and m.whole(s[begin - base : end - base]):
                out.append((begin, end))
    return out


class Chunk:
    """Characters ``[a, b)`` of a marked document, with ``longest`` more on both sides in ``s`` (from ``base``)."""

    def __init__(self, m: Model, s: str, base: int, a: int, b: int, n: int):
        self.m, self.s, self.base, self.a, self.b, self.n = m, s, base, a, b, n
        self.left = states(m, s, a, base, False)
        self.right = states(m, s, b, base, b == n)
        self.cuts = self._safe()

    def text(self, begin: int, end: int) -> str:
        return self.s[begin - self.base : end - self.base]

    def _safe(self) -> tuple[int, int] | None:
        """First and last place of the chunk where a space follows other text, behind what left states may cover."""
        low, high = self.a + self.m.longest, self.b - 1
        part = self.text(low - 1, high + 1) if low <= high else ""
        first = next((low + k for k in range(len(part) - 1) if part[k + 1] == MARK and part[k] != MARK), None)
        if first is None:
            return None
        last = next(low + k for k in range(len(part) - 2, -1, -1) if part[k + 1] == MARK and part[k] != MARK)
        return first, last

    def walk(self, begin: int, before: str, end: int) -> dict[int, tuple[int, float]]:
        """``end of piece -> (its begin, score so far)`` of the paths from ``begin``, where ``before`` was the last
        piece, to past ``end``."""
        m, found = self.m, {begin: (-1, 0.0)}
        limit = self.base + len(self.s)
        for p in range(begin, end):
            if p not in found:
                continue
            q, total = found[p]
            last = before if q < 0 else self.text(q, p)
            for e in range(p + 1, min(p + m.longest, limit) + 1):
                piece = self.text(p, e)
                if m.whole(piece) and (not last or m.follows(last, piece)):
                    value = total + m.weight(piece)
                    if e not in found or found[e][1] < value:
                        found[e] = (p, value)
        return found

    def matrix(self) -> np.ndarray:
        out = np.full((len(self.left), len(self.right)), NEVER)
        if self.cuts:
            first, last = self.cuts
            tail = self.walk(last, "", self.b)
            ends = np.array([tail[e][1] if tail.get(e, (None,))[0] == s else NEVER for s, e in self.right])
            heads = np.array([self.walk(e, self.text(s, e), first).get(first, (0, NEVER))[1] for s, e in self.left])
            middle = float(self.m.score_of[self.m.segment(self.text(first, last))].sum())
            return heads[:, None] + middle + ends[None, :]
        for k, (s, e) in enumerate(self.left):
            if e > self.b:
                if (s, e) in self.right:
                    out[k, self.right.index((s, e))] = 0.0
                continue
            found = self.walk(e, self.text(s, e), self.b)
            for j, (t, f) in enumerate(self.right):
                if (t, f) == (s, e):
                    out[k, j] = 0.0
                elif found.get(f, (None,))[0] == t:
                    out[k, j] = found[f][1]
        return out

    def path(self, begin: int, before: str, end: int) -> list[int]:
        found, ids = self.walk(begin, before, end), []
        while end != begin:
            p = found[end][0]
            ids[:0] = self.m.ids(self.text(p, end))
            end = p
        return ids

    def backtrace(self, left: int, right: int) -> list[int]:
        """Ids of the pieces that end behind the left state's and with the right state's."""
        (s, e), (_, f) = self.left[left], self.right[right]
        if f == e:
            return []
        if not self.cuts:
            return self.path(e, self.text(s, e), f)
        first, last = self.cuts
        return self.path(e, self.text(s, e), first) + self.m.segment(self.text(first, last)) + self.path(last, "", f)


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Max-plus product of transfer matrices."""
    return (x[:, :, None] + y[None]).max(1)


def products(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of neighbouring matrices."""
    return functools.reduce(product, matrices)


def ends(matrix: np.ndarray) -> tuple[int, int]:
    """The states at both ends of the path of greatest weight."""
    best = np.unravel_index(matrix.argmax(), matrix.shape)
    if matrix[best] == NEVER:
        raise ValueError("no path through the document")
    return int(best[0]), int(best[1])


def inside(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """The state at every boundary of neighbouring matrices, of the best path between the two outer states."""
    best = [matrices[0][first]]
    for m in matrices[1:]:
        best.append((best[-1][:, None] + m).max(0))
    out = [last]
    for k in range(len(matrices) - 1, 0, -1):
        out.append(int((best[k - 1] + matrices[k][:, out[-1]]).argmax()))
    return [first, *out[::-1]]


def scan(matrices: list[np.ndarray], fan: int = FAN) -> list[int]:
    """The state at every boundary, first to last, of the path of greatest weight: up a tree of products and down again."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        levels.append([products(levels[-1][a : a + fan]) for a in range(0, len(levels[-1]), fan)])
    states = list(ends(levels[-1][0]))
    for level in levels[-2::-1]:
        parts = [inside(level[k * fan : (k + 1) * fan], a, b) for k, (a, b) in enumerate(zip(states, states[1:], strict=False))]
        states = [parts[0][0], *(x for part in parts for x in part[1:])]
    return states


MATRIX = "uid long, k long, rows long, matrix binary"
PLACED = "uid long, k long, from long, to long"


def _matrices(group: pa.Table) -> tuple[list[int], list[np.ndarray]]:
    at = sorted(group.to_pylist(), key=lambda r: r["k"])
    return [r["k"] for r in at], [np.frombuffer(r["matrix"]).reshape(r["rows"], -1) for r in at]


def place(matrices: DataFrame, path: str) -> DataFrame:
    """``uid, k, from, to``: the states on both sides of every chunk, from the matrices ``uid, k, rows, matrix``."""
    fan = FAN

    def up(group: pa.Table) -> pa.Table:
        ks, found = _matrices(group)
        x = products(found)
        return pa.table({"uid": group.column("uid").slice(0, 1), "k": pa.array([ks[0] // fan], pa.int64()), "rows": pa.array([x.shape[0]], pa.int64()), "matrix": pa.array([x.tobytes()], pa.binary())})

    def top(batches):
        for b in batches:
            for r in b.to_pylist():
                a, z = ends(np.frombuffer(r["matrix"]).reshape(r["rows"], -1))
                yield pa.RecordBatch.from_pydict({"uid": [r["uid"]], "k": [r["k"]], "from": pa.array([a], pa.int64()), "to": pa.array([z], pa.int64())})

    def down(group: pa.Table, outer: pa.Table) -> pa.Table:
        ks, found = _matrices(group)
        states = inside(found, outer.column("from")[0].as_py(), outer.column("to")[0].as_py())
        return pa.table({"uid": group.column("uid"), "k": pa.array(ks, pa.int64()), "from": pa.array(states[:-1], pa.int64()), "to": pa.array(states[1:], pa.int64())})

    over = F.floor(F.col("k") / fan).cast("long")
    levels = [matrices]
    while (levels[-1].agg(F.max("k").alias("k")).first()["k"] or 0) > 0:
        grouped = levels[-1].groupBy("uid", over.alias("over"))
        levels.append(common.table(grouped.applyInArrow(up, MATRIX), f"{path}/products{len(levels)}"))
    states = levels[-1].mapInArrow(top, PLACED)
    for level in levels[-2::-1]:
        states = level.groupBy("uid", over.alias("over")).cogroup(states.groupBy("uid", F.col("k").alias("over"))).applyInArrow(down, PLACED)
    return states


def _chunks(docs: DataFrame, longest: int, chunk: int) -> DataFrame:
    """``uid, doc_id, k, a, b, n, base, s`` of texts longer than a chunk."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("k", "a", "b", "n", "base")], ("s", pa.string())])

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = MARK + text.as_py().replace(" ", MARK)
                uid += 1
                for k, a in enumerate(range(0, len(s), chunk)):
                    e, base = min(a + chunk, len(s)), max(0, a - longest)
                    yield pa.RecordBatch.from_pylist([{"uid": uid, "doc_id": doc_id, "k": k, "a": a, "b": e, "n": len(s), "base": base, "s": s[base : e + longest]}], schema)

    return docs.mapInArrow(run, "uid long, doc_id long, k long, a long, b long, n long, base long, s string")


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_chunks, n_tokens, ids`` per row of ``docs``; ``path`` is the model's file."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    shape = "doc_id long, n_chunks long, n_tokens long, ids array<int>"

    def small(batches):
        m = model(path)
        for b in batches:
            for part in common.slices(b, common.byte_sizes(b.column(1)), 2 << 20):
                ids = m.encode(part.column(1).to_pylist())
                sizes = [len(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([1] * len(ids), pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "n_chunks", "n_tokens", "ids"])

    direct = rows.where(F.length("text") < chunk).mapInArrow(small, shape)
    folder = common.workdir(spark, "pieces")
    n_parts = common.shuffle_partitions(spark)
    with common.settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="64"):
        chunks = common.table(_chunks(rows.where(F.length("text") >= chunk), model(path).longest, chunk).repartition(n_parts, "uid", "k"), f"{folder}/chunks")

    def piece(m: Model, r: dict) -> Chunk:
        return Chunk(m, r["s"], r["base"], r["a"], r["b"], r["n"])

    def transfer(batches):
        m = model(path)
        for b in batches:
            for r in b.to_pylist():
                x = piece(m, r).matrix()
                yield pa.RecordBatch.from_pydict({"uid": [r["uid"]], "k": [r["k"]], "rows": pa.array([x.shape[0]], pa.int64()), "matrix": [x.tobytes()]})

    matrices = common.table(chunks.mapInArrow(transfer, MATRIX), f"{folder}/matrices")
    placed = place(matrices, folder)

    def trace(batches):
        m = model(path)
        for b in batches:
            for r in b.to_pylist():
                ids = piece(m, r).backtrace(r["from"], r["to"])
                yield pa.RecordBatch.from_arrays([pa.array([r["uid"]]), pa.array([r["doc_id"]], pa.int64()), pa.array([r["k"]]), pa.array([ids], pa.list_(pa.int32()))], names=["uid", "doc_id", "k", "ids"])

    traced = chunks.join(placed, ["uid", "k"]).select("uid", "doc_id", "k", "a", "b", "n", "base", "s", "from", "to").mapInArrow(trace, "uid long, doc_id long, k long, ids array<int>")
    whole = traced.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n_chunks"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x.ids)).alias("ids"))
    giant = common.table(whole.select("doc_id", "n_chunks", F.size("ids").cast("long").alias("n_tokens"), "ids"), f"{folder}/giant")
    return direct.unionByName(giant)


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_chunks, n_tokens, ids_crc32, decoded_sha256``: every text encoded, and decoded again from its ids.

    ``ids_crc32`` is over the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` over the text in UTF-8.
    """

    def run(batches):
        m = model(path)
        for b in batches:
            ids = b.column(3)
            flat, cuts = ids.flatten().to_numpy().astype("<u4"), np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            parts = [flat[a:e] for a, e in zip(cuts, cuts[1:], strict=False)]
            hashed = [hashlib.sha256() for _ in parts]
            for h, x in zip(hashed, parts, strict=True):
                for text in m.decode_parts(x.tolist()):
                    h.update(text.encode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64()), pa.array([h.hexdigest() for h in hashed])], names=["doc_id", "n_chunks", "n_tokens", "ids_crc32", "decoded_sha256"])

    return encode(docs, path, doc_id, text, chunk).mapInArrow(run, "doc_id long, n_chunks long, n_tokens long, ids_crc32 long, decoded_sha256 string")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_sentencepiece_scan(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` with the public 32,000-piece model."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), model_path())
