"""Token-id output: every shard is one compressed wavelet matrix with rank and select support.

Texts are encoded with a public tokenizer where they lie; the ids go to ranges of ``doc_id`` (quantiles of the ids of all
rows), are sorted there by Spark and written as shards of about ``SHARD_IDS`` ids in ascending order. A shard's file
holds the documents' ids and lengths, and one bit-plane per bit of an id: level by level, from the highest bit, the
bits in the order left by a stable partition of the level above. Planes are cut into blocks of 65,536 bits, each
compressed on its own, with the ones before each block in the header. So one file answers access, counting and
occurrence lookup by reading a block per level, and gives back the whole sequence by undoing the partitions upwards.

A null text is encoded as empty, so its document holds the end id alone. A null doc_id sorts first and stays null. Rows
that repeat a doc_id are documents of their own, ordered by the checksum of their ids. Empty tables write no shard.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm import common
from vellum.llm.storage import open_fs

#: Ids of a shard, about.
SHARD_IDS = 1 << 20
#: Documents of a range of ids, at most on average.
RANGE_ROWS = 50_000
#: Bits of a block of a plane.
BLOCK = 1 << 16
#: Distinct words whose ids a worker keeps.
MEMO = 1_000_000
MAGIC = b"VWM1"
#: Bytes of text that are encoded together, about.
BATCH_BYTES = 8 << 20
#: New words that go to the tokenizer in one call.
JOINED = 500
#: Signs that often stand behind a word.
PUNCTUATION = ".,;:!?|"
#: White space besides the space and the newline, in Python's sense or Unicode's.
OTHER_SPACE = re.compile("[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def has_runs(text: str) -> bool:
    """Whether the text has white space that may not be cut at: runs of it, at its ends, or of other kinds."""
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or bool(OTHER_SPACE.search(text))


class Encoder:
    """Ids of whole texts. Words between single spaces and newlines are encoded once and remembered.

    The tokenizer's pattern lets a piece hold a space only as its first character or in a run of white space, so a
    text without such runs may be cut before every single space and around every newline. Other texts, and texts that
    hold one of the tokenizer's added tokens, go to the tokenizer as they are. A word of letters and the punctuation
    behind it are two pieces of the pattern, so the letters are encoded without it and remembered on their own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tok = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for letters, which the pattern would leave whole
        self.plain.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.spaced = np.array([(self.tok.id_to_token(i) or "").startswith("\u0120") for i in range(self.tok.get_vocab_size())])
        self.memo: dict[str, bytes] = {}  # a word stands for itself with a space before it, or behind a newline without
        self.tails = {"": b""}
        self.newline = self.raw("\n")

    def raw(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        whole = [has_runs(t) or any(x in t for x in self.added) for t in texts]
        out: list[bytes] = [b""] * len(texts)
        some = [k for k, w in enumerate(whole) if w]
        for k, e in zip(some, self.tok.encode_batch_fast([texts[k] for k in some], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, dtype=self.dtype).tobytes()
        rest = [k for k, w in enumerate(whole) if not w]
        if rest:
            for k, ids in zip(rest, self._cut([texts[k] for k in rest]), strict=True):
                out[k] = ids
        return out

    def _cut(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that may be cut at every space and newline."""
        pieces = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        first = pieces.offsets.to_numpy()
        coded = pieces.values.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        heads = pieces.values.take(pa.array(first[:-1]))  # have no space before them: as behind a newline, without it
        words = self._words(coded.dictionary)
        known = self._words(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), heads, pa.scalar("", pa.large_string())), newline=b"")
        which[first[:-1]] = len(words) + np.arange(len(heads))
        words += known
        sizes = np.fromiter(map(len, words), np.int64, len(words)) // self.dtype.itemsize
        begins = np.cumsum(sizes) - sizes
        n = sizes[which]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(words), self.dtype)[np.repeat(begins[which] - (ends - n), n) + np.arange(ends[-1])]
        cuts = np.concatenate(([0], ends))[first].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def _words(self, words: pa.Array, newline: bytes | None = None) -> list[bytes]:
        """The ids of distinct words, each with a space before it, or behind its newline (given as ``newline``)."""
        newline = self.newline if newline is None else newline
        below = pc.starts_with(words, "\n")
        stems = pc.utf8_rtrim(words, characters=PUNCTUATION)
        letters = pc.utf8_is_alpha(pc.utf8_ltrim(stems, characters="\n"))
        keys = pc.if_else(letters, stems, words).dictionary_encode()
        names = keys.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [self.memo.get(k) for k in names]
        if None in found:
            self._learn([k for k, ids in zip(names, found, strict=True) if ids is None])
            found = [self.memo[k] for k in names]
        out = [found[k] for k in keys.indices.to_numpy(zero_copy_only=False).tolist()]
        tail = np.where(letters.to_numpy(zero_copy_only=False), pc.binary_length(words).to_numpy() - pc.binary_length(stems).to_numpy(), 0)
        ended = np.flatnonzero(tail)
        spelt = [w[-n:] for w, n in zip(words.take(pa.array(ended)).to_numpy(zero_copy_only=False).tolist(), tail[ended].tolist(), strict=True)]
        for x in set(spelt).difference(self.tails):
            self.tails[x] = self.raw(x)
        for k, x in zip(ended.tolist(), spelt, strict=True):
            out[k] += self.tails[x]
        for k in np.flatnonzero(below.to_numpy(zero_copy_only=False)).tolist() if newline else ():
            out[k] = newline + out[k]
        return out

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of new words. Letters behind a space go many to a call: the pattern parts them, and in the
        ids a word begins where a piece begins with a space."""
        letters = pc.utf8_is_alpha(pa.array(words, pa.large_string())).to_numpy(zero_copy_only=False).tolist()
        many = [w for w, is_ in zip(words, letters, strict=True) if is_]
        joined = [" " + " ".join(many[a : a + JOINED]) for a in range(0, len(many), JOINED)]
        found = [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)]
        if found:
            flat = np.concatenate(found)
            begins = (np.append(np.flatnonzero(self.spaced[flat]), len(flat)) * self.dtype.itemsize).tolist()
            raw = flat.tobytes()
            self.memo.update(zip(many, [raw[a:b] for a, b in zip(begins, begins[1:], strict=False)], strict=True))
        rest = [w for w, is_ in zip(words, letters, strict=True) if not is_]
        below = pc.utf8_is_alpha(pc.utf8_ltrim(pa.array(rest, pa.large_string()), characters="\n")).to_numpy(zero_copy_only=False).tolist()
        for tok, wanted in ((self.plain, True), (self.tok, False)):
            names = [w for w, is_ in zip(rest, below, strict=True) if is_ == wanted]
            spelt = [w[1:] if w[:1] == "\n" else " " + w for w in names]
            for w, e in zip(names, tok.encode_batch_fast(spelt, add_special_tokens=False), strict=True):
                self.memo[w] = np.array(e.ids, self.dtype).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def dump(ids: np.ndarray, bits: int, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of one shard."""
    z = zstandard.ZstdCompressor(level=1)
    body, levels, at = [], [], 0

    def put(raw: bytes) -> int:
        nonlocal at
        data = z.compress(raw)
        body.append(data)
        at += len(data)
        return at

    a, n = ids, len(ids)
    ends_docs = put(json.dumps([doc_ids, lengths]).encode())
    for level in range(bits - 1, -1, -1):
        ones = (a & a.dtype.type(1 << level)) != 0
        plane = np.packbits(ones)
        per_block = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK // 8), dtype=np.int64) if n else np.zeros(0, np.int64)
        before = [0, *np.cumsum(per_block).tolist()]
        levels.append({"ones": before, "ends": [put(plane[k : k + BLOCK // 8].tobytes()) for k in range(0, len(plane), BLOCK // 8)]})
        below = np.empty_like(a)
        np.compress(~ones, a, out=below[: n - before[-1]])
        np.compress(ones, a, out=below[n - before[-1] :])
        a = below
    head = json.dumps({"n": n, "bits": bits, "docs": ends_docs, "levels": levels}).encode()
    return MAGIC + len(head).to_bytes(8, "little") + head + b"".join(body)


class Wavelet:
    """Queries on a shard's file. ``read(offset, size)`` gives bytes of it; blocks are read when asked for."""

    def __init__(self, read):
        lead = read(0, 12)
        if lead[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int.from_bytes(lead[4:], "little")
        head = json.loads(read(12, size))
        self.read, self.base, self.n, self.bits, self.levels = read, 12 + size, head["n"], head["bits"], head["levels"]
        self.docs_end = head["docs"]
        for level, x in enumerate(self.levels):
            x["begin"] = head["docs"] if not level else (self.levels[level - 1]["ends"] or [self.levels[level - 1]["begin"]])[-1]
        self._blocks: dict[tuple[int, int], np.ndarray] = {}

    def documents(self) -> tuple[list[int | None], list[int]]:
        doc_ids, lengths = json.loads(zstandard.decompress(self.read(self.base, self.docs_end)))
        return doc_ids, lengths

    def block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._blocks:
            x = self.levels[level]
            begin = x["ends"][k - 1] if k else x["begin"]
            raw = zstandard.decompress(self.read(self.base + begin, x["ends"][k] - begin))
            self._blocks[level, k] = np.unpackbits(np.frombuffer(raw, np.uint8))
        return self._blocks[level, k]

    def ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of the plane."""
        k, r = divmod(i, BLOCK)
        return self.levels[level]["ones"][k] + (int(self.block(level, k)[:r].sum()) if r else 0)

    def zeros(self, level: int) -> int:
        return self.n - self.levels[level]["ones"][-1]

    def select(self, level: int, bit: int, r: int) -> int:
        """Position of the ``r``-th (from 0) bit of this value in the plane."""
        counts = self.levels[level]["ones"] if bit else [min(k * BLOCK, self.n) - x for k, x in enumerate(self.levels[level]["ones"])]
        k = int(np.searchsorted(counts, r, side="right")) - 1
        here = self.block(level, k)[: self.n - k * BLOCK]
        return k * BLOCK + int(np.flatnonzero(here == bit)[r - counts[k]])

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        value = 0
        for level in range(self.bits):
            k, r = divmod(i, BLOCK)
            bit = int(self.block(level, k)[r])
            value = value << 1 | bit
            one = self.ones(level, i)
            i = self.zeros(level) + one if bit else i - one
        return value

    def _range(self, value: int, begin: int, end: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self.ones(level, begin), self.ones(level, end)
            if value >> (self.bits - 1 - level) & 1:
                begin, end = self.zeros(level) + a, self.zeros(level) + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def count(self, value: int, begin: int = 0, end: int | None = None) -> int:
        """How often an id occurs in ``[begin, end)``."""
        a, b = self._range(value, begin, self.n if end is None else end)
        return b - a

    def occurrence(self, value: int, r: int) -> int:
        """Position of the ``r``-th (from 0) occurrence of an id."""
        begin, end = self._range(value, 0, self.n)
        if not 0 <= r < end - begin:
            raise IndexError(f"{value} occurs {end - begin} times")
        i = begin + r
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self.select(level, bit, i - self.zeros(level) if bit else i)
        return i

    def sequence(self) -> np.ndarray:
        """All ids: the partitions undone from the lowest bit upwards."""
        a = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            raw = b"".join(self._raw(level))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool)
            z, out = self.zeros(level), np.empty_like(a)
            out[np.flatnonzero(~ones)] = a[:z]
            out[np.flatnonzero(ones)] = a[z:] | a.dtype.type(1 << (self.bits - 1 - level))
            a = out
        return a

    def _raw(self, level: int):
        x, begin = self.levels[level], self.levels[level]["begin"]
        if x["ends"]:
            data = self.read(self.base + begin, x["ends"][-1] - begin)
            for end in x["ends"]:
                yield zstandard.decompress(data[begin - x["begin"] : end - x["begin"]])
                begin = end


def load(data: bytes) -> Wavelet:
    return Wavelet(lambda offset, size: data[offset : offset + size])


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every text, append ``end_id``, write shards under ``path``; the manifest ``path, part, seq, n_ids, start``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = max(common.shuffle_partitions(spark), -(-rows.count() // RANGE_ROWS))
    bounds = rows.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 20 * n).alias("at")).first()["at"] or []
    bounds = sorted(set(bounds))

    def encode(batches):
        enc, at = encoder(tokenizer), np.array(bounds, np.int64)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in chain.from_iterable(common.slices(x, common.byte_sizes(x.column(1)), BATCH_BYTES) for x in batches):
            ids = b.column(0).to_pylist()
            data = [x + end for x in enc.batch(b.column(1).to_numpy(zero_copy_only=False).tolist())]
            part = np.searchsorted(at, np.array([-(1 << 63) if i is None else i for i in ids], np.int64), side="left")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(part, pa.int32()), pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "part", "sum", "ids"])

    coded = rows.mapInArrow(encode, "doc_id long, part int, sum long, ids binary")
    placed = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "sum")

    def write(batches):
        fs, folder = open_fs(path)
        enc = encoder(tokenizer)
        bits = max(1, (max(enc.tok.get_vocab_size(), end_id + 1) - 1).bit_length())
        held: list[tuple[int | None, bytes]] = []
        state = {"n": 0, "part": None, "seq": 0}

        def flush():
            ids = np.frombuffer(b"".join(x for _, x in held), enc.dtype)
            data = dump(ids, bits, [i for i, _ in held], [len(x) // enc.dtype.itemsize for _, x in held])
            fs.create_dir(folder, recursive=True)
            name = f"{uuid.uuid4().hex}.wm"
            with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(data)
            row = {"path": [f"{path}/{name}"], "part": [state["part"]], "seq": [state["seq"]], "n_ids": [len(ids)]}
            held.clear()
            state.update(n=0, seq=state["seq"] + 1)
            return pa.RecordBatch.from_pydict(row, pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("n_ids", pa.int64())]))

        for b in batches:
            for i, part, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if held and (part != state["part"] or state["n"] >= shard_ids):
                    yield flush()
                state["part"] = part
                held.append((i, x))
                state["n"] += len(x) // enc.dtype.itemsize
        if held:
            yield flush()

    files = common.table(placed.mapInArrow(write, "path string, part int, seq long, n_ids long"), f"{path}.manifest")
    by_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per range
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = by_part.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(F.broadcast(begin), "part").select("path", "part", "seq", "n_ids", (F.col("begin") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("start"))


def read_shards(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and with ``with_ids`` the ``ids`` of every document of the shards."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.list_(pa.int32()))] * with_ids])

    def read(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as file:
                    shard = load(file.read())
                ids, (doc_ids, lengths) = shard.sequence().astype("<u4"), shard.documents()
                ends = np.cumsum(lengths)
                parts = [ids[e - k : e] for e, k in zip(ends, lengths, strict=True)]
                cols = [doc_ids, (start + ends - lengths).tolist(), lengths, [zlib.crc32(x.tobytes()) for x in parts], *[[x.tolist() for x in parts]] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    n = common.shuffle_partitions(manifest.sparkSession)
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_token_ids(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` as token ids in wavelet shards, read back from them."""
    path = common.workdir(spark, "ids")
    with common.settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="4000"):
        manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer_path())
    return read_shards(manifest, with_ids=False)
