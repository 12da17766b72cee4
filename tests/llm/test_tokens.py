import random
import zlib

import numpy as np
import pytest

from tests.llm.data import docs, rows_of
from vellum.llm import sentencepiece_scan as sp
from vellum.llm import wavelet

ODD = ["a  b", "\n a", "x\n\ny", "a\tb c", " a", "a ", "", "\0 x", "<|endoftext|> b", "it's don't\nI'll 12 3a _b", "a\nb c\n", "é\xa0b", "one.\ntwo, three"]


def plain(text):
    """The library's own ids, with no settings of ours."""
    from tokenizers import Tokenizer

    if not hasattr(plain, "tok"):
        plain.tok = Tokenizer.from_file(wavelet.tokenizer_path())
    return np.array(plain.tok.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def test_encoder_equals_library():
    e = wavelet.Encoder(wavelet.tokenizer_path())
    r = random.Random(4)
    texts = ODD + ["".join(r.choice(["abc", "Übung", "日本", " ", " ", "\n", ".", ",", "x1", "'s", "!?", "<|endoftext|>", "|", "ⅷ", "e\u0301", "_"]) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    want = [plain(t) for t in texts]
    assert e.batch(texts) == want and e.batch(texts) == want and [e.batch([t])[0] for t in texts] == want
    assert e.batch([]) == []


def test_wavelet_queries():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000, 140_000):
        ids = (rng.zipf(1.5, n) % 50_000).astype(np.uint16)
        w = wavelet.load(wavelet.dump(ids, 16, [None, 3], [0, n]))
        assert (w.sequence() == ids).all() and w.documents() == ([None, 3], [0, n])
        for i in rng.integers(0, n, 12) if n else ():
            v = int(ids[i])
            at = np.flatnonzero(ids == v)
            r = int(rng.integers(len(at)))
            assert w.access(int(i)) == v and w.count(v) == len(at) and w.occurrence(v, r) == at[r] and w.count(v, 3, int(i) + 3) == (ids[3 : int(i) + 3] == v).sum()
        with pytest.raises(IndexError):
            w.occurrence(50_001, 0)


def test_shards_hold_all_documents(spark, tmp_path):
    d = docs(spark, 50)
    manifest = wavelet.write_shards(d, f"file://{tmp_path}/s", wavelet.tokenizer_path(), shard_ids=2000)
    got = wavelet.read_shards(manifest).collect()
    rows = [(i, np.append(np.frombuffer(plain(t), "<u2"), 0).astype("<u4")) for i, t in rows_of(d)]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(x), zlib.crc32(x.tobytes())) for i, x in rows)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate(([0], np.cumsum([r.n_tokens for r in ordered])))[:-1].tolist() and len({r.start for r in got}) == len(got)
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids) and manifest.count() > 1
    assert wavelet.read_shards(wavelet.write_shards(d.limit(0), f"file://{tmp_path}/e", wavelet.tokenizer_path())).count() == 0


@pytest.fixture(scope="module")
def model():
    return sp.model(sp.model_path())


def scanned(m, text, size):
    s = sp.MARK + text.replace(" ", sp.MARK)
    chunks = [sp.Chunk(m, s[max(0, a - m.longest) : min(a + size, len(s)) + m.longest], max(0, a - m.longest), a, min(a + size, len(s)), len(s)) for a in range(0, len(s), size)]
    matrices = [c.matrix() for c in chunks]
    at = sp.scan(matrices, fan=3)
    assert at == sp.scan(matrices)
    ids = [i for k, c in enumerate(chunks) for i in c.backtrace(at[k], at[k + 1])]
    weight = sum(x[a, b] for x, a, b in zip(matrices, at, at[1:], strict=False))
    assert abs(weight - m.score_of[ids].sum()) < 1e-3  # the weight of the path is that of its pieces
    return ids


def test_scan_equals_library(model):
    r = random.Random(2)
    texts = ["thingandtheother" * 30, "a" * 300, " " * 200, "the" * 100 + " " * 40 + "x", "日本é\x00" * 50] + ["".join(r.choice("abe theing  \n日é    ") for _ in range(r.randint(1, 300))) for _ in range(150)]
    for t in texts:
        want = model.library.encode(t)
        assert all(scanned(model, t, size) == want for size in (17, 64)) and model.decode(want) == t


def test_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.normal(size=s) for s in ((2, 3), (3, 4), (4, 2)))
    assert np.allclose(sp.product(sp.product(a, b), c), sp.product(a, sp.product(b, c)))


def test_scan_finds_the_best_of_many_paths():
    """Random matrices, where every choice of states is a path: against all of them."""
    import itertools

    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        sizes = [1, *rng.integers(1, 4, n - 1).tolist(), 2]
        matrices = [np.where(rng.random((a, b)) < 0.2, sp.NEVER, rng.normal(size=(a, b))) for a, b in zip(sizes, sizes[1:], strict=False)]
        weigh = lambda path: sum(m[a, b] for m, a, b in zip(matrices, path, path[1:], strict=False))  # noqa: B023, E731
        best = max(map(weigh, itertools.product(*map(range, sizes))))
        if best > sp.NEVER:
            for fan in (2, 3, 64):
                assert abs(weigh(sp.scan(matrices, fan)) - best) < 1e-9


@pytest.mark.parametrize("fan", [64, 3])
def test_documents_encode_and_decode(spark, model, monkeypatch, fan):
    import hashlib

    monkeypatch.setattr(sp, "FAN", fan)
    monkeypatch.setattr(sp, "DECODE", 7)

    d = docs(spark, 40)
    rows = rows_of(d)
    got = sp.encode(d, sp.model_path(), chunk=300).collect()
    assert sorted((str(r.doc_id), str(r.ids)) for r in got) == sorted((str(i), str(model.library.encode(t))) for i, t in rows)
    assert max(r.n_chunks for r in got) > 1 and all(r.n_tokens == len(r.ids) for r in got)
    digests = sp.digests(d, sp.model_path(), chunk=300).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in digests) == sorted((str(i), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sp.encode(d.limit(0), sp.model_path()).count() == 0
