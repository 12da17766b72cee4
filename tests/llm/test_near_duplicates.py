import hashlib

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tests.llm.data import docs, rows_of
from vellum.llm import components, embedding_caps, simhash, suffix_dedup
from vellum.llm.suffix_array import permuted_prefixes, suffix_array


def reach(n, links):
    least = list(range(n))
    while True:
        after = list(least)
        for a, b in links:
            after[a] = after[b] = min(after[a], after[b])
        if after == least:
            return least
        least = after


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(k, k + 1) for k in range(70, 90)]
    df = spark.createDataFrame([*links, (5, None)], "a long, b long")
    got = {r.node: r.component for r in components.components(df).collect()}
    want = reach(100, links)
    assert got == {k: c for k, c in enumerate(want) if k != c}
    assert components.components(df.limit(0)).count() == 0


def fingerprint(text):
    w = text.encode().lower().split()
    h = [xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(len(w) - 2, min(len(w), 1)))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    d = docs(spark, 80)
    got = simhash.near_duplicates(d).collect()
    rows = rows_of(d)
    assert sorted((str(r.doc_id), r.fp % 2**64) for r in got) == sorted((str(i), fingerprint(t)) for i, t in rows)
    known = sorted({(i, fingerprint(t)) for i, t in rows if i is not None})
    links = [(j, k) for j, (_, x) in enumerate(known) for k, (_, y) in enumerate(known) if (x ^ y).bit_count() <= 2]
    want = reach(len(known), links)
    assert {(r.doc_id, r.fp % 2**64, r.component_id) for r in got if r.doc_id is not None} == {(i, x, known[c][0]) for (i, x), c in zip(known, want, strict=True)}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, fingerprint(r.text or "")) for r in kept.collect() if r.doc_id is not None) == sorted(known[k] for k in set(want))
    assert len({i for i, _ in (known[k] for k in set(want))}) < len(set(want))  # an id of two texts stays twice
    assert kept.where("doc_id IS NULL").count() == 2 and simhash.near_duplicates(d.limit(0)).count() == 0


def test_gray_hierarchy_finds_all_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 20)
    monkeypatch.setattr(simhash, "FAN", 4)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 150, dtype=np.int64).tolist()
    near = [x ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for x in base[:60]] + [base[0] ^ (1 << a) ^ (1 << b) for a in range(6) for b in range(6, 12)]
    fps = sorted({(x + 2**63) % 2**64 - 2**63 for x in base + near})
    df = spark.createDataFrame(list(zip(fps, range(len(fps)), strict=True)), "fp long, rep long")
    got = {r.node: r.component for r in simhash.link_fingerprints(df).collect()}
    links = [(a, b) for a in range(len(fps)) for b in range(a) if ((fps[a] ^ fps[b]) % 2**64).bit_count() <= 2]
    want = reach(len(fps), links)
    assert len(links) > 60 and got == {k: c for k, c in enumerate(want) if k != c}


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, a, depth = int(rng.integers(0, 50)), int(rng.integers(1, 4)), int(rng.integers(1, 60))
        text = rng.integers(97, 97 + a, n).astype(np.uint8)
        s, raw = suffix_array(text, depth), text.tobytes()
        assert sorted(s.tolist()) == list(range(n))
        cut = [raw[k : k + depth] for k in s]
        assert cut == sorted(cut)
        if n:
            p = permuted_prefixes(text, s, depth)
            for x, y in zip(s, s[1:], strict=False):
                shared = next((k for k in range(depth) if x + k >= n or y + k >= n or raw[x + k] != raw[y + k]), depth)
                assert p[y] == shared


def removed(rows):
    """Masks of the removed bytes, in the order of the rows."""
    least = {}
    key = lambda i: float("inf") if i is None else i
    for i, b in rows:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            least[w] = min(least.get(w, float("inf")), key(i))
    out = []
    for i, b in rows:
        m = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < key(i):
                m[k : k + 50] = b"\1" * 50
        out.append(m)
    return out


@pytest.mark.parametrize("hot", [10_000, 3])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    for name, value in (("HOT_DOCS", hot), ("BLOCK_BYTES", 5000), ("RUN", 64), ("BATCH_BYTES", 3000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    d = docs(spark, 60, long=3000)
    rows = [(i, t.encode()) for i, t in rows_of(d)]
    masks = removed(rows)
    want = sorted((str(i), len(b), sum(m), sum(x and not (k and m[k - 1]) for k, x in enumerate(m)), hashlib.sha256(bytes(c for c, x in zip(b, m, strict=True) if not x)).hexdigest()) for (i, b), m in zip(rows, masks, strict=True))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(d).collect())
    assert got == want and sum(x[2] for x in got) > 1000
    clean = suffix_dedup.cleaned(d)
    assert clean.columns == d.columns and clean.count() == d.count()
    texts = sorted(str((i, bytes(c for c, x in zip(b, m, strict=True) if not x).decode("utf-8", "ignore"))) for (i, b), m in zip(rows, masks, strict=True))
    assert sorted(str((r.doc_id, r.text or "")) for r in clean.collect()) == texts
    assert suffix_dedup.digests(d.limit(0)).count() == 0


def test_caps_against_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 32))
    near = np.concatenate([base[:40] + rng.normal(size=(40, 32)) * 0.05, base[:1] + rng.normal(size=(400, 32)) * 0.02])
    x = np.concatenate((base, near, base[:5])).astype(np.float32)
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [1.0, None] * 16, [float("inf")] * 32, [1.0] * 8, [2.0] * 8]
    rows = [(k, v.tolist(), 0, "x") for k, v in enumerate(x)] + [(5000 + k, v, 0, "x") for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, dim string")
    got = {r.vec_id: r for r in embedding_caps.near_duplicates(df, cell=64).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    comp = reach(len(x), np.argwhere(linked).tolist())
    found, true = sum(r.n_links for k, r in got.items() if k < 5000), int(linked.sum())
    assert 0.99 * true <= found <= true
    assert all(got[k].n_links <= linked[k].sum() and got[k].kept == (got[k].component_id == k) for k in range(len(x)))
    assert np.mean([got[k].component_id == comp[k] for k in range(len(x))]) > 0.98
    assert all(got[5000 + k].n_links == 0 and got[5000 + k].kept for k in range(6)) and got[5006].n_links == got[5007].n_links == 1 and got[5007].component_id == 5006
    assert embedding_caps.near_duplicates(df.limit(0)).count() == 0


def test_caps_with_repeated_ids_and_any_scale(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 16))
    turn = lambda v: v + rng.normal(size=16) * 0.02
    rows = [(5, x), (5, y), (6, turn(x)), (7, turn(y)), (8, x * 1e200), (9, turn(x) * 1e-200), (10, rng.normal(size=16)), (11, x * 1e-310), (None, x)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_caps.near_duplicates(df).collect())
    assert got == [(0, 0, None, True), (5, 1, 5, True), (5, 4, 5, True), (6, 4, 5, False), (7, 1, 5, False), (8, 4, 5, False), (9, 4, 5, False), (10, 0, 10, True), (11, 4, 5, False)]


def test_decoding_finds_every_filter():
    rng = np.random.default_rng(4)
    for dim, alpha in ((1, 0.4), (2, 0.4), (9, 0.5), (24, 0.45)):
        u = rng.normal(size=(40, dim))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        rotation, words = embedding_caps.code(dim, 1, alpha)
        if dim == 1:
            directions = words[0]
        else:
            directions = np.concatenate([np.concatenate((np.repeat(words[0][k : k + 1], len(words[1]), 0), words[1]), axis=1) for k in range(len(words[0]))])
        row, ident = embedding_caps.decode(u, 1, alpha)
        assert set(zip(row.tolist(), ident.tolist(), strict=True)) == {(int(a), int(b)) for a, b in np.argwhere((u @ rotation) @ directions.T >= alpha)}


def test_candidates_grow_with_the_vectors():
    """Five times the vectors: the members of a filter, and so candidates per vector, stay about the same."""
    rng = np.random.default_rng(6)
    per = []
    for n in (6000, 30_000):
        u = rng.normal(size=(n, 64))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        _, ident = embedding_caps.decode(u, 0, embedding_caps.alpha_for(64, n))
        sizes = np.unique(ident, return_counts=True)[1]
        per.append((sizes**2).sum() / n)
    assert per[1] < 1.6 * per[0]
