import random

import pytest

from tests.llm.data import docs
from tests.llm.test_near_duplicates import reach
from vellum.llm import near_copies

import corpus_pipeline


def sets(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}


def similar(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def edited(spark):
    """``docs`` and groups of texts with some words exchanged, similar on both sides of 0.8."""
    r = random.Random(4)
    d = docs(spark, 40)
    rows = []
    for g in range(8):
        base = ["w%d" % r.randrange(10**6) for _ in range(r.choice([8, 60, 200]))]
        for c in range(9):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 30)):
                w[r.randrange(len(w))] = "e%d" % r.randrange(10**6)
            rows.append((1000 + 10 * g + c, " ".join(w) if c % 2 else " \n".join(w).upper()))
    return d.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)


@pytest.mark.parametrize("cell", [512, 3])
def test_near_copies_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(near_copies, "CELL", cell)
    d = edited(spark)
    rows = sorted({(r.doc_id, r.text or "") for r in d.collect() if r.doc_id is not None})
    s = [sets(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if similar(s[i], s[j])]
    assert sum(s[i] != s[j] for i, j in links) > 50
    want = [next(i for i, c in enumerate(reach(len(rows), links)) if c == k) for k in sorted(set(reach(len(rows), links)))]
    stage = corpus_pipeline.near_duplicates(spark, d, "")
    assert stage.columns == d.columns
    got = stage.collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(rows[k][0] for k in want)
    assert sum(r.doc_id is None for r in got) == 2
    assert near_copies.keep_one(d.limit(0)).count() == 0


def test_leaves_meet_across_partitions(spark, monkeypatch, tmp_path):
    """Small leaves in several partitions: what stands within a leaf of another in some order is found."""
    import numpy as np
    from vellum.llm.simhash import gray_rank
    from pyspark.sql import functions as F

    monkeypatch.setattr(near_copies, "LEAF", 4)
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 62), 1 << 62, (300, near_copies.WIDE))
    near = base.copy()
    near[:, 0] ^= 1 << rng.integers(0, 20, 300)
    rows = [(k, 10, *map(int, f)) for k, f in enumerate(np.concatenate((base, near)))]
    df = spark.createDataFrame(rows, near_copies.PRINTS)
    order = [r.node for r in df.orderBy(gray_rank(F.col("f0")), "node").collect()]
    want = {tuple(sorted((a, b))) for k, a in enumerate(order) for b in order[k + 1 : k + 3] if a % 300 == b % 300}
    got = {(r.a, r.b) for r in near_copies.candidates(df, 1, f"file://{tmp_path}/x").collect()}
    assert {tuple(sorted(x)) for x in got} >= want and len(want) > 250 and all(a % 300 == b % 300 for a, b in got)


def test_leaves_against_brute_force():
    """Rows, limits and the order of words: the pairs within all limits, and no others."""
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (30, near_copies.WIDE), dtype=np.uint64)
    noise = np.bitwise_and.reduce(rng.integers(0, 1 << 63, (3, 200, near_copies.WIDE), dtype=np.uint64), axis=0)
    x = base[rng.integers(0, 30, 200)] ^ noise
    x = x[np.argsort(x[:, 1])]
    for first in range(near_copies.WIDE):
        got = set(zip(*(c.tolist() for c in near_copies.within(x[:150], x[50:], first)), strict=True))
        bits = np.bitwise_count(x[:150, None] ^ x[None, 50:]).astype(int)
        total = np.cumsum(np.roll(bits, -first, axis=2), axis=2)
        assert got == {(int(i), int(j)) for i, j in np.argwhere((total <= near_copies.LIMITS).all(2))} and len(got) > 500


def test_pairs_at_the_similarity_meet():
    """Sets of similarity 0.8 among many others differ in as many bits as assumed, and share a leaf in some order."""
    import numpy as np

    rng = np.random.default_rng(8)
    apart = []
    for _ in range(400):
        both, own = rng.integers(-(1 << 62), 1 << 62, 160), rng.integers(-(1 << 62), 1 << 62, (2, 20))
        a, b = (near_copies.wide_fingerprint(np.concatenate((both, x))) for x in own)
        apart.append(int(np.bitwise_count(a ^ b).sum()))
    assert abs(np.mean(apart) / (64 * near_copies.WIDE) - near_copies.DIFFER) < 0.01 and np.mean(np.array(apart) <= near_copies.LIMITS[-1]) > 0.99
    assert near_copies.orders_for(100) == 1 and 5 < near_copies.orders_for(200_000) < 32 < near_copies.orders_for(10**9) < 400
