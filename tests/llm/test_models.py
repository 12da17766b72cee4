import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tests.llm.data import docs, rows_of
from vellum.llm import brown_lm, crf, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_model(spark):
    d = docs(spark, 150)
    got = brown_lm.perplexity_scores(d).collect()
    end, train = object(), Counter()
    key = lambda i: "" if i is None else str(i)
    tokens = [(i, [*(t.encode().lower().split()), end]) for i, t in rows_of(d)]
    for i, t in tokens:
        if zlib.crc32(key(i).encode()) % 5 != 1:
            train.update(t)
    n, v = sum(train.values()), len(train)
    want = sorted((key(i), len(t), sum(train[w] > 0 for w in t), round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, t in tokens)
    assert sorted((key(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.held_out == (zlib.crc32(key(r.doc_id).encode()) % 5 == 1) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert brown_lm.perplexity_scores(d.limit(0)).count() == 0


def test_scores_are_the_models(spark):
    """The score of every text, by a forward computation from the classes and counts alone."""
    d = docs(spark, 120)
    found = {}
    original = brown_lm.cluster

    def spy(*args):
        out = original(*args)
        found["class"] = {r["h"]: r["class"] for r in out.collect()}
        return out

    brown_lm.cluster = spy
    try:
        got = brown_lm.perplexity_scores(d).collect()
    finally:
        brown_lm.cluster = original
    key = lambda i: "" if i is None else str(i)
    texts = [(i, t.encode().lower().split()) for i, t in rows_of(d)]
    hashes = dict(zip(words := sorted({w for _, t in texts for w in t}), brown_lm.word_hashes(words).tolist(), strict=True))
    train = [t for i, t in texts if zlib.crc32(key(i).encode()) % 5 != 1]
    count = Counter(w for t in train for w in t)
    klass = lambda w: found["class"].get(hashes[w], brown_lm.RARE) if count[w] >= brown_lm.MIN_COUNT else brown_lm.RARE
    assert len({klass(w) for w in words}) > 10
    mass = Counter()
    for w, n in count.items():
        mass[klass(w)] += n
    trans = np.full((brown_lm.ALL, brown_lm.ALL), brown_lm.ADD)
    path = lambda t: [brown_lm.END, *map(klass, t), brown_lm.END]
    for t in train:
        for a, b in zip(path(t), path(t)[1:], strict=False):
            trans[a, b] += 1
    trans /= trans.sum(1, keepdims=True)
    once = sum(n == 1 for n in count.values())
    unknown = (once + brown_lm.ADD) / (mass[brown_lm.RARE] + once + 2 * brown_lm.ADD)

    def emission(w):
        return unknown if not count[w] else count[w] / mass[klass(w)] * ((1 - unknown) if klass(w) == brown_lm.RARE else 1)

    want = sorted((key(i), round(sum(map(math.log10, map(emission, t))) + sum(math.log10(trans[a, b]) for a, b in zip(path(t), path(t)[1:], strict=False)), 6)) for i, t in texts)
    assert sorted((key(r.doc_id), round(r.score, 6)) for r in got) == want
    assert abs(trans.sum(1) - 1).max() < 1e-9 and all(abs(sum(emission(w) for w in count if klass(w) == c) + (unknown if c == brown_lm.RARE else 0) - 1) < 1e-9 for c in {klass(w) for w in count})


def test_exchange_raises_mutual_information():
    rng = np.random.default_rng(0)
    cells = 2 * brown_lm.GROUPS
    profile = rng.dirichlet(np.ones(cells) * 0.2, 3)
    dense = np.array([rng.multinomial(200, profile[k % 3]) for k in range(90)])
    row, cell = np.nonzero(dense)
    old = np.full(90, -1)
    old[:3] = [0, 1, 2]
    table = np.zeros((brown_lm.CLASSES, cells))
    table[[0, 1, 2]] = dense[:3]
    new = brown_lm.exchange(row, cell, dense[row, cell], old, table)
    again = brown_lm.exchange(row, cell, dense[row, cell], new, table)
    assert all(len({again[k] for k in range(j, 90, 3)}) <= 2 for j in range(3))
    rebuilt = np.zeros_like(table)
    np.add.at(rebuilt, again, dense)
    assert np.allclose(rebuilt, table)


def test_words_travel_together(spark, monkeypatch):
    """No table between the steps has a row per word: only one per block and shard, whatever the number of words."""
    rng = random.Random(3)
    texts = [(k, " ".join(f"w{rng.randrange(900)}" for _ in range(100))) for k in range(300)]
    for name, value in {"BLOCK_TOKENS": 4000, "SHARD_TOKENS": 3000, "SLOTS": 60}.items():
        monkeypatch.setattr(brown_lm, name, value, raising=False)
    rows, table = {}, brown_lm.common.table

    def spy(df, path):
        out = table(df, path)
        rows[path.rsplit("/", 1)[1]] = out.count()
        return out

    monkeypatch.setattr(brown_lm.common, "table", spy)
    got = {r.doc_id: r for r in brown_lm.perplexity_scores(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    blocks, shards = rows.pop("blocks"), 300 * 101 // 3000
    assert blocks >= 4 and rows.pop("scores") == 300
    assert max(rows.values()) <= (blocks + 1) * (shards + 1)
    train = Counter(w for k, t in texts if zlib.crc32(str(k).encode()) % 5 != 1 for w in [*t.split(), ""])
    n, v = train.total(), len(train)
    for k, t in texts:
        words = [*t.split(), ""]
        assert (got[k].n_known, got[k].train_tokens) == (sum(train[w] > 0 for w in words), n)
        assert abs(got[k].base_score - sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)) < 1e-6
    assert all(-400 < r.score < -200 for r in got.values())


def brute(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


def junk(spark):
    good = docs(spark, 60)
    bad = spark.createDataFrame([(1000 + k, "\n".join("ab | cd | ef | gh | ij | kl | mn%%% op###" + str(j * k) for j in range(8))) for k in range(60)], "doc_id long, text string")
    return good.unionByName(bad, allowMissingColumns=True)


def test_quality_counts_and_verdicts(spark):
    d = junk(spark)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(1000 + k, 0, 0) for k in range(60)] + [(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality_rules.train(d, labels)
    got = quality_rules.score(d, model).collect()
    key = lambda x: (str(x[0]), *x[1:])
    assert sorted(map(key, ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got))) == sorted(map(key, ((i, *brute(t)) for i, t in rows_of(d))))
    assert not any(r.kept for r in got if r.doc_id is not None and r.doc_id >= 1000)
    clean = [r for r in got if r.doc_id is not None and r.doc_id < 1000 and not r.base_failed]
    assert clean and all(r.kept for r in clean)
    kept = quality_rules.keep(d, model)
    assert kept.columns == d.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.score(d.limit(0), model).count() == 0 and quality_rules.line_labels(d, model).count() > 0
    plain = quality_rules.train(d, labels.limit(0))
    assert all(r.kept == (not r.base_failed) for r in quality_rules.score(d, plain).collect())


def test_viterbi_and_gradient():
    rng = np.random.default_rng(1)
    x, lengths = rng.normal(size=(9, len(crf.FEATURES))), np.array([4, 0, 5])
    model = {"state": rng.normal(size=(2, x.shape[1])).tolist(), "transition": rng.normal(size=(2, 2)).tolist()}
    got, s, t = crf.viterbi(x, lengths, model), np.asarray(model["state"]), np.asarray(model["transition"])
    at = 0
    for n in lengths:
        best = max(((sum(x[at + k] @ s[y >> k & 1] for k in range(n)) + sum(t[y >> k & 1, y >> (k + 1) & 1] for k in range(n - 1)), y) for y in range(1 << n)), default=(0, 0))[1]
        assert got[at : at + n].tolist() == [best >> k & 1 for k in range(n)]
        at += n
    y = (np.arange(400) // 5 % 2).astype(int)
    z = np.column_stack([np.ones(400), y + rng.normal(size=400) * 0.5, *[rng.normal(size=400)] * (len(crf.FEATURES) - 2)])
    fitted = crf.train(z, np.full(80, 5), y)
    assert (crf.viterbi(z, np.full(80, 5), fitted) == y).mean() > 0.97


def thue_morse(n):
    """Strings whose polynomial hashes modulo 2 ** 64 agree, whatever the base."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_counts_are_exact_where_hashes_collide():
    a, b = thue_morse(4096)
    texts = [f"{a}\n{b}", f"{a} x y\n{b} x y", f"{a}\n{a}", "\n\n".join([f"w{k}" for k in range(60)] + ["w3"]), "", " \x1c ", "a b c\na b c"]
    got = quality_rules.judge(texts, quality_rules.KEEP_ALL)
    assert list(zip(*(got[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), strict=True)) == [brute(t) for t in texts]
    assert got["kept"].tolist() == (~got["base_failed"]).tolist()


def test_kept_follows_the_best_labels_of_a_model_by_hand():
    """A model that calls lines with many symbols boilerplate, and likes neighbours alike: every verdict by brute force."""
    import itertools

    k = len(crf.FEATURES)
    state = np.zeros((2, k))
    state[1, 0], state[0, crf.FEATURES.index("symbols")] = 0.6, 8.0
    model = {"state": state.tolist(), "transition": [[0.5, 0.0], [0.0, 0.5]]}
    r = np.random.default_rng(5)
    texts = ["\n".join(" ".join(r.choice(["word", "more", "|", "#", "thing"], p=p) + str(r.integers(10**6)) for _ in range(12)) for p in ([0.4, 0.3, 0.02, 0.02, 0.26], [0.1, 0.1, 0.35, 0.35, 0.1], [0.3, 0.2, 0.12, 0.13, 0.25]) for _ in range(r.integers(1, 4))) for _ in range(20)]
    got = quality_rules.judge(texts, model)
    for n, t in enumerate(texts):
        lines = crf.Lines([t.encode()])
        score = lines.x @ state.T
        best = max(itertools.product((0, 1), repeat=len(score)), key=lambda y: sum(score[j, v] for j, v in enumerate(y)) + 0.5 * sum(u == v for u, v in zip(y, y[1:], strict=False)))
        share = sum(w for w, y in zip(lines.line_words, best, strict=True) if y) / lines.line_words.sum()
        assert got["content_share"][n] == share and got["kept"][n] == (share >= quality_rules.CONTENT_SHARE and not brute(t)[-1])
    assert 0 < got["kept"].sum() < len(texts)
