import hashlib

from tests.llm.test_near_duplicates import removed
from vellum.llm import suffix_dedup


def test_runs_of_more_than_65535_windows(spark):
    passage = " ".join("word%d" % k for k in range(40))
    rows = [(1, "-" * 70_100 + passage), (2, "head " + passage + "-" * 70_300), (3, passage + " end of another text"), (4, "=-" * 36_000 + "x"), (5, "y" + "=-" * 36_100)]
    masks = removed([(i, t.encode()) for i, t in rows])
    want = [(i, sum(m), hashlib.sha256(bytes(c for c, x in zip(t.encode(), m, strict=True) if not x)).hexdigest()) for (i, t), m in zip(rows, masks, strict=True)]
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == want


def test_equal_letters_and_words_that_hash_alike(spark):
    """200,000 equal bytes in two documents, and Thue-Morse words, which polynomial hashes do not tell apart."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(8192))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a + "0" * 60 + b), (2, b + "1" * 60 + a[:3000]), (3, "z" * 200_000), (4, "q" + "z" * 200_000), (5, a[100:300] + "w" + "z" * 10)]
    masks = removed([(i, t.encode()) for i, t in rows])
    want = [(i, sum(m), hashlib.sha256(bytes(c for c, x in zip(t.encode(), m, strict=True) if not x)).hexdigest()) for (i, t), m in zip(rows, masks, strict=True)]
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in got) == want


def test_contexts_are_told_apart_by_their_bytes(monkeypatch):
    """With a hash that says nothing, contexts are numbered by their bytes."""
    texts = [("x%d " % k) * 30 for k in range(40)] + ["y" * 400, "z" * 300]
    data = "".join(texts).encode()
    t = suffix_dedup.Texts(data, [len(x) for x in texts], list(range(len(texts))))
    every = suffix_dedup.Contexts(t, t.anchors()[0], t.anchors()[0][:0], 8)
    monkeypatch.setattr(suffix_dedup.Texts, "hashes", lambda self, start, stop: start.astype("u8") * 0)
    again = suffix_dedup.Contexts(t, t.anchors()[0], t.anchors()[0][:0], 8)
    bytes_of = lambda c: [t.buf[c.first[k] : c.stop_first[k]].tobytes() for k in c.which]
    assert bytes_of(every) == bytes_of(again) == [t.buf[a : a + n + 49].tobytes() for a, n in zip(again.start, again.windows, strict=True)]
