from tests.llm.data import rows_of
from tests.llm.test_models import junk
from tests.llm.test_near_copies import sets, similar
from tests.llm.test_near_duplicates import reach, removed
from vellum.llm import quality_rules, queries, sentencepiece_scan

import corpus_pipeline


def expected(name, before, now, model):
    """A stage's rows by brute force from its input."""
    rows, found = rows_of(before), sorted(map(str, rows_of(now))) if name != "pieces" else None
    if name == "quality":
        kept = quality_rules.judge([t for _, t in rows], model)["kept"]
        assert found == sorted(str(r) for r, k in zip(rows, kept, strict=True) if k)
    elif name == "near_duplicates":
        known = sorted({r for r in rows if r[0] is not None})
        s = [sets(t) for _, t in known]
        group = reach(len(known), [(i, j) for i in range(len(known)) for j in range(i) if similar(s[i], s[j])])
        assert sorted(r[0] for r in rows_of(now) if r[0] is not None) == sorted(known[k][0] for k in set(group))
    elif name == "repeats":
        texts = [(i, t.encode()) for i, t in rows]
        left = [(i, bytes(c for c, x in zip(b, m, strict=True) if not x).decode("utf-8", "ignore")) for (i, b), m in zip(texts, removed(texts), strict=True)]
        assert found == sorted(map(str, left))
    elif name == "mixture":
        assert set(found) == set(map(str, rows))
    else:
        m = sentencepiece_scan.model(sentencepiece_scan.model_path())
        assert sorted((str(r.doc_id), str(r.ids)) for r in now.collect()) == sorted((str(i), str(m.library.encode(t))) for i, t in rows)


def test_stages(spark, tmp_path):
    d = junk(spark)
    spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(1000 + k, 0, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    model = quality_rules.train(now, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(now.count())
        if name != "pieces":
            assert now.columns == before.columns, name
        expected(name, before, now, model)
    assert 0 < counts[0] < d.count() and counts[1] < counts[0] and counts[2] == counts[1] <= counts[3] == counts[4]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[4]


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
