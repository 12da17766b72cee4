import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import diff, matrix, ml, retrieval, runner, tabular
from vellum.sources import readers, writers
from vellum.streaming import trace


def test_tabular(spark):
    products = spark.createDataFrame([(1, 5999, 10), (2, 1299, 5), (3, 8999, 1)], "id int, price int, stock int")
    items = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "product_id int, quantity int")
    joined = tabular.cart(items, products, "product_id", "id")
    assert tabular.total(joined, F.col("price") * F.col("quantity")).first().total == 22296 and tabular.all_available(joined, "quantity", "stock").first().available
    with pytest.raises(Exception, match="no such product"):
        tabular.cart(spark.createDataFrame([(9, 1)], "product_id int, quantity int"), products, "product_id", "id").collect()
    events = spark.createDataFrame([("a", "view", 1), ("a", "purchase", 2), ("b", "view", 1), ("c", "purchase", 3)], "user string, event string, ts int")
    assert tabular.conversion(events, "user", F.col("event") == "purchase").first().rate == pytest.approx(2 / 3)
    assert tabular.conversion(events.limit(0), "user", F.col("event") == "purchase").first().rate is None
    for share, want in ((0.8, 8), (0.0, 0), (1.0, 10), (0.55, 5)):
        first, rest = tabular.split_by_position(spark.range(10), "id", share)
        assert sorted(r.id for r in first.collect()) == list(range(want)) and sorted(r.id for r in rest.collect()) == list(range(want, 10))
    ties = spark.createDataFrame([(k, None if k < 2 else 7 if k < 9 else 9) for k in range(10)], "k int, x int")
    for share in (0.1, 0.2, 0.5, 0.95):
        first, rest = tabular.split_by_position(ties, "x", share)
        assert first.count() == int(10 * share) and {r.k for r in first.collect()} | {r.k for r in rest.collect()} == set(range(10)) and first.columns == ["k", "x"]
    twice = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 2, "z")], "k string, t int, v string")
    assert {tuple(r) for r in tabular.latest(twice, "k", "t").collect()} == {("a", 1, "y"), ("b", 2, "z")}
    assert tabular.describe(products, "price").count() == 8


def test_matrix(spark):
    a = np.array([[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])
    m = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(2) for j in range(3)], "i long, j long, v double")
    dense = lambda x: {(r.i, r.j): r.v for r in x.collect()}
    want = lambda x: {(i, j): x[i, j] for i in range(x.shape[0]) for j in range(x.shape[1])}
    assert dense(matrix.matmul(m, matrix.transpose(m))) == want(a @ a.T) and dense(matrix.reshape(m, 3, 2)) == want(a.reshape(3, 2))
    assert dense(matrix.combine(m, m, lambda x, y: x * y)) == want(a * a) and dense(matrix.elementwise(m, lambda v: matrix.clip(v, 2, 5))) == want(a.clip(2, 5))
    row = spark.createDataFrame([(j, float(j)) for j in range(3)], "j long, r double")
    assert dense(matrix.broadcast_row(m, row, lambda v, r: v + r)) == want(a + np.arange(3))
    for wrong in (matrix.broadcast_row(m, row.where("j < 2"), lambda v, r: v), matrix.broadcast_row(m.where("j < 2"), row, lambda v, r: v), matrix.reshape(m, 3, 4)):
        with pytest.raises(Exception, match="shapes differ"):
            wrong.collect()
    with pytest.raises(Exception, match="shapes differ"):
        matrix.combine(m, m.where("j < 2"), lambda x, y: x).collect()
    assert [r.total for r in matrix.reduce(m, 0).orderBy("j").collect()] == a.sum(0).tolist() and matrix.reduce(m).first().mean == a.mean()
    s = spark.createDataFrame([([[2.0, 1.0], [1.0, 3.0]], [3.0, 5.0])], "m array<array<double>>, b array<double>").select(matrix.linear_algebra(F.col("m"), F.col("b")).alias("s")).first().s
    assert s.det == pytest.approx(5) and np.allclose(s.solution, [0.8, 1.4]) and np.allclose(s.inverse, np.linalg.inv([[2, 1], [1, 3]]))
    v = spark.createDataFrame([([3.0, 1.0, 2.0],)], "v array<double>").select(matrix.argsort(F.col("v")).alias("s"), matrix.argmax(F.col("v")).alias("m"), matrix.item(F.col("v"), -1).alias("l")).first()
    assert (v.s, v.m, v.l) == ([1, 2, 0], 0, 2.0)


def test_diff(spark):
    old = spark.createDataFrame([("a", {"source": "x", "k": "1"}), ("b", {"k": "1"})], "id string, metadata map<string,string>")
    new = spark.createDataFrame([("a", {"source": "y", "k": "1"}), ("c", {"k": "2"})], "id string, metadata map<string,string>")
    assert {r.id: r.status for r in diff.compare(old, new, "id").collect()} == {"a": "same", "b": "removed", "c": "added"}
    row = diff.summary(diff.compare(old, new, "id"), "id").first()
    assert (row.old_count, row.new_count, row.added_ids, row.behaviorally_identical) == (2, 2, ["c"], False)
    assert diff.summary(diff.compare(old, old, "id"), "id").first().behaviorally_identical


def test_retrieval(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "vector database index"), ("d2", "cooking recipes"), ("d3", "database of vectors")], "doc_id string, text string")
    found = retrieval.hypothetical_search(retrieval.index_texts(docs, dimensions=256), "how?", lambda q: "vector database index", 2, dimensions=256).collect()
    assert found[0].doc_id == "d1" and found[0].score == pytest.approx(1.0, abs=1e-5)
    terms = {r.term for r in retrieval.expand_query(spark.createDataFrame([("保险理赔",)], "query string")).collect()}
    assert terms == {"保险索赔", "理赔", "索赔流程", "理赔流程", "索赔", "赔付", "保险理赔"}
    memory = lambda k, text, imp: retrieval.add_memory(spark, "n", "fact", text, imp, 0.9, "2024-01-01 00:00:00", k)
    memories = memory(1, "likes the ocean", 2.0).unionByName(memory(2, "works on databases", 0.5)).unionByName(memory(3, "数据库", 0.1))
    best = retrieval.search_memories(memories, "databases work", "n", "2024-02-01 00:00:00").collect()
    assert best[0].id == 2 and max(r.importance for r in best) == 1.0
    with pytest.raises(ValueError):
        retrieval.add_memory(spark, "n", "fact", " ", 1, 1, "2024-01-01 00:00:00", 1)
    children = spark.createDataFrame([("c", "p"), ("x", "q")], "child_id string, parent_id string")
    parents = spark.createDataFrame([("p", "whole")], "parent_id string, content string")
    assert retrieval.parent_context(children.where("child_id = 'c'"), parents).first().parent_content == "whole"
    with pytest.raises(Exception, match="no parent"):
        retrieval.parent_context(children, parents).collect()


def test_files_and_streams(spark, tmp_path):
    p = str(tmp_path)
    writers.write_jsonl(spark.createDataFrame([("a", 1)], "k string, v int"), f"{p}/j")
    assert readers.read_jsonl(spark, f"{p}/j", "k string, v int").first().v == 1
    (tmp_path / "bad.json").write_text("{oops\n")
    with pytest.raises(Exception):
        readers.read_jsonl(spark, f"{p}/bad.json", "k string").collect()
    (tmp_path / "t.txt").write_text("x" * 100)
    assert readers.read_texts(spark, f"{p}/t.txt", 10).first().text.startswith("x" * 10 + "\n...") and readers.list_files(spark, p, "*.txt").count() == 1
    for k, state in enumerate([{"step": 1}, {"step": 2}]):
        writers.save_checkpoint(spark, f"{p}/cp", "r", "n", state, f"2024-01-01 00:00:0{k}")
    assert readers.load_checkpoint(writers.checkpoints(spark, f"{p}/cp"), "r", "step int").first().state.step == 2
    writers.write_new(spark.range(1), f"{p}/new")
    with pytest.raises(Exception):
        writers.write_new(spark.range(1), f"{p}/new")
    for k in range(3):
        trace.emit(spark, f"{p}/trace", "action", "r", {"k": k}, f"2024-01-01 00:0{k}:00")
    query = trace.write_stream(trace.read_stream(spark, f"{p}/trace"), f"{p}/events", f"{p}/checkpoint")
    query.awaitTermination(60)
    events = spark.read.parquet(f"{p}/events")
    assert events.count() == 3 and trace.cap_actions(events, 2).first().over
    up = trace.upsert_stream(trace.read_stream(spark, f"{p}/trace"), f"{p}/state", f"{p}/checkpoint2")
    up.awaitTermination(60)
    assert tabular.latest(spark.read.parquet(f"{p}/state"), "run_id", "timestamp").count() == 1
    documents, pages, blocks, _ = readers.text_layout(spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string"))
    assert documents.count() == 2 and pages.count() == 2 and blocks.where("document_id = '1'").count() == 2
    assert readers.model_ids(" a, ,b", ["x"]) == ["a", "b"] and readers.model_ids("", ["x"]) == ["x"]


def test_models(spark):
    texts = [("这个产品很好用", "positive"), ("体验非常棒", "positive"), ("我很喜欢这个功能", "positive"), ("客服响应很快", "positive"), ("这个东西太难用了", "negative"), ("体验很差", "negative"), ("我不喜欢这个产品", "negative"), ("客服一直不回复", "negative")]
    model = ml.train_text_classifier(spark.createDataFrame(texts, "text string, label string"))
    got = ml.classify_texts(model, spark.createDataFrame([("这个功能很好用",), ("客服一直不回复",)], "text string")).collect()
    assert [r.predicted for r in got] == ["positive", "negative"]
    data = spark.createDataFrame([(float(a), float(b), 3.0 * a - 2 * b + 5) for a in range(5) for b in range(5)], "a double, b double, y double")
    weights, intercept = ml.linear_regression(data, ["a", "b"], "y")
    assert np.allclose(weights, [3, -2], atol=1e-3) and intercept == pytest.approx(5, abs=1e-2)
    grams = spark.createDataFrame([("Ab c",), (None,), ("x",)], "t string").select(ml.char_ngrams(F.col("t")).alias("g")).collect()
    assert grams[0].g == ["a", "b", " ", "c", "ab", "b ", " c"] and grams[1].g == [] and grams[2].g == ["x"]


def test_runner(spark, tmp_path):
    seen = []
    state = runner.Runner(runner.default_tools(), trace=lambda *a: seen.append(a)).run("计算 (17 + 5) * 3")
    assert state.status == "completed" and state.calls == 1 and state.output == "66" and [s[0] for s in seen] == ["start", "action", "end"]
    w = runner.Workspace(spark, str(tmp_path))
    for bad in ("../x", "/etc/passwd"):
        with pytest.raises(ValueError):
            w.resolve(bad)
    tools = runner.default_tools(w)
    tools.invoke("write_file", {"name": "a.txt", "content": "hi"})
    assert tools.invoke("read_file", {"name": "a.txt"}) == "hi" and len(w.files()) == 1
    with pytest.raises(FileExistsError):
        tools.invoke("write_file", {"name": "a.txt", "content": "hi"})
    with pytest.raises(TypeError):
        tools.invoke("calculator", {"expression": 3})
    assert runner.Policy().check(tools.get("write_file"), 0, 0) == (False, "not approved")
    assert runner.Runner(tools, runner.Policy(max_calls=0)).run("1 + 1").status == "stopped"


def test_small_ml_and_sampling_helpers(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0), (0.5, 0.5)], "prediction double, label double")
    assert ml.mean_loss(df).first().loss == 0.5 and ml.mean_loss(df, kind="absolute").first().loss == 0.5
    assert ml.mean_loss(spark.createDataFrame([(0.5, 1.0)], "prediction double, label double"), kind="log").first().loss == pytest.approx(np.log(2))
    points = ml.circle(spark, 60, 1)
    model = ml.perceptron(points, ["x", "y"], "label", [2, 3, 2])
    ml.save(model, f"file://{tmp_path}/m")
    assert ml.accuracy(ml.load(f"file://{tmp_path}/m").transform(points)).first() == ml.accuracy(model.transform(points)).first()
    ids = spark.range(100)
    assert [r.id for r in matrix.choice(ids, "id", 7, 3).collect()] == [r.id for r in matrix.shuffled(ids, "id", 3).collect()][:7]
    assert matrix.choice(ids, "id", 7, 4).collect() != matrix.choice(ids, "id", 7, 3).collect()
    assert {r.batch for r in matrix.batches(ids, "id", 20, 1).collect()} == set(range(5)) and matrix.batches(ids, "id", 20, 1).count() == 100
    assert [tuple(r) for r in matrix.positions(spark.createDataFrame([(1, ["a", "b"])], "k int, v array<string>"), "v").collect()] == [(1, 0, "a"), (1, 1, "b")]


def test_encoder_plug_in(spark):
    from vellum.functions import vectors

    vectors.register("lengths", lambda: lambda texts: [[len(t), 4.0] for t in texts])
    got = spark.createDataFrame([("abc",), (None,)], "t string").select(vectors.encode(F.col("t"), "lengths").alias("v")).collect()
    assert np.allclose([r.v for r in got], [[0.6, 0.8], [0.0, 1.0]])


def test_html_becomes_blocks(spark, tmp_path):
    from vellum.sources import readers

    html = "<html><title>T</title><style>p {}</style><h1>Head &amp; more</h1><p>One <b>two</b>\n three</p><pre>def f():\n    return 1</pre><ul><li>a<li>b</ul>tail"
    blocks = list(readers.html_blocks(html.encode()))
    assert [(b["text"], b["max_font_size"], b["monospace"]) for b in blocks] == [("T", 12.0, False), ("Head & more", 24.0, False), ("One two three", 12.0, False), ("def f():\n    return 1", 12.0, True), ("a", 12.0, False), ("b", 12.0, False), ("tail", 12.0, False)]
    assert list(readers.html_blocks(b"")) == []


def test_commands_write_what_they_say(spark, tmp_path, capsys):
    from vellum import cli

    (tmp_path / "u.jsonl").write_text('{"unit_id": "1", "kind": "code", "text": "def f():\\nreturn 1"}\n{"unit_id": "2", "kind": "list", "text": "x"}\n')
    assert cli.main(["diagnose", str(tmp_path / "u.jsonl"), "-o", str(tmp_path / "d.json")], spark) == 0
    assert (tmp_path / "d.json").read_text() == '{"units":1,"failing":1,"indentation":1,"split_identifiers":0,"boundaries":1}\n'
    assert cli.main(["ask", "(2 + 3) * 4"], spark) == 0 and '"output": "20"' in capsys.readouterr().out
    with pytest.raises(FileExistsError):
        cli.main(["ask", "1 + 1", "-o", str(tmp_path / "d.json")], spark)
