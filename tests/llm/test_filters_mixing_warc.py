import datetime
import gzip
import math

import pytest
from pyspark.sql import functions as F

from tests.llm.data import docs
from vellum.llm import mixing, url_filters, warc
from vellum.llm.storage import Window, open_fs


def test_entries_hold_from_their_day_until_the_next(spark):
    entries = spark.createDataFrame([
        ("l", "block", "example.com", "add", "2021-01-10"), ("l", "block", "example.com", "remove", "2021-02-01"), ("l", "block", "example.com", "add", "2021-03-01"), ("l", "block", "example.com", "remove", "2021-03-01"),
        ("m", "allow", "a.example.com", "add", "2021-01-15"), ("m", "block", "a.example.com/en", "add", "2021-01-20"), ("m", "block", None, "add", "2021-01-01"), ("m", "block", "b.org", "add", None), ("m", "block", "b.org", "?", "2020-01-01"),
    ], "list_name string, kind string, key string, action string, effective_date string")
    day = lambda s: datetime.date.fromisoformat(s)
    captures = spark.createDataFrame([
        (1, "http://example.com/x", day("2021-01-09")), (2, "http://example.com/x", day("2021-01-10")), (3, "http://EXAMPLE.com./x", day("2021-01-31")), (4, "http://example.com/x", day("2021-02-01")), (5, "http://example.com", day("2021-03-02")),
        (6, "http://u@a.example.com:80/", day("2021-01-16")), (7, "https://a.example.com/en/1", day("2021-01-20")), (8, None, day("2021-01-20")), (9, "junk", day("2021-01-20")), (10, "http://example.com", None), (2, "http://example.com/x", day("2021-01-10")),
        (11, "http://notexample.com/", day("2021-01-20")),
    ], "page_id long, url string, fetched_on date").withColumn("host", F.lit("clash"))
    got = [(r.page_id, r.kept, r.n_active, r.rule_key) for r in url_filters.url_filter(captures, entries).collect()]
    by = {r[0]: r[1:] for r in got}
    assert all(by[k] == (True, 0, None) for k in (1, 4, 5, 8, 9, 10)) and by[2] == by[3] == (False, 1, "example.com") and by[6] == (True, 2, "a.example.com") and by[7] == (False, 3, "a.example.com/en") and by[11] == (True, 0, None) and len(got) == 12
    assert url_filters.url_filter(captures.limit(0), entries).count() == 0 and url_filters.url_filter(captures, entries.limit(0)).where("NOT kept").count() == 0


def test_paths_keep_their_case_and_long_hosts_match(spark):
    entries = spark.createDataFrame([("l", "block", "A.example.COM/EN", "add", "2021-01-01"), ("l", "block", "example.net", "add", "2021-01-01")], "list_name string, kind string, key string, action string, effective_date string")
    day = datetime.date(2021, 5, 5)
    long_host = "x" * 60 + "." + ".".join(["y" * 60] * 5) + ".example.net"
    captures = spark.createDataFrame([(1, "http://a.example.com/EN/x", day), (2, "http://a.example.com/en/x", day), (3, f"http://{long_host}/", day)], "page_id long, url string, fetched_on date").withColumns({"__meta": F.lit("m"), "Host": F.lit("clash"), "best": F.lit(1), "key": F.lit("k")})
    got = url_filters.url_filter(captures, entries)
    assert got.columns == ["page_id", "url", "fetched_on", "__meta", "best", "key", "host", "n_active", "rule_key", "rule_list", "kept"]
    assert {(r.page_id, r.kept, r.rule_key, r["__meta"]) for r in got.collect()} == {(1, False, "a.example.com/EN", "m"), (2, True, None, "m"), (3, False, "example.net", "m")}


def test_mixture_keeps_its_budget(spark):
    d = docs(spark, 200)
    got = mixing.mix(d, budget_share=(6, 10), entropy_share=0.97, block_tokens=300).collect()
    assert len(got) == d.count()
    total = sum(r.n_tokens for r in got)
    drawn = sum(r.n_tokens * r.copies for r in got)
    assert drawn <= total * 6 // 10 and drawn > total * 0.5
    share = {}
    for r in got:
        share[r.source] = share.get(r.source, 0) + r.n_tokens * r.copies
    p = [x / drawn for x in share.values()]
    assert -sum(x * math.log(x) for x in p) > 0.96 * math.log(len(p))
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in mixing.mix(d, budget_share=(6, 10), entropy_share=0.97, block_tokens=300).collect()}
    assert mixing.mix(d.limit(0), max_passes=2.0).count() == 0


def test_no_document_is_dropped_without_a_budget(spark):
    d = docs(spark, 100)
    got = mixing.mix(d, max_passes=2.0).collect()
    assert all(r.copies >= 1 for r in got) and max(r.copies for r in got) <= 3
    out = mixing.repeat(d, max_passes=2.0)
    assert out.columns == d.columns and out.count() >= d.count()
    assert {(r.doc_id, r.text) for r in out.collect()} == {(r.doc_id, r.text) for r in d.collect()}


def test_repeated_rows_draw_a_number_each(spark):
    """Rows equal in all columns: together they are drawn as often as the plan says, not each as often as the most."""
    rows = [(k // 4, " ".join(["w"] * (3 + k // 4 % 5)), "big" if k % 3 else "small") for k in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"__k": F.lit(1), "__a": F.lit("x"), "copies": F.lit(2)})
    how = {"budget_share": (13, 10), "target_entropy": 0.68, "block_tokens": 40}
    plan = mixing.mix(d, **how).groupBy("source").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).orderBy("source").collect()
    out = mixing.repeat(d, **how)
    assert out.columns == d.columns
    got = out.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", " "))).alias("t")).orderBy("source").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in plan] and len(plan) == 2


def test_exponent_is_that_of_bisection(spark):
    tokens = {"a": 5000, "b": 300, "c": 20, "d": 1}
    s = spark.createDataFrame(list(tokens.items()), "source string, tokens long")

    def entropy(alpha):
        w = [(n / sum(tokens.values())) ** alpha for n in tokens.values()]
        return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)

    low, high = 0.0, 1.0
    for _ in range(24):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 1.1 else (low, mid)
    assert mixing.find_alpha(s, target_entropy=1.1) == round(low, 6)
    alpha = mixing.find_alpha(s, max_passes=3.0)
    w = {k: (n / 5321) ** alpha for k, n in tokens.items()}
    passes = max(w[k] / n for k, n in tokens.items()) / min(w[k] / n for k, n in tokens.items())
    assert abs(passes - 3) < 0.01 and mixing.find_alpha(s, target_entropy=2.0) == 0.0 and mixing.find_alpha(s, max_passes=1.0) == 1.0


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>é" * 400, "<b>x" * 500
    rows = [(1, "http://a/", big), (2, None, big), (9, "http://b/ c\n", big), (3, "u", other), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (9, "again", big), (None, "n", big), (8, "u", "y" * 300_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark, pages, tmp_path):
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w")
    for split in (warc.SPLIT_BYTES, 700):
        got = warc.read_archives(manifest, split_bytes=split).collect()
        assert len(got) == pages.count()
        kinds = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to) for r in got)
        assert kinds == [(-1, "revisit", 9), (1, "revisit", 9), (2, "revisit", 9), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None), (9, "response", None), (9, "response", None)]
        want = {r.page_id: (r.html or "").encode() for r in pages.collect()}
        assert all(r.payload_bytes == len(want[r.page_id]) and (r.record_type == "revisit" or bytes(r.payload) == want[r.page_id]) for r in got)
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_false_magic_is_not_a_member(tmp_path):
    import hashlib

    one = warc.record(1, "u", b"a" * 50, hashlib.sha1(b"a" * 50).digest(), 50)
    data = b"\x1f\x8b\x08junk" + gzip.compress(b"not a record") + one + one
    (tmp_path / "x.warc.gz").write_bytes(data)
    fs, name = open_fs(str(tmp_path / "x.warc.gz"))
    at = len(data) - 2 * len(one)
    assert warc.first_member(Window(fs.open_input_file(name), len(data)), 0, len(data)) == at
    assert len(list(warc.read_split(str(tmp_path / "x.warc.gz"), 0, at + 1, block=64))) == 1
    (tmp_path / "y.warc.gz").write_bytes(one[:-10])
    with pytest.raises(ValueError):
        list(warc.read_split(str(tmp_path / "y.warc.gz"), 0, 10**6))


FOREIGN = [
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 10\r\n\r\nsoftware: \r\n\r\n",
    b"WARC/1.0\r\nwarc-type:request\r\nWARC-Record-ID:<urn:uuid:2>\r\nWARC-Target-URI: http://a/\r\nContent-Type: application/http;msgtype=request\r\nContent-Length: 18\r\n\r\nGET / HTTP/1.1\r\n\r\n\r\n\r\n",
    b"WARC/1.0\r\nWARC-TYPE:response\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Target-URI:http://a/\r\nX-Long: one\r\n  two\r\nContent-Type: application/http; msgtype=response\r\nContent-Length:72\r\n\r\nHTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n3\r\nabc\r\n2;x\r\nde\r\n0\r\n\r\n\r\n\r\n",
    b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:uuid:4>\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:5>\r\nWARC-Payload-Digest: sha1:A9993E364706816ABA3E25717850C26C9CD0D89D\r\nContent-Type: application/http\r\nContent-Length: 43\r\n\r\nHTTP/1.0 200 OK\r\nContent-Length: 999\r\n\r\nabc",
]


def test_archives_of_other_writers(spark, tmp_path):
    import hashlib

    FOREIGN[2] = FOREIGN[2].replace(b"Content-Length:72", b"Content-Length:%d" % (len(FOREIGN[2].partition(b"\r\n\r\n")[2]) - 4))
    data = b"".join(map(gzip.compress, FOREIGN))
    (tmp_path / "z.warc.gz").write_bytes(data)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/z.warc.gz", len(data))], "path string, n_bytes long")
    for split in (100, 1 << 20):
        got = sorted((r.record_id, r.url, bytes(r.payload), r.payload_digest) for r in warc.read_archives(manifest, split_bytes=split).collect())
        assert got == [("<urn:uuid:3>", "http://a/", b"abcde", hashlib.sha1(b"abcde").hexdigest()), ("<urn:uuid:5>", None, b"abc", hashlib.sha1(b"abc").hexdigest())]
    every = warc.read_archives(manifest, kinds=("warcinfo", "request", "response", "metadata")).collect()
    assert sorted(r.record_type for r in every) == ["metadata", "request", "response", "response", "warcinfo"] and all(r.page_id is None for r in every)
