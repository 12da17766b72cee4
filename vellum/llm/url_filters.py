"""URL filters: dated list entries as validity intervals, joined as of the time of each capture.

Entries ``(list_name, kind, key, action, effective_date)`` come in date order or not. ``key`` is a host suffix
(``example.com``, in any case) or a host and its first path segment (``a.example.com/en``, whose case counts); ``action`` is ``add`` or ``remove``;
``kind`` is ``block`` or ``allow``. An entry holds from its day until the next entry of the same list, kind and key.

Everything is DataFrame expressions. The verdict depends only on the site (host and first path segment) and the day,
so it is made once for each distinct pair (combined before the shuffle) and joined back to the captures. That join has
one row per site and day on its small side, so AQE can split a hot site on the capture side. A key's intervals are one
array: entries are reduced to one per list, kind, key and day first, so its length is bounded by the days that the
lists cover, whatever the number of entries.

Null or unparsable URLs have a null host, match nothing and are kept. Null fetch times match nothing and are kept.
Entries with a null key, day or unknown action are ignored. Entries of one day that contradict each other: ``remove``
wins. Repeated captures give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def segment_of(url: Column) -> Column:
    """First path segment, empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)", 1), F.lit(""))


def keys_of(host: Column, segment: Column) -> Column:
    """The list keys that apply to a site: every suffix of the host at a dot, and the host with its first segment."""
    labels = F.split(host, r"\.")
    keys = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(segment == "", keys).otherwise(F.array_append(keys, F.concat(host, F.lit("/"), segment)))


def entry_key(key: Column) -> Column:
    """An entry's key with its host in lower case; the path segment keeps its case, as paths do."""
    host = F.substring_index(key, "/", 1)
    return F.concat(F.lower(host), F.substring(key, F.length(host) + 1, F.length(key)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``key, intervals array<struct<valid_from, valid_to, kind, list_name>>``: one row per key; ``valid_to`` is exclusive."""
    day = (
        entries.where("key IS NOT NULL AND effective_date IS NOT NULL AND action IN ('add', 'remove')")
        .groupBy("list_name", "kind", entry_key(F.col("key")).alias("key"), F.to_date("effective_date").alias("valid_from"))
        .agg(F.max("action").alias("action"))
    )
    following = Window.partitionBy("list_name", "kind", "key").orderBy("valid_from")
    spans = day.withColumn("valid_to", F.lead("valid_from").over(following)).where("action = 'add'")
    return spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("valid_from", "valid_to", "kind", "list_name"))).alias("intervals"))


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """The captures with ``host, n_active, rule_key, rule_list, kept``.

    ``n_active`` counts the entries that apply to the capture on its day. The longest key decides; of equal keys an
    ``allow`` entry wins, then the list name that sorts last. ``kept`` is false where the deciding entry blocks.
    Captures keep all their columns; columns of these names, in whatever case, are replaced.
    """
    mine = {"host", "n_active", "rule_key", "rule_list", "kept"}
    rest = F.struct(*[F.col(f"`{c}`") for c in captures.columns if c.lower() not in mine], F.lit(0).alias("_"))  # apart from the names used here
    site = captures.select(rest.alias("rest"), host_of(F.col(url)).alias("host"), segment_of(F.col(url)).alias("segment"), F.to_date(F.col(fetched)).alias("day"))
    pairs = site.where("host IS NOT NULL AND day IS NOT NULL").select("host", "segment", "day").distinct()
    asked = pairs.select("*", F.explode(keys_of(F.col("host"), F.col("segment"))).alias("key"))
    active = asked.join(validity_intervals(entries), "key").withColumn(
        "active", F.filter("intervals", lambda x: (x.valid_from <= F.col("day")) & (x.valid_to.isNull() | (F.col("day") < x.valid_to)))
    )
    best = F.array_max(F.transform("active", lambda x: F.struct(F.length("key").alias("size"), (x.kind == "allow").alias("allow"), x.list_name.alias("list"), F.col("key").alias("rule"))))
    verdict = (
        active.where(F.size("active") > 0)
        .groupBy("host", "segment", "day")
        .agg(F.sum(F.size("active")).alias("n_active"), F.max(best).alias("best"))
    )
    kept = [c for c in captures.columns if c.lower() not in mine]
    return site.join(verdict, ["host", "segment", "day"], "left").select(
        *[F.col("rest").getField(c).alias(c) for c in kept],
        "host",
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("best.rule").alias("rule_key"),
        F.col("best.list").alias("rule_list"),
        F.coalesce(F.col("best.allow"), F.lit(True)).alias("kept"),
    )


#: The list history of the query: (list_name, kind, key, action, effective_date). Host rules are added from the captures.
FIXED_ENTRIES = [
    ("adult", "block", "adult-x.example.net", "add", "2021-03-01"),
    ("registry", "block", "example.net", "add", "2022-01-01"),
    ("registry", "block", "example.net", "remove", "2022-07-01"),
    ("registry", "block", "example.org", "add", "2023-02-01"),
    ("partners", "allow", "example.org", "add", "2023-06-01"),
    ("partners", "allow", "example.org", "remove", "2023-09-15"),
]


def host_rules(hosts: DataFrame) -> DataFrame:
    """A list history made from the hosts themselves, as the tables bring none: the MD5 of the host sets kind and days."""
    h = F.conv(F.substring(F.md5("host"), 1, 7), 16, 10).cast("long")
    base = F.lit("2021-01-01").cast("date")
    at = lambda days: F.date_add(base, days.cast("int"))
    step = lambda kind, key, action, when, days: F.when(when, F.struct(F.lit("review").alias("list_name"), F.lit(kind).alias("kind"), key.alias("key"), F.lit(action).alias("action"), at(days).alias("effective_date")))
    host = F.col("host")
    steps = F.array(
        step("block", host, "add", h % 4 == 0, h % 500),
        step("block", host, "remove", h % 4 == 0, h % 500 + 150 + h % 90),
        step("block", host, "add", h % 8 == 0, h % 500 + 400 + h % 77),
        step("block", F.concat(host, F.lit("/en")), "add", h % 4 == 1, h % 900),
        step("allow", host, "add", h % 8 == 4, h % 500 + 60),
        step("allow", host, "remove", h % 8 == 4, h % 500 + 120),
    )
    return hosts.select(F.explode(F.array_compact(steps)).alias("e")).select("e.*")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` as a capture; the day of fetching follows from page_id, as the table has none."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2021-01-01").cast("date"), (F.col("page_id") * 37 % 1461).cast("int")))
    fixed = spark.createDataFrame(FIXED_ENTRIES, "list_name string, kind string, key string, action string, effective_date string").withColumn("effective_date", F.to_date("effective_date"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    return url_filter(captures, fixed.unionByName(host_rules(hosts))).select("page_id", "host", "fetched_on", "n_active", "rule_key", "rule_list", "kept")


OP1_SQL = """
WITH captures AS (
  SELECT page_id, nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\\.+$', ''), '') AS host,
         coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)', 1), '') AS segment,
         DATE '2021-01-01' + CAST(page_id * 37 % 1461 AS INTEGER) AS fetched_on
  FROM pages),
hosts AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) AS h FROM captures WHERE host IS NOT NULL),
entries AS (
  SELECT * FROM (VALUES
    ('adult', 'block', 'adult-x.example.net', 'add', DATE '2021-03-01'), ('registry', 'block', 'example.net', 'add', DATE '2022-01-01'),
    ('registry', 'block', 'example.net', 'remove', DATE '2022-07-01'), ('registry', 'block', 'example.org', 'add', DATE '2023-02-01'),
    ('partners', 'allow', 'example.org', 'add', DATE '2023-06-01'), ('partners', 'allow', 'example.org', 'remove', DATE '2023-09-15')) t(list_name, kind, key, action, day)
  UNION ALL SELECT 'review', 'block', host, 'add', DATE '2021-01-01' + CAST(h % 500 AS INTEGER) FROM hosts WHERE h % 4 = 0
  UNION ALL SELECT 'review', 'block', host, 'remove', DATE '2021-01-01' + CAST(h % 500 + 150 + h % 90 AS INTEGER) FROM hosts WHERE h % 4 = 0
  UNION ALL SELECT 'review', 'block', host, 'add', DATE '2021-01-01' + CAST(h % 500 + 400 + h % 77 AS INTEGER) FROM hosts WHERE h % 8 = 0
  UNION ALL SELECT 'review', 'block', host || '/en', 'add', DATE '2021-01-01' + CAST(h % 900 AS INTEGER) FROM hosts WHERE h % 4 = 1
  UNION ALL SELECT 'review', 'allow', host, 'add', DATE '2021-01-01' + CAST(h % 500 + 60 AS INTEGER) FROM hosts WHERE h % 8 = 4
  UNION ALL SELECT 'review', 'allow', host, 'remove', DATE '2021-01-01' + CAST(h % 500 + 120 AS INTEGER) FROM hosts WHERE h % 8 = 4),
days AS (SELECT list_name, kind, lower(split_part(key, '/', 1)) || substr(key, length(split_part(key, '/', 1)) + 1) AS key, day, max(action) AS action FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(day) OVER (PARTITION BY list_name, kind, key ORDER BY day) AS until FROM days),
hits AS (
  SELECT c.page_id, s.key, s.kind, s.list_name
  FROM captures c JOIN spans s ON s.action = 'add' AND s.day <= c.fetched_on AND (s.until IS NULL OR c.fetched_on < s.until)
   AND (c.host = s.key OR ends_with(c.host, '.' || s.key) OR (c.segment <> '' AND c.host || '/' || c.segment = s.key))),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY page_id) AS n,
         row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, kind ASC, list_name DESC) AS r
  FROM hits)
SELECT c.page_id, c.host, c.fetched_on, coalesce(r.n, 0) AS n_active, r.key AS rule_key, r.list_name AS rule_list,
       coalesce(r.kind = 'allow', true) AS kept
FROM captures c LEFT JOIN ranked r ON r.page_id = c.page_id AND r.r = 1
"""
