"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

Source token shares ``p`` become weights ``q ~ p ** alpha``. The exponent is bisected between 0 (uniform) and 1 (as found)
to meet a target entropy, or the largest number of passes that any source may make over its own documents. A token
budget times ``q`` gives each source its quota: whole passes over the source, then a part of one more pass. For that
part the source's documents are dealt by hash into blocks of about ``block_tokens``, the blocks are put in a hashed
order, blocks are taken whole while they fit, and of the next block the documents that fit, again in hashed order.

All of it is DataFrame expressions. Totals are combined before the shuffle, so a source that holds most rows costs no
more than another. Running sums go over blocks (one row for each ``block_tokens``), in two levels, and over documents only
inside the one boundary block of each source. Six halvings of the bisection are one aggregate over the table of sources.

Null sources and ``''`` are one source. Null or wordless texts have no tokens; they follow their source's whole passes
and cost nothing in the partial one. Equal documents are told apart by their rows, so repeated rows are drawn
separately. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm import common

#: Halvings of [0, 1] for the exponent, which is then rounded to 6 digits.
BISECTIONS = 24
#: Halvings that one aggregate serves.
LEVELS = 6
#: Leading hexadecimal digits of a block's place in the order, by which running sums are split.
SPLIT = 2
#: Weights are integers out of this many, so that quotas do not hang on the last bits of a logarithm.
PARTS = 1_000_000


def _measure(sources: DataFrame, total: float, alphas: list[float], budget: float | None) -> list[tuple[float, float]]:
    """For each exponent the entropy of the weights in nats, and the passes that the most repeated source makes: one
    aggregate for all of them."""
    w = F.pow(F.col("tokens") / F.lit(total), F.col("alpha"))
    tried = sources.select("tokens", F.posexplode(F.array(*map(F.lit, alphas))).alias("at", "alpha")).withColumn("w", w)
    each = tried.groupBy("at").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.ln("w")).alias("wlw"), F.max(F.col("w") / F.col("tokens")).alias("most"), F.min(F.col("w") / F.col("tokens")).alias("least"))
    found = {r["at"]: r for r in each.collect()}  # a row for each exponent
    out = []
    for k in range(len(alphas)):
        r = found[k]
        tokens = r["z"] / r["least"] if budget is None else budget
        out.append((math.log(r["z"]) - r["wlw"] / r["z"], tokens * r["most"] / r["z"]))
    return out


def find_alpha(sources: DataFrame, target_entropy: float | None = None, max_passes: float | None = None, budget: float | None = None) -> float:
    """The largest exponent that reaches ``target_entropy`` (in nats), or the smallest that keeps within ``max_passes``.

    ``sources``: ``source, tokens`` with tokens above zero. With no ``budget`` it is the least one that uses every
    source in full once. Out of reach: the end of [0, 1] that comes closest. ``LEVELS`` halvings share an aggregate: all
    the points that they could ask about are measured together.
    """
    total = float(sources.agg(F.sum("tokens").alias("all")).first()["all"])
    low, high = 0.0, 1.0
    for _ in range(BISECTIONS // LEVELS):
        step = (high - low) / (1 << LEVELS)
        points = [low + k * step for k in range(1, 1 << LEVELS)]
        measured = dict(zip(points, _measure(sources, total, points, budget), strict=True))
        for _ in range(LEVELS):
            mid = (low + high) / 2
            entropy, passes = measured[mid]
            if target_entropy is not None:
                low, high = (mid, high) if entropy >= target_entropy else (low, mid)
            else:
                low, high = (low, mid) if passes <= max_passes else (mid, high)
    return round(low if target_entropy is not None else high, 6)


def weights(sources: DataFrame, alpha: float) -> DataFrame:
    """``source, tokens, parts``: the weight of each source in millionths, at least 1 and rounded half up."""
    total = sources.agg(F.sum("tokens").cast("double").alias("all")).first()["all"] or 1.0
    w = F.pow(F.col("tokens") / F.lit(total), F.lit(alpha))
    norm = sources.agg(F.sum(w).alias("z")).first()["z"] or 1.0
    return sources.select("source", "tokens", F.greatest(F.floor(w / F.lit(norm) * PARTS + 0.5), F.lit(1)).cast("long").alias("parts"))


def mix(docs: DataFrame, *, budget: int | None = None, budget_share: tuple[int, int] | None = None, target_entropy: float | None = None, entropy_share: float | None = None, max_passes: float | None = None, block_tokens: int = 100_000, seed: int = 42, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, source, n_tokens, copies, block, part`` per row of ``docs``: how often the mixture uses it.

    ``copies`` counts the whole passes and the partial one; ``block`` is the row's block in the partial pass and
    ``part`` whether that pass reaches the row. ``entropy_share`` states the target entropy as a share of the uniform
    one. ``budget`` is in words, or ``budget_share`` a fraction ``(a, b)`` of all words. With neither it is the least
    that uses every source in full at least once, so that no row is dropped.
    """
    spark = docs.sparkSession
    path = common.workdir(spark, "mix")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), common.n_words(F.col(text)).alias("n_tokens"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("key"),
    )
    rows = common.table(rows, f"{path}/rows")
    sources = common.table(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), f"{path}/sources")
    known = sources.where("tokens > 0")
    alpha = 1.0
    if budget_share is not None:
        budget = (known.agg(F.sum("tokens").alias("t")).first()["t"] or 0) * budget_share[0] // budget_share[1]
    if found := known.agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first():
        if entropy_share is not None and found["n"]:
            target_entropy = entropy_share * math.log(found["n"])
        if found["n"] > 1 and (target_entropy is not None or max_passes is not None):
            alpha = find_alpha(known, target_entropy, max_passes, budget)
    q = weights(known, alpha)
    if budget is None:  # every source's quota is its own size at least
        budget = q.agg(F.max(F.ceil(F.col("tokens") * PARTS / F.col("parts"))).cast("long").alias("least")).first()["least"] or 0
    quota = F.floor(F.lit(budget).cast("decimal(38,0)") * F.col("parts") / PARTS).cast("long")
    plan = q.withColumn("quota", quota).select(
        "source", F.expr("quota div tokens").alias("passes"), (F.col("quota") % F.col("tokens")).alias("rest"), F.ceil(F.col("tokens") / block_tokens).cast("long").alias("n_blocks")
    )
    plan = common.table(plan, f"{path}/plan")
    head = F.conv(F.substring("key", 1, 12), 16, 10).cast("long")
    dealt = rows.join(F.broadcast(plan) if plan.count() <= 10_000 else plan, "source", "left").withColumn("block", F.coalesce(head % F.col("n_blocks"), F.lit(0)))
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("block"), "block"))).withColumn("lead", F.substring("place", 1, SPLIT))
    leads = blocks.groupBy("source", "lead").agg(F.sum("size").alias("size"))  # 16 ** SPLIT rows for each source at most
    ahead = Window.partitionBy("source").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    leads = leads.select("source", "lead", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "lead").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    left = F.col("rest") - F.col("before")
    placed = blocks.join(leads, ["source", "lead"]).withColumn("before", before).select("source", "block", left.alias("left"), (left >= F.col("size")).alias("whole"), ((left > 0) & (left < F.col("size"))).alias("boundary"))
    placed = common.table(placed, f"{path}/blocks")
    whole = placed.where("whole").select("source", "block", F.lit(True).alias("in_whole"))
    edge = placed.where("boundary").select("source", "block", "left")
    sized = dealt.select("doc_id", "source", "n_tokens", "key", "block", "passes")
    marked = sized.join(whole.unionByName(edge.withColumn("in_whole", F.lit(False)), allowMissingColumns=True), ["source", "block"], "left")
    inside = marked.where("in_whole = false")
    so_far = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("part", so_far <= F.col("left"))
    outside = marked.where("in_whole IS NULL OR in_whole").withColumn("part", F.coalesce("in_whole", F.lit(False)))
    out = ["doc_id", "source", "n_tokens", (F.coalesce("passes", F.lit(1)) + F.col("part").cast("long")).alias("copies"), "block", "part"]
    return outside.select(*out).unionByName(inside.select(*out))


def repeat(docs: DataFrame, **how) -> DataFrame:
    """The mixture's rows: every row of ``docs`` as often as ``mix(docs, **how)`` uses it, with all its columns.

    Numbers are joined by id, source and number of words. Rows equal in all three are numbered on both sides, so that each
    number of copies is used for one row.
    """
    doc_id, text, source = how.get("doc_id", "doc_id"), how.get("text", "text"), how.get("source", "source")
    number = lambda order: F.row_number().over(Window.partitionBy("id", "source", "n").orderBy(order))
    plan = mix(docs, **how).select(F.col("doc_id").alias("id"), "source", F.col("n_tokens").alias("n"), "copies").withColumn("k", number("copies"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source"), common.n_words(F.col(text)).alias("n"), F.xxhash64(F.col(text)).alias("place"), row)
    marked = marked.withColumn("k", number("place"))
    drawn = marked.alias("m").join(plan.alias("p"), F.col("m.id").eqNullSafe(F.col("p.id")) & (F.col("m.source") == F.col("p.source")) & (F.col("m.n") == F.col("p.n")) & (F.col("m.k") == F.col("p.k")))
    return drawn.where("copies > 0").select("m.row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: a mixture of as many words as six tenths of the tables', whose entropy over the sources is 0.995
    of the uniform one. Large sources are drawn in part, the smallest may repeat."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), budget_share=(6, 10), entropy_share=OP3_SHARE)


#: Entropy of the query's mixture as a share of the uniform one.
OP3_SHARE = 0.995

OP3_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
sources AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM rows GROUP BY source HAVING sum(n_tokens) > 0),
one AS (SELECT list(tokens / total ORDER BY source) AS shares, count(*) AS n FROM sources, (SELECT CAST(sum(tokens) AS DOUBLE) AS total FROM sources)),
bisect(step, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END
  FROM (SELECT step, low, high, mid, ln(list_sum(w)) - list_sum(list_transform(w, lambda x: x * ln(x))) / list_sum(w) >= {OP3_SHARE} * ln(n) AS ok
        FROM (SELECT step, low, high, (low + high) / 2 AS mid, n, list_transform(shares, lambda s: pow(s, (low + high) / 2)) AS w FROM bisect, one WHERE step < {BISECTIONS}))),
exponent AS (SELECT CASE WHEN (SELECT n FROM one) > 1 THEN round(low, 6) ELSE 1.0 END AS alpha FROM bisect WHERE step = {BISECTIONS}),
powered AS (SELECT source, tokens, pow(tokens / (SELECT CAST(sum(tokens) AS DOUBLE) FROM sources), (SELECT alpha FROM exponent)) AS w FROM sources),
plan AS (
  SELECT source, CAST(quota // tokens AS BIGINT) AS passes, CAST(quota % tokens AS BIGINT) AS rest, CAST(ceil(tokens / 100000) AS BIGINT) AS n_blocks
  FROM (SELECT source, tokens, CAST((SELECT sum(tokens) * 6 // 10 FROM sources) * greatest(CAST(floor(w / (SELECT sum(w) FROM powered) * {PARTS} + 0.5) AS BIGINT), 1) // {PARTS} AS BIGINT) AS quota FROM powered)),
dealt AS (SELECT rows.*, passes, rest, coalesce(CAST('0x' || substr(key, 1, 12) AS BIGINT) % n_blocks, 0) AS block FROM rows LEFT JOIN plan USING (source)),
blocks AS (SELECT source, block, sum(n_tokens) AS size, max(rest) AS rest, md5('42:block:' || block) AS k FROM dealt GROUP BY source, block),
placed AS (SELECT source, block, size, rest - coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM blocks),
summed AS (
  SELECT d.*, p.size, p.room, sum(n_tokens) OVER (PARTITION BY d.source, d.block ORDER BY key, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS so_far
  FROM dealt d JOIN placed p ON d.source = p.source AND d.block = p.block)
SELECT doc_id, source, n_tokens, coalesce(passes, 1) + CAST(part AS BIGINT) AS copies, block, part
FROM (SELECT *, coalesce(room >= size OR (room > 0 AND so_far <= room), false) AS part FROM summed)
"""
