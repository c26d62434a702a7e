"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscript.llm.common import table, written

#: How much of the way from the entropy of the sources' own shares to the largest possible one the weights are to go, where
#: no entropy is asked for; passes over a source at most.
GAP, REPEATS = 0.5, 4.0
#: Halvings of the exponent's interval [0, 1].
HALVINGS = 40
#: Documents of a part of a block permutation, about: its tokens are summed before those of single documents are.
PART_DOCUMENTS = 1 << 16
SEED = "mix"


def tokens_of(text: Column) -> Column:
    """Words of a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weights(sources: DataFrame, entropy: float | None = None, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """sources (source, tokens) to source, tokens, weight, exponent, budget: a row per source with tokens.

    Shares p become p**x / sum(p**x). x is the largest exponent in [0, 1], by bisection, at which the weights reach the
    entropy (a share of the largest possible; GAP applies where none is given); it rises again as far as no source is to be
    passed over more than `repeats` times. budget: all tokens, where none is given. Sources without tokens are left out. The
    bisection reads one row with a number per source.
    """
    some = sources.where("tokens > 0")
    shares = some.agg(F.array_sort(F.collect_list(F.col("tokens").cast("double"))).alias("each"), F.sum("tokens").alias("total"))  # a number per source
    total = F.lit(budget).cast("double") if budget is not None else F.col("total").cast("double")
    add = lambda array: F.aggregate(array, F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: add(F.transform("p", lambda v: F.pow(v, x)))
    log_mean = lambda x: add(F.transform("p", lambda v: F.pow(v, x) * F.log(v)))
    # entropy of p**x / Z is log Z - x * sum(p**x * log p) / Z
    reached = lambda x: F.log(norm(x)) - x * log_mean(x) / norm(x)
    most = F.log(F.size("p").cast("double"))
    target = F.lit(entropy) * most if entropy is not None else reached(F.lit(1.0)) + F.lit(GAP) * (most - reached(F.lit(1.0)))
    wide = lambda x: reached(x) >= F.col("target") - F.lit(1e-12)
    # the least share is repeated most: the exponent must keep min(p)**(x - 1) / Z * budget / total within the limit
    often = lambda x: F.pow(F.array_min("p"), x - F.lit(1.0)) / norm(x) * F.col("budget") / F.col("total") <= F.greatest(F.lit(repeats), F.col("budget") / F.col("total"))

    def bisected(low_side) -> Column:
        """The end of the interval at which the halving arrives; low_side says whether the half below is left."""
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        halved = lambda s, _: F.when(low_side((s["lo"] + s["hi"]) / 2), F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi"))).otherwise(F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halved)

    one = shares.where("total > 0").select("total", total.alias("budget"), F.transform("each", lambda v: v / F.col("total")).alias("p")).withColumn("target", target)
    for_entropy = F.when(wide(F.lit(1.0)), 1.0).otherwise(bisected(lambda x: ~wide(x))["lo"])
    for_repeats = F.when(often(F.lit(0.0)), 0.0).otherwise(bisected(lambda x: often(x))["hi"])
    found = one.select("total", "budget", "p", F.greatest(for_entropy, for_repeats).alias("exponent")).select("total", "budget", "exponent", norm(F.col("exponent")).alias("z")).first()
    total_, budget_, exponent, z = found or (1.0, 0.0, 1.0, 1.0)  # without tokens there is no source either
    weight = F.pow(F.col("tokens") / F.lit(float(total_)), F.lit(exponent)) / F.lit(z)
    return some.select("source", "tokens", weight.alias("weight"), F.lit(exponent).alias("exponent"), F.floor(F.round(weight * F.lit(budget_), 3)).cast("long").alias("budget"))


def mix(docs: DataFrame, entropy: float | None = None, repeats: float = REPEATS, budget: int | None = None, seed: str = SEED) -> DataFrame:
    """Rows of docs with copies, tokens, place and weight: a document is to be used `copies` times, 0 or more.

    docs has doc_id, text and source. A source's budget of tokens is spent on whole passes over it, and then on the
    documents that come first in a permutation by hash, up to the last that fits. place (0 to 1) is a document's place in
    that permutation. Sums run over parts of each permutation and then within a part, so a large source needs no single
    task. A null source is a source of its own; a null or empty text has no tokens and is never used (copies 0);
    repeated rows count each. Null doc_ids share a place in the order. An empty table gives no row.
    """
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("source"), tokens_of(F.col("text")).alias("tokens"))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")
    rows = written(rows.withColumn("place", order), "counted")
    parts_bits = max(8, (rows.count() // PART_DOCUMENTS).bit_length())
    rows = rows.withColumn("part", F.shiftright("place", 48 - parts_bits).cast("int"))
    sources = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    plan = weights(sources, entropy, repeats, budget).withColumnRenamed("tokens", "source_tokens").withColumn("passes", F.floor(F.col("budget") / F.col("source_tokens"))).withColumn("rest", F.col("budget") - F.col("passes") * F.col("source_tokens"))
    parts = rows.groupBy("source", "part").agg(F.sum("tokens").alias("part_tokens"))
    before = parts.withColumn("before", F.sum("part_tokens").over(Window.partitionBy("source").orderBy("part")) - F.col("part_tokens"))  # a row per part
    within = Window.partitionBy("source", "part").orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("reach", F.sum("tokens").over(within)).join(before.select("source", "part", "before"), ["source", "part"]).join(plan, "source", "left")
    used = F.when(F.col("tokens") > 0, F.col("passes") + F.when(F.col("before") + F.col("reach") <= F.col("rest"), 1).otherwise(0)).otherwise(0)
    return placed.select("doc_id", F.when(F.col("source") != "-", F.substring("source", 2, 1 << 20)).alias("source"), "tokens", (F.col("place") / F.lit(float(1 << 48))).alias("place"), F.coalesce(used, F.lit(0)).cast("int").alias("copies"), F.round("weight", 6).alias("weight"), F.round("exponent", 6).alias("exponent"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("place")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as mix() plans, under its own columns, whatever their names.

    Rows with a null doc_id or source are planned as others; a null or empty text is never used. Rows of the same doc_id,
    source and number of tokens share out the numbers that are planned for them. An empty table stays empty.
    """
    id_, source, tokens = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-")), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")), F.col("tokens")
    keys = ["id", "source", "tokens"]
    plan = mix(docs).where("copies > 0").groupBy(id_.alias("id"), source.alias("source"), tokens).agg(F.sort_array(F.collect_list("copies"), False).alias("each"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), id_.alias("id"), source.alias("source"), tokens_of(F.col("text")).alias("tokens"), F.xxhash64("text").alias("hash"))
    placed = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))).join(plan, keys).where("n <= size(each)")
    return placed.select("row", F.explode(F.sequence(F.lit(1), F.element_at("each", F.col("n"))))).select("row.*")


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, '=' || source AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens,
    CAST('0x' || substr(md5('mix:' || doc_id), 1, 12) AS BIGINT) AS place
  FROM documents
), src AS (
  SELECT source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY source HAVING sum(tokens) > 0
), total AS (
  SELECT sum(tokens)::DOUBLE AS total, count(*) AS n FROM src
), p AS (
  SELECT source, tokens, tokens / total AS p, n, total FROM src, total
), goal AS (
  SELECT h0 + 0.5 * (ln(n) - h0) - 1e-12 AS t FROM (SELECT ln(sum(p)) - sum(p * ln(p)) / sum(p) AS h0, max(n) AS n FROM p)
), h AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN e >= t THEN (lo + hi) / 2 ELSE lo END, CASE WHEN e >= t THEN hi ELSE (lo + hi) / 2 END FROM goal, (
    SELECT i, lo, hi, ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) AS e FROM h, p WHERE i < 40 GROUP BY i, lo, hi)
), one AS (
  SELECT CASE WHEN ln(sum(p)) - sum(p * ln(p)) / sum(p) >= (SELECT t FROM goal) THEN 1.0 ELSE (SELECT lo FROM h WHERE i = 40) END AS x FROM p
), r AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN e THEN lo ELSE (lo + hi) / 2 END, CASE WHEN e THEN (lo + hi) / 2 ELSE hi END FROM (
    SELECT i, lo, hi, pow(min(p), (lo + hi) / 2 - 1) / sum(pow(p, (lo + hi) / 2)) <= 4 AS e FROM r, p WHERE i < 40 GROUP BY i, lo, hi)
), two AS (
  SELECT CASE WHEN 1 / min(p) / count(*) <= 4 THEN 0.0 ELSE (SELECT hi FROM r WHERE i = 40) END AS x FROM p
), z AS (
  SELECT max(x) AS x, sum(pow(p, x)) AS z FROM p, (SELECT greatest(one.x, two.x) AS x FROM one, two)
), plan AS (
  SELECT source, tokens AS source_tokens, pow(p, x) / z AS weight, x AS exponent, floor(round(pow(p, x) / z * total, 3))::BIGINT AS budget FROM p, z
), placed AS (
  SELECT d.*, weight, exponent, budget // source_tokens AS passes, budget % source_tokens AS rest, sum(d.tokens) OVER (PARTITION BY source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS reach FROM d LEFT JOIN plan USING (source)
)
SELECT doc_id, substr(source, 2) AS source, tokens, CASE WHEN tokens > 0 THEN passes + CASE WHEN reach <= rest THEN 1 ELSE 0 END ELSE 0 END::INT AS copies, round(weight, 6) AS weight, round(exponent, 6) AS exponent FROM placed
"""
