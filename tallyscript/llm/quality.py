"""Quality rules: failures of documents by host, rates shrunk with an empirical beta prior, and verdicts on hosts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscript.llm.common import per_text, table, written

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50

#: A host is rejected if its shrunken failure rate, less so many of its standard deviations, is at least this.
HOST_RATE, DEVIATIONS = 0.5, 2.0
#: Most documents that the prior may weigh as much as, for hosts whose rates hardly differ.
PRIOR_MOST = 1000.0


def measures(texts: list[bytes]) -> list[list]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    rows = []
    for text in texts:
        words = text.split()
        rows.append([len(words), len(b"".join(words).translate(None, CONTINUED)), len(text) - len(text.translate(None, SYMBOLS)), repeated_lines(text), repeated_words(words)])
    return [list(c) for c in zip(*rows, strict=True)]


#: The bytes of UTF-8 that don't begin a code point.
CONTINUED = bytes(range(0x80, 0xC0))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    first: dict[tuple, int] = {}
    covered = bytearray(len(words))
    if len(set(windows)) == len(windows):
        return 0
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            covered[i : i + 3] = covered[j : j + 3] = b"\1\1\1"
    return sum(covered)


def host_verdicts(measured: DataFrame, rate: float = HOST_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """Per host: n_docs, n_failed, host_rate (shrunken failure rate), host_rejected.

    The beta prior's mean is the share of failures over all hosts, its weight follows from how much more the hosts'
    rates vary than chance alone would have them (method of moments). With the host's own counts it gives a beta distribution of the host's rate; the verdict takes
    the rate at `deviations` under its mean, which few documents don't lift over the limit. Null hosts have no verdict.
    """
    hosts = measured.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    moments = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("k"), F.count("*").alias("h"), F.sum(F.col("n_docs") * F.col("n_docs")).alias("nn"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("kk")
    )
    n, h = F.col("n"), F.col("h")
    p = F.try_divide("k", "n")
    chance = p * (1 - p)
    between = F.try_divide(F.col("kk") - n * p * p - (h - 1) * chance, n - F.try_divide("nn", "n"))  # what the rates vary beyond chance
    weight = F.when((h > 1) & (n > h) & (between > chance / (PRIOR_MOST + 1)), F.try_divide(chance, between) - 1).otherwise(F.lit(PRIOR_MOST))
    mean, most = moments.select(p.alias("mean"), F.greatest(F.lit(0.0), F.least(F.lit(PRIOR_MOST), weight)).alias("weight")).first()
    mean, most = mean or 0.0, most or 0.0
    shrunk = (F.col("n_failed") + F.lit(mean * most)) / (F.col("n_docs") + F.lit(most))
    sure = shrunk - F.lit(deviations) * F.sqrt(shrunk * (1 - shrunk) / (F.col("n_docs") + F.lit(most) + 1))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), (sure >= rate).alias("host_rejected"))


def judge(docs: DataFrame, host: str = "source", rate: float = HOST_RATE, deviations: float = DEVIATIONS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate, host_rejected.

    docs has doc_id, text and the host column; other columns are ignored. A null text has no words and fails. A document
    that doesn't fail is kept unless its host is rejected; with a null host it is kept, and its host_rate is null. Repeated rows and null doc_ids are
    judged row by row. An empty table gives no row.
    """
    fields = pa.schema([(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
    picked = docs.select("doc_id", "text", F.col(host).cast("string").alias("host"))
    measured = per_text(picked, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long", fields, measures, keep=("doc_id", "host"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    measured = written(measured.withColumn("base_failed", failed), "measured")
    hosts = host_verdicts(measured, rate, deviations).select("host", F.round("host_rate", 6).alias("host_rate"), "host_rejected")
    return measured.join(hosts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))).alias("kept"),
        "host_rate", F.coalesce("host_rejected", F.lit(False)).alias("host_rejected"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), line AS (
  SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines FROM (
    SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l) GROUP BY doc_id
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (
    SELECT win.doc_id, unnest([i, i + 1, i + 2]) AS pos FROM win JOIN (SELECT doc_id, x FROM win GROUP BY doc_id, x HAVING count(*) > 1) USING (doc_id, x)) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, host, len(w)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN line USING (doc_id) LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS k FROM f WHERE host IS NOT NULL GROUP BY host
), s AS (
  SELECT sum(n) AS n, sum(k) AS k, count(*)::DOUBLE AS h, sum(n * n) AS nn, sum(k * k / n) AS kk, sum(k) / sum(n) AS p FROM h
), b AS (
  SELECT p, h, n, p * (1 - p) AS chance, CASE WHEN n - nn / n <> 0 THEN (kk - n * p * p - (h - 1) * p * (1 - p)) / (n - nn / n) END AS between_ FROM s
), prior AS (
  SELECT p, greatest(0, least(1000, CASE WHEN h > 1 AND n > h AND between_ > chance / 1001 THEN chance / between_ - 1 ELSE 1000 END)) AS weight FROM b
), v AS (
  SELECT host, r AS host_rate, r - 2 * sqrt(r * (1 - r) / (n + weight + 1)) >= 0.5 AS host_rejected FROM (SELECT host, h.n, weight, (k + p * weight) / (h.n + weight) AS r FROM h, prior)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(host_rejected, false) AS kept, round(host_rate, 6) AS host_rate, coalesce(host_rejected, false) AS host_rejected FROM f LEFT JOIN v USING (host)
"""
