"""Transcript text to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscript.functions.text import LINE, clock_seconds, lines_of, strip, visual_of, without_visual

KEYS = ("job_id", "chunk_no", "run_no")


def parse_v04(runs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """runs (keys, text) to lines (keys, line_no, ts, sec, speaker, content): lines without clock and speaker are left out."""
    line = F.posexplode(lines_of(strip(F.col("text")))).alias("line_no", "line")
    part = lambda k: F.regexp_extract("line", LINE, k)
    rows = runs.select(*keys, line).withColumn("line", strip(F.col("line"))).where(F.col("line").rlike(LINE))
    rows = rows.select(*keys, "line_no", part(1).alias("ts"), strip(part(2)).alias("speaker"), strip(part(3)).alias("content"))
    return rows.select(*keys, "line_no", "ts", clock_seconds(F.col("ts")).cast("int").alias("sec"), "speaker", "content")


def parse_v03(runs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As parse_v04, with bracketed spans moved from content to visual."""
    return parse_v04(runs, keys).withColumn("visual", visual_of(F.col("content"))).withColumn("content", without_visual(F.col("content")))


def sections(prompts: DataFrame) -> DataFrame:
    """prompts (id, prompt_text) to id, name, body, position: parts under **NAME:** marks; of a name used twice the last holds."""
    mark = r"\*\*([A-Z\s]+):\*\*"
    names = F.regexp_extract_all("prompt_text", F.lit(mark), F.lit(1))
    bodies = F.slice(F.split("prompt_text", mark, -1), 2, F.greatest(F.size(names), F.lit(1)))
    pairs = F.posexplode(F.arrays_zip(names.alias("name"), bodies.alias("body"))).alias("position", "pair")
    rows = prompts.where(F.col("prompt_text").rlike(mark)).select("id", pairs).select("id", strip(F.col("pair.name")).alias("name"), strip(F.col("pair.body")).alias("body"), "position")
    last = F.struct("position", "body")
    return rows.groupBy("id", "name").agg(F.min("position").alias("position"), F.max(last).alias("last")).select("id", "name", F.col("last.body").alias("body"), "position")


def join_sections(parts: DataFrame) -> DataFrame:
    """The reverse: id, prompt_text, of parts in their order."""
    text = F.concat(F.lit("**"), F.col("name"), F.lit(":**\n"), F.col("body"))
    return parts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", text.alias("text")))), lambda s: s["text"]), "\n\n").alias("prompt_text"))
