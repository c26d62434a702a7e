"""Nearest-time joins between the lines of several transcripts of one chunk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscript.functions.similarity import alike_v03, alike_v04, form_v03, form_v04, same_speaker_v04
from tallyscript.functions.text import speaker_name

#: Seconds that two lines may be apart, and of a slot.
TOLERANCE, SLOT_S = 5, 120

CHUNK = ("job_id", "chunk_no")


def nearest(base: DataFrame, other: DataFrame, keys: tuple[str, ...] = CHUNK, tolerance: int = TOLERANCE, differ: str | None = None, carry: tuple[str, ...] = (), slot_s: int = SLOT_S) -> DataFrame:
    """For each line of base and each run of other the line with the least |seconds|, the first on ties; none beyond tolerance.

    differ: a column of both that tells runs apart; base and run must differ in it. carry: further columns of base to keep.

    base: keys, base_run, line_no, sec, speaker, content. other: keys, run_no, line_no, sec, speaker, content. Out: keys, base_run,
    line_no, run_no, other_line_no, distance, speaker, content, other_speaker, other_content.

    Time is cut into slots; lines of other also stand in a neighbouring slot that they are near enough to. In a slot, the lines of
    base and of one run are put in order of time twice, and each line of base sees the last one before it, once from either
    side: so a slot of n lines takes n log n steps, and a long chunk has many slots.
    """
    around = F.sequence(F.floor((F.col("sec") - tolerance) / slot_s), F.floor((F.col("sec") + tolerance) / slot_s))
    told = F.col(differ) if differ else F.lit(None).cast("string")
    line = F.struct(F.col("line_no").alias("line"), F.col("sec").alias("at"), F.col("speaker").alias("who"), F.col("content").alias("what"))
    right = other.select(*keys, "run_no", told.alias("_told"), F.explode(around).alias("slot"), "sec", line.alias("o"))
    present = right.groupBy(*keys, "slot").agg(F.collect_set(F.struct("run_no", "_told")).alias("_runs"))
    own = ("base_run", "line_no", *carry, "speaker", "content")
    left = base.select(*keys, F.floor(F.col("sec") / slot_s).alias("slot"), "sec", told.alias("_own"), F.struct(*own).alias("b")).join(present, [*keys, "slot"])
    runs = F.filter("_runs", lambda r: r["_told"] != F.col("_own")) if differ else F.col("_runs")
    left = left.select(*keys, "slot", "sec", "b", F.explode(runs).alias("_run")).select(*keys, F.col("_run.run_no").alias("run_no"), "slot", "sec", "b")
    both = left.unionByName(right.drop("_told"), allowMissingColumns=True)
    group = Window.partitionBy(*keys, "run_no", "slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine, first = F.col("b").isNotNull(), F.desc("o.line")
    upto = F.last("o", ignorenulls=True).over(group.orderBy("sec", mine, first))
    beyond = F.last("o", ignorenulls=True).over(group.orderBy(F.desc("sec"), F.desc(mine), first))
    seen = both.withColumn("upto", upto).withColumn("beyond", beyond).where("b is not null")
    apart = lambda o: F.abs(F.col("sec") - F.col(o)["at"])
    later = F.col("upto").isNull() | (apart("beyond") < apart("upto")) | ((apart("beyond") == apart("upto")) & (F.col("beyond.line") < F.col("upto.line")))
    best = seen.select(*keys, "run_no", "sec", "b", F.when(F.col("beyond").isNotNull() & later, F.col("beyond")).otherwise(F.col("upto")).alias("best"))
    near = best.withColumn("distance", F.abs(F.col("sec") - F.col("best.at"))).where(F.col("distance") <= tolerance)
    return near.select(*keys, "b.base_run", "b.line_no", "run_no", *[f"b.{c}" for c in carry], F.col("best.line").alias("other_line_no"), "distance", "b.speaker", "b.content", F.col("best.who").alias("other_speaker"), F.col("best.what").alias("other_content"))


def as_base(lines: DataFrame) -> DataFrame:
    return lines.withColumnRenamed("run_no", "base_run")


def formed(lines: DataFrame, form: Callable[[Column], Column]) -> DataFrame:
    """lines with the form of their content that is compared, made once a line."""
    return lines.withColumn("content", form(F.col("content")))


def compared(matches: DataFrame, same: Callable[[Column, Column], Column], alike: Callable[[Column, Column], Column]) -> DataFrame:
    """matches of formed() lines with same_speaker (0 or 1) and similarity, and the contents as they were."""
    judged = matches.withColumn("same_speaker", same(F.col("speaker"), F.col("other_speaker")).cast("int")).withColumn("similarity", alike(F.col("content"), F.col("other_content")))
    return judged.withColumn("content", F.col("content.text")).withColumn("other_content", F.col("other_content.text"))


def align_v04(base: DataFrame, lines: DataFrame, keys: tuple[str, ...] = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """The baseline's lines against every run, its own included, as it counts too."""
    return compared(nearest(formed(base, form_v04), formed(lines, form_v04), keys, carry=carry), same_speaker_v04, alike_v04)


def align_v03(base: DataFrame, lines: DataFrame, keys: tuple[str, ...] = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    return compared(nearest(formed(base, form_v03), formed(lines, form_v03), keys, carry=carry), lambda a, b: speaker_name(a) == speaker_name(b), alike_v03)


def pairs_v03(lines: DataFrame, runs: DataFrame, keys: tuple[str, ...] = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """The lines of every run against every run, itself included: what both the runs' agreement and the lines' confidence follow from.

    nearest() with same_speaker (by known names), same_name (exact), similarity, and another, whether the two runs' texts differ.
    """
    marked = formed(lines, form_v03).join(runs.select(*keys, "run_no", F.sha2("text", 256).alias("sha")), [*keys, "run_no"])
    mine, theirs = as_base(marked), marked.withColumn("content", F.struct("content", "sha"))
    met = nearest(mine, theirs, keys, carry=("sha", *carry)).withColumn("another", F.col("sha") != F.col("other_content.sha")).withColumn("other_content", F.col("other_content.content"))
    judged = compared(met.drop("sha"), lambda a, b: speaker_name(a) == speaker_name(b), alike_v03)
    return judged.withColumn("same_name", (F.col("speaker") == F.col("other_speaker")).cast("int"))
