"""Validation of transcripts, repetition, and admission of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscript.functions.similarity import bound
from tallyscript.functions.text import failed, lines_of, strip
from tallyscript.operators.parsing import KEYS

#: Marks of errors in the order in which they are looked for, starts of timed lines, limits.
ERRORS = (r"\[ERROR:", r"\[PARTIAL:.*Generation stopped", "Transcription failed", "No response candidates", "Invalid response", "No content parts")
TIMED = r"^\d{1,2}:\d{2}|^\(\d{1,2}:\d{2}|^\[\d{1,2}:\d{2}"
MIN_LENGTH, REPEATED_LINES, REPEATED_CONTENTS, REPEATED_SHARE, KEPT_REPEATS = 50, 10, 5, 0.3, 3


def content_after_colon(line: Column) -> Column:
    """What follows the first colon, which for timed lines is the clock's own."""
    return strip(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))


def loops(text: Column, compat: bool = True) -> Column:
    """n_lines, n_contents, most, excessive of a stripped text: a row's contents are sorted and equal neighbours counted."""

    def longest(contents: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("of"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("most"))
        count = lambda s, c: F.when(s["of"].eqNullSafe(c), s["n"] + 1).otherwise(F.lit(1).cast("long"))
        return F.aggregate(F.array_sort(contents), start, lambda s, c: bound(count(s, c), lambda n: F.struct(c.alias("of"), n.alias("n"), F.greatest(s["most"], n).alias("most"))))["most"]

    def counted(lines: Column) -> Column:
        content = content_after_colon if compat else lambda x: strip(F.regexp_replace(x, r"^\s*\d{1,2}:\d{2}\s+[^:]+:|^[^:]*:", ""))
        contents = F.transform(F.filter(lines, lambda x: x.contains(":")), content)
        return bound(contents, lambda c: F.struct(F.size(lines).cast("long").alias("n_lines"), F.size(c).cast("long").alias("n_contents"), longest(c).alias("most")))

    judged = lambda r: (r["n_lines"] >= REPEATED_LINES) & (r["n_contents"] >= REPEATED_CONTENTS) & (r["most"] > r["n_contents"] * REPEATED_SHARE)
    return bound(bound(lines_of(text), counted), lambda r: F.struct(r["n_lines"].alias("n_lines"), r["n_contents"].alias("n_contents"), r["most"].alias("most"), judged(r).alias("excessive")))


def repetition(texts: DataFrame, keys: tuple[str, ...] = KEYS, compat: bool = True) -> DataFrame:
    """keys, n_lines, n_contents, most, excessive: whether one content makes up over 30 % of the lines with a colon.

    compat=False compares what follows clock and speaker instead. Each text is judged in its row, without a shuffle.
    """
    return texts.where("text is not null").select(*keys, loops(strip(F.col("text")), compat).alias("found")).select(*keys, "found.*")


def validate(texts: DataFrame, keys: tuple[str, ...] = KEYS, min_length: int = MIN_LENGTH) -> DataFrame:
    """keys, text, ok, reason of the first rule that fails. Each text is judged in its row, without a shuffle."""
    rows = texts.select(*keys, "text", strip(F.coalesce("text", F.lit(""))).alias("_text"))
    text = F.col("_text")
    reason = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "Empty or invalid transcript")
    for pattern in ERRORS:
        reason = reason.when(text.rlike("(?i)" + pattern), f"Error marker detected: {pattern}")
    reason = reason.when(F.length(text) < min_length, F.concat(F.lit("Transcript too short: "), F.length(text).cast("string"), F.lit(f" chars (min: {min_length})")))
    structured = F.exists(lines_of(text), lambda x: x.contains(":") | strip(x).rlike(TIMED))
    reason = reason.when(~structured, "No valid transcript lines with timestamps/speakers found")
    reason = reason.when(loops(text)["excessive"], "Excessive repetition detected (likely AI generation loop)").otherwise("Valid transcript")
    checked = rows.select(*keys, "text", reason.alias("reason"))
    return checked.select(*keys, "text", (F.col("reason") == "Valid transcript").alias("ok"), "reason")


def suppress_repeats(texts: DataFrame, keys: tuple[str, ...] = KEYS, kept: int = KEPT_REPEATS) -> DataFrame:
    """keys, line_no, line: of a content's occurrences `kept` stay, the next becomes a note, further ones go."""
    lines = texts.select(*keys, F.posexplode(lines_of(F.col("text"))).alias("line_no", "line")).withColumn("content", F.when(F.col("line").contains(":"), content_after_colon(F.col("line"))))
    n = F.row_number().over(Window.partitionBy(*keys, "content").orderBy("line_no"))
    note = F.concat(F.regexp_extract("line", r"^([^:]*:)", 1), F.lit(" [continues repeating: '"), F.col("content"), F.lit("']"))
    counted = lines.where("content is not null").withColumn("n", n).where(F.col("n") <= kept + 1)
    shown = counted.select(*keys, "line_no", F.when(F.col("n") == kept + 1, note).otherwise(F.col("line")).alias("line"))
    return shown.unionByName(lines.where("content is null").select(*keys, "line_no", "line"))


def check_voice(texts: DataFrame, compat: bool = True) -> DataFrame:
    """texts (text, vad_info) with voice_ok: many segments need lines, none bears few; only where voice activity is known.

    compat takes a missing fallback_mode for true.
    """
    n = F.size(F.filter(lines_of(F.col("text")), lambda x: x.contains(":")))
    known = ~F.coalesce("vad_info.fallback_mode", F.lit(compat))
    segments = F.coalesce("vad_info.num_segments", F.lit(0))
    return texts.withColumn("voice_ok", ~(known & (((segments > 5) & (n < 2)) | ((segments == 0) & (n > 10)))))


def admit(checked: DataFrame) -> DataFrame:
    """checked (job_id, chunk_no, run_no, ok) to a row per chunk: n_runs, n_valid, success_rate, mode."""
    out = checked.groupBy("job_id", "chunk_no").agg(F.count("*").alias("n_runs"), F.count_if("ok").alias("n_valid"))
    mode = F.when(F.col("n_valid") == 0, "failed").when(F.col("n_valid") == 1, "single").otherwise("consensus")
    return out.withColumn("success_rate", F.coalesce(F.try_divide("n_valid", "n_runs"), F.lit(0.0))).withColumn("mode", mode)


def stop_early(checked: DataFrame, runs: int) -> DataFrame:
    """The runs up to the one with which half of them have failed."""
    before = Window.partitionBy("job_id", "chunk_no").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    return checked.withColumn("_failed", F.coalesce(F.sum((~F.col("ok")).cast("int")).over(before), F.lit(0))).where(F.col("_failed") < max(runs // 2, 1)).drop("_failed")


def unwrap(attempts: DataFrame, v03: bool = False) -> DataFrame:
    """attempts (finish_reason, text) with response and error, as a hosted model's answer is taken."""
    reasons = F.create_map(*[F.lit(x) for pair in ((0, "UNSPECIFIED"), (1, "STOP"), (2, "MAX_TOKENS"), (3, "SAFETY"), (4, "RECITATION")) for x in pair])
    why = F.coalesce(F.try_element_at(reasons, F.col("finish_reason")), F.concat(F.lit("UNKNOWN("), F.col("finish_reason").cast("string"), F.lit(")")))
    stopped = F.concat(F.lit("Generation stopped due to "), why)
    response = F.when(F.col("finish_reason") == 1, F.col("text")).when(F.col("text").isNotNull(), F.concat(F.lit("[PARTIAL: " if v03 else "[PARTIAL_VAD: "), stopped, F.lit("]\n\n"), F.col("text")))
    error = F.when(response.isNull(), F.when(F.col("finish_reason") == 1, "No content parts in response").otherwise(F.concat(stopped, F.lit(" with no content")) if v03 else stopped))
    return attempts.withColumn("response", response).withColumn("error", error)


def first_valid(checked: DataFrame) -> DataFrame:
    """checked (keys, attempt, ok, text): of each run the first valid attempt, else the last one and failed."""
    good = F.min_by("text", F.when(F.col("ok"), F.col("attempt")))
    return checked.groupBy(*KEYS).agg(F.count("*").alias("attempts"), F.coalesce(F.max("ok"), F.lit(False)).alias("ok"), F.when(F.max("ok"), good).otherwise(F.max_by("text", "attempt")).alias("text"))


def is_failure(texts: DataFrame) -> DataFrame:
    return texts.withColumn("failed", failed(F.col("text")))


def commonest(texts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, content, n of the content that most lines with a colon have, the first by its text of equals."""
    lines = texts.select(*keys, F.explode(lines_of(strip(F.col("text")))).alias("line")).where(F.col("line").contains(":"))
    counted = lines.groupBy(*keys, content_after_colon(F.col("line")).alias("content")).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("content", "n"), F.struct(-F.col("n"), F.col("content")))
    return counted.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")
