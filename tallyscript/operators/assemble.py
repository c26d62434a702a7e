"""Chunks' transcripts into one, with clocks shifted and context carried forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscript.functions.similarity import bound
from tallyscript.functions.text import METADATA_V03, METADATA_V04, ONE_WORD_LINE, QUALITY_MARKS, FAILED_PART_V03, clock_seconds, failed, failed_v03, is_metadata, keeps_context, lines_of, seconds_clock, strip

#: Chunks of a job that one task sees at least.
SLICE = 1024


def shift_lines(chunks: DataFrame, v03: bool = False) -> DataFrame:
    """chunks (job_id, chunk_no, start_s, text) to job_id, chunk_no, line_no, line: clocks moved by the chunk's start.

    Blank and metadata lines go; lines without a clock and a one-word speaker stay as they are.
    """
    lines = chunks.select("job_id", "chunk_no", "start_s", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line")).withColumn("line", strip(F.col("line")))
    lines = lines.where((F.col("line") != "") & ~is_metadata(F.col("line"), METADATA_V03 if v03 else METADATA_V04))
    part = lambda k: F.regexp_extract("line", ONE_WORD_LINE, k)
    moved = F.concat(seconds_clock(clock_seconds(part(1)) + F.col("start_s")), F.lit(" "), part(2), F.lit(": "), part(3))
    return lines.select("job_id", "chunk_no", "line_no", F.when(F.col("line").rlike(ONE_WORD_LINE), moved).otherwise(F.col("line")).alias("line"))


def shift_text(text: Column, start_s: Column, v03: bool = False) -> Column:
    """shift_lines as one expression on a chunk's text."""
    lines = F.filter(F.transform(lines_of(text), strip), lambda x: (x != "") & ~is_metadata(x, METADATA_V03 if v03 else METADATA_V04))
    part = lambda x, k: F.regexp_extract(x, ONE_WORD_LINE, k)
    moved = lambda x: F.concat(seconds_clock(clock_seconds(part(x, 1)) + start_s), F.lit(" "), part(x, 2), F.lit(": "), part(x, 3))
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike(ONE_WORD_LINE), moved(x)).otherwise(x)), "\n")


def last(array: Column, n: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)


def context_v04(text: Column) -> Column:
    """The last five of the spoken lines among a transcript's last ten, without marks of review."""
    lines = F.filter(F.transform(last(lines_of(strip(text)), 10), strip), keeps_context)
    clean = F.transform(lines, lambda x: strip(F.regexp_replace(F.regexp_replace(x, QUALITY_MARKS, ""), r"\*[^*]+\*", "")))
    return F.array_join(last(clean, 5), "\n")


def context_v03(text: Column) -> Column:
    """The last fifty spoken lines, without marks of review."""
    lines = F.filter(F.transform(lines_of(strip(text)), strip), lambda x: (x != "") & ~is_metadata(x, METADATA_V03) & keeps_context(x))
    clean = F.transform(lines, lambda x: strip(F.regexp_replace(F.regexp_replace(x, QUALITY_MARKS, ""), r"\*👤\d+💬\d+\*", "")))
    return F.array_join(last(clean, 50), "\n")


def carry_context(chunks: DataFrame, v03: bool = False, width: int = SLICE) -> DataFrame:
    """chunks (job_id, chunk_no, text) with the text of the last earlier chunk that did not fail: context_chunk_no, previous, context.

    Chunks are carried first within slices of a job, then from slice to slice by each one's last good chunk. No window holds a whole job.
    """
    good = F.when(~(failed_v03 if v03 else failed)(F.col("text")), F.struct("chunk_no", "text"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    marked = chunks.withColumn("slice", F.floor(F.col("chunk_no") / width))
    inside = marked.withColumn("held", F.last(good, ignorenulls=True).over(before("job_id", "slice").orderBy("chunk_no")))
    lasts = marked.groupBy("job_id", "slice").agg(F.max_by(good, F.when(good.isNotNull(), F.col("chunk_no"))).alias("last"))
    carried = lasts.select("job_id", "slice", F.last("last", ignorenulls=True).over(before("job_id").orderBy("slice")).alias("carried"))
    held = inside.join(carried, ["job_id", "slice"]).withColumn("held", F.coalesce("held", "carried"))
    return held.select(*chunks.columns, F.col("held.chunk_no").alias("context_chunk_no"), F.col("held.text").alias("previous"), (context_v03 if v03 else context_v04)(F.col("held.text")).alias("context"))


def continuity(chunk_no: Column, previous: Column) -> Column:
    """The sentence that tells a model where it goes on. It names the chunk before, though the context may be an earlier one's."""
    head = F.concat(F.lit("SEQUENCE CONTEXT: Continuing from chunk "), (chunk_no - 1).cast("string"))
    lines = context_v04(previous)
    going_on = F.concat(head, F.lit(". \nRecent conversation:\n\n"), lines, F.lit("\n\nContinue naturally from this context, maintaining speaker consistency."))
    return (
        F.when(chunk_no == 1, "SEQUENCE CONTEXT: This is the start of the video - begin transcription from the beginning.")
        .when(F.coalesce(previous, F.lit("")).isin("") | failed(previous), F.concat(head, F.lit(" (previous context unavailable).")))
        .when(lines != "", going_on)
        .otherwise(F.concat(head, F.lit(" - maintain speaker consistency.")))
    )


#: Fixed sentences of the older format's prompt.
START_V03 = "\n\nIMPORTANT: This is the start of the video. Begin transcription from the very beginning."
BEFORE_V03 = "\n\nPREVIOUS CONTEXT: Here are the final moments from the previous video segment:\n\n"
AFTER_V03 = "\n\nIMPORTANT: Continue the transcription naturally from where this context ends. Maintain speaker identification consistency and conversational flow. Use the same speaker names (Ava, A06, A04, BS) as established in the previous context."
UNKNOWN_V03 = ("\n\nIMPORTANT: This continues from the previous video segment (chunk ", "). Maintain speaker identification consistency.")


def full_prompt_v03(base: Column, chunk_no: Column, previous: Column) -> Column:
    """The older format's prompt: base, and how it goes on from the previous chunk's transcript."""
    unknown = F.concat(F.lit(UNKNOWN_V03[0]), (chunk_no - 1).cast("string"), F.lit(UNKNOWN_V03[1]))
    known = bound(F.coalesce(context_v03(previous), F.lit("")), lambda lines: F.when(lines != "", F.concat(F.lit(BEFORE_V03), lines, F.lit(AFTER_V03))).otherwise(unknown))
    return F.concat(base, F.when(chunk_no == 1, START_V03).otherwise(known))


def voice_context(fallback: Column, ratio: Column, segments: Column, confidence: Column) -> Column:
    """The lines that tell a model about voice activity."""
    activity = F.when(segments > 10, "- High speech activity detected - expect multiple speaker turns").when(segments < 3, "- Low speech activity - focus on clear, distinct utterances")
    clarity = F.when(confidence > 0.8, "- High confidence speech detection - expect clear audio").when(confidence < 0.5, "- Lower confidence detection - some segments may be unclear")
    known = F.concat_ws(
        "\n",
        F.lit("VAD PREPROCESSING RESULTS:"),
        F.format_string("- Speech coverage: %.1f%% of total duration", ratio * 100),
        F.concat(F.lit("- Detected "), segments.cast("string"), F.lit(" speech segments")),
        F.format_string("- Average VAD confidence: %.2f", confidence),
        activity,
        clarity,
        F.lit("\nFocus transcription on VAD-identified speech regions for optimal accuracy."),
    )
    return F.when(F.coalesce(fallback, F.lit(False)), "VAD CONTEXT: Standard chunking mode (VAD preprocessing unavailable).").otherwise(known)


def full_prompt(base: Column, voice: Column, sequence: Column) -> Column:
    return F.concat_ws("\n\n", base, voice, sequence)


def parts(chunks: DataFrame) -> DataFrame:
    """chunks (job_id, chunk_no, start_s, text, voice_line) to a document's parts: job_id, chunk_no, bad, part.

    Each chunk has a head, its voice activity and its shifted lines; a failed one keeps its text under a banner.
    """
    text = strip(F.col("text"))
    bad = (text == "") | failed(text)
    body = F.when(bad, F.concat(F.lit("❌ CHUNK "), F.col("chunk_no").cast("string"), F.lit(" FAILED:\n"), text)).otherwise(shift_text(text, F.col("start_s")))
    head = F.concat(F.lit("📌 CHUNK "), F.col("chunk_no").cast("string"), F.format_string(" (Starting at %.1f minutes)", F.col("start_s") / 60))
    return chunks.select("job_id", "chunk_no", bad.alias("bad"), F.concat_ws("\n", head, F.concat(F.lit("   📊 VAD: "), F.coalesce("voice_line", F.lit("Traditional chunking mode"))), F.lit("-" * 60), body, F.lit("")).alias("part"))


def assemble(chunks: DataFrame) -> DataFrame:
    """parts() joined to a row per job: job_id, n_chunks, n_failed, document."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "part"))), lambda s: s["part"]), "\n")
    return parts(chunks).groupBy("job_id").agg(F.count("*").alias("n_chunks"), F.count_if("bad").alias("n_failed"), joined.alias("document"))


def parts_v03(chunks: DataFrame) -> DataFrame:
    """chunks (job_id, chunk_no, start_s, text) to job_id, chunk_no, out, part; empty and failed chunks are out, and have no part."""
    text = strip(F.col("text"))
    left_out = (text == "") | failed_v03(text, FAILED_PART_V03)
    head = F.concat(F.lit("--- Chunk "), F.col("chunk_no").cast("string"), F.format_string(" (Starting at %.1f minutes) ---", F.col("start_s") / 60))
    return chunks.select("job_id", "chunk_no", left_out.alias("out"), F.when(~left_out, F.concat_ws("\n", head, shift_text(text, F.col("start_s"), v03=True), F.lit(""))).alias("part"))


def assemble_v03(chunks: DataFrame) -> DataFrame:
    """parts_v03() joined to a row per job: job_id, n_chunks, n_left_out, document."""
    kept = F.collect_list(F.when(F.col("part").isNotNull(), F.struct("chunk_no", "part")))
    joined = F.array_join(F.transform(F.array_sort(kept), lambda s: s["part"]), "\n")
    return parts_v03(chunks).groupBy("job_id").agg(F.count("*").alias("n_chunks"), F.count_if("out").alias("n_left_out"), joined.alias("document"))


def voice_line(segments: Column, ratio: Column, confidence: Column) -> Column:
    return F.concat(segments.cast("string"), F.format_string(" segments, %.1f%% speech, confidence %.2f", ratio * 100, confidence))


def run_summary(chunks: DataFrame, compat: bool = True) -> DataFrame:
    """chunks (job_id, text, fallback_mode, speech_ratio, num_segments, avg_confidence) to a row per job of counts and means.

    compat takes a missing fallback_mode for true. Means are over positive values only, 0 without any.
    """
    voiced = ~F.coalesce("fallback_mode", F.lit(compat))
    positive = lambda c: F.coalesce(F.avg(F.when(voiced & (F.col(c) > 0), F.col(c))), F.lit(0.0))
    out = chunks.groupBy("job_id").agg(
        F.count("*").alias("total_chunks"), F.count_if(voiced).alias("vad_enhanced_chunks"), F.count_if(~voiced).alias("traditional_chunks"), F.coalesce(F.sum(F.when(voiced, F.col("num_segments"))), F.lit(0)).alias("total_speech_segments"),
        positive("speech_ratio").alias("avg_speech_ratio"), positive("avg_confidence").alias("avg_vad_confidence"), F.count_if(~failed(F.col("text"))).alias("successful_chunks"), F.count_if(failed(F.col("text"))).alias("failed_chunks"),
    )
    return out.withColumn("vad_enhancement_rate", F.col("vad_enhanced_chunks") / F.col("total_chunks"))


def preview(texts: DataFrame, keys: tuple[str, ...], most: int = 100) -> DataFrame:
    """keys, content (the first lines), total_lines, truncated."""
    lines = lines_of(F.col("text"))
    return texts.select(*keys, F.array_join(F.slice(lines, 1, most), "\n").alias("content"), F.size(lines).alias("total_lines"), (F.size(lines) > most).alias("truncated"))


def header(chunks: DataFrame, compat: bool = True) -> DataFrame:
    """Per job the figures of a document's head: total_chunks, enhanced, rate in percent with one place."""
    voiced = ~F.coalesce("fallback_mode", F.lit(compat))
    out = chunks.groupBy("job_id").agg(F.count("*").alias("total_chunks"), F.count_if(voiced).alias("enhanced"))
    return out.withColumn("rate", F.format_string("%.1f%%", F.col("enhanced") / F.col("total_chunks") * 100))
