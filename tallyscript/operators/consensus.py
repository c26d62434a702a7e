"""Choice of a baseline among runs, and confidence of its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscript.functions.text import BRACKETS, SCORED_LINE, lines_of, strip
from tallyscript.operators.intervals import largest, look_up
from tallyscript.operators.align import CHUNK, align_v04, as_base, pairs_v03

#: Weight of voice activity, confidence without any, thresholds in percent and in shares, marks of review.
VOICE_WEIGHT, NO_VOICE, SPEAKER_PERCENT, CONTENT_PERCENT = 0.3, 0.5, 70, 85
ACCEPT, REVIEW, READY = (0.6, 0.7), (0.4, 0.5), 0.8
FLAGS = {"accept": "✅", "review": "⚠️", "critical": "🚨"}


def score_v04(runs: DataFrame) -> DataFrame:
    """job_id, chunk_no, run_no, base_score: percent of all lines that begin with a clock and a one-word speaker."""
    lines = lines_of(strip(F.col("text")))
    return runs.select(*CHUNK, "run_no", (100 * F.size(F.filter(lines, lambda x: x.rlike(SCORED_LINE))) / F.size(lines)).alias("base_score"))


def voice_bonus(info: DataFrame) -> DataFrame:
    """info (fallback_mode, speech_ratio, num_segments, avg_confidence, hybrid) with bonus, 0 to 10."""
    ratio, n = F.coalesce("speech_ratio", F.lit(0.0)), F.coalesce("num_segments", F.lit(0))
    points = (
        F.when(ratio.between(0.3, 0.8), 3.0).when(ratio > 0.1, 1.0).otherwise(0.0)
        + F.coalesce("avg_confidence", F.lit(0.0)) * 4
        + F.when(n > 5, 2.0).when(n > 2, 1.0).otherwise(0.0)
        + F.when(F.coalesce("hybrid", F.lit(False)), 1.0).otherwise(0.0)
    )
    return info.withColumn("bonus", F.when(F.coalesce("fallback_mode", F.lit(False)), 0.0).otherwise(F.least(points, F.lit(10.0))))


def best_run(scored: DataFrame) -> DataFrame:
    """scored (job_id, chunk_no, run_no, score) to the run of the highest score per chunk, the first of equals: base_run, score."""
    top = F.max_by(F.struct("run_no", "score"), F.struct("score", -F.col("run_no")))
    return scored.groupBy(*CHUNK).agg(top.alias("top")).select(*CHUNK, F.col("top.run_no").alias("base_run"), F.col("top.score").alias("score"))


def baseline_v04(runs: DataFrame, bonus: DataFrame | None = None) -> DataFrame:
    """bonus (job_id, chunk_no, run_no, bonus) adds to the scores of the runs that it has."""
    scored = score_v04(runs)
    scored = scored.join(bonus, [*CHUNK, "run_no"], "left") if bonus is not None else scored.withColumn("bonus", F.lit(0.0))
    return best_run(scored.select(*CHUNK, "run_no", (F.col("base_score") + F.coalesce("bonus", F.lit(0.0))).alias("score")))


def over_runs(*columns: str | Column) -> list[Column]:
    """Of one line's matches: the sum of each column, nulls left out, taken in order of runs, as sums of doubles depend on it."""
    held = F.array_sort(F.collect_list(F.struct("run_no", *[(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)])))

    def total(field: str) -> Column:
        return F.aggregate(held, F.lit(None).cast("double"), lambda s, m: F.when(m[field].isNull(), s).otherwise(F.coalesce(s, F.lit(0.0)) + m[field]))

    return [total(f"x{k}") for k in range(len(columns))]


def scored_v03(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of two kinds: every run's lines with the means over the runs that they match, and, with a null line_no, the run itself.

    Each has its run's (base_run) parse_score, format_score, richness, agreement, score (at most 100), and best_run, the chunk's
    run of the highest score, the first of equals. Lines are paired once; scores and choice follow by windows over the pairs' chunk.

    A matched pair of lines of runs with different texts agrees by 0.6 for the same speaker, by exact name, and 0.4 times the
    similarity of content; a run's agreement is 30 times the mean, summed by line in order of runs, then over lines in order. A chunk's only run gets 30, one without lines 0, one without such a pair 15.
    """
    carried = ("ts", "sec", "visual")
    pairs = pairs_v03(lines, runs, carry=carried)
    agreed = F.when(F.col("another"), F.col("same_name") * 0.6 + F.col("similarity") * 0.4)
    own = [F.first(c).alias(c) for c in ("speaker", "content", *carried)]
    speaker, content, total = over_runs("same_speaker", "similarity", agreed)
    said = pairs.groupBy(*CHUNK, "base_run", "line_no").agg(*own, (speaker / F.count("*")).alias("speaker_raw"), (content / F.count("*")).alias("content_raw"), F.count("*").alias("n_matched"), total.alias("agreed"), F.count(agreed).alias("n_agreed"))
    counts = F.struct(F.size(lines_of(strip(F.col("text")))).alias("lines"), F.regexp_count("text", F.lit(r"\S+")).alias("words"), F.regexp_count("text", F.lit(BRACKETS)).alias("visual"), F.regexp_count("text", F.lit(r"\[unclear\]|\[inaudible\]|\[uncertain\]")).alias("unclear"))
    rows = said.unionByName(runs.select(*CHUNK, F.col("run_no").alias("base_run"), counts.alias("text")), allowMissingColumns=True).repartition(*CHUNK)
    run = Window.partitionBy(*CHUNK, "base_run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chunk = Window.partitionBy(*CHUNK)
    over = {"n_parsed": F.count("line_no"), "speakers": F.collect_set("speaker"), "n_content": F.count_if(F.trim("content") != ""), "agreed": F.sum("agreed"), "n_agreed": F.sum("n_agreed"), "text": F.max("text")}
    rows = rows.withColumns({f"_{c}": f.over(run) for c, f in over.items()}).withColumn("_n_runs", F.count_if(F.col("line_no").isNull()).over(chunk))
    n = F.col("_text.lines")
    parse = 20 * (F.col("_n_parsed") / n * 0.5 + F.when(F.col("_n_parsed") > 0, 0.5).otherwise(0.0))
    form = 20 * (1 - F.least(F.col("_text.unclear") / n, F.lit(0.5))) * F.least(F.size("_speakers") / F.greatest(F.col("_n_parsed") / 10, F.lit(1.0)), F.lit(1.0))
    rich = 30 * (F.least(F.col("_text.words") / 1000, F.lit(1.0)) * 0.4 + F.least(F.col("_text.visual") / 20, F.lit(1.0)) * 0.3 + F.col("_n_content") / n * 0.3)
    agreement = F.when(F.col("_n_runs") <= 1, 30.0).when(F.col("_n_parsed") == 0, 0.0).otherwise(F.coalesce(30 * F.try_divide("_agreed", "_n_agreed"), F.lit(15.0)))
    rows = rows.withColumns({"parse_score": parse, "format_score": form, "richness": F.when(F.col("_text.words") == 0, 0.0).otherwise(rich), "agreement": agreement})
    rows = rows.withColumn("score", F.least(F.col("parse_score") + F.col("format_score") + F.col("richness") + F.col("agreement"), F.lit(100.0)))
    rows = rows.withColumn("best_run", F.max_by("base_run", F.struct("score", -F.col("base_run"))).over(chunk))
    return rows.select(*CHUNK, "base_run", "line_no", "speaker", "content", *carried, "speaker_raw", "content_raw", "n_matched", "parse_score", "format_score", "richness", "agreement", "score", "best_run")


def score_v03(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """job_id, chunk_no, run_no, parse_score, format_score, richness, agreement, score (at most 100)."""
    return scored_v03(runs, lines).where("line_no is null").select(*CHUNK, F.col("base_run").alias("run_no"), "parse_score", "format_score", "richness", "agreement", "score")


def baseline_v03(runs: DataFrame, lines: DataFrame) -> DataFrame:
    return scored_v03(runs, lines).where("line_no is null and base_run = best_run").select(*CHUNK, "base_run", "score")


def baseline_lines(lines: DataFrame, baseline: DataFrame) -> DataFrame:
    return as_base(lines).join(baseline.select(*CHUNK, "base_run"), [*CHUNK, "base_run"])


def line_confidence(base: DataFrame, aligned: DataFrame) -> DataFrame:
    """Each line of base with the means over its matched runs, 1 where none matched: speaker_raw, content_raw, n_matched."""
    speaker, content = over_runs("same_speaker", "similarity")
    means = aligned.groupBy(*CHUNK, "line_no").agg((speaker / F.count("*")).alias("s"), (content / F.count("*")).alias("c"), F.count("*").alias("n"))
    return base.join(means, [*CHUNK, "line_no"], "left").select(*base.columns, F.coalesce("s", F.lit(1.0)).alias("speaker_raw"), F.coalesce("c", F.lit(1.0)).alias("content_raw"), F.coalesce("n", F.lit(0)).cast("long").alias("n_matched"))


def confidence_of(aligned: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """line_confidence() where base is one of the runs: each of its lines then matches itself, and comes with its match."""
    own = ("base_run", "speaker", "content", *carried)
    speaker, content = over_runs("same_speaker", "similarity")
    return aligned.groupBy(*CHUNK, "line_no").agg(*[F.first(c).alias(c) for c in own], (speaker / F.count("*")).alias("speaker_raw"), (content / F.count("*")).alias("content_raw"), F.count("*").alias("n_matched"))


def voice_stretches(segments: DataFrame, keys: tuple[str, ...] = CHUNK) -> DataFrame:
    """Segments (start_s, end_s, confidence) to stretches of seconds: keys, from_, to, vad, the largest confidence from one second up to another, without it.

    A segment counts at the seconds that its ends fall in, both included.
    """
    whole = segments.where("end_s >= start_s").select(*keys, F.col("start_s").cast("long").alias("a"), (F.col("end_s").cast("long") + 1).alias("b"), F.col("confidence").alias("vad"))
    return largest(whole, keys, "vad")


def second_confidence(segments: DataFrame, keys: tuple[str, ...] = CHUNK) -> DataFrame:
    """voice_stretches() with a row for each second: keys, sec, vad."""
    return voice_stretches(segments, keys).select(*keys, F.explode(F.sequence(F.col("from_").cast("int"), (F.col("to") - 1).cast("int"))).alias("sec"), "vad")


def classify_v04(lines: DataFrame, weight: float = VOICE_WEIGHT) -> DataFrame:
    """lines (speaker_raw, content_raw, vad) with confidences raised by voice activity, percents, review_needed, reason, text."""
    vad = F.coalesce("vad", F.lit(NO_VOICE))
    out = lines.withColumn("vad", vad).withColumn("speaker_conf", F.least(F.lit(1.0), F.col("speaker_raw") + F.col("vad") * F.lit(weight) * 0.5)).withColumn("content_conf", F.least(F.lit(1.0), F.col("content_raw") + F.col("vad") * F.lit(weight)))
    out = out.withColumn("speaker_pct", (F.col("speaker_conf") * 100).cast("int")).withColumn("content_pct", (F.col("content_conf") * 100).cast("int"))
    bad_speaker, bad_content = F.col("speaker_pct") < SPEAKER_PERCENT, F.col("content_pct") < CONTENT_PERCENT
    marks = F.concat_ws(" ", F.when(bad_speaker, F.concat(F.lit("spkr:"), F.col("speaker_pct").cast("string"))), F.when(bad_content, F.concat(F.lit("text:"), F.col("content_pct").cast("string"))))
    reason = F.when(bad_speaker | bad_content, F.concat(F.lit("[verify: "), marks, F.lit("]"))).otherwise("")
    out = out.withColumn("review_needed", bad_speaker | bad_content).withColumn("reason", reason)
    return out.withColumn("text", F.concat_ws(" ", "ts", F.concat(F.col("speaker"), F.lit(": "), F.col("content")), F.nullif("reason", F.lit(""))))


def classify_v03(lines: DataFrame) -> DataFrame:
    """lines (speaker_raw, content_raw, visual) with quality (accept, review, critical), review_needed, reason, text."""
    at_least = lambda limits: (F.col("speaker_raw") >= limits[0]) & (F.col("content_raw") >= limits[1])
    out = lines.withColumn("quality", F.when(at_least(ACCEPT), "accept").when(at_least(REVIEW), "review").otherwise("critical"))
    percent = lambda c: F.bround(F.col(c) * 100, 0).cast("int").cast("string")
    out = out.withColumn("review_needed", F.col("quality") != "accept").withColumn("reason", F.when(F.col("quality") != "accept", F.concat(F.lit("👤"), percent("speaker_raw"), F.lit("💬"), percent("content_raw"))))
    flag = F.when(F.col("quality") == "accept", FLAGS["accept"]).when(F.col("quality") == "review", FLAGS["review"]).otherwise(FLAGS["critical"])
    visual = F.when(F.col("visual") != "", F.concat(F.lit("["), F.col("visual"), F.lit("]")))
    return out.withColumn("text", F.concat_ws(" ", "ts", F.concat(F.col("speaker"), F.lit(": "), F.col("content")), visual, flag, F.concat(F.lit("*"), F.col("reason"), F.lit("*"))))


def consensus_v04(runs: DataFrame, lines: DataFrame, voice: DataFrame | None = None, bonus: DataFrame | None = None, weight: float = VOICE_WEIGHT) -> DataFrame:
    """Flagged lines of every chunk's baseline. voice: confidence of speech as voice_stretches()."""
    base = baseline_lines(lines, baseline_v04(runs, bonus))
    confident = confidence_of(align_v04(base, lines, carry=("ts", "sec")), ("ts", "sec"))
    confident = look_up(confident, "sec", voice, CHUNK, "vad") if voice is not None else confident.withColumn("vad", F.lit(NO_VOICE))
    return classify_v04(confident, weight)


def consensus_v03(runs: DataFrame, lines: DataFrame) -> DataFrame:
    """Flagged lines of every chunk's baseline."""
    chosen = scored_v03(runs, lines).where("line_no is not null and base_run = best_run")
    return classify_v03(chosen.select(*CHUNK, "line_no", "base_run", "speaker", "content", "ts", "sec", "visual", "speaker_raw", "content_raw", "n_matched"))


def quality_v04(flagged: DataFrame) -> DataFrame:
    """Per chunk: total_lines, auto_accept, manual_review, rate, means of confidences; null means where there is no line."""
    out = flagged.groupBy(*CHUNK).agg(F.count("*").alias("total_lines"), F.count_if(~F.col("review_needed")).alias("auto_accept"), F.count_if("review_needed").alias("manual_review"), F.avg("speaker_conf").alias("speaker"), F.avg("content_conf").alias("content"), F.avg("vad").alias("vad"))
    return out.withColumn("auto_accept_rate", F.col("auto_accept") / F.greatest("total_lines", F.lit(1)))


def quality_v03(flagged: DataFrame) -> DataFrame:
    """Per chunk: counts of each quality, rate, means, research_ready."""
    count = lambda q: F.count_if(F.col("quality") == q)
    out = flagged.groupBy(*CHUNK).agg(F.count("*").alias("total_lines"), count("accept").alias("auto_accept"), count("review").alias("manual_review"), count("critical").alias("critical_review"), F.avg("speaker_raw").alias("speaker"), F.avg("content_raw").alias("content"))
    rate = F.col("auto_accept") / F.greatest("total_lines", F.lit(1))
    return out.withColumn("auto_accept_rate", rate).withColumn("research_ready", rate >= READY).withColumn("lines_needing_review", F.col("manual_review") + F.col("critical_review"))


def boost_impact(flagged: DataFrame) -> DataFrame:
    """Per chunk: what voice activity changed."""
    raised = F.col("speaker_conf") > F.col("speaker_raw")
    return flagged.groupBy(*CHUNK).agg(F.count_if(raised).alias("improved_lines"), F.count_if(F.col("vad") > 0.6).alias("high_vad_lines"), F.avg("vad").alias("avg_vad"), F.sum(F.when(raised, F.col("speaker_conf") - F.col("speaker_raw")).otherwise(0.0)).alias("total_boost"))
