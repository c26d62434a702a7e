"""Nested summaries: a chunk's consensus analysis and a job's processing summary, each one JSON object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscript.operators.align import CHUNK
from tallyscript.operators.assemble import run_summary
from tallyscript.operators.consensus import FLAGS, READY, classify_v03, scored_v03

#: Fixed values of the two files.
VERSION, REASON, ALGORITHMS = "V04_VAD_Enhanced", "quality_scoring", {True: "hybrid_bert", False: "basic"}


def fields(**columns: Column | str) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def as_json(column: Column | str) -> Column:
    """One JSON object with all its fields, null ones too."""
    return F.to_json(column, {"ignoreNullFields": "false"})


def consensus_analysis(runs: DataFrame, lines: DataFrame, admitted: DataFrame, hybrid: bool = False) -> DataFrame:
    """job_id, chunk_no, analysis: of each chunk of two valid runs or more, the flagged transcript, its figures, its lines, and how runs were admitted.

    runs (run_no from 1) and their lines are the valid runs only; admitted (n_runs, n_valid, success_rate) counts all of them.
    A chunk's lines are gathered in its row, as they are in its file.
    """
    rows = scored_v03(runs, lines)
    judged = classify_v03(rows.where("line_no is not null and base_run = best_run"))
    line = fields(timestamp="ts", speaker="speaker", content="content", visual="visual", flag=F.when(F.col("quality") == "accept", FLAGS["accept"]).when(F.col("quality") == "review", FLAGS["review"]).otherwise(FLAGS["critical"]), review_needed="review_needed", flag_reason="reason", confidence=fields(speaker="speaker_raw", content="content_raw"), total_comparisons="n_matched")
    of = lambda q: F.count_if(F.col("quality") == q)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text", line.alias("line"))))
    chunk = judged.groupBy(*CHUNK).agg(ordered.alias("lines"), F.count("*").alias("total_lines"), of("accept").alias("accept"), of("review").alias("review"), of("critical").alias("critical"), F.avg("speaker_raw").alias("speaker"), F.avg("content_raw").alias("content"), F.first("base_run").alias("run_index"), F.first("score").alias("score"))
    rate = F.col("accept") / F.greatest("total_lines", F.lit(1))
    summary = fields(
        total_runs="n_valid", flagging_used=F.lit(True), algorithm_used=F.lit(ALGORITHMS[hybrid]), baseline_selected=fields(run_index="run_index", quality_score="score", selection_reason=F.lit(REASON)), total_lines="total_lines",
        quality_distribution=fields(auto_accept="accept", manual_review="review", critical_review="critical"), overall_confidence=fields(speaker="speaker", content="content"), research_ready=rate >= READY, lines_needing_review=F.col("review") + F.col("critical"), auto_accept_rate=rate,
    )
    validation = fields(total_attempts="n_runs", valid_runs="n_valid", failed_runs=F.col("n_runs") - F.col("n_valid"), success_rate="success_rate")
    whole = fields(flagged_transcript=F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), analysis_summary=summary, detailed_analysis=F.transform("lines", lambda x: x["line"]), validation_summary=validation)
    return chunk.join(admitted.where("n_valid > 1"), list(CHUNK)).select(*CHUNK, whole.alias("analysis"))


def processing_summary(chunks: DataFrame, jobs: DataFrame, compat: bool = True) -> DataFrame:
    """job_id, summary: of each job its video, settings, voice activity, results and files.

    chunks as in run_summary(); jobs (job_id, video_file, processing_date, config, dependency_status, output_dir), the middle two being structs.
    """
    rows = jobs.join(run_summary(chunks, compat), "job_id")
    name = F.regexp_extract("video_file", r"([^/]*?)(\.[^./]*)?$", 1)
    path = lambda *ends: F.concat("output_dir", F.lit("/"), *ends)
    counted = ("total_chunks", "vad_enhanced_chunks", "traditional_chunks", "total_speech_segments", "avg_speech_ratio", "avg_vad_confidence")
    whole = fields(
        video_file="video_file", processing_date="processing_date", version=F.lit(VERSION), config="config", dependency_status="dependency_status", vad_statistics=fields(**{c: c for c in counted}),
        processing_results=fields(chunks_processed="total_chunks", successful_chunks="successful_chunks", failed_chunks="failed_chunks", vad_enhancement_rate="vad_enhancement_rate"),
        output_files=fields(complete_transcript=path(name, F.lit("_v04_complete_transcript.txt")), chunks_directory=path(F.lit("chunks")), processing_summary=path(F.lit("v04_processing_summary.json"))),
    )
    return rows.select("job_id", whole.alias("summary"))
