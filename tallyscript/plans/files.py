"""Queries over files and databases that are written from the given tables and read back."""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscript.operators import jobs, parsing, summaries, validate
from tallyscript.plans.queries import CHUNK, JOB_CHUNKS_SQL, V03_SQL, chunks_of_jobs, query
from tallyscript.sources import derived, sqlite, tables
from tallyscript.sources.derived import JOBS_SQL, RUNS_SQL
from tallyscript.sources.shared import new_folder
from tallyscript.sources.tables import table

# Admission of files

ENDINGS = (".MP4", ".mov", ".txt", "")


def page_files(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Writes pages as files below folder, but for every fifth; gives page_id and path of all."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(f"{folder}/part "), (F.col("page_id") % 7).cast("string"), F.lit("/v "), F.col("page_id").cast("string"), ending).alias("path"), "html")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, html in zip(rows["path"], rows["html"]):
                if "://" in path:
                    store, at = pyarrow.fs.FileSystem.from_uri(urllib.parse.quote(path, safe=":/"))
                else:
                    store, at = pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")
                at = urllib.parse.unquote(at)
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as file:
                    file.write(html.encode() * 40)
            yield rows[["path"]]

    pages.where("page_id % 5 <> 0").select("path", "html").mapInPandas(put, "path string").write.format("noop").mode("overwrite").save()
    return pages.select("page_id", "path")


@query(
    """WITH p AS (SELECT page_id, 'v ' || page_id || ['.MP4', '.mov', '.txt', ''][page_id % 4 + 1] AS filename, lower(['.MP4', '.mov', '.txt', ''][page_id % 4 + 1]) AS extension, octet_length(encode(html)) * 40 AS bytes FROM pages),
e AS (SELECT *, CASE WHEN page_id % 5 = 0 THEN 'File not found' WHEN page_id % 4 > 1 THEN 'Invalid file type. Supported: .mp4, .mov, .avi, .mkv, .webm' END AS error FROM p)
SELECT page_id, error IS NULL AS valid, error, CASE WHEN error IS NULL THEN filename END AS filename, CASE WHEN error IS NULL THEN round(bytes / 1048576, 2) END AS size_mb, CASE WHEN error IS NULL THEN extension END AS extension FROM e"""
)
def admit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, some missing and some of another type, asked for by path."""
    folder = new_folder(spark, "videos")
    wanted = page_files(spark, sf_dir, folder)
    return jobs.admit_files(wanted, tables.file_sizes(spark, folder)).drop("path")


# SQLite


def stored_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of the jobs table."""
    rows = derived.jobs(spark, sf_dir)
    name = F.concat(F.lit("v"), F.col("id").cast("string"), F.lit(".mp4"))
    return rows.select("id", F.concat(F.lit("/in/"), name).alias("video_path"), name.alias("video_filename"), F.col("minutes").alias("video_duration_minutes"), F.lit("basic").alias("prompt_name"), F.lit("{}").alias("config_json"), "status", F.when(F.col("status") == "complete", F.concat(F.lit("out/"), F.col("id").cast("string"))).alias("output_path"), F.col("created_at").cast("timestamp").alias("created_at"))


def database(spark: SparkSession) -> str:
    sqlite.register(spark)
    path = f"{new_folder(spark, 'sqlite')}/jobs.db"
    sqlite.create(path)
    return path


@query(f"WITH {JOBS_SQL} SELECT id, 'v' || id || '.mp4' AS video_filename, minutes AS video_duration_minutes, output_path, created_at, completed_at FROM (SELECT *, CASE WHEN status = 'complete' THEN 'out/' || id END AS output_path, NULL::TIMESTAMP AS completed_at FROM jobs) WHERE status = 'complete' AND id >= 100")
def sqlite_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs written to SQLite, by ranges of ids in order, and read back by ranges, with the conditions in the scan."""
    path = database(spark)
    rows = stored_jobs(spark, sf_dir).repartitionByRange(sqlite.ATTACHED, "id").sortWithinPartitions("id")
    rows.write.format("sqlite").option("path", path).option("table", "jobs").mode("append").save()
    held = sqlite.load(spark, path, "jobs", [("status", "=", "complete"), ("id", ">=", 100)])
    return held.select("id", "video_filename", "video_duration_minutes", "output_path", "created_at", "completed_at")


@query("SELECT key, value FROM (SELECT 'k' || user_id AS key, value::VARCHAR AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL) WHERE k = 1")
def sqlite_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings written twice: odd events' values first, then each key's last value replaces what is there."""
    path = database(spark)
    events = table(spark, sf_dir, "events").where("user_id is not null and value is not null")
    rows = events.select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.col("value").cast("string").alias("value"), F.col("ts").alias("updated_at"), "event_id")
    for some in (rows.where("event_id % 2 = 1"), rows):
        last = some.groupBy("key").agg(F.max_by(F.struct("value", "updated_at"), F.struct("updated_at", "event_id")).alias("last")).select("key", "last.*")
        last.write.format("sqlite").option("path", path).option("table", "settings").mode("append").save()
    return sqlite.load(spark, path, "settings").select("key", "value")


# Nested summaries

VALID_RUNS_SQL = RUNS_SQL.replace("\nruns AS (", "\nall_runs AS (").replace(
    "\nraw_lines AS",
    r"""
checked AS (SELECT *, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 50 AND contains(text, ':') AS ok FROM all_runs),
admitted AS (SELECT job_id, chunk_no, count(*) AS n_runs, count(*) FILTER (ok) AS n_valid FROM checked GROUP BY ALL),
runs AS (SELECT job_id, chunk_no, row_number() OVER (PARTITION BY job_id, chunk_no ORDER BY run_no)::INT AS run_no, text FROM checked WHERE ok),
raw_lines AS""",
)
ANALYSIS_SQL = f"""{V03_SQL.replace(RUNS_SQL, VALID_RUNS_SQL)},
said AS (SELECT b.job_id, b.chunk_no, b.line_no, count(a.run_no) AS n FROM base b LEFT JOIN aligned a ON a.job_id = b.job_id AND a.chunk_no = b.chunk_no AND a.line_no = b.line_no GROUP BY ALL),
shown AS (SELECT j.*, n, CASE quality WHEN 'accept' THEN '✅' WHEN 'review' THEN '⚠️' ELSE '🚨' END AS flag, CASE WHEN quality <> 'accept' THEN '👤' || round_even(speaker_raw * 100, 0)::INT || '💬' || round_even(content_raw * 100, 0)::INT END AS why FROM judged j JOIN said s ON s.job_id = j.job_id AND s.chunk_no = j.chunk_no AND s.line_no = j.line_no),
chunk AS (SELECT job_id, chunk_no, string_agg(ts || ' ' || speaker || ': ' || content || ' ' || flag || coalesce(' *' || why || '*', ''), chr(10) ORDER BY line_no) AS flagged, count(*) AS total_lines, count(*) FILTER (quality = 'accept') AS accept, count(*) FILTER (quality = 'review') AS review, count(*) FILTER (quality = 'critical') AS critical, avg(speaker_raw) AS speaker, avg(content_raw) AS content,
  string_agg(concat_ws('|', ts, speaker, content, flag, (quality <> 'accept')::VARCHAR, coalesce(why, '-'), printf('%.4f', floor(speaker_raw * 10000 + 0.5::DOUBLE) / 10000), printf('%.4f', floor(content_raw * 10000 + 0.5::DOUBLE) / 10000), n::VARCHAR), chr(10) ORDER BY line_no) AS lines FROM shown GROUP BY ALL)"""


def four_places(value: Column) -> Column:
    """A number from 0 up at four places, halves up; formats alone differ on halves, as some round the decimal and some the binary number."""
    return F.format_string("%.4f", F.floor(value * 10000 + 0.5) / 10000)


@query(
    f"""WITH {ANALYSIS_SQL} SELECT c.job_id, c.chunk_no, sha256(flagged) AS flagged_sha256, n_valid AS total_runs, true AS flagging_used, 'basic' AS algorithm_used, base_run::BIGINT AS run_index, round(score, 6) AS quality_score, 'quality_scoring' AS selection_reason, total_lines, accept AS auto_accept, review AS manual_review, critical AS critical_review, round(speaker, 6) AS speaker, round(content, 6) AS content,
accept / total_lines >= 0.8 AS research_ready, review + critical AS lines_needing_review, round(accept / total_lines, 6) AS auto_accept_rate, lines, n_runs AS total_attempts, n_valid AS valid_runs, n_runs - n_valid AS failed_runs, round(n_valid / n_runs, 6) AS success_rate
FROM chunk c JOIN best3 b ON b.job_id = c.job_id AND b.chunk_no = c.chunk_no JOIN admitted a ON a.job_id = c.job_id AND a.chunk_no = c.chunk_no WHERE n_valid > 1"""
)
def consensus_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis of each chunk as a JSON file of its own, read back."""
    checked = validate.validate(derived.runs(spark, sf_dir))
    number = F.row_number().over(Window.partitionBy(*CHUNK).orderBy("run_no"))
    runs = checked.where("ok").select(*CHUNK, number.alias("run_no"), "text")
    rows = summaries.consensus_analysis(runs, parsing.parse_v03(runs), validate.admit(checked))
    folder = new_folder(spark, "analyses")
    tables.write_transcripts(rows.select(*CHUNK, summaries.as_json("analysis").alias("line")), folder, tuple(CHUNK), ("line",))
    read = tables.read_transcripts(spark, folder, tuple(CHUNK)).select(*CHUNK, F.from_json("text", rows.schema["analysis"].dataType.simpleString()).alias("a"))
    s, v = "a.analysis_summary.", "a.validation_summary."
    line = lambda x: F.concat_ws("|", x["timestamp"], x["speaker"], x["content"], x["flag"], x["review_needed"].cast("string"), F.coalesce(x["flag_reason"], F.lit("-")), four_places(x["confidence"]["speaker"]), four_places(x["confidence"]["content"]), x["total_comparisons"].cast("string"))
    places = lambda c: F.round(c, 6).alias(c.rsplit(".", 1)[1])
    return read.select(
        *CHUNK, F.sha2("a.flagged_transcript", 256).alias("flagged_sha256"), f"{s}total_runs", f"{s}flagging_used", f"{s}algorithm_used", F.col(f"{s}baseline_selected.run_index").cast("long").alias("run_index"), places(f"{s}baseline_selected.quality_score"), f"{s}baseline_selected.selection_reason", f"{s}total_lines", f"{s}quality_distribution.*",
        places(f"{s}overall_confidence.speaker"), places(f"{s}overall_confidence.content"), f"{s}research_ready", f"{s}lines_needing_review", places(f"{s}auto_accept_rate"), F.array_join(F.transform("a.detailed_analysis", line), "\n").alias("lines"), f"{v}total_attempts", f"{v}valid_runs", f"{v}failed_runs", places(f"{v}success_rate"),
    )


@query(
    f"""WITH {JOB_CHUNKS_SQL}, v AS (SELECT *, NOT coalesce(CASE WHEN chunk_no % 4 = 0 THEN NULL ELSE chunk_no % 4 = 1 END, true) AS voiced, (chunk_no % 10) / 10 AS ratio, chunk_no % 13 AS n, (chunk_no % 8) / 8 AS c FROM job_chunks)
SELECT job_id, '/in/job ' || job_id || '.mp4' AS video_file, printf('2024-01-%02dT00:00:00', job_id % 28 + 1) AS processing_date, 'V04_VAD_Enhanced' AS version, 'm' || job_id % 3 AS model_name, (job_id % 5)::INT AS consensus_runs, job_id % 2 = 0 AS vad_informed_chunking, job_id % 3 = 0 AS whisper_available,
count(*) AS total_chunks, count(*) FILTER (voiced) AS vad_enhanced_chunks, count(*) FILTER (NOT voiced) AS traditional_chunks, coalesce(sum(n) FILTER (voiced), 0)::BIGINT AS total_speech_segments, round(coalesce(avg(ratio) FILTER (voiced AND ratio > 0), 0), 6) AS avg_speech_ratio, round(coalesce(avg(c) FILTER (voiced AND c > 0), 0), 6) AS avg_vad_confidence,
count(*) AS chunks_processed, count(*) FILTER (NOT starts_with(text, '[')) AS successful_chunks, count(*) FILTER (starts_with(text, '[')) AS failed_chunks, round(count(*) FILTER (voiced) / count(*), 6) AS vad_enhancement_rate,
'/out/' || job_id || '/job ' || job_id || '_v04_complete_transcript.txt' AS complete_transcript, '/out/' || job_id || '/chunks' AS chunks_directory, '/out/' || job_id || '/v04_processing_summary.json' AS processing_summary FROM v GROUP BY job_id"""
)
def processing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each job as a JSON file of its own, read back."""
    n, job = F.col("chunk_no"), F.col("job_id")
    chunks = chunks_of_jobs(spark, sf_dir).withColumns({"fallback_mode": F.when(n % 4 == 0, F.lit(None).cast("boolean")).otherwise(n % 4 == 1), "speech_ratio": n % 10 / 10, "num_segments": n % 13, "avg_confidence": n % 8 / 8})
    key = job.cast("string")
    config = summaries.fields(model_name=F.concat(F.lit("m"), (job % 3).cast("string")), consensus_runs=(job % 5).cast("int"), vad_informed_chunking=job % 2 == 0)
    info = chunks.select("job_id").distinct().select("job_id", F.concat(F.lit("/in/job "), key, F.lit(".mp4")).alias("video_file"), F.format_string("2024-01-%02dT00:00:00", job % 28 + 1).alias("processing_date"), config.alias("config"), summaries.fields(whisper_available=job % 3 == 0).alias("dependency_status"), F.concat(F.lit("/out/"), key).alias("output_dir"))
    rows = summaries.processing_summary(chunks, info)
    folder = new_folder(spark, "summaries")
    tables.write_transcripts(rows.select("job_id", summaries.as_json("summary").alias("line")), folder, ("job_id",), ("line",))
    read = tables.read_transcripts(spark, folder, ("job_id",)).select("job_id", F.from_json("text", rows.schema["summary"].dataType.simpleString()).alias("s"))
    out = read.select("job_id", "s.video_file", "s.processing_date", "s.version", "s.config.*", "s.dependency_status.*", "s.vad_statistics.*", "s.processing_results.*", "s.output_files.*")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_speech_ratio", "avg_vad_confidence", "vad_enhancement_rate")})
