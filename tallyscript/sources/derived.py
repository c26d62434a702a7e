"""Inputs of the operators, derived from the given tables by rule; DuckDB's form of each rule stands beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscript.sources.tables import table

#: Runs of each chunk.
RUNS = 3
HOP_S, ASR_EVERY, ASR_FRAMES = 0.01, 25, 10


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, chunk_no, run_no, text: three differing transcripts of every conversation; ten conversations are a job."""
    turns = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 10).alias("job_id"), (F.col("conv_id") % 10 + 1).alias("chunk_no"), "turn", "role", F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1).alias("words"))
    rows = turns.withColumn("run_no", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1)))).where("(turn + chunk_no + run_no) % 7 <> 0")
    sec = F.greatest(F.lit(0).cast("long"), F.col("turn") * 7 + F.col("chunk_no") % 5 + F.col("run_no") * (F.col("turn") % 3 - 1) * 2)
    speaker = F.when((F.col("turn") * 3 + F.col("chunk_no") + F.col("run_no")) % 11 == 0, "system").otherwise(F.col("role"))
    content = F.array_join(F.slice("words", F.col("run_no") + 1, F.size("words")), " ")
    line = F.concat(F.format_string("%02d:%02d", F.floor(sec / 60), sec % 60), F.lit(" "), speaker, F.lit(": "), content)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda s: s["line"])
    return rows.groupBy("job_id", "chunk_no", "run_no").agg(F.array_join(ordered, "\n").alias("text"))


RUNS_SQL = r"""
turns AS (SELECT conv_id // 10 AS job_id, conv_id % 10 + 1 AS chunk_no, turn, role, string_split(replace(text, chr(10), ' '), ' ') AS words FROM conversations),
turn_runs AS (
  SELECT job_id, chunk_no, run_no, turn, greatest(0, turn * 7 + chunk_no % 5 + run_no * (turn % 3 - 1) * 2) AS sec, CASE WHEN (turn * 3 + chunk_no + run_no) % 11 = 0 THEN 'system' ELSE role END AS speaker, array_to_string(words[run_no + 1 :], ' ') AS content
  FROM turns, (SELECT unnest([0, 1, 2]) AS run_no) WHERE (turn + chunk_no + run_no) % 7 <> 0
),
runs AS (SELECT job_id, chunk_no, run_no::INT AS run_no, string_agg(printf('%02d:%02d', sec // 60, sec % 60) || ' ' || speaker || ': ' || content, chr(10) ORDER BY turn) AS text FROM turn_runs GROUP BY ALL),
raw_lines AS (SELECT job_id, chunk_no, run_no, i - 1 AS line_no, l[i] AS line FROM (SELECT job_id, chunk_no, run_no, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT job_id, chunk_no, run_no, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS l FROM runs))),
lines AS (
  SELECT job_id, chunk_no, run_no, line_no::INT AS line_no, regexp_extract(line, '^(\d{1,2}:\d{2})\s+([^:]+):\s*(.*)$', 1) AS ts, regexp_replace(regexp_extract(line, '^(\d{1,2}:\d{2})\s+([^:]+):\s*(.*)$', 2), '^\s+|\s+$', '', 'g') AS speaker, regexp_replace(regexp_extract(line, '^(\d{1,2}:\d{2})\s+([^:]+):\s*(.*)$', 3), '^\s+|\s+$', '', 'g') AS content
  FROM (SELECT job_id, chunk_no, run_no, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM raw_lines) WHERE regexp_matches(line, '^(\d{1,2}:\d{2})\s+([^:]+):\s*(.*)$')
),
timed AS (SELECT *, (string_split(ts, ':')[1]::INT * 60 + string_split(ts, ':')[2]::INT) AS sec FROM lines)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, frame_idx, energy: the events of a user as frames in order of time, event and value, nulls last, so that no order of equal events is left to chance."""
    events = table(spark, sf_dir, "events").where("user_id is not null")
    order = Window.partitionBy("user_id").orderBy(*(F.asc_nulls_last(c) for c in ("ts", "event_id", "value")))
    return events.select(F.col("user_id").alias("stream_id"), (F.row_number().over(order) - 1).alias("frame_idx"), F.col("value").alias("energy"))


FRAMES_SQL = "frames AS (SELECT user_id AS stream_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id NULLS LAST, value NULLS LAST) - 1)::INT AS frame_idx, value AS energy FROM events WHERE user_id IS NOT NULL)"


def asr_segments(frames_: DataFrame) -> DataFrame:
    """Every 25th frame begins a segment of ten frames."""
    return frames_.where(F.col("frame_idx") % ASR_EVERY == 0).select("stream_id", (F.col("frame_idx") * F.lit(HOP_S)).alias("start_s"), ((F.col("frame_idx") + ASR_FRAMES) * F.lit(HOP_S)).alias("end_s"))


def streams(frames_: DataFrame) -> DataFrame:
    return frames_.groupBy("stream_id").agg((F.count("*") * F.lit(HOP_S)).alias("duration_s"))


STREAMS_SQL = "streams AS (SELECT stream_id, count(*) * 0.01::DOUBLE AS duration_s FROM frames GROUP BY stream_id)"


def calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(segments, streams), a stream for each customer: an order is a speech segment, its time the day of the year, its length from the price."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream_id"), "o_orderkey", (F.dayofyear("o_orderdate") * 4.0).alias("start_s"), F.col("o_totalprice"))
    rows = orders.select("stream_id", "o_orderkey", "start_s", (F.col("start_s") + 1 + F.floor(F.col("o_totalprice")) % 40 / 8).alias("end_s"), (F.floor(F.col("o_totalprice")) % 100 / 100).alias("confidence"))
    order = Window.partitionBy("stream_id").orderBy("start_s", "end_s", "o_orderkey")
    segments = rows.select("stream_id", F.row_number().over(order).alias("seg_no"), "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration"), "confidence")
    return segments, segments.groupBy("stream_id").agg((F.max("end_s") + F.col("stream_id") % 7).alias("duration_s"))


CALLS_SQL = """
call_rows AS (SELECT o_custkey AS stream_id, o_orderkey, dayofyear(o_orderdate) * 4.0::DOUBLE AS start_s, dayofyear(o_orderdate) * 4.0::DOUBLE + 1 + (floor(o_totalprice)::BIGINT % 40) / 8 AS end_s, (floor(o_totalprice)::BIGINT % 100) / 100 AS confidence FROM orders),
segments AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_s, end_s, o_orderkey)::INT AS seg_no, start_s, end_s, end_s - start_s AS duration, confidence FROM call_rows),
streams AS (SELECT stream_id, max(end_s) + stream_id % 7 AS duration_s FROM segments GROUP BY stream_id)"""


def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_lines(table(spark, sf_dir, "events"))


def progress_lines(events: DataFrame) -> DataFrame:
    """job_id, seq, raw, source: events as lines of running jobs, some without a prefix, some malformed."""
    e = events.where("user_id is not null")
    chunk, total = F.col("event_id") % 12 + 1, F.lit(12)
    json = F.format_string('{"type":"%s","chunk":%d,"total":%d,"percent":%d,"status":"step %d","message":"m%d","level":"info"}', "event_type", chunk, total, F.floor(chunk * 100 / total), chunk, F.col("event_id") % 100)
    done = F.format_string('{"type":"complete","chunksProcessed":%d,"message":"m%d"}', chunk, F.col("event_id") % 100)
    raw = F.when(F.col("event_id") % 17 == 0, "").when(F.col("event_type") == "view", F.concat(F.lit("PROGRESS:"), json)).when(F.col("event_type") == "purchase", F.concat(F.lit("COMPLETE:"), done)).when(F.col("event_type") == "error", F.concat(F.lit("ERROR:"), json)).when(F.col("event_type") == "signup", F.concat(F.lit("LOG:"), F.when(F.col("event_id") % 3 == 0, '{"type":').otherwise(json))).otherwise(F.concat(F.lit("  line "), F.col("event_id").cast("string")))
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), raw.alias("raw"), F.when(F.col("event_id") % 23 == 0, "stderr").otherwise("stdout").alias("source"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs."""
    status = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"), "failed").when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("minutes"))


JOBS_SQL = "jobs AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'processing' END AS status, o_orderdate AS created_at, o_totalprice AS minutes FROM orders)"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as prompts with marked sections."""
    text = F.concat(F.lit("intro\n**ROLE:**\n"), F.col("p_name"), F.lit("\n**OUTPUT FORMAT:**\n MM:SS "), F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("\n**ROLE:**\n again "), F.col("p_type"))).otherwise(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.when(F.col("p_partkey") % 11 == 0, "no sections").otherwise(text).alias("prompt_text"))
