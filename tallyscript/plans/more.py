"""Further named queries: prompts, attempts, contexts, job results and small checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscript.operators import assemble, chunking, consensus, cost, jobs, parsing, signal, validate
from tallyscript.plans.queries import FLAGGED_SQL, JOB_CHUNKS_SQL, PARTS_SQL, PLAIN_FLAG_SQL, PROGRESS_SQL, SHIFT_SQL, V03_SQL, V04_SQL, chunks_of_jobs, flagged_v04, lines_v03, query, rounded
from tallyscript.sources import derived, tables
from tallyscript.sources.derived import CALLS_SQL, JOBS_SQL, RUNS_SQL
from tallyscript.sources.shared import new_folder
from tallyscript.sources.tables import table
from tallyscript.streaming import progress


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as attempts, a customer's orders being those of one run; every third is valid."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.lit(0).cast("long").alias("job_id"), F.col("o_custkey").alias("chunk_no"), F.lit(0).alias("run_no"), key.alias("attempt"), (key % 3 == 0).alias("ok"), F.concat(F.lit("t"), key.cast("string")).alias("text"), (key % 6).cast("int").alias("finish_reason"))


@query("SELECT o_custkey AS chunk_no, count(*) AS attempts, bool_or(o_orderkey % 3 = 0) AS ok, 't' || coalesce(min(o_orderkey) FILTER (o_orderkey % 3 = 0), max(o_orderkey)) AS text FROM orders GROUP BY o_custkey")
def first_valid_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.first_valid(attempts(spark, sf_dir)).select("chunk_no", "attempts", "ok", "text")


@query("""WITH a AS (SELECT o_orderkey AS attempt, o_orderkey % 6 AS r, CASE WHEN o_orderkey % 5 <> 0 THEN 't' || o_orderkey END AS t FROM orders), w AS (SELECT *, 'Generation stopped due to ' || coalesce(['UNSPECIFIED', 'STOP', 'MAX_TOKENS', 'SAFETY', 'RECITATION'][r + 1], 'UNKNOWN(' || r || ')') AS s FROM a)
SELECT attempt, CASE WHEN r = 1 THEN t WHEN t IS NOT NULL THEN '[PARTIAL_VAD: ' || s || ']' || chr(10) || chr(10) || t END AS response, CASE WHEN t IS NULL THEN CASE WHEN r = 1 THEN 'No content parts in response' ELSE s END END AS error FROM w""")
def unwrap_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.unwrap(attempts(spark, sf_dir).withColumn("text", F.when(F.col("attempt") % 5 != 0, F.col("text")))).select("attempt", "response", "error")


@query("WITH f AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 = 0 AS ok, coalesce(sum((o_orderkey % 3 <> 0)::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failed FROM orders) SELECT o_custkey AS chunk_no, o_orderkey AS run_no, ok FROM f WHERE failed < 2")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = attempts(spark, sf_dir).select("job_id", "chunk_no", F.col("attempt").alias("run_no"), "ok")
    return validate.stop_early(runs, 5).select("chunk_no", "run_no", "ok")


VOICED = "v AS (SELECT *, CASE WHEN chunk_no % 4 = 0 THEN NULL ELSE chunk_no % 4 = 1 END AS fallback_mode, (chunk_no % 13)::BIGINT AS num_segments FROM job_chunks)"


def voiced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("chunk_no")
    return chunks_of_jobs(spark, sf_dir).withColumns({"fallback_mode": F.when(n % 4 == 0, F.lit(None).cast("boolean")).otherwise(n % 4 == 1), "num_segments": n % 13})


@query(f"WITH {JOB_CHUNKS_SQL}, {VOICED}, k AS (SELECT *, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, ':'))) AS n FROM v) SELECT job_id, chunk_no, NOT (NOT coalesce(fallback_mode, true) AND ((num_segments > 5 AND n < 2) OR (num_segments = 0 AND n > 10))) AS voice_ok FROM k")
def voice_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voiced_chunks(spark, sf_dir).withColumn("vad_info", F.struct("fallback_mode", "num_segments"))
    return validate.check_voice(rows).select("job_id", "chunk_no", "voice_ok")


@query(f"WITH {JOB_CHUNKS_SQL}, {VOICED} SELECT job_id, count(*) AS total_chunks, count(*) FILTER (NOT coalesce(fallback_mode, true)) AS enhanced, printf('%.1f%%', count(*) FILTER (NOT coalesce(fallback_mode, true)) / count(*) * 100) AS rate FROM v GROUP BY job_id")
def assembly_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.header(voiced_chunks(spark, sf_dir))


@query(
    rf"""WITH {JOB_CHUNKS_SQL}, held AS (SELECT job_id, chunk_no, last_value(CASE WHEN NOT starts_with(text, '[') THEN text END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM job_chunks),
k AS (SELECT job_id, chunk_no, t, array_to_string(list_filter(list_transform(string_split(t, chr(10))[-10:], lambda x: trim(x)), lambda x: contains(x, ':') AND regexp_matches(substr(x, 1, 10), '[0-9]'))[-5:], chr(10)) AS c FROM held)
SELECT job_id, chunk_no, CASE WHEN chunk_no = 1 THEN 'SEQUENCE CONTEXT: This is the start of the video - begin transcription from the beginning.' WHEN coalesce(t, '') = '' THEN 'SEQUENCE CONTEXT: Continuing from chunk ' || chunk_no - 1 || ' (previous context unavailable).' WHEN c <> '' THEN 'SEQUENCE CONTEXT: Continuing from chunk ' || chunk_no - 1 || '. ' || chr(10) || 'Recent conversation:' || chr(10) || chr(10) || c || chr(10) || chr(10) || 'Continue naturally from this context, maintaining speaker consistency.' ELSE 'SEQUENCE CONTEXT: Continuing from chunk ' || chunk_no - 1 || ' - maintain speaker consistency.' END AS sequence FROM k"""
)
def continuity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assemble.carry_context(chunks_of_jobs(spark, sf_dir))
    return rows.select("job_id", "chunk_no", assemble.continuity(F.col("chunk_no"), F.col("previous")).alias("sequence"))


@query(rf"WITH {JOB_CHUNKS_SQL} SELECT job_id, chunk_no, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: contains(x, ':') AND regexp_matches(substr(x, 1, 10), '[0-9]'))[-50:], chr(10)) AS context FROM job_chunks")
def context_v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of_jobs(spark, sf_dir).select("job_id", "chunk_no", assemble.context_v03(F.col("text")).alias("context"))


@query(
    """WITH p AS (SELECT p_partkey, p_size % 13 AS n, p_size % 10 / 10 AS c, p_partkey % 4 / 4 AS r, p_partkey % 9 = 0 AS f FROM part)
SELECT p_partkey, CASE WHEN f THEN 'VAD CONTEXT: Standard chunking mode (VAD preprocessing unavailable).' ELSE 'VAD PREPROCESSING RESULTS:' || chr(10) || printf('- Speech coverage: %.1f%% of total duration', r * 100) || chr(10) || '- Detected ' || n || ' speech segments' || chr(10) || printf('- Average VAD confidence: %.2f', c) || CASE WHEN n > 10 THEN chr(10) || '- High speech activity detected - expect multiple speaker turns' WHEN n < 3 THEN chr(10) || '- Low speech activity - focus on clear, distinct utterances' ELSE '' END || CASE WHEN c > 0.8 THEN chr(10) || '- High confidence speech detection - expect clear audio' WHEN c < 0.5 THEN chr(10) || '- Lower confidence detection - some segments may be unclear' ELSE '' END || chr(10) || chr(10) || 'Focus transcription on VAD-identified speech regions for optimal accuracy.' END AS context FROM p"""
)
def voice_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", assemble.voice_context(F.col("p_partkey") % 9 == 0, F.col("p_partkey") % 4 / 4, n % 13, n % 10 / 10).alias("context"))


@query("SELECT key, CASE WHEN key::BIGINT % 11 = 0 THEN 'no sections' ELSE 'intro' || chr(10) || '**ROLE:**' || chr(10) || p.p_name || chr(10) || '**OUTPUT FORMAT:**' || chr(10) || ' MM:SS ' || p.p_brand || CASE WHEN p.p_partkey % 3 = 0 THEN chr(10) || '**ROLE:**' || chr(10) || ' again ' || p.p_type ELSE '' END END AS prompt_text FROM (SELECT DISTINCT l_partkey::VARCHAR AS key FROM lineitem) w JOIN part p ON p.p_partkey::VARCHAR = w.key")
def prompt_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("key")).distinct()
    return jobs.prompt_of(wanted, derived.prompts(spark, sf_dir).withColumn("name", F.when(F.col("id") == "0", "basic").otherwise(F.concat(F.lit("n"), "id"))))


@query("SELECT p_partkey::VARCHAR AS id, '**ROLE:**' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'again ' || p_type ELSE p_name END || chr(10) || chr(10) || '**OUTPUT FORMAT:**' || chr(10) || 'MM:SS ' || p_brand AS prompt_text FROM part WHERE p_partkey % 11 <> 0")
def prompt_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.join_sections(parsing.sections(derived.prompts(spark, sf_dir)))


@query("SELECT p_partkey::VARCHAR AS id, p_name AS name, p_type AS description, p_brand AS prompt_text FROM part WHERE p_partkey % 5 <> 4 AND p_partkey % 7 <> 0")
def prompt_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, body = F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_brand"))
    mapped = F.to_json(F.create_map(id_, F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("description"), body.alias("prompt"))))
    listed = F.to_json(F.struct(F.array(F.struct(id_.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), body.alias("prompt_text"))).alias("prompts")))
    text = F.when(F.col("p_partkey") % 5 == 4, "{broken").when(F.col("p_partkey") % 2 == 0, mapped).otherwise(listed)
    return tables.importable(tables.prompt_library(table(spark, sf_dir, "part").select(text.alias("text"))))


@query("SELECT p_type AS id FROM (SELECT p_type, min(p_partkey) AS k FROM part GROUP BY p_type) ORDER BY k LIMIT 1")
def default_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("id")).agg(F.min("p_partkey").alias("position"))
    return jobs.default_prompt(types, "absent")


@query(f"WITH {JOBS_SQL} SELECT status, count(*) AS n FROM (SELECT id, status FROM jobs UNION ALL SELECT c_custkey + 10000000, 'queued' FROM customer) GROUP BY status")
def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = derived.jobs(spark, sf_dir).select("id", "status")
    fresh = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 10_000_000).alias("id"), F.lit("queued").alias("status"))
    return jobs.seed(jobs.seed(held, fresh, "id"), held, "id").groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {JOBS_SQL} SELECT id, 'note ' || c_mktsegment AS text, id % 9 AS chunks, id % 50 AS lines FROM jobs j LEFT JOIN customer c ON c.c_custkey = j.id WHERE status = 'complete'")
def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = jobs.by_status(derived.jobs(spark, sf_dir), "complete").select("id", F.concat(F.lit("out/"), F.col("id").cast("string")).alias("output_path"), F.to_json(F.struct((F.col("id") % 9).alias("chunks"), (F.col("id") % 50).alias("lines"))).alias("stats_json"))
    notes = table(spark, sf_dir, "customer").select(F.concat(F.lit("out/"), F.col("c_custkey").cast("string")).alias("path"), F.concat(F.lit("note "), "c_mktsegment").alias("text"))
    return jobs.with_results(done, notes).select("id", "text", "stats.chunks", "stats.lines")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '/home/me/' || c_name WHEN 1 THEN '/home/me/out' ELSE '/data/' || c_name END AS path FROM customer")
def home_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    path = F.when(k == 0, F.concat(F.lit("~/"), "c_name")).when(k == 1, "").otherwise(F.concat(F.lit("/data/"), "c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", jobs.home_path(path, "/home/me", "~/out").alias("path"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 8 = 0 THEN 0 ELSE trunc(l_linenumber * 100 / (l_suppkey % 8))::INT END AS percent FROM lineitem")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", progress.percent_done(F.col("l_linenumber"), F.col("l_suppkey") % 8).alias("percent"))


@query("SELECT user_id AS job_id, event_id AS seq, 'error' AS kind, 'Process exited with code ' || event_id % 3 AS message FROM events WHERE event_id % 5 <> 0 AND event_id % 3 <> 0")
def exit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 3)
    return progress.exit_events(table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), code.alias("code")))


@query("SELECT l_orderkey, l_linenumber, abs(l_tax * 100 - l_discount * 100) > 1 AS duration_off, l_quantity * 2 > 95 AS too_large, l_quantity * 2 < 0.1 AS too_small FROM lineitem")
def cut_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 100).alias("expected_s"), (F.col("l_tax") * 100).alias("actual_s"), (F.col("l_quantity") * 2).alias("mb"))
    return chunking.check_cuts(cuts).select("l_orderkey", "l_linenumber", "duration_off", "too_large", "too_small")


@query(f"WITH {CALLS_SQL} SELECT stream_id, (k + 1)::INT AS chunk_no, true AS fallback_mode, 0.0::DOUBLE AS bonus FROM (SELECT stream_id, unnest(range(0, ceil(duration_s / 180)::BIGINT)) AS k FROM streams)")
def fallback_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.no_voice(chunking.fixed_chunks(derived.calls(spark, sf_dir)[1], 180)).withColumn("hybrid", F.lit(False))
    return consensus.voice_bonus(chunks).select("stream_id", "chunk_no", "fallback_mode", "bonus")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))) AS line FROM documents), c AS (SELECT doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS content, count(*) AS n FROM l GROUP BY ALL) SELECT doc_id, first(content ORDER BY n DESC, content) AS content, max(n) AS n FROM c GROUP BY doc_id""")
def commonest_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit("a: "), x))
    return validate.commonest(table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text")), ("doc_id",))


@query(
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity * 60 * 300 AS i, l_quantity * 60 * 300 * 0.15::DOUBLE AS o, 1 + l_linenumber % 3 * 2 AS runs FROM lineitem),
p AS (SELECT *, least(i, 200000) / 1000 * 0.00125::DOUBLE + greatest(i - 200000, 0) / 1000 * 0.0025::DOUBLE AS ci, least(o, 200000) / 1000 * 0.010::DOUBLE + greatest(o - 200000, 0) / 1000 * 0.015::DOUBLE AS co FROM v)
SELECT l_orderkey, l_linenumber, (trunc(i + o) * runs)::BIGINT AS total_tokens, round(round(ci, 3) * runs, 3) AS input_cost, round(round(co, 3) * runs, 3) AS output_cost, round(round(ci + co, 3) * runs, 3) AS total_cost FROM p"""
)
def cost_estimate_v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("duration_min"), F.lit(cost.PRICES[0][0]).alias("model"), F.lit(3).alias("chunk_min"), F.lit(1).alias("fps"), (1 + F.col("l_linenumber") % 3 * 2).alias("runs"))
    rows = cost.estimate_cost(videos, cost.prices(spark), v03=True)
    return rows.select("l_orderkey", "l_linenumber", F.col("total_tokens").cast("long").alias("total_tokens"), *[F.round(c, 3).alias(c) for c in ("input_cost", "output_cost", "total_cost")])


@query(f"WITH {JOB_CHUNKS_SQL}, {SHIFT_SQL} SELECT job_id, chunk_no, line_no, line FROM shifted WHERE NOT (starts_with(line, 'Prompt:') OR starts_with(line, 'Chunk size:') OR starts_with(line, 'Validation:'))")
def shift_timestamps_v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.shift_lines(chunks_of_jobs(spark, sf_dir), v03=True)


@query(f"WITH {V03_SQL} SELECT job_id, chunk_no, line_no, ts || ' ' || speaker || ': ' || content || CASE quality WHEN 'accept' THEN ' ✅' WHEN 'review' THEN ' ⚠️' ELSE ' 🚨' END || CASE WHEN quality <> 'accept' THEN ' *👤' || round_even(speaker_raw * 100, 0)::INT || '💬' || round_even(content_raw * 100, 0)::INT || '*' ELSE '' END AS text FROM judged")
def consensus_v03_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus_v03(*lines_v03(spark, sf_dir)).select("job_id", "chunk_no", "line_no", "text")


@query(f"WITH {RUNS_SQL} SELECT job_id, chunk_no, count(DISTINCT speaker) AS speakers, count(*) AS n_lines FROM timed GROUP BY ALL")
def distinct_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_v04(derived.runs(spark, sf_dir)).groupBy("job_id", "chunk_no").agg(F.count_distinct("speaker").alias("speakers"), F.count("*").alias("n_lines"))


@query(f"WITH {PROGRESS_SQL}, e AS (SELECT job_id, seq, kind, message FROM parsed UNION ALL SELECT user_id, event_id, 'error', 'Process exited with code ' || event_id % 3 FROM events WHERE event_id % 5 <> 0 AND event_id % 3 <> 0) SELECT job_id, kind, count(*) AS n, max(seq) AS last_seq FROM e GROUP BY ALL")
def merged_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = progress.parse(derived.progress_log(spark, sf_dir)).select("job_id", "seq", "kind", "message")
    return parsed.unionByName(exit_events(spark, sf_dir)).groupBy("job_id", "kind").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@query("SELECT key, arg_max(value, ts) AS value FROM (SELECT 'k' || user_id % 20 AS key, value, ts FROM events) GROUP BY key")
def settings_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("k"), (F.col("user_id") % 20).cast("string")).alias("key"), "value", F.col("ts").alias("updated_at"))
    held = jobs.as_map(jobs.latest(rows, rows.limit(0), "key", "updated_at"))
    return held.select(F.explode("settings").alias("key", "value"))


# Forms of the older format


@query("""WITH a AS (SELECT o_orderkey AS attempt, o_orderkey % 6 AS r, CASE WHEN o_orderkey % 5 <> 0 THEN 't' || o_orderkey END AS t FROM orders), w AS (SELECT *, 'Generation stopped due to ' || coalesce(['UNSPECIFIED', 'STOP', 'MAX_TOKENS', 'SAFETY', 'RECITATION'][r + 1], 'UNKNOWN(' || r || ')') AS s FROM a)
SELECT attempt, CASE WHEN r = 1 THEN t WHEN t IS NOT NULL THEN '[PARTIAL: ' || s || ']' || chr(10) || chr(10) || t END AS response, CASE WHEN t IS NULL THEN CASE WHEN r = 1 THEN 'No content parts in response' ELSE s || ' with no content' END END AS error FROM w""")
def unwrap_responses_v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.unwrap(attempts(spark, sf_dir).withColumn("text", F.when(F.col("attempt") % 5 != 0, F.col("text"))), v03=True).select("attempt", "response", "error")


@query(
    rf"""WITH {JOB_CHUNKS_SQL}, held AS (SELECT job_id, chunk_no, last_value(CASE WHEN NOT (starts_with(text, '[CONSENSUS_FAILED') OR starts_with(text, '[VALIDATION_FAILED')) THEN {{'n': chunk_no, 't': text}} END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM job_chunks)
SELECT job_id, chunk_no, coalesce(h.n, -1)::BIGINT AS context_chunk_no, array_to_string(list_filter(list_transform(string_split(h.t, chr(10)), lambda x: trim(x)), lambda x: contains(x, ':') AND regexp_matches(substr(x, 1, 10), '[0-9]'))[-50:], chr(10)) AS context FROM held"""
)
def carry_context_v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.carry_context(chunks_of_jobs(spark, sf_dir), v03=True).select("job_id", "chunk_no", F.coalesce("context_chunk_no", F.lit(-1)).alias("context_chunk_no"), "context")


@query(
    rf"""WITH {JOB_CHUNKS_SQL}, {SHIFT_SQL}, body AS (SELECT job_id, chunk_no, string_agg(line, chr(10) ORDER BY line_no) AS body FROM shifted WHERE NOT (starts_with(line, 'Prompt:') OR starts_with(line, 'Chunk size:') OR starts_with(line, 'Validation:')) GROUP BY ALL),
p AS (SELECT c.job_id, c.chunk_no, starts_with(text, '[CONSENSUS_FAILED') AS gone, '--- Chunk ' || c.chunk_no || printf(' (Starting at %.1f minutes) ---', start_s / 60) || chr(10) || body || chr(10) AS part FROM job_chunks c LEFT JOIN body ON body.job_id = c.job_id AND body.chunk_no = c.chunk_no)
SELECT job_id, count(*) AS n_chunks, count(*) FILTER (gone) AS n_left_out, coalesce(string_agg(part, chr(10) ORDER BY chunk_no) FILTER (NOT gone), '') AS document FROM p GROUP BY job_id"""
)
def assemble_transcript_v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.assemble_v03(chunks_of_jobs(spark, sf_dir))


@query(f"WITH {V04_SQL}, {PLAIN_FLAG_SQL}, f AS (SELECT {FLAGGED_SQL} FROM flagged) SELECT job_id, chunk_no, string_agg(text, chr(10) ORDER BY line_no) AS text FROM f GROUP BY ALL")
def consensus_v04_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagged lines of each chunk, formatted and joined."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"])
    return flagged_v04(spark, sf_dir).groupBy("job_id", "chunk_no").agg(F.array_join(ordered, "\n").alias("text"))


@query(
    rf"""WITH {JOB_CHUNKS_SQL}, held AS (SELECT job_id, chunk_no, last_value(CASE WHEN NOT (starts_with(text, '[CONSENSUS_FAILED') OR starts_with(text, '[VALIDATION_FAILED')) THEN text END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM job_chunks),
k AS (SELECT job_id, chunk_no, coalesce(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: contains(x, ':') AND regexp_matches(substr(x, 1, 10), '[0-9]'))[-50:], chr(10)), '') AS c FROM held)
SELECT job_id, chunk_no, 'Transcribe job ' || job_id || '.' || chr(10) || chr(10) || CASE WHEN chunk_no = 1 THEN 'IMPORTANT: This is the start of the video. Begin transcription from the very beginning.' WHEN c <> '' THEN 'PREVIOUS CONTEXT: Here are the final moments from the previous video segment:' || chr(10) || chr(10) || c || chr(10) || chr(10) || 'IMPORTANT: Continue the transcription naturally from where this context ends. Maintain speaker identification consistency and conversational flow. Use the same speaker names (Ava, A06, A04, BS) as established in the previous context.' ELSE 'IMPORTANT: This continues from the previous video segment (chunk ' || chunk_no - 1 || '). Maintain speaker identification consistency.' END AS prompt FROM k"""
)
def prompt_assembly_v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("Transcribe job "), F.col("job_id").cast("string"), F.lit("."))
    rows = assemble.carry_context(chunks_of_jobs(spark, sf_dir), v03=True)
    return rows.select("job_id", "chunk_no", assemble.full_prompt_v03(base, F.col("chunk_no"), F.col("previous")).alias("prompt"))


# Jobs and prompts as tables


@query("SELECT c_custkey AS id, '/in/' || c_name || '.mp4' AS video_path, c_name || '.mp4' AS video_filename, c_mktsegment AS prompt_name, CASE WHEN c_custkey % 4 = 0 THEN '{}' ELSE '{\"model\":\"m\",\"runs\":' || c_custkey % 5 || '}' END AS config_json, 'queued' AS status FROM customer")
def insert_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = F.when(F.col("c_custkey") % 4 != 0, F.to_json(F.struct(F.lit("k").alias("apiKey"), F.lit("m").alias("model"), (F.col("c_custkey") % 5).alias("runs"))))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("/in/"), "c_name", F.lit(".mp4")).alias("video_path"), F.col("c_mktsegment").alias("prompt_name"), config.alias("config"))
    held = spark.createDataFrame([], "id long, video_path string, video_filename string, prompt_name string, config_json string, status string")
    return jobs.insert(held, new)


@query(f"WITH {JOBS_SQL} SELECT id, status, created_at, minutes FROM jobs WHERE id = (SELECT max(l_orderkey) FROM lineitem)")
def job_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return jobs.by_id(derived.jobs(spark, sf_dir), wanted)


@query("SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_name ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS description, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 't0' WHEN p_partkey % 3 = 0 THEN 't1' ELSE 't0' END AS created_at, CASE WHEN p_partkey % 3 = 0 THEN 't1' ELSE 't0' END AS updated_at FROM part")
def prompt_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third prompt is saved: of these, even ones are there and are replaced, odd ones are new."""
    key = F.col("id").cast("long")
    prompts = derived.prompts(spark, sf_dir).withColumns({"created_at": F.lit("t0"), "updated_at": F.lit("t0")})
    held = prompts.where((key % 3 != 0) | (key % 2 == 0))
    changes = prompts.where(key % 3 == 0).select("id", F.concat(F.lit("new "), "name").alias("name"), F.lit(None).cast("string").alias("description"), "prompt_text", F.when(key % 2 == 0, F.lit("t0")).alias("created_at"), F.lit(None).cast("string").alias("updated_at"))
    return jobs.save_prompts(held, changes, F.lit("t1")).select("id", "name", "description", "created_at", "updated_at")


@query("SELECT p_partkey::VARCHAR AS id, p_name AS name FROM part WHERE p_partkey % 7 = 2")
def prompt_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = derived.prompts(spark, sf_dir)
    return jobs.prompts_of(held.where("cast(id as long) % 7 = 2").select("id"), held).select("id", "name")


@query("SELECT p_partkey::VARCHAR AS key, p_name AS name, p_type AS description, printf('  %-20s - ', p_partkey::VARCHAR) || p_name || chr(10) || repeat(' ', 25) || p_type AS line FROM part")
def prompt_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.listing(derived.prompts(spark, sf_dir))


@query("SELECT p_name || '.json' AS path, p_name AS name, p_type AS description FROM part")
def prompt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported prompts, read back from their JSON."""
    fields = F.from_json("json", "name string, description string, prompt_text string")
    return jobs.exported(derived.prompts(spark, sf_dir)).select("path", fields.alias("p")).select("path", "p.name", "p.description")


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || 'VAD CONTEXT: Standard chunking mode (VAD preprocessing unavailable).' || chr(10) || chr(10) || CASE WHEN p_size = 1 THEN 'SEQUENCE CONTEXT: This is the start of the video - begin transcription from the beginning.' ELSE 'SEQUENCE CONTEXT: Continuing from chunk ' || p_size - 1 || ' (previous context unavailable).' END AS prompt FROM part")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    whole = assemble.full_prompt(F.col("p_name"), assemble.voice_context(F.lit(True), none, none, none), assemble.continuity(F.col("p_size"), F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", whole.alias("prompt"))


# Sinks, and energy of samples


FILES_SQL = rf"""{JOB_CHUNKS_SQL}, {SHIFT_SQL}, {PARTS_SQL},
good AS (SELECT job_id, chunk_no, row_number() OVER (PARTITION BY job_id, chunk_no ORDER BY run_no) AS run_no, text FROM runs WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 50 AND contains(text, ':')),
run_lines AS (SELECT job_id, chunk_no, run_no, i, l[i] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT job_id, chunk_no, run_no, string_split(text, chr(10)) AS l FROM good))),
files AS (SELECT 'run' AS kind, job_id, chunk_no, run_no, string_agg(line, chr(10) ORDER BY i) AS text FROM run_lines GROUP BY ALL
  UNION ALL SELECT 'chunk', job_id, chunk_no, -1, string_agg(line, chr(10) ORDER BY i) FROM (SELECT job_id, chunk_no, i, l[i] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT job_id, chunk_no, string_split(text, chr(10)) AS l FROM job_chunks))) GROUP BY job_id, chunk_no
  UNION ALL SELECT 'combined', job_id, -1, -1, string_agg(part, chr(10) ORDER BY chunk_no) FROM p GROUP BY job_id)"""


@query(rf"WITH {FILES_SQL} SELECT kind, job_id, chunk_no, run_no, len(string_split(text, chr(10))) AS n_lines, sha256(text) AS text_sha256 FROM files")
def transcript_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all jobs, written as text and read back: one for each valid run, each chunk, and each job's whole document."""
    folder = new_folder(spark, "transcripts")
    checked = validate.validate(derived.runs(spark, sf_dir)).where("ok")
    number = F.row_number().over(Window.partitionBy("job_id", "chunk_no").orderBy("run_no"))
    chunks = chunks_of_jobs(spark, sf_dir)
    whole = assemble.parts(chunks.withColumn("voice_line", F.lit(None).cast("string"))).select("job_id", "chunk_no", F.col("part").alias("text"))
    kinds = {
        "run": (checked.select("job_id", "chunk_no", number.alias("run_no"), "text"), ("job_id", "chunk_no", "run_no"), ("line_no",)),
        "chunk": (chunks.select("job_id", "chunk_no", "text"), ("job_id", "chunk_no"), ("line_no",)),
        "combined": (whole, ("job_id",), ("chunk_no", "line_no")),
    }
    read = []
    for kind, (texts, by, order) in kinds.items():
        tables.write_transcripts(tables.numbered_lines(texts), f"{folder}/{kind}", by, order)
        file = tables.read_transcripts(spark, f"{folder}/{kind}", by)
        column = lambda c, by=by: (F.col(c) if c in by else F.lit(-1)).cast("long").alias(c)
        read.append(file.select(F.lit(kind).alias("kind"), *map(column, ("job_id", "chunk_no", "run_no")), F.size(F.split("text", "\n", -1)).alias("n_lines"), F.sha2("text", 256).alias("text_sha256")))
    return read[0].unionByName(read[1]).unionByName(read[2])


@query(f"WITH {JOB_CHUNKS_SQL} SELECT job_id, count(*) AS n_chunks, count(*) FILTER (starts_with(text, '[')) AS n_failed FROM job_chunks GROUP BY job_id")
def summary_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of each job, written as JSON and read back."""
    folder = new_folder(spark, "summaries")
    rows = assemble.assemble(chunks_of_jobs(spark, sf_dir).withColumn("voice_line", F.lit(None).cast("string"))).drop("document")
    tables.write_summaries(rows, folder)
    return tables.read_summaries(spark, folder, rows.schema)


@query("WITH s AS (SELECT user_id AS stream_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id NULLS LAST, value NULLS LAST) - 1) AS idx, value / 100 AS x FROM events WHERE user_id IS NOT NULL), h AS (SELECT stream_id, idx // 4 AS frame_idx, sum(x * x) AS e FROM s GROUP BY ALL HAVING count(*) = 4) SELECT a.stream_id, a.frame_idx, round(a.e + b.e, 6) AS energy FROM h a JOIN h b ON b.stream_id = a.stream_id AND b.frame_idx = a.frame_idx + 1")
def frame_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = derived.frames(spark, sf_dir).select("stream_id", F.col("frame_idx").cast("long").alias("idx"), (F.col("energy") / 100).alias("x"))
    return rounded(signal.frame_energy(samples, 4), "energy")
