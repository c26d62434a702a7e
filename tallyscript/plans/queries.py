"""Named queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscript.functions import similarity as sim
from tallyscript.functions import text as tx
from tallyscript.operators import align, assemble, chunking, consensus, cost, jobs, parsing, signal, validate
from tallyscript.plans.voice import VOICE_SQL, runs_voice
from tallyscript.sources import derived
from tallyscript.sources.derived import CALLS_SQL, FRAMES_SQL, JOBS_SQL, RUNS_SQL, STREAMS_SQL
from tallyscript.sources.shared import new_folder, written
from tallyscript.sources.tables import event_lines, table
from tallyscript.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

KEYS = ["job_id", "chunk_no", "run_no"]
CHUNK = ["job_id", "chunk_no"]
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles at six places, as sums of other orders differ beyond."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def lines_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_v04(derived.runs(spark, sf_dir))


# Parsing and normal forms


@query(f"WITH {RUNS_SQL} SELECT job_id, chunk_no, run_no, line_no, ts, sec, speaker, content FROM timed")
def parse_lines_v04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of_runs(spark, sf_dir)


@query(rf"""WITH bracketed AS (SELECT doc_id, i - 1 AS line_no, printf('%02d:%02d', doc_id // 60 % 60, doc_id % 60) || ' ' || lang || ': ' || regexp_replace(l[i], '(\w+) (\w+)', '\1 [\2]') AS line FROM (SELECT doc_id, lang, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))),
p AS (SELECT doc_id, line_no, regexp_extract(line, '^(\d{{1,2}}:\d{{2}})\s+([^:]+):\s*(.*)$', 1) AS ts, regexp_extract(line, '^(\d{{1,2}}:\d{{2}})\s+([^:]+):\s*(.*)$', 2) AS speaker, regexp_extract(line, '^(\d{{1,2}}:\d{{2}})\s+([^:]+):\s*(.*)$', 3) AS c FROM bracketed)
SELECT doc_id, line_no::INT AS line_no, ts, string_split(ts, ':')[1]::INT * 60 + string_split(ts, ':')[2]::INT AS sec, {STRIP.format("speaker")} AS speaker, {STRIP.format("regexp_replace(" + STRIP.format("c") + r", '\[([^\]]+)\]', '', 'g')")} AS content, array_to_string(regexp_extract_all(c, '\[([^\]]+)\]', 1), ' ') AS visual FROM p WHERE ts <> ''""")
def parse_lines_v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    head = F.concat(tx.seconds_clock(F.col("doc_id") % 3600), F.lit(" "), F.col("lang"), F.lit(": "))
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.col("head"), F.regexp_replace(x, r"^(.*?)(\w+) (\w+)", "$1$2 [$3]")))
    return parsing.parse_v03(docs.withColumn("head", head).select("doc_id", F.array_join(lines, "\n").alias("text")), ("doc_id",))


@query("SELECT event_id, printf('%02d:%02d', event_id // 60, event_id % 60) AS clock, event_id::DOUBLE AS seconds FROM events")
def clock_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = tx.seconds_clock(F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", clock.alias("clock"), tx.clock_seconds(clock).alias("seconds"))


SPEAKER_SQL = "CASE WHEN s IN ('anna', 'ava', 'adult female', 'teacher') THEN 'teacher' WHEN s IN ('a06', 'student 1', 'boy student', 'student boy') THEN 'student_a06' WHEN s IN ('a04', 'student 2', 'girl student', 'student girl') THEN 'student_a04' WHEN s IN ('bs', 'background student', 'other student') THEN 'background_student' ELSE replace(s, ' ', '_') END"


@query(f"WITH s AS (SELECT c_custkey, lower(trim(CASE c_custkey % 6 WHEN 0 THEN ' Teacher ' WHEN 1 THEN 'Student 1' WHEN 2 THEN 'GIRL STUDENT' WHEN 3 THEN 'BS' ELSE c_mktsegment || ' Voice' END)) AS s FROM customer) SELECT c_custkey, {SPEAKER_SQL} AS speaker FROM s")
def speaker_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    said = F.when(k == 0, " Teacher ").when(k == 1, "Student 1").when(k == 2, "GIRL STUDENT").when(k == 3, "BS").otherwise(F.concat("c_mktsegment", F.lit(" Voice")))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.speaker_name(said).alias("speaker"))


@query(r"SELECT conv_id, turn, replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[.,!?;:]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '''s', 's'), '''ll', 'll'), '''re', 're') AS plain FROM conversations")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.plain_words(F.col("text")).alias("plain"))


# Similarity


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn beside the one with the next number in its conversation."""
    t = table(spark, sf_dir, "conversations")
    following = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return t.select("conv_id", "turn", F.col("text").alias("a")).join(following, ["conv_id", "turn"])


NEIGHBOURS_SQL = "pair AS (SELECT x.conv_id, x.turn, x.text AS a, y.text AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"
WORDS_SQL = r"list_distinct(list_filter(string_split_regex({}, '\s+'), lambda w: w <> ''))"
OVERLAP_SQL = "CASE WHEN len(wa) = 0 AND len(wb) = 0 THEN 1.0::DOUBLE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 ELSE len(list_intersect(wa, wb)) / (len(wa) + len(wb) - len(list_intersect(wa, wb))) END"
PLAIN_SQL = r"replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({}, '\[([^\]]+)\]', '', 'g'), '^\s+|\s+$', '', 'g')), '[.,!?;:]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '''s', 's'), '''ll', 'll'), '''re', 're')"
J3_SQL = f"plain AS (SELECT *, {PLAIN_SQL.format('a')} AS pa, {PLAIN_SQL.format('b')} AS pb FROM pair), worded AS (SELECT *, {WORDS_SQL.format('pa')} AS wa, {WORDS_SQL.format('pb')} AS wb FROM plain), scored AS (SELECT *, {OVERLAP_SQL} AS o FROM worded), j3 AS (SELECT *, CASE WHEN a = '' AND b = '' THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 WHEN pa = pb THEN 1.0 WHEN len(wa) <= 3 AND len(wb) <= 3 THEN least(o * 1.2::DOUBLE, 1.0) ELSE o END AS similarity FROM scored)"


@query(f"WITH {NEIGHBOURS_SQL}, w AS (SELECT conv_id, turn, {WORDS_SQL.format('lower(a)')} AS wa, {WORDS_SQL.format('lower(b)')} AS wb FROM pair) SELECT conv_id, turn, round({OVERLAP_SQL}, 6) AS similarity FROM w")
def jaccard_v04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours(spark, sf_dir).select("conv_id", "turn", sim.jaccard_v04(F.col("a"), F.col("b")).alias("similarity")), "similarity")


@query(f"WITH {NEIGHBOURS_SQL}, {J3_SQL} SELECT conv_id, turn, round(similarity, 6) AS similarity FROM j3")
def jaccard_v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours(spark, sf_dir).select("conv_id", "turn", sim.jaccard_v03(F.col("a"), F.col("b")).alias("similarity")), "similarity")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("va")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("vb")), "vec_id")


VECTORS_SQL = "v AS (SELECT x.vec_id, x.embedding::DOUBLE[] AS va, y.embedding::DOUBLE[] AS vb FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1), c AS (SELECT vec_id, (list_cosine_similarity(va, vb) + 1) / 2 AS score FROM v)"


@query(f"WITH {VECTORS_SQL} SELECT vec_id, round(score, 6) AS score FROM c")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vectors(spark, sf_dir).select("vec_id", sim.embedding_similarity(F.col("va"), F.col("vb")).alias("score")), "score")


BOOST_SQL = r"least(CASE WHEN (na + nb) / 2 <= 3 THEN score * 1.3::DOUBLE WHEN (na + nb) / 2 <= 5 THEN score * 1.1::DOUBLE ELSE score END, 1.0)"


@query(rf"WITH p AS (SELECT p_partkey, p_size / 60 AS score, len(list_filter(string_split_regex(p_name, '\s+'), lambda w: w <> '')) AS na, len(list_filter(string_split_regex(p_name || ' ' || repeat(p_type || ' ', p_size % 7), '\s+'), lambda w: w <> '')) AS nb FROM part) SELECT p_partkey, round({BOOST_SQL}, 6) AS score FROM p")
def short_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.concat("p_name", F.lit(" "), F.expr("repeat(p_type || ' ', p_size % 7)"))
    return rounded(table(spark, sf_dir, "part").select("p_partkey", sim.short_boost(F.col("p_size") / 60, F.col("p_name"), other).alias("score")), "score")


@query(
    rf"WITH {NEIGHBOURS_SQL}, {J3_SQL}, {VECTORS_SQL}, n AS (SELECT conv_id, turn, similarity, CASE WHEN turn % 2 = 0 THEN score END AS score, len(list_filter(string_split_regex(a, '\s+'), lambda w: w <> '')) AS na, len(list_filter(string_split_regex(b, '\s+'), lambda w: w <> '')) AS nb FROM j3 LEFT JOIN c ON c.vec_id = conv_id) SELECT conv_id, turn, round(coalesce(CASE WHEN score IS NOT NULL THEN {BOOST_SQL} END, similarity), 6) AS similarity FROM n"
)
def hybrid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("conv_id"), sim.embedding_similarity(F.col("va"), F.col("vb")).alias("score"))
    rows = neighbours(spark, sf_dir).join(v, "conv_id", "left").withColumn("score", F.when(F.col("turn") % 2 == 0, F.col("score")))
    return rounded(rows.select("conv_id", "turn", sim.hybrid(F.col("score"), F.col("a"), F.col("b")).alias("similarity")), "similarity")


# Validation and repetition


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcripts: every line with a speaker, but for those of every fifth document."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.when(F.col("doc_id") % 5 == 0, x).otherwise(F.concat(F.col("lang"), F.lit(": "), x)))
    marked = F.when(F.col("doc_id") % 50 == 3, F.concat(F.lit("transcription FAILED: "), F.array_join(lines, "\n"))).otherwise(F.array_join(lines, "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", marked.alias("text"))


DOCS_SQL = r"""doc_texts AS (SELECT doc_id, CASE WHEN doc_id % 50 = 3 THEN 'transcription FAILED: ' ELSE '' END || array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN doc_id % 5 = 0 THEN x ELSE lang || ': ' || x END), chr(10)) AS text FROM documents),
doc_lines AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS l FROM doc_texts))),
contents AS (SELECT doc_id, CASE WHEN contains(line, ':') THEN regexp_replace(substr(line, instr(line, ':') + 1), '^\s+|\s+$', '', 'g') END AS content, count(*) AS n FROM doc_lines GROUP BY ALL),
repeated AS (SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (content IS NOT NULL), 0)::BIGINT AS n_contents, coalesce(max(n) FILTER (content IS NOT NULL), 0)::BIGINT AS most FROM contents GROUP BY doc_id),
loops AS (SELECT *, n_lines >= 10 AND n_contents >= 5 AND most > n_contents * 0.3::DOUBLE AS excessive FROM repeated)"""


@query(f"WITH {DOCS_SQL} SELECT doc_id, n_lines, n_contents, most, excessive FROM loops")
def repetition_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.repetition(doc_texts(spark, sf_dir), ("doc_id",))


REASON_SQL = r"""CASE WHEN length(text) = 0 THEN 'Empty or invalid transcript' WHEN regexp_matches(t, '(?i)\[ERROR:') THEN 'Error marker detected: \[ERROR:' WHEN regexp_matches(t, '(?i)\[PARTIAL:.*Generation stopped') THEN 'Error marker detected: \[PARTIAL:.*Generation stopped' WHEN regexp_matches(t, '(?i)Transcription failed') THEN 'Error marker detected: Transcription failed' WHEN regexp_matches(t, '(?i)No response candidates') THEN 'Error marker detected: No response candidates' WHEN regexp_matches(t, '(?i)Invalid response') THEN 'Error marker detected: Invalid response' WHEN regexp_matches(t, '(?i)No content parts') THEN 'Error marker detected: No content parts' WHEN length(t) < 50 THEN 'Transcript too short: ' || length(t) || ' chars (min: 50)' WHEN NOT contains(t, ':') THEN 'No valid transcript lines with timestamps/speakers found' WHEN excessive THEN 'Excessive repetition detected (likely AI generation loop)' ELSE 'Valid transcript' END"""


@query(rf"WITH {DOCS_SQL}, c AS (SELECT d.doc_id, d.text, regexp_replace(d.text, '^\s+|\s+$', '', 'g') AS t, excessive FROM doc_texts d LEFT JOIN loops USING (doc_id)), r AS (SELECT doc_id, {REASON_SQL} AS reason FROM c) SELECT doc_id, reason = 'Valid transcript' AS ok, reason FROM r")
def validate_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(doc_texts(spark, sf_dir), ("doc_id",)).drop("text")


@query(
    r"""WITH """
    + DOCS_SQL
    + r""", raw AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM doc_texts))),
n AS (SELECT *, regexp_replace(substr(line, instr(line, ':') + 1), '^\s+|\s+$', '', 'g') AS content, contains(line, ':') AS has FROM raw),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, has, CASE WHEN has THEN content END ORDER BY line_no) AS k FROM n)
SELECT doc_id, line_no::INT AS line_no, CASE WHEN has AND k = 4 THEN substr(line, 1, instr(line, ':')) || ' [continues repeating: ''' || content || ''']' ELSE line END AS line FROM k WHERE NOT has OR k <= 4"""
)
def repetition_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.suppress_repeats(doc_texts(spark, sf_dir), ("doc_id",))


@query(
    rf"""WITH {RUNS_SQL}, c AS (SELECT job_id, chunk_no, run_no, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM runs), k AS (SELECT job_id, chunk_no, run_no, length(t) >= 50 AND contains(t, ':') AS ok FROM c), a AS (SELECT job_id, chunk_no, count(*) AS n_runs, count(*) FILTER (ok) AS n_valid FROM k GROUP BY ALL)
SELECT job_id, chunk_no, n_runs, n_valid, n_valid / n_runs AS success_rate, CASE n_valid WHEN 0 THEN 'failed' WHEN 1 THEN 'single' ELSE 'consensus' END AS mode FROM a"""
)
def admit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.admit(validate.validate(derived.runs(spark, sf_dir)))


# Alignment and consensus

BASE_V04_SQL = r"""score AS (SELECT job_id, chunk_no, run_no, 100 * count(*) FILTER (regexp_matches(line, '^\d{1,2}:\d{2}\s+\w+:')) / count(*) AS base_score FROM raw_lines GROUP BY ALL),
best AS (SELECT job_id, chunk_no, arg_max(run_no, (base_score, -run_no)) AS base_run FROM score GROUP BY ALL)"""
MATCH_SQL = """base AS (SELECT l.* FROM timed l JOIN {best} b ON l.job_id = b.job_id AND l.chunk_no = b.chunk_no AND l.run_no = b.base_run),
met AS (SELECT b.job_id, b.chunk_no, b.run_no AS base_run, b.line_no, o.run_no, o.line_no AS other_line_no, abs(b.sec - o.sec)::DOUBLE AS distance, b.speaker, b.content, o.speaker AS other_speaker, o.content AS other_content,
  row_number() OVER (PARTITION BY b.job_id, b.chunk_no, b.line_no, o.run_no ORDER BY abs(b.sec - o.sec), o.line_no) AS k FROM base b JOIN timed o ON b.job_id = o.job_id AND b.chunk_no = o.chunk_no AND abs(b.sec - o.sec) <= 5),
near AS (SELECT * EXCLUDE (k) FROM met WHERE k = 1)"""
#: The sum of a line's matches in order of runs, as sums of doubles depend on the order.
IN_ORDER = "list_reduce(list({} ORDER BY a.run_no) FILTER (a.run_no IS NOT NULL), lambda x, y: x + y)"
V04_SQL = f"""{RUNS_SQL}, {BASE_V04_SQL}, {MATCH_SQL.format(best="best")},
w4 AS (SELECT *, {WORDS_SQL.format("lower(content)")} AS wa, {WORDS_SQL.format("lower(other_content)")} AS wb FROM near),
aligned AS (SELECT * EXCLUDE (wa, wb), (lower(speaker) = lower(other_speaker))::INT AS same_speaker, {OVERLAP_SQL} AS similarity FROM w4),
conf AS (SELECT b.job_id, b.chunk_no, b.line_no, b.ts, b.sec, b.speaker, b.content, coalesce({IN_ORDER.format('same_speaker::DOUBLE')} / count(a.run_no), 1.0) AS speaker_raw, coalesce({IN_ORDER.format('similarity')} / count(a.run_no), 1.0) AS content_raw, count(a.run_no) AS n_matched
  FROM base b LEFT JOIN aligned a ON a.job_id = b.job_id AND a.chunk_no = b.chunk_no AND a.line_no = b.line_no GROUP BY ALL)"""
FLAG_SQL = """boosted AS (SELECT conf.* EXCLUDE (speaker_raw, content_raw), speaker_raw, content_raw, {vad} AS vad, least(1.0, speaker_raw + {vad} * 0.3::DOUBLE * 0.5) AS speaker_conf, least(1.0, content_raw + {vad} * 0.3::DOUBLE) AS content_conf FROM {rows}),
pct AS (SELECT *, trunc(speaker_conf * 100)::INT AS speaker_pct, trunc(content_conf * 100)::INT AS content_pct FROM boosted),
flagged AS (SELECT *, speaker_pct < 70 OR content_pct < 85 AS review_needed, CASE WHEN speaker_pct < 70 OR content_pct < 85 THEN '[verify: ' || concat_ws(' ', CASE WHEN speaker_pct < 70 THEN 'spkr:' || speaker_pct END, CASE WHEN content_pct < 85 THEN 'text:' || content_pct END) || ']' ELSE '' END AS reason FROM pct)"""
PLAIN_FLAG_SQL = FLAG_SQL.format(vad="0.5::DOUBLE", rows="conf")
VOICE_FLAG_SQL = FLAG_SQL.format(vad="coalesce(voice.vad, 0.5)", rows="conf LEFT JOIN voice ON voice.job_id = conf.job_id AND voice.chunk_no = conf.chunk_no AND voice.sec = conf.sec")


@query(f"WITH {RUNS_SQL}, {BASE_V04_SQL} SELECT job_id, chunk_no, run_no, round(base_score, 6) AS base_score FROM score")
def score_v04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(consensus.score_v04(derived.runs(spark, sf_dir)), "base_score")


@query(f"WITH {RUNS_SQL}, {BASE_V04_SQL} SELECT b.job_id, b.chunk_no, base_run, round(base_score, 6) AS score FROM best b JOIN score s ON s.job_id = b.job_id AND s.chunk_no = b.chunk_no AND s.run_no = base_run")
def baseline_v04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(consensus.baseline_v04(derived.runs(spark, sf_dir)), "score")


@query(f"WITH {RUNS_SQL}, {BASE_V04_SQL}, {MATCH_SQL.format(best='best')} SELECT job_id, chunk_no, base_run, line_no, run_no, other_line_no, distance FROM near")
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derived.runs(spark, sf_dir)
    lines = parsing.parse_v04(runs)
    matched = align.nearest(consensus.baseline_lines(lines, consensus.baseline_v04(runs)), lines)
    return matched.select("job_id", "chunk_no", "base_run", "line_no", "run_no", "other_line_no", F.col("distance").cast("double").alias("distance"))


J3_PAIRS_SQL = f"""plain AS (SELECT *, {PLAIN_SQL.format("a")} AS pa, {PLAIN_SQL.format("b")} AS pb FROM pair), worded AS (SELECT *, {WORDS_SQL.format("pa")} AS wa, {WORDS_SQL.format("pb")} AS wb FROM plain), scored AS (SELECT *, {OVERLAP_SQL} AS o FROM worded),
aligned AS (SELECT * EXCLUDE (pa, pb, wa, wb, o), CASE WHEN a = '' AND b = '' THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 WHEN pa = pb THEN 1.0 WHEN len(wa) <= 3 AND len(wb) <= 3 THEN least(o * 1.2::DOUBLE, 1.0) ELSE o END AS similarity FROM scored)"""
NAMES_SQL = f"named AS (SELECT near.*, content AS a, other_content AS b FROM near), pair AS (SELECT n.*, (({SPEAKER_SQL.replace('s IN', 'lower(trim(speaker)) IN').replace('replace(s,', 'replace(lower(trim(speaker)),')}) = ({SPEAKER_SQL.replace('s IN', 'lower(trim(other_speaker)) IN').replace('replace(s,', 'replace(lower(trim(other_speaker)),')}))::INT AS same_speaker FROM named n)"
AGREE_SQL = f"""every AS (SELECT b.job_id, b.chunk_no, b.run_no AS base_run, b.line_no, o.run_no, b.speaker, o.speaker AS other_speaker, b.content AS a, o.content AS b, row_number() OVER (PARTITION BY b.job_id, b.chunk_no, b.run_no, b.line_no, o.run_no ORDER BY abs(b.sec - o.sec), o.line_no) AS k
  FROM timed b JOIN timed o ON b.job_id = o.job_id AND b.chunk_no = o.chunk_no AND abs(b.sec - o.sec) <= 5),
pair AS (SELECT e.*, (speaker = other_speaker)::INT AS same_speaker FROM every e JOIN runs r1 ON r1.job_id = e.job_id AND r1.chunk_no = e.chunk_no AND r1.run_no = e.base_run JOIN runs r2 ON r2.job_id = e.job_id AND r2.chunk_no = e.chunk_no AND r2.run_no = e.run_no WHERE k = 1 AND r1.text <> r2.text),
{J3_PAIRS_SQL},
line_sums AS (SELECT job_id, chunk_no, base_run, line_no, count(*) AS n, list_reduce(list(same_speaker * 0.6::DOUBLE + similarity * 0.4::DOUBLE ORDER BY run_no), lambda x, y: x + y) AS total FROM aligned GROUP BY job_id, chunk_no, base_run, line_no),
means AS (SELECT job_id, chunk_no, base_run AS run_no, list_reduce(list(total ORDER BY line_no), lambda x, y: x + y) / sum(n) AS mean FROM line_sums GROUP BY job_id, chunk_no, base_run),
agreement AS (SELECT r.job_id, r.chunk_no, r.run_no, CASE WHEN count(*) OVER (PARTITION BY r.job_id, r.chunk_no) <= 1 THEN 30.0 WHEN p.n IS NULL THEN 0.0 ELSE coalesce(30 * mean, 15.0) END AS agreement
  FROM runs r LEFT JOIN (SELECT job_id, chunk_no, run_no, count(*) AS n FROM timed GROUP BY ALL) p USING (job_id, chunk_no, run_no) LEFT JOIN means USING (job_id, chunk_no, run_no))"""
SCORE_V03_SQL = r"""parsed AS (SELECT job_id, chunk_no, run_no, count(*) AS n_parsed, count(DISTINCT speaker) AS n_speakers, count(*) FILTER (trim(content) <> '') AS n_content FROM timed GROUP BY ALL),
texts AS (SELECT r.job_id, r.chunk_no, r.run_no, (SELECT count(*) FROM raw_lines x WHERE x.job_id = r.job_id AND x.chunk_no = r.chunk_no AND x.run_no = r.run_no) AS n_lines, len(regexp_extract_all(text, '\S+')) AS n_words, len(regexp_extract_all(text, '\[([^\]]+)\]')) AS n_visual, len(regexp_extract_all(text, '\[unclear\]|\[inaudible\]|\[uncertain\]')) AS n_unclear FROM runs r),
parts AS (SELECT t.job_id, t.chunk_no, t.run_no, 20 * (coalesce(n_parsed, 0) / n_lines * 0.5::DOUBLE + CASE WHEN n_parsed > 0 THEN 0.5::DOUBLE ELSE 0 END) AS parse_score, 20 * (1 - least(n_unclear / n_lines, 0.5::DOUBLE)) * least(coalesce(n_speakers, 0) / greatest(coalesce(n_parsed, 0) / 10, 1.0), 1.0) AS format_score,
  CASE WHEN n_words = 0 THEN 0.0 ELSE 30 * (least(n_words / 1000, 1.0) * 0.4::DOUBLE + least(n_visual / 20, 1.0) * 0.3::DOUBLE + coalesce(n_content, 0) / n_lines * 0.3::DOUBLE) END AS richness FROM texts t LEFT JOIN parsed USING (job_id, chunk_no, run_no)),
score3 AS (SELECT *, least(parse_score + format_score + richness + agreement, 100.0) AS score FROM parts JOIN agreement USING (job_id, chunk_no, run_no)),
best3 AS (SELECT job_id, chunk_no, arg_max(run_no, (score, -run_no)) AS base_run, max(score) AS score FROM score3 GROUP BY ALL)"""


def lines_v03(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs and their lines."""
    runs = derived.runs(spark, sf_dir)
    return runs, parsing.parse_v03(runs)


@query(f"WITH {RUNS_SQL}, {AGREE_SQL} SELECT job_id, chunk_no, run_no, round(agreement, 6) AS agreement FROM agreement")
def agreement_v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(consensus.score_v03(*lines_v03(spark, sf_dir)).select(*KEYS, "agreement"), "agreement")


@query(f"WITH {RUNS_SQL}, {AGREE_SQL}, {SCORE_V03_SQL} SELECT job_id, chunk_no, run_no, round(parse_score, 6) AS parse_score, round(format_score, 6) AS format_score, round(richness, 6) AS richness, round(agreement, 6) AS agreement, round(score, 6) AS score FROM score3")
def score_v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(consensus.score_v03(*lines_v03(spark, sf_dir)), "parse_score", "format_score", "richness", "agreement", "score")


@query(f"WITH {RUNS_SQL}, {AGREE_SQL}, {SCORE_V03_SQL} SELECT job_id, chunk_no, base_run, round(score, 6) AS score FROM best3")
def baseline_v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(consensus.baseline_v03(*lines_v03(spark, sf_dir)), "score")


ALIGN_V03_SQL = f"{MATCH_SQL.format(best='best')}, {NAMES_SQL}, {J3_PAIRS_SQL}"


@query(f"WITH {RUNS_SQL}, {BASE_V04_SQL}, {ALIGN_V03_SQL} SELECT job_id, chunk_no, line_no, run_no, same_speaker, round(similarity, 6) AS similarity FROM aligned")
def align_v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, lines = lines_v03(spark, sf_dir)
    return rounded(align.align_v03(consensus.baseline_lines(lines, consensus.baseline_v04(runs)), lines).select(*CHUNK, "line_no", "run_no", "same_speaker", "similarity"), "similarity")


@query(f"WITH {V04_SQL} SELECT job_id, chunk_no, line_no, ts, round(speaker_raw, 6) AS speaker_raw, round(content_raw, 6) AS content_raw, n_matched FROM conf")
def line_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derived.runs(spark, sf_dir)
    lines = parsing.parse_v04(runs)
    base = consensus.baseline_lines(lines, consensus.baseline_v04(runs))
    return rounded(consensus.line_confidence(base, align.align_v04(base, lines)).select(*CHUNK, "line_no", "ts", "speaker_raw", "content_raw", "n_matched"), "speaker_raw", "content_raw")


FLAGGED = ["job_id", "chunk_no", "line_no", "speaker_pct", "content_pct", "review_needed", "reason", "text"]
FLAGGED_SQL = "job_id, chunk_no, line_no, speaker_pct, content_pct, review_needed, reason, ts || ' ' || speaker || ': ' || content || CASE WHEN reason <> '' THEN ' ' || reason ELSE '' END AS text"


def flagged_v04(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derived.runs(spark, sf_dir)
    return consensus.consensus_v04(runs, parsing.parse_v04(runs))


def flagged_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = derived.runs(spark, sf_dir)
    return consensus.consensus_v04(runs, parsing.parse_v04(runs), consensus.voice_stretches(runs_voice(runs)))


@query(f"WITH {V04_SQL}, {PLAIN_FLAG_SQL} SELECT {FLAGGED_SQL} FROM flagged")
def consensus_v04_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged_v04(spark, sf_dir).select(*FLAGGED)


@query(f"WITH {V04_SQL}, {VOICE_SQL}, {VOICE_FLAG_SQL} SELECT {FLAGGED_SQL}, vad FROM flagged")
def consensus_v04_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged_voice(spark, sf_dir).select(*FLAGGED, "vad")


@query(f"WITH {V04_SQL}, {VOICE_SQL}, {VOICE_FLAG_SQL} SELECT job_id, chunk_no, count(*) FILTER (speaker_conf > speaker_raw) AS improved_lines, count(*) FILTER (vad > 0.6) AS high_vad_lines, round(avg(vad), 6) AS avg_vad, round(sum(CASE WHEN speaker_conf > speaker_raw THEN speaker_conf - speaker_raw ELSE 0 END), 6) AS total_boost FROM flagged GROUP BY ALL")
def boost_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(consensus.boost_impact(flagged_voice(spark, sf_dir)), "avg_vad", "total_boost")


@query(f"WITH {V04_SQL}, {PLAIN_FLAG_SQL} SELECT job_id, chunk_no, count(*) AS total_lines, count(*) FILTER (NOT review_needed) AS auto_accept, count(*) FILTER (review_needed) AS manual_review, round(avg(speaker_conf), 6) AS speaker, round(avg(content_conf), 6) AS content, round(avg(vad), 6) AS vad, round(count(*) FILTER (NOT review_needed) / count(*), 6) AS auto_accept_rate FROM flagged GROUP BY ALL")
def quality_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(consensus.quality_v04(flagged_v04(spark, sf_dir)), "speaker", "content", "vad", "auto_accept_rate")


V03_SQL = f"""{RUNS_SQL}, {AGREE_SQL.replace("pair AS", "pair0 AS").replace("FROM pair)", "FROM pair0)").replace("plain AS", "plain0 AS").replace("FROM plain)", "FROM plain0)").replace("worded AS", "worded0 AS").replace("FROM worded)", "FROM worded0)").replace("scored AS", "scored0 AS").replace("FROM scored)", "FROM scored0)").replace("aligned AS", "aligned0 AS").replace("FROM aligned GROUP", "FROM aligned0 GROUP")}, {SCORE_V03_SQL}, {MATCH_SQL.format(best="best3")}, {NAMES_SQL}, {J3_PAIRS_SQL},
conf AS (SELECT b.job_id, b.chunk_no, b.line_no, b.ts, b.speaker, b.content, coalesce({IN_ORDER.format('same_speaker::DOUBLE')} / count(a.run_no), 1.0) AS speaker_raw, coalesce({IN_ORDER.format('similarity')} / count(a.run_no), 1.0) AS content_raw FROM base b LEFT JOIN aligned a ON a.job_id = b.job_id AND a.chunk_no = b.chunk_no AND a.line_no = b.line_no GROUP BY ALL),
judged AS (SELECT *, CASE WHEN speaker_raw >= 0.6 AND content_raw >= 0.7 THEN 'accept' WHEN speaker_raw >= 0.4 AND content_raw >= 0.5 THEN 'review' ELSE 'critical' END AS quality FROM conf)"""


@query(f"WITH {V03_SQL} SELECT job_id, chunk_no, line_no, ts, speaker, round(speaker_raw, 6) AS speaker_raw, round(content_raw, 6) AS content_raw, quality, quality <> 'accept' AS review_needed FROM judged")
def consensus_v03_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = consensus.consensus_v03(*lines_v03(spark, sf_dir))
    return rounded(rows.select(*CHUNK, "line_no", "ts", "speaker", "speaker_raw", "content_raw", "quality", "review_needed"), "speaker_raw", "content_raw")


@query(f"WITH {V03_SQL} SELECT job_id, chunk_no, count(*) AS total_lines, count(*) FILTER (quality = 'accept') AS auto_accept, count(*) FILTER (quality = 'review') AS manual_review, count(*) FILTER (quality = 'critical') AS critical_review, round(avg(speaker_raw), 6) AS speaker, round(avg(content_raw), 6) AS content, round(count(*) FILTER (quality = 'accept') / count(*), 6) AS auto_accept_rate, count(*) FILTER (quality = 'accept') / count(*) >= 0.8 AS research_ready, count(*) FILTER (quality <> 'accept') AS lines_needing_review FROM judged GROUP BY ALL")
def quality_distribution_v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(consensus.quality_v03(consensus.consensus_v03(*lines_v03(spark, sf_dir))), "speaker", "content", "auto_accept_rate")


# Voice activity and chunks


@query(f"WITH {CALLS_SQL}, v AS (SELECT stream_id, count(*) AS n, avg(confidence) AS c, sum(duration) / max(s.duration_s) AS r FROM segments JOIN streams s USING (stream_id) GROUP BY stream_id) SELECT stream_id, round(CASE WHEN stream_id % 7 = 0 THEN 0 ELSE least(CASE WHEN r BETWEEN 0.3 AND 0.8 THEN 3 WHEN r > 0.1 THEN 1 ELSE 0 END + c * 4 + CASE WHEN n > 5 THEN 2 WHEN n > 2 THEN 1 ELSE 0 END, 10) END, 6) AS bonus FROM v")
def vad_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, streams = derived.calls(spark, sf_dir)
    means = segments.groupBy("stream_id").agg(F.avg("confidence").alias("avg_confidence"))
    info = signal.speech_stats(segments, streams).join(means, "stream_id").withColumn("fallback_mode", F.col("stream_id") % 7 == 0).withColumn("hybrid", F.lit(None).cast("boolean"))
    return rounded(consensus.voice_bonus(info).select("stream_id", "bonus"), "bonus")


@query(f"WITH {CALLS_SQL} SELECT stream_id, sec::INT AS sec, max(confidence) AS vad FROM (SELECT stream_id, confidence, unnest(range(trunc(start_s)::BIGINT, trunc(end_s)::BIGINT + 1)) AS sec FROM segments) GROUP BY ALL")
def second_confidence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.second_confidence(derived.calls(spark, sf_dir)[0], ("stream_id",))


VOICED_SQL = f"{FRAMES_SQL}, sorted AS (SELECT stream_id, list_sort(list(energy)) AS l, (count(*) - 1) * 0.3::DOUBLE AS r FROM frames WHERE energy IS NOT NULL GROUP BY stream_id), around AS (SELECT stream_id, r, l[floor(r)::BIGINT + 1] AS v1, l[ceil(r)::BIGINT + 1] AS v2 FROM sorted), limits AS (SELECT stream_id, CASE WHEN v1 = v2 THEN v1 ELSE (ceil(r) - r) * v1 + (r - floor(r)) * v2 END AS threshold FROM around), voiced AS (SELECT frames.*, threshold, (energy > threshold)::INT::DOUBLE AS voiced FROM frames JOIN limits USING (stream_id)), smooth AS (SELECT *, sum(voiced) OVER (PARTITION BY stream_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smoothed FROM voiced)"
BLEND_SQL = f"{VOICED_SQL}, n AS (SELECT stream_id, max(frame_idx) + 1 AS n FROM frames GROUP BY stream_id), asr AS (SELECT stream_id, frame_idx * 0.01::DOUBLE AS s, (frame_idx + 10) * 0.01::DOUBLE AS e FROM frames WHERE frame_idx % 25 = 0), marked AS (SELECT DISTINCT stream_id, unnest(range(trunc(s * 100)::BIGINT, least(trunc(e * 100)::BIGINT, n))) AS frame_idx FROM asr JOIN n USING (stream_id)), blend AS (SELECT s.*, CASE WHEN m.frame_idx IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS asr, smoothed * 0.7::DOUBLE + CASE WHEN m.frame_idx IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END * (1 - 0.7::DOUBLE) AS confidence FROM smooth s LEFT JOIN marked m USING (stream_id, frame_idx))"


@query(f"WITH {VOICED_SQL} SELECT stream_id, frame_idx, round(threshold, 6) AS threshold, voiced FROM voiced")
def frame_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.threshold(derived.frames(spark, sf_dir)).select("stream_id", "frame_idx", "threshold", "voiced"), "threshold")


@query(f"WITH {VOICED_SQL} SELECT stream_id, frame_idx, round(smoothed, 6) AS smoothed FROM smooth")
def frame_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.smooth(signal.threshold(derived.frames(spark, sf_dir))).select("stream_id", "frame_idx", "smoothed"), "smoothed")


def blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = derived.frames(spark, sf_dir)
    return signal.blend(signal.stamp(signal.smooth(signal.threshold(frames)), derived.asr_segments(frames), 1 / derived.HOP_S))


@query(f"WITH {BLEND_SQL} SELECT stream_id, frame_idx, asr, round(confidence, 6) AS confidence FROM blend")
def frame_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(blended(spark, sf_dir).select("stream_id", "frame_idx", "asr", "confidence"), "confidence")


SEGMENTS_SQL = f"""{BLEND_SQL}, turned AS (SELECT *, confidence > 0.6 AS on_, lag(confidence) OVER w AS before, lag(confidence > 0.6) OVER w AS on_before FROM blend WINDOW w AS (PARTITION BY stream_id ORDER BY frame_idx)),
numbered AS (SELECT *, sum((on_ <> coalesce(on_before, false))::INT) OVER (PARTITION BY stream_id ORDER BY frame_idx) AS turn FROM turned),
islands AS (SELECT stream_id, turn, min(frame_idx) AS first, max(frame_idx) + 1 AS stop, sum(floor(confidence * 1099511627776::DOUBLE + 0.5::DOUBLE)::BIGINT) AS total, count(*) AS k, arg_min(before, frame_idx) AS earlier FROM numbered WHERE on_ GROUP BY ALL),
cut AS (SELECT stream_id, first * 0.02::DOUBLE AS start_s, stop * 0.02::DOUBLE AS end_s, CASE WHEN trunc(first * 0.02::DOUBLE / 0.02::DOUBLE) < first THEN (total + (SELECT floor(b.confidence * 1099511627776::DOUBLE + 0.5::DOUBLE)::BIGINT FROM blend b WHERE b.stream_id = i.stream_id AND b.frame_idx = i.first - 1))::DOUBLE / (k + 1) ELSE total::DOUBLE / k END / 1099511627776::DOUBLE AS confidence FROM islands i),
speech AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_s) AS seg_no, start_s, end_s, end_s - start_s AS duration, confidence FROM cut WHERE end_s - start_s > 0.1::DOUBLE)"""


@query(f"WITH {SEGMENTS_SQL} SELECT stream_id, seg_no::INT AS seg_no, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(duration, 6) AS duration, round(confidence, 6) AS confidence FROM speech")
def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.segments(blended(spark, sf_dir)), "start_s", "end_s", "duration", "confidence")


@query(f"WITH {SEGMENTS_SQL}, {STREAMS_SQL} SELECT stream_id, round(duration_s, 6) AS duration_s, count(seg_no) AS num_segments, round(coalesce(sum(duration), 0), 6) AS speech_s, round(coalesce(avg(duration), 0), 6) AS mean_duration, round(coalesce(sum(duration), 0) / duration_s, 6) AS speech_ratio FROM streams LEFT JOIN speech USING (stream_id) GROUP BY stream_id, duration_s")
def speech_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = signal.speech_stats(signal.segments(blended(spark, sf_dir)), derived.streams(derived.frames(spark, sf_dir)))
    return rounded(stats, "duration_s", "speech_s", "mean_duration", "speech_ratio")


@query(f"WITH {CALLS_SQL} SELECT stream_id, (k + 1)::INT AS chunk_no, k * 120.0::DOUBLE AS start_s, least((k + 1) * 120.0::DOUBLE, duration_s) AS end_s FROM (SELECT stream_id, duration_s, unnest(range(0, ceil(duration_s / 120)::BIGINT)) AS k FROM streams)")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fixed_chunks(derived.calls(spark, sf_dir)[1], 120)


GAPS_SQL = "gaps AS (SELECT * FROM (SELECT stream_id, seg_no AS gap_no, end_s AS gap_start, lead(start_s) OVER (PARTITION BY stream_id ORDER BY seg_no) AS gap_end FROM segments) WHERE gap_end - gap_start >= 2), centred AS (SELECT *, (gap_start + gap_end) / 2 AS centre FROM gaps)"


@query(f"WITH {CALLS_SQL}, {GAPS_SQL} SELECT stream_id, gap_no, gap_start, gap_end, centre FROM centred")
def speech_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.speech_gaps(derived.calls(spark, sf_dir)[0])


CUTS_SQL = """steps AS (
  SELECT stream_id, duration_s, 0 AS boundary_no, 0.0::DOUBLE AS at_s FROM streams
  UNION ALL
  SELECT s.stream_id, s.duration_s, boundary_no + 1, coalesce((SELECT CASE WHEN arg_min(centre, (abs(centre - s.at_s - 120), gap_no)) > s.at_s + 120 * 0.7::DOUBLE THEN arg_min(centre, (abs(centre - s.at_s - 120), gap_no)) END FROM centred c WHERE c.stream_id = s.stream_id AND abs(centre - s.at_s - 120) < 30), s.at_s + 120)
  FROM steps s WHERE s.at_s + 120 < s.duration_s
), cuts AS (SELECT stream_id, boundary_no, at_s AS boundary_s FROM steps WHERE boundary_no > 0)"""
CHUNKS_SQL = f"""{CUTS_SQL}, ends AS (SELECT stream_id, boundary_no AS chunk_no, boundary_s AS end_s FROM cuts UNION ALL SELECT stream_id, coalesce((SELECT max(boundary_no) FROM cuts WHERE cuts.stream_id = streams.stream_id), 0) + 1, duration_s FROM streams),
chunks AS (SELECT * FROM (SELECT stream_id, chunk_no::INT AS chunk_no, lag(end_s, 1, 0.0) OVER (PARTITION BY stream_id ORDER BY chunk_no) AS start_s, end_s FROM ends) WHERE end_s > start_s)"""


@query(f"WITH RECURSIVE {CALLS_SQL}, {GAPS_SQL}, {CUTS_SQL} SELECT stream_id, boundary_no::INT AS boundary_no, boundary_s FROM cuts")
def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.boundaries(*derived.calls(spark, sf_dir), 120)


@query(f"WITH RECURSIVE {CALLS_SQL}, {GAPS_SQL}, {CHUNKS_SQL} SELECT stream_id, chunk_no, start_s, end_s FROM chunks")
def gap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, streams = derived.calls(spark, sf_dir)
    return chunking.gap_chunks(chunking.boundaries(segments, streams, 120), streams)


@query(f"WITH RECURSIVE {CALLS_SQL}, {GAPS_SQL}, {CHUNKS_SQL}, cutup AS (SELECT c.stream_id, chunk_no, least(c.end_s - c.start_s, s.end_s - c.start_s) - greatest(0, s.start_s - c.start_s) AS duration, confidence FROM chunks c JOIN segments s ON s.stream_id = c.stream_id AND s.end_s > c.start_s AND s.start_s < c.end_s), kept AS (SELECT * FROM cutup WHERE duration > 0.1::DOUBLE) SELECT c.stream_id, c.chunk_no, c.start_s, c.end_s, round(coalesce(sum(k.duration), 0), 6) AS speech_s, count(k.duration) AS num_segments, round(coalesce(avg(k.confidence), 0), 6) AS avg_confidence, round(coalesce(sum(k.duration), 0) / (c.end_s - c.start_s), 6) AS speech_ratio FROM chunks c LEFT JOIN kept k ON k.stream_id = c.stream_id AND k.chunk_no = c.chunk_no GROUP BY c.stream_id, c.chunk_no, c.start_s, c.end_s")
def chunk_vad_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, streams = derived.calls(spark, sf_dir)
    segments = written(segments, "segments")  # cuts, chunks and overlaps each follow from them
    chunks = written(chunking.gap_chunks(chunking.boundaries(segments, streams, 120), streams), "chunks")
    return rounded(chunking.chunk_voice(chunks, segments), "speech_s", "avg_confidence", "speech_ratio")


# Assembly


#: How failed chunks begin: in either format, in the older one only, and in the newer one only.
FAILURES = ("[CONSENSUS_FAILED] ", "[VALIDATION_FAILED] ", "[FAILED] ")


def chunks_of_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of each chunk, a job for each run; every ninth chunk failed; a chunk starts two minutes after the one before."""
    runs = derived.runs(spark, sf_dir).withColumn("job_id", F.col("job_id") * derived.RUNS + F.col("run_no"))
    mark = F.when((F.col("job_id") + F.col("chunk_no")) % 9 == 4, F.element_at(F.array(*map(F.lit, FAILURES)), (F.col("chunk_no") % 3 + 1).cast("int")))
    return runs.select("job_id", "chunk_no", ((F.col("chunk_no") - 1) * 120.0).alias("start_s"), F.concat(F.coalesce(mark, F.lit("")), "text").alias("text"))


JOB_CHUNKS_SQL = f"{RUNS_SQL}, job_chunks AS (SELECT job_id * 3 + run_no AS job_id, chunk_no, (chunk_no - 1) * 120.0::DOUBLE AS start_s, CASE WHEN (job_id * 3 + run_no + chunk_no) % 9 = 4 THEN ['[CONSENSUS_FAILED] ', '[VALIDATION_FAILED] ', '[FAILED] '][chunk_no % 3 + 1] ELSE '' END || text AS text FROM runs)"
SHIFT_SQL = r"""cl AS (SELECT job_id, chunk_no, start_s, i - 1 AS line_no, regexp_replace(l[i], '^\s+|\s+$', '', 'g') AS line FROM (SELECT job_id, chunk_no, start_s, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT job_id, chunk_no, start_s, string_split(text, chr(10)) AS l FROM job_chunks))),
shifted AS (SELECT job_id, chunk_no, line_no::INT AS line_no, CASE WHEN regexp_matches(line, '^(\d{1,2}:\d{2})\s+(\w+):\s*(.*)$') THEN printf('%02d:%02d', (start_s::BIGINT + split_part(line, ':', 1)::BIGINT * 60 + substr(split_part(line, ':', 2), 1, 2)::BIGINT) // 60, (start_s::BIGINT + split_part(line, ':', 1)::BIGINT * 60 + substr(split_part(line, ':', 2), 1, 2)::BIGINT) % 60) || ' ' || regexp_extract(line, '^(\d{1,2}:\d{2})\s+(\w+):\s*(.*)$', 2) || ': ' || regexp_extract(line, '^(\d{1,2}:\d{2})\s+(\w+):\s*(.*)$', 3) ELSE line END AS line
  FROM cl WHERE line <> '' AND NOT (starts_with(line, '===') OR starts_with(line, '---') OR starts_with(line, 'Generated:') OR starts_with(line, 'Model:')))"""


@query(f"WITH {JOB_CHUNKS_SQL}, {SHIFT_SQL} SELECT job_id, chunk_no, line_no, line FROM shifted")
def shift_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.shift_lines(chunks_of_jobs(spark, sf_dir))


@query(
    rf"""WITH {JOB_CHUNKS_SQL}, held AS (SELECT job_id, chunk_no, last_value(CASE WHEN NOT starts_with(text, '[') THEN {{'n': chunk_no, 't': text}} END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM job_chunks),
k AS (SELECT job_id, chunk_no, h.n AS context_chunk_no, list_filter(list_transform(string_split(h.t, chr(10))[-10:], lambda x: trim(x)), lambda x: contains(x, ':') AND regexp_matches(substr(x, 1, 10), '[0-9]')) AS l FROM held)
SELECT job_id, chunk_no, coalesce(context_chunk_no, -1) AS context_chunk_no, array_to_string(l[-5:], chr(10)) AS context FROM k"""
)
def carry_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.carry_context(chunks_of_jobs(spark, sf_dir)).select("job_id", "chunk_no", F.coalesce("context_chunk_no", F.lit(-1)).alias("context_chunk_no"), "context")


PARTS_SQL = r"""body AS (SELECT job_id, chunk_no, string_agg(line, chr(10) ORDER BY line_no) AS body FROM shifted GROUP BY ALL),
p AS (SELECT c.job_id, c.chunk_no, starts_with(text, '[') AS bad, '📌 CHUNK ' || c.chunk_no || printf(' (Starting at %.1f minutes)', start_s / 60) || chr(10) || '   📊 VAD: Traditional chunking mode' || chr(10) || repeat('-', 60) || chr(10) || CASE WHEN starts_with(text, '[') THEN '❌ CHUNK ' || c.chunk_no || ' FAILED:' || chr(10) || text ELSE body END || chr(10) AS part FROM job_chunks c LEFT JOIN body ON body.job_id = c.job_id AND body.chunk_no = c.chunk_no)"""


@query(rf"WITH {JOB_CHUNKS_SQL}, {SHIFT_SQL}, {PARTS_SQL} SELECT job_id, count(*) AS n_chunks, count(*) FILTER (bad) AS n_failed, string_agg(part, chr(10) ORDER BY chunk_no) AS document FROM p GROUP BY job_id")
def assemble_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.assemble(chunks_of_jobs(spark, sf_dir).withColumn("voice_line", F.lit(None).cast("string")))


@query(
    f"""WITH {JOB_CHUNKS_SQL}, v AS (SELECT *, CASE WHEN chunk_no % 4 = 0 THEN NULL ELSE chunk_no % 4 = 1 END AS fallback_mode, (chunk_no % 10) / 10 AS speech_ratio, chunk_no % 13 AS num_segments, (chunk_no % 8) / 8 AS avg_confidence FROM job_chunks), w AS (SELECT *, NOT coalesce(fallback_mode, true) AS voiced FROM v)
SELECT job_id, count(*) AS total_chunks, count(*) FILTER (voiced) AS vad_enhanced_chunks, count(*) FILTER (NOT voiced) AS traditional_chunks, coalesce(sum(num_segments) FILTER (voiced), 0)::BIGINT AS total_speech_segments, round(coalesce(avg(speech_ratio) FILTER (voiced AND speech_ratio > 0), 0), 6) AS avg_speech_ratio, round(coalesce(avg(avg_confidence) FILTER (voiced AND avg_confidence > 0), 0), 6) AS avg_vad_confidence, count(*) FILTER (NOT starts_with(text, '[')) AS successful_chunks, count(*) FILTER (starts_with(text, '[')) AS failed_chunks, round(count(*) FILTER (voiced) / count(*), 6) AS vad_enhancement_rate FROM w GROUP BY job_id"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("chunk_no")
    rows = chunks_of_jobs(spark, sf_dir).withColumns({"fallback_mode": F.when(n % 4 == 0, F.lit(None).cast("boolean")).otherwise(n % 4 == 1), "speech_ratio": n % 10 / 10, "num_segments": n % 13, "avg_confidence": n % 8 / 8})
    return rounded(assemble.run_summary(rows), "avg_speech_ratio", "avg_vad_confidence", "vad_enhancement_rate")


@query("WITH l AS (SELECT page_id, string_split(html, chr(10)) AS l FROM pages) SELECT page_id, array_to_string(l[1:100], chr(10)) AS content, len(l)::INT AS total_lines, len(l) > 100 AS truncated FROM l")
def preview_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.preview(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), ("page_id",))


# Estimates


@query(
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity AS d, CASE l_partkey % 4 WHEN 0 THEN 'gemini-2.5-pro-preview-05-06' WHEN 1 THEN 'gemini-2.0-flash-exp' WHEN 2 THEN 'gemini-2.5-flash-preview-05-20' ELSE 'unknown' END AS model, 2 + l_suppkey % 2 AS c, 1 + l_linenumber % 3 * 2 AS runs FROM lineitem),
t AS (SELECT *, d * 60 * 300 AS i, d * 60 * 300 * 0.15::DOUBLE AS o FROM v),
p AS (SELECT *, CASE l_model WHEN 0 THEN least(i, 200000) / 1000 * 0.00125::DOUBLE + greatest(i - 200000, 0) / 1000 * 0.0025::DOUBLE WHEN 1 THEN i / 1000 * 0.000075::DOUBLE ELSE 0 END AS ci, CASE l_model WHEN 0 THEN least(o, 200000) / 1000 * 0.010::DOUBLE + greatest(o - 200000, 0) / 1000 * 0.015::DOUBLE WHEN 1 THEN o / 1000 * 0.0003::DOUBLE ELSE 0 END AS co FROM (SELECT *, CASE model WHEN 'gemini-2.5-pro-preview-05-06' THEN 0 WHEN 'unknown' THEN 2 ELSE 1 END AS l_model FROM t))
SELECT l_orderkey, l_linenumber, model, trunc(i + o)::BIGINT AS total_tokens, greatest(1, trunc(d / c)::INT) AS num_chunks, round(ci, 3) AS input_cost, round(co, 3) AS output_cost, round(round(ci + co, 3) * runs, 3) AS total_cost FROM p"""
)
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 4
    model = F.when(k == 0, cost.PRICES[0][0]).when(k == 1, cost.PRICES[1][0]).when(k == 2, cost.PRICES[2][0]).otherwise("unknown")
    videos = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("duration_min"), model.alias("model"), (2 + F.col("l_suppkey") % 2).alias("chunk_min"), F.lit(1).alias("fps"), (1 + F.col("l_linenumber") % 3 * 2).alias("runs"))
    rows = cost.estimate_cost(videos, cost.prices(spark))
    return rows.select("l_orderkey", "l_linenumber", "model", "total_tokens", "num_chunks", "input_cost", "output_cost", F.round("total_cost", 3).alias("total_cost"))


@query(
    """WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS d, l_extendedprice / 100 AS mb, l_partkey % 3 AS p FROM lineitem),
q AS (SELECT *, [1, 3, 5][p + 1] AS runs, [3, 2, 2][p + 1] AS cm, [0.5, 2.0, 2.0][p + 1]::DOUBLE AS base, [0.0, 0.5, 0.5][p + 1]::DOUBLE AS more, [30, 90, 150][p + 1] AS est FROM v)
SELECT l_orderkey, l_linenumber, ['quick', 'standard', 'high'][p + 1] AS preset, coalesce(ceil(d / cm), 0)::BIGINT AS num_chunks, CASE WHEN d IS NULL THEN est ELSE floor(ceil(d / cm) * (base + 2 * runs + more) + 0.5::DOUBLE) END::BIGINT AS minutes, round(mb / 1024 * runs * 0.15::DOUBLE, 2) AS price, round(mb / 15, 1) AS guessed FROM q"""
)
def time_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    preset = F.element_at(F.array(*[F.lit(p[0]) for p in cost.PRESETS]), (F.col("l_partkey") % 3 + 1).cast("int"))
    videos = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("duration_min"), (F.col("l_extendedprice") / 100).alias("mb"), preset.alias("preset"))
    return cost.estimate_time(videos, cost.presets(spark)).select("l_orderkey", "l_linenumber", "preset", F.coalesce("num_chunks", F.lit(0)).alias("num_chunks"), "minutes", "price", cost.guess_minutes(F.col("mb")).alias("guessed"))


# Jobs, settings, prompts


@query(f"WITH {JOBS_SQL} SELECT id, status, created_at FROM jobs ORDER BY created_at DESC, id DESC LIMIT 10")
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recent(derived.jobs(spark, sf_dir).select("id", "status", "created_at"))


@query(f"WITH {JOBS_SQL} SELECT id, created_at, minutes FROM jobs WHERE status = 'failed'")
def jobs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.by_status(derived.jobs(spark, sf_dir), "failed").select("id", "created_at", "minutes")


@query(
    """WITH e AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'odd' END AS status, ts, CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error_message, CASE WHEN event_type = 'purchase' THEN 'out/' || event_id END AS output_path FROM events WHERE user_id IS NOT NULL)
SELECT id, arg_max(status, seq) AS status, min(ts) AS created_at, max(ts) FILTER (status = 'processing') AS started_at, max(ts) FILTER (status IN ('complete', 'failed', 'cancelled')) AS completed_at, arg_max(error_message, seq) FILTER (error_message IS NOT NULL) AS error_message, arg_max(output_path, seq) FILTER (output_path IS NOT NULL) AS output_path FROM e WHERE status <> 'odd' GROUP BY id"""
)
def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "processing").when(kind == "purchase", "complete").when(kind == "error", "failed").when(kind == "signup", "queued").otherwise("odd")
    events = table(spark, sf_dir, "events").where("user_id is not null").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), status.alias("status"), "ts", F.when(kind == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error_message"), F.when(kind == "purchase", F.concat(F.lit("out/"), F.col("event_id").cast("string"))).alias("output_path"))
    return jobs.lifecycle(events)


@query("SELECT key, value, updated_at FROM (SELECT 'k' || user_id AS key, value, ts AS updated_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events) WHERE k = 1")
def settings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), "value", F.col("ts").alias("updated_at"), "event_id")
    return jobs.latest(rows.where("event_id % 2 = 0").drop("event_id"), rows.where("event_id % 2 = 1").drop("event_id"), "key", "updated_at")


@query(
    """WITH p AS (SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_partkey % 11 <> 0)
SELECT p_partkey::VARCHAR AS id, 'ROLE' AS name, CASE WHEN p_partkey % 3 = 0 THEN 'again ' || p_type ELSE p_name END AS body, 0 AS position FROM p UNION ALL SELECT p_partkey::VARCHAR, 'OUTPUT FORMAT', 'MM:SS ' || p_brand, 1 FROM p"""
)
def prompt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.sections(derived.prompts(spark, sf_dir))


@query(
    """WITH p AS (SELECT p_partkey::VARCHAR AS id, p_name AS name FROM part WHERE p_partkey % 5 <> 1) SELECT id, name FROM p UNION ALL SELECT 'copy-' || id, name || ' (copy)' FROM p WHERE id::BIGINT % 10 = 0"""
)
def prompt_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = derived.prompts(spark, sf_dir).withColumns({"created_at": F.lit("2024-01-01"), "updated_at": F.lit("2024-01-01")})
    gone = held.where("cast(id as long) % 5 = 1").select("id")
    wanted = held.where("cast(id as long) % 10 = 0").select("id", F.concat(F.lit("copy-"), "id").alias("new_id"), F.lit("2024-01-02").alias("now"))
    return jobs.duplicate(jobs.without(held, gone), wanted).select("id", "name")


@query(r"SELECT path, bytes, ending, ending IN ('.mp4', '.mov', '.avi', '.mkv', '.webm') AS admitted, round(bytes / 1048576, 2) AS size_mb FROM (SELECT path, bytes, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS ending FROM (SELECT regexp_replace(url, '[?#].*$', '') || ['.MP4', '.mov', '.txt', ''][page_id % 4 + 1] AS path, length(html) * 1000 AS bytes FROM pages))")
def admit_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".MP4", ".mov", ".txt", ""))), (F.col("page_id") % 4 + 1).cast("int"))
    return jobs.admit_videos(table(spark, sf_dir, "pages").select(F.concat(F.regexp_replace("url", "[?#].*$", ""), ending).alias("path"), (F.length("html") * 1000).cast("long").alias("bytes")))


# Progress

PROGRESS_SQL = """ev AS (SELECT user_id AS job_id, event_id AS seq, event_type AS t, event_id % 23 = 0 AS err, event_id % 17 = 0 AS blank, event_id % 12 + 1 AS c, event_id FROM events WHERE user_id IS NOT NULL),
js AS (SELECT *, CASE WHEN t = 'purchase' THEN '{"type":"complete","chunksProcessed":' || c || ',"message":"m' || event_id % 100 || '"}' ELSE '{"type":"' || t || '","chunk":' || c || ',"total":12,"percent":' || c * 100 // 12 || ',"status":"step ' || c || '","message":"m' || event_id % 100 || '","level":"info"}' END AS j FROM ev),
ln AS (SELECT *, CASE t WHEN 'view' THEN 'PROGRESS:' || j WHEN 'purchase' THEN 'COMPLETE:' || j WHEN 'error' THEN 'ERROR:' || j WHEN 'signup' THEN 'LOG:' || CASE WHEN event_id % 3 = 0 THEN '{"type":' ELSE j END ELSE 'line ' || event_id END AS line FROM js WHERE NOT blank),
parsed AS (SELECT job_id, seq, CASE WHEN err OR t IN ('click', 'signup') THEN 'log' WHEN t = 'view' THEN 'progress' WHEN t = 'purchase' THEN 'complete' ELSE 'error' END AS kind, CASE WHEN NOT err AND t NOT IN ('click', 'purchase') THEN c END AS chunk, CASE WHEN NOT err AND t NOT IN ('click', 'purchase') THEN 12 END AS total, CASE WHEN NOT err AND t NOT IN ('click', 'purchase') THEN c * 100 // 12 END AS percent, CASE WHEN NOT err AND t NOT IN ('click', 'purchase') THEN 'step ' || c END AS status, CASE WHEN NOT err AND t = 'purchase' THEN c END AS done, CASE WHEN err OR t = 'click' THEN line ELSE 'm' || event_id % 100 END AS message, CASE WHEN err THEN 'error' WHEN t = 'purchase' THEN NULL ELSE 'info' END AS level FROM ln WHERE err OR NOT (t = 'signup' AND event_id % 3 = 0)),
entries AS (SELECT *, CASE kind WHEN 'progress' THEN status WHEN 'complete' THEN 'Transcription completed successfully' WHEN 'error' THEN 'ERROR: ' || message ELSE message END AS entry FROM parsed)"""


@query(f"WITH {PROGRESS_SQL} SELECT job_id, seq, kind, coalesce(chunk, -1)::BIGINT AS chunk, coalesce(total, -1)::BIGINT AS total, coalesce(percent, -1)::BIGINT AS percent, status, coalesce(done, -1)::BIGINT AS chunks_processed, message, level FROM parsed")
def progress_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.parse(derived.progress_log(spark, sf_dir)).na.fill(-1, ["chunk", "total", "percent", "chunks_processed"])


STATE_SQL = f"""{PROGRESS_SQL}, lasts AS (SELECT job_id, arg_max(kind, seq) FILTER (kind IN ('progress', 'complete')) AS moved, arg_max(percent, seq) FILTER (kind = 'progress') AS percent, arg_max(status, seq) FILTER (kind = 'progress') AS status, arg_max(chunk, seq) FILTER (kind = 'progress') AS chunk, arg_max(total, seq) FILTER (kind = 'progress') AS total, arg_max(done, seq) FILTER (kind = 'complete') AS done, count(*) AS n_logs, arg_max(kind, seq) FILTER (kind IN ('complete', 'error')) AS outcome FROM parsed GROUP BY job_id),
states AS (SELECT job_id, CASE moved WHEN 'complete' THEN 100 WHEN 'progress' THEN percent ELSE 0 END::BIGINT AS percent, CASE moved WHEN 'complete' THEN 'Complete!' WHEN 'progress' THEN status ELSE 'Initializing...' END AS status, CASE moved WHEN 'complete' THEN done WHEN 'progress' THEN chunk ELSE 0 END::BIGINT AS chunk, CASE moved WHEN 'complete' THEN done WHEN 'progress' THEN total ELSE 0 END::BIGINT AS total, n_logs, outcome FROM lasts)"""


@query(f"WITH {STATE_SQL} SELECT job_id, percent, status, chunk, total, n_logs, outcome FROM states")
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.latest_state(progress.parse(derived.progress_log(spark, sf_dir)))


@query(f"WITH {PROGRESS_SQL} SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS entry_no, entry FROM entries")
def progress_log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.log_entries(progress.parse(derived.progress_log(spark, sf_dir)))


@query(f"WITH {STATE_SQL}, logs AS (SELECT job_id, string_agg(entry, chr(10) ORDER BY seq) AS log FROM entries GROUP BY job_id) SELECT s.job_id, percent, status, chunk, total, n_logs, outcome, log FROM states s JOIN logs USING (job_id)")
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """progress_latest as a stream, with each job's log: the lines are written as text files, and followed until all that is there has been read."""
    folder = new_folder(spark, "progress")
    progress.to_text(derived.progress_log(spark, sf_dir)).write.text(f"{folder}/lines")
    lines = progress.from_text(event_lines(spark, f"{folder}/lines"))
    progress.follow(lines, f"{folder}/checkpoint", f"{folder}/state").awaitTermination()
    return progress.followed(spark, f"{folder}/state").withColumn("log", F.array_join("log", "\n"))
