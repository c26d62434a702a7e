"""Small inputs with results worked out by hand."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyscript.functions import similarity as sim
from tallyscript.functions import text as tx
from tallyscript.operators import assemble, chunking, consensus, cost, jobs, parsing, signal, validate
from tallyscript.sources import tables
from tallyscript.streaming import progress


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def runs_frame(spark, *texts):
    return spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts)], "job_id long, chunk_no int, run_no int, text string")


THREE = (
    "00:05 Teacher: open the book\n00:12 Ana: which page\n00:20 Ana: ten",
    "00:06 Teacher: open the book\n00:12 Ben: which page\n00:21 Ben: eleven",
    "00:05 Teacher: open a book\n00:14 Ana: which page is it\n00:26 Ana: ten",
)


def test_consensus_v04(spark):
    runs = runs_frame(spark, *THREE)
    rows = consensus.consensus_v04(runs, parsing.parse_v04(runs)).orderBy("line_no").collect()
    assert [(r.speaker_pct, r.content_pct, r.reason) for r in rows] == [(100, 98, ""), (74, 98, ""), (57, 65, "[verify: spkr:57 text:65]")]
    assert rows[2].text == "00:20 Ana: ten [verify: spkr:57 text:65]"


def test_consensus_v03(spark):
    runs = runs_frame(spark, *THREE)
    rows = consensus.consensus_v03(runs, parsing.parse_v03(runs)).orderBy("line_no").collect()
    assert [r.quality for r in rows][0] == "accept"
    assert all(r.text.startswith(f"{r.ts} {r.speaker}: {r.content} ") for r in rows)


def test_parse(spark):
    text = "  00:01 Ana Maria:  hi [waves] there [smiles]\nno clock: x\n00:01:05 X: hi\n\n12:34 B: \n"
    rows = parsing.parse_v03(runs_frame(spark, text)).orderBy("line_no").collect()
    assert [(r.ts, r.sec, r.speaker, r.content, r.visual) for r in rows] == [("00:01", 1, "Ana Maria", "hi  there", "waves smiles"), ("12:34", 754, "B", "", "")]
    assert parsing.parse_v04(runs_frame(spark, None, "")).count() == 0


def test_clock(spark):
    assert one(spark, tx.clock_seconds(F.col("c")), c="1:05") == 65.0
    assert one(spark, tx.clock_seconds(F.col("c")), c="00:01:05") == 0.0
    assert one(spark, tx.seconds_clock(F.col("s")), s=185.9) == "03:05"
    assert one(spark, tx.seconds_clock(F.col("s")), s=7507) == "125:07"


def test_speaker_and_words(spark):
    assert one(spark, tx.speaker_name(F.col("s")), s=" AVA ") == "teacher"
    assert one(spark, tx.speaker_name(F.col("s")), s="Male Voice") == "male_voice"
    assert one(spark, tx.plain_words(F.col("s")), s=" It's,  we'll; GO! ") == "its well go"


def test_similarity(spark):
    pair = lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert pair(sim.jaccard_v04, "a b", "B c") == pytest.approx(1 / 3)
    assert (pair(sim.jaccard_v04, " ", ""), pair(sim.jaccard_v04, "a", "")) == (1.0, 0.0)
    assert pair(sim.jaccard_v03, "a b", "b c") == pytest.approx(0.4)
    assert (pair(sim.jaccard_v03, "[x] Hi!", "hi"), pair(sim.jaccard_v03, "", "a")) == (1.0, 0.0)
    assert one(spark, sim.embedding_similarity(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 2.0]) == 0.5
    assert one(spark, sim.short_boost(F.lit(0.5), F.col("a"), F.col("b")), a="one two", b="three") == pytest.approx(0.65)


@settings(max_examples=15, deadline=None)
@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_similarity_is_symmetric(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(sim.jaccard_v04(F.col("a"), F.col("b")).alias("x"), sim.jaccard_v04(F.col("b"), F.col("a")).alias("y"), sim.jaccard_v04(F.col("a"), F.col("a")).alias("z")).first()
    assert row.x == row.y and 0 <= row.x <= 1 and row.z == 1


def test_validate(spark):
    long = "\n".join(f"00:{i:02d} A: line number {i} of the talk" for i in range(12))
    looped = "\n".join(f"x: the same thing {i // 8}" for i in range(12))
    texts = [None, "", "short: x", "[ERROR: bad", "no response CANDIDATES here", "w" * 60, long, looped]
    rows = validate.validate(runs_frame(spark, *texts)).orderBy("run_no").collect()
    assert [r.ok for r in rows] == [False] * 6 + [True, False]
    assert [r.reason.split(" ")[0] for r in rows] == ["Empty", "Empty", "Transcript", "Error", "Error", "No", "Valid", "Excessive"]
    admitted = validate.admit(validate.validate(runs_frame(spark, *texts))).first()
    assert (admitted.n_runs, admitted.n_valid, admitted["mode"]) == (8, 1, "single")


def test_suppress(spark):
    rows = validate.suppress_repeats(runs_frame(spark, "plain\n" + "\n".join(["A: yes"] * 5) + "\nplain")).orderBy("line_no").collect()
    assert [r.line for r in rows] == ["plain", "A: yes", "A: yes", "A: yes", "A: [continues repeating: 'yes']", "plain"]


def test_attempts(spark):
    tries = spark.createDataFrame([(1, 1, 0, 0, False, "a"), (1, 1, 0, 1, True, "b"), (1, 1, 0, 2, True, "c"), (1, 1, 1, 0, False, "d"), (1, 1, 1, 1, False, "e")], "job_id long, chunk_no int, run_no int, attempt int, ok boolean, text string")
    assert [(r.ok, r.text) for r in validate.first_valid(tries).orderBy("run_no").collect()] == [(True, "b"), (False, "e")]
    answers = spark.createDataFrame([(1, "x"), (2, "y"), (9, None)], "finish_reason int, text string")
    got = validate.unwrap(answers).collect()
    assert [r.response for r in got] == ["x", "[PARTIAL_VAD: Generation stopped due to MAX_TOKENS]\n\ny", None]
    assert got[2].error == "Generation stopped due to UNKNOWN(9)"
    old = validate.unwrap(answers, v03=True).collect()
    assert [r.response for r in old] == ["x", "[PARTIAL: Generation stopped due to MAX_TOKENS]\n\ny", None] and old[2].error == "Generation stopped due to UNKNOWN(9) with no content"


def test_smooth_and_threshold(spark):
    frames = spark.createDataFrame([(1, i, float(e)) for i, e in enumerate((1, 1, 1, 0, 0, 1))], "stream_id long, frame_idx int, energy double")
    rows = signal.smooth(frames, "energy").orderBy("frame_idx").collect()
    assert [r.smoothed for r in rows] == pytest.approx([0.6, 0.6, 0.6, 0.6, 0.4, 0.2])


def test_segments(spark):
    values = [0.9] * 10 + [0.1] * 5 + [0.8] * 3 + [0.1] * 2 + [0.7] * 10
    frames = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "stream_id long, frame_idx int, confidence double")
    rows = signal.segments(frames).collect()
    assert [(r.seg_no, round(r.start_s, 2), round(r.end_s, 2)) for r in rows] == [(1, 0.0, 0.2), (2, 0.4, 0.6)]
    assert [round(r.confidence, 6) for r in rows] == [0.9, 0.7]


@settings(max_examples=10, deadline=None)
@given(st.floats(0.5, 900), st.integers(1, 200))
def test_fixed_chunks_tile(spark, duration, size):
    rows = chunking.fixed_chunks(spark.createDataFrame([(1, duration)], "stream_id long, duration_s double"), size).orderBy("chunk_no").collect()
    assert rows[0].start_s == 0 and rows[-1].end_s == duration
    assert all(a.end_s == b.start_s for a, b in zip(rows, rows[1:], strict=False))


def test_boundaries(spark):
    segments = spark.createDataFrame([(1, 1, 0.0, 50.0, 50.0, 1.0), (1, 2, 54.0, 100.0, 46.0, 1.0), (1, 3, 100.5, 170.0, 69.5, 1.0)], "stream_id long, seg_no int, start_s double, end_s double, duration double, confidence double")
    streams = spark.createDataFrame([(1, 170.0), (2, 130.0), (3, 0.0)], "stream_id long, duration_s double")
    cuts = chunking.boundaries(segments, streams, 60)
    assert sorted((r.stream_id, r.boundary_s) for r in cuts.collect()) == [(1, 52.0), (1, 112.0), (2, 60.0), (2, 120.0)]
    chunks = chunking.gap_chunks(cuts, streams)
    assert sorted((r.stream_id, r.start_s, r.end_s) for r in chunks.collect()) == [(1, 0.0, 52.0), (1, 52.0, 112.0), (1, 112.0, 170.0), (2, 0.0, 60.0), (2, 60.0, 120.0), (2, 120.0, 130.0)]
    voice = chunking.chunk_voice(chunks, segments).where("stream_id = 1").orderBy("chunk_no").collect()
    assert [(r.num_segments, r.speech_s) for r in voice] == [(1, 50.0), (2, 57.5), (1, 58.0)]


def test_cost(spark):
    videos = spark.createDataFrame([(30.0, cost.PRICES[0][0], 3, 1, 1), (30.0, "none", 3, 1, 3)], "duration_min double, model string, chunk_min int, fps int, runs int")
    rows = cost.estimate_cost(videos, cost.prices(spark)).orderBy("runs").collect()
    assert (rows[0].total_tokens, rows[0].input_cost, rows[0].output_cost, rows[0].total_cost, rows[0].num_chunks) == (621000, 1.1, 0.81, 1.91, 10)
    assert rows[1].total_cost == 0


def test_shift_and_context(spark):
    chunks = spark.createDataFrame([(1, 1, 0.0, "00:01 A: one"), (1, 2, 60.0, "[FAILED] 1: x"), (1, 3, 120.0, "=== head\n00:05 A: hi ✅\n00:05 Male Student 1: hi")], "job_id long, chunk_no int, start_s double, text string")
    assert [r.line for r in assemble.shift_lines(chunks).orderBy("chunk_no", "line_no").collect()] == ["00:01 A: one", "[FAILED] 1: x", "02:05 A: hi ✅", "00:05 Male Student 1: hi"]
    held = assemble.carry_context(chunks).orderBy("chunk_no").collect()
    assert [r.context_chunk_no for r in held] == [None, 1, 1] and held[2].context == "00:01 A: one"
    whole = assemble.assemble(chunks.withColumn("voice_line", F.lit(None).cast("string"))).first()
    assert (whole.n_chunks, whole.n_failed) == (3, 1) and "❌ CHUNK 2 FAILED:" in whole.document and "02:05 A: hi" in whole.document


def test_older_failures(spark):
    texts = ["00:01 A: one", "[VALIDATION_FAILED] x", "[CONSENSUS_FAILED] y", "[noise] 00:02 B: two", "00:03 C: three"]
    chunks = spark.createDataFrame([(1, i + 1, i * 60.0, t) for i, t in enumerate(texts)], "job_id long, chunk_no int, start_s double, text string")
    assert [r.context_chunk_no for r in assemble.carry_context(chunks, v03=True).orderBy("chunk_no").collect()] == [None, 1, 1, 1, 4]
    assert [r.context_chunk_no for r in assemble.carry_context(chunks).orderBy("chunk_no").collect()] == [None, 1, 1, 1, 1]
    whole = assemble.assemble_v03(chunks).first()
    assert (whole.n_chunks, whole.n_left_out) == (5, 1)
    assert whole.document == "--- Chunk 1 (Starting at 0.0 minutes) ---\n00:01 A: one\n\n--- Chunk 2 (Starting at 1.0 minutes) ---\n[VALIDATION_FAILED] x\n\n--- Chunk 4 (Starting at 3.0 minutes) ---\n[noise] 00:02 B: two\n\n--- Chunk 5 (Starting at 4.0 minutes) ---\n04:03 C: three\n"


def test_insert_drops_the_secret(spark):
    held = spark.createDataFrame([(1, "complete")], "id long, status string")
    new = spark.createDataFrame([(2, "/a/b.mp4", "basic", '{"apiKey":"k","runs":3,"vad":{"on":true}}'), (3, "c.mov", "basic", None)], "id long, video_path string, prompt_name string, config string")
    rows = {r.id: r for r in jobs.insert(held, new).collect()}
    assert rows[1].status == "complete" and (rows[2].status, rows[2].video_filename, rows[2].config_json) == ("queued", "b.mp4", '{"runs":3,"vad":{"on":true}}') and rows[3].config_json == "{}"


def test_prompt_table(spark):
    prompts = spark.createDataFrame([("1", "basic", "d", "B", "t0", "t0"), ("2", "other", "d", "O", "t0", "t0")], "id string, name string, description string, prompt_text string, created_at string, updated_at string")
    changes = spark.createDataFrame([("2", "new", "e", "N", "t0", None), (None, "third", "f", "T", None, None)], prompts.schema)
    rows = {r.name: r for r in jobs.save_prompts(prompts, changes, F.lit("t1")).collect()}
    assert sorted(rows) == ["basic", "new", "third"] and (rows["new"].id, rows["new"].updated_at) == ("2", "t1") and rows["third"].id and rows["third"].created_at == "t1"
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert [r.id for r in jobs.without(prompts, ids("1")).collect()] == ["2"] and [r.name for r in jobs.prompts_of(ids("2"), prompts).collect()] == ["other"]
    for missing in (jobs.without(prompts, ids("9")), jobs.prompts_of(ids("1", "9"), prompts), jobs.duplicate(prompts, ids("9").selectExpr("id", "'x' as new_id", "'t' as now"))):
        with pytest.raises(Exception, match="Prompt not found: 9"):
            missing.collect()
    assert jobs.exported(prompts).first().json == '{"name":"basic","description":"d","prompt_text":"B"}'
    assert jobs.listing(prompts).first().line == "  1                    - basic\n                         d"


def test_sinks_and_sources(spark, tmp_path):
    lines = spark.createDataFrame([(1, "00:01 A: x"), (2, "00:02 B: y"), (2, "")], "job_id long, line string")
    tables.write_transcripts(lines, f"{tmp_path}/t", ("job_id",), ("line",))
    assert sorted(map(tuple, tables.read_transcripts(spark, f"{tmp_path}/t", ("job_id",)).collect())) == [(1, "00:01 A: x"), (2, "\n00:02 B: y")]
    assert tables.transcripts(spark, f"{tmp_path}/t/*/*.txt").count() >= 2
    rows = spark.createDataFrame([(1, 2.5, "é")], "job_id long, rate double, note string")
    tables.write_summaries(rows, f"{tmp_path}/s")
    assert tables.read_summaries(spark, f"{tmp_path}/s", rows.schema).collect() == rows.collect()


def test_followed_text(spark, tmp_path):
    raw = spark.createDataFrame([(1, 1, "stdout", 'PROGRESS:{"chunk":1,"total":4,"percent":25,"status":"a\\tb"}'), (1, 2, "stderr", "oops"), (2, 3, "stdout", "")], "job_id long, seq long, source string, raw string")
    progress.to_text(raw).write.text(f"{tmp_path}/lines")
    progress.follow(progress.from_text(tables.event_lines(spark, f"{tmp_path}/lines")), f"{tmp_path}/c", f"{tmp_path}/state").awaitTermination()
    got = progress.followed(spark, f"{tmp_path}/state").collect()
    assert [(r.job_id, r.percent, r.n_logs) for r in got] == [(1, 25, 2)]


def test_frame_energy(spark):
    samples = spark.createDataFrame([(1, i, float(i)) for i in range(9)] + [(2, 0, 1.0)], "stream_id long, idx long, x double")
    got = sorted((r.stream_id, r.frame_idx, r.energy) for r in signal.frame_energy(samples, 2).collect())
    assert got == [(1, 0, 14.0), (1, 1, 54.0), (1, 2, 126.0)]


def test_repetition_counts(spark):
    looped = "\n".join(f"x: the same thing {i // 8}" for i in range(12)) + "\nno colon"
    row = validate.repetition(runs_frame(spark, looped)).first()
    assert (row.n_lines, row.n_contents, row.most, row.excessive) == (13, 12, 8, True)


def test_jobs(spark):
    t = datetime.datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, 1, "queued", t, None, None), (1, 2, "processing", t + datetime.timedelta(1), None, None), (1, 3, "failed", t + datetime.timedelta(2), "e", None), (1, 4, "odd", t, None, None)], "id long, seq long, status string, ts timestamp, error_message string, output_path string")
    row = jobs.lifecycle(events).first()
    assert (row.status, row.started_at, row.completed_at, row.error_message) == ("failed", t + datetime.timedelta(1), t + datetime.timedelta(2), "e")
    prompts = spark.createDataFrame([("1", "basic", "d", "BASE", "t", "t"), ("2", "other", "d", "OTHER", "t", "t")], "id string, name string, description string, prompt_text string, created_at string, updated_at string")
    got = jobs.prompt_of(spark.createDataFrame([("2",), ("other",), ("x",)], "key string"), prompts).collect()
    assert sorted((r.key, r.prompt_text) for r in got) == [("2", "OTHER"), ("other", "OTHER"), ("x", "BASE")]


def test_sections_round_trip(spark):
    text = "**ROLE:**\nact\n\n**OUTPUT FORMAT:**\nMM:SS"
    parts = parsing.sections(spark.createDataFrame([("1", text), ("2", "none")], "id string, prompt_text string"))
    assert parsing.join_sections(parts).collect()[0].prompt_text == text


def test_prompt_library(spark):
    texts = spark.createDataFrame([('{"k": {"name": "n", "description": "d", "prompt": "p"}}',), ('{"prompts": [{"id": "1", "name": "m", "description": "e", "prompt_text": "q"}]}',), ("{bad",)], "text string")
    assert sorted((r.id, r.prompt_text) for r in tables.prompt_library(texts).collect()) == [("1", "q"), ("k", "p")]


def test_progress(spark):
    raw = spark.createDataFrame([(1, 1, 'PROGRESS:{"chunk":1,"total":4,"percent":25,"status":"s"}', "stdout"), (1, 2, "PROGRESS:{bad", "stdout"), (1, 3, " ", "stdout"), (1, 4, "text", "stdout"), (1, 5, "oops", "stderr"), (1, 6, 'COMPLETE:{"message":"done"}', "stdout")], "job_id long, seq long, raw string, source string")
    events = progress.parse(raw)
    assert [(r.seq, r.kind, r.level) for r in events.orderBy("seq").collect()] == [(1, "progress", None), (4, "log", "info"), (5, "log", "error"), (6, "complete", None)]
    state = progress.latest_state(events).first()
    assert (state.percent, state.status, state.n_logs, state.outcome) == (100, "Complete!", 4, "complete")
