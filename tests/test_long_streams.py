"""Long streams, jobs and chunks in many slices: the same rows as plain loops give, whatever the slice."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyscript.operators import align, assemble, chunking, consensus, intervals, signal
from tallyscript.plans.queries import SQL
from tallyscript.sources import derived


def frames_of(spark, seed=1, sizes=(1, 2, 5, 37, 200)):
    rng = random.Random(seed)
    rows = [(s, i, rng.choice([rng.random(), rng.randrange(4) / 4, 10.0 ** rng.randrange(-9, 9)])) for s, n in enumerate(sizes) for i in range(n)]
    return rows, spark.createDataFrame(rows, "stream_id long, frame_idx int, energy double")


@pytest.mark.parametrize(("width", "bins", "rounds"), [(3, 4, 1), (7, 2, 3), (64, 8, 0), (1 << 16, 1024, 2)])
def test_percentile_by_counting(spark, width, bins, rounds):
    rows, frames = frames_of(spark)
    for share in (0.0, 0.3, 0.5, 1.0):
        got = {(r.stream_id, r.slice): r.threshold for r in signal.stream_percentile(frames, share, width, bins, rounds).collect()}
        assert set(got) == {(s, i // width) for s, i, _ in rows}
        for (s, _), value in got.items():
            assert value == pytest.approx(np.percentile([e for t, _, e in rows if t == s], share * 100), rel=1e-12)


def test_percentile_of_odd_streams(spark):
    rows = [(1, i, 5.0) for i in range(50)] + [(2, i, None) for i in range(5)] + [(3, 0, None), (3, 1, 2.0)]
    frames = spark.createDataFrame(rows, "stream_id long, frame_idx int, energy double")
    got = {(r.stream_id, r.threshold) for r in signal.stream_percentile(frames, 0.3, 4, 4, 2).collect()}
    assert got == {(1, 5.0), (3, 2.0)}


def test_percentile_between_equal_values(spark, tmp_path):
    """Of equal values the percentile is that value, so that none of its frames is above it; the SQL says the same."""
    sizes = {(1, 29.27): 2, (2, 26.11): 2, (3, 29.27): 9, (4, 122.79): 30}
    rows = [(s, i, v) for (s, v), n in sizes.items() for i in range(n)]
    frames = spark.createDataFrame(rows, "stream_id long, frame_idx int, energy double")
    got = signal.threshold(frames).collect()
    assert len(got) == len(rows) and all(r.threshold == r.energy and r.voiced == 0 for r in got)
    events = frames.select(F.monotonically_increasing_id().alias("event_id"), F.timestamp_seconds("frame_idx").alias("ts"), F.col("stream_id").alias("user_id"), F.col("energy").alias("value"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert con.sql(f"SELECT count(*), sum(voiced) FROM ({SQL['frame_threshold']})").fetchall() == [(len(rows), 0.0)]


def test_equal_moments_have_one_order(spark, tmp_path):
    """Frames of one moment and event are ordered by value, nulls last, in the query and in its SQL, however the rows lie."""
    rows = [(7, t, 1, None if v == 5 else float(v)) for t in (1, None, 2) for v in range(9, -1, -1)]
    events = spark.createDataFrame(rows, "event_id long, t long, user_id long, value double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = [(r.frame_idx, r.energy) for r in derived.frames(spark, str(tmp_path)).orderBy("frame_idx").collect()]
    assert got == list(enumerate(3 * [0.0, 1.0, 2.0, 3.0, 4.0, 6.0, 7.0, 8.0, 9.0, None]))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert con.sql(f"WITH {derived.FRAMES_SQL} SELECT frame_idx, energy FROM frames ORDER BY frame_idx").fetchall() == got


def test_a_slice_of_nulls_stays(spark):
    """Frames whose slice has no energy at all are kept, with their stream's percentile."""
    frames = spark.createDataFrame([(1, i, None if 4 <= i < 8 else float(i)) for i in range(12)] + [(2, 0, None)], "stream_id long, frame_idx int, energy double")
    got = {r.frame_idx: (r.threshold, r.voiced) for r in signal.threshold(frames, width=4).where("stream_id = 1").collect()}
    assert sorted(got) == list(range(12)) and len({t for t, _ in got.values()}) == 1 and all(got[i][1] is None for i in range(4, 8))


def test_mean_confidence_is_exact_in_every_order(spark):
    rng = random.Random(2)
    rows = [(s, i, rng.choice([0.72, 0.86, 1.0, 0.3 + 0.14 * 3])) for s in range(20) for i in range(32 + s)]
    frames = spark.createDataFrame(rows, "stream_id long, frame_idx int, confidence double")
    seen = [sorted((r.stream_id, r.confidence) for r in signal.segments(frames.repartition(3), width=w).collect()) for w in (1, 3, 11, 1 << 16)]
    assert all(s == seen[0] for s in seen) and len(seen[0]) == 20


def test_same_segments_for_every_slice(spark):
    rng = random.Random(7)
    _, frames = frames_of(spark, 3, (40, 300))
    asr = spark.createDataFrame([(s, a, a + rng.random() * 0.6) for s in (0, 1) for a in (rng.random() * 3 for _ in range(8))] + [(1, -1.0, 0.05), (1, 2.9, 90.0), (0, 0.2, 0.1)], "stream_id long, start_s double, end_s double")
    seen = []
    for width in (2, 3, 7, 64, 1 << 16):
        smoothed = signal.smooth(signal.threshold(frames, width=width), slice_=width)
        stamped = signal.blend(signal.stamp(smoothed, asr, 100.0, width))
        found = signal.segments(stamped, speech=0.5, shortest=0.0, width=width)
        per_frame = sorted((r.stream_id, r.frame_idx, round(r.smoothed, 9), r.asr) for r in stamped.collect())
        seen.append((per_frame, sorted((r.stream_id, r.seg_no, *(round(x, 9) for x in (r.start_s, r.end_s, r.confidence))) for r in found.collect())))
    assert all(s == seen[-1] for s in seen) and len(seen[0][1]) > 10
    spans = [(r.stream_id, max(0, int(r.start_s * 100)), int(r.end_s * 100)) for r in asr.collect()]
    voiced = {(r.stream_id, r.frame_idx): r.voiced for r in signal.threshold(frames).collect()}
    for s, i, smoothed, marked in seen[0][0]:
        assert marked == any(t == s and a <= i < b for t, a, b in spans)
        assert smoothed == pytest.approx(sum(voiced.get((s, i + k), 0) for k in range(-2, 3)) / 5)


def plain_cuts(gaps, duration, d=120.0):
    at, cuts = 0.0, []
    while at + d < duration:
        ideal = at + d
        near = [g for g in gaps if abs(g - ideal) < 30]
        best = min(near, key=lambda g: abs(g - ideal), default=None)
        at = best if best and best > at + d * 0.7 else ideal
        cuts.append(at)
    return cuts


def test_boundaries_of_ten_thousand_gaps(spark):
    rng = random.Random(5)
    at, segments = 0.0, []
    for k in range(10_001):
        end = at + rng.choice([1.0, 20.0, 90.0, 250.0])
        segments.append((1, k + 1, at, end))
        at = end + rng.choice([2.0, 4.0, 3.5])
    rows = spark.createDataFrame(segments, "stream_id long, seg_no int, start_s double, end_s double")
    streams = spark.createDataFrame([(1, at)], "stream_id long, duration_s double")
    began = time.perf_counter()
    got = [r.boundary_s for r in chunking.boundaries(rows, streams, 120).orderBy("boundary_no").collect()]
    assert time.perf_counter() - began < 60
    centres = [(a[3] + b[2]) / 2 for a, b in zip(segments, segments[1:])]
    near, want, start, position = sorted(centres), [], 0.0, 0
    while start + 120 < at:  # plain_cuts with a cursor
        while position < len(near) and near[position] <= start + 90:
            position += 1
        want.append(plain_cuts([g - start for g in near[position : position + 200]], 121.0)[0] + start)
        start = want[-1]
    assert len(got) == len(want) and all(abs(a - b) < 1e-6 for a, b in zip(got, want))


def test_carried_context_over_slices(spark):
    rng = random.Random(6)
    texts = [(job, k, rng.choice(["00:01 A: one", "[FAILED] x"]) + str(k)) for job in (1, 2) for k in range(1, 60)] + [(3, 1, "[FAILED] x"), (3, 2, "[FAILED] y"), (3, 50, "z")]
    chunks = spark.createDataFrame(texts, "job_id long, chunk_no int, text string")
    good = {(j, k) for j, k, t in texts if not t.startswith("[")}
    want = {(j, k): max((c for i, c in good if i == j and c < k), default=None) for j, k, _ in texts}
    for width in (1, 4, 1024):
        assert {(r.job_id, r.chunk_no): r.context_chunk_no for r in assemble.carry_context(chunks, width=width).collect()} == want


def test_overlaps_of_any_length(spark):
    rng = random.Random(9)
    some = lambda n, longest: [(s, i, a, a + rng.random() * rng.choice([0.0, 1.0, 100.0, longest])) for s in (1, 2) for i, a in enumerate(rng.random() * 50_000 for _ in range(n))]
    a, b = some(40, 500.0) + [(1, 99, 5.0, 36_005.0)], some(60, 3_000.0) + [(1, 98, 0.0, 1e6), (2, 97, -500.0, 64.0)]
    left = spark.createDataFrame(a, "key long, i int, a0 double, a1 double")
    right = spark.createDataFrame(b, "key long, j int, b0 double, b1 double")
    got = sorted((r.key, r.i, r.j) for r in intervals.overlaps(left, right, "key", ("a0", "a1"), ("b0", "b1")).collect())
    assert got == sorted((s, i, j) for s, i, a0, a1 in a for t, j, b0, b1 in b if s == t and a1 > b0 and b1 > a0 and a1 > a0 and b1 > b0)


def test_largest_at_each_second(spark):
    rng = random.Random(10)
    rows = [(s, a := rng.randrange(-50, 400), a + rng.choice([1, 2, 7, 300]), rng.random()) for s in (1, 2) for _ in range(60)] + [(3, 5, 5, 0.5), (3, 0, 36_000, 0.25)]
    frame = spark.createDataFrame(rows, "key long, a long, b long, v double")
    stretches = intervals.largest(frame, ("key",), "v")
    got = {}
    for r in stretches.collect():
        assert r.from_ < r.to
        for t in range(r.from_, r.to):
            assert (r.key, t) not in got
            got[r.key, t] = r.v
    want = {}
    for s, a, b, v in rows:
        for t in range(a, b):
            want[s, t] = max(v, want.get((s, t), 0))
    assert got == want
    points = spark.createDataFrame([(s, t, "x") for s in (1, 2, 3, 4) for t in (-60, -1, 0, 5, 399, 500, 35_999, 36_000)], "key long, t int, note string")
    assert {(r.key, r.t): r.v for r in intervals.look_up(points, "t", stretches, ("key",), "v").collect()} == {(r.key, r.t): want.get((r.key, r.t)) for r in points.collect()}
    whole = spark.createDataFrame([(1, 1, 0.5, 36_000.2, 0.7)], "job_id long, chunk_no int, start_s double, end_s double, confidence double")
    assert [tuple(r) for r in consensus.voice_stretches(whole).collect()] == [(1, 1, 0, 36_001, 0.7)]


def plain_nearest(lines, tolerance=5):
    found = {}
    for c, run, k, sec in lines:
        for d, other, j, at in lines:
            if c == d and abs(sec - at) <= tolerance:
                key = (c, run, k, other)
                found[key] = min(found.get(key, (99, 0)), (abs(sec - at), j))
    return {(*key, j, d) for key, (d, j) in found.items()}


@pytest.mark.parametrize("slot_s", [5, 13, 120])
def test_nearest_in_slots(spark, slot_s):
    rng = random.Random(slot_s)
    lines = [(c, run, k, rng.randrange(0, 200)) for c in (1, 2) for run in (1, 2, 3) for k in range(rng.randrange(0, 40))]
    frame = spark.createDataFrame([(1, *x, "A", "b") for x in lines], "job_id long, chunk_no int, run_no int, line_no int, sec int, speaker string, content string")
    got = align.nearest(align.as_base(frame), frame, slot_s=slot_s).collect()
    assert {(r.chunk_no, r.base_run, r.line_no, r.run_no, r.other_line_no, r.distance) for r in got} == plain_nearest(lines) and len(got) == len(plain_nearest(lines))
    told = align.nearest(align.as_base(frame.withColumn("d", F.col("run_no") % 2)), frame.withColumn("d", F.col("run_no") % 2), differ="d", slot_s=slot_s).collect()
    assert {(r.chunk_no, r.base_run, r.line_no, r.run_no, r.other_line_no, r.distance) for r in told} == {x for x in plain_nearest(lines) if (x[1] - x[3]) % 2}


def test_nearest_in_one_slot_of_many_lines(spark):
    """Ten thousand lines of one second range, which all pairs would make a hundred million rows of."""
    lines = spark.range(20_000).select(F.lit(1).alias("job_id"), F.lit(1).alias("chunk_no"), (F.col("id") % 2).alias("run_no"), F.floor(F.col("id") / 2).alias("line_no"), (F.col("id") % 7).alias("sec"), F.lit("A").alias("speaker"), F.lit("b").alias("content"))
    began = time.perf_counter()
    got = align.nearest(align.as_base(lines.where("run_no = 0")), lines)
    assert got.count() == 20_000 and got.where("distance > 1").count() == 0 and time.perf_counter() - began < 60


def test_means_over_runs_in_order_of_runs(spark):
    """However a line's matches arrive, they are summed in order of runs, so that no whole percent is lost or won by chance."""
    values = [0.1, 0.2, 0.3]
    for rows in ([2, 1, 0], [0, 1, 2], [1, 2, 0]):
        aligned = spark.createDataFrame([(1, 1, 0, r, 0, "A", "b", 1, values[r]) for r in rows], "job_id int, chunk_no int, line_no int, run_no int, base_run int, speaker string, content string, same_speaker int, similarity double").coalesce(1)
        row = consensus.confidence_of(aligned, ()).first()
        assert (row.speaker_raw, row.content_raw, row.n_matched) == (1.0, (0.1 + 0.2 + 0.3) / 3, 3)
        assert consensus.line_confidence(aligned.select("job_id", "chunk_no", "line_no").distinct(), aligned).first().content_raw == (0.1 + 0.2 + 0.3) / 3
