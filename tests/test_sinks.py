"""Sinks: files in order, whole and alone in their folders."""

import glob
import random

from pyspark.sql import functions as F

from tallyscript.sources import tables


def test_transcripts_over_eight_partitions(spark, tmp_path):
    rng = random.Random(2)
    texts = {(job, chunk): "\n".join(f"{i:02d}:00 Ana: {'é' * rng.randrange(3)} {rng.random()}" if i % 5 else "" for i in range(rng.randrange(1, 300))) for job in (1, 2, 10, None) for chunk in range(1, 13)}
    rows = [(j, c, t) for (j, c), t in texts.items()]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "job_id long, chunk_no long, text string").repartition(8)
    lines = tables.numbered_lines(frame).repartition(8, F.rand(3))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_transcripts(lines, f"{tmp_path}/chunks", ("job_id", "chunk_no"), ("line_no",))
        tables.write_transcripts(lines, f"{tmp_path}/combined", ("job_id",), ("chunk_no", "line_no"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{tmp_path}/chunks/job_id=*/chunk_no=*/*.txt")) == len(glob.glob(f"{tmp_path}/chunks/job_id=*/chunk_no=*")) == 48
    assert len(glob.glob(f"{tmp_path}/combined/job_id=*/*.txt")) == 4
    with open(glob.glob(f"{tmp_path}/chunks/job_id=10/chunk_no=7/*.txt")[0], encoding="utf-8") as f:
        assert f.read() == texts[10, 7] + "\n"
    assert {(r.job_id, r.chunk_no): r.text for r in tables.read_transcripts(spark, f"{tmp_path}/chunks", ("job_id", "chunk_no")).collect()} == texts
    whole = {r.job_id: r.text for r in tables.read_transcripts(spark, f"{tmp_path}/combined", ("job_id",)).collect()}
    assert whole == {j: "\n".join(texts[j, c] for c in range(1, 13)) for j in (1, 2, 10, None)}


def test_a_task_for_each_shuffle_partition_and_no_file_half_written(spark, tmp_path):
    """Small files are written by as many tasks as shuffles have, not by the one that their few bytes fill; odd paths and empty tables work."""
    path = f"{tmp_path}/a b%20c"
    lines = spark.range(400).select(F.floor(F.col("id") / 2).alias("job_id"), (F.col("id") % 2).alias("line_no"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("line"))
    tracker, group = spark.sparkContext.statusTracker(), "sink"
    spark.sparkContext.setJobGroup(group, group)
    tables.write_transcripts(lines, f"file://{path}", ("job_id",), ("line_no",))
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("", "")
    assert max(s.numTasks for s in stages if s and s.numCompletedTasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = glob.glob(f"{path}/**/*", recursive=True, include_hidden=True)
    assert sum(f.endswith("part-0.txt") for f in files) == 200 and len(files) == 400  # folders and their files
    with open(f"{path}/job_id=7/part-0.txt", encoding="utf-8") as f:
        assert f.read() == "14\n\n"
    tables.write_transcripts(lines.where("job_id < 0"), f"{tmp_path}/none", ("job_id",), ("line_no",))
    assert glob.glob(f"{tmp_path}/none") and not glob.glob(f"{tmp_path}/none/*", include_hidden=True)


def test_transcripts_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """However many files there are, the driver lists none and the reading takes as many tasks as shuffles have; an empty sink has no rows."""
    by = ("job_id", "chunk_no")
    lines = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.floor(F.col("id") / 3)).alias("job_id"), F.col("id").alias("chunk_no"), F.lit(0).alias("line_no"), F.concat(F.lit("é\n"), "id").alias("line"))
    tables.write_transcripts(lines, f"{tmp_path}/t", by, ("line_no",))
    for hidden in (f"{tmp_path}/t/_SUCCESS", f"{tmp_path}/t/job_id=0/chunk_no=1/.part"):  # of a task that died
        with open(hidden, "w") as f:
            f.write("half")
    monkeypatch.setattr(tables, "READ_BYTES", 100, raising=False)
    read = tables.read_transcripts(spark, f"file://{tmp_path}/t", by)
    assert read.inputFiles() == []
    assert read.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert read.dtypes == [("job_id", "bigint"), ("chunk_no", "bigint"), ("text", "string")]
    rows = read.collect()
    assert len(rows) == 600 and {tuple(r) for r in rows} == {(i // 3 if i % 3 else None, i, f"é\n{i}") for i in range(600)}
    tables.write_transcripts(lines.where("job_id < 0"), f"{tmp_path}/none", by, ("line_no",))
    assert tables.read_transcripts(spark, f"{tmp_path}/none", by).collect() == []
