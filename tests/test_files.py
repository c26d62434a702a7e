"""Files and databases: admission without reading content, SQLite round trips, nested summaries."""

import datetime
import json
import os
import re
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter

from tallyscript.operators import jobs, parsing, summaries, validate
from tallyscript.plans import files
from tallyscript.sources import sqlite, tables
from tests.test_goldens import THREE, runs_frame


def test_admission_reads_no_content(spark, tmp_path):
    for name, size in (("a/one.MP4", 3_000_000), ("a/two.txt", 10), ("b/no ending", 5), ("b/x.tar.webm", 100), ("b/empty.mp4", 0)):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(b"x" * size)
    files = tables.file_sizes(spark, str(tmp_path))
    names = ["a/one.MP4", "a/two.txt", "b/no ending", "b/x.tar.webm", "b/gone.mp4", "b/gone.txt", "b/empty.mp4"]
    wanted = spark.createDataFrame([(f"file://{tmp_path}/{n}" if k % 2 else f"{tmp_path}/{n}", 7) for k, n in enumerate(names)] + [(None, 8)], "path string, length int")
    out = jobs.admit_files(wanted, files)
    invalid = "Invalid file type. Supported: .mp4, .mov, .avi, .mkv, .webm"
    got = {(r.path or "-").removeprefix("file://").removeprefix(f"{tmp_path}/"): tuple(r)[2:] for r in out.collect()}
    assert got == {
        "a/one.MP4": (True, None, "one.MP4", 2.86, ".mp4"), "a/two.txt": (False, invalid, None, None, None), "b/no ending": (False, invalid, None, None, None),
        "b/x.tar.webm": (True, None, "x.tar.webm", 0.0, ".webm"), "b/gone.mp4": (False, "File not found", None, None, None), "b/empty.mp4": (False, "File not found", None, None, None), "b/gone.txt": (False, "File not found", None, None, None), "-": (False, "File not found", None, None, None),
    }
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.split("\n") if "FileScan" in x]
    assert scan and all("length" in x and "content" not in x for x in scan)


@pytest.fixture
def database(spark, tmp_path):
    sqlite.register(spark)
    sqlite.create(f"{tmp_path}/jobs.db")
    return f"{tmp_path}/jobs.db"


def jobs_frame(spark, rows):
    return spark.createDataFrame([(i, f"/in/{i}.mp4", f"{i}.mp4", m, "basic", "{}", s) for i, m, s in rows], "id long, video_path string, video_filename string, video_duration_minutes double, prompt_name string, config_json string, status string")


def put(frame, path, name, mode="append"):
    frame.write.format("sqlite").option("path", path).option("table", name).mode(mode).save()


def test_jobs_round_trip_with_conditions_in_the_scan(spark, database):
    rows = [(i, i / 4 if i % 3 else None, ["queued", "complete", "failed"][i % 3]) for i in range(1, 400)]
    put(jobs_frame(spark, rows).repartition(4), database, "jobs")
    held = sqlite.load(spark, database, "jobs", partitions=5)
    assert sorted((r.id, r.video_duration_minutes, r.status) for r in held.collect()) == rows and held.rdd.getNumPartitions() == 5
    assert all(r.created_at is not None and r.started_at is None for r in held.take(3))  # the table's own defaults
    where = [("status", "=", "failed"), ("id", ">", 100), ("id", "<=", 350), ("video_duration_minutes", "null", False), ("video_filename", "starts", "2"), ("id", "in", [203, 206, 209, 210, 302])]
    some = sqlite.load(spark, database, "jobs", where)
    assert sorted(r.id for r in some.collect()) == [203, 206, 209]
    reader = sqlite.SqliteReader({"path": database, "table": "jobs", "where": json.dumps(where)}, some.schema)
    assert sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == [203, 206, 209]  # nothing else leaves the scan
    assert held.where("id = 5").count() == 1 and held.count() == 399 and held.alias("a").where("id < 9").join(some.alias("b"), F.expr("a.id + 198 = b.id")).count() == 2
    put(jobs_frame(spark, [(5, 9.0, "cancelled")]), database, "jobs")
    assert [(r.status, r.video_duration_minutes) for r in held.where("id = 5").collect()] == [("cancelled", 9.0)] and held.count() == 399
    put(jobs_frame(spark, [(1, 1.0, "queued")]), database, "jobs", "overwrite")
    assert held.count() == 1
    for odd in (("nothing", "=", 1), ("id", "; drop", 1)):
        with pytest.raises(Exception, match="no (column|operator)"):
            sqlite.load(spark, database, "jobs", [odd]).collect()


def test_a_broken_row_writes_nothing(spark, database):
    put(jobs_frame(spark, [(1, 1.0, "queued")]), database, "jobs")
    bad = jobs_frame(spark, [(i, 1.0, "queued" if i != 77 else "odd") for i in range(2, 100)]).repartition(6)
    with pytest.raises(Exception, match="CHECK constraint"):
        put(bad, database, "jobs")
    assert sqlite.load(spark, database, "jobs").count() == 1
    failing = jobs_frame(spark, [(i, 1.0, "queued") for i in range(2, 100)]).repartition(6).withColumn("status", F.when(F.col("id") == 50, F.raise_error(F.lit("lost"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="lost"):
        put(failing, database, "jobs")
    assert sqlite.load(spark, database, "jobs").count() == 1


def test_more_files_than_attach_and_moments_of_all_kinds(spark, database):
    """Thirty tasks' rows come in, the last of a key stays, moments keep their parts of a second, and no row passes through Python in the commit."""
    at = [datetime.datetime(2024, 1, 1, 5, 6, 7), datetime.datetime(1969, 12, 31, 23, 59, 59, 999999), None]
    rows = spark.range(0, 900, 1, 30).select((F.col("id") % 800).alias("id"), *(F.lit(x).alias(x) for x in ("video_path", "video_filename", "prompt_name", "config_json")), F.col("id").cast("double").alias("video_duration_minutes"), F.lit("queued").alias("status"), F.element_at(F.array(*map(F.lit, at)), (F.col("id") % 3 + 1).cast("int")).alias("created_at"))
    put(rows, database, "jobs")
    held = {r.id: (r.video_duration_minutes, r.at) for r in sqlite.load(spark, database, "jobs").select("*", F.col("created_at").cast("string").alias("at")).collect()}
    texts = ["2024-01-01 05:06:07", "1969-12-31 23:59:59.999999", None]
    assert held == {i: (float(n), texts[n % 3]) for n in range(900) for i in [n % 800]}
    db = sqlite3.connect(database)
    assert [r[0] for r in db.execute("SELECT created_at FROM jobs WHERE id IN (300, 301, 302) ORDER BY id")] == texts
    db.execute("UPDATE jobs SET created_at = '2024-02-03T04:05:06+01:00' WHERE id = 300")
    db.execute("UPDATE jobs SET created_at = '' WHERE id = 301")
    db.commit()
    db.close()
    odd = sqlite.load(spark, database, "jobs", [("id", "in", [300, 301])]).orderBy("id").select(F.col("created_at").cast("string")).collect()
    assert [r[0] for r in odd] == ["2024-02-03 03:05:06", None]
    assert not [f for f in os.listdir(os.path.dirname(database)) if f.endswith(".staged")] and issubclass(sqlite.SqliteWriter, DataSourceArrowWriter)


def test_settings_replace(spark, database):
    frame = lambda *rows: spark.createDataFrame(rows, "key string, value string")
    put(frame(("theme", "light"), ("a'b", 'c"d')), database, "settings")
    put(frame(("theme", "dark")), database, "settings")
    assert {r.key: r.value for r in sqlite.load(spark, database, "settings").collect()} == {"theme": "dark", "a'b": 'c"d'}
    assert sqlite.load(spark, database, "jobs").collect() == []
    with pytest.raises(Exception, match="no table"):
        sqlite.load(spark, database, "nothing")
    db = sqlite3.connect(database)
    assert db.execute("PRAGMA integrity_check").fetchone() == ("ok",)
    db.close()


def test_analysis_has_the_fields_of_the_file(spark):
    runs = runs_frame(spark, *THREE, "too short").withColumn("run_no", F.col("run_no") + 1)
    checked = validate.validate(runs)
    good = checked.where("ok").drop("ok", "reason")
    row = summaries.consensus_analysis(good, parsing.parse_v03(good), validate.admit(checked)).select("*", summaries.as_json("analysis").alias("json")).first()
    a = row.analysis.asDict(True)
    assert list(a) == ["flagged_transcript", "analysis_summary", "detailed_analysis", "validation_summary"]
    assert a["validation_summary"] == {"total_attempts": 4, "valid_runs": 3, "failed_runs": 1, "success_rate": 0.75}
    assert list(a["analysis_summary"]) == ["total_runs", "flagging_used", "algorithm_used", "baseline_selected", "total_lines", "quality_distribution", "overall_confidence", "research_ready", "lines_needing_review", "auto_accept_rate"]
    assert list(a["detailed_analysis"][0]) == ["timestamp", "speaker", "content", "visual", "flag", "review_needed", "flag_reason", "confidence", "total_comparisons"]
    assert [x["timestamp"] for x in a["detailed_analysis"]] == sorted(x["timestamp"] for x in a["detailed_analysis"]) and a["flagged_transcript"].count("\n") == len(a["detailed_analysis"]) - 1
    assert '"flag_reason":null' in row.json
    one = runs_frame(spark, THREE[0]).withColumn("run_no", F.lit(1))
    assert summaries.consensus_analysis(one, parsing.parse_v03(one), validate.admit(validate.validate(one))).collect() == []  # one valid run has no analysis


def test_four_places_as_the_sql_has_them(spark):
    values = [0.97825, 0.93125, 0.00005, 1.0, 0.0, 2 / 3, 0.12345]
    form = re.search(r"printf\('%.4f', .*? / 10000\)", files.ANALYSIS_SQL).group().replace("speaker_raw", "x")
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").orderBy("k").select(files.four_places(F.col("x"))).collect()]
    assert got == [duckdb.sql(f"SELECT {form} FROM (SELECT {v!r}::DOUBLE AS x)").fetchall()[0][0] for v in values]
    assert got[:3] == ["0.9783", "0.9313", "0.0001"]
