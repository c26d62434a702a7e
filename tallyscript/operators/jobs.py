"""Jobs, settings and prompts as tables of events: the latest event of a key is its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a job, those that begin and end work, file endings of videos.
STATES = ("queued", "processing", "complete", "failed", "cancelled")
ENDED = ("complete", "failed", "cancelled")
#: Field of a job's settings that is not stored.
SECRET = "apiKey"
#: Fixed texts of a file that is not admitted.
NOT_FOUND, INVALID_TYPE = "File not found", "Invalid file type. Supported: "
VIDEOS = (".mp4", ".mov", ".avi", ".mkv", ".webm")


def recent(jobs: DataFrame, n: int = 10) -> DataFrame:
    """The newest n, the higher id first of the same time."""
    return jobs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def by_status(jobs: DataFrame, status: str) -> DataFrame:
    return jobs.where(F.col("status") == status).orderBy(F.col("created_at").desc(), F.col("id").desc())


def by_id(jobs: DataFrame, id_: int) -> DataFrame:
    return jobs.where(F.col("id") == id_)


def insert(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """jobs and those of new (id, video_path, prompt_name, config), queued. config, JSON, is stored without its secret; a missing one as {}."""
    config = F.coalesce(F.from_json("config", "map<string, variant>"), F.from_json(F.lit("{}"), "map<string, variant>"))
    fresh = new.select("id", "video_path", F.substring_index("video_path", "/", -1).alias("video_filename"), "prompt_name", F.to_json(F.map_filter(config, lambda k, _: k != SECRET)).alias("config_json"), F.lit(STATES[0]).alias("status"))
    return jobs.unionByName(fresh, allowMissingColumns=True)


def lifecycle(events: DataFrame) -> DataFrame:
    """events (id, seq, status, ts, error_message, output_path) to each job's state: status, created_at, started_at, completed_at,
    error_message, output_path. Events of unknown status are left out."""
    known = events.where(F.col("status").isin(*STATES))
    at = lambda states: F.max(F.when(F.col("status").isin(*states), F.col("ts")))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return known.groupBy("id").agg(F.max_by("status", "seq").alias("status"), F.min("ts").alias("created_at"), at(("processing",)).alias("started_at"), at(ENDED).alias("completed_at"), latest("error_message").alias("error_message"), latest("output_path").alias("output_path"))


def latest(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: of each key the row that comes last by `order`, a change before a held row of the same time."""
    rows = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    turn = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col("_new").desc())
    return rows.withColumn("_turn", F.row_number().over(turn)).where("_turn = 1").drop("_turn", "_new")


def as_map(settings: DataFrame) -> DataFrame:
    """One row with all settings, of which there are as many as a person has made."""
    return settings.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings"))


def seed(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Insert rows whose key isn't there yet."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti").select(*table.columns))


def required(ids: DataFrame, prompts: DataFrame) -> DataFrame:
    """The distinct ids; reading one that no prompt has is an error."""
    held = prompts.select("id").distinct().withColumn("_held", F.lit(True))
    found = ids.select("id").distinct().join(held, "id", "left")
    return found.select(F.when(F.col("_held"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("Prompt not found: "), F.col("id"))).cast("string")).alias("id"))


def prompts_of(ids: DataFrame, prompts: DataFrame) -> DataFrame:
    """The prompts of these ids; an error if one is missing."""
    return prompts.join(required(ids, prompts), "id").select(*prompts.columns)


def without(prompts: DataFrame, ids: DataFrame) -> DataFrame:
    """prompts but for those of these ids; an error if one is missing."""
    return prompts.join(required(ids, prompts), "id", "left_anti")


def save_prompts(prompts: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Upsert by id: a change replaces the prompt of its id whole, a new one is added. updated_at becomes now, and created_at if it is missing in a new one.

    changes has a row per id, with a null id for a new prompt.
    """
    known = prompts.select("id", F.lit(True).alias("_known"))
    made = changes.withColumn("id", F.coalesce("id", F.uuid())).join(known, "id", "left")
    made = made.withColumn("updated_at", now).withColumn("created_at", F.when(F.col("_known"), F.col("created_at")).otherwise(F.coalesce("created_at", now)))
    return prompts.join(changes.select("id"), "id", "left_anti").select(*prompts.columns).unionByName(made.select(*prompts.columns))


def listing(prompts: DataFrame) -> DataFrame:
    """key, name, description of each prompt, and a line that shows them."""
    line = F.concat(F.format_string("  %-20s - ", "id"), "name", F.lit("\n" + " " * 25), "description")
    return prompts.select(F.col("id").alias("key"), "name", "description", line.alias("line"))


def exported(prompts: DataFrame) -> DataFrame:
    """path, json of each prompt: what another library can import, without id and times."""
    return prompts.select(F.concat("name", F.lit(".json")).alias("path"), F.to_json(F.struct("name", "description", "prompt_text")).alias("json"))


def duplicate(prompts: DataFrame, wanted: DataFrame) -> DataFrame:
    """prompts and copies of those in wanted (id, new_id, now), by the name of "... (copy)"; an error if one is missing."""
    copies = prompts.join(wanted.join(required(wanted, prompts), "id"), "id").select(F.col("new_id").alias("id"), F.concat("name", F.lit(" (copy)")).alias("name"), "description", "prompt_text", F.col("now").alias("created_at"), F.col("now").alias("updated_at"))
    return prompts.unionByName(copies)


def prompt_of(wanted: DataFrame, prompts: DataFrame, fallback: str = "basic") -> DataFrame:
    """wanted (key) with prompt_text of that id or name, else of the fallback; an error if neither is there."""
    by_key = prompts.select(F.explode(F.array_distinct(F.array("id", "name"))).alias("key"), "prompt_text").groupBy("key").agg(F.min("prompt_text").alias("prompt_text"))
    other = by_key.where(F.col("key") == fallback).select(F.col("key").alias("fallback"), F.col("prompt_text").alias("other"))
    rows = wanted.join(by_key, "key", "left").withColumn("fallback", F.lit(fallback)).join(F.broadcast(other), "fallback", "left")  # other: one row at most
    return rows.select("key", F.coalesce("prompt_text", "other", F.raise_error(F.concat(F.lit("no prompt "), F.col("key"))).cast("string")).alias("prompt_text"))


def default_prompt(prompts: DataFrame, wanted: str) -> DataFrame:
    """The id that is wanted, else the first."""
    return prompts.agg(F.coalesce(F.max(F.when(F.col("id") == wanted, F.col("id"))), F.min_by("id", "position")).alias("id"))


def admit_videos(files: DataFrame) -> DataFrame:
    """files (path, bytes) with ending, admitted, size_mb."""
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select("path", "bytes", ending.alias("ending"), ending.isin(*VIDEOS).alias("admitted"), F.round(F.col("bytes") / 1048576, 2).alias("size_mb"))


def admit_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (path) with what is known of the files (path, length): valid, error, filename, size_mb, extension; the last three are null unless valid.

    files come from tables.file_sizes(), which reads no content. A path that isn't among them is not found; only then its ending counts.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    known = files.select(plain("path").alias("_at"), F.col("length").alias("_bytes"))
    rows = wanted.withColumn("_at", plain("path")).join(known, "_at", "left")
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    error = F.when(F.col("_bytes").isNull(), NOT_FOUND).when(~ending.isin(*VIDEOS), INVALID_TYPE + ", ".join(VIDEOS))
    valid = error.isNull()
    name = F.regexp_extract("path", r"([^/]*)/*$", 1)
    return rows.select(*wanted.columns, valid.alias("valid"), error.alias("error"), F.when(valid, name).alias("filename"), F.when(valid, F.round(F.col("_bytes") / 1048576, 2)).alias("size_mb"), F.when(valid, ending).alias("extension"))


def with_results(jobs: DataFrame, transcripts: DataFrame) -> DataFrame:
    """jobs (output_path, stats_json) with the transcript's text and the parsed counters."""
    stats = F.from_json("stats_json", "chunks long, lines long, autoAccept long, needsReview long")
    return jobs.join(transcripts.select(F.col("path").alias("output_path"), "text"), "output_path", "left").withColumn("stats", stats)


def home_path(path: Column, home: str, default: str) -> Column:
    """A leading ~ as the home folder; the default for nothing."""
    return F.regexp_replace(F.coalesce(F.nullif(path, F.lit("")), F.lit(default)), "^~", home)
