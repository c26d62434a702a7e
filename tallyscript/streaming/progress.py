"""Progress lines of running jobs, parsed and folded to the latest state, in batch or as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Numbers of events that a part of a job's log spans.
PART = 100_000
#: How long a job that says nothing keeps its state, in milliseconds; the store that can hold lists and let them expire.
KEPT_MS = 7 * 24 * 3600 * 1000
#: State that may expire makes Spark run batches without lines for ever, so a query that is to end runs none.
STREAMING = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}

#: Fixed prefixes of event lines, and the fields of their JSON.
PREFIXES = {"progress": "PROGRESS:", "complete": "COMPLETE:", "error": "ERROR:", "log": "LOG:"}
FIELDS = "type string, chunk long, total long, percent long, status string, message string, level string, outputFile string, timestamp string, chunksProcessed long"


def parse(raw: DataFrame) -> DataFrame:
    """raw (job_id, seq, raw, source) to job_id, seq, kind, chunk, total, percent, status, chunks_processed, message, level.

    Blank lines and malformed JSON go; a line without a prefix is an info log, one of the error stream an error log.
    """
    line = F.trim("raw")
    kind = F.when(F.col("source") == "stderr", "log")
    body = F.lit(None).cast("string")
    for name, prefix in PREFIXES.items():
        kind = kind.when(line.startswith(prefix), name)
        body = F.when((F.col("source") != "stderr") & line.startswith(prefix), F.substring(line, len(prefix) + 1, 1 << 30)).otherwise(body)
    rows = raw.withColumn("line", line).withColumn("kind", kind.otherwise("plain")).withColumn("body", body).where("line <> ''")
    rows = rows.withColumn("event", F.from_json("body", FIELDS + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    rows = rows.where("body is null or (event is not null and event._corrupt is null)")
    plain = F.col("body").isNull()
    level = F.when(F.col("source") == "stderr", "error").when(plain, "info").otherwise(F.col("event.level"))
    return rows.select(
        "job_id", "seq", F.when(F.col("kind") == "plain", "log").otherwise(F.col("kind")).alias("kind"), *[F.col(f"event.{c}").alias(c) for c in ("chunk", "total", "percent", "status")], F.col("event.chunksProcessed").alias("chunks_processed"), F.when(plain, F.col("line")).otherwise(F.col("event.message")).alias("message"), level.alias("level")
    )


def exit_events(exits: DataFrame) -> DataFrame:
    """exits (job_id, seq, code) to error events for codes other than 0; none for a null code, which a signal leaves."""
    return exits.where("code <> 0").select("job_id", "seq", F.lit("error").alias("kind"), F.concat(F.lit("Process exited with code "), F.col("code").cast("string")).alias("message"))


#: Fixed texts: of a job before any progress, of progress without a status, of a completed job, its log entry, an error's beginning, a missing field.
WAITING, WORKING, DONE, DONE_ENTRY, ERROR_ENTRY, MISSING = "Initializing...", "Processing...", "Complete!", "Transcription completed successfully", "ERROR: ", "undefined"


def shown(events: DataFrame) -> DataFrame:
    """Events of parse() as they show: job_id, seq, moved (percent, status, chunk, total; null for those that move nothing), entry, outcome.

    Progress moves to its own figures, a completion to 100 percent with its chunks as both counts; each event adds an entry to the
    job's log, without the time of day that a screen puts before it.
    """
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    moved = lambda percent, status, chunk, total: F.struct(percent.alias("percent"), status.alias("status"), chunk.alias("chunk"), total.alias("total"))
    status, said = F.coalesce(F.nullif("status", F.lit("")), F.lit(WORKING)), lambda c: F.coalesce(c, F.lit(MISSING))
    progress = moved(none("percent"), status, none("chunk"), none("total"))
    complete = moved(F.lit(100).cast("long"), F.lit(DONE), none("chunks_processed"), none("chunks_processed"))
    kind = F.col("kind")
    return events.select(
        "job_id", "seq", F.when(kind == "progress", progress).when(kind == "complete", complete).alias("moved"),
        F.when(kind == "progress", said("status")).when(kind == "complete", DONE_ENTRY).when(kind == "error", F.concat(F.lit(ERROR_ENTRY), said("message"))).otherwise(said("message")).alias("entry"),
        F.when(kind.isin("complete", "error"), kind).alias("outcome"),
    )


def latest_state(events: DataFrame) -> DataFrame:
    """Each job's state after all its events: percent, status, chunk, total, n_logs, outcome (complete, error or null)."""
    rows = shown(events)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    state = rows.groupBy("job_id").agg(last("moved").alias("moved"), F.count("entry").alias("n_logs"), last("outcome").alias("outcome"))
    figure = lambda c, none: F.coalesce(f"moved.{c}", F.lit(none)).alias(c)
    return state.select("job_id", figure("percent", 0), figure("status", WAITING), figure("chunk", 0), figure("total", 0), "n_logs", "outcome")


def log_entries(events: DataFrame) -> DataFrame:
    """The jobs' logs, an entry a row: job_id, entry_no from 1, entry. Dealt by ranges, so that a job of many entries has many tasks.

    Entries are numbered within their part of a job, and parts by what the parts before hold.
    """
    rows = shown(events).select("job_id", "seq", "entry").withColumn("part", F.floor(F.col("seq") / PART))
    inside = rows.withColumn("k", F.row_number().over(Window.partitionBy("job_id", "part").orderBy("seq")))
    sizes = rows.groupBy("job_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("job_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inside.join(sizes.withColumn("before", before), ["job_id", "part"]).select("job_id", (F.col("before") + F.col("k")).alias("entry_no"), "entry")


def percent_done(chunk: Column, total: Column) -> Column:
    """Whole percent of chunks begun; 0 of none."""
    return F.coalesce(F.try_divide(chunk * 100, total).cast("int"), F.lit(0))


def from_text(lines: DataFrame) -> DataFrame:
    """Lines (raw) of tab-separated job, number, source and text to job_id, seq, source, raw."""
    part = lambda k: F.element_at(F.split("raw", "\t", 4), k)
    return lines.select(part(1).cast("long").alias("job_id"), part(2).cast("long").alias("seq"), part(3).alias("source"), part(4).alias("raw"))


def to_text(log: DataFrame) -> DataFrame:
    """The reverse: value."""
    return log.select(F.concat_ws("\t", "job_id", "seq", "source", "raw").alias("value"))


class LiveState(StatefulProcessor):
    """A job's figures as a value and its log as a list, both in Spark's state store, both gone KEPT_MS after the last change.

    Lines of one job may come in any order: a line moves the figures only if it has the highest number so far, and the log is put in
    order of numbers when it is shown. The list has an element for each batch with lines of the job, JSON of numbers and entries, as each
    element that Python puts into the store or gets from it costs a message to the JVM's state server.
    """

    FIGURES = "percent long, status string, chunk long, total long, moved_seq long, outcome string, outcome_seq long"
    OUT = "job_id long, percent long, status string, chunk long, total long, n_logs long, outcome string, log array<string>"

    def __init__(self, kept_ms: int = KEPT_MS):
        self.kept_ms = kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.figures = handle.getValueState("figures", self.FIGURES, self.kept_ms)
        self.log = handle.getListState("log", "entries string", self.kept_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.figures.exists()  # else there is no log either, as both are renewed together
        held = self.figures.get() if known else (0, WAITING, 0, 0, -1, None, -1)
        percent, status, chunk, total, moved_seq, outcome, outcome_seq = held
        fresh = []
        for r in rows:
            fresh.append((r.seq, r.entry))
            if r.status is not None and r.seq > moved_seq:
                percent, status, chunk, total, moved_seq = r.percent, r.status, r.chunk, r.total, r.seq
            if r.outcome is not None and r.seq > outcome_seq:
                outcome, outcome_seq = r.outcome, r.seq
        self.figures.update((percent, status, chunk, total, moved_seq, outcome, outcome_seq))
        entries = [e for part in self.log.get() for e in json.loads(part[0])] if known else []
        self.log.appendValue((json.dumps(fresh),))
        log = [entry for _, entry in sorted([*map(tuple, entries), *fresh])]
        yield Row(job_id=key[0], percent=percent, status=status, chunk=chunk, total=total, n_logs=len(log), outcome=outcome, log=log)

    def close(self) -> None:
        pass


def follow(raw: DataFrame, checkpoint: str, path: str, kept_ms: int = KEPT_MS):
    """Start a query that keeps LiveState of a stream of raw lines: after each batch the jobs that changed, as Parquet below path, a folder a batch.

    It reads what is there and ends; started again with the same checkpoint, it goes on from the state that it left.
    """

    def keep(state: DataFrame, batch: int) -> None:
        state.write.mode("overwrite").parquet(f"{path}/batch={batch:09d}")

    spark = raw.sparkSession
    before = {k: spark.conf.get(k) for k in STREAMING}
    for k, v in STREAMING.items():
        spark.conf.set(k, v)
    try:
        rows = shown(parse(raw)).select("job_id", "seq", "moved.*", "entry", "outcome")
        state = rows.groupBy("job_id").transformWithState(LiveState(kept_ms), LiveState.OUT, "Update", "ProcessingTime")
        return state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def followed(spark: SparkSession, path: str) -> DataFrame:
    """Each job's state as follow() left it last."""
    states = spark.read.parquet(path)
    own = [c for c in states.columns if c not in ("job_id", "batch")]
    last = F.max_by(F.struct(*own), "batch").alias("last")
    return states.groupBy("job_id").agg(last).select("job_id", "last.*")
