"""Live state of jobs: completion, log, order, and a restart from the checkpoint."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyscript.sources.tables import event_lines
from tallyscript.streaming import progress

LOG = [
    (1, 1, "stdout", 'PROGRESS:{"chunk":3,"total":12,"percent":25,"status":"s"}'),
    (1, 2, "stderr", "PROGRESS:a warning"),
    (1, 3, "stdout", 'COMPLETE:{"type":"complete","chunksProcessed":12}'),
    (2, 1, "stdout", 'PROGRESS:{"chunk":1,"total":4}'),
    (2, 2, "stdout", 'ERROR:{"message":"no model"}'),
    (2, 3, "stdout", 'ERROR:{"mess'),
    (3, 1, "stdout", "starting"),
    (4, 1, "stdout", 'COMPLETE:{"type":"complete"}'),
    (4, 2, "stdout", 'PROGRESS:{"chunk":1,"total":2,"percent":50,"status":""}'),
    (4, 3, "stdout", 'LOG:{"level":"info"}'),
]
WANT = {
    1: (100, "Complete!", 12, 12, 3, "complete", ["s", "PROGRESS:a warning", "Transcription completed successfully"]),
    2: (0, "Processing...", 1, 4, 2, "error", ["undefined", "ERROR: no model"]),
    3: (0, "Initializing...", 0, 0, 1, None, ["starting"]),
    4: (50, "Processing...", 1, 2, 3, "complete", ["Transcription completed successfully", "", "undefined"]),
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "job_id long, seq long, source string, raw string")


def test_batch_state_and_log(spark):
    events = progress.parse(frame(spark, LOG))
    logs = {}
    for r in progress.log_entries(events).orderBy("job_id", "entry_no").collect():
        logs.setdefault(r.job_id, []).append(r.entry)
        assert r.entry_no == len(logs[r.job_id])
    got = {r.job_id: (r.percent, r.status, r.chunk, r.total, r.n_logs, r.outcome, logs[r.job_id]) for r in progress.latest_state(events).collect()}
    assert got == WANT


def test_log_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(progress, "PART", 7)
    rows = [(j, s, "stdout", f"line {s}") for j in (1, 2) for s in range(100) if (s + j) % 5]
    random.Random(1).shuffle(rows)
    got = {(r.job_id, r.entry_no): r.entry for r in progress.log_entries(progress.parse(frame(spark, rows))).collect()}
    assert got == {(j, k + 1): f"line {s}" for j in (1, 2) for k, s in enumerate(s for s in range(100) if (s + j) % 5)}


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Two starts over the lines in disorder give the state of one batch: figures, outcome and the log in order."""
    lines, state, checkpoint = (f"{tmp_path}/{n}" for n in ("lines", "state", "checkpoint"))
    rows = LOG[:]
    random.Random(4).shuffle(rows)
    store = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(store)
    for part in (rows[:4], rows[4:]):
        progress.to_text(frame(spark, part)).write.mode("append").text(lines)
        progress.follow(progress.from_text(event_lines(spark, lines)), checkpoint, state).awaitTermination()
    got = {r.job_id: (r.percent, r.status, r.chunk, r.total, r.n_logs, r.outcome, r.log) for r in progress.followed(spark, state).collect()}
    assert got == WANT and spark.conf.get(store) == held
    changed = spark.read.parquet(state).where("batch > 0").select("job_id").distinct()
    assert {r.job_id for r in changed.collect()} == {r[0] for r in rows[4:]}  # update mode: a batch holds the jobs that changed
    assert spark.read.parquet(state).agg(F.max("batch")).first()[0] == 1


def test_state_expires(spark, tmp_path):
    """A job that says nothing for longer than its state is kept starts anew."""
    lines, state, checkpoint = (f"{tmp_path}/{n}" for n in ("lines", "state", "checkpoint"))
    for part in (LOG[:1], LOG[1:2]):
        progress.to_text(frame(spark, part)).write.mode("append").text(lines)
        progress.follow(progress.from_text(event_lines(spark, lines)), checkpoint, state, kept_ms=1).awaitTermination()
    last = progress.followed(spark, state).first()
    assert (last.percent, last.n_logs, last.log) == (0, 1, ["PROGRESS:a warning"])


def test_a_batch_is_one_element_of_a_log():
    """However many lines of a job a batch has, the store gets one element; later batches put their entries in order among the earlier ones."""

    class Held:
        def __init__(self):
            self.values, self.calls = [], 0

        def exists(self):
            return bool(self.values)

        def get(self):
            return iter(self.values) if isinstance(self.values, list) else self.values

        def appendValue(self, value):  # noqa: N802
            self.values.append(value)
            self.calls += 1

        def appendList(self, values):  # noqa: N802
            self.values += values
            self.calls += len(values)

        def update(self, value):
            self.values = value

    live = progress.LiveState()
    live.figures, live.log = Held(), Held()
    line = lambda k: Row(seq=k, percent=k, status="s", chunk=1, total=2, entry=f'"é\n{k}', outcome=None)
    for some in (range(999, 0, -2), range(0, 1000, 2)):
        (shown,) = live.handleInputRows((1,), iter([line(k) for k in some]), None)
    assert live.log.calls == 2 and shown.n_logs == 1000 and shown.percent == 999 and shown.log == [f'"é\n{k}' for k in range(1000)]
