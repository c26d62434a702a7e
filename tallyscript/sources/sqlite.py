"""SQLite tables as a Spark source and sink: reads by ranges of row numbers with conditions in the scan, writes that all hold or none.

The file lies in a folder that the driver and all executors mount. load() reads a table, and
df.write.format("sqlite").option("path", ...).option("table", ...).mode("append").save() writes to one after register(spark).
It is meant for the tables of a desktop's jobs and settings, which one file and one writer can hold. Rows pass between Spark and SQLite as
Arrow batches, and from file to file within SQLite, so that Python never touches a row at a time in the one task that commits.
Moments are stored as text in UTC, as SQLite's own CURRENT_TIMESTAMP is.

Conditions are an option of the source: Spark 4.1 lets a Python source take filters, but keeps those of one scan for later scans
of the same table (seen in a self-join, and in a count after a filter), which gives wrong rows.
"""

from __future__ import annotations

import datetime
import json
import os
import sqlite3
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

#: Statuses of a job, and the columns of the two tables; fixed values.
STATUSES = ("queued", "processing", "complete", "failed", "cancelled")
TABLES = {
    "jobs": "id INTEGER PRIMARY KEY AUTOINCREMENT, video_path TEXT NOT NULL, video_filename TEXT NOT NULL, video_duration_minutes REAL, prompt_name TEXT NOT NULL, config_json TEXT NOT NULL, "
    f"status TEXT NOT NULL CHECK (status IN {STATUSES}), output_path TEXT, stats_json TEXT, error_message TEXT, created_at DATETIME DEFAULT CURRENT_TIMESTAMP, started_at DATETIME, completed_at DATETIME",
    "settings": "key TEXT PRIMARY KEY, value TEXT NOT NULL, updated_at DATETIME DEFAULT CURRENT_TIMESTAMP",
}
KINDS = {"INTEGER": LongType(), "REAL": DoubleType(), "DATETIME": TimestampType()}
ARROW = {LongType(): pa.int64(), DoubleType(): pa.float64(), StringType(): pa.string(), TimestampType(): pa.timestamp("us", "UTC")}
#: Rows of a batch that a reader gives, row numbers of a range at most, files that a commit reads side by side (SQLite allows ten).
BATCH, RANGE, ATTACHED = 10_000, 1_000_000, 8
COMPARED = ("=", "<>", "<", "<=", ">", ">=")

Condition = tuple[str, str, object]


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def create(path: str) -> None:
    """The two tables, if they are not there."""
    os.makedirs(os.path.dirname(local(path)), exist_ok=True)
    with sqlite3.connect(local(path)) as db:
        for name, columns in TABLES.items():
            db.execute(f"CREATE TABLE IF NOT EXISTS {name} ({columns})")
    db.close()


def stored(column: pa.Array) -> list:
    """As SQLite keeps them: moments and days as text, moments with parts of a second if there are any."""
    kind = column.type
    if pa.types.is_date(kind):
        column = column.cast(pa.string())
    elif pa.types.is_timestamp(kind):
        fine = column.cast(pa.timestamp("us"))
        whole = pc.floor_temporal(fine, unit="second")
        column = pc.if_else(pc.equal(fine, whole), whole.cast(pa.timestamp("s")).cast(pa.string()), fine.cast(pa.string()))
    return column.to_pylist()


def moments(texts: Sequence[str | None]) -> pa.Array:
    """The reverse; other forms than SQLite's own are read one by one."""
    texts = [t or None for t in texts]
    try:
        return pa.array(texts, pa.string()).cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC"))
    except pa.ArrowInvalid:
        read = [t and datetime.datetime.fromisoformat(t) for t in texts]
        return pa.array([t and (t if t.tzinfo else t.replace(tzinfo=datetime.UTC)) for t in read], pa.timestamp("us", "UTC"))


def opened(path: str) -> sqlite3.Connection:
    """For reading only."""
    return sqlite3.connect(f"file:{quote(local(path))}?mode=ro", uri=True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)


def load(spark: SparkSession, path: str, table: str, where: Sequence[Condition] = (), partitions: int | None = None) -> DataFrame:
    """The rows of a table that meet all conditions (column, operator, value), read in `partitions` ranges of row numbers; eight, or as many as ranges of RANGE numbers need.

    Operators: those of COMPARED; "in" with a list; "starts" with a text; "null" with true or false. SQLite tests them before Spark sees a row.
    """
    register(spark)
    options = {"path": path, "table": table, "where": json.dumps(list(where))} | ({"partitions": str(partitions)} if partitions else {})
    return spark.read.format("sqlite").options(**options).load()


def tested(conditions: Sequence[Condition], columns: Sequence[str]) -> tuple[list[str], list[object]]:
    """Conditions as SQL, and the values for its marks."""
    tests, values = [], []
    for column, operator, value in conditions:
        if column not in columns:
            raise ValueError(f"no column {column}")
        name = quoted(column)
        if operator in COMPARED:
            tests.append(f"{name} {operator} ?")
            values.append(value)
        elif operator == "in":
            tests.append(f"{name} IN ({', '.join('?' * len(value))})")
            values.extend(value)
        elif operator == "starts":
            tests.append(f"substr({name}, 1, ?) = ?")
            values.extend([len(value), value])
        elif operator == "null":
            tests.append(f"{name} IS {'' if value else 'NOT '}NULL")
        else:
            raise ValueError(f"no operator {operator}")
    return tests, values


class SqliteSource(DataSource):
    """Options: path, table; for reads where (JSON of load()'s conditions), and partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        db = opened(self.options["path"])
        columns = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        db.close()
        if not columns:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return StructType([StructField(c[1], KINDS.get(c[2].upper(), StringType())) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SqliteWriter(dict(self.options), schema, overwrite)


@dataclass
class Rows(InputPartition):
    first: int
    stop: int


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.fields = options, schema.fields
        self.where, self.values = tested(json.loads(options.get("where", "[]")), schema.names)

    def partitions(self) -> list[InputPartition]:
        db = opened(self.options["path"])
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.options['table'])}").fetchone()
        db.close()
        if low is None:
            return []
        numbers = high - low + 1
        step = -(-numbers // int(self.options.get("partitions", max(8, -(-numbers // RANGE)))))
        return [Rows(first, min(first + step, high + 1)) for first in range(low, high + 1, step)]

    def batches(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        """part is None for a table without rows."""
        if part is None:
            return
        names = ", ".join(quoted(f.name) for f in self.fields)
        where = " AND ".join(["rowid >= ?", "rowid < ?", *self.where])
        kinds = [ARROW[f.dataType] for f in self.fields]
        db = opened(self.options["path"])
        rows = db.execute(f"SELECT {names} FROM {quoted(self.options['table'])} WHERE {where}", [part.first, part.stop, *self.values])
        while some := rows.fetchmany(BATCH):
            columns = [moments(c) if pa.types.is_timestamp(kind) else pa.array(c, kind) for c, kind in zip(zip(*some), kinds)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in self.fields])
        db.close()

    def read(self, part: Rows | None) -> Iterator[tuple]:
        for batch in self.batches(part):
            yield from zip(*(c.to_pylist() for c in batch.columns))


class BatchReader(SqliteReader):
    """The same rows for Spark, as the batches that they are read in."""

    def read(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        return self.batches(part)


@dataclass
class Staged(WriterCommitMessage):
    path: str


def merged(paths: list[str]) -> str:
    """The first of some staged files, with the rows of the others behind its own."""
    db = sqlite3.connect(paths[0], isolation_level=None)
    try:
        db.execute("PRAGMA journal_mode = OFF")
        db.execute("PRAGMA synchronous = OFF")
        for path in paths[1:]:
            db.execute("ATTACH ? AS other", (path,))
            db.execute("INSERT INTO main.staged SELECT * FROM other.staged ORDER BY rowid")
            db.execute("DETACH other")
            os.remove(path)
    finally:
        db.close()
    return paths[0]


class SqliteWriter(DataSourceArrowWriter):
    """Each task puts its rows into a file of its own beside the table; the commit moves them in one transaction, an abort deletes them.

    A commit is quickest if tasks hold ranges of the table's key in order, as pages are then filled one after the other.
    """

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.table, self.names, self.overwrite = local(options["path"]), options["table"], schema.names, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        path = f"{self.path}.{uuid.uuid4().hex}.staged"
        db = sqlite3.connect(path, isolation_level=None)
        db.execute("PRAGMA journal_mode = OFF")
        db.execute("PRAGMA synchronous = OFF")
        db.execute(f"CREATE TABLE staged ({', '.join(map(quoted, self.names))})")
        db.execute("BEGIN")
        for batch in batches:
            db.executemany(f"INSERT INTO staged VALUES ({', '.join('?' * len(self.names))})", zip(*map(stored, batch.columns)))
        db.execute("COMMIT")
        db.close()
        return Staged(path)

    def commit(self, messages: list[Staged | None]) -> None:
        """Rows of a key that is there replace it. If one row breaks a rule of the table, none is written.

        More files than may be attached at once are merged first, neighbours with neighbours, so that later rows still replace earlier ones.
        """
        paths = [m.path for m in messages if m is not None]
        each = -(-len(paths) // ATTACHED)
        columns = ", ".join(map(quoted, self.names))
        db = sqlite3.connect(self.path, isolation_level=None)
        try:
            if each > 1:
                with ThreadPoolExecutor(ATTACHED) as pool:
                    paths = list(pool.map(merged, [paths[k : k + each] for k in range(0, len(paths), each)]))
            for k, path in enumerate(paths):
                db.execute(f"ATTACH ? AS staged_{k}", (path,))
            db.execute("BEGIN IMMEDIATE")
            if self.overwrite:
                db.execute(f"DELETE FROM main.{quoted(self.table)}")
            for k in range(len(paths)):
                db.execute(f"INSERT OR REPLACE INTO main.{quoted(self.table)} ({columns}) SELECT * FROM staged_{k}.staged ORDER BY rowid")
            db.execute("COMMIT")
        except sqlite3.Error:
            if db.in_transaction:
                db.execute("ROLLBACK")
            raise
        finally:
            db.close()
            self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)
