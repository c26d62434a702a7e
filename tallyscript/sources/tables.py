"""Sources: the given tables, transcripts, prompt libraries and job files."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscript.sources.shared import at

#: How Spark names the folder of a null.
NULL = "__HIVE_DEFAULT_PARTITION__"
#: Text that a task gathers before it hands it on.
READ_BYTES = 4 << 20
PROMPT = "struct<name string, description string, prompt string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """All files below folder, without their content: path, length. Spark passes over empty files, so they are not among them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of running jobs' output as a stream: raw."""
    return spark.readStream.text(path).withColumnRenamed("value", "raw")


def prompt_library(texts: DataFrame) -> DataFrame:
    """texts (text), JSON of either form, to id, name, description, prompt_text; nothing for malformed JSON.

    A map of key to {name, description, prompt}, or {"prompts": [{id, name, description, prompt_text}]}.
    """
    listed = F.from_json("text", "prompts array<struct<id string, name string, description string, prompt_text string>>")["prompts"]
    mapped = F.from_json("text", "map<string, struct<name string, description string, prompt string>>")
    rows = texts.select(listed.alias("listed"), mapped.alias("mapped"))
    a = rows.where("listed is not null").select(F.explode("listed").alias("p")).select("p.*")
    b = rows.where("listed is null and mapped is not null").select(F.explode("mapped").alias("id", "p")).select("id", "p.name", "p.description", F.col("p.prompt").alias("prompt_text"))
    return a.unionByName(b)


def importable(prompts: DataFrame) -> DataFrame:
    """Prompts that have a name and a text."""
    return prompts.where("name <> '' and prompt_text <> ''")


def numbered_lines(texts: DataFrame) -> DataFrame:
    """texts (..., text) with a row for each line, in place of text: line_no, line."""
    return texts.select(*[c for c in texts.columns if c != "text"], F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def write_transcripts(rows: DataFrame, path: str, by: tuple[str, ...], order: tuple[str, ...]) -> None:
    """Sink: a text file for each value of `by`, alone in its folder, with the rows' `line` in the order of `order`.

    Rows are dealt by `by`, so that one task writes a whole file, and are sorted there before they are written; a file is never
    held in memory. A null counts as a value. Columns of `by` are numbers.

    Tasks write through pyarrow, as Spark's own writer renames each file in the driver and, on a local disk, starts a process for
    each folder and file to set its rights. There are as many tasks as shuffles have, however few bytes the files hold. A file gets its name when it is whole.
    """
    at(path)[0].create_dir(at(path)[1], recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = at(path)
        key, file, n = None, None, 0
        part = f"{uuid.uuid4().hex}.txt"

        def finish() -> None:
            file.close()
            folder = f"{root}/{'/'.join(key)}"
            store.move(f"{folder}/.{part}", f"{folder}/part-0.txt")

        for batch in batches:
            *keys, lines = (column.to_pylist() for column in batch.columns)
            for *values, line in zip(*keys, lines):
                names = [f"{c}={NULL if v is None else v}" for c, v in zip(by, values)]
                if names != key:
                    if file:
                        finish()
                    key, n = names, n + 1
                    folder = f"{root}/{'/'.join(key)}"
                    store.create_dir(folder, recursive=True)
                    file = store.open_output_stream(f"{folder}/.{part}")
                file.write(((line or "") + "\n").encode())
        if file:
            finish()
        yield pa.RecordBatch.from_pydict({"files": [n]})

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, *by).sortWithinPartitions(*by, *order)
    dealt.select(*by, "line").mapInArrow(put, "files long").write.format("noop").mode("overwrite").save()


def read_transcripts(spark: SparkSession, path: str, by: tuple[str, ...]) -> DataFrame:
    """What write_transcripts() wrote, a row a file: by, text (without the last line's end). No rows if it wrote none.

    Tasks list the folders, a level after the other, and read the files through pyarrow, as Spark's own reader lists every folder and file in
    the driver, whose memory then grows with their number, and takes a task for some 32 files. Names in one folder are listed by one task.
    """

    def inside(store: pyarrow.fs.FileSystem, root: str, folder: str) -> Iterator[str]:
        """The names in a folder below root, less hidden ones, as Spark passes over them."""
        found = store.get_file_info(pyarrow.fs.FileSelector(f"{root}{folder}"))
        return (f"{folder}/{f.base_name}" for f in found if not f.base_name.startswith((".", "_")))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = at(path)
        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            names = inside(store, root, folder)
            while some := list(itertools.islice(names, 10_000)):
                yield pa.RecordBatch.from_pydict({"name": some})

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = pa.schema([*((c, pa.int64()) for c in by), ("value", pa.string())])
        return pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(zip(*rows), kinds)], schema=kinds)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = at(path)
        rows, held = [], 0
        for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
            pairs = [name.split("=", 1) for name in folder.split("/")[1:]]
            if [c for c, *_ in pairs] != list(by):
                raise ValueError(f"{root}{folder} is not a folder of {', '.join(by)}")
            key = [None if value == NULL else int(value) for _, value in pairs]
            for name in inside(store, root, folder):
                with store.open_input_stream(f"{root}{name}") as file:
                    rows.append((*key, file.read()))
                held += len(rows[-1][-1])
                if held >= READ_BYTES or len(rows) == 10_000:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = spark.range(0, 1, 1, 1).select(F.lit("").alias("name"))
    for _ in by:
        names = names.mapInArrow(listed, "name string").repartition(tasks, "name")
    files = names.mapInArrow(texts, ", ".join([*(f"{c} long" for c in by), "value string"]))
    return files.select(*by, F.expr("substring(value, 1, length(value) - 1)").alias("text"))


def write_summaries(rows: DataFrame, path: str) -> None:
    """Sink: a JSON object per row."""
    rows.write.json(path)


def read_summaries(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
