"""Shared helpers: tables, the shared work folder, and slices of Arrow batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 2 << 20
#: Logarithm of the bits of a filter of ids at most (8 MB), and where in a hash its three places start.
FILTER_BITS, FILTER_SHIFTS = 26, (0, 19, 38)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. A session on one machine may name none; a cluster must."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/tallyscript-{uuid.uuid4().hex}/{name}"
    atexit.register(remove, spark, path.rsplit("/", 1)[0])
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of new_path(), if the session still runs."""
    if spark.sparkContext._jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and read again by whatever follows, also after a lost executor."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table_ = df.sparkSession.read.schema(df.schema).parquet(path)
    table_.written_path = path
    return table_


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.written_path.rsplit("/", 1)[0])


def unused(name: str, columns: list[str]) -> str:
    """name, with as many "_" as it takes to differ from all columns; case doesn't count, as in Spark."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def large_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input: never a broadcast, so that the plan is one and the same at every size."""
    return left.join(right.hint("merge"), on, how)


class IdFilter:
    """A Bloom filter of ids, FILTER_BITS at most: what it lets through is joined exactly, so a full one only saves nothing."""

    def __init__(self, ids: DataFrame):
        """ids: one column. The driver gets a row for each 64 bits that has a bit set."""
        self.size = size = min(FILTER_BITS, max(16, (12 * ids.count()).bit_length()))
        place = F.explode(F.array(*[F.shiftrightunsigned(F.col("h"), s).bitwiseAND(F.lit((1 << size) - 1)) for s in FILTER_SHIFTS]))
        places = ids.select(F.xxhash64(ids.columns[0]).alias("h")).select(place.alias("place"))
        bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
        rows = places.groupBy(F.shiftrightunsigned("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        self.words = np.zeros(1 << size - 6, np.int64)
        self.words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the ids with these values of xxhash64() may be among those of the filter."""
        hashes, found = hashes.astype(np.int64).view(np.uint64), np.ones(len(hashes), bool)
        for shift in FILTER_SHIFTS:
            place = (hashes >> np.uint64(shift)) & np.uint64((1 << self.size) - 1)
            found &= (self.words[place >> np.uint64(6)].view(np.uint64) >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found

    def column(self, name: str) -> Column:
        """maybe() of a column as an expression; only its hashes go to Python. A null is not among the ids."""
        shared = SparkSession.active().sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def among(hashes: pd.Series) -> pd.Series:
            return pd.Series(shared.value.maybe(hashes.to_numpy()))

        return F.col(name).isNotNull() & among(F.xxhash64(name))


def fold_remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the contract's split of held-out rows."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(modulus))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches of about SLICE_BYTES with their texts as UTF-8 bytes, null as empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > SLICE_BYTES:
                yield part(batch, column, start, i)
                start, held = i, 0
            held += int(size)
        if start < len(sizes):
            yield part(batch, column, start, len(sizes))


def part(batch: pa.RecordBatch, column: pa.Array, start: int, end: int) -> tuple[pa.RecordBatch, list[bytes]]:
    texts = column.slice(start, end - start).cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return batch.slice(start, end - start), [t or b"" for t in texts.to_pylist()]


def per_text(df: DataFrame, schema: str, fields: pa.Schema, score: Callable[[list[bytes]], list[list]], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Apply score to the texts in slices: the kept columns, then score's columns named by fields. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, text):
            got = [pa.array(values, field.type) for values, field in zip(score(texts), fields, strict=True)]
            own = [rows.column(i) for i in range(rows.num_columns) if rows.schema.names[i] in keep]
            names = [n for n in rows.schema.names if n in keep]
            yield pa.RecordBatch.from_arrays(own + got, names + fields.names)

    picked = df.select(*[c for c in keep], F.col(text))
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema.fields}
    return picked.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [schema]))
