"""Sharding by size-tiered compaction: small immutable shards, merged into target-sized files under versioned manifests.

A store is a folder: `data` holds batches of immutable Parquet files, one a shard; `manifest/version=N` lists the shards that
make up version N. A version is written beside the others and then renamed into place, which fails if another writer took the
number; readers see a whole version or none. Arrivals add small shards. As soon as a tier holds FANOUT shards of like size, runs
of them are merged, up to the target size; so a row is rewritten once for each tier that it climbs. DataFrame functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscript.llm.common import new_path, table, unused

#: Bytes of a merged file; shards whose sizes are within a factor FANOUT are of one tier, and so many of a tier start a merge; shards that one window orders.
TARGET_BYTES, FANOUT, LANE_SHARDS = 32 << 20, 4, 4096
#: Bytes of text of an arriving shard, about, whatever the read split: far under the target. Arrivals that a table is taken for.
ARRIVAL_BYTES, ARRIVALS = 8 << 20, 4
#: Smallest tier.
LEAST_BYTES = 64 << 10
#: Rows of a manifest up to which it is broadcast (some 200 bytes each); a longer one is joined by shuffles.
BROADCAST_SHARDS = 50_000

#: shard is the name within the store, the same for the same input; file is where its rows are.
MANIFEST = "shard string, batch string, file string, bytes long, rows long, tier int"


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def version(self) -> int:
        """The latest committed version; 0 for none."""
        root = self.path("manifest")
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = files.listStatus(root) if files.exists(root) else []
        return max([0, *(int(s.getPath().getName()[8:]) for s in found if s.getPath().getName().startswith("version="))])

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/version={version}")

    def commit(self, shards: DataFrame, version: int, about: int = 0) -> None:
        """Put the manifest, of about so many rows, in its place in one step; an error if the version exists by then."""
        part = f"part-{uuid.uuid4().hex}"
        shards.coalesce(1 + about // 100_000).write.parquet(f"{self.folder}/manifest/.{part}")
        jvm, rename = self.spark._jvm, getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("manifest").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self.path(f"manifest/.{part}"), self.path(f"manifest/version={version}"), self.spark.sparkContext._gateway.new_array(rename, 0))

    def file(self) -> Column:
        """Where the row at hand is, below data."""
        return F.substring_index(F.col("_metadata.file_path"), f"{self.folder.rsplit('/', 1)[-1]}/data/", -1)

    def listed(self, batch: str, schema) -> DataFrame:
        """A manifest's rows for a batch just written."""
        files = self.rows([batch], schema)
        found = files.groupBy(self.file().alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        name = F.regexp_replace("file", r"-[0-9a-f]{32}|-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|\.zstd\.parquet$", "")  # without the writers' own ids
        return found.select(name.alias("shard"), F.lit(batch).alias("batch"), "file", "bytes", "rows", tier("bytes").alias("tier"))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        shards = self.manifest(version)
        rows = self.files(shards)
        if rows is None:
            return self.spark.createDataFrame([], self.spark.read.parquet(f"{self.folder}/schema").schema)
        file_ = unused("_file", rows.columns)
        return rows.withColumn(file_, self.file()).join(bounded(shards.select(F.col("file").alias(file_)), shards.count()), file_, "left_semi").drop(file_)

    def rows(self, paths: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{self.folder}/data/{p}" for p in paths])

    def files(self, shards: DataFrame) -> DataFrame | None:
        """The rows of some shards and perhaps of others of their batches, to be told by file(); None without any shard.

        A batch is read as a folder where half of its shards or more are wanted. So the driver gets a row per batch, and a
        name per shard only of batches of which fewer are wanted: what merges have left over.
        """
        schema = self.spark.read.parquet(f"{self.folder}/schema").schema
        wanted = shards.groupBy("batch").agg(F.count("*").alias("wanted"))
        of_batches = {r["batch"]: r["wanted"] for r in wanted.collect()}
        if not of_batches:
            return None
        whole = [b for b, n in of_batches.items() if 2 * n >= self.size_of(b)]
        rest = shards.where(~F.col("batch").isin(whole)) if whole else shards
        paths = whole + [r["file"] for r in rest.select("file").collect()] if len(whole) < len(of_batches) else whole
        return self.rows(paths, schema)

    def size_of(self, batch: str) -> int:
        """Shards that a batch was written with."""
        root = self.path(f"data/{batch}")
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(root).getFileCount() - 1  # but for the mark of success

    def append(self, docs: DataFrame, per_shard: int) -> int:
        """Write docs as they arrive, shards of `per_shard` rows at most, without a shuffle; commit and return the version that holds them."""
        version = self.version() + 1
        batch = f"arrival-{version:06d}-{uuid.uuid4().hex}"
        if version == 1:
            docs.limit(0).write.mode("ignore").parquet(f"{self.folder}/schema")
        docs.write.option("compression", "zstd").option("maxRecordsPerFile", per_shard).parquet(f"{self.folder}/data/{batch}")
        held = self.manifest(version - 1)
        self.commit(held.unionByName(self.listed(batch, docs.schema)), version, held.count() if version > 1 else 0)
        return version

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
        """Merge each tier that holds `fanout` shards or more into files of up to target bytes, as long as there is one; return the version.

        A tier is cut into runs of neighbours by name. A run of fewer than fanout shards waits, unless it fills a file. Old
        files stay for readers of old versions.
        """
        while self.merge(target, fanout):
            pass
        return self.version()

    def merge(self, target: int, fanout: int) -> bool:
        """Merge what is due, commit, and tell whether anything was."""
        version = self.version()
        shards = self.manifest(version)
        n = shards.count()
        runs = merge_runs(shards, n, target, fanout)
        found = runs.agg(F.max("run").alias("last"), F.count("*").alias("members")).first()
        if not found["members"]:
            return False
        n_runs, members = found["last"] + 1, found["members"]
        batch = f"merged-{version + 1:06d}-{uuid.uuid4().hex}"
        rows = self.files(shards.join(runs.select("shard"), "shard", "left_semi"))
        schema, columns = rows.schema, rows.columns
        file_, run_, key_ = (unused(n, columns) for n in ("_file", "run", "_key"))
        keys = task_keys(self.spark, n_runs)
        numbered = runs.join(bounded(keys, n_runs), F.col("run") == F.col("task"))
        plan = numbered.select(F.col("file").alias(file_), F.col("run").alias(run_), F.col("key").alias(key_))
        moved = rows.withColumn(file_, self.file()).join(bounded(plan, members), file_).drop(file_)
        moved.repartition(n_runs, key_).drop(key_).write.option("compression", "zstd").partitionBy(run_).parquet(f"{self.folder}/data/{batch}")
        kept = shards.join(runs.select("shard"), "shard", "left_anti").select(*shards.columns)
        self.commit(kept.unionByName(self.listed(batch, schema)), version + 1, n)
        return True


def bounded(plan: DataFrame, n: int) -> DataFrame:
    """plan, n rows, one a shard, to be broadcast if it is short; else both sides of a join are shuffled."""
    return F.broadcast(plan) if n <= BROADCAST_SHARDS else plan


def rows_of(docs: DataFrame, size: int) -> int:
    """Rows of docs that have about so many bytes of text; at least one."""
    about = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    return max(1, size * about["rows"] // max(1, about["bytes"]))


def merge_runs(shards: DataFrame, n: int, target: int, fanout: int) -> DataFrame:
    """shard, file, run of the shards of a manifest of n rows that are due to be merged, runs being numbered from 0.

    In each lane of a tier, shards under the target follow each other by name; a run ends where it reaches the target. It is
    due if it has `fanout` shards, or two that fill a file.
    """
    small = shards.where(F.col("bytes") < target).withColumn("lane", F.pmod(F.xxhash64("shard"), F.lit(1 + n // LANE_SHARDS)))
    before = Window.partitionBy("tier", "lane").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = small.withColumn("part", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / F.lit(target)))
    of_run = runs.groupBy("tier", "lane", "part").agg(F.count("*").alias("members"), F.sum("bytes").alias("size"))
    due = of_run.where((F.col("members") >= fanout) | (F.col("members") > 1) & (F.col("size") >= target))
    numbered = due.withColumn("run", (F.row_number().over(Window.orderBy("tier", "lane", "part")) - 1).cast("int"))  # a row per run
    return runs.join(numbered.select("tier", "lane", "part", "run"), ["tier", "lane", "part"]).select("shard", "file", "run")


def task_keys(spark: SparkSession, n: int) -> DataFrame:
    """(task, key): for each of n tasks a key that repartition(n, key) deals to it alone."""
    tried = spark.range(n * (12 + n.bit_length())).select(F.col("id").alias("key"))
    first = tried.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("task")).agg(F.min("key").alias("key"))
    missing = spark.range(n).select(F.col("id").cast("int").alias("task")).join(first, "task", "left")
    return missing.select("task", F.coalesce("key", F.col("task").cast("long")).alias("key"))  # a task without one shares


def tier(size: str):
    """0 up to LEAST_BYTES, then one more for each factor FANOUT."""
    return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.col(size), F.lit(1)) / F.lit(float(LEAST_BYTES))) / F.log(F.lit(float(FANOUT))))).cast("int")


def shard(docs: DataFrame, folder: str, target: int = TARGET_BYTES, arrivals: int = ARRIVALS) -> DataFrame:
    """Append docs to the store at folder in some arrivals, compact it after each, and return a row per stored row.

    The rows: doc_id, shard, shard_rows, shard_bytes, tier, version, text_crc32. docs has doc_id and text, and any other
    columns, which are stored too, whatever their names. A document's arrival follows from the hash of its id; all null ids
    arrive together. Nulls, empty and long texts and repeated rows are stored as they are (text_crc32 of a null is
    null). An empty table gives empty versions.
    """
    store, per_shard = ShardStore(docs.sparkSession, folder), rows_of(docs, ARRIVAL_BYTES)
    for k in range(arrivals):
        store.append(docs.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(arrivals)) == k), per_shard)
        store.compact(target)
    version = store.version()
    n = store.manifest(version).count()
    about = store.manifest(version).select("file", "shard", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "tier")
    rows = store.files(store.manifest(version))
    if rows is None:
        stored = docs.limit(0).select("doc_id", F.lit("").alias("file"), "text")
    else:
        stored = rows.select("doc_id", store.file().alias("file"), "text")
    joined = stored.select("doc_id", "file", F.crc32(F.col("text").cast("binary")).alias("text_crc32")).join(bounded(about, n), "file")
    return joined.select("doc_id", "shard", "shard_rows", "shard_bytes", "tier", F.lit(version).alias("version"), "text_crc32")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), new_path(spark, "shards"))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Store the documents in shards; a row per stored row, as shard() has it for nulls, repeated rows and empty tables."""
    return shard(docs, new_path(spark, "shards"))
