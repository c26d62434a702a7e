"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A bucket compares its members with one centre. Whatever a star leaves open, as two members may be alike and the centre not,
is compared in blocks: documents that share open buckets are cut into blocks of bounded size, a task counts the common
shingles of two blocks as a product of matrices, and gives back a tree of links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscript.llm.common import IdFilter, discard, large_join, per_text, slices, table, unused, written
from tallyscript.llm.graph import components

#: Defaults of the operator: words in a shingle, and the least similarity of a link in percent.
SHINGLE, PERCENT = 5, 80
#: Bins of the one permutation, and of them rows in each of the bands: a link at 85 percent shares a bucket but for 8 in
#: 10 million, one at 80 percent but for 5 in 100,000.
BINS, ROWS, BANDS = 128, 5, 25
#: Documents and shingles of a block, about; two blocks meet in a task. Shingles in one product of matrices.
BLOCK_DOCUMENTS, BLOCK_SHINGLES, COLUMNS = 256, 1_000_000, 8192

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: of all words if they are fewer than size, of none without words."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total * MIX[0] + hashes[k : k + len(total)])
    return np.unique(total)


def donors(attempt: int, bins: int) -> np.ndarray:
    """For each bin, the one that it tries to borrow from: a hash of the bin and the attempt."""
    return (mixed(np.arange(bins, dtype=np.uint64) * MIX[3] + np.array([attempt + 1], np.uint64) * MIX[0]) % np.uint64(bins)).astype(np.intp)


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One-permutation minima of nonempty sets: the smallest hash in each bin, a bin being the hash's leading bits.

    An empty bin borrows from the first of its donors that is not empty (optimal densification).
    """
    low = np.arange(bins, dtype=np.uint64) << np.uint64(65 - bins.bit_length())
    least, full = np.zeros((len(sets), bins), np.uint64), np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, low)
        full[i] = at < np.append(at[1:], len(s))
        least[i, full[i]] = s[at[full[i]]]
    dense, empty, attempt = least.copy(), ~full, 0
    rows = np.flatnonzero(empty.any(1))
    while len(rows):
        give = donors(attempt, bins)
        r, k = np.nonzero(empty[rows] & full[rows][:, give])
        dense[rows[r], k] = least[rows[r], give[k]]
        empty[rows[r], k] = False
        rows, attempt = rows[empty[rows].any(1)], attempt + 1
    return dense


def bands_of(signature: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band of each signature."""
    total = np.full((len(signature), BANDS), 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        total = mixed(total * MIX[0] + signature[:, r : ROWS * BANDS : ROWS])
    return total


def fingerprint(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (128 bits over the whole set; null if empty), bands, of each row with an id."""

    def make(texts: list[bytes]) -> list[list]:
        sets = [shingle_hashes(t, shingle) for t in texts]
        some = [i for i, s in enumerate(sets) if len(s)]
        bands: list = [None] * len(sets)
        for i, row in zip(some, bands_of(signatures([sets[i] for i in some])).view(np.int64) if some else (), strict=True):
            bands[i] = row.tolist()
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return [[len(s) for s in sets], keys, bands]

    fields = pa.schema([("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return per_text(rows, "n_shingles long, set_key binary, bands array<long>", fields, make, keep=("doc_id", "text_hash"))


def shingle_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """doc_id and the whole set of shingle hashes of the rows whose ids are among ids (one column, doc_id).

    A filter of the ids leaves most texts where they are; the sets of the rest, no texts, are then joined with the ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(IdFilter(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pa.array(shared.value.maybe(batch.column(1).to_numpy(zero_copy_only=False))))
            for own, texts in slices([rows]) if rows.num_rows else ():
                sets = [shingle_hashes(t, shingle).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    hashed = docs.select("doc_id", F.xxhash64("doc_id").alias("h"), "text")
    found = hashed.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, shingles array<long>")
    return large_join(found, ids, "doc_id", "left_semi")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union, on whole sets."""
    both = large_join(pairs, sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    both = large_join(both, sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def star(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of each bucket's members and its centre, whose sizes allow a link.

    The centre is the member that shares most places with others over all its buckets: what most copies are alike to. So one
    document is the centre of most buckets of its group, and a member has few centres.
    """
    weights = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    weighed = large_join(members, written(weights, "weights"), "rep")
    centre = F.max_by(F.struct(F.col("rep").alias("a"), F.col("n").alias("size_a")), F.struct("weight", "rep"))
    centres = written(weighed.groupBy("bucket").agg(centre.alias("centre")).select("bucket", "centre.*"), "centres")
    joined = large_join(members, centres, "bucket").where("rep <> a")
    fit = 100 * F.least("size_a", "n") >= percent * F.greatest("size_a", "n")
    return joined.where(fit).select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()


def open_documents(members: DataFrame, labels: DataFrame) -> DataFrame:
    """rep, n, cluster of documents in buckets whose members are in several components; a cluster holds whole buckets."""
    labelled = members.join(labels, F.col("rep") == F.col("node"), "left").select("rep", "n", "bucket", F.coalesce("component", "rep").alias("component"))
    parted = labelled.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("rep").alias("first")).where("c0 < c1")
    parted = written(parted.select("bucket", "first"), "parted")
    rest = written(large_join(labelled, parted, "bucket").select("rep", "n", "first").distinct(), "open")
    clusters = components(rest.select(F.col("first").alias("a"), F.col("rep").alias("b")))
    return rest.select("rep", "n").distinct().join(clusters, F.col("rep") == F.col("node")).select("rep", "n", F.col("component").alias("cluster"))


def tree_of_links(ids: list, sets: list[np.ndarray], first: np.ndarray, percent: int) -> list[tuple]:
    """Links that join all linked documents of two blocks. first marks the one block; if it holds all, they are one."""
    sizes = np.array([len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # a shingle of one document is common to none
    row = np.repeat(np.arange(len(sets)), sizes)[shared]
    names, column = np.unique(column[shared], return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(names), COLUMNS):
        some = slice(*np.searchsorted(column, (at, at + COLUMNS)))
        part = np.zeros((len(sets), min(COLUMNS, len(names) - at)), np.float32)
        part[row[some], column[some] - at] = 1
        common += part @ part.T
    alike = 100 * common.astype(np.int64)
    alike = alike >= percent * (sizes[:, None] + sizes[None, :] - common.astype(np.int64))
    if not first.all():
        alike &= first[:, None] != first[None, :]
    root = np.arange(len(sets))
    links = []
    for a, b in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
        if root[a] != root[b]:
            links.append((ids[a], ids[b]))
            root[root == root[b]] = root[a]
    return links


def blockwise(documents: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join all linked documents of each cluster."""
    sizes = documents.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("shingles"))
    blocks = sizes.where("k > 1").select("cluster", F.greatest(F.ceil(F.col("k") / BLOCK_DOCUMENTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("blocks"))
    placed = documents.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("rep", "cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block")

    def run(group: pa.Table) -> pa.Table:
        ids, block = group.column("rep").to_pylist(), group.column("block").to_numpy()
        links = tree_of_links(ids, [x.values.to_numpy() for x in group.column("shingles")], block == group.column("lo")[0].as_py(), percent)
        kind = group.schema.field("rep").type
        return pa.table({"a": pa.array([x for x, _ in links], kind), "b": pa.array([x for _, x in links], kind)})

    kind = documents.schema["rep"].dataType.simpleString()
    return large_join(met, sets, "rep").groupBy("cluster", "lo", "hi").applyInArrow(run, f"a {kind}, b {kind}").distinct()


def placements(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, text_hash, set_key, n_shingles, component_id of each row with an id."""
    rows = docs.select("doc_id", "text").where("doc_id is not null")
    prints = written(fingerprint(rows, shingle), "prints")
    one = F.min(F.struct(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands")).alias("one")
    classes = written(prints.where("set_key is not null").groupBy("set_key").agg(one).select("set_key", "one.*"), "classes")
    members = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = written(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "shared")  # a written side, as Spark can then split a large bucket
    members = written(large_join(members, shared, "bucket"), "members")
    needed = written(members.select(F.col("rep").alias("doc_id")).distinct(), "needed")
    sets = written(shingle_sets(rows, needed, shingle).withColumnRenamed("doc_id", "rep"), "sets")

    links = written(linked(written(star(members, percent), "pairs"), sets, percent), "links")
    rest = written(open_documents(members, components(links)), "documents")
    labels = components(links.unionByName(written(blockwise(rest, sets, percent), "more")))
    discard(shared, members, sets)  # labels are written
    places = classes.select("set_key", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    placed = prints.select("doc_id", "text_hash", "n_shingles", "set_key").join(places, "set_key", "left")
    return placed.select("doc_id", "text_hash", "set_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs with an id: doc_id, n_shingles, component_id, kept.

    docs has doc_id and text; other columns are ignored. A set holds a document's distinct shingles of lower-case words.
    Documents of equal sets are one class, whose least doc_id stands for it from there on. Classes that share a bucket are
    candidates: each bucket compares its members with one centre, a star. Buckets whose members are then in several
    components are compared in blocks, so that no link within a bucket is lost. Comparisons are on whole sets.

    A null or empty text, or one of white space, has an empty set and no link: it is its own component. Rows with a null
    doc_id are left out. Rows that share a doc_id are one node: each is placed by its text, and the links of all count. An
    empty table gives no row.
    """
    return placements(docs, shingle, percent).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component, that of the least doc_id.

    Rows of one doc_id with the same set of shingles, repeated rows among them, are one document, and one of them stays; those
    with other sets stay beside it. A null or empty text has no copy but rows of its own doc_id and text. Rows with a
    null doc_id all stay. An empty table stays empty; all columns are kept, whatever their names.

    Only rows whose id a filter takes for one with something to drop are shuffled.
    """
    placed = written(placements(docs, SHINGLE, PERCENT), "placed")
    again = F.count("*").alias("n")
    of_set = placed.groupBy("doc_id", F.coalesce("set_key", F.lit(b"")).alias("set_key")).agg(again, F.min("text_hash").alias("text_hash"), F.min("component_id").alias("component_id"))
    judged = written(of_set, "judged")
    suspects = written(judged.where("n > 1 or doc_id <> component_id").select("doc_id").distinct(), "suspects")
    maybe = IdFilter(suspects).column("doc_id")
    hash_ = unused("text_hash", docs.columns)
    good = judged.where("doc_id = component_id").select("doc_id", F.col("text_hash").alias(hash_))
    rest = docs.where(maybe).withColumn(hash_, F.xxhash64("text")).dropDuplicates(["doc_id", hash_])
    return docs.where(~maybe).unionByName(large_join(rest, good, ["doc_id", hash_], "left_semi").select(*docs.columns))


#: Brute force over all pairs of distinct sets that share a shingle; components by repeated least labels.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS sh FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM n
  UNION
  SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node WHERE e.b > r.root
), c AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, w.doc_id) AS component_id, coalesce(c.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""
