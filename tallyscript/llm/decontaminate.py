"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in document words."""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscript.llm.common import discard, slices, table, unused, written

#: Words in a window.
WINDOW = 10
#: Bytes of benchmark text that one search holds, some 125 times as many bytes of memory; a larger benchmark is searched for in blocks of items.
PATTERN_BYTES = 2 << 20

#: Bytes of words are 0-9, a-z and all beyond ASCII, once A-Z are lower case.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WuManber:
    """Patterns of one length in words. The block that shifts and selects is the last two words under the window.

    shift tells how far the window may move when a block ends it; 0 where the block ends a pattern. ending holds, by
    block and then by first word, the patterns with that suffix, which are compared with the text word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ending: dict[tuple[bytes, ...], dict[bytes, list[tuple[bytes, ...]]]] = defaultdict(lambda: defaultdict(list))
        for p in patterns:
            for end in range(self.block, length + 1):
                block = p[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.ending[p[-self.block :]][p[0]].append(p)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(position of the first word, pattern) of each occurrence."""
        end, block, far, shift, length = self.length, self.block, self.far, self.shift, self.length
        n = len(words)
        while end <= n:
            suffix = tuple(words[end - block : end])
            move = shift.get(suffix, far)
            if move:
                end += move
                continue
            start = end - length
            for p in self.ending[suffix].get(words[start], ()):
                if all(a == b for a, b in zip(p, words[start:end], strict=True)):
                    yield start, p
            end += 1


class Windows:
    """All windows of some items, by length, and the items that hold each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            words = tuple(words_of(text))
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                by_length[size][words[i : i + size]].append(item)
        self.items = {p: i for found in by_length.values() for p, i in found.items()}
        self.searches = [WuManber(found, size) for size, found in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Stretches of words in occurrences, and items with an occurrence."""
        spans, items = [], set()
        for search in self.searches:
            for start, p in search.search(words):
                spans.append((start, start + search.length))
                items.update(self.items[p])
        return merged(spans), items


class Items:
    """Items to be sent out; each Python worker makes their windows once."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.items, self.window = items, window

    def __getstate__(self) -> dict:
        return {"items": self.items, "window": self.window}

    @functools.cached_property
    def windows(self) -> Windows:
        return Windows(self.items, self.window)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def blocks_of(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about limit bytes; the driver holds one at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).where("item_id is not null and text is not null").toLocalIterator():
        if held and size + len(row[1]) > limit:
            yield held
            held, size = [], 0
        held.append((row[0], bytes(row[1])))
        size += len(row[1])
    yield held


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. A null text has no words; items
    without words, with a null id or text match nothing; an item of fewer words than window is one window. Repeated
    items all count, repeated rows and null doc_ids give a row each. With an empty benchmark nothing is hit. The
    windows of pattern_bytes of items go to each task; the documents are searched without a shuffle. A larger benchmark is
    searched for block by block, and what the blocks hit is united by row.
    """
    blocks = blocks_of(benchmark, pattern_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        found = searched(docs.select("doc_id", "text"), first, window)
        return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    rows = docs.select(F.struct("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")).alias("doc_id"), "text")
    parts = [written(searched(rows, block, window), "hits") for block in itertools.chain((first, second), blocks)]
    united = parts[0]
    for other in parts[1:]:
        united = united.unionByName(other)
    # rows of the same id and text have the same hits: n of each, as every block reports every row once
    whole = united.groupBy("doc_id").agg(F.first("n_words").alias("n_words"), (F.count("*") / len(parts)).cast("int").alias("n"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s[0], s[1] - 1)))))
    return whole.select(
        F.col("doc_id.doc_id").alias("doc_id"), "n_words", F.when(F.size("spans") > 0, hit).otherwise(0).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("one")
    ).drop("one")


#: Names of what searched() adds.
FOUND = ("n_words", "n_hit", "items", "spans")


def searched(rows: DataFrame, items: list[tuple[str, bytes]], window: int, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, ...] = FOUND) -> DataFrame:
    """The kept columns of rows, and what their texts hold of the windows of some items, under FOUND's or other names."""
    shared = rows.sparkSession.sparkContext.broadcast(Items(items, window))
    text = unused("text", list(keep))
    picked = rows.select(*keep, F.col("text").alias(text))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value.windows
        for part, texts in slices(batches, text):
            n_words, hits, which_items, spans = [], [], [], []
            for raw in texts:
                words = words_of(raw)
                found, which = windows.find(words)
                n_words.append(len(words))
                hits.append(sum(e - s for s, e in found))
                which_items.append(sorted(which))
                spans.append([[s, e] for s, e in found])
            own = [part.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(own + [pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), pa.array(which_items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int32())))], [*keep, *names])

    types = ("long", "long", "array<string>", "array<array<int>>")
    return picked.mapInArrow(run, ", ".join(kinds + [f"`{n}` {t}" for n, t in zip(names, types, strict=True)]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of a benchmark item occurs; others keep all their columns, whatever their names.

    A benchmark of several blocks is searched for block by block; what each leaves is written, so that one block's windows are in
    memory at a time.

    Null and empty texts hold no window and stay, as do repeated rows and rows with a null id. An empty table stays empty.
    """
    columns = docs.columns
    names = tuple(unused(n, columns) for n in FOUND)
    kept, held = docs, None
    for number, block in enumerate(blocks_of(table(spark, sf_dir, "benchmark"), PATTERN_BYTES)):
        if number:
            fresh = written(kept, "clean")
            if held is not None:
                discard(held)
            kept = held = fresh
        kept = searched(kept, block, WINDOW, tuple(columns), names).where(F.col(names[1]) == 0).select(*columns)
    return kept


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), item AS (
  SELECT id, words, least(10, len(words)) AS m FROM w WHERE kind = 'b' AND len(words) > 0
), pattern AS (
  SELECT DISTINCT id AS item_id, m, array_to_string(words[i : i + m - 1], ' ') AS p FROM (SELECT id, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM item)
), size AS (
  SELECT DISTINCT m FROM pattern
), place AS (
  SELECT w.id, size.m, unnest(range(1, len(words) - m + 2)) AS i, words FROM w, size WHERE kind = 'd' AND len(words) >= m
), found AS (
  SELECT place.id, place.i, place.m, pattern.item_id FROM (SELECT id, m, i, array_to_string(words[i : i + m - 1], ' ') AS p FROM place) place JOIN pattern USING (m, p)
), hit AS (
  SELECT id, count(DISTINCT pos) AS n_hit FROM (SELECT id, unnest(range(i, i + m)) AS pos FROM found) GROUP BY id
), items AS (
  SELECT id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM found GROUP BY id
)
SELECT w.id AS doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit ON hit.id = w.id LEFT JOIN items ON items.id = w.id WHERE kind = 'd'
"""
