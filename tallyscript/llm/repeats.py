"""Long repeats: every byte covered by a string of LENGTH bytes that also starts elsewhere.

A window, a string of LENGTH bytes, is represented by an anchor, the string of k bytes in it with the least prefix polynomial
hash: equal windows have equal anchors at the same place. Neighbouring windows that share an anchor form one segment. Segments
that occur twice are repeated as a whole; anchors that occur once end the search for their windows. Where only the anchor
agrees, the suffixes that start at the segments' windows are sorted, anchor by anchor: a mergesort whose comparisons find the
common extension of two suffixes by binary search over prefix hashes, so that each takes a logarithm of the length. Neighbours in
that order that agree over LENGTH bytes are compared byte by byte, and are repeated. An anchor that too many segments share for one
task goes on to a round with longer anchors, down to single windows. Spark's shuffle brings equal anchors together.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscript.llm.common import SLICE_BYTES, IdFilter, discard, large_join, table, written

#: Bytes of a repeated string, and of the anchors by round.
LENGTH, ANCHORS = 400, (192, 340, 385, 400)
#: Bytes of the segments of one anchor that are sorted in one task; of segments that are sorted together; segments a task, about.
GROUP_BYTES, SORT_BYTES, TASK_SEGMENTS = 1 << 19, 1 << 18, 1 << 13
#: Bits of the digest that stands for a segment's bytes; seed of a second one, which finds two segments to compare.
DIGEST_BITS, SECOND_SEED = 64, 7
#: Windows that are looked at together in a task.
PART = 1 << 18
#: An odd base of the polynomial hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PLACE_BITS = 20


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


FORWARD, BACK = powers(BASE, GROUP_BYTES + SORT_BYTES + 2), powers(INVERSE, GROUP_BYTES + SORT_BYTES + 2)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * FORWARD[: len(data)], out=prefix[1:])
    return prefix


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """The polynomial hash of each string of k bytes, from hashes of prefixes."""
    prefix = prefix_hashes(data)
    h = (prefix[k:] - prefix[:-k]) * BACK[: len(data) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def least_places(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each run of w hashes the place of the least one, the first of equals."""
    key = (hashes & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    if w > 1:
        n = len(key) - w + 1
        blocks = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        blocks[: len(key)] = key
        blocks = blocks.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        key = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    return (key & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def segments(text: bytes, k: int, length: int, bits: int = DIGEST_BITS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int], list[int]]]:
    """(first window, number of windows, anchor's place, anchor's hash, digest, second digest) of the text's segments, part by part."""
    n = len(text) - length + 1
    for at in range(0, n, PART):
        part = text[at : min(at + PART, n) + length - 1]
        hashes = window_hashes(np.frombuffer(part, np.uint8), k)
        place = least_places(hashes, length - k + 1)
        first = np.append(0, np.flatnonzero(place[1:] != place[:-1]) + 1)
        count = np.diff(np.append(first, len(place)))
        pieces = [part[s : s + c + length - 1] for s, c in zip(first.tolist(), count.tolist(), strict=True)]
        digests = [(xxhash.xxh3_64_intdigest(p) - (1 << 63)) >> 64 - bits for p in pieces]
        yield first + at, count, place[first] + at, hashes[place[first]].view(np.int64), digests, [xxhash.xxh64_intdigest(p, SECOND_SEED) - (1 << 63) for p in pieces]


def cut(contexts: DataFrame, k: int, length: int, bits: int) -> DataFrame:
    """The segments of (id, h, start, context), places being counted from the text's begin: id, h, start, lo, n, place, anchor, digest, second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], [[] for _ in range(6)]
            size = 0
            starts = batch.column(2).to_pylist()
            for i, text in enumerate(batch.column(3)):
                text = text.as_py() or b""
                for lo, n, place, anchors, *digests in segments(text, k, length, bits) if len(text) >= length else ():
                    rows.append(np.full(len(lo), i))
                    for out, x in zip(held, (lo + starts[i], n, place + starts[i], anchors, *digests), strict=True):
                        out.append(x)
                    size += len(text)
                if size > SLICE_BYTES or i == len(starts) - 1 and rows:
                    own = pa.array(np.concatenate(rows))
                    columns = [batch.column(c).take(own) for c in range(3)] + [pa.array(np.concatenate(x), pa.int64()) for x in held]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "h", "start", "lo", "n", "place", "anchor", "digest", "second"])
                    rows, held, size = [], [[] for _ in range(6)], 0

    return contexts.mapInArrow(run, "id string, h long, start long, lo long, n long, place long, anchor long, digest long, second long")


def one_round(contexts: DataFrame, k: int, length: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments that occur twice by their digests, undecided segments, and pairs that tell whether a digest lied.

    shared: id, h, start, lo, n, place, anchor, digest of all segments whose anchor occurs twice. ahead: one of each undecided
    kind, with bytes, those of all undecided segments of the anchor together. pairs: of each kind that occurs twice, those two
    segments that differ most by the second digest; if any two differ, these do.
    """
    every = written(cut(contexts, k, length, bits), "segments")
    # small sides are written before they are joined, as Spark can then split the rows of an anchor among tasks
    often = written(every.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "often")
    shared = written(large_join(every, often, "anchor"), "shared")
    at = F.struct("id", "h", "start", "lo", "n", "place")
    kinds = shared.groupBy("anchor", "digest").agg(F.count("*").alias("k"), F.min(at).alias("one"), F.min(F.struct("second", at.alias("at"))).alias("low"), F.max(F.struct("second", at.alias("at"))).alias("high"))
    kinds = written(kinds, "kinds")
    # an anchor with one kind of segment only, or of which every kind is repeated, is done
    of_anchor = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("k").alias("least"), F.sum(F.col("one.n") + length - 1).alias("bytes"))
    undecided = written(of_anchor.where("kinds > 1 and least = 1").select("anchor", "bytes"), "undecided")
    ahead = written(large_join(kinds, undecided, "anchor").select("one.*", "anchor", "bytes"), "ahead")
    twice = kinds.where("k > 1").select("anchor", "digest", F.explode(F.array("low.at", "high.at")).alias("at"))
    pairs = written(twice.select("at.*", "anchor", "digest"), "pairs")
    discard(every, often, undecided, kinds)
    return shared, ahead, pairs


class Suffixes:
    """Suffixes of joined segments, and their order by their first `length` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.prefix = data, length, prefix_hashes(data)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far the suffixes at x and y agree, `length` at most: binary search over hashes of their prefixes."""
        px, py, bx, by = self.prefix[x], self.prefix[y], BACK[x], BACK[y]
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), self.length)
        mid = hi
        while len(x) and (lo < hi).any():
            same = (self.prefix[x + mid] - px) * bx == (self.prefix[y + mid] - py) * by
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
            mid = (lo + hi + 1) // 2
        return lo

    def after(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether the suffix at y comes before that at x (or may equal it)."""
        common = self.extension(x, y)
        equal = common == self.length
        at = np.where(equal, 0, common)
        return np.where(equal, or_equal, self.data[y + at] < self.data[x + at])

    def sort(self, start: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The order that sorts each class of suffixes: a mergesort of all classes at once.

        start: places of the suffixes; first and size: of each suffix's class, which is a stretch of start.
        """
        order, place, width = np.arange(len(start)), np.arange(len(start)) - first, 1
        while width < size.max(initial=0):
            run = place // width
            low = first + (run ^ 1) * width
            some = np.flatnonzero(low < first + size)  # a last run without a partner stays
            run, low = run[some], low[some]
            lo, hi = low.copy(), np.minimum(low + width, first[some] + size[some])
            mine, right = start[order[some]], run % 2 == 1
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) // 2
                up = self.after(mine[open_], start[order[mid]], right[open_])
                lo[open_], hi[open_] = np.where(up, mid + 1, lo[open_]), np.where(up, hi[open_], mid)
                open_ = open_[lo[open_] < hi[open_]]
            moved = order.copy()
            moved[first[some] + (run & ~1) * width + place[some] - run * width + lo - low] = order[some]
            order, width = moved, width * 2
        return order

    def same_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of suffixes agree over `length` bytes, by the bytes themselves.

        A pair that continues the one before it, both a byte further, is compared in its last byte only.
        """
        order = np.lexsort((x, y - x))
        x, y = x[order], y[order]
        head = np.ones(len(x), bool)
        head[1:] = (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1)
        same = self.data[x + self.length - 1] == self.data[y + self.length - 1]
        places = np.flatnonzero(head)
        for at in range(0, len(places), 4096):
            some = places[at : at + 4096]
            reach = np.arange(self.length)
            same[some] = (self.data[x[some][:, None] + reach] == self.data[y[some][:, None] + reach]).all(1)
        if not same.all():  # then what follows a difference isn't known
            same = np.array([self.data[a : a + self.length].tobytes() == self.data[b : b + self.length].tobytes() for a, b in zip(x, y, strict=True)], bool)
        out = np.empty(len(x), bool)
        out[order] = same
        return out


def repeated_windows(anchors: np.ndarray, contexts: list[bytes], offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (segment, first window, number) of windows that occur in two places of whole groups of segments.

    offsets: the anchor's place in each context. Equal windows have it at the same distance, so suffixes are sorted by anchor
    and distance; what is repeated then has an equal neighbour.
    """
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    n = sizes - length + 1
    segment = np.repeat(np.arange(len(contexts)), n)
    window = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    group = np.unique(anchors, return_inverse=True)[1][segment]
    key = group * (2 * length) + offsets[segment] - window
    order = np.argsort(key, kind="stable")
    key, segment, window = key[order], segment[order], window[order]
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begins, len(key)))
    several = np.repeat(size > 1, size)  # the only one of its class is nowhere else
    segment, window, size = segment[several], window[several], size[size > 1]
    start = (np.cumsum(sizes) - sizes)[segment] + window
    first, size = np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)
    suffixes = Suffixes(data, length)
    sorted_ = suffixes.sort(start, first, size)
    start, segment, window = start[sorted_], segment[sorted_], window[sorted_]
    near = np.flatnonzero(first[1:] == first[:-1])
    near = near[suffixes.extension(start[near], start[near + 1]) == length]
    same = suffixes.same_bytes(start[near], start[near + 1])
    found = np.zeros(len(start), bool)
    found[near[same]] = found[near[same] + 1] = True
    for at in np.unique(first[near[~same]]):  # hashes that lied have put a class in a wrong order
        members = np.arange(at, at + size[at])
        strings = [data[s : s + length].tobytes() for s in start[members]]
        counts = Counter(strings)
        found[members] = [counts[x] > 1 for x in strings]
    segment, window = segment[found], window[found]
    order = np.lexsort((window, segment))
    segment, window = segment[order], window[order]
    begins = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (window[1:] != window[:-1] + 1))) if len(segment) else np.empty(0, np.int64)
    return segment[begins], window[begins], np.diff(np.append(begins, len(segment)))


def sort_suffixes(ahead: DataFrame, length: int) -> DataFrame:
    """Repeated stretches of windows (id, h, lo, n) of undecided segments (anchor, place, id, h, start, context), whole groups by anchor."""

    def settled(rows: pa.Table) -> pa.RecordBatch:
        column = {c: rows.column(c) for c in rows.column_names}
        starts = column["start"].to_numpy()
        segment, window, n = repeated_windows(column["anchor"].to_numpy(), column["context"].to_pylist(), column["place"].to_numpy() - starts, length)
        take = pa.array(segment)
        return pa.RecordBatch.from_arrays([column["id"].take(take).combine_chunks(), column["h"].take(take).combine_chunks(), pa.array(starts[segment] + window), pa.array(n, pa.int64())], ["id", "h", "lo", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            anchors = rows.column("anchor").to_numpy()
            ends = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(anchors)) if len(anchors) else []
            reach = np.cumsum(pc.binary_length(rows.column("context")).to_numpy()) if len(anchors) else []
            done = at = 0
            for end in ends[:-1]:  # the last group may go on in the next batch
                if reach[end - 1] - (reach[done - 1] if done else 0) > SORT_BYTES and at > done:
                    yield settled(rows.slice(done, at - done))
                    done = at
                at = end
            if at > done:
                yield settled(rows.slice(done, at - done))
            held = rows.slice(at)
        if held is not None and held.num_rows:
            yield settled(held)

    parts = 1 + ahead.count() // TASK_SEGMENTS
    grouped = ahead.select("anchor", "place", "id", "h", "start", "context").repartition(parts, "anchor").sortWithinPartitions("anchor")
    return grouped.mapInArrow(run, "id string, h long, lo long, n long")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("context"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchors: tuple[int, ...] = ANCHORS, group_bytes: int = GROUP_BYTES, digest_bits: int = DIGEST_BITS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    docs has doc_id and text; other columns are ignored. Texts are UTF-8 bytes, a null one is empty. A string that occurs at
    any second place, in the same text or another row's, is removed wherever it occurs; strings are judged on the input. spans
    lists the removed stretches as start:end, comma-joined. Repeated rows are each other's second place. Null doc_ids
    are rows like others. Texts shorter than `length` bytes keep all. An empty table gives no row.

    Segments of one anchor and digest are repeated once the two of them that a second digest puts farthest apart have the same
    bytes; if they don't, the digest lied, and all its segments are sorted as suffixes. digest_bits are fewer in tests only.
    """
    contexts = keyed(docs).where(F.length("context") >= length).select("id", "h", F.lit(0).cast("long").alias("start"), "context")
    found = []
    for k in anchors:
        shared, ahead, pairs = one_round(contexts, k, length, digest_bits)
        wanted = ahead.select("id", "h", "start", "lo", "n", "place", "anchor", "bytes", F.lit(None).cast("long").alias("digest"))
        wanted = wanted.unionByName(pairs.withColumn("bytes", F.lit(None).cast("long")), allowMissingColumns=True)
        near = contexts.where(IdFilter(wanted.select("id").distinct()).column("id"))

        def with_bytes(rows: DataFrame) -> DataFrame:
            piece = F.substring(F.col("context"), F.col("lo") - F.col("start") + 1, F.col("n") + length - 1)
            return large_join(rows, near, ["id", "h", "start"]).select("anchor", "digest", "place", "bytes", "id", "h", F.col("lo").alias("start"), piece.alias("context"))

        fetched = written(with_bytes(wanted), "fetched")
        differ = fetched.where("bytes is null").groupBy("anchor", "digest").agg(F.collect_set("context").alias("contexts")).where(F.size("contexts") > 1)
        lied = written(differ.select("anchor").distinct(), "lied")
        kinds, undecided = pairs.select("anchor", "digest").distinct(), fetched.where("bytes is not null")
        if not lied.isEmpty():  # of these anchors all segments are undecided, whatever their bytes
            kinds, near = large_join(kinds, lied, "anchor", "left_anti"), contexts
            members = large_join(shared.distinct(), lied, "anchor").withColumn("bytes", F.lit(0).cast("long"))
            undecided = written(large_join(undecided, lied, "anchor", "left_anti").unionByName(with_bytes(members)), "undecided")
        kinds = written(kinds, "kinds")  # before the join, so that Spark can split the rows of one kind among tasks
        found.append(written(large_join(shared, kinds, ["anchor", "digest"]).select("id", "h", "lo", "n").distinct(), "repeated"))
        discard(shared, pairs, kinds)
        if undecided.isEmpty():
            break
        found.append(written(sort_suffixes(undecided.where(F.col("bytes") <= group_bytes), length), "sorted"))
        contexts = undecided.where(F.col("bytes") > group_bytes).select("id", "h", "start", "context")
        if k == anchors[-1] or contexts.isEmpty():
            break
    windows = found[0]
    for other in found[1:]:
        windows = windows.unionByName(other)
    stretches = written(windows.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.array("lo", F.col("lo") + F.col("n") - 1 + length))).alias("stretches")), "stretches")
    maybe = IdFilter(stretches.select("id").distinct()).column("id")
    clear = keyed(docs).where(~maybe).withColumn("stretches", F.lit(None).cast("array<array<bigint>>"))
    rest = large_join(keyed(docs).where(maybe), stretches, ["id", "h"], "left")
    rows = clear.select("doc_id", "context", "stretches").unionByName(rest.select("doc_id", "context", "stretches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, digests, lists = [], [], [], [], []
            for text, stretches in zip(batch.column(1), batch.column(2), strict=True):
                text, spans, at, kept = text.as_py() or b"", [], 0, hashlib.sha256()
                for s, e in stretches.as_py() or ():
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(e, spans[-1][1])
                    else:
                        spans.append([s, e])
                for s, e in spans:
                    kept.update(text[at:s])
                    at = e
                kept.update(text[at:])
                sizes.append(len(text))
                removed.append(sum(e - s for s, e in spans))
                counts.append(len(spans))
                digests.append(kept.hexdigest())
                lists.append(",".join(f"{s}:{e}" for s, e in spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(lists, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
