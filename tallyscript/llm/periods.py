"""Periodic runs of words: suffix classes united by decreasing common prefix, whose ordered positions seed the runs."""

from __future__ import annotations

import hashlib
from bisect import bisect
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscript.llm.common import slices, table

#: Fixed value of the query: fewest words of a run. A run also holds its period twice.
SHORTEST = 12
#: Two places of a run one period apart agree over this many words at least, as a run has 2 periods and SHORTEST words.
AGREE = SHORTEST // 2

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
FIELDS = pa.schema([("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

Run = tuple[int, int, int]


def shared_starts(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places from which AGREE words follow in their text that also follow from another place of it, ascending.

    words: numbers of the words of several texts in a row; text: the number of each word's text. Windows are compared by a
    64-bit hash; one of another window's hash only adds places, which the suffix sort then tells apart.
    """
    n = len(words) - AGREE + 1
    if n < 2:
        return np.empty(0, np.int64)
    h = text[:n].astype(np.uint64)
    for k in range(AGREE):
        h = (h ^ words[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    whole = np.flatnonzero(text[:n] == text[AGREE - 1 :])
    order = whole[np.argsort(h[whole], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    return np.sort(order[np.r_[same, False] | np.r_[False, same]])


def suffix_order(words: np.ndarray, text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of shared_starts() in the order of their suffixes, and each one's words in common with the one before (0 if below AGREE).

    A suffix ends where the places in a row do, since what follows there comes once only: behind it, windows are read as
    letters. Ranks are doubled; equal suffixes keep the order of the text, so that neighbours' common prefixes shrink by one
    letter at most from one place to the next.
    """
    m = len(places)
    letter = np.zeros(m, np.int64)
    for k in range(AGREE):  # exact: by the words themselves, a column at a time
        _, letter = np.unique(letter * (int(words.max()) + 1) + words[places + k], return_inverse=True)
    _, letter = np.unique(letter * (int(text.max()) + 1) + text[places], return_inverse=True)
    stops = np.r_[np.flatnonzero((np.diff(places) != 1) | (np.diff(text[places]) != 0)), m - 1]
    left = stops[np.searchsorted(stops, np.arange(m))] - np.arange(m) + 1  # letters of each suffix
    rank, reach = letter, 1
    while reach < left.max():
        after = np.zeros(m, np.int64)
        on = np.flatnonzero(left > reach)
        after[on] = rank[on + reach] + 1
        _, rank = np.unique(rank * (m + 1) + after, return_inverse=True)
        reach *= 2
    order = np.argsort(rank, kind="stable")
    at = np.empty(m, np.int64)
    at[order] = np.arange(m)
    letters, ends, earlier, common, held = letter.tolist(), left.tolist(), np.r_[-1, order[:-1]][at].tolist(), [0] * m, 0
    for i in range(m):  # neighbours' common letters, in the order of the text
        j = earlier[i]
        if j < 0:
            held = 0
            continue
        most = min(ends[i], ends[j])
        while held < most and letters[i + held] == letters[j + held]:
            held += 1
        common[i] = held
        held = max(held - 1, 0)
    shared = np.array(common, np.int64)[order]
    return places[order], np.where(shared > 0, shared + AGREE - 1, 0)


def seeds(order: np.ndarray, common: np.ndarray) -> Iterator[Run]:
    """(place, period, words): two places of one class, next to each other, whose distance is at most what follows from both.

    Suffixes next to each other in order are united by decreasing common words. A class is a list of its places in order, which
    periodic text lengthens at its end; the smaller class goes into the larger one. What is next to each other once a class is
    united has no smaller period, else a place between would have come with more words in common.
    """
    edges = np.flatnonzero(common > 0)
    edges = edges[np.argsort(-common[edges], kind="stable")]
    group = list(range(len(order)))
    members = [[p] for p in order.tolist()]
    for e, words in zip(edges.tolist(), common[edges].tolist(), strict=True):
        a, b = e - 1, e
        while group[a] != a:
            group[a] = a = group[group[a]]
        while group[b] != b:
            group[b] = b = group[group[b]]
        large, small = members[a], members[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        group[b] = a
        members[b] = None
        mine = set(small)
        if len(small) == 1:
            large.insert(bisect(large, small[0]), small[0])
        else:
            large += small
            large.sort()
        for x in small:
            k = bisect(large, x) - 1
            if k and large[k - 1] not in mine and x - large[k - 1] <= words:
                yield large[k - 1], x - large[k - 1], words
            if k + 1 < len(large) and large[k + 1] not in mine and large[k + 1] - x <= words:
                yield x, large[k + 1] - x, words


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """Each text's runs (start, length, period) by start, then period; texts are lists of words."""
    found: list[list[Run]] = [[] for _ in texts]
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number)) for w in chain.from_iterable(texts)], np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    places = shared_starts(words, text)
    if not len(places):
        return found
    first = np.searchsorted(text, np.arange(len(texts))).tolist()
    plain, owner = words.tolist(), text.tolist()
    for place, period, agree in seeds(*suffix_order(words, text, places)):
        t = owner[place]
        starts = place == first[t] or plain[place - 1] != plain[place - 1 + period]  # other seeds of a run lie behind its start
        if starts and period + agree >= SHORTEST:
            found[t].append((place - first[t], period + agree, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run contains behind its first period, joined by a blank."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])


def repeated_tail(words: list[bytes], h: int | None) -> list[bytes]:
    """words, for every tenth h with a tail that repeats its first part, as the query asks for."""
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def judged(words: list[bytes], runs: list[Run]) -> list:
    listed = "".join([f"{s},{n},{q}\n" for s, n, q in runs])
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = [best[0], best[1], best[2], 1000 * best[1] // best[2]] if best else [None] * 4
    return [len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest()]


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_runs, start, length, period, exponent_milli of the longest run, runs_sha256, collapsed_sha256.

    docs has doc_id and text; other columns are ignored. planted gives every tenth document, by the crc32 of its id, a
    repeated tail first; one with a null id stays as it is. A null, empty or blank text has no words and no runs: four nulls, and
    the hashes of nothing. Repeated rows are judged row by row; of runs of one length the one that starts first counts. A text
    of any length is searched whole, in the task that reads it, at n log n steps for its n words; no shuffle. An empty table gives no row.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary")) if planted else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in slices(batches):
            texts = [repeated_tail(t.split(), x) for t, x in zip(raw, rows.column(2).to_pylist(), strict=True)]
            values = [judged(words, runs) for words, runs in zip(texts, runs_of(texts), strict=True)]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*values, strict=True), FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *columns], ["doc_id", *FIELDS.names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h")).mapInArrow(run, SCHEMA)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True)
