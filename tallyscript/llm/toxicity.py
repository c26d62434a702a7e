"""Toxicity: the nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index, vote."""

from __future__ import annotations

import itertools
import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscript.llm.common import fold_remainder, slices, table

#: Labelled examples of each class in the index, about; nearest ones that vote; examples in a block.
EXAMPLES, NEAREST, BLOCK = 1500, 15, 64
#: Every term of an example is in the index; its G statistic over the examples is a weight: at this, half of the largest.
G_HALF = 20.0
#: A term that one of COMMON examples has is an array over the examples of each block, in single precision, with its largest weight
#: there; rarer ones have postings.
COMMON = 32
#: Terms that one of ALIKE examples has decide which examples are alike.
ALIKE = 16
#: Texts that are searched for together; blocks of best bound that each looks at first.
TEXTS, FIRST_BLOCKS = 128, 8
#: What a cosine may be off by while common terms are multiplied with single precision; those that it could matter for are added up anew.
ROUGH = 3e-4
#: Starts of words in bytes that are terms as the words are: they gather the forms of a word.
STARTS = (4, 5, 6)
#: Weight of the base rate beside the votes, in votes of toxic examples at cosine 1.
PRIOR = 0.25
DECISION = 0.7

#: Words are runs of letters, in lower case as to ASCII; all bytes beyond ASCII count as letters.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of_word(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in STARTS if len(word) >= n)]


def term_counts(words: Counter) -> Counter:
    counts: Counter = Counter()
    for word, n in words.items():
        for term in terms_of_word(word):
            counts[term] += n
    return counts


def words_of(text: bytes) -> Counter:
    return Counter(text.translate(LETTERS).split())


def g_statistic(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """2 * sum(observed * log(observed / expected)) of having a term against the class; 0 if there is one class only."""
    total, have = n_a + n_b, a + b
    cells = ((a, n_a * have), (b, n_b * have), (n_a - a, n_a * (total - have)), (n_b - b, n_b * (total - have)))
    return np.maximum(2 * sum(x * np.log(np.maximum(x, 1) * total / np.maximum(e, 1)) for x, e in cells), 0.0)


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each start up to its end, and how many each has."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum()), n


class Examples:
    """Unit TF-IDF vectors of examples, inverted: sparse postings by term and block of examples, each with its largest weight."""

    def __init__(self, examples: list[tuple[int, int, bytes]], class_sizes: tuple[int, int], documents: tuple[int, dict[bytes, int]] | None = None):
        """examples: (id, label, text) in ascending id; class_sizes: all labelled rows of label 0 and 1.

        documents: how many there are, and how many of them have each term; the examples themselves if not given.
        """
        self.vocabulary: dict[bytes, int] = {}
        counted = []
        for _, _, text in examples:
            terms = term_counts(words_of(text))
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms], np.int64)
            order = np.argsort(ids)
            counted.append((ids[order], np.array(list(terms.values()), float)[order]))
        size = len(self.vocabulary)
        self.ids = [i for i, _, _ in examples]
        self.labels = np.array([y for _, y, _ in examples], float)
        n = [int((self.labels == k).sum()) for k in (0, 1)]
        have = [sum((np.bincount(t, minlength=size) for (t, _), y in zip(counted, self.labels, strict=True) if y == k), np.zeros(size, np.int64)) for k in (0, 1)]
        of_all, having = (sum(n), have[0] + have[1]) if documents is None else (documents[0], np.array([documents[1].get(t, 0) for t in self.vocabulary], float))
        g = g_statistic(*have, *n)
        self.idf = (np.log((1 + of_all) / (1 + np.minimum(having, of_all))) + 1) * (1 + g) / (1 + g + G_HALF)
        share = [size_ / max(k, 1) for size_, k in zip(class_sizes, n, strict=True)]
        self.votes = np.where(self.labels == 1, 1.0, share[0] / share[1] if share[1] else 1.0)
        empty = np.array([not len(t) for t, _ in counted], bool)
        rate = lambda of: ((self.votes * self.labels)[of].sum() + 0.1) / (self.votes[of].sum() + 1.0)
        self.base, self.base_empty = (rate(slice(None)), rate(empty)) if len(empty) else (0.1, 0.1)
        order = self.alike_together(counted)
        self.ids, self.labels, self.votes = [self.ids[i] for i in order], self.labels[order], self.votes[order]
        self.texts = [(counted[i][0].astype(np.int32), counted[i][1].astype(np.int32)) for i in order]
        self.knots = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self.invert()
        self.knots = self.calibrated()

    def alike_together(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """An order of the examples in which those of a block are alike, so that blocks' largest weights bound closely.

        Parts are halved along the direction in which their common terms differ most, found by power iteration.
        """
        vectors = [self.weighed(t, c) for t, c in counted]
        have = np.bincount(np.concatenate([np.empty(0, np.int64), *(t for t, _ in vectors)]), minlength=len(self.vocabulary))
        common = np.flatnonzero(have * ALIKE >= max(len(vectors), 1))
        rows = np.zeros((len(vectors), len(common)), np.float32)
        for row, (terms, weights) in zip(rows, vectors, strict=True):
            at = np.searchsorted(common, terms)
            held = np.flatnonzero(at < len(common))
            held = held[common[at[held]] == terms[held]]
            row[at[held]] = weights[held]
        parts, done = [np.arange(len(vectors))], []
        while parts:
            part = parts.pop()
            if len(part) <= BLOCK:
                done.append(part)
                continue
            apart = rows[part] - rows[part].mean(0)
            along = apart[np.argmax((apart * apart).sum(1))]
            for _ in range(8):
                along = apart.T @ (apart @ along)
                along /= np.sqrt((along * along).sum()) or 1
            part = part[np.argsort(apart @ along, kind="stable")]
            half = -(-len(part) // (2 * BLOCK)) * BLOCK
            parts += [part[half:], part[:half]]
        return np.concatenate([np.empty(0, np.int64), *done])

    def __getstate__(self) -> bytes:
        """What the index is made of, as Spark writes what it sends out to each executor's disk."""
        names = ("vocabulary", "ids", "labels", "idf", "votes", "base", "base_empty", "texts", "knots")
        return zlib.compress(pickle.dumps({n: getattr(self, n) for n in names}, 5), 1)

    def __setstate__(self, state: bytes) -> None:
        self.__dict__.update(pickle.loads(zlib.decompress(state)))
        self.invert()

    def invert(self) -> None:
        vectors, size = [self.weighed(t, c) for t, c in self.texts], len(self.vocabulary)
        self.vectors, self.terms = vectors, Terms(self.vocabulary)
        self.blocks = -(-len(vectors) // BLOCK)
        term = np.concatenate([np.empty(0, np.int64), *(t for t, _ in vectors)])
        weight = np.concatenate([np.empty(0), *(w for _, w in vectors)])
        place = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        common = np.flatnonzero(np.bincount(term, minlength=size) * COMMON >= max(len(vectors), 1))
        self.column = np.full(size, -1)
        self.column[common] = np.arange(len(common))
        dense = self.column[term] >= 0
        self.common = np.zeros((self.blocks, len(common), BLOCK), np.float32)
        self.common[place[dense] // BLOCK, self.column[term[dense]], place[dense] % BLOCK] = weight[dense]
        self.most = np.ascontiguousarray(self.common.max(2, initial=0).T)
        order = np.lexsort((place[~dense], term[~dense]))
        term, self.place, self.weight = term[~dense][order], place[~dense][order].astype(np.int32), weight[~dense][order]
        self.start = np.searchsorted(term, np.arange(size + 1))

    @property
    def postings(self) -> Iterator[np.ndarray]:
        """Each block as an array of its weights by term and example."""
        for b in range(self.blocks):
            block = np.zeros((len(self.vocabulary), BLOCK))
            for k, (terms, weights) in enumerate(self.vectors[b * BLOCK : (b + 1) * BLOCK]):
                block[terms, k] = weights
            yield block

    def weighed(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(counts)) * self.idf[terms]
        return terms, weights / math.sqrt((weights * weights).sum() or 1.0)

    def vector(self, counts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        return self.weighed(*counts) if len(counts[0]) else None

    def query(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms of the vocabulary and their counts."""
        _, terms, counts = self.terms.of([text])
        return terms, counts

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEAREST) -> list[tuple[float, int]]:
        return self.nearest_all(np.zeros(len(terms), np.int64), terms, weights, 1, k)[0]

    def nearest_all(self, text: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int = NEAREST) -> list[list[tuple[float, int]]]:
        """For each of n texts the k examples of largest cosine over 0, exactly, ties by place: blocks by their bound, until none can matter.

        text, terms, weights: the texts' unit vectors, in the order of texts. Rare terms' postings are added up in full. What
        common terms may add in a block is bounded by their largest weights there; with the most that rare terms gave one of its
        examples this is the block's bound. The blocks of best bound come first; then those that the k-th cosine so far doesn't exclude.
        """
        if not self.blocks:
            return [[] for _ in range(n)]
        width = self.blocks * BLOCK
        dense = self.column[terms] >= 0
        query = np.zeros((n, self.common.shape[1]), np.float32)
        query[text[dense], self.column[terms[dense]]] = weights[dense]
        rare = terms[~dense]
        found, size = ranges(self.start[rare], self.start[rare + 1])
        scores = np.bincount(np.repeat(text[~dense] * width, size) + self.place[found], np.repeat(weights[~dense], size) * self.weight[found], n * width).astype(float, copy=False).reshape(n, self.blocks, BLOCK)
        bound = query @ self.most + scores.max(2)
        looked = np.zeros((n, self.blocks), bool)
        np.put_along_axis(looked, np.argpartition(-bound, min(FIRST_BLOCKS, self.blocks) - 1, axis=1)[:, :FIRST_BLOCKS], True, axis=1)
        looked &= bound > 0
        known, wanted = np.zeros((n, self.blocks), bool), looked
        for last in (False, True):
            for b in np.flatnonzero(wanted.any(0)).tolist():
                rows = np.flatnonzero(wanted[:, b])
                scores[rows, b] += query[rows] @ self.common[b] if len(rows) < n else query @ self.common[b]
            known |= wanted
            seen = np.where(known[:, :, None], scores, -1.0).reshape(n, width)
            least = np.partition(seen, width - min(k, width), axis=1)[:, width - min(k, width)]
            if not last:
                wanted = ~known & (bound > 0) & (bound >= least[:, None] - 2 * ROUGH)
        out, whole = [], np.zeros(len(self.vocabulary))
        at = np.searchsorted(text, np.arange(n + 1))
        for i in range(n):
            places = np.flatnonzero((seen[i] > 0) & (seen[i] >= least[i] - 2 * ROUGH))
            own = terms[at[i] : at[i + 1]]
            whole[own] = weights[at[i] : at[i + 1]]
            exact = np.array([whole[t] @ w for t, w in map(self.vectors.__getitem__, places.tolist())])
            whole[own] = 0
            best = np.lexsort((places, -np.round(exact, 12)))[:k] if len(places) else ()
            out.append([(float(exact[j]), int(places[j])) for j in best if exact[j] > 0])
        return out

    def score(self, text: bytes) -> tuple[float, str]:
        """(score, evidence): shares of cubed cosines, held towards the base rate; the three nearest examples."""
        return self.score_all([text])[0]

    def score_all(self, texts: list[bytes]) -> list[tuple[float, str]]:
        rows = []
        for start in range(0, len(texts), TEXTS):
            some = texts[start : start + TEXTS]
            text, terms, counts = self.terms.of(some)
            weights = (1 + np.log(counts)) * self.idf[terms]
            weights /= np.sqrt(np.bincount(text, weights * weights, len(some)))[text]
            have = np.bincount(text, minlength=len(some)) > 0
            rows += [self.voted(near) if has else (float(self.base_empty), "") for near, has in zip(self.nearest_all(text, terms, weights, len(some)), have, strict=True)]
        return rows

    def voted(self, near: list[tuple[float, int]]) -> tuple[float, str]:
        total, toxic = PRIOR, PRIOR * self.base
        for cosine, e in near:
            vote = self.votes[e] * cosine**3
            total += vote
            toxic += vote * self.labels[e]
        share = min(1.0, max(0.0, toxic / total))
        return float(np.interp(share, *self.knots)), ",".join(f"{self.ids[e]}:{cosine:.4f}" for cosine, e in near[:3])

    def calibrated(self) -> tuple[np.ndarray, np.ndarray]:
        """A rising line through (share of votes, share of toxic labels), from each example's vote by all the others.

        Neighbouring shares are pooled until the labels' shares rise; classes count by how many labelled rows they have. A pool is
        held towards the base rate by the weight of one row. Beyond the largest share that an example has, a copy of one has more;
        there the share itself holds.
        """
        counted = [(t, w) for t, w in self.vectors if len(t)]
        which = [i for i, (t, _) in enumerate(self.vectors) if len(t)]
        shares = []
        for start in range(0, len(counted), TEXTS):
            some = counted[start : start + TEXTS]
            text = np.repeat(np.arange(len(some)), [len(t) for t, _ in some])
            near = self.nearest_all(text, np.concatenate([t for t, _ in some]).astype(np.int64), np.concatenate([w for _, w in some]), len(some), NEAREST + 1)
            shares += [self.voted([x for x in found if x[1] != i][:NEAREST])[0] for found, i in zip(near, which[start : start + TEXTS], strict=True)]
        pools: list[list[float]] = []  # weight, weight of toxic ones, weighted share
        for k in np.argsort(shares, kind="stable").tolist():
            w = self.votes[which[k]]
            pools.append([w, w * self.labels[which[k]], w * shares[k]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        if not pools:
            return np.array([0.0, 1.0]), np.array([0.0, 1.0])
        w, toxic, share = np.array(pools).T
        rate = np.maximum.accumulate((toxic + self.base) / (w + 1))
        most = share[-1] / w[-1]
        beyond = min(1.0, most + 0.05)
        return np.concatenate([[0.0], share / w, [beyond, 1.0]]), np.concatenate([[rate[0] / 2], rate, [max(rate[-1], beyond), 1.0]])


MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)
#: The low n bytes of eight.
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Table:
    """Numbers of unique 64-bit keys, found for many keys at once."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], numbers[order]
        bits = max(8, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, or -1."""
        part = (keys >> self.shift).astype(np.int64)
        at, end, found = self.first[part], self.first[part + 1], np.full(len(keys), -1, np.int32)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.keys[here] == keys[left]
            found[left[hit]] = self.numbers[here[hit]]
            at[left] += 1
            left = left[~hit & (here + 1 < end[left])]
        return found


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in the order of texts: the text's number, a key of the word, its first eight bytes, its length.

    The key of a word of up to eight bytes is exact for its length, that of a longer one a 64-bit hash.
    """
    plain = [t.translate(LETTERS) for t in texts]
    data = np.frombuffer(b" " + b" ".join(plain) + b" " * 9, np.uint8)
    letter = data != 32
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    start, length = edge[::2], edge[1::2] - edge[::2]
    eight = lambda at: np.lib.stride_tricks.sliding_window_view(data, 8)[at].copy().view("<u8").ravel()
    first = eight(start) & LOW[np.minimum(length, 8)]
    key, long, read = first.copy(), np.flatnonzero(length > 8), 8
    while len(long):
        h = key[long]
        key[long] = (h ^ (h >> TURN)) * MIX ^ (eight(start[long] + read) & LOW[np.minimum(length[long] - read, 8)])
        read += 8
        long = long[length[long] > read]
    key = (key ^ length.astype(np.uint64) << np.uint64(56)) * MIX
    ends = np.cumsum([len(t) + 1 for t in plain])
    return np.searchsorted(ends, start), key, first, length


class Terms:
    """Numbers of a vocabulary's words, and of the starts of words, for all words of many texts at once."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.size = max(len(vocabulary), 1)
        words = {t: k for t, k in vocabulary.items() if not t.endswith(b"*")}
        starts = {t[:-1]: k for t, k in vocabulary.items() if t.endswith(b"*")}
        self.words = Table(word_keys(list(words))[1], np.array(list(words.values()), np.int32))
        _, _, first, length = word_keys(list(starts))
        self.starts = Table(self.start_keys(first, length), np.array(list(starts.values()), np.int32))

    @staticmethod
    def start_keys(first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Exact keys of starts of at most seven bytes."""
        return (first | length.astype(np.uint64) << np.uint64(56)) * MIX

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of all texts, in the order of texts and terms; each term of a text once."""
        text, key, first, length = word_keys(texts)
        base, keys = text * self.size, []
        for found, words in [(self.words.find(key), None), *((self.starts.find(self.start_keys(first[w] & LOW[n], np.full(len(w), n))), w) for n in STARTS for w in [np.flatnonzero(length >= n)])]:
            some = np.flatnonzero(found >= 0)
            keys.append(base[some if words is None else words[some]] + found[some])
        keys = np.sort(np.concatenate(keys))
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        return keys[at] // self.size, keys[at] % self.size, np.diff(np.append(at, len(keys))).astype(float)


def document_counts(docs: DataFrame, terms: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """How many rows of docs have a text, and how many of those have each term. The driver gets a row per term."""
    shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = Terms(shared.value), np.zeros(len(shared.value) + 1, np.int64)  # the last one counts texts
        for _, texts in slices(batches):
            n[-1] += len(texts)
            for start in range(0, len(texts), TEXTS):
                _, found, _ = known.of(texts[start : start + TEXTS])
                n[:-1] += np.bincount(found, minlength=len(shared.value))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["term", "n"])

    rows = docs.select("text").where("text is not null").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    got = dict(zip(rows.column("term").to_pylist(), rows.column("n").to_pylist(), strict=True))
    return got.pop(len(terms), 0), {terms[k]: n for k, n in got.items()}


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Examples:
    """An index of labelled rows: some `examples` of each class by the hash of their id, of which distinct texts stay.

    All their terms are indexed; how rare a term is follows from all of docs. docs has doc_id and text, labels doc_id and
    toxic. The driver gets these rows, and a count for each of their terms. Rows with a null id, text or label
    teach nothing; of labels for the same id the largest holds.
    """
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) / (1 << 20)
    wanted = F.lit(False)
    for label, n in sizes.items():
        wanted = wanted | ((F.col("toxic") == label) & (place * n < examples))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    picked = texts.join(F.broadcast(marked.where(wanted)), "doc_id").collect()  # about two times `examples` rows
    once = {bytes(r["text"]): (r["doc_id"], r["toxic"], bytes(r["text"])) for r in sorted(picked, key=lambda r: r["doc_id"], reverse=True)}
    terms = sorted({t for text in once for w in words_of(text) for t in terms_of_word(w)})
    return Examples(sorted(once.values()), (sizes.get(0, 0), sizes.get(1, 0)), document_counts(docs, terms))


def score(docs: DataFrame, model: Examples) -> DataFrame:
    """One row per row of docs: doc_id, score, predicted, evidence.

    Only text is looked at; a null or empty text, or one without a term of an example, gets the rate of labelled
    rows without one. Repeated rows and null ids are scored row by row; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            got = shared.value.score_all(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= DECISION) for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string())], ["doc_id", "score", "predicted", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence string")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold_remainder("doc_id", 3) != 1))
    return score(docs, model).select("doc_id", (fold_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "evidence")
