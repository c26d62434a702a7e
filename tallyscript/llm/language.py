"""Language ID by error-correcting output codes: n-gram classifiers predict the bits of languages' codewords."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscript.llm.common import fold_remainder, large_join, slices, table, unused, written

#: Labelled rows of each language that a model learns from, about; buckets of hashed three-byte strings; languages up to which their sizes are sent to all tasks.
ROWS_PER_LANGUAGE, BUCKETS, SENT = 4000, 1 << 14, 1 << 14
#: Bits of a codeword for more languages than all two-way splits can serve.
BITS_PER_LANGUAGE_BIT = 8
#: Share of the rightly decoded rows of the labelled sample whose margin is too small for certainty: what is as near to a second
#: codeword is flagged as ambiguous.
AMBIGUOUS = 0.01
#: A text with a smaller share of three-byte strings that the sample has is in none of its languages.
KNOWN = 0.5
#: Strings of three bytes that count as independent at most; more in a text don't make a prediction surer.
EVIDENCE = 50

LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))


def buckets_of(text: bytes) -> np.ndarray:
    """The bucket of each three-byte string, in lower case and with all but letters as spaces."""
    b = np.frombuffer(b" " + text.translate(LOWER) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - int(math.log2(BUCKETS)))


def pieces(codes: np.ndarray, size: int = 1 << 18) -> Iterator[np.ndarray]:
    for i in range(0, len(codes), size):
        yield codes[i : i + size]


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages. Up to five: every split in two. More: a random code of large distance."""
    if n <= 5:
        splits = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c] or [(1,) * n]
        return np.array(splits, np.float32).T
    bits, rng, best = BITS_PER_LANGUAGE_BIT * math.ceil(math.log2(n)), np.random.default_rng(2), None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        distance = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * bits).min()
        if best is None or distance > best[0]:
            best = distance, code
    return best[1]


class CodeModel:
    """Weights of the bits' classifiers by bucket, and how much each bit counts in decoding."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: occurrences by language and bucket in the labelled sample."""
        self.languages, self.code = languages, codewords(len(languages))
        self.seen, self.ambiguous_under = (counts.sum(0) > 0).astype(np.float32), 0.0
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
        self.weights = np.empty((BUCKETS, self.code.shape[1]), np.float32)
        self.loss_weight = np.ones(self.code.shape[1])
        for bit, side in enumerate(self.code.T > 0):
            one, other = share[side].mean(0), share[~side].mean(0) if not side.all() else share.mean(0)
            self.weights[:, bit] = np.log(one / other)
            mean = (one + other) / 2
            self.loss_weight[bit] = (one * np.log(one / mean) + other * np.log(other / mean)).sum() / 2 + 1e-6  # how far the sides differ
        self.loss_weight /= self.loss_weight.sum()

    def predict(self, text: bytes) -> tuple[str, float, float, float]:
        """(language, score, margin, known): the codeword of least weighted logistic loss, how far the next one is, and which
        share of the text's strings the sample has."""
        codes = buckets_of(text)
        total, known = np.zeros(self.code.shape[1]), 0.0
        for part in pieces(codes):
            total += self.weights.take(part, axis=0).sum(0, dtype=np.float64)
            known += float(self.seen.take(part).sum(dtype=np.float64))
        bits = total * (min(len(codes), EVIDENCE) / max(len(codes), 1))
        losses = np.logaddexp(0, -self.code * bits) @ self.loss_weight
        order = np.argsort(losses, kind="stable")
        likely = np.exp(-(losses - losses[order[0]]))
        score = float(1 / likely.sum())
        return self.languages[order[0]], score, float(losses[order[1]] - losses[order[0]]) if len(order) > 1 else score, known / max(len(codes), 1)


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> CodeModel | None:
    """A model of labelled (doc_id, text, lang) with all their languages; of one with more rows, some rows_per_language by the hash of their id.

    The driver gets a row per language and bucket, as an Arrow table. None without labelled text. The margin under which a
    prediction is ambiguous is then taken from the model's predictions of the sample.
    """
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = written(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) / (1 << 20)
    sized = rows.join(F.broadcast(sizes), "lang") if sizes.count() <= SENT else large_join(rows, sizes, "lang")
    sample = sized.where(place * F.col("n") < rows_per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, texts in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                held = sums.setdefault(lang, np.zeros(BUCKETS))
                for codes in pieces(buckets_of(text)):
                    held += np.bincount(codes, minlength=BUCKETS)
        for lang, held in sums.items():
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some, pa.int32()), pa.array(held[some])], ["lang", "bucket", "n"])

    counted = sample.mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    named = counted.column("lang").combine_chunks().dictionary_encode()
    languages = sorted(named.dictionary.to_pylist())
    if not languages:
        return None
    number = {language: k for k, language in enumerate(languages)}
    rank = np.array([number[x] for x in named.dictionary.to_pylist()])
    counts = np.zeros((len(languages), BUCKETS))
    counts[rank[named.indices.to_numpy()], counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    model = CodeModel(languages, counts)
    right = predict(sample, model, ("lang",)).where("lang = lang_pred")
    model.ambiguous_under = right.agg(F.percentile("margin", F.lit(AMBIGUOUS))).first()[0] or 0.0
    return model


#: Names of what predict() adds.
PREDICTED = ("lang_pred", "score", "margin", "ambiguous", "known")


def predict(docs: DataFrame, model: CodeModel | None, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, ...] = PREDICTED) -> DataFrame:
    """One row per row of docs: the kept columns, lang_pred, score (0 to 1), margin, ambiguous, known, under these or other names.

    Only text is looked at; bytes that are no UTF-8 are no letters. A null text, one without a letter, or any text without a model is `und` with score, margin and
    known 0 and ambiguous. Repeated rows and null ids are predicted row by row; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = unused("text", list(keep)) if "text" in keep else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, texts in slices(batches, text):
            got = [model.predict(t) if model and any(map(str.isalpha, t.decode(errors="replace"))) else ("und", 0.0, 0.0, 0.0) for t in texts]
            columns = [pa.array([g[k] for g in got], pa.float64()) for k in (1, 2, 3)]
            columns.insert(2, pa.array([g[0] == "und" or model is not None and g[2] < model.ambiguous_under for g in got], pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array([g[0] for g in got], pa.string()), *columns], [*keep, *names])

    picked = docs.select(*keep, F.col("text").alias(text))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    return picked.mapInArrow(run, ", ".join(kinds + [f"`{n}` {k}" for n, k in zip(names, ("string", "double", "double", "boolean", "double"), strict=True)]))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = (fold_remainder("doc_id", 4) == 2).alias("held_out")
    model = fit(docs.where(fold_remainder("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", held, *PREDICTED)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those in none of the learned languages; all, if nothing was labelled.

    A document is in none of them if the labelled sample has less than KNOWN of its three-byte strings: other scripts and
    noise. A document between two learned languages stays. The model learns from rows whose id's crc32 modulo 4 is not 2, or
    is null. docs keeps its columns, whatever their names, and its other rows: repeated ones, ones with a null id or lang. A
    null or empty text goes. An empty table stays empty.
    """
    fold = fold_remainder("doc_id", 4)
    model = fit(docs.where(fold.isNull() | (fold != 2)))
    names = tuple(unused(n, docs.columns) for n in PREDICTED)
    judged = predict(docs, model, tuple(docs.columns), names)
    return judged.where((F.col(names[0]) != "und") & (F.col(names[4]) >= KNOWN)).select(*docs.columns)
