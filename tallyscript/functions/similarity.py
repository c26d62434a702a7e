"""Column functions that compare two texts or two vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyscript.functions.text import plain_words, without_visual


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which value is computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct words: 1 if both are empty, 0 if one is."""
    share = bound(F.size(F.array_intersect(a, b)), lambda common: common / (F.size(a) + F.size(b) - common))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def form_v04(text: Column) -> Column:
    """What alike_v04() compares: text and its set of words."""
    return F.struct(text.alias("text"), word_set(F.lower(text)).alias("words"))


def form_v03(text: Column) -> Column:
    """What alike_v03() compares: text, its spoken words in plain form, and their set."""
    return bound(plain_words(without_visual(text)), lambda plain: F.struct(text.alias("text"), plain.alias("plain"), word_set(plain).alias("words")))


def alike_v04(a: Column, b: Column) -> Column:
    return overlap(a["words"], b["words"])


def alike_v03(a: Column, b: Column) -> Column:
    """Raised by a fifth if both texts have at most three distinct words."""
    short = (F.size(a["words"]) <= 3) & (F.size(b["words"]) <= 3)
    raised = bound(overlap(a["words"], b["words"]), lambda score: F.when(short, F.least(score * 1.2, F.lit(1.0))).otherwise(score))
    return F.when((a["text"] == "") & (b["text"] == ""), 1.0).when((a["text"] == "") | (b["text"] == ""), 0.0).when(a["plain"] == b["plain"], 1.0).otherwise(raised)


def jaccard_v04(a: Column, b: Column) -> Column:
    return bound(F.struct(form_v04(a).alias("a"), form_v04(b).alias("b")), lambda w: alike_v04(w["a"], w["b"]))


def jaccard_v03(a: Column, b: Column) -> Column:
    """Of spoken words in plain form. Where texts are compared with several others, form_v03() of each once and alike_v03() do less."""
    return bound(F.struct(form_v03(a).alias("a"), form_v03(b).alias("b")), lambda w: alike_v03(w["a"], w["b"]))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def embedding_similarity(a: Column, b: Column) -> Column:
    """Cosine, moved to 0..1."""
    return (cosine(a, b) + 1) / 2


def short_boost(score: Column, a: Column, b: Column) -> Column:
    """Raise the score of short utterances by their mean number of words, up to 1; a null score stays null."""
    raised = bound((F.size(words(a)) + F.size(words(b))) / 2, lambda mean: F.when(mean <= 3, score * 1.3).when(mean <= 5, score * 1.1).otherwise(score))
    return F.when(score.isNotNull(), F.least(raised, F.lit(1.0)))


def hybrid(embedding_score: Column, a: Column, b: Column) -> Column:
    """The boosted similarity of embeddings where there is one, else that of words."""
    return F.coalesce(short_boost(embedding_score, without_visual(a), without_visual(b)), jaccard_v03(a, b))


def same_speaker_v04(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)
