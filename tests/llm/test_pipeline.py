"""The pipeline's stages against brute force on the smallest tables."""

import itertools
import re

import pytest
from pyspark.sql import functions as F
from collections import Counter

import corpus_pipeline
from tallyscript.llm import decontaminate, language, mixing, secrets, tokens
from tallyscript.llm.common import table, written
from tests.llm.test_operators import empty, odd, shingle_set


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near", "decontaminate", "mix", "shard"]
    docs = table(spark, sf_dir, "documents")
    columns, held = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(written(stage(spark, held[-1], sf_dir), name))
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in held]
    assert all(d.columns == columns for d in held[:-1])
    # language: texts without a letter go; the given table has no language that was not learned
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(ids[0]) - set(ids[1]) == {i for i in ids[0] if not any(map(str.isalpha, texts[i] or ""))}
    # near duplicates: one document of each component stays
    sets = {i: shingle_set(texts[i], 5) for i in ids[1]}
    root = {i: i for i in ids[1]}
    for a, b in itertools.combinations(sorted(ids[1]), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    assert sorted(ids[2]) == sorted(set(root.values()))
    # mixing and shards: as many copies as planned, all of them stored
    plan = {r.doc_id: r.copies for r in mixing.mix(held[3]).collect()}
    assert Counter(ids[4]) == Counter({i: n for i, n in plan.items() if n})
    assert Counter(ids[5]) == Counter(ids[4])
    assert corpus_pipeline.run(spark, sf_dir).count() == len(ids[5])


CLASHING = ("score", "margin", "ambiguous", "lang_pred", "known", "n_words", "n_hit", "items", "spans", "text_hash", "component_id", "set_key", "row", "id", "tokens", "hash", "n", "each", "part", "place", "copies", "source_", "file", "run", "task", "key", "_file", "_key", "bytes", "shard")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, sf_dir, name):
    """Nulls, empty, long and repeated texts, repeated rows, null ids, columns of any name; then no row at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd(spark).withColumns({c: F.lit(c) for c in CLASHING})
    got = stage(spark, docs, sf_dir)
    rows = got.collect()
    ids = sorted((r.doc_id is not None, r.doc_id) for r in rows)
    all_ids = sorted((r.doc_id is not None, r.doc_id) for r in docs.collect())
    if name != "shard":
        assert got.columns == docs.columns and all(r[c] == c for r in rows for c in CLASHING)
    if name == "near":
        assert [i for _, i in ids] == [None, 0, 1, 2, 3, 4, 6]
    elif name in ("decontaminate", "shard"):
        assert ids == all_ids
    elif name == "mix":
        assert {i for _, i in ids} == {3, 4, 5, 6}  # the others have no words
    else:
        assert {i for _, i in ids} <= {3, 4, 5, 6}
    assert stage(spark, empty(spark), sf_dir).count() == 0


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("pattern_bytes", [2 << 20, 700])
def test_decontamination_against_brute_force(spark, sf_dir, monkeypatch, pattern_bytes):
    """A document goes if ten words in a row of an item, or a whole shorter item, occur in it; however many blocks the benchmark has."""
    monkeypatch.setattr(decontaminate, "PATTERN_BYTES", pattern_bytes)
    docs = table(spark, sf_dir, "documents")
    items = [benchmark_words(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    items = [w for w in items if w]
    first = next(w for w in items if len(w) > 12)
    short = next((w for w in items if len(w) < 10), None)
    added = [(-1, "x " + " ".join(first[1:11]).upper() + " y"), (-2, " ".join(first[1:10])), (-3, "so: " + "-".join(short or first))]
    docs = docs.unionByName(spark.createDataFrame(added, "doc_id long, text string"), allowMissingColumns=True)
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def clean(text):
        words = benchmark_words(text)
        return not any(tuple(words[i : i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    want = sorted(r.doc_id for r in docs.collect() if clean(r.text))
    stage = decontaminate.decontamination_stage(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in stage.collect()) == want and -1 not in want and -3 not in want and -2 in want and len(want) < docs.count() - 2
    plan = stage._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_language_model_of_many_languages(spark):
    """No language is left out, however many there are and however few rows they have."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda k: letters[k % 26] + letters[k // 26 % 26]
    rows = [(k, f"{name(k)}{name(k)}x {name(k)}q{name(k)} " * 5, name(k)) for k in range(600)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted({r[2] for r in rows}) and len(model.languages) == 600
    sent = language.SENT
    try:
        language.SENT = 10
        assert language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == model.languages
    finally:
        language.SENT = sent


def test_bytes_that_are_no_text(spark):
    """Strings may hold bytes that are no UTF-8: they are read as replacement characters and nothing fails."""
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'FF616263FE' AS string) AS text, 'en' AS lang, 's' AS source, 3L AS n_chars UNION ALL SELECT 2L, cast(X'C328' AS string), 'en', 's', 2L")
    assert len(language.predict(docs, language.fit(docs)).collect()) == 2
    assert [r.spans for r in secrets.find_secrets(docs).collect()] == ["", ""]
    import public_tokenizers

    encode = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    bad = b"\xffabc\xfe"
    assert encode.encode([bad]) == [tokens.packed(encode.library.encode(bad.decode(errors="replace"), add_special_tokens=False).ids)]
