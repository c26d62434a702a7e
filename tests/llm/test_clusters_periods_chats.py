"""Clusters, periodic runs and reply trees against brute force, and on odd rows."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyscript.llm import chats, clusters, periods
from tallyscript.llm.common import table
from tests.llm.test_operators import docs_of, empty, odd

# 11 Clusters


def plain_clusters(vectors, k, rounds, width, seed="3:"):
    """(cluster, distance) of each (vec_id, vector) that is usable, and the centroids, by loops over Python's integers."""
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(1024 * x))) for x in v]) for i, v in vectors if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in first[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))[::-1]

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[0], []).append(v)
        for n, group in groups.items():
            centroids[n] = [sum(c) // len(group) for c in zip(*group)]
    return [(i, *place(v)) for i, v in kept], centroids


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<double>, cluster int, v string")


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_against_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    vectors = [(i, [rng.choice([-1, 0, 1]) + rng.gauss(0, 0.2) for _ in range(5)]) for i in range(60)]
    vectors += [(100 + i, vectors[0][1]) for i in range(30)]  # one very common vector
    want, centroids = plain_clusters(vectors, 4, 3, 5)
    got = clusters.cluster(frame(spark, vectors), k=4, rounds=3, width=5).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    for r in got:
        assert r.cluster_inertia == sum(d for _, n, d in want if n == r.cluster) and r.inertia == sum(d for _, _, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_clusters_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, None), (2, [0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, -inf]), (None, [0.5, 0.5]), (6, [0.25, -0.0001]), (6, [0.25, -0.0001]), (7, [1e30, -1e30]), (8, []), (9, [0.1, 0.2, 0.3])]
    want, _ = plain_clusters(vectors, 8, 10, 2)
    got = clusters.cluster(frame(spark, vectors), width=2).collect()
    key = lambda r: (r[0] is None, *r)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key) and len(got) == 4
    assert clusters.cluster(frame(spark, vectors[:5]), width=2).collect() == [] == clusters.cluster(frame(spark, []), width=2).collect()
    far = [(i, [s * 1e30] * 64) for i, s in enumerate([1, -1, 1, 1, -1, -1])]
    top = clusters.cluster(frame(spark, far), k=1, rounds=0).collect()
    assert {r.distance for r in top} == {0, 1 << 62} and top[0].inertia is None  # three times 2^62 is no long


def test_cluster_plan_has_no_python(spark, sf_dir):
    plan = clusters.op11(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 12 Periodic runs


def plain_runs(w):
    n, found = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            seg = w[i : i + length]
            if length >= max(12, 2 * q) and not any(seg[d:] == seg[: length - d] for d in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def word_lists():
    rng = random.Random(4)
    for _ in range(150):
        w = [bytes([97 + rng.randrange(rng.choice([1, 2, 3, 5]))]) for _ in range(rng.randrange(90))]
        block = [bytes([97 + rng.randrange(3)]) for _ in range(rng.randrange(1, 9))]
        yield w[: len(w) // 3] + block * rng.randrange(9) + w[len(w) // 3 :]
    yield from (fibonacci(150), [b"x"] * 60, fibonacci(60) + [b"c"] + fibonacci(60), ([b"a"] * 20 + [b"b"]) * 4, [], [b"x"] * 12, [b"x"] * 11, [b"p%d" % (i % 6) for i in range(12)], [b"p%d" % (i % 7) for i in range(13)])


def test_runs_against_brute_force():
    texts = list(word_lists())
    got = periods.runs_of(texts)
    assert got == [plain_runs(t) for t in texts] and sum(map(len, got)) > 100
    assert [periods.runs_of([t])[0] for t in texts[-12:]] == got[-12:]  # texts beside a text change nothing


def test_runs_when_hashes_collide(monkeypatch):
    """Windows of one hash are told apart by their words."""
    texts = list(word_lists())
    monkeypatch.setattr(periods, "shared_starts", lambda words, text: periods.np.flatnonzero(text[: len(text) - 5] == text[5:]))
    assert periods.runs_of(texts) == [plain_runs(t) for t in texts]


def plain_row(doc_id, text, planted=True):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if planted and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *([best[0], best[1], best[2], 1000 * best[1] // best[2]] if best else [None] * 4), digest("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_op12_against_brute_force(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").where(F.length("text") < 6000).collect()]
    got = {r.doc_id: tuple(r) for r in periods.op12(spark, sf_dir).collect()}
    assert all(got[i] == plain_row(i, t) for i, t in texts) and sum(r[1] > 0 for r in got.values()) > 5


def test_runs_of_odd_texts(spark):
    docs = odd(spark).withColumns({"h": F.lit("x"), "n_runs": F.lit(1)})
    got = periods.periodic_runs(docs, planted=True).collect()
    assert len(got) == docs.count() and periods.periodic_runs(empty(spark), planted=True).collect() == []
    for r in got:
        if r.doc_id not in (4, 5):
            assert tuple(r) in {plain_row(d.doc_id, d.text) for d in docs.collect() if d.doc_id == r.doc_id}
    long = [r for r in got if r.doc_id == 4][0]
    assert (long.start, long.length, long.period) in {(0, 60_000, 997)} or zlib.crc32(b"4") % 10 == 0
    one = periods.periodic_runs(docs_of(spark, ["la " * 50_000, " a\x1cb " * 12])).orderBy("doc_id").collect()
    assert (one[0].n_runs, one[0].length, one[0].period) == (1, 50_000, 1) and one[0].collapsed_sha256 == hashlib.sha256(b"la").hexdigest()
    assert one[1].length == 12  # only blanks, tabs and line ends part words


# 13 Reply trees


def plain_paths(messages, most):
    """Each tree's best paths as lists of (role, text), by walking up from every leaf."""
    by, found = {m[:2]: m for m in messages}, {}
    inner = {(m[0], m[2]) for m in messages}
    for m in messages:
        if m[:2] in inner:
            continue
        path, at = [], m
        while at and len(path) <= len(messages):
            path.append(at)
            at = by.get((at[0], at[2]))
        if len(path) <= len(messages):
            found.setdefault(m[0], []).append((-sum(x[5] for x in path) / len(path), -len(path), f"{len(str(m[1]))}:{m[1]}#1", [(x[3], x[4]) for x in path[::-1]]))
    return {c: [p[3] for p in sorted(paths)[:most]] for c, paths in found.items()}


TREE = "conv_id long, message_id long, parent_id long, role string, text string, score double, tree string, node int, back int"


def tree_frame(spark, messages):
    return spark.createDataFrame([(*m, "x", 1, 2) for m in messages], TREE)


def test_paths_against_a_plain_walk(spark):
    rng = random.Random(8)
    words = ["a", "\\", "###", "####", "</turn>", "\n", "### User: ", "<", "/turn>", ": ", "é", "\\### Assistant: </turn> ok", ""]
    messages = []
    for conv in range(12):
        for i in range(rng.randrange(1, 40)):
            parent = None if i == 0 else rng.choice([i - 1, rng.randrange(i), 999 if rng.random() < 0.1 else i - 1])
            messages.append((conv, i, parent, rng.choice(["user", "assistant", "system", "tool: x", "=", "Assistant", "a:", "\\</turn>\n###"]), "".join(rng.choices(words, k=rng.randrange(6))), rng.choice([0.0, 0.5, 1.0])))
    messages += [(50, 1, 2, "user", "round", 1.0), (50, 2, 1, "user", "and round", 1.0), (50, 3, 2, "assistant", "hangs", 1.0)]  # a circle has no root
    for most in (1, 3):
        want = plain_paths(messages, most)
        got = {}
        for r in chats.format_paths(chats.messages_of(tree_frame(spark, messages)), most).collect():
            assert [chats.unescaped(r.document[s.start : s.end]) for s in r.loss] == [t for role, t in chats.turns_of(r.document) if role == "assistant"]
            got.setdefault(r.conv_id, {})[r["rank"]] = chats.turns_of(r.document)
        assert {c: [p[k] for k in sorted(p)] for c, p in got.items()} == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    messages = [(1, i, i - 1 if i else None, "user" if i % 2 else "assistant", str(i), 1.0) for i in range(700)]
    tables, kept = [], chats.written
    monkeypatch.setattr(chats, "written", lambda df, name: tables.append(name) or kept(df, name))
    row = chats.format_paths(chats.messages_of(tree_frame(spark, messages))).first()
    assert [t for _, t in chats.turns_of(row.document)] == [str(i) for i in range(700)] and len(tables) < 30


def test_chats_on_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", None), (None, 0, "user", "x"), (None, None, "assistant", "y" * 300_000), (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 0, "assistant", "tie")]
    turns = spark.createDataFrame([(*r, "z", 5) for r in rows], "conv_id long, turn long, role string, text string, node string, up int")
    got = {r.conv_id: r for r in chats.read_back(chats.format_paths(chats.messages_by_turn(turns))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (2, sha("\n\nassistant\n\n"), 0, sha(""))
    assert (got[None].n_turns, got[None].loss_chars) == (2, 300_000) and got[None].turns_sha256 == sha("assistant\n" + "y" * 300_000 + "\nuser\nx\n")
    assert got[2].n_turns == 3 and got[2].turns_sha256 == sha("assistant\ntie\nuser\nsame\nuser\nsame\n")
    assert chats.read_back(chats.format_paths(chats.messages_by_turn(turns.where("turn > 9")))).collect() == []
    repeated = [(1, 7, None, "user", "a", 1.0), (1, 7, None, "user", "a", 1.0), (1, 8, 7, "assistant", "b", None)]
    paths = chats.format_paths(chats.messages_of(tree_frame(spark, repeated)), 5).collect()
    assert sorted(len(chats.turns_of(r.document)) for r in paths) == [1, 2]  # the repeated row is a path of its own
