"""Segments whose digests lie: their bytes decide."""

import random

import pytest

from tallyscript.llm import repeats
from tests.llm.test_operators import brute_removed, docs_of


@pytest.mark.parametrize("digest_bits", [0, 2, 64])
@pytest.mark.parametrize("length,anchors,group_bytes", [(24, (10, 20, 24), repeats.GROUP_BYTES), (24, (10, 20, 24), 200), (8, (8,), repeats.GROUP_BYTES)])
def test_forced_collisions(spark, digest_bits, length, anchors, group_bytes):
    """With a digest of no or of two bits nearly all segments of an anchor look equal; what is removed stays as brute force has it."""
    rng = random.Random(length)
    piece = lambda n: "".join(rng.choices("abcdé ", k=n))
    shared = [piece(n) for n in (length - 2, length, length + 1, 2 * length, 5 * length)]
    anchor = piece(12)  # in many texts with other surroundings, so that segments share an anchor only
    texts = [None, "", "ab" * (3 * length)] + [piece(rng.randrange(3 * length)) + rng.choice([*shared, anchor])[rng.randrange(3) :] + piece(rng.randrange(3 * length)) + rng.choice(shared) for _ in range(40)]
    texts += [texts[9], texts[9]]
    rows = docs_of(spark, texts)
    rows = rows.unionByName(rows.where("doc_id = 12"))  # a repeated row is a second place for all of its text
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(rows, length, anchors, group_bytes, digest_bits).collect())
    want = brute_removed([*texts, texts[12]], length)
    assert got == sorted([(i, *w) for i, w in enumerate(want[:-1])] + [(12, *want[-1])])
