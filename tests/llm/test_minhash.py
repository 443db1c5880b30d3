"""Tensored MinHash tables against all pairs."""

import random

import numpy as np
import pytest

from strata.llm import minhash_dedup
from strata.llm.common import SPACE_WORDS_LOWER, mix, word_hashes
from tests.llm import plain


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_of_odd_documents(spark, k, num):
    rows = plain.odd_documents()
    got = minhash_dedup.near_duplicates(plain.documents(spark, rows).selectExpr("*", "1 AS kept", "2 AS digest"), k=k, num=num, den=100).collect()
    exp = [(i, n, c, i == c) for i, n, c in plain.classes([(i, t) for i, t, *_ in rows], k, num, 100)]
    plain.same([tuple(r) for r in got], exp)


def test_chains_hot_groups_and_folds(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "FOLD_KEYS", 1000)
    monkeypatch.setattr(minhash_dedup, "AT_ONCE", 500)
    rnd = random.Random(3)
    say = lambda n: [f"t{rnd.randrange(400)}" for _ in range(n)]
    rows, base = [], say(90)
    for i in range(120):  # a chain: each differs from the last by one word, so its ends don't link
        base = list(base)
        base[rnd.randrange(90)] = f"c{i}"
        rows.append((1000 - i, " ".join(base), "en", "a"))
    hub = say(70)
    for i in range(150):
        near = list(hub)
        near[rnd.randrange(70)] = f"h{i}"
        rows.append((2000 + i, " ".join(near), "en", "a"))
    rows += [(3000 + i, rows[5][1], "en", "b") for i in range(40)]
    rows += [(4000 + i, " ".join(say(rnd.randint(1, 8))), "en", "b") for i in range(60)]
    got = minhash_dedup.near_duplicates(plain.documents(spark, rows), k=3, num=85, den=100).collect()
    plain.same([tuple(r)[:3] for r in got], plain.classes([(i, t) for i, t, *_ in rows], 3, 85, 100))


def test_repeated_ids_and_empty_table(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(7, a, "en", "a"), (7, b, "en", "a"), (3, b + " more", "en", "a"), (9, a, "en", "a"), (9, a, "en", "a"), (None, a, "en", "a")]
    got = sorted(map(repr, minhash_dedup.near_duplicates(plain.documents(spark, rows), k=3, num=85, den=100).collect()))
    expected = [(7, 58, 7, True), (7, 58, 3, False), (3, 59, 3, True), (9, 58, 7, False), (9, 58, 7, False), (None, 58, None, False)]
    plain.same([tuple(r)[:3] for r in minhash_dedup.near_duplicates(plain.documents(spark, rows), k=3, num=85, den=100).collect()], [e[:3] for e in expected])
    assert len(got) == 6
    assert minhash_dedup.near_duplicates(plain.documents(spark, rows).limit(0)).count() == 0


def test_pairs_at_the_threshold_meet():
    """Pairs of similarity 0.85 share two collections; unlike ones hardly ever."""
    rng = np.random.default_rng(1)
    fresh = lambda n: mix(rng.integers(1, 1 << 63, n).astype(np.uint64))
    missed = met = 0
    for _ in range(300):
        both, a, b = fresh(170), fresh(15), fresh(15)
        x, y = minhash_dedup.collection_keys([np.sort(np.append(both, a)), np.sort(np.append(both, b))])
        missed += np.count_nonzero(x == y) < 2
        u, v = minhash_dedup.collection_keys([fresh(100), fresh(100)])
        met += np.count_nonzero(u == v) >= 2
    assert missed == 0 and met == 0


def test_an_estimate_by_minhashes_is_the_similarity():
    rng = np.random.default_rng(2)
    fresh = lambda n: mix(rng.integers(1, 1 << 63, n).astype(np.uint64))
    shares = []
    for _ in range(100):
        both = fresh(120)
        x, y = minhash_dedup.collection_keys([np.append(both, fresh(40)), np.append(both, fresh(40))], collections=96, rows=1)
        shares.append((x == y).mean())
    assert abs(np.mean(shares) - 0.6) < 0.02


def test_table_keys_are_pairs_of_collections():
    words = word_hashes("a b c d e", SPACE_WORDS_LOWER)
    assert len(minhash_dedup.table_keys(words)) == 10 and len(set(minhash_dedup.table_keys(words))) == 10
    assert len(minhash_dedup.table_keys(words[:1])) == 0
