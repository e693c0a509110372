"""Ranked search against a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from claimlens.llm import ranked_search as rs

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(bool(c) for _, c in counted)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counted:
            n = sum(c.values())
            if n:
                m = 50 + (50 * n * n_docs) // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
                if s > 0:
                    found.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, extra=(), **settings):
    a = spark.createDataFrame([(d, t, *["x"] * len(extra)) for d, t in docs], ", ".join(["doc_id long", "text string", *[f"{c} string" for c in extra]]))
    b = spark.createDataFrame([(d, t, *["x"] * len(extra)) for d, t in items], ", ".join(["item_id long", "text string", *[f"{c} string" for c in extra]]))
    return sorted([tuple(r) for r in rs.search(a, b, **settings).collect()], key=str)


def corpus(n, seed, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Äpfel", "naïve", "日本", "X1", "İx"]
    return [(i, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=rng.choice([1, 3, 8, 20, 60, 200])))) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"size": 7, "block": 3, "first": 1}, {"size": 16, "sent_bytes": 0, "first": 1, "k": 5}])
def test_like_brute_force(spark, settings):
    docs, items = corpus(300, 1), corpus(12, 2)
    assert searched(spark, docs, items, **settings) == brute(docs, items, settings.get("k", 50))


def test_bounds_leave_slices_unvisited(spark, monkeypatch):
    """Documents that hold the whole item stand in few slices; the others cannot reach them."""
    docs = corpus(400, 3) + [(1000 + i, "rare words stand here together " * (1 + i % 3)) for i in range(9)]
    items = [(0, "rare words stand here together w0 w1 w2")]
    joined = []
    score = rs._score
    monkeypatch.setattr(rs, "_score", lambda k: (joined.append(k), score(k))[1])
    assert searched(spark, docs, items, size=8, first=1, k=5) == brute(docs, items, 5)
    assert joined == [5, 5]


def test_bound_holds_every_score():
    rng = np.random.default_rng(1)
    tf = rng.integers(1, 40, 1000)
    for m in (50, 51, 100, 3000):
        gains = rs.impacts(np.sort(tf), m)
        assert (np.diff(gains) >= 0).all()
        assert gains.tolist() == [(10**9 * int(t)) // (1000 * int(t) + 20 * m) for t in np.sort(tf)]


def test_terms_of_bytes_and_of_text_agree():
    text = "A-b C_d É1é\x7f日本·x\x00y { z } K İ 9"
    assert [t.decode() for t in rs.terms_of(text.encode())] == terms(text)


def test_nulls_empty_long_repeats_ties_and_clashing_names(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "alpha beta"), (5, "beta alpha"), (6, "alpha beta"), (6, "alpha beta"), (None, "alpha beta"), (None, "alpha"),
            (7, "gamma " * 50_000 + "alpha"), (-8, "alpha beta"), (9, "Alpha BETA")]
    items = [(1, "alpha"), (1, "alpha"), (2, None), (3, ""), (None, "beta gamma"), (4, "nowhere"), (5, "alpha " * 3000)]
    got = searched(spark, docs, items, extra=("row_id", "terms", "n", "m", "block", "rank", "score", "term", "slice"))
    assert got == brute(docs, items)
    assert searched(spark, docs, items, sent_bytes=0, size=2, block=1, first=1) == brute(docs, items)


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, "")], [(1, "a")]) == []


def test_a_common_stratum_is_cut_into_slices(spark):
    docs = [(i, "one two three") for i in range(500)] + [(1000 + i, "one four five") for i in range(20)]
    assert searched(spark, docs, [(0, "four one")], size=32) == brute(docs, [(0, "four one")])
