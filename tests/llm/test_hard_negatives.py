"""Hard negatives against an enumeration of all pairs, and the intervals against true products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, dim, seed, labels=4, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(labels, dim))
    label = rng.integers(0, labels, n)
    return rng.normal(size=(n, dim)) * spread + middle[label], label


def brute(rows, anchors=lambda i: i % 50 == 0, positives=5, negatives=3, least=50, most=95):
    """Rows (id, label, vector) by definition."""
    fine = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, q in dict.fromkeys((i, lab, tuple(v)) for i, lab, v in fine):
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, other) for j, other, v in fine if j != i and len(v) == len(q))
        for s, j, other in [x for x in scored if x[2] == lab][:positives]:
            hard = [x for x in scored if x[2] != lab and least * -s <= 100 * -x[0] <= most * -s][:negatives]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, extra=(), **settings):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab) for i, lab, v in rows], SCHEMA)
    table = df.select(F.col("vec_id").alias("id"), "label", hn.integer_vectors(df).alias("vector"), *[F.lit("x").alias(c) for c in extra])
    return sorted(tuple(r) for r in hn.mine(table, F.col("id") % 50 == 0, **settings).collect())


@pytest.mark.parametrize("dim", [1, 7, 64, 100, 130])
def test_rotation_keeps_products(dim):
    a, _ = vectors(40, dim, 1)
    turned = hn.rotate(a)
    assert np.allclose(turned @ turned.T, a @ a.T)


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_intervals_hold_the_product_at_every_level(dim):
    rows, _ = vectors(300, dim, 2)
    rows = np.floor(rows * 256)
    rows[5] = 0  # a vector without direction
    asked, _ = vectors(20, dim, 3)
    asked = np.vstack([np.floor(asked * 256), np.zeros(dim), rows[:2]])
    codes, aligned, left, length = hn.encode(rows)
    widths = []
    for q, turned in zip(asked, hn.rotate(asked)):
        true, seen = rows @ q, []

        def cut(low, high):
            seen.append((low, high))
            return np.ones(len(low), bool)

        hn.candidates(hn.Asked(turned), np.arange(len(rows)), codes, aligned, left, length, cut)
        assert len(seen) == hn.LEVELS
        for low, high in seen:
            assert (low <= true).all() and (true <= high).all()
        widths.append([np.mean(high - low) for low, high in seen])
    widths = np.mean(widths, 0)
    assert (np.diff(widths) < 0).all(), "each level narrows the interval"


def test_filter_leaves_out_most_rows_of_clusters():
    rows, label = vectors(2000, 64, 4, labels=20, spread=0.3)
    rows = np.floor(rows * 256)
    codes, aligned, left, length = hn.encode(rows)
    q = rows[0]
    kept = hn.candidates(hn.Asked(hn.rotate(q[None])[0]), np.arange(len(rows)), codes, aligned, left, length, lambda low, high: high >= np.sort(low)[-5])
    assert set(np.argsort(-(rows @ q), kind="stable")[:5]) <= set(kept)
    assert len(kept) < 300


@pytest.mark.parametrize("dim,n", [(16, 400), (64, 300), (5, 250)])
def test_like_brute_force(spark, dim, n, monkeypatch):
    v, label = vectors(n, dim, dim)
    rows = [(i, int(label[i]), v[i].tolist()) for i in range(n)]
    assert mined(spark, rows) == brute(rows)


def test_small_blocks_give_the_same(spark):
    v, label = vectors(300, 24, 9)
    rows = [(i, int(label[i]), v[i].tolist()) for i in range(300)]
    df = spark.createDataFrame([(i, x, lab) for i, lab, x in rows], SCHEMA).repartition(9)
    table = df.select(F.col("vec_id").alias("id"), "label", hn.integer_vectors(df).alias("vector"))
    assert sorted(tuple(r) for r in hn.mine(table, F.col("id") % 50 == 0).collect()) == brute(rows)


def test_nulls_ties_repeats_and_odd_vectors(spark):
    v, label = vectors(120, 8, 7, labels=3)
    rows = [(i, int(label[i]), v[i].tolist()) for i in range(120)]
    same = v[3].tolist()
    rows += [(i, 0, same) for i in range(200, 230)] + [(i, 1, same) for i in range(230, 260)]  # ties across both labels
    rows += [rows[50], rows[50], rows[7], rows[7]]  # repeated rows, an anchor among them
    rows += [(300, None, same), (301, 1, None), (302, 1, [None] + same[1:]), (303, 1, [float("nan")] + same[1:]), (304, 1, [float("inf")] + same[1:])]
    rows += [(None, 1, same), (350, 1, []), (351, 1, []), (352, 2, []), (400, 1, [1.0, 2.0]), (401, 1, [1.0, 2.0]), (402, 0, [1.0, 1.0])]
    rows += [(450, 2, [0.0] * 8), (500, 2, [-x for x in same])]  # no direction; scores below zero
    got = mined(spark, rows, extra=("score", "anchor", "slot", "scores", "width", "rank", "found"))
    assert got == brute(rows)
    assert any(r[0] == 400 for r in got) and any(r[0] == 350 for r in got)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(2**20, 2**21, size=(60, 6)).astype(float)
    rows = [(i, i % 3, np.float32(base[i]).tolist()) for i in range(60)]
    assert mined(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1.0])]) == []
    assert mined(spark, [(0, 0, [1.0]), (1, 1, [0.9])]) == []  # no positive
    assert mined(spark, [(0, 0, [1.0]), (1, 0, [1.0]), (2, 1, [0.9])]) == [(0, 1, 1, 2, 65536, 256 * 230)]


def test_window_of_a_score():
    for p in (-7, 0, 1, 3, 100, 101, 12345):
        low, high = hn.window(p, 50, 95)
        inside = [s for s in range(-20, 13000) if 50 * p <= 100 * s <= 95 * p]
        assert inside == [s for s in range(-20, 13000) if low <= s <= high]
