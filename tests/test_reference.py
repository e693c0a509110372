"""Merged profiles, documents cut at marks, and reference rows by date."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimlens.errors import ClaimLensError
from claimlens.operators import sketches, validity
from claimlens.sources import documents


# --- merged profiles -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 60_000
    frame = pd.DataFrame({"part": np.arange(n) % 7, "x": np.where(rng.random(n) < 0.1, 5.0, rng.normal(1e6, 3, n)), "k": rng.integers(0, 20_000, n), "name": [f"n{i % 900}" for i in range(n)]})
    frame.loc[::13, "x"] = np.nan
    return spark.createDataFrame(frame).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).withColumn("none", F.lit(None).cast("double")), frame


def merged(spark, path):
    return {r["column_name"]: r for r in sketches.merged_profile(spark, path).collect()}


def test_merged_equals_whole_within_bounds(spark, table, tmp_path):
    df, frame = table
    path = str(tmp_path / "p")
    for k in range(7):
        sketches.write_partition_profile(df.where(F.col("part") == k), path, str(k))
    got = merged(spark, path)
    for c in ("x", "k"):
        v = frame[c].dropna().to_numpy(float)
        r = got[c]
        assert (r["rows"], r["missing"], r["min"], r["max"]) == (60_000, 60_000 - len(v), v.min(), v.max())
        assert abs(r["mean"] - v.mean()) < 1e-9 * abs(v.mean()) and abs(r["std"] - v.std(ddof=1)) < 1e-6 * v.std(ddof=1)
        assert abs(r["distinct_estimate"] - len(set(v))) <= 0.04 * len(set(v))
        for name, p in sketches.QUARTILES.items():
            assert (v < r[name]).mean() <= p + 0.005 and (v <= r[name]).mean() >= p - 0.005
    assert abs(got["name"]["distinct_estimate"] - 900) <= 36 and got["name"]["mean"] is None
    assert got["none"]["missing"] == 60_000 and got["none"]["q50"] is None and got["none"]["std"] is None
    spans = {(r["column_name"], r["name"]): r for r in sketches.rank_span(df, sketches.merged_profile(spark, path)).collect()}
    assert all(r["below"] <= sketches.QUARTILES[n] + 0.005 and r["upto"] >= sketches.QUARTILES[n] - 0.005 for (_, n), r in spans.items())


def test_a_new_partition_costs_only_itself(spark, table, tmp_path):
    df, _ = table
    path = str(tmp_path / "p")
    sketches.write_partition_profile(df.where("part = 0"), path, "0")
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "p").rglob("*.parquet")}
    sketches.write_partition_profile(df.where("part = 1"), path, "1")
    assert all(f.stat().st_mtime_ns == t for f, t in before.items())
    assert merged(spark, path)["k"]["rows"] == df.where("part < 2").count()
    sketches.write_partition_profile(df.where("part = 1"), path, "1")
    assert merged(spark, path)["k"]["rows"] == df.where("part < 2").count(), "a partition written again replaces itself"
    with pytest.raises(ClaimLensError):
        sketches.merged_profile(spark, str(tmp_path / "none"))


# --- documents -------------------------------------------------------------------------------------------


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab \n-é", k=rng.choice([0, 1, 30, 900]))) for _ in range(700)]
    body = documents.MARK.join(texts)
    (tmp_path / "big.txt").write_text(body)
    (tmp_path / "small.txt").write_text("only one" + documents.MARK)
    (tmp_path / "notes.md").write_text("no")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "8k", "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = documents.read_marked_docs(spark, str(tmp_path))
            got = sorted((r["source_file"], r["document"], r["text"]) for r in df.collect())
            assert got == [("big.txt", i, t) for i, t in enumerate(body.split(documents.MARK)) if t] + [("small.txt", 0, "only one")]
            if size == "8k":
                splits = spark.read.option("lineSep", documents.MARK).text(str(tmp_path / "big.txt")).rdd.getNumPartitions()
                assert splits > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_written_documents_come_back(spark, tmp_path):
    texts = [("a\nb",), ("",), ("--- end",), ("c" * 5000,)]
    path = documents.write_marked_docs(spark.createDataFrame(texts, "text string"), str(tmp_path / "d"), files=1)
    assert sorted(r["text"] for r in documents.read_marked_docs(spark, path).collect()) == sorted(t for t, in texts if t)
    with pytest.raises(Exception, match="contains the mark"):
        documents.write_marked_docs(spark.createDataFrame([("x" + documents.MARK,)], "text string"), str(tmp_path / "e"))
    with pytest.raises(ClaimLensError):
        documents.read_marked_docs(spark, str(tmp_path / "none"))


# --- dated reference rows --------------------------------------------------------------------------------


def day(n):
    return None if n is None else dt.date(2026, 1, 1) + dt.timedelta(days=n)


def brute(claims, reference, ends):
    out = []
    for i, key, n in claims:
        rows = [(f, cost, t) for k, f, t, cost in reference if k == key and k is not None and f is not None and n is not None and f <= n]
        last = max((r for r in rows), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0), default=None)
        good = last and (not ends or last[2] is None or n < last[2])
        out.append((i, last[1] if good else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("ends", [False, True])
@pytest.mark.parametrize("hot", [False, True])
def test_as_of_equals_brute_force(spark, ends, hot):
    rng = random.Random(ends * 2 + hot)
    keys = ["A"] * 30 + ["B", "C", "D", None] if hot else ["A", "B", "C", "D", None]
    claims = [(i, rng.choice(keys), rng.choice([None, *range(-5, 60)])) for i in range(800)]
    reference = [(rng.choice(keys), f, None if rng.random() < 0.5 else f + rng.randint(0, 12), rng.choice([1.0, 2.0, 3.0])) for f in (rng.randint(0, 50) for _ in range(40))] + [("A", None, None, 9.0)]
    c = spark.createDataFrame([(i, k, day(n)) for i, k, n in claims], "claim_id long, code string, claim_date date").repartition(7)
    r = spark.createDataFrame([(k, day(f), day(t), cost) for k, f, t, cost in reference], "code string, valid_from date, valid_to date, cost double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = validity.valid_on(c, r, "code", ["cost"], valid_to="valid_to" if ends else None)
        assert got.columns == ["claim_id", "code", "claim_date", "cost"]
        assert sorted(((x["claim_id"], x["cost"]) for x in got.collect()), key=str) == brute(claims, reference, ends)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_as_of_with_repeats_and_empty_tables(spark):
    c = spark.createDataFrame([(1, "A", day(3))] * 3, "claim_id long, code string, claim_date date")
    r = spark.createDataFrame([("A", day(3), 1.0), ("A", day(3), 2.0)], "code string, valid_from date, cost double")
    assert [x["cost"] for x in validity.valid_on(c, r, "code", ["cost"]).collect()] == [2.0] * 3
    assert [x["cost"] for x in validity.valid_on(c, r.limit(0), "code", ["cost"]).collect()] == [None] * 3
    assert validity.valid_on(c.limit(0), r, "code", ["cost"]).count() == 0
    with pytest.raises(ValueError):
        validity.valid_on(c.withColumn("cost", F.lit(1)), r, "code", ["cost"])
