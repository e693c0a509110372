"""Tables that grow by batches, lines that do not parse, and claims that come late."""

import datetime as dt
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import queries
from claimlens import constants as K
from claimlens import session
from claimlens.errors import ClaimLensError
from claimlens.operators import audit
from claimlens.schemas import RAW_CLAIMS
from claimlens.sources import quarantine, tables, upsert
from claimlens.streaming import audits


# --- upsert ----------------------------------------------------------------------------------------------


def batch(spark, rows):
    return spark.createDataFrame(rows, "claim_id string, amount double")


def rows_of(spark, path):
    return sorted((r["claim_id"] or "", r["amount"] or 0) for r in upsert.read_upserted(spark, path).collect())


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("keep", ["first", "last"])
def test_batches_are_a_rebuild(spark, tmp_path, keep):
    rng = random.Random(3)
    path, want = str(tmp_path / keep), {}
    for b in range(5):
        rows = {(f"C{rng.randrange(60)}" if i else None): rng.choice([None, float(rng.randrange(9))]) for i in range(25)}
        assert upsert.upsert_layer(batch(spark, list(rows.items())), path, f"b{b}", keep=keep, buckets=7)
        want = rows | want if keep == "first" else want | rows
        assert rows_of(spark, path) == sorted((k or "", v or 0) for k, v in want.items())
        assert not upsert.upsert_layer(batch(spark, list(rows.items())).repartition(3), path, f"b{b}", keep=keep, buckets=7)
    assert [(r["batch"], r["sequence"], r["rows"] > 0) for r in upsert.manifest(spark, path).orderBy("sequence").collect()] == [(f"b{b}", b, True) for b in range(5)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.upsert_layer(batch(spark, [(f"C{i}", 1.0) for i in range(200)]), path, "a", buckets=16)
    before = files(path)
    upsert.upsert_layer(batch(spark, [("C1", 2.0), ("new", 2.0)]), path, "b", buckets=16)
    after = files(path)
    folders = {os.path.dirname(f) for f in set(before) ^ set(after)}
    assert 1 <= len(folders) <= 2 and len({os.path.dirname(f) for f in after}) == 16
    assert all(after[f] == before[f] for f in set(before) & set(after))


def test_a_batch_that_broke_off_is_applied_again(spark, tmp_path):
    """The data was written, the manifest was not."""
    path = str(tmp_path / "t")
    upsert.upsert_layer(batch(spark, [("A", 1.0), ("B", 1.0)]), path, "a", buckets=4)
    upsert.upsert_layer(batch(spark, [("B", 2.0), ("C", 2.0)]), path, "b", buckets=4)
    for f in (tmp_path / "t" / "manifest").iterdir():
        if '"b"' in f.read_text(errors="ignore"):
            f.write_text("")
    for f in (tmp_path / "t" / "manifest").glob(".*.crc"):
        f.unlink()
    assert [r["batch"] for r in upsert.manifest(spark, path).where("batch is not null").collect()] == ["a"]
    want = rows_of(spark, path)
    assert upsert.upsert_layer(batch(spark, [("B", 2.0), ("C", 2.0)]), path, "b", buckets=4)
    assert rows_of(spark, path) == want == [("A", 1.0), ("B", 1.0), ("C", 2.0)]


def test_what_does_not_fit_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    good = batch(spark, [("A", 1.0)])
    upsert.upsert_layer(good, path, "a", buckets=4)
    for df, name, settings in ((batch(spark, [("A", 9.0)]), "a", {}), (good, "b", {"keep": "last"}), (good.withColumn("x", F.lit(1)), "c", {}), (good.union(good), "d", {}), (good, "e", {"buckets": 5})):
        with pytest.raises(ClaimLensError):
            upsert.upsert_layer(df, path, name, **{"buckets": 4} | settings)
    assert rows_of(spark, path) == [("A", 1.0)]
    with pytest.raises(ClaimLensError):
        upsert.read_upserted(spark, str(tmp_path / "none"))


def test_an_empty_batch_is_listed(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.upsert_layer(batch(spark, [("A", 1.0)]), path, "a", buckets=4)
    assert upsert.upsert_layer(batch(spark, []), path, "none", buckets=4) and not upsert.upsert_layer(batch(spark, []), path, "none", buckets=4)
    assert rows_of(spark, path) == [("A", 1.0)]


# --- quarantine ------------------------------------------------------------------------------------------


def test_no_line_is_lost(spark, tmp_path):
    good = ['C1,P1,PR1,D10,PROC1,12.5,2024-01-01', 'C2,P1,"PR, ""x""",,,,', ' C3 ,P1,PR1,D10,PROC1,-1e3,']
    bad = ["C4,P1,PR1,D10,PROC1,twelve,2024-01-01", "C5,P1", "C6,P1,PR1,D10,PROC1,1,2024-01-01,more", 'C7,"a,b",x', "free text"]
    for i, part in enumerate((good[:2] + bad[:2], bad[2:] + good[2:])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.csv").write_text("\n".join([",".join(RAW_CLAIMS.names), *part, ""]))
    kept, rejected = quarantine.read_with_quarantine(spark, str(tmp_path / "in"), RAW_CLAIMS)
    assert {(r["claim_id"], r["provider_id"], r["billed_amount"]) for r in kept.collect()} == {("C1", "PR1", 12.5), ("C2", 'PR, "x"', None), (" C3 ", "PR1", -1000.0)}
    assert kept.columns == tables.ingest_csv(spark, str(tmp_path / "in"), RAW_CLAIMS).columns
    assert sorted(r["line"] for r in rejected.collect()) == sorted(bad)
    assert {r["line"]: r["n_fields"] for r in rejected.collect()} == dict(zip(bad, (7, 2, 8, 3, 1)))
    counts = quarantine.ingest_with_quarantine(spark, str(tmp_path / "in"), RAW_CLAIMS, str(tmp_path / "out"), "bronze_claims")
    assert counts == (3, 5) and spark.read.parquet(str(tmp_path / "out" / "bronze_claims_rejected")).count() == 5


def test_clean_and_missing_files(spark, tmp_path):
    path = tables.write_csv(spark.createDataFrame([("C1", 1.0)], "claim_id string, billed_amount double"), str(tmp_path / "ok"))
    kept, rejected = quarantine.read_with_quarantine(spark, path, RAW_CLAIMS)
    assert kept.count() == 1 and rejected.count() == 0
    with pytest.raises(ClaimLensError) as info:
        quarantine.read_with_quarantine(spark, str(tmp_path / "none"), RAW_CLAIMS)
    assert info.value.error_code == "ING-1001"


# --- audits of a stream ----------------------------------------------------------------------------------

CLAIMS = "provider_id string, claim_date timestamp, validation_flags string, billed_amount double, expected_cost double"
FLAGS = ["", "", "WARN_HIGH_BILLING", "ERR_INCOMPLETE_CLAIM", "WARN_MISSING_AMOUNT|WARN_HIGH_BILLING"]


def some_claims(seed, n=600, providers=8):
    rng = random.Random(seed)
    return [(f"P{rng.randrange(providers)}" if i % 50 else None, None if i % 41 == 0 else dt.datetime(2026, 1, 1) + dt.timedelta(days=rng.randrange(300), hours=rng.randrange(24)),
             rng.choice(FLAGS if rng.random() < 0.6 else [""]), rng.choice([1.0, 5.0, 10.5, None]), rng.choice([1.0, 1.0, 0.0, None])) for i in range(n)]


def streamed(spark, tmp_path, slices, delay):
    folder, schema = str(tmp_path / "in"), spark.createDataFrame([], CLAIMS).schema
    os.makedirs(folder)
    for i, rows in enumerate(slices):
        spark.createDataFrame(rows, CLAIMS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    audits.write_audit_triggers(stream, out, str(tmp_path / "state"), delay).awaitTermination()
    return {r["provider_id"]: r for r in audits.latest_audit_triggers(spark, out).collect()}


def test_stream_in_time_equals_the_batch(spark, tmp_path):
    rows = sorted(some_claims(1), key=lambda r: (r[1] is not None, r[1] or 0))
    got = streamed(spark, tmp_path, [rows[i * 150 : (i + 1) * 150] for i in range(4)], 10)
    want = {r["provider_id"]: r for r in audit.audit_trigger(spark.createDataFrame(rows, CLAIMS)).collect()}
    assert set(got) == set(want)
    for p, r in want.items():
        assert all(got[p][c] == r[c] for c in want[p].asDict()) and got[p]["late_rows"] == 0
        assert got[p]["open_days"] < 100, "closed days leave the state"


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    rows = sorted((r for r in some_claims(2) if r[1]), key=lambda r: r[1])
    late = [("P1", dt.datetime(2026, 1, 5), "ERR_INCOMPLETE_CLAIM", 99.0, 1.0)] * 7 + [(f"P{i}", dt.datetime(2026, 1, 2), "", 1.0, 1.0) for i in range(3)]
    got = streamed(spark, tmp_path, [rows[:300], rows[300:], late], 10)
    want = {r["provider_id"]: r for r in audit.audit_trigger(spark.createDataFrame(rows, CLAIMS)).collect()}
    assert {p: r["late_rows"] for p, r in got.items() if r["late_rows"]} == {"P0": 1, "P1": 8, "P2": 1}
    for p, r in want.items():
        assert all(got[p][c] == r[c] for c in ("denial_rate_90d", "high_billing_30d", "incomplete_30d"))
    assert got["P1"]["single_claim"], "a single claim needs no window"


def test_windows_equal_a_plain_loop():
    rng = np.random.default_rng(5)
    for _ in range(200):
        days = np.unique(rng.integers(0, 400, rng.integers(1, 40)))
        sums = np.stack([rng.integers(1, 9, len(days)), rng.integers(0, 5, len(days)), rng.integers(0, 6, len(days)), rng.integers(0, 3, len(days))], axis=1)
        judged = rng.random(len(days)) < 0.5
        want = [False] * 3
        for d in days[judged]:
            long, short = (sums[(days > d - n) & (days <= d)].sum(axis=0) for n in (90, 30))
            want = [want[0] or long[1] / long[0] > K.AUDIT_HIGH_RATE, want[1] or short[2] > K.AUDIT_HIGH_BILLINGS, want[2] or short[3] > K.AUDIT_INCOMPLETE]
        assert list(audits.judge(days, sums, judged)) == [bool(w) for w in want]


def test_state_does_not_depend_on_how_rows_arrive():
    rows = pd.DataFrame([(d, 1, d % 2, d % 3 == 0, 0, False) for d in range(0, 200, 3)], columns=["day", "claims", "flagged", "high", "incomplete", "cost"])
    whole = audits.advance(None, rows, 120)
    state = None
    for at in range(0, len(rows), 7):
        state, outcome = audits.advance(state, rows[at : at + 7], None)
    state, outcome = audits.advance(state, rows[:0], 120)
    on_time = audits.advance(None, rows[rows["day"] > 120], 120)
    assert whole[1][5] == int((rows["day"] <= 120).sum()) and on_time[1][5] == 0
    assert whole[1][:4] == on_time[1][:4] and len(state[0]) == len([d for d in rows["day"] if d > 120 - 89])


def test_a_replayed_batch_is_compared_and_not_written(spark, tmp_path):
    df = spark.createDataFrame([(f"C{i}", i) for i in range(50)], "claim_id string, x int")
    assert upsert.upsert_layer(df, str(tmp_path), "a")
    before = len(session._staged)
    assert not upsert.upsert_layer(df, str(tmp_path), "a")
    assert len(session._staged) == before


def test_marked_files_grow_with_the_tasks(spark, tmp_path, monkeypatch):
    for i in range(4):
        spark.createDataFrame([(10 * i + j, f"text {i} {j}") for j in range(5)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    written, write = [], queries.documents.write_marked_docs
    monkeypatch.setattr(queries.documents, "write_marked_docs", lambda *a, **k: written.append(write(*a, **k)) or written[-1])
    assert queries.REGISTRY["read_marked_docs"](spark, str(tmp_path)).count() == 20
    assert len(spark.read.text(written[0]).inputFiles()) == 4


def test_a_delivery_of_several_files_is_one_micro_batch(spark, tmp_path, monkeypatch):
    lines = [(i, 1, i % 40, i % 3, 100.0 + i, dt.date(1994, 1, 1) + dt.timedelta(days=i % 700)) for i in range(400)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate date").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    paths, write = [], queries.audits.write_audit_triggers
    monkeypatch.setattr(queries.audits, "write_audit_triggers", lambda stream, path, state: paths.append(path) or write(stream, path, state))
    found = queries.REGISTRY["stream_audit_trigger"](spark, str(tmp_path))
    assert len(paths) == 5
    assert sorted(r["batch_id"] for r in spark.read.parquet(paths[0]).select("batch_id").distinct().collect()) == [0, 1, 2, 3, 4]
    want = {r["provider_id"]: r["triggered"] for r in queries.REGISTRY["audit_trigger"](spark, str(tmp_path)).collect()}
    assert {r["provider_id"]: r["triggered"] for r in found.collect()} == want


@pytest.mark.parametrize("parts", [1, 4])
def test_deliveries_hold_the_rows_of_all_files(spark, tmp_path, parts):
    """Places count rows within a file; with the table's rows as the bound, only the first file was delivered."""
    lines = [(i // 3, 1 + i % 3, i * 7 % 40, i % 5, 10.0 * i, dt.date(1995, 1, 1 + i % 28)) for i in range(300)]
    frame = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate date")
    frame.repartition(parts).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, k % 7) for k in range(100)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    batches = [b.collect() for b in queries._claim_batches(spark, str(tmp_path))]
    assert sorted(r["claim_id"] for b in batches for r in b) == sorted(f"C{i // 3}-{1 + i % 3}" for i in range(300))
    assert all(60 < len(b) < 140 for b in batches)
    places = [sorted(r["source_position"] for r in b) for b in batches]
    assert places[0][-1] < places[1][0] and places[1][-1] < places[2][0]
    assert queries.REGISTRY["upsert_silver"](spark, str(tmp_path)).count() == 300
