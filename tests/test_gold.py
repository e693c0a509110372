import datetime as dt

from pyspark.sql import functions as F

from claimlens import constants as K
from claimlens.operators import features, kpi, profile, quality, quantiles

SCHEMA = (
    "claim_id string, patient_id string, provider_id string, diagnosis_code string, procedure_code string, severity string, "
    "billed_amount double, expected_cost double, claim_date timestamp, flag_missing_diagnosis boolean, flag_missing_procedure boolean, "
    "flag_missing_amount boolean, flag_high_billing boolean, flag_invalid_diagnosis boolean, flag_incomplete_claim boolean, validation_flags string"
)
JAN, JUN = dt.datetime(2024, 1, 15), dt.datetime(2024, 6, 1)


def validated(spark):
    return spark.createDataFrame([
        ("C1", "P1", "PR1", "D10", "PROC1", "High", 4000.0, 5000.0, JAN, False, False, False, False, False, False, ""),
        ("C2", "P2", "PR1", None, "PROC1", None, 5000.0, 5000.0, JAN, True, False, False, False, False, False, "WARN_MISSING_DIAGNOSIS"),
        ("C3", "P3", "PR2", None, None, None, None, None, JUN, True, True, True, False, False, True, "WARN_MISSING_DIAGNOSIS|ERR_INCOMPLETE_CLAIM"),
        ("C4", "P4", None, "D20", "PROC1", "High", 20000.0, 5000.0, None, False, False, False, True, False, False, "WARN_HIGH_BILLING"),
    ], SCHEMA)


def gold(spark):
    return {r["claim_id"]: r for r in features.gold_features(validated(spark)).collect()}


def test_features(spark):
    g = gold(spark)
    assert [g[c]["claim_amount_ratio"] for c in ("C1", "C3", "C4")] == [0.8, None, 4.0]
    assert [g[c]["diagnosis_severity_flag"] for c in ("C1", "C2", "C3", "C4")] == [1, 0, 0, 1]
    assert [g[c]["missing_fields_count"] for c in ("C1", "C2", "C3")] == [0, 1, 3]
    assert [g[c]["is_high_biller"] for c in ("C1", "C4")] == [0, 1]
    assert [g[c]["claim_month"] for c in ("C1", "C3", "C4")] == [1, 6, None]
    assert [g[c]["risk_score"] for c in ("C1", "C2", "C3", "C4")] == [0, 2, 8, 2]


def test_provider_totals_skip_claims_without_provider(spark):
    g = gold(spark)
    assert (g["C1"]["provider_claim_count"], g["C1"]["provider_denial_rate"]) == (2, 0.5)
    assert (g["C4"]["provider_claim_count"], g["C4"]["provider_denial_rate"]) == (None, None)


def test_label_before_and_after_noise(spark):
    rows = validated(spark)
    plain = {r["claim_id"]: r["denial_label"] for r in features.add_denial_label(rows, noise=0.0).collect()}
    assert plain == {"C1": 0, "C2": 0, "C3": 1, "C4": 0}
    flipped = {r["claim_id"]: r["denial_label"] for r in features.add_denial_label(rows, noise=1.0).collect()}
    assert flipped == {k: 1 - v for k, v in plain.items()}


def test_noise_hits_about_one_in_twenty_and_ignores_partitioning(spark):
    df = spark.range(20000).select(F.concat(F.lit("C"), "id").alias("claim_id"), F.lit(False).alias("flag_high_billing"))
    sets = [
        {r["claim_id"] for r in features.add_denial_label(df.repartition(n)).where("denial_label = 1").collect()} for n in (1, 4, 17)
    ]
    assert sets[0] == sets[1] == sets[2] and 0.045 < len(sets[0]) / 20000 < 0.055


def test_projection_skips_absent_columns(spark):
    df = spark.createDataFrame([(1, "x", "C1")], "other int, specialty string, claim_id string")
    assert features.gold_projection(df).columns == ["claim_id", "specialty"]
    assert features.gold_features(validated(spark)).columns == [c for c in K.GOLD_COLUMNS if c not in ("specialty", "location", "category", "average_cost")]


def test_month_without_date_column(spark):
    assert features.add_claim_month(spark.createDataFrame([("C1",)], "claim_id string")).first()["claim_month"] is None


def test_partial_aggregate_replaces_the_provider_window(spark):
    plan = features.provider_stats(validated(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("HashAggregate") == 2


def test_kpis(spark):
    claims = spark.createDataFrame([("PR1", 10.0, "2024-01-01"), ("PR1", None, "2024-01-01"), ("PR2", 5.0, "bad"), (None, 1.0, "2023-12-31")],
                                   "provider_id string, billed_amount double, date string")
    assert tuple(kpi.kpi_summary(claims).first()) == (4, 16.0, 2)
    assert tuple(kpi.kpi_summary(claims.where("billed_amount is null")).first()) == (1, 0.0, 1)
    assert [tuple(r) for r in kpi.claims_trend(claims).collect()] == [("2023-12-31", 1.0), ("2024-01-01", 10.0)]
    assert kpi.claims_trend(claims.drop("date")).count() == 0
    providers = spark.createDataFrame([("PR1", "Dr A"), ("PR2", None)], "provider_id string, doctor_name string")
    assert [tuple(r) for r in kpi.provider_activity(claims, providers).collect()] == [("Dr A", 2)]


def test_history(spark):
    t = dt.datetime(2024, 1, 1, 12, 30)
    rows = [(i, "ann" if i % 2 else "bob", f"C{i}", 0.1235, "LOW", i % 2, "", t + dt.timedelta(minutes=i)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, username string, claim_id string, denial_probability double, risk_level string, is_denied int, flags string, submitted_at timestamp")
    mine, every = kpi.history_latest(df, "ann"), kpi.history_latest(df, "ann", is_admin=True)
    assert mine.count() == every.count() == 100
    assert {r["submitted_by"] for r in mine.collect()} == {"ann"} and every.first()["id"] == 299
    shown = kpi.history_display(every, is_admin=True).first()
    assert (shown["denial_probability"], shown["is_denied"], shown["submitted_at"]) == (f"{0.1235 * 100:.1f}%", K.DENIED_TEXT, "2024-01-01 17:29")
    assert "submitted_by" not in kpi.history_display(every).columns


def test_exact_quantiles_match_pandas(spark):
    import random

    import pandas as pd

    rng = random.Random(3)
    # a third of the values are one value; long enough for the bracketed path
    data = [(float(rng.choice([7.0, rng.randint(0, 50), rng.gauss(10, 30)])), None if i % 3 else float(i)) for i in range(30011)]
    df = spark.createDataFrame(data, "a double, b double").repartition(5)
    frame = pd.DataFrame(data, columns=["a", "b"])
    got = {(r["column_name"], r["p"]): r["value"] for r in quantiles.exact_quantiles(df, ["a", "b"], (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
    for (c, p), v in got.items():
        assert abs(v - frame[c].quantile(p)) < 1e-9, (c, p)
    assert len(got) == 10


def test_quantiles_without_nan_and_under_many_passes(spark, monkeypatch):
    import random

    import pandas as pd

    rng = random.Random(4)
    data = [(1e6 * rng.random() ** 9 if i % 5 else float("nan"), None, float(i % 3), rng.choice([1.0, 2.0])) for i in range(20000)]
    frame = pd.DataFrame(data, columns=list("abcd"))
    df = spark.createDataFrame(data, "a double, b double, c double, d double").repartition(3)
    for ranked, margin in ((1000, 0.001), (2, 0.001), (5, 1e-9)):
        monkeypatch.setattr(quantiles, "_RANKED", ranked)
        monkeypatch.setattr(quantiles, "_MARGIN", margin)
        got = {(r["column_name"], r["p"]): r["value"] for r in quantiles.exact_quantiles(df, list("abcd"), (0.1, 0.5, 0.999)).collect()}
        assert set(got) == {(c, p) for c in "acd" for p in (0.1, 0.5, 0.999)}
        assert all(abs(v - frame[c].quantile(p)) < 1e-9 for (c, p), v in got.items())
    row = {r["column_name"]: r for r in profile.profile_numeric(spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, float("nan"), float("nan"))], "x double")).collect()}["x"]
    assert (row["count"], row["mean"], row["75%"], row["max"]) == (3.0, 2.0, 2.5, 3.0)
    assert quantiles.exact_quantiles(df.limit(0), ["a"], (0.5,)).count() == 0


def test_small_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], (0.5,)).first()["value"] == 3.0


def test_profile(spark):
    df = spark.createDataFrame([("C1", "2024-01-01", 1.0), ("C1", "x", 2.0), (None, None, None), (None, "2024-03-01", 4.0)],
                               "claim_id string, claim_date string, amount double")
    assert tuple(profile.profile_shape(df, "t").first())[:3] == ("t", 4, 3)
    assert {r["column_name"]: (r["missing"], r["missing_pct"]) for r in profile.profile_missing(df).collect()} == {
        "claim_id": (2, 50.0), "claim_date": (1, 25.0), "amount": (1, 25.0)}
    assert profile.profile_duplicates(df).first()[0] == 2
    r = profile.profile_date_range(df).first()
    assert (str(r["min_date"])[:10], str(r["max_date"])[:10], r["invalid"]) == ("2024-01-01", "2024-03-01", 2)
    assert {r[0]: r[1] for r in profile.profile_cardinality(df).collect()} == {"claim_id": 1, "claim_date": 3, "amount": 3}
    assert {r[0]: r[1] for r in profile.profile_cardinality(df, approx=True).collect()} == {"claim_id": 1, "claim_date": 3, "amount": 3}
    s = profile.profile_numeric(df).first()
    assert (s["count"], s["mean"], s["std"], s["50%"], s["max"]) == (3.0, 2.33, 1.53, 2.0, 4.0)
    text = "\n".join(r["line"] for r in profile.profile_lines(df, "t").orderBy("section", "position").collect())
    assert "2 duplicate(s) found" in text and "PROFILING REPORT: t" in text


def test_long_texts_are_counted_by_digest(spark):
    texts = ["a" * 64, "a" * 65, "a" * 65, "b" * 5000, "b" * 5001, None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert profile.profile_cardinality(df).first()["distinct_values"] == 4


def test_quality(spark):
    df = spark.createDataFrame([("C1", None), ("C2", "x")], "claim_id string, b string")
    issues = {(r["column_name"], r["issue"], r["null_pct"]) for r in quality.quality_check(df, "t", ("claim_id", "b", "c")).collect()}
    assert issues == {("b", "HIGH NULLS", 50.0), ("c", "COLUMN MISSING", None)}
    texts = {r[0] for r in quality.issue_text(quality.quality_check(df, "t", ("b", "c"))).collect()}
    assert texts == {"[t] HIGH NULLS in 'b': 50.0%", "[t] COLUMN MISSING: 'c'"}
    assert tuple(quality.quality_summary({"t": df}, {"t": ("claim_id", "b", "c")}).first()) == ("t", 2, 2, 1, 2)
    lines = [r["line"] for r in quality.quality_report({"t": df.select("claim_id")}).orderBy("position").collect()]
    assert lines[-1].endswith("No critical issues found.")


def test_announced_checks(spark):
    from claimlens.schemas import RAW_DIAGNOSIS

    df = spark.createDataFrame([("D1", 3, None), ("D2", None, None)], "diagnosis_code string, category int, empty string")
    status = {r["column_name"]: r["status"] for r in quality.schema_check(df, "t", RAW_DIAGNOSIS).collect()}
    assert status == {"diagnosis_code": "OK", "category": "TYPE MISMATCH", "severity": "MISSING"}
    assert tuple(quality.join_null_check(df, {"category": "diagnosis_code"}).first()) == ("category", 2, 1)
    assert {r[0]: r["all_null"] for r in quality.all_null_check(df, df.columns).collect()} == {"diagnosis_code": False, "category": False, "empty": True}


def test_problems_of_layers_are_coded_errors(spark, tmp_path):
    import pytest

    from claimlens.errors import ClaimLensError
    from claimlens.plans import layers
    from claimlens.sources import tables

    def bronze(folder, claims, columns="claim_id string, patient_id string, provider_id string, diagnosis_code string, procedure_code string, billed_amount double, date string"):
        tables.save_bronze(spark.createDataFrame(claims, columns), folder, "bronze_claims")
        tables.save_bronze(spark.createDataFrame([("P1", "Dr", "X", "Y")], "provider_id string, doctor_name string, specialty string, location string"), folder, "bronze_providers")
        tables.save_bronze(spark.createDataFrame([("D10", "a", "High")], "diagnosis_code string, category string, severity string"), folder, "bronze_diagnosis")
        tables.save_bronze(spark.createDataFrame([("PROC1", "1", "2", "r")], "procedure_code string, average_cost string, expected_cost string, region string"), folder, "bronze_cost")
        return folder

    full = [(f"C{i}", "p", "P1" if i % 3 else "P9", "D10" if i % 2 else None, "PROC1" if i % 2 else None, 1.0 if i % 2 else None, "2024-01-01") for i in range(40)]
    good = bronze(str(tmp_path / "good"), full)
    paths = layers.run_layers(spark, good, good, strict=True)
    found = {(r["code"], r["subject"]) for r in spark.read.parquet(paths["layer_problems"]).collect()}
    assert found == {("SLV-2001", f"bronze_claims.{c}") for c in ("diagnosis_code", "procedure_code", "billed_amount")} | {("SLV-2004", "doctor_name")}
    assert "layer_problems" not in layers.run_layers(spark, good, good)
    short = bronze(str(tmp_path / "short"), [(c[0], *c[2:]) for c in full], "claim_id string, provider_id string, diagnosis_code string, procedure_code string, billed_amount double, date string")
    with pytest.raises(ClaimLensError) as info:
        layers.run_layers(spark, short, short, strict=True)
    assert info.value.error_code == "ING-1002" and info.value.layer == "ingestion" and "patient_id" in str(info.value)
    alike = bronze(str(tmp_path / "alike"), [(f"C{i}", "p", "P1", None, None, None, None) for i in range(200)])
    with pytest.raises(ClaimLensError) as info:
        layers.run_layers(spark, alike, alike, strict=True)
    assert info.value.error_code in ("GLD-3002", "GLD-3003")
    codes = {r["code"] for r in spark.read.parquet(layers.run_layers(spark, alike, alike, strict=False)["layer_problems"]).collect()}
    assert codes >= {"GLD-3002", "SLV-2001"}
