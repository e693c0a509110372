import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from claimlens.constants import WHITESPACE
from claimlens.functions import numbers, text
from claimlens.operators import clean, enrich, rules

RAW = "claim_id string, patient_id string, provider_id string, diagnosis_code string, procedure_code string, billed_amount double, date string"
ROWS = [
    ("C001", "P1", "PR100", "d10", "PROC1", 5000.0, "2024-01-01"),
    ("C002", "P2", "PR101", None, "PROC2", 50000.0, "2024-02-15"),
    ("C003", "P3", "PR102", " D30\t", None, None, "2024-03-10"),
    ("C001", "P1", "PR100", "d10", "PROC1", 5000.0, "2024-01-01"),
]


def by(df, key="claim_id"):
    return {r[key]: r for r in df.collect()}


def test_claims_are_deduplicated_typed_and_normalised(spark):
    out = clean.clean_claims(spark.createDataFrame(ROWS, RAW))
    assert "date" not in out.columns and dict(out.dtypes)["claim_date"] == "timestamp"
    rows = by(out)
    assert len(rows) == 3 and out.count() == 3
    assert rows["C001"]["diagnosis_code"] == "D10" and rows["C003"]["diagnosis_code"] == "D30"
    assert rows["C002"]["diagnosis_code"] is None


def test_headers_are_normalised(spark):
    df = spark.createDataFrame([("a", 1)], "` Claim ID ` string, `Billed Amount` int")
    assert clean.normalize_columns(df).columns == ["claim_id", "billed_amount"]


def test_first_row_does_not_depend_on_partitioning(spark):
    rows = [(f"C{i % 7}", f"PR{i % 5}", float(i % 11)) for i in range(500)]
    df = spark.createDataFrame(rows, "claim_id string, provider_id string, billed_amount double")
    results = [sorted(clean.dedup_keep_first(df.repartition(n)).collect()) for n in (1, 4, 17)]
    assert results[0] == results[1] == results[2] and len(results[0]) == 7


def test_null_key_is_one_key(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), ("C1", "c")], "claim_id string, provider_id string")
    assert sorted(r["provider_id"] for r in clean.dedup_keep_first(df).collect()) == ["a", "c"]


def test_dedup_limits_groups_before_the_shuffle(spark):
    plan = clean.dedup_keep_first(spark.createDataFrame(ROWS, RAW))._jdf.queryExecution().executedPlan().toString()
    limits = [i for i, line in enumerate(plan.splitlines()) if "WindowGroupLimit" in line]
    exchange = next(i for i, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning" in line)
    assert len(limits) == 2 and limits[0] < exchange < limits[1]


def test_unreadable_dates_and_numbers_become_null(spark):
    df = spark.createDataFrame([("1", "2024-02-30", "x"), ("2", "soon", "7.5"), ("3", None, None)], "claim_id string, date string, n string")
    rows = by(clean.parse_date(df).withColumn("n", numbers.to_double("n")))
    assert [rows[k]["claim_date"] for k in "123"] == [None] * 3
    assert [rows[k]["n"] for k in "123"] == [None, 7.5, None]


def test_strip_equals_pythons(spark):
    samples = [f"{w}a {w}b{w}" for w in WHITESPACE] + ["", WHITESPACE, "​x", "plain"]
    rows = spark.createDataFrame([(s,) for s in samples], "s string").select("s", text.strip("s").alias("t")).collect()
    assert all(r["t"] == r["s"].strip() for r in rows)


def test_blank_code_is_missing_only_on_request(spark):
    df = spark.createDataFrame([("C1", "  ")], "claim_id string, diagnosis_code string")
    assert clean.standardize_codes(df).first()["diagnosis_code"] == ""
    assert clean.standardize_codes(df, empty_as_null=True).first()["diagnosis_code"] is None


def test_reference_cleaning(spark):
    p = clean.clean_providers(spark.createDataFrame([("PR1", " Dr A ", "X", None)], "provider_id string, doctor_name string, specialty string, location string"))
    assert p.first().asDict() == {"provider_id": "PR1", "doctor_name": "Dr A", "specialty": "X", "location": "Unknown"}
    c = clean.clean_cost(spark.createDataFrame([(" proc1", "n/a", "5000")], "procedure_code string, average_cost string, expected_cost string"))
    assert tuple(c.first()) == ("PROC1", None, 5000.0)


def test_left_joins_keep_every_claim(spark):
    claims = clean.clean_claims(spark.createDataFrame(ROWS, RAW))
    providers = spark.createDataFrame([("PR100", "Dr A", "X", "Y")], "provider_id string, doctor_name string, specialty string, location string")
    diagnosis = spark.createDataFrame([("D10", "Heart", "High")], "diagnosis_code string, category string, severity string")
    cost = spark.createDataFrame([("PROC1", 4000.0, 5000.0)], "procedure_code string, average_cost double, expected_cost double")
    rows = by(enrich.enrich_claims(claims, providers, diagnosis, cost))
    assert len(rows) == 3
    assert rows["C001"]["severity"] == "High" and rows["C003"]["doctor_name"] is None


def test_repeated_reference_key_fans_out_unless_deduplicated(spark):
    claims = spark.createDataFrame([("C1", "D10"), ("C2", None)], "claim_id string, diagnosis_code string")
    ref = spark.createDataFrame([("D10", "a", "x"), ("D10", "b", "y"), (None, "n", "n")], "diagnosis_code string, category string, severity string")
    assert enrich.enrich_diagnosis(claims, ref).count() == 3
    assert enrich.enrich_diagnosis(claims, ref, dedup_reference=True).count() == 2
    safe = by(enrich.enrich_diagnosis(claims, ref, dedup_reference=True, null_safe=True))
    assert safe["C2"]["category"] == "n"


def test_first_row_of_the_source_wins(spark):
    rows = [("C1", "z", ("b.parquet", 0)), ("C1", "y", ("a.parquet", 7)), ("C1", "a", ("a.parquet", 12)), ("C2", "m", ("a.parquet", 1))]
    df = spark.createDataFrame(rows, "claim_id string, provider_id string, source_position struct<file_path:string,row_index:long>")
    got = sorted(tuple(r) for r in clean.dedup_keep_first(df).collect())
    assert got == [("C1", "y"), ("C2", "m")]


def test_staged_tables_can_be_dropped(spark, monkeypatch):
    from claimlens import session

    monkeypatch.setattr(session, "_staged", [])
    staged = session.stage(spark.range(5), "five")
    path = session._staged[0]
    assert staged.count() == 5 and session.drop_staged(spark) == 1
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


def test_shuffled_join_gives_the_same_rows(spark):
    claims = spark.range(2000).select(
        F.concat(F.lit("C"), "id").alias("claim_id"),
        F.when(F.col("id") % 3 == 0, "PR0").when(F.col("id") % 3 == 1, F.concat(F.lit("PR"), F.col("id") % 50)).alias("provider_id"))
    ref = spark.range(40).select(F.concat(F.lit("PR"), "id").alias("provider_id"), *[F.lit(c).alias(c) for c in enrich.PROVIDER_COLUMNS])
    small = sorted(enrich.enrich_providers(claims, ref).collect(), key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = enrich.enrich_providers(claims, ref)
        assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
        assert sorted(large.collect(), key=str) == small and len(small) == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


RULE_INPUT = "claim_id string, diagnosis_code string, procedure_code string, billed_amount double, expected_cost double"


def test_rules(spark):
    df = spark.createDataFrame([
        ("C999", "D10", "PROC1", 50000.0, 5000.0),
        ("C888", "D10", "PROC1", 4000.0, 5000.0),
        ("C777", None, None, None, None),
        ("C666", "D70", "PROC1", 15000.0, 5000.0),
        ("C555", "", "PROC1", 1.0, None),
    ], RULE_INPUT)
    rows = by(rules.apply_validation_rules(df))
    assert rows["C999"]["validation_flags"] == "WARN_HIGH_BILLING"
    assert rows["C888"]["validation_flags"] == ""
    assert rows["C777"]["validation_flags"] == "WARN_MISSING_DIAGNOSIS|WARN_MISSING_PROCEDURE|WARN_MISSING_AMOUNT|ERR_INCOMPLETE_CLAIM"
    assert rows["C666"]["validation_flags"] == "WARN_INVALID_DIAGNOSIS"
    assert rows["C555"]["validation_flags"] == "WARN_INVALID_DIAGNOSIS"
    assert all(r[f.flag] is not None for r in rows.values() for f in rules.BATCH_RULES)


def test_summary_counts_every_rule_and_clean_claims(spark):
    df = rules.apply_validation_rules(spark.createDataFrame([("a", None, "P", 1.0, 1.0), ("b", "D10", "P", 1.0, 1.0), ("c", "D10", "P", 1.0, 1.0)], RULE_INPUT))
    rows = {r["rule"]: r for r in rules.validation_summary(df).collect()}
    assert len(rows) == 7
    assert (rows["CLEAN"]["claims"], rows["CLEAN"]["pct_of_claims"]) == (2, 66.7)
    assert rows["WARN_MISSING_DIAGNOSIS"]["claims"] == 1
    assert tuple(rules.flagged_count(df).first()) == (1, 3)


def test_summary_of_an_empty_table(spark):
    rows = rules.validation_summary(rules.apply_validation_rules(spark.createDataFrame([], RULE_INPUT))).collect()
    assert {r["claims"] for r in rows} == {0} and {r["pct_of_claims"] for r in rows} == {None}


def test_python_rounding_on_ties(spark):
    values = [12.35, 0.145, 17.30805, 83.81315, 2.5, -2.5, 0.125, -0.375, 1e9 + 0.05, 0.74345, 3.0] + [i / 200 for i in range(-400, 400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 4):
        rows = df.select("v", numbers.py_round("v", digits).alias("r"), numbers.np_round("v", digits).alias("n")).collect()
        import numpy as np

        assert all(r["r"] == round(r["v"], digits) for r in rows)
        assert all(r["n"] == np.round(r["v"], digits) for r in rows)
    texts = df.where("v > 0.01").select("v", numbers.fixed("v", 2).alias("t")).collect()
    assert all(r["t"] == f"{r['v']:.2f}" for r in texts)
    assert df.select(F.max(numbers.py_round(F.lit(None).cast("double"), 2))).first()[0] is None


def test_first_row_by_file_and_place(spark, tmp_path):
    """Several files with odd names: the row of the first path wins, and of one file the row that stands first."""
    from claimlens.sources import star

    folder = tmp_path / "a b%c"
    for i, name in enumerate(("part 2", "part-1", "part=0")):
        spark.createDataFrame([(f"C{j}", f"{name} {j} {k}") for k in range(2) for j in range(i, 3)], "claim_id string, provider_id string").coalesce(1).write.parquet(str(folder / name))
    files = sorted(str(f) for f in folder.rglob("*.parquet"))
    df = star.with_position(spark.read.parquet(*[str(folder / n) for n in ("part-1", "part=0", "part 2")]))
    kept = {r["claim_id"]: r["provider_id"] for r in clean.dedup_keep_first(df.repartition(5)).collect()}
    order = [next(n for n in ("part 2", "part-1", "part=0") if f"/{n}/" in f) for f in files]
    starts = {"part 2": 0, "part-1": 1, "part=0": 2}
    assert kept == {f"C{j}": next(f"{n} {j} 0" for n in order if starts[n] <= j) for j in range(3)}
    assert dict(df.dtypes)["source_position"] == "bigint"


def test_plain_text_is_neither_trimmed_nor_parsed(spark):
    """What is visible at both ends and a day in plain form take the cheap way; the results are those of the full one."""
    ends = ["", "a", " ", "!", "~", "\x7f", "\x1f", "\u00a0", "é", "\u3000", "😀"]
    samples = [a + m + b for a in ends for m in ("", "x y", "\n") for b in ends] + [None]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    full = F.btrim("s", F.lit(WHITESPACE))
    assert df.where(~text.strip("s").eqNullSafe(full)).count() == 0
    days = [None, "", "2000-02-30", "2000-02-29", "2000-2-3", "2000-01-01\n", " 2000-01-01", "0000-01-01", "12000-01-01", "2024-13-01", "2018-11-04", "unknown"]
    df = spark.createDataFrame([(s,) for s in days], "s string")
    for zone in ("America/Sao_Paulo", "UTC"):  # the first has days without a midnight
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert df.where(~numbers.to_timestamp("s").eqNullSafe(F.try_to_timestamp("s", F.lit("yyyy-MM-dd")))).count() == 0
    assert "WHEN" in text.strip("s")._jc.toString() and "WHEN" in numbers.to_timestamp("s")._jc.toString()
