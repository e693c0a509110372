import pytest
from pyspark.sql import functions as F

from claimlens import constants as K
from claimlens.errors import ClaimLensError
from claimlens.operators import kpi, rules, serving
from claimlens.plans import decisions, layers
from claimlens.schemas import HISTORY, RAW_CLAIMS, RAW_SCHEMAS
from claimlens.sources import star, tables
from claimlens.streaming.decisions import stream_score_claims

REQUEST = "claim_id string, patient_id string, provider_id string, diagnosis_code string, procedure_code string, billed_amount double, strict_mode boolean"


def scorer(df):
    return serving.decide(df.withColumn("raw_probability", F.lit(0.2)), 0.37)


def requests(spark):
    return spark.createDataFrame([
        ("clean", "P", "R", "D10", "PROC1", 20000.0, True),
        ("one", "P", "R", None, "PROC1", 100.0, None),
        ("two", "P", "R", "", "", 100.0, True),
        ("one_high", "P", "R", "D10", "", 20000.5, True),
        ("high", "P", "R", "D10", "PROC1", 30000.0, True),
        ("amount", "P", "R", "D10", "PROC1", None, True),
        ("lenient", "P", "R", None, None, None, False),
    ], REQUEST)


@pytest.fixture(scope="module")
def decided(spark):
    return {r["claim_id"]: r for r in decisions.decide_claims(requests(spark), scorer).collect()}


def test_override_probabilities(decided):
    got = {k: r["probability"] for k, r in decided.items()}
    assert got == {"clean": 0.2, "one": 0.88, "two": 0.95, "one_high": 0.92, "high": 0.95, "amount": 0.88, "lenient": 0.2}
    assert decided["one"]["predicted_label"] == 1 and decided["one"]["risk_level"] == "HIGH"
    assert decided["lenient"]["predicted_label"] == 0 and decided["lenient"]["risk_level"] == "LOW"


def test_request_flags(decided):
    assert decided["clean"]["flags"] == []
    assert decided["two"]["flags"] == ["WARN_MISSING_DIAGNOSIS", "WARN_MISSING_PROCEDURE", "ERR_INCOMPLETE_CLAIM"]
    assert decided["one_high"]["flags"] == ["WARN_MISSING_PROCEDURE", "WARN_HIGH_BILLING"]
    assert decided["amount"]["flags"] == ["WARN_MISSING_AMOUNT"]


def test_features_left_to_the_model(decided):
    r = decided["clean"]
    assert (r["is_high_biller"], r["claim_amount_ratio"], r["missing_fields_count"]) == (0.0, 1.0, 0.0)
    assert r["diagnosis_severity_flag"] is r["provider_denial_rate"] is r["provider_claim_count"] is r["claim_month"] is None
    assert (decided["one"]["diagnosis_severity_flag"], decided["high"]["claim_amount_ratio"], decided["high"]["provider_denial_rate"]) == (1.0, 4.5, 0.85)


def test_contributions(decided):
    assert [c["feature"] for c in decided["two"]["feature_contributions"]] == ["Missing Diagnosis Code", "Missing Procedure Code"]
    assert [c["feature"] for c in decided["clean"]["feature_contributions"]] == ["Provider Denial History"]
    assert [c["score"] for c in decided["high"]["feature_contributions"]] == ["+3.15"]


def test_levels_use_the_unrounded_probability(spark):
    df = spark.createDataFrame([(0.69999,), (0.7,), (0.4,), (0.39996,), (1.2,), (-0.1,)], "raw_probability double")
    rows = serving.decide(df, 0.7).collect()
    assert [r["risk_level"] for r in rows] == ["MEDIUM", "HIGH", "MEDIUM", "LOW", "HIGH", "LOW"]
    assert [r["probability"] for r in rows] == [0.7, 0.7, 0.4, 0.4, 1.0, 0.0]
    assert [r["predicted_label"] for r in rows] == [0, 1, 0, 0, 1, 0]


def test_decision_needs_no_shuffle(spark):
    plan = decisions.decide_claims(requests(spark), scorer)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_history_rows_stay_in_generated_code(spark, tmp_path):
    """Every set of rules that can fire, by rows without a lambda: with one, each row left generated code and came back."""
    requests(spark).write.parquet(str(tmp_path / "requests"))
    rows = serving.history_rows(decisions.decide_claims(spark.read.parquet(str(tmp_path / "requests")), scorer), "ann")
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
    cases = [(d, p, a) for d in (None, "", "D10") for p in (None, "", "PROC1") for a in (None, 1.0, 1e9)]
    got = rules.request_flags(spark.createDataFrame(cases, "diagnosis_code string, procedure_code string, billed_amount double")).collect()
    for r in got:
        d, p, a = not r["diagnosis_code"], not r["procedure_code"], r["billed_amount"]
        fired = (d, p, a is None, (a or 0) > K.SERVING_HIGH_AMOUNT, d and p)
        assert r["flags"] == [rule.label for rule, hit in zip(rules.REQUEST_RULES, fired) if hit]
    assert len(got) == 27


def test_evaluation_reports_every_claim(spark):
    out = {r["claim_id"]: r for r in decisions.evaluate_claims(requests(spark), scorer).collect()}
    assert len(out) == 7 and K.OFFLINE_TEXT in out["one"]["full_report"] and "Claim is clean" in out["clean"]["full_report"]


def test_evaluation_without_an_index_falls_back(spark, tmp_path):
    from claimlens.sources import policies

    out = decisions.evaluate_claims(requests(spark), scorer, lambda: policies.read_index(spark, str(tmp_path / "none"))).collect()
    assert any(K.OFFLINE_TEXT in r["full_report"] for r in out)
    with pytest.raises(ClaimLensError):
        decisions.evaluate_claims(requests(spark), scorer, lambda: tables.load_bronze(spark, str(tmp_path), "none"))


def test_history_grows(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = serving.history_rows(decisions.decide_claims(requests(spark), scorer), "ann")
    for _ in range(2):
        tables.append_history(rows, path)
    back = tables.read_history(spark, path)
    assert back.count() == 14 and back.columns == HISTORY.names and back.select("id").distinct().count() == 14
    latest = kpi.history_latest(back, "ann", limit=5)
    assert latest.count() == 5 and "submitted_by" in latest.columns
    assert kpi.history_latest(back, "bob").count() == 0


def test_streams_and_batches_share_one_history(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    requests(spark).repartition(3).write.parquet(src)

    def stream(state, user):
        rows = spark.readStream.schema(requests(spark).schema).option("maxFilesPerTrigger", 1).parquet(src)
        stream_score_claims(rows, scorer, out, str(tmp_path / state), user).awaitTermination()

    stream("one", "a")
    stream("two", "b")
    stream("one", "a")  # nothing new
    tables.append_history(serving.history_rows(decisions.decide_claims(requests(spark), scorer), "c"), out)
    back = tables.read_history(spark, out)
    assert {r["username"]: r["count"] for r in back.groupBy("username").count().collect()} == {"a": 7, "b": 7, "c": 7}
    assert back.select("id").distinct().count() == 21


def test_csv_files_with_other_headers_are_an_error(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text("claim_id,patient_id,provider_id\nC1,P1,PR1\n")
    (folder / "b.csv").write_text("provider_id,claim_id,patient_id\nPR2,C2,P2\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.ingest_csv(spark, str(folder), RAW_CLAIMS).collect()
    (folder / "b.csv").write_text("claim_id,patient_id,provider_id\nC2,P2,PR2\n")
    assert sorted(tuple(r)[:3] for r in tables.ingest_csv(spark, str(folder), RAW_CLAIMS).collect()) == [("C1", "P1", "PR1"), ("C2", "P2", "PR2")]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    requests(spark).repartition(3).write.parquet(src)

    def run():
        stream = spark.readStream.schema(requests(spark).schema).option("maxFilesPerTrigger", 1).parquet(src)
        stream_score_claims(stream, scorer, out, state).awaitTermination()
        return sorted((r["claim_id"], r["denial_probability"], r["flags"]) for r in spark.read.parquet(out).collect())

    batch = decisions.decide_claims(requests(spark), scorer).select("claim_id", "probability", F.array_join("flags", "|"))
    want = sorted(tuple(r) for r in batch.collect())
    assert run() == want
    assert run() == want  # nothing new: nothing scored twice
    requests(spark).where("claim_id = 'one'").write.mode("append").parquet(src)
    assert len(run()) == 8


def test_ingestion(spark, tmp_path):
    raw, base = tmp_path / "raw", str(tmp_path / "bronze")
    raw.mkdir()
    (raw / "claims_1000.csv").write_text(
        "claim_id,patient_id,provider_id,diagnosis_code,procedure_code,billed_amount,date\n"
        'C1,P1,PR1,D10,PROC1,100.5,2024-01-01\nC2,P2,PR1,,"PROC1, left",,2024-01-02\nC1,P1,PR1,D10,PROC1,100.5,2024-01-01\n')
    (raw / "cost.csv").write_text("procedure_code,average_cost,expected_cost,region\nPROC1,4000,x,Delhi\n")
    df = tables.ingest_csv(spark, str(raw / "claims_1000.csv"), RAW_SCHEMAS["bronze_claims"])
    rows = df.collect()
    assert len(rows) == 3 and {r["source_file"] for r in rows} == {"claims_1000.csv"} and rows[0]["ingestion_timestamp"] is not None
    assert rows[1]["billed_amount"] is None and rows[1]["procedure_code"] == "PROC1, left"
    assert tables.ingest_csv(spark, str(raw / "none.csv"), RAW_SCHEMAS["bronze_claims"]) is None
    with pytest.raises(FileNotFoundError):
        tables.ingest_csv_table(spark, str(raw / "none.csv"), RAW_SCHEMAS["bronze_claims"], base, "t")
    report = {r["table_name"]: (r["status"], r["row_count"]) for r in tables.ingest_all(spark, str(raw), base).collect()}
    assert report == {"bronze_claims": ("LOADED", 3), "bronze_providers": ("MISSING", 0), "bronze_diagnosis": ("MISSING", 0), "bronze_cost": ("LOADED", 1)}
    assert tables.load_bronze(spark, base, "bronze_claims").count() == 3
    with pytest.raises(ClaimLensError) as info:
        tables.load_bronze(spark, base, "bronze_diagnosis")
    assert info.value.error_code == "ING-1004" and "[ING-1004]" in str(info.value)
    with pytest.raises(ClaimLensError):
        tables.read_claims_batch(spark, str(raw / "none.csv"), RAW_SCHEMAS["bronze_claims"])
    assert tables.read_claims_batch(spark, str(raw / "claims_1000.csv"), RAW_SCHEMAS["bronze_claims"]).count() == 3


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Billed Amount,extra,claim_id\n7.5,x,C1\noops,y,C2\n")
    df = tables.ingest_csv(spark, str(tmp_path / "c.csv"), RAW_SCHEMAS["bronze_claims"])
    assert df.columns == ["Billed Amount", "extra", "claim_id", "ingestion_timestamp", "source_file"]
    assert [tuple(r)[:3] for r in df.orderBy("claim_id").collect()] == [(7.5, "x", "C1"), (None, "y", "C2")]


def test_other_layer_formats(spark, tmp_path):
    path = tables.save_bronze(spark.range(3), str(tmp_path), "t", fmt="orc")
    assert spark.read.orc(path).count() == 3


def test_csv_keeps_padding(spark, tmp_path):
    df = spark.createDataFrame([(" a\t", 'q"x'), (None, "b")], "x string, y string")
    path = tables.write_csv(df, str(tmp_path / "t"))
    back = tables.ingest_csv(spark, path, df.schema).select("x", "y")
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_layers_are_written_and_reread(spark, tmp_path):
    base = str(tmp_path)
    for name, df in star.bronze(spark, "/root/testdata/sf0.001", patient=True).items():
        tables.save_bronze(df, base, name)
    paths = layers.run_layers(spark, base, base)
    gold = tables.load_gold(spark, paths["gold_features"])
    assert gold.columns == list(K.GOLD_COLUMNS)
    assert gold.count() == spark.read.parquet(paths["silver_claims"]).count() == gold.select("claim_id").distinct().count()


def test_report_file(spark, tmp_path):
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "position int, line string").repartition(2)
    path = tables.write_report(lines, str(tmp_path / "r"))
    assert [r["value"] for r in spark.read.text(path).collect()] == ["a", "b"]
