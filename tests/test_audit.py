import datetime as dt
import hashlib

from claimlens import constants as K
from claimlens.operators import audit

SCHEMA = "provider_id string, claim_date timestamp, validation_flags string, billed_amount double, expected_cost double"


def day(n):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n)


def test_windows_and_thresholds(spark):
    rows = [("A", day(3 * i), "WARN_HIGH_BILLING", 1.0, 1.0) for i in range(10)] + [("A", day(29), "X|WARN_HIGH_BILLING", 1.0, 1.0)]  # 11 in 30 days
    rows += [("B", day(3 * i), "WARN_HIGH_BILLING", 1.0, 1.0) for i in range(10)] + [("B", day(30), "WARN_HIGH_BILLING", 1.0, 1.0)]  # never 11
    rows += [("B", day(-50), "", 1.0, 1.0)] * 30
    rows += [("C", None, "", 10.0, 1.0), ("C", None, "", 5.0, 0.0)]  # exactly ten times
    rows += [("D", None, "", 10.1, 1.0)]
    rows += [("E", day(0), "ERR_INCOMPLETE_CLAIM", None, 1.0)] * 6 + [("E", day(0), "", 1.0, 1.0)] * 9
    rows += [(None, day(0), "ERR_INCOMPLETE_CLAIM", 99.0, 1.0)]
    rows += [("F", day(0), "WARN_HIGH_BILLING", 1.0, 1.0)] + [("F", day(89), "", 1.0, 1.0)] * 3
    rows += [("G", day(0), "", 1.0, 1.0)] * 101 + [("H", day(0), "", 1.0, 1.0)] * 100
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["provider_id"]: tuple(r)[1:] for r in audit.audit_trigger(df).collect()}
    assert set(got) == set("ABCDEFGH")
    assert got["A"] == (True, True, False, False, True)
    assert got["B"][1] is False and got["C"] == (False,) * 5 and got["D"] == (False, False, False, True, True)
    assert got["E"] == (False, False, True, False, True)
    tiers = {r["provider_id"]: r["tier"] for r in audit.provider_tier(df).collect()}
    assert tiers["A"] == "HIGH RISK" and tiers["C"] == "NORMAL" and tiers["E"] == "ELEVATED" and tiers["F"] == "ELEVATED"
    notice = {r["provider_id"]: (r["high_billing_rate"], r["notice"]) for r in audit.high_billing_notice(df).collect()}
    assert notice["F"] == (1.0, True) and notice["G"] == (0.0, False) and "C" not in notice
    assert [tuple(r) for r in audit.high_volume_provider(df).collect()] == [("G", "2026-01", 101)]
    assert audit.audit_trigger(df.limit(0)).count() == 0


def test_fixed_values():
    """The numbers of the rules, written out: the twins share the constants, so a wrong one would pass both."""
    assert [(label, weight) for _, label, weight in K.RULES] == [
        ("WARN_MISSING_DIAGNOSIS", 2), ("WARN_MISSING_PROCEDURE", 2), ("WARN_MISSING_AMOUNT", 1), ("WARN_HIGH_BILLING", 2),
        ("WARN_INVALID_DIAGNOSIS", 1), ("ERR_INCOMPLETE_CLAIM", 3)]
    assert K.VALID_DIAGNOSIS_CODES == ("D10", "D20", "D30", "D40", "D50", "D60")
    assert (K.HIGH_BILLING_MULTIPLIER, K.HIGH_BILLER_MULTIPLIER, K.DENIAL_SCORE, K.LABEL_NOISE_RATE) == (3.0, 2.0, 3, 0.05)
    assert (K.RISK_HIGH, K.RISK_MEDIUM, K.TEST_SHARE, K.NULL_WARN_PCT) == (0.7, 0.4, 0.2, 10.0)
    assert (K.CHUNK_WORDS, K.CHUNK_OVERLAP, K.EMBEDDING_DIM) == (200, 50, 384)
    assert (K.SERVING_HIGH_AMOUNT, K.SERVING_RATIO_HIGH, K.SERVING_RATIO_NORMAL, K.SERVING_PROVIDER_RATE) == (20000, 4.5, 1.0, 0.85)
    assert (K.OVERRIDE_ONE_MISSING, K.OVERRIDE_OTHER, K.OVERRIDE_HIGH_BILLER_FLOOR, K.CONTRIBUTION_FALLBACK_ABOVE) == (0.88, 0.95, 0.92, 0.15)
    assert [c[2] for c in K.CONTRIBUTIONS] == ["+5.01", "+4.85", "+3.15", "+1.05"]
    assert set(K.ACTION_STEPS) >= {"WARN_HIGH_BILLING"} and K.DEFAULT_QUERY_PREFIX == "healthcare claim validation rule remediation "
    assert K.FEATURES == ("claim_amount_ratio", "provider_claim_count", "provider_denial_rate", "diagnosis_severity_flag", "missing_fields_count", "is_high_biller", "claim_month")
    assert K.GOLD_COLUMNS == (
        "claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code", "billed_amount", "claim_date", "specialty", "location", "category", "severity",
        "expected_cost", "average_cost", *K.FEATURES, "validation_flags", "risk_score", "denial_label")
    assert [flag for flag, _, _ in K.RULES] == [
        "flag_missing_diagnosis", "flag_missing_procedure", "flag_missing_amount", "flag_high_billing", "flag_invalid_diagnosis", "flag_incomplete_claim"]
    assert K.DIAGNOSIS_ROWS == (("D10", "Heart", "High"), ("D20", "Bone", "High"), ("D30", "Fever", "Low"), ("D40", "Skin", "Low"), ("D50", "Diabetes", "High"), ("D60", "Cold", "Low"))
    assert K.COST_ROWS == (("PROC1", 4000.0, 5000.0), ("PROC2", 12000.0, 15000.0), ("PROC3", 7000.0, 9000.0), ("PROC4", 6000.0, 8000.0), ("PROC5", 20000.0, 25000.0), ("PROC6", 800.0, 1200.0))
    assert K.EXPECTED_COLUMNS["bronze_claims"] == ("claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code", "billed_amount")
    assert list(K.FLAG_QUERIES) == ["WARN_HIGH_BILLING", "ERR_INCOMPLETE_CLAIM", "WARN_MISSING_DIAGNOSIS", "WARN_MISSING_PROCEDURE", "WARN_MISSING_AMOUNT", "WARN_INVALID_DIAGNOSIS"]
    assert K.FLAG_QUERIES["WARN_HIGH_BILLING"].startswith("high billing flag billed amount exceeds expected cost") and len(K.WHITESPACE) == 29
    # long texts by digest: a change of one sign shows
    digests = {name: hashlib.md5(repr(getattr(K, name)).encode()).hexdigest() for name in ("FLAG_QUERIES", "ACTION_STEPS", "EVIDENCE_TEMPLATE", "PLAN_TEMPLATE", "CONTRIBUTIONS")}
    assert digests == {
        "FLAG_QUERIES": "52ae60cea7b586ce665988970fe953dc", "ACTION_STEPS": "ef40deecdeb0a56e7e037a404726a3ef", "EVIDENCE_TEMPLATE": "77d527e382ef51261e9f727d18afa59a",
        "PLAN_TEMPLATE": "44d307496dcd2c38828f2cfb2f218cce", "CONTRIBUTIONS": "1f211976240835b923a717a16f0008d9"}
