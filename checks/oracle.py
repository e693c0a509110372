"""The registered queries as DuckDB SQL over the same tables.

Logic is written independently of the library; fixed values (codes, reference rows, texts) are shared with it and pinned against
literals in tests/test_audit.py.
"""

from __future__ import annotations

from claimlens import constants as K


def q(text: str) -> str:
    """A text as SQL literal."""
    return "'" + text.replace("'", "''") + "'"


_WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in K.WHITESPACE) + ")"


def strip(x: str) -> str:
    return f"trim({x}, (SELECT ws FROM consts))"


def values(rows, columns: str) -> str:
    def cell(v):
        return "NULL" if v is None else q(v) if isinstance(v, str) else repr(v)

    return f"(VALUES {', '.join('(' + ', '.join(cell(v) for v in r) + ')' for r in rows)}) AS {columns}"


# --- shared tables ---------------------------------------------------------------------------------

CTES: dict[str, str] = {
    "consts": f"SELECT {_WS} AS ws",
    "bronze": """
      SELECT concat('C', l_orderkey, '-', l_linenumber) AS claim_id,
             concat('P', o_custkey) AS patient_id,
             CASE WHEN l_partkey % 9 = 0 THEN concat('  PR', l_suppkey, chr(9)) ELSE concat('PR', l_suppkey) END AS provider_id,
             CASE WHEN (l_orderkey * 7 + l_linenumber) % 10 < 3 THEN NULL
                  WHEN l_partkey % 4 = 1 THEN concat('d', 10 * (1 + l_partkey % 7))
                  WHEN l_partkey % 5 = 2 THEN concat(' D', 10 * (1 + l_partkey % 7), chr(160))
                  ELSE concat('D', 10 * (1 + l_partkey % 7)) END AS diagnosis_code,
             CASE WHEN (l_orderkey + l_linenumber * 3) % 4 = 0 THEN NULL
                  WHEN l_partkey % 3 = 2 THEN concat(chr(9), 'proc', 1 + l_partkey % 6)
                  ELSE concat('PROC', 1 + l_partkey % 6) END AS procedure_code,
             CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_extendedprice END AS billed_amount,
             CASE WHEN l_partkey % 50 = 7 THEN 'unknown' WHEN l_partkey % 50 = 8 THEN '2000-02-30'
                  ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date, position
      FROM (SELECT *, row_number() OVER () AS position FROM lineitem) LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "dedup": """
      SELECT * EXCLUDE (position) FROM bronze QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY position) = 1""",
    "claims": f"""
      SELECT claim_id, patient_id, {strip('provider_id')} AS provider_id, upper({strip('diagnosis_code')}) AS diagnosis_code,
             upper({strip('procedure_code')}) AS procedure_code, billed_amount,
             CAST(try_strptime(date, '%Y-%m-%d') AS DATE) AS claim_date
      FROM dedup""",
    "raw_providers": """
      SELECT concat('PR', s_suppkey) AS provider_id, concat(' ', s_name, ' ') AS doctor_name,
             CASE s_nationkey % 4 WHEN 0 THEN 'Cardiology' WHEN 1 THEN 'Neurology' WHEN 2 THEN 'Orthopedics' ELSE 'General' END AS specialty,
             CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE n_name END AS location
      FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "providers": f"""
      SELECT provider_id, {strip('doctor_name')} AS doctor_name, specialty, coalesce(location, 'Unknown') AS location FROM raw_providers""",
    "diagnosis": "SELECT * FROM " + values(K.DIAGNOSIS_ROWS, "t(diagnosis_code, category, severity)"),
    "cost": "SELECT procedure_code, average_cost::DOUBLE AS average_cost, expected_cost::DOUBLE AS expected_cost FROM "
    + values(K.COST_ROWS, "t(procedure_code, average_cost, expected_cost)"),
    "silver": """
      SELECT c.*, doctor_name, specialty, location, category, severity, average_cost, expected_cost
      FROM claims c LEFT JOIN providers USING (provider_id) LEFT JOIN diagnosis USING (diagnosis_code) LEFT JOIN cost USING (procedure_code)""",
    "flagged": """
      SELECT *, diagnosis_code IS NULL AS flag_missing_diagnosis, procedure_code IS NULL AS flag_missing_procedure,
             billed_amount IS NULL AS flag_missing_amount, coalesce(billed_amount > 3.0 * expected_cost, false) AS flag_high_billing,
             coalesce(diagnosis_code NOT IN ('D10', 'D20', 'D30', 'D40', 'D50', 'D60'), false) AS flag_invalid_diagnosis,
             diagnosis_code IS NULL AND procedure_code IS NULL AS flag_incomplete_claim
      FROM silver""",
    "validated": """
      SELECT *, concat_ws('|', CASE WHEN flag_missing_diagnosis THEN 'WARN_MISSING_DIAGNOSIS' END,
               CASE WHEN flag_missing_procedure THEN 'WARN_MISSING_PROCEDURE' END,
               CASE WHEN flag_missing_amount THEN 'WARN_MISSING_AMOUNT' END,
               CASE WHEN flag_high_billing THEN 'WARN_HIGH_BILLING' END,
               CASE WHEN flag_invalid_diagnosis THEN 'WARN_INVALID_DIAGNOSIS' END,
               CASE WHEN flag_incomplete_claim THEN 'ERR_INCOMPLETE_CLAIM' END) AS validation_flags
      FROM flagged""",
    "stats": """
      SELECT provider_id, count(claim_id) AS provider_claim_count,
             round_even(avg((validation_flags <> '')::INT), 4) AS provider_denial_rate
      FROM validated WHERE provider_id IS NOT NULL GROUP BY provider_id""",
    "scored": """
      SELECT *, (3 * flag_incomplete_claim::INT + 2 * flag_missing_diagnosis::INT + 2 * flag_missing_procedure::INT
                 + 2 * flag_high_billing::INT + flag_missing_amount::INT + flag_invalid_diagnosis::INT)::INT AS risk_score
      FROM validated""",
    "labelled": """
      SELECT *, (CASE WHEN ('0x' || substr(md5(claim_id), 1, 8))::BIGINT % 10000 < 500
                      THEN 1 - (risk_score >= 3)::INT ELSE (risk_score >= 3)::INT END)::INT AS denial_label
      FROM scored""",
    "gold": """
      SELECT l.*, CASE WHEN expected_cost > 0 THEN billed_amount / expected_cost END AS claim_amount_ratio,
             provider_claim_count, provider_denial_rate,
             coalesce(severity = 'High', false)::INT AS diagnosis_severity_flag,
             ((diagnosis_code IS NULL)::INT + (procedure_code IS NULL)::INT + (billed_amount IS NULL)::INT)::INT AS missing_fields_count,
             coalesce(billed_amount > 2.0 * expected_cost, false)::INT AS is_high_biller,
             month(claim_date)::INT AS claim_month
      FROM labelled l LEFT JOIN stats USING (provider_id)""",
    "rule_scores": "SELECT denial_label AS label, (risk_score + provider_denial_rate) / 12.0 AS score FROM gold",
    "batch": """
      SELECT claim_id, provider_id, diagnosis_code, billed_amount, claim_id NOT LIKE '%7' AS strict_mode,
             CASE WHEN procedure_code IS NULL AND billed_amount IS NOT NULL THEN '' ELSE procedure_code END AS procedure_code
      FROM bronze""",
    "strict_batch": "SELECT *, true AS strict_mode FROM bronze",
    "requests": """
      SELECT *, coalesce(billed_amount > 20000, false) AS high,
             (coalesce(diagnosis_code, '') = '')::INT + (coalesce(procedure_code, '') = '')::INT + (billed_amount IS NULL)::INT AS missing
      FROM {batch}""",
    "request_scores": """
      SELECT *, (missing + high::INT * 2 + CASE WHEN missing > 0 OR high THEN 0.85::DOUBLE ELSE 0.1::DOUBLE END) / 8.0 AS raw FROM requests""",
    "decided": """
      SELECT *, CASE WHEN hit THEN CASE WHEN high THEN greatest(base, 0.92) ELSE base END ELSE printf('%.4f', least(1.0, raw))::DOUBLE END::DOUBLE AS probability,
             CASE WHEN hit OR raw >= 0.37 THEN 1 ELSE 0 END::INT AS predicted_label,
             CASE WHEN hit OR raw >= 0.70 THEN 'HIGH' WHEN raw >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
             concat_ws('|', CASE WHEN coalesce(diagnosis_code, '') = '' THEN 'WARN_MISSING_DIAGNOSIS' END,
                CASE WHEN coalesce(procedure_code, '') = '' THEN 'WARN_MISSING_PROCEDURE' END,
                CASE WHEN billed_amount IS NULL THEN 'WARN_MISSING_AMOUNT' END, CASE WHEN high THEN 'WARN_HIGH_BILLING' END,
                CASE WHEN coalesce(diagnosis_code, '') = '' AND coalesce(procedure_code, '') = '' THEN 'ERR_INCOMPLETE_CLAIM' END) AS flags
      FROM (SELECT *, strict_mode AND (high OR missing > 0) AS hit, CASE WHEN missing = 1 THEN 0.88 ELSE 0.95 END AS base FROM request_scores)""",
    "part_cost": """
      SELECT concat(' proc', p_partkey) AS procedure_code,
             CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR) END AS average_cost,
             CASE WHEN p_partkey % 11 = 0 THEN '' ELSE CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR) END AS expected_cost
      FROM part""",
    "history": """
      SELECT *, CASE WHEN denial_probability >= 0.70 THEN 'HIGH' WHEN denial_probability >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
             denial_probability >= 0.37 AS is_denied
      FROM (SELECT event_id AS id, concat('user', user_id) AS submitted_by, concat('C', event_id) AS claim_id, concat('P', user_id) AS patient_id,
                   concat('PR', event_id % 100) AS provider_id, value * 100 AS billed_amount, NULL::VARCHAR AS diagnosis_code,
                   'PROC1' AS procedure_code, round_even(value / 500.0::DOUBLE, 4) AS denial_probability, event_type AS flags, ts AS submitted_at
            FROM events)""",
    "doc_words": r"""
      SELECT concat('doc', doc_id, '.txt') AS source_file,
             list_filter(string_split_regex(text, '[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda w: w <> '') AS w
      FROM documents""",
    "doc_chunks": """
      SELECT source_file, CASE WHEN len(w) = 0 THEN [] ELSE
               [array_to_string(w[s + 1 : s + 200], ' ') FOR s IN range(0, len(w), 150) IF s = 0 OR s + 50 < len(w)] END AS chunks
      FROM doc_words""",
    "chunks": """
      SELECT source_file, replace(source_file, '.txt', '') || '_' || (i - 1) AS chunk_id, chunks[i] AS text,
             (i - 1)::INT AS chunk_index, len(chunks)::INT AS total_chunks
      FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM doc_chunks)""",
    "distances": """
      SELECT q.vec_id::VARCHAR AS query_id, e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2 AS distance
      FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q""",
    # lexical vectors, sparse: md5 bucket of each word, count times ln((n + 1) / (df + 1)), length one as 32-bit floats
    "chunk_buckets": r"""
      SELECT chunk_id, bucket, count(*) AS tf
      FROM (SELECT chunk_id, (('0x' || substr(md5(w), 1, 6))::INT % 384)::INT AS bucket
            FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM chunks)) GROUP BY ALL""",
    "idf": """
      SELECT bucket, ln(((SELECT count(*) FROM chunks) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM chunk_buckets GROUP BY bucket""",
    "chunk_vectors": """
      SELECT chunk_id, bucket, (tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY chunk_id)))::FLOAT::DOUBLE AS v
      FROM chunk_buckets JOIN idf USING (bucket) QUALIFY sum(tf * idf * tf * idf) OVER (PARTITION BY chunk_id) > 0""",
    "asked": """
      SELECT flag, coalesce(known, concat('healthcare claim validation rule remediation ', flag)) AS query FROM (
        SELECT DISTINCT unnest(string_split(validation_flags, '|')) AS flag FROM validated WHERE validation_flags <> ''
        UNION SELECT DISTINCT upper(event_type) FROM events
        UNION SELECT flag FROM rule_labels) LEFT JOIN flag_queries USING (flag)""",
    "flag_queries": "SELECT * FROM " + values(list(K.FLAG_QUERIES.items()), "t(flag, known)"),
    "query_vectors": r"""
      SELECT flag, bucket, (w / sqrt(sum(w * w) OVER (PARTITION BY flag)))::FLOAT::DOUBLE AS v
      FROM (SELECT flag, bucket, count(*) * coalesce(any_value(idf), ln((SELECT count(*) FROM chunks) + 1)) AS w
            FROM (SELECT flag, (('0x' || substr(md5(w), 1, 6))::INT % 384)::INT AS bucket
                  FROM (SELECT flag, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS w FROM asked))
            LEFT JOIN idf USING (bucket) GROUP BY flag, bucket)""",
    "chunk_distances": """
      SELECT flag, chunk_id, source_file, text, distance, row_number() OVER (PARTITION BY flag ORDER BY round(distance, 11), chunk_id) AS rank
      FROM (SELECT q.flag, c.chunk_id, any_value(q.sq) + any_value(c.sq) - 2 * coalesce(sum(a.v * b.v), 0) AS distance
            FROM (SELECT flag, sum(v * v) AS sq FROM query_vectors GROUP BY flag) q
            CROSS JOIN (SELECT chunk_id, sum(v * v) AS sq FROM chunk_vectors GROUP BY chunk_id) c
            LEFT JOIN query_vectors a ON a.flag = q.flag
            LEFT JOIN chunk_vectors b ON b.chunk_id = c.chunk_id AND b.bucket = a.bucket
            GROUP BY q.flag, c.chunk_id) JOIN chunks USING (chunk_id)""",
    "rule_labels": "SELECT * FROM " + values([(label, i) for i, (_, label, _) in enumerate(K.RULES)], "t(flag, label)"),
    "evidence": f"""
      SELECT flag AS reason_title, source_file AS source_name, printf('%.4f', distance)::DOUBLE AS similarity_score, concat(substr({strip('text')}, 1, 100), '...') AS policy_preview,
             concat({q(K.EVIDENCE_TEMPLATE.split('{flag}')[0])}, flag, {q(K.EVIDENCE_TEMPLATE.split('{flag}')[1].split('{source_file}')[0])}, source_file,
                    {q(K.EVIDENCE_TEMPLATE.split('{source_file}')[1].split('{policy_text}')[0])}, {strip('text')}, {q(K.EVIDENCE_TEMPLATE.split('{policy_text}')[1])}) AS block
      FROM chunk_distances JOIN rule_labels USING (flag) WHERE rank = 1""",
    "steps": "SELECT * FROM " + values(list(K.ACTION_STEPS.items()), "t(flag, steps)"),
    # flag texts of every distinct flag list
    "lists": "SELECT DISTINCT validation_flags, string_split(validation_flags, '|') AS flags FROM {flag_source} WHERE validation_flags <> ''",
    "list_flags": "SELECT validation_flags, unnest(flags) AS flag, unnest(range(len(flags))) AS i FROM lists",
    "list_texts": """
      SELECT validation_flags, string_agg('- ' || flag, chr(10) ORDER BY i) AS flag_lines,
             string_agg('For ' || flag || ':' || chr(10) || steps || chr(10), chr(10) ORDER BY i) AS action_steps
      FROM list_flags LEFT JOIN steps USING (flag) GROUP BY validation_flags""",
    "list_evidence": """
      SELECT validation_flags, string_agg(block, chr(10) ORDER BY i) AS analysis, list_sort(list(DISTINCT source_name)) AS sources
      FROM list_flags JOIN evidence ON flag = reason_title GROUP BY validation_flags""",
}

_DEPENDS = {
    "dedup": ["bronze"], "claims": ["consts", "dedup"], "providers": ["consts", "raw_providers"],
    "silver": ["claims", "providers", "diagnosis", "cost"], "flagged": ["silver"], "validated": ["flagged"], "stats": ["validated"],
    "scored": ["validated"], "labelled": ["scored"], "gold": ["labelled", "stats"], "rule_scores": ["gold"], "batch": ["bronze"],
    "strict_batch": ["bronze"], "requests": [], "request_scores": ["requests"], "decided": ["request_scores"], "doc_chunks": ["doc_words"],
    "chunks": ["doc_chunks"], "chunk_buckets": ["chunks"], "idf": ["chunks", "chunk_buckets"], "chunk_vectors": ["chunk_buckets", "idf"],
    "asked": ["validated", "rule_labels", "flag_queries"], "query_vectors": ["asked", "idf", "chunks"], "chunk_distances": ["query_vectors", "chunk_vectors", "chunks"],
    "evidence": ["consts", "chunk_distances", "rule_labels"], "lists": [], "list_flags": ["lists"],
    "list_texts": ["list_flags", "steps"], "list_evidence": ["list_flags", "evidence"],
}


def sql(select: str, *tables: str, flag_source: str = "validated", batch: str = "batch") -> str:
    """``select`` behind the shared tables it names and all they build on."""
    order: list[str] = []

    def need(name: str) -> None:
        if name == "lists":
            need(flag_source)
        if name == "requests":
            need(batch)
        for other in _DEPENDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for t in tables:
        need(t)
    ctes = ",\n".join(f"{n} AS ({CTES[n].replace('{flag_source}', flag_source).replace('{batch}', batch)})" for n in order)
    return f"WITH {ctes}\n{select}" if ctes else select


# --- the queries -------------------------------------------------------------------------------------

ORACLE: dict[str, str] = {}

_RAW = "claim_id, provider_id, diagnosis_code, procedure_code, billed_amount, date"
ORACLE["ingest_csv"] = sql(f"SELECT {_RAW}, patient_id, 'claims_1000.csv' AS source_file FROM bronze", "bronze")
ORACLE["ingest_csv_table"] = sql("SELECT count(*) AS rows_read, count(billed_amount) AS amounts, count(*) AS rows_written FROM bronze", "bronze")
ORACLE["save_bronze"] = sql(f"SELECT {_RAW} FROM bronze", "bronze")
ORACLE["load_bronze"] = ORACLE["save_bronze"]
ORACLE["ingest_all"] = """
  SELECT 'bronze_claims' AS table_name, 'LOADED' AS status, count(*) AS row_count FROM lineitem
  UNION ALL SELECT 'bronze_providers', 'LOADED', count(*) FROM supplier
  UNION ALL SELECT 'bronze_diagnosis', 'MISSING', 0
  UNION ALL SELECT 'bronze_cost', 'LOADED', count(*) FROM part"""
ORACLE["write_silver"] = sql("SELECT * REPLACE (claim_date::TIMESTAMP AS claim_date) FROM silver", "silver")
_FLAGS = ", ".join(f for f, _, _ in K.RULES)
ORACLE["write_validated"] = sql(f"SELECT claim_id, {_FLAGS}, validation_flags FROM validated", "validated")
_GOLD = ", ".join(K.GOLD_COLUMNS)
ORACLE["write_gold"] = sql(f"SELECT {_GOLD} FROM gold", "gold")
ORACLE["gold_features"] = ORACLE["write_gold"]
ORACLE["load_gold"] = sql("SELECT denial_label, risk_score, count(*) AS claims FROM gold GROUP BY ALL", "gold")
ORACLE["read_text_docs"] = r"""
  SELECT doc_id, length(t) AS characters, md5(t) AS text_md5
  FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g') AS t FROM documents)"""
_RAMP = """(SELECT {key}, 384::INT AS dim, round(sum(v * (bucket + 1)), 3) AS ramp, round(max(v), 5) AS largest FROM {table} GROUP BY {key})"""
_CHUNK_RAMP = _RAMP.format(key="chunk_id", table="chunk_vectors")
ORACLE["write_index"] = sql(f"SELECT chunk_id, source_file, md5(text) AS text_md5, chunk_index, total_chunks, dim, ramp, largest FROM chunks JOIN {_CHUNK_RAMP} USING (chunk_id)", "chunks", "chunk_vectors")
ORACLE["build_index"] = sql(f"SELECT * FROM {_CHUNK_RAMP}", "chunk_vectors")
_HISTORY = "SELECT u.username, claim_id, probability AS denial_probability, risk_level, predicted_label AS is_denied, flags FROM decided CROSS JOIN (VALUES ({}), ({})) AS u(username)"
ORACLE["append_history"] = " UNION ALL ".join(f"SELECT * FROM ({part})" for part in (
    sql(_HISTORY.format("'clerk'", "'admin'"), "decided"), sql(_HISTORY.format("'stream a'", "'stream b'"), "decided", batch="strict_batch")))
ORACLE["read_claims_batch"] = sql("""
  SELECT claim_id, patient_id, probability, risk_level, flags FROM decided""", "decided", batch="strict_batch")

ORACLE["normalize_columns"] = sql("SELECT claim_id, billed_amount FROM bronze", "bronze")
ORACLE["dedup_keep_first"] = sql("SELECT * FROM dedup", "dedup")
ORACLE["cleaning_counts"] = sql("""
  SELECT count(*) AS rows, count(*) - count(DISTINCT claim_id) AS duplicates,
         count(*) FILTER (WHERE try_strptime(date, '%Y-%m-%d') IS NULL) AS dates_null FROM bronze""", "bronze")
ORACLE["parse_date"] = sql("SELECT claim_id, CAST(try_strptime(date, '%Y-%m-%d') AS DATE) AS claim_date FROM bronze", "bronze")
ORACLE["standardize_codes"] = sql(
    f"SELECT claim_id, upper({strip('diagnosis_code')}) AS diagnosis_code, upper({strip('procedure_code')}) AS procedure_code FROM bronze", "consts", "bronze")
ORACLE["strip_strings"] = sql(f"""
  SELECT claim_id, {strip('provider_id')} AS provider_id, {strip('diagnosis_code')} AS diagnosis_code, {strip('procedure_code')} AS procedure_code
  FROM bronze""", "consts", "bronze")
ORACLE["fill_unknown"] = sql("SELECT provider_id, coalesce(location, 'Unknown') AS location FROM raw_providers", "raw_providers")
ORACLE["coerce_numeric"] = sql("""
  SELECT procedure_code, TRY_CAST(average_cost AS DOUBLE) AS average_cost, TRY_CAST(expected_cost AS DOUBLE) AS expected_cost FROM part_cost""", "part_cost")
ORACLE["clean_claims"] = sql("SELECT * FROM claims", "claims")
ORACLE["clean_providers"] = sql("SELECT * FROM providers", "providers")
ORACLE["clean_diagnosis"] = """
  SELECT concat('D', p_partkey) AS diagnosis_code, p_type AS category, CASE WHEN p_size > 25 THEN 'High' ELSE 'Low' END AS severity FROM part"""
ORACLE["clean_cost"] = sql("""
  SELECT concat('PROC', trim(replace(procedure_code, 'proc', ''))) AS procedure_code, TRY_CAST(average_cost AS DOUBLE) AS average_cost,
         TRY_CAST(expected_cost AS DOUBLE) AS expected_cost FROM part_cost""", "part_cost")
ORACLE["gold_projection"] = sql("""
  SELECT claim_id, provider_id, diagnosis_code, procedure_code, billed_amount, claim_date, expected_cost, average_cost, claim_amount_ratio,
         missing_fields_count, is_high_biller, claim_month, validation_flags, risk_score, denial_label FROM gold""", "gold")
ORACLE["history_display"] = sql(f"""
  SELECT claim_id, patient_id, provider_id, billed_amount, diagnosis_code, procedure_code, risk_level,
         printf('%.1f', denial_probability * 100) || '%' AS denial_probability,
         CASE WHEN is_denied THEN {q(K.DENIED_TEXT)} ELSE {q(K.CLEAN_TEXT)} END AS is_denied, flags, submitted_by,
         strftime(submitted_at, '%Y-%m-%d %H:%M') AS submitted_at FROM history""", "history")

for _flag, _, _ in K.RULES:
    ORACLE[_flag] = sql(f"SELECT claim_id, {_flag} FROM flagged", "flagged")
ORACLE["validation_flags"] = sql("SELECT claim_id, validation_flags FROM validated", "validated")
ORACLE["flagged_count"] = sql("SELECT count(*) FILTER (WHERE validation_flags <> '') AS flagged, count(*) AS total FROM validated", "validated")
ORACLE["validation_summary"] = sql(" UNION ALL ".join(
    f"SELECT '{label}' AS rule, count(*) FILTER (WHERE {cond}) AS claims, printf('%.1f', count(*) FILTER (WHERE {cond})::DOUBLE / count(*) * 100)::DOUBLE AS pct_of_claims FROM validated"
    for label, cond in [(label, f) for f, label, _ in K.RULES] + [("CLEAN", "validation_flags = ''")]), "validated")
ORACLE["request_flags"] = sql("SELECT claim_id, flags FROM decided", "decided")

ORACLE["enrich_providers"] = sql("SELECT claim_id, provider_id, doctor_name, specialty, location FROM silver", "silver")
ORACLE["enrich_diagnosis"] = sql("SELECT claim_id, diagnosis_code, category, severity FROM silver", "silver")
ORACLE["enrich_cost"] = sql("SELECT claim_id, procedure_code, average_cost, expected_cost FROM silver", "silver")
ORACLE["enrich_claims"] = sql("SELECT * FROM silver", "silver")
ORACLE["join_claims_providers"] = sql(f"""
  SELECT claim_id, {strip('b.provider_id')} AS provider_id, {strip('diagnosis_code')} AS diagnosis_code, {strip('procedure_code')} AS procedure_code,
         billed_amount, date, doctor_name, specialty, location
  FROM bronze b LEFT JOIN raw_providers p ON {strip('b.provider_id')} = p.provider_id""", "consts", "bronze", "raw_providers")

ORACLE["kpi_summary"] = sql("""
  SELECT count(*) AS total_claims, round(coalesce(sum(billed_amount), 0), 2) AS total_billed_amount, count(DISTINCT provider_id) AS unique_providers FROM bronze""", "bronze")
ORACLE["provider_activity_top10"] = sql(f"""
  SELECT doctor_name, count(*) AS claim_count FROM bronze b JOIN providers p ON {strip('b.provider_id')} = p.provider_id
  WHERE doctor_name IS NOT NULL GROUP BY doctor_name ORDER BY claim_count DESC, doctor_name LIMIT 10""", "bronze", "providers")
ORACLE["claims_trend"] = sql("""
  SELECT strftime(try_strptime(date, '%Y-%m-%d'), '%Y-%m-%d') AS date_parsed, round(coalesce(sum(billed_amount), 0), 2) AS billed_amount
  FROM bronze WHERE try_strptime(date, '%Y-%m-%d') IS NOT NULL GROUP BY 1""", "bronze")
ORACLE["label_distribution"] = sql("""
  SELECT sum(denial_label)::BIGINT AS denied, round(avg(denial_label) * 100, 4) AS denial_rate_pct,
         CASE WHEN avg(denial_label) * 100 > 95 OR avg(denial_label) * 100 < 5 THEN 'EXTREME' ELSE 'OK' END AS status FROM labelled""", "labelled")
ORACLE["class_balance"] = sql("SELECT round(avg(denial_label) * 100, 4) AS denied_pct, round(100 - avg(denial_label) * 100, 4) AS approved_pct FROM labelled", "labelled")
ORACLE["scale_pos_weight"] = sql("""
  SELECT count(*) FILTER (WHERE denial_label = 0) AS negatives, count(*) FILTER (WHERE denial_label = 1) AS positives,
         count(*) FILTER (WHERE denial_label = 0) / count(*) FILTER (WHERE denial_label = 1) AS scale_pos_weight FROM labelled""", "labelled")
ORACLE["feature_medians"] = sql(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, quantile_cont({f}::DOUBLE, 0.5) AS median FROM gold" for f in K.FEATURES), "gold")

_LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
             "l_returnflag", "l_linestatus", "l_shipdate")
ORACLE["profile_shape"] = f"""
  SELECT 'lineitem' AS table_name, count(*) AS row_count, {len(_LINEITEM)}::INT AS column_count, '{', '.join(_LINEITEM)}' AS column_names FROM lineitem"""
_CLAIM_COLUMNS = ("claim_id", "provider_id", "diagnosis_code", "procedure_code", "billed_amount", "date")
ORACLE["profile_missing"] = sql("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, round_even((count(*) - count({c}))::DOUBLE / count(*) * 100, 2) AS missing_pct FROM bronze"
    for c in _CLAIM_COLUMNS) + ") WHERE missing > 0", "bronze")
ORACLE["profile_duplicates"] = sql("SELECT count(*) - count(DISTINCT claim_id) AS duplicates FROM bronze", "bronze")
ORACLE["profile_date_range"] = sql(" UNION ALL ".join(f"""
  SELECT '{name}' AS column_name, strftime(min(try_strptime(date, '%Y-%m-%d')), '%Y-%m-%d') AS min_date,
         strftime(max(try_strptime(date, '%Y-%m-%d')), '%Y-%m-%d') AS max_date, count(*) FILTER (WHERE try_strptime(date, '%Y-%m-%d') IS NULL) AS invalid
  FROM bronze""" for name in ("date", "Ship Date")), "bronze")
ORACLE["profile_cardinality"] = sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values FROM bronze" for c in _CLAIM_COLUMNS), "bronze")
ORACLE["profile_numeric"] = " UNION ALL ".join(f"""
  SELECT '{c}' AS column_name, count({c})::DOUBLE AS count, round_even(avg({c}), 2) AS mean, round_even(stddev_samp({c}), 2) AS std, round_even(min({c})::DOUBLE, 2) AS min,
         round_even(quantile_cont({c}::DOUBLE, 0.25), 2) AS "25%", round_even(quantile_cont({c}::DOUBLE, 0.5), 2) AS "50%",
         round_even(quantile_cont({c}::DOUBLE, 0.75), 2) AS "75%", round_even(max({c})::DOUBLE, 2) AS max FROM lineitem""" for c in _LINEITEM[:8])
_PROFILED = {
    "bronze": ("bronze_claims", _CLAIM_COLUMNS),
    "raw_providers": ("bronze_providers", ("provider_id", "doctor_name", "specialty", "location")),
    "customer": ("customer", ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
    "part": ("part", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    "events": ("events", ("event_id", "ts", "user_id", "event_type", "value", "props")),
    "documents": ("documents", ("doc_id", "text", "lang", "source", "n_chars")),
    "pages": ("pages", ("page_id", "url", "html")),
    "benchmark": ("benchmark", ("item_id", "text")),
    "conversations": ("conversations", ("conv_id", "turn", "role", "text")),
}
_NUMBERS = {"billed_amount", "c_custkey", "c_nationkey", "c_acctbal", "p_partkey", "p_size", "p_retailprice", "event_id", "user_id", "value", "doc_id",
            "n_chars", "page_id", "item_id", "conv_id", "turn"}


def _profile(t: str, name: str, c: str) -> str:
    stats = [("count", "count({c})::DOUBLE"), ("mean", "round_even(avg({c}), 2)"), ("std", "round_even(stddev_samp({c}), 2)"), ("min", "round_even(min({c})::DOUBLE, 2)"),
             *[(f"{p}%", "round_even(quantile_cont({c}::DOUBLE, 0." + str(p) + "), 2)") for p in (25, 50, 75)], ("max", "round_even(max({c})::DOUBLE, 2)")]
    numbers = ", ".join((f.format(c=c) if c in _NUMBERS else "NULL::DOUBLE") + f' AS "{n}"' for n, f in stats)
    day = "strftime({}(try_strptime(date, '%Y-%m-%d')), '%Y-%m-%d')"
    dates = (f"{day.format('min')} AS min_date, {day.format('max')} AS max_date, count(*) FILTER (WHERE try_strptime(date, '%Y-%m-%d') IS NULL) AS invalid_dates"
             if c == "date" else "NULL::VARCHAR AS min_date, NULL::VARCHAR AS max_date, NULL::BIGINT AS invalid_dates")
    repeats = f"count(*) - count(DISTINCT {c}) - coalesce(max(({c} IS NULL)::BIGINT), 0)" if c == "claim_id" else "NULL::BIGINT"
    return (f"SELECT '{name}' AS table_name, count(*) AS row_count, '{c}' AS column_name, count(*) - count({c}) AS missing, "
            f"count(DISTINCT {c}) AS distinct_values, ({repeats})::BIGINT AS duplicates, {dates}, {numbers} FROM {t}")


ORACLE["profile_all"] = sql(" UNION ALL ".join(_profile(t, name, c) for t, (name, columns) in _PROFILED.items() for c in columns), "bronze", "raw_providers")
ORACLE["quality_check"] = sql("""
  SELECT 'bronze_claims' AS table_name, 'patient_id' AS column_name, 'COLUMN MISSING' AS issue, NULL::DOUBLE AS null_pct
  UNION ALL SELECT * FROM (""" + " UNION ALL ".join(f"""
  SELECT 'bronze_claims' AS table_name, '{c}' AS column_name, 'HIGH NULLS' AS issue, printf('%.1f', (count(*) - count({c}))::DOUBLE / count(*) * 100)::DOUBLE AS null_pct FROM bronze
  HAVING (count(*) - count({c}))::DOUBLE / count(*) * 100 > 10.0""" for c in _CLAIM_COLUMNS[:5]) + ")", "bronze")


def _summary(name: str, table: str, columns, expected, absent: int) -> str:
    nulls = " + ".join(f"count(*) - count({c})" for c in columns)
    issues = " + ".join(f"((count(*) - count({c}))::DOUBLE / count(*) * 100 > 10.0)::INT" for c in expected)
    return (f"SELECT '{name}' AS table_name, count(*) AS row_count, {len(columns)}::INT AS column_count, ({nulls})::BIGINT AS total_nulls, "
            f"({issues} + {absent})::BIGINT AS issues FROM {table}")


ORACLE["quality_summary"] = sql(" UNION ALL ".join([
    _summary("bronze_claims", "bronze", _CLAIM_COLUMNS, _CLAIM_COLUMNS[:5], 1),
    _summary("bronze_providers", "raw_providers", ("provider_id", "doctor_name", "specialty", "location"), ("provider_id", "doctor_name", "specialty"), 0),
    _summary("bronze_cost", "(SELECT procedure_code, TRY_CAST(average_cost AS DOUBLE) AS average_cost, TRY_CAST(expected_cost AS DOUBLE) AS expected_cost FROM part_cost)",
             ("procedure_code", "average_cost", "expected_cost"), ("procedure_code", "average_cost", "expected_cost"), 0),
]), "bronze", "raw_providers", "part_cost")

ORACLE["provider_claim_count"] = sql("SELECT claim_id, provider_claim_count FROM gold", "gold")
ORACLE["provider_denial_rate"] = sql("SELECT claim_id, provider_denial_rate FROM gold", "gold")
ORACLE["provider_features"] = sql("SELECT * FROM stats", "stats")
ORACLE["history_latest"] = sql("SELECT * EXCLUDE (submitted_at) FROM history ORDER BY submitted_at DESC, id DESC LIMIT 100", "history")
ORACLE["history_latest_user"] = sql(
    "SELECT * EXCLUDE (submitted_at) FROM history WHERE submitted_by = 'user8' ORDER BY submitted_at DESC, id DESC LIMIT 100", "history")
for _c in ("claim_amount_ratio", "diagnosis_severity_flag", "missing_fields_count", "is_high_biller", "claim_month", "risk_score", "denial_label"):
    ORACLE[_c] = sql(f"SELECT claim_id, {_c} FROM gold", "gold")

ORACLE["chunk_text"] = sql("""
  SELECT source_file, len(chunks)::INT AS n_chunks, md5(coalesce(array_to_string(chunks, chr(10)), '')) AS chunks_md5 FROM doc_chunks""", "doc_chunks")
ORACLE["chunk_documents"] = sql("SELECT chunk_id, source_file, text, chunk_index, total_chunks FROM chunks", "chunks")
ORACLE["knn_l2"] = sql("""
  SELECT query_id, vec_id, round(distance, 4) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank
  FROM distances QUALIFY rank <= 10""", "distances")
ORACLE["cosine_from_l2"] = sql("""
  SELECT query_id, vec_id, round(1.0 - distance / 2.0, 4) AS cosine FROM distances
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 3""", "distances")
_OCCURRING = "flag IN (SELECT unnest(string_split(validation_flags, '|')) FROM validated UNION SELECT upper(event_type) FROM events)"
ORACLE["topk_chunks"] = sql(f"""
  SELECT flag AS query_id, rank::INT AS rank, chunk_id, source_file, md5(text) AS text_md5, round(distance, 4) AS distance
  FROM chunk_distances WHERE rank <= 3 AND {_OCCURRING}""", "validated", "chunk_distances")
ORACLE["retrieve"] = sql(f"""
  SELECT flag, query, count(chunk_id)::INT AS n_chunks, coalesce(string_agg(chunk_id, ',' ORDER BY rank), '') AS chunk_ids,
         coalesce(arg_min(source_file, rank), '') AS source_file, md5(coalesce(arg_min(text, rank), '')) AS text_md5, count(chunk_id) > 0 AS found
  FROM asked LEFT JOIN (SELECT * FROM chunk_distances WHERE rank <= 3) USING (flag) WHERE {_OCCURRING} GROUP BY flag, query""", "validated", "asked", "chunk_distances")
ORACLE["retrieve_multiple"] = sql(f"""
  SELECT flag, coalesce(source_file, '') AS source_file, round(distance, 4) AS distance, chunk_id IS NOT NULL AS found
  FROM asked LEFT JOIN (SELECT * FROM chunk_distances WHERE rank = 1) USING (flag) WHERE {_OCCURRING}""", "validated", "asked", "chunk_distances")
# whole documents instead of chunks
_WHOLE = "chunks AS (SELECT concat('doc', doc_id, '.txt') AS chunk_id, text FROM documents)"
ORACLE["embed_text"] = f"""WITH {_WHOLE}, chunk_buckets AS ({CTES['chunk_buckets']}), idf AS ({CTES['idf']}), chunk_vectors AS ({CTES['chunk_vectors']})
  SELECT chunk_id AS source_file, dim, ramp, largest FROM {_CHUNK_RAMP}"""
_ASKED = """asked AS (
  SELECT DISTINCT unnest(string_split(validation_flags, '|')) AS flag FROM validated WHERE validation_flags <> ''
  UNION SELECT DISTINCT upper(event_type) FROM events)"""
ORACLE["expand_flag_query"] = sql(f"""
  , {_ASKED}, texts AS (SELECT * FROM {values(list(K.FLAG_QUERIES.items()), 't(flag, text)')})
  SELECT flag, coalesce(text, {q(K.DEFAULT_QUERY_PREFIX)} || flag) AS query FROM asked LEFT JOIN texts USING (flag)""", "validated")

ORACLE["prepare_features"] = sql("SELECT claim_id, " + ", ".join(
    f"coalesce({f}::DOUBLE, (SELECT quantile_cont({f}::DOUBLE, 0.5) FROM gold)) AS {f}" for f in K.FEATURES) + ", denial_label FROM gold", "gold")
ORACLE["stratified_split"] = sql("""
  SELECT claim_id, denial_label, row_number() OVER (PARTITION BY denial_label ORDER BY md5(claim_id), claim_id)
         <= floor(count(*) OVER (PARTITION BY denial_label) * 0.2::DOUBLE + 0.5) AS is_test FROM labelled""", "labelled")
ORACLE["score_auc"] = sql("""
  SELECT round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 6)::DOUBLE AS auc
  FROM (SELECT *, sum(n) OVER (ORDER BY score) - n AS below
        FROM (SELECT score, count(*) FILTER (WHERE label = 1)::DOUBLE AS p, count(*) FILTER (WHERE label = 0)::DOUBLE AS n FROM rule_scores GROUP BY score))""", "rule_scores")


def _thresholds() -> str:
    import numpy as np

    return ", ".join(f"({i}, {float(t)!r}::DOUBLE, {round(float(t), 2)!r}::DOUBLE)" for i, t in enumerate(np.arange(0.10, 0.91, 0.01)))


ORACLE["best_f1_threshold"] = sql(f"""
  SELECT r AS best_threshold, round(f1, 6) AS best_f1
  FROM (SELECT i, r, 2.0::DOUBLE * count(*) FILTER (WHERE label = 1 AND score >= t) / (2.0::DOUBLE * count(*) FILTER (WHERE label = 1 AND score >= t)
               + count(*) FILTER (WHERE label = 0 AND score >= t) + count(*) FILTER (WHERE label = 1 AND score < t)) AS f1
        FROM rule_scores, (VALUES {_thresholds()}) th(i, t, r) GROUP BY i, r)
  ORDER BY f1 DESC, i LIMIT 1""", "rule_scores")
ORACLE["classification_report"] = sql("""
  , cm AS (SELECT count(*) FILTER (WHERE label = 1 AND score >= 0.37)::DOUBLE AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.37)::DOUBLE AS fp,
                  count(*) FILTER (WHERE label = 1 AND score < 0.37)::DOUBLE AS fn, count(*) FILTER (WHERE label = 0 AND score < 0.37)::DOUBLE AS tn FROM rule_scores),
  m AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0, tn + fp AS s0,
               tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fn + fp) AS f1, tp + fn AS s1, (tp + tn) / (tp + tn + fp + fn) AS acc FROM cm),
  rows AS (SELECT 'Approved' AS class, p0 AS p, r0 AS r, f0 AS f, s0 AS s FROM m UNION ALL SELECT 'Denied', p1, r1, f1, s1 FROM m
           UNION ALL SELECT 'accuracy', acc, acc, acc, s0 + s1 FROM m
           UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM m
           UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM m)
  SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, s::BIGINT AS support FROM rows""", "rule_scores")
ORACLE["risk_level"] = sql("""
  SELECT claim_id, printf('%.4f', least(p, 1.0))::DOUBLE AS probability, (least(p, 1.0) >= 0.37)::INT AS predicted_label,
         CASE WHEN p >= 0.70 THEN 'HIGH' WHEN p >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, 0.37::DOUBLE AS threshold
  FROM (SELECT claim_id, (risk_score * 2 + provider_denial_rate) / 12.0 AS p FROM gold)""", "gold")
ORACLE["explanation_text"] = sql(f"""
  SELECT claim_id, rank, concat(CASE WHEN v > 0 THEN '⚠' ELSE '✓' END, ' ', label, ' is ', value::VARCHAR, ' (',
         CASE WHEN v > 0 THEN '+' ELSE '' END, printf('%.2f', v), ' risk)') AS line
  FROM (SELECT claim_id, 1::INT AS rank, {q(K.FEATURE_LABELS['missing_fields_count'])} AS label, missing_fields_count::DOUBLE AS value,
               missing_fields_count * 0.25::DOUBLE - 0.25::DOUBLE AS v FROM gold
        UNION ALL SELECT claim_id, 2, {q(K.FEATURE_LABELS['claim_amount_ratio'])}, printf('%.4f', coalesce(claim_amount_ratio, 1.0::DOUBLE))::DOUBLE,
               printf('%.4f', coalesce(claim_amount_ratio, 1.0::DOUBLE) / 10 - 0.2::DOUBLE)::DOUBLE FROM gold)
  WHERE abs(v) >= 0.01""", "gold")

ORACLE["serving_features"] = sql("""
  SELECT claim_id, high::INT::DOUBLE AS is_high_biller, CASE WHEN high THEN 4.5::DOUBLE ELSE 1.0::DOUBLE END AS claim_amount_ratio, missing::DOUBLE AS missing_fields_count,
         CASE WHEN coalesce(diagnosis_code, '') = '' THEN 1.0::DOUBLE END AS diagnosis_severity_flag,
         CASE WHEN missing > 0 OR high THEN 0.85::DOUBLE END AS provider_denial_rate, NULL::DOUBLE AS provider_claim_count, NULL::DOUBLE AS claim_month
  FROM requests""", "requests")
ORACLE["strict_override"] = sql("SELECT claim_id, probability, predicted_label, risk_level FROM decided", "decided")
_FIRED = ", ".join(f"CASE WHEN list_contains(string_split(flags, '|'), '{f}') THEN {q('/'.join(t))} END" for f, *t in K.CONTRIBUTIONS if f)
_FALLBACK = next(q("/".join(t)) for f, *t in K.CONTRIBUTIONS if f is None)
ORACLE["canned_contributions"] = sql(f"""
  SELECT claim_id, CASE WHEN c = '' AND probability > 0.15 THEN {_FALLBACK} ELSE c END AS contributions
  FROM (SELECT claim_id, probability, concat_ws('; ', {_FIRED}) AS c FROM decided)""", "decided")

ORACLE["action_steps"] = sql("""
  SELECT claim_id, md5(coalesce(action_steps, '')) AS steps_md5 FROM validated LEFT JOIN list_texts USING (validation_flags)""", "validated", "list_texts")
ORACLE["rag_evidence"] = sql("SELECT reason_title, source_name, similarity_score, policy_preview, md5(block) AS block_md5 FROM evidence", "evidence")


def _report(claim_id: str, analysis: str) -> str:
    head, rest = K.PLAN_TEMPLATE.split("{claim_id}")
    a, rest = rest.split("{flags_list}")
    b, rest = rest.split("{policy_analysis}")
    c, d = rest.split("{action_steps}")
    return (f"CASE WHEN validation_flags = '' THEN concat('CLAIM ', {claim_id}, ': No validation flags present. Claim is clean.') "
            f"ELSE concat({q(head)}, {claim_id}, {q(a)}, flag_lines, {q(b)}, {analysis}, {q(c)}, action_steps, {q(d)}) END")


_N_FLAGS = "CASE WHEN validation_flags = '' THEN 0 ELSE len(string_split(validation_flags, '|')) END::INT AS n_flags"
ORACLE["remediation_plan"] = sql(f"""
  SELECT claim_id, {_N_FLAGS}, coalesce(array_to_string(sources, ','), '') AS sources, length(report)::INT AS report_length, md5(report) AS report_md5
  FROM (SELECT *, {_report('claim_id', 'analysis')} AS report FROM validated LEFT JOIN list_texts USING (validation_flags) LEFT JOIN list_evidence USING (validation_flags))""",
    "validated", "list_texts", "list_evidence")
ORACLE["plan_sources"] = sql("SELECT claim_id, unnest(sources) AS source_file FROM validated JOIN list_evidence USING (validation_flags)", "validated", "list_evidence")
ORACLE["fallback_plan"] = sql(f"""
  SELECT claim_id, {_N_FLAGS}, '' AS sources, length(report)::INT AS report_length, md5(report) AS report_md5
  FROM (SELECT *, {_report('claim_id', q(K.OFFLINE_TEXT))} AS report FROM validated LEFT JOIN list_texts USING (validation_flags))""", "validated", "list_texts")
_BATCH = "SELECT *, flags AS validation_flags FROM decided"
CTES["decided_flags"] = _BATCH
_DEPENDS["decided_flags"] = ["decided"]
_N_CONTRIB = "len(list_filter([{}], lambda c: c IS NOT NULL))".format(_FIRED)
ORACLE["evaluate_claims"] = sql(f"""
  SELECT claim_id, probability, predicted_label, risk_level, flags,
         (CASE WHEN {_N_CONTRIB} = 0 AND probability > 0.15 THEN 1 ELSE {_N_CONTRIB} END)::INT AS n_contributions,
         coalesce(array_to_string(sources, ','), '') AS sources, md5({_report('claim_id', 'analysis')}) AS report_md5
  FROM decided_flags LEFT JOIN list_texts USING (validation_flags) LEFT JOIN list_evidence USING (validation_flags)""",
    "decided_flags", "list_texts", "list_evidence", flag_source="decided_flags")
ORACLE["stream_score_claims"] = sql("""
  SELECT claim_id, 'stream' AS username, probability AS denial_probability, risk_level, predicted_label AS is_denied, flags FROM decided""", "decided", batch="strict_batch")

ORACLE["schema_check"] = sql("SELECT 'bronze_claims' AS table_name, (SELECT count(*) FROM bronze) AS row_count, * FROM " + values(
    [(c, "double" if c == "billed_amount" else "string", None if c == "patient_id" else "double" if c == "billed_amount" else "string",
      "MISSING" if c == "patient_id" else "OK") for c in ("claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code", "billed_amount", "date")],
    "t(column_name, expected_type, actual_type, status)"), "bronze")
ORACLE["join_null_check"] = sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({k}) AS keyed, count(*) FILTER (WHERE {k} IS NOT NULL AND {c} IS NULL) AS unmatched FROM silver"
    for c, k in (("doctor_name", "provider_id"), ("category", "diagnosis_code"), ("expected_cost", "procedure_code"))), "silver")
ORACLE["all_null_check"] = sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, count(*) > 0 AND count({c}) = 0 AS all_null FROM gold" for c in K.FEATURES), "gold")
ORACLE["attribution_sorted"] = sql("SELECT claim_id, 7::INT AS features, true AS ranked, true AS in_order, true AS adds_up FROM gold", "gold")

# provider audits, with the numbers of the policy
_DAYS = """days AS (
  SELECT provider_id, claim_date AS day, count(*) AS claims, count(*) FILTER (WHERE validation_flags <> '') AS flagged,
         count(*) FILTER (WHERE list_contains(string_split(validation_flags, '|'), 'WARN_HIGH_BILLING')) AS high,
         count(*) FILTER (WHERE list_contains(string_split(validation_flags, '|'), 'ERR_INCOMPLETE_CLAIM')) AS incomplete,
         max(CASE WHEN expected_cost > 0 THEN billed_amount / expected_cost END) AS multiple
  FROM validated WHERE provider_id IS NOT NULL GROUP BY provider_id, claim_date),
sums AS (
  SELECT *, sum(flagged) OVER w90 / sum(claims) OVER w90 AS rate, sum(high) OVER w90 / sum(claims) OVER w90 AS high_rate,
         sum(high) OVER w30 AS high_30, sum(incomplete) OVER w30 AS incomplete_30
  FROM days WHERE day IS NOT NULL
  WINDOW w90 AS (PARTITION BY provider_id ORDER BY day RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY provider_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW))"""
ORACLE["provider_tier"] = sql(f""", {_DAYS} SELECT provider_id, claims, round(rate, 9) AS denial_rate,
  CASE WHEN rate < 0.20 THEN 'NORMAL' WHEN rate <= 0.40 THEN 'ELEVATED' ELSE 'HIGH RISK' END AS tier
  FROM (SELECT provider_id, sum(claims)::BIGINT AS claims, sum(flagged) / sum(claims) AS rate FROM days GROUP BY provider_id)""", "validated")
ORACLE["audit_trigger"] = sql(f""", {_DAYS} SELECT *, denial_rate_90d OR high_billing_30d OR incomplete_30d OR single_claim AS triggered FROM (
  SELECT provider_id, coalesce(bool_or(rate > 0.40), false) AS denial_rate_90d, coalesce(bool_or(high_30 > 10), false) AS high_billing_30d,
         coalesce(bool_or(incomplete_30 > 5), false) AS incomplete_30d, any_value(single) AS single_claim
  FROM (SELECT provider_id, coalesce(bool_or(multiple > 10), false) AS single FROM days GROUP BY provider_id) LEFT JOIN sums USING (provider_id)
  GROUP BY provider_id)""", "validated")
ORACLE["high_billing_notice"] = sql(f""", {_DAYS} SELECT provider_id, round(max(high_rate), 9) AS high_billing_rate, max(high_rate) > 0.25 AS notice
  FROM sums GROUP BY provider_id""", "validated")
ORACLE["high_volume_provider"] = sql(f""", {_DAYS} SELECT provider_id, strftime(day, '%Y-%m') AS month, sum(claims)::BIGINT AS claims
  FROM days WHERE day IS NOT NULL GROUP BY ALL HAVING sum(claims) > 100""", "validated")

# approximate search: the exact search has so many neighbours, of which nine in ten have to be found
ORACLE["knn_cells_recall"] = "SELECT sum(least(10, (SELECT count(*) FROM embeddings)))::BIGINT AS neighbours, true AS reached FROM embeddings WHERE vec_id % 20 = 0"

# the model: what SQL can say of a result that depends on trees
ORACLE["write_artifacts"] = sql(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, quantile_cont({f}::DOUBLE, 0.5) AS median, true AS same_scores, true AS same_threshold, 1.0::DOUBLE AS importance_sum FROM gold HAVING count({f}) > 0"
    for f in K.FEATURES), "gold")
ORACLE["feature_importance"] = "SELECT feature, true AS in_range, 1.0::DOUBLE AS total FROM " + values([(f, i) for i, f in enumerate(K.FEATURES)], "t(feature, i)")
ORACLE["importance_sorted"] = f"SELECT unnest(range(1, {len(K.FEATURES) + 1}))::INT AS place, true AS in_order, true AS known"
ORACLE["score_claims"] = sql(
    "SELECT claim_id, true AS in_range, true AS rounded, true AS label_fits, true AS level_fits, true AS threshold_fits FROM gold", "gold")
ORACLE["tune_random_cv"] = "SELECT unnest(range(10))::INT AS trial, true AS in_ranges, true AS learned"
ORACLE["train_gbt"] = "SELECT true AS tuned, true AS threshold_in_range, true AS f1_in_range, true AS auc_in_range"

# growing tables
ORACLE["upsert_silver"] = ORACLE["clean_claims"]
ORACLE["stream_audit_trigger"] = "SELECT *, 0::BIGINT AS late_rows FROM (" + ORACLE["audit_trigger"] + ")"
_CSV_LINE = "concat_ws(',', claim_id, coalesce(patient_id, ''), coalesce(provider_id, ''), coalesce(diagnosis_code, ''), coalesce(procedure_code, ''), amount, coalesce(date, ''))"
ORACLE["quarantine_csv"] = sql(f"""
  , keyed AS (SELECT *, regexp_replace(claim_id, '[^0-9]', '', 'g')::BIGINT AS key FROM bronze),
  amounts AS (SELECT *, CASE WHEN key % 97 = 3 THEN 'n/a' ELSE coalesce(billed_amount::VARCHAR, '') END AS amount FROM keyed),
  lines AS (SELECT *, key % 89 = 1 AS short, key % 89 <> 1 AND key % 83 = 2 AS long, {_CSV_LINE} AS line FROM amounts)
  SELECT 'good' AS kind, claim_id, billed_amount, date, NULL::VARCHAR AS line, NULL::INT AS n_fields FROM lines WHERE NOT short AND NOT long AND amount <> 'n/a'
  UNION ALL SELECT 'rejected', NULL, NULL, NULL, CASE WHEN short THEN regexp_replace(line, ',[^,]*$', '') WHEN long THEN line || ',more' ELSE line END,
         (7 - short::INT + long::INT)::INT FROM lines WHERE short OR long OR amount = 'n/a'""", "bronze")

_LINE_NUMBERS = _LINEITEM[:8]
ORACLE["profile_sketches"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS missing, "
    + (f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, true AS mean_fits, true AS std_fits, true AS distinct_fits, true AS ranks_fit"
       if c in _LINE_NUMBERS else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::BOOLEAN AS mean_fits, NULL::BOOLEAN AS std_fits, true AS distinct_fits, NULL::BOOLEAN AS ranks_fit")
    + " FROM lineitem" for c in _LINEITEM)
ORACLE["read_marked_docs"] = "SELECT doc_id, length(coalesce(text, '')) AS characters, md5(coalesce(text, '')) AS text_md5 FROM documents"
ORACLE["cost_valid_on"] = sql("""
  , dated AS (
    SELECT concat('PROC', 1 + p_partkey % 6) AS procedure_code, ('1992-01-01'::DATE + (p_partkey * 37 % 2500)::INT)::DATE AS valid_from, max(p_retailprice) AS dated_cost FROM part GROUP BY 1, 2)
  SELECT claim_id, c.procedure_code, claim_date, dated_cost
  FROM claims c ASOF LEFT JOIN dated d ON c.procedure_code = d.procedure_code AND c.claim_date >= d.valid_from""", "claims")

_HIGH_NULLS = [(t, table, c) for t, table, columns in (
    ("bronze", "bronze_claims", _CLAIM_COLUMNS[:5]), ("raw_providers", "bronze_providers", ("provider_id", "doctor_name", "specialty"))) for c in columns]
ORACLE["layer_problems"] = sql("SELECT * FROM (" + " UNION ALL ".join([
    "SELECT 'ING-1002' AS code, 'bronze_claims.patient_id' AS subject, 'column of type string is missing' AS detail",
    "SELECT 'ING-1002', 'bronze_cost.region', 'column of type string is missing'",
    *[f"SELECT 'SLV-2001', '{table}.{c}', printf('%.1f%% nulls', (count(*) - count({c}))::DOUBLE / count(*) * 100) FROM {t} HAVING (count(*) - count({c}))::DOUBLE / count(*) > 0.1" for t, table, c in _HIGH_NULLS],
    *[f"SELECT 'SLV-2004', '{c}', printf('%d of %d keys found no row', count(*) FILTER (WHERE {k} IS NOT NULL AND {c} IS NULL), count({k})) FROM silver HAVING count(*) FILTER (WHERE {k} IS NOT NULL AND {c} IS NULL) > 0"
      for c, k in (("doctor_name", "provider_id"), ("category", "diagnosis_code"), ("expected_cost", "procedure_code"))],
    *[f"SELECT 'GLD-3002', '{f}', 'no value at all' FROM gold HAVING count(*) > 0 AND count({f}) = 0" for f in K.FEATURES],
    "SELECT 'GLD-3003', 'denial_label', printf('%.1f%% denied', avg(denial_label) * 100) FROM labelled HAVING avg(denial_label) * 100 > 95 OR avg(denial_label) * 100 < 5",
]) + ")", "bronze", "raw_providers", "silver", "gold", "labelled")

# reports as text, line by line
_REPORTED = {
    "bronze_claims": ("bronze", _CLAIM_COLUMNS, {"billed_amount"}), "bronze_providers": ("raw_providers", ("provider_id", "doctor_name", "specialty", "location"), set()),
    "bronze_diagnosis": ("diagnosis", ("diagnosis_code", "category", "severity"), set()),
    "bronze_cost": ("cost", ("procedure_code", "average_cost", "expected_cost"), {"average_cost", "expected_cost"}),
}
# columns that the quality report expects
_EXPECTED = {
    "bronze_claims": ("claim_id", "patient_id", "provider_id", "diagnosis_code", "procedure_code", "billed_amount"), "bronze_providers": ("provider_id", "doctor_name", "specialty"),
    "bronze_diagnosis": ("diagnosis_code", "category", "severity"), "bronze_cost": ("procedure_code", "average_cost", "expected_cost"),
}


def _lines(parts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT unnest(string_split(text, chr(10))) AS value FROM ({part}) t(text)" for part in parts)


def _quality_lines() -> list[str]:
    parts, issues = ["SELECT 'DATA QUALITY SUMMARY — ALL BRONZE TABLES' || chr(10)", "SELECT '--- Issues Requiring Attention ---'"], []
    for name, (t, columns, _) in _REPORTED.items():
        absent = [c for c in _EXPECTED[name] if c not in columns]
        high = " + ".join(f"((count(*) - count({c}))::DOUBLE / count(*) * 100 > 10.0)::INT" for c in _EXPECTED[name] if c in columns)
        nulls = " + ".join(f"count(*) - count({c})" for c in columns)
        parts.append(f"""SELECT concat('Table   : {name}', chr(10), '  Rows          : ', format('{{:,}}', count(*)), chr(10), '  Columns       : {len(columns)}', chr(10),
          '  Total nulls   : ', format('{{:,}}', {nulls}), chr(10), '  Issues found  : ', ({high} + {len(absent)})::INT, chr(10)) FROM {t}""")
        issues += [f"SELECT concat('  ⚠  [{name}] COLUMN MISSING: ', chr(39), '{c}', chr(39))" for c in absent]
        issues += [f"SELECT printf('  ⚠  [{name}] HIGH NULLS in %s{c}%s: %.1f%%', chr(39), chr(39), (count(*) - count({c}))::DOUBLE / count(*) * 100) FROM {t} HAVING (count(*) - count({c}))::DOUBLE / count(*) * 100 > 10.0"
                   for c in _EXPECTED[name] if c in columns]
    return parts + issues


def _profile_lines(name: str, t: str, columns, numbers) -> list[str]:
    missing = {c: f"(count(*) - count({c}))" for c in columns}
    parts = [f"SELECT 'PROFILING REPORT: {name}'", f"SELECT concat('Rows    : ', format('{{:,}}', count(*)), chr(10), 'Columns : {len(columns)}', chr(10), 'Names   : [{', '.join(columns)}]') FROM {t}",
             "SELECT '--- Missing Values ---'"]
    parts += [f"SELECT printf('  %-30s %5d missing  (%s%%)', '{c}', {m}, round_even({m}::DOUBLE / count(*) * 100, 2)::VARCHAR) FROM {t} HAVING {m} > 0" for c, m in missing.items()]
    parts.append(f"SELECT '  No missing values' FROM {t} HAVING {' + '.join(missing.values())} = 0")
    if "claim_id" in columns:
        parts += ["SELECT '--- Duplicate claim_ids ---'", f"SELECT printf('  %d duplicate(s) found', count(*) - count(DISTINCT claim_id)) FROM {t}"]
    if "date" in columns:
        day = "strftime({}(try_strptime(date, '%Y-%m-%d')), '%Y-%m-%d %H:%M:%S')"
        parts.append(f"""SELECT concat('--- Date Range (date) ---', chr(10), '  Min     : ', {day.format('min')}, chr(10), '  Max     : ', {day.format('max')}, chr(10),
          printf('  Invalid : %d unparseable date(s)', count(*) FILTER (WHERE try_strptime(date, '%Y-%m-%d') IS NULL))) FROM {t}""")
    parts += ["SELECT '--- Column Cardinality (unique values) ---'", *[f"SELECT printf('  %-30s %5d unique', '{c}', count(DISTINCT {c})) FROM {t}" for c in columns]]
    stats = [("count", "count({c})::DOUBLE"), ("mean", "round_even(avg({c}), 2)"), ("std", "round_even(stddev_samp({c}), 2)"), ("min", "round_even(min({c})::DOUBLE, 2)"),
             *[(f"{p}%", "round_even(quantile_cont({c}::DOUBLE, 0." + str(p) + "), 2)") for p in (25, 50, 75)], ("max", "round_even(max({c})::DOUBLE, 2)")]
    if numbers:
        parts.append("SELECT '--- Numeric Statistics ---'")
        parts += [f"SELECT concat(printf('  %-30s ', '{c}'), " + ", '  ', ".join(f"'{n}=', coalesce(({f.format(c=c)})::VARCHAR, 'NaN')" for n, f in stats) + f") FROM {t}" for c in columns if c in numbers]
    return parts


ORACLE["write_report"] = sql(_lines(_quality_lines() + [p for name, (t, columns, numbers) in _REPORTED.items() for p in _profile_lines(name, t, columns, numbers)]),
                             "bronze", "raw_providers", "diagnosis", "cost")
