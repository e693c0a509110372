"""Registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import constants as K
from claimlens.functions.numbers import py_round
from claimlens.functions.vector import cosine_from_l2
from claimlens.ml import evaluate, prepare, score, train
from claimlens.operators import (
    audit, cells, chunking, clean, embed, enrich, features, inverted, knn, kpi, profile, quality, remediate, retrieval, rules, serving, sketches, validity,
)
from claimlens.plans import decisions, layers, training
from claimlens.schemas import RAW_CLAIMS, RAW_SCHEMAS
from claimlens.session import drop_table, scratch_path, stage
from claimlens.sources import artifacts, documents, policies, quarantine, star, tables, upsert
from claimlens.streaming import audits
from claimlens.streaming.decisions import stream_score_claims

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- shared inputs ---------------------------------------------------------------------------------


def claims(spark, sf, patient=False):
    return clean.clean_claims(star.raw_claims(spark, sf, patient, position=True))


def providers(spark, sf):
    return clean.clean_providers(star.raw_providers(spark, sf))


def silver(spark, sf, patient=False):
    return layers.build_silver(star.bronze(spark, sf, patient, position=True))


def costed(spark, sf, patient=False):
    """Clean claims with expected costs: what the rules and most features need."""
    return enrich.enrich_cost(claims(spark, sf, patient), star.cost(spark))


def validated(spark, sf, patient=False):
    return rules.apply_validation_rules(costed(spark, sf, patient))


def gold(spark, sf):
    """Gold table without patient and provider texts, over a written validated table."""
    full = enrich.enrich_diagnosis(validated(spark, sf), star.diagnosis(spark))
    return features.gold_features(stage(full, "validated"))


def ints(df, *columns):
    return df.withColumns({c: F.col(c).cast("int") for c in columns})


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- scans, sources, sinks ---------------------------------------------------------------------------


def _raw_csv(spark, sf):
    path = scratch_path(spark, "raw") + "/claims_1000.csv"
    return tables.write_csv(star.raw_claims(spark, sf, patient=True).select(*RAW_CLAIMS.names), path)


@query
def ingest_csv(spark, sf):
    return tables.ingest_csv(spark, _raw_csv(spark, sf), RAW_CLAIMS).drop("ingestion_timestamp")


@query
def ingest_csv_table(spark, sf):
    base = scratch_path(spark, "bronze")
    rows = tables.ingest_csv_table(spark, _raw_csv(spark, sf), RAW_CLAIMS, base, "bronze_claims")
    return tables.load_bronze(spark, base, "bronze_claims").agg(
        F.count(F.lit(1)).alias("rows_read"), F.count("billed_amount").alias("amounts"), F.lit(rows).cast("long").alias("rows_written"))


@query
def save_bronze(spark, sf):
    base = scratch_path(spark, "bronze")
    path = tables.save_bronze(star.raw_claims(spark, sf), base, "bronze_claims", fmt="csv")
    return tables.ingest_csv(spark, path, star.raw_claims(spark, sf).schema).drop("ingestion_timestamp", "source_file")


@query
def ingest_all(spark, sf):
    raw = scratch_path(spark, "raw")
    tables.write_csv(star.raw_claims(spark, sf, patient=True).select(*RAW_CLAIMS.names), f"{raw}/claims_1000.csv")
    tables.write_csv(star.raw_providers(spark, sf), f"{raw}/providers_1000.csv")
    tables.write_csv(star.raw_part_cost(spark, sf).withColumn("region", F.lit("all")), f"{raw}/cost.csv")
    return tables.ingest_all(spark, raw, scratch_path(spark, "bronze"), schemas=RAW_SCHEMAS)


@query
def load_bronze(spark, sf):
    base = scratch_path(spark, "bronze")
    tables.save_bronze(star.raw_claims(spark, sf), base, "bronze_claims")
    return tables.load_bronze(spark, base, "bronze_claims")


def _layers(spark, sf, patient=True, **options):
    base = scratch_path(spark, "layers")
    for name, df in star.bronze(spark, sf, patient, position=True).items():
        tables.save_bronze(df, base, name)
    return layers.run_layers(spark, base, base, **options)


@query
def write_silver(spark, sf):
    path = tables.write_layer(silver(spark, sf, patient=True), scratch_path(spark, "silver"))
    return spark.read.parquet(path)


@query
def write_validated(spark, sf):
    path = tables.write_layer(rules.apply_validation_rules(silver(spark, sf)), scratch_path(spark, "validated"))
    return spark.read.parquet(path).select("claim_id", *[r.flag for r in rules.BATCH_RULES], "validation_flags")


@query
def write_gold(spark, sf):
    return _gold_output(spark.read.parquet(_layers(spark, sf)["gold_features"]))


@query
def load_gold(spark, sf):
    path = tables.write_layer(gold(spark, sf), scratch_path(spark, "gold"))
    return tables.load_gold(spark, path).groupBy("denial_label", "risk_score").agg(F.count(F.lit(1)).alias("claims")).transform(
        ints, "denial_label", "risk_score")


@query
def read_text_docs(spark, sf):
    """Documents written as lines of text files, 500 to a file, read back file by file and cut into documents again."""
    docs = star.table(spark, sf, "documents")
    path = scratch_path(spark, "policies")
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " "))
    docs.select(line.alias("value")).write.option("compression", "none").option("maxRecordsPerFile", 500).text(path)
    lines = policies.read_text_docs(spark, path).select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    cut = F.split("line", "\t", 2)
    return lines.select(cut[0].cast("long").alias("doc_id"), F.length(cut[1]).cast("long").alias("characters"), F.md5(cut[1]).alias("text_md5"))


@query
def write_index(spark, sf):
    index, _ = _unwritten_index(spark, sf)
    path = scratch_path(spark, "index")
    policies.write_index(index, path)
    return policies.read_index(spark, path).select(
        "chunk_id", "source_file", F.md5("text").alias("text_md5"), "metadata.chunk_index", "metadata.total_chunks", "embedding").transform(
        lambda df: df.join(_vector_output(df, "chunk_id"), "chunk_id").drop("embedding"))


@query
def write_artifacts(spark, sf):
    """The medians read back, and whether the model, threshold and importances that were read back are those written."""
    t, path = _trained(spark, sf), scratch_path(spark, "model")
    artifacts.write_artifacts(spark, path, t.model, t.medians, t.threshold, t.best_f1, t.auc, train.feature_importance(t.model, spark))
    loaded = artifacts.read_artifacts(spark, path)
    rows = prepare.impute(_gold_table(spark, sf), t.medians)
    both = score.with_log_odds(rows, t.model).select("claim_id", F.col("log_odds").alias("a")).join(score.with_log_odds(rows, loaded.model), "claim_id")
    same = both.where(F.col("a") != F.col("log_odds")).isEmpty()
    gains = spark.read.json(f"{path}/feature_importance").agg(F.round(F.sum("importance"), 6)).first()[0]
    return spark.createDataFrame(
        [(k, v, same, loaded.threshold == t.threshold and 0.1 <= t.threshold <= 0.9, gains) for k, v in loaded.medians.items()],
        "feature string, median double, same_scores boolean, same_threshold boolean, importance_sum double")


@query
def append_history(spark, sf):
    """Two users' batches and two streams, read back row by row."""
    path = scratch_path(spark, "history")
    decided = decisions.decide_claims(_batch(spark, sf), rule_scorer)
    tables.append_history(serving.history_rows(decided, "clerk"), path)
    tables.append_history(serving.history_rows(decided, "admin"), path)
    for user in ("stream a", "stream b"):
        stream_score_claims(_stream(spark, sf), rule_scorer, path, scratch_path(spark, "stream-state"), user).awaitTermination()
    return tables.read_history(spark, path).select("username", "claim_id", "denial_probability", "risk_level", "is_denied", "flags")


@query
def read_claims_batch(spark, sf):
    batch = tables.read_claims_batch(spark, _raw_csv(spark, sf), RAW_CLAIMS)
    decided = decisions.decide_claims(batch, rule_scorer)
    return decided.select("claim_id", "patient_id", "probability", "risk_level", F.array_join("flags", "|").alias("flags"))


@query
def write_report(spark, sf):
    bronze = star.bronze(spark, sf)
    path = tables.write_report(quality.quality_report(bronze), scratch_path(spark, "quality-report"))
    detail = tables.write_report(profile.profile_report(bronze), scratch_path(spark, "profile-report"), ("table_order", "section", "position"))
    return spark.read.text([path, detail])


# --- projections, cleaning -----------------------------------------------------------------------------


@query
def normalize_columns(spark, sf):
    raw = star.raw_claims(spark, sf).select(F.col("claim_id").alias(" Claim ID "), F.col("billed_amount").alias("Billed Amount"))
    return clean.normalize_columns(raw)


@query
def dedup_keep_first(spark, sf):
    return clean.dedup_keep_first(star.raw_claims(spark, sf, patient=True, position=True))


@query
def cleaning_counts(spark, sf):
    return clean.cleaning_counts(star.raw_claims(spark, sf))


@query
def parse_date(spark, sf):
    return clean.parse_date(star.raw_claims(spark, sf).select("claim_id", "date")).withColumn("claim_date", F.to_date("claim_date"))


@query
def standardize_codes(spark, sf):
    return clean.standardize_codes(star.raw_claims(spark, sf)).select("claim_id", "diagnosis_code", "procedure_code")


@query
def strip_strings(spark, sf):
    return clean.strip_strings(star.raw_claims(spark, sf)).select("claim_id", "provider_id", "diagnosis_code", "procedure_code")


@query
def fill_unknown(spark, sf):
    return clean.fill_unknown(star.raw_providers(spark, sf)).select("provider_id", "location")


@query
def coerce_numeric(spark, sf):
    return clean.coerce_numeric(star.raw_part_cost(spark, sf))


@query
def clean_claims(spark, sf):
    return claims(spark, sf, patient=True).withColumn("claim_date", F.to_date("claim_date"))


@query
def clean_providers(spark, sf):
    return providers(spark, sf)


@query
def clean_diagnosis(spark, sf):
    return clean.clean_diagnosis(star.raw_part_diagnosis(spark, sf))


@query
def clean_cost(spark, sf):
    return clean.clean_cost(star.raw_part_cost(spark, sf))


def _gold_output(df):
    out = ints(df, "diagnosis_severity_flag", "missing_fields_count", "is_high_biller", "risk_score", "denial_label")
    return out.withColumn("claim_date", F.to_date("claim_date"))


@query
def gold_projection(spark, sf):
    wide = features.add_denial_label(features.add_claim_month(features.add_is_high_biller(features.add_missing_fields_count(
        features.add_claim_amount_ratio(validated(spark, sf))))))
    return features.gold_projection(wide).withColumn("claim_date", F.to_date("claim_date")).transform(
        ints, "missing_fields_count", "is_high_biller", "risk_score", "denial_label")


@query
def history_display(spark, sf):
    rows = star.history(spark, sf).withColumn("is_denied", F.col("is_denied") == 1).withColumnRenamed("username", "submitted_by")
    return kpi.history_display(rows, is_admin=True)


# --- rules ---------------------------------------------------------------------------------------------


def _flag_query(rule: rules.Rule) -> Query:
    def run(spark, sf):
        source = costed(spark, sf) if rule.flag == "flag_high_billing" else claims(spark, sf)
        return rules.add_flags(source, (rule,)).select("claim_id", rule.flag)

    return run


REGISTRY.update({rule.flag: _flag_query(rule) for rule in rules.BATCH_RULES})


@query
def validation_flags(spark, sf):
    return validated(spark, sf).select("claim_id", "validation_flags")


@query
def flagged_count(spark, sf):
    return rules.flagged_count(validated(spark, sf))


@query
def validation_summary(spark, sf):
    return rules.validation_summary(validated(spark, sf))


def _batch(spark, sf):
    """Submitted claims: the raw table, with blank codes and a strict flag."""
    raw = star.raw_claims(spark, sf)
    blank = F.when(F.col("procedure_code").isNull() & F.col("billed_amount").isNotNull(), "").otherwise(F.col("procedure_code"))
    return raw.select("claim_id", F.lit("P0").alias("patient_id"), "provider_id", "diagnosis_code", blank.alias("procedure_code"),
                      "billed_amount", (~F.col("claim_id").endswith("7")).alias("strict_mode"))


@query
def request_flags(spark, sf):
    return rules.request_flags(_batch(spark, sf)).select("claim_id", F.array_join("flags", "|").alias("flags"))


# --- joins ---------------------------------------------------------------------------------------------


@query
def enrich_providers(spark, sf):
    return enrich.enrich_providers(claims(spark, sf), providers(spark, sf)).select("claim_id", "provider_id", *enrich.PROVIDER_COLUMNS)


@query
def enrich_diagnosis(spark, sf):
    return enrich.enrich_diagnosis(claims(spark, sf), star.diagnosis(spark)).select("claim_id", "diagnosis_code", *enrich.DIAGNOSIS_COLUMNS)


@query
def enrich_cost(spark, sf):
    return costed(spark, sf).select("claim_id", "procedure_code", *enrich.COST_COLUMNS)


@query
def enrich_claims(spark, sf):
    return silver(spark, sf, patient=True).withColumn("claim_date", F.to_date("claim_date"))


@query
def join_claims_providers(spark, sf):
    stripped = clean.strip_strings(star.raw_claims(spark, sf))
    return kpi.join_claims_providers(stripped, star.raw_providers(spark, sf))


# --- aggregates ----------------------------------------------------------------------------------------


@query
def kpi_summary(spark, sf):
    return kpi.kpi_summary(star.raw_claims(spark, sf)).transform(rounded, 2, "total_billed_amount")


@query
def provider_activity_top10(spark, sf):
    return kpi.provider_activity(clean.strip_strings(star.raw_claims(spark, sf)), providers(spark, sf))


@query
def claims_trend(spark, sf):
    return kpi.claims_trend(star.raw_claims(spark, sf)).transform(rounded, 2, "billed_amount")


def _labelled(spark, sf):
    return features.add_denial_label(validated(spark, sf))


@query
def label_distribution(spark, sf):
    return features.label_distribution(_labelled(spark, sf))


@query
def class_balance(spark, sf):
    return prepare.class_balance(_labelled(spark, sf)).transform(rounded, 4, "denied_pct", "approved_pct")


@query
def scale_pos_weight(spark, sf):
    return prepare.scale_pos_weight(_labelled(spark, sf))


@query
def feature_medians(spark, sf):
    return prepare.feature_medians(stage(gold(spark, sf).select(*K.FEATURES), "features"))


@query
def profile_shape(spark, sf):
    return profile.profile_shape(star.table(spark, sf, "lineitem"), "lineitem")


@query
def profile_missing(spark, sf):
    return profile.profile_missing(star.raw_claims(spark, sf))


@query
def profile_duplicates(spark, sf):
    return profile.profile_duplicates(star.raw_claims(spark, sf))


@query
def profile_date_range(spark, sf):
    ranges = profile.profile_date_range(star.raw_claims(spark, sf).withColumn("Ship Date", F.to_date(F.try_to_timestamp("date", F.lit("yyyy-MM-dd")))))
    return ranges.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("min_date", "max_date")})


@query
def profile_cardinality(spark, sf):
    return profile.profile_cardinality(star.raw_claims(spark, sf))


@query
def profile_numeric(spark, sf):
    return profile.profile_numeric(star.table(spark, sf, "lineitem"))


PROFILED = ("customer", "part", "events", "documents", "pages", "benchmark", "conversations")


@query
def profile_all(spark, sf):
    bronze = {"bronze_claims": star.raw_claims(spark, sf), "bronze_providers": star.raw_providers(spark, sf)}
    found = profile.profile_all(bronze | {t: star.table(spark, sf, t) for t in PROFILED})
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("min_date", "max_date")})


@query
def quality_check(spark, sf):
    return quality.quality_check(star.raw_claims(spark, sf), "bronze_claims", K.EXPECTED_COLUMNS["bronze_claims"])


@query
def quality_summary(spark, sf):
    return quality.quality_summary({
        "bronze_claims": star.raw_claims(spark, sf),
        "bronze_providers": star.raw_providers(spark, sf),
        "bronze_cost": clean.coerce_numeric(star.raw_part_cost(spark, sf)),
    })


# --- windows, sorts ------------------------------------------------------------------------------------


@query
def provider_claim_count(spark, sf):
    rows = stage(validated(spark, sf), "validated")
    return features.add_provider_features(rows).select("claim_id", "provider_claim_count")


@query
def provider_denial_rate(spark, sf):
    rows = stage(validated(spark, sf), "validated")
    return features.add_provider_features(rows).select("claim_id", "provider_denial_rate")


@query
def history_latest(spark, sf):
    return kpi.history_latest(star.history(spark, sf), "", is_admin=True).drop("submitted_at")


@query
def history_latest_user(spark, sf):
    return kpi.history_latest(star.history(spark, sf), "user8").drop("submitted_at")


# --- features ------------------------------------------------------------------------------------------


@query
def claim_amount_ratio(spark, sf):
    return features.add_claim_amount_ratio(costed(spark, sf)).select("claim_id", "claim_amount_ratio")


@query
def diagnosis_severity_flag(spark, sf):
    rows = enrich.enrich_diagnosis(claims(spark, sf), star.diagnosis(spark))
    return features.add_diagnosis_severity_flag(rows).select("claim_id", "diagnosis_severity_flag").transform(ints, "diagnosis_severity_flag")


@query
def missing_fields_count(spark, sf):
    return features.add_missing_fields_count(claims(spark, sf)).select("claim_id", "missing_fields_count").transform(ints, "missing_fields_count")


@query
def is_high_biller(spark, sf):
    return features.add_is_high_biller(costed(spark, sf)).select("claim_id", "is_high_biller").transform(ints, "is_high_biller")


@query
def claim_month(spark, sf):
    return features.add_claim_month(claims(spark, sf)).select("claim_id", "claim_month")


@query
def provider_features(spark, sf):
    rows = features.provider_stats(validated(spark, sf))
    return rows


@query
def risk_score(spark, sf):
    return _labelled(spark, sf).select("claim_id", "risk_score").transform(ints, "risk_score")


@query
def denial_label(spark, sf):
    return _labelled(spark, sf).select("claim_id", "denial_label").transform(ints, "denial_label")


@query
def gold_features(spark, sf):
    full = rules.apply_validation_rules(silver(spark, sf, patient=True))
    return _gold_output(features.gold_features(stage(full, "validated")))


# --- text and vectors ------------------------------------------------------------------------------------


@query
def chunk_text(spark, sf):
    return chunking.chunk_text(star.documents(spark, sf)).select(
        "source_file", F.size("chunks").alias("n_chunks"), F.md5(F.array_join("chunks", "\n")).alias("chunks_md5"))


@query
def chunk_documents(spark, sf):
    return chunking.chunk_documents(star.documents(spark, sf)).select(
        "chunk_id", "source_file", "text", "metadata.chunk_index", "metadata.total_chunks")


def _unwritten_index(spark, sf):
    """Index of all documents for one reader, which writes it: vectors are made when it does."""
    return embed.build_index(stage(embed.with_buckets(chunking.chunk_documents(star.documents(spark, sf))), "chunks"))


def _build_lexical_index(spark, sf):
    index, model = _unwritten_index(spark, sf)
    return stage(index, "index"), model


# Where this process has written the index of a corpus, by application and data: made once, read by every retrieval.
_INDEXES: dict[tuple[str, str], tuple[str, embed.Embedder]] = {}


def _lexical_index(spark, sf):
    """Written index of all documents, its model and its postings."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES or not tables.path_exists(spark, f"{_INDEXES[key][0]}/postings/leading"):
        index, model = _unwritten_index(spark, sf)
        path = scratch_path(spark, "index")
        policies.write_index(index, f"{path}/chunks")
        drop_table(index)  # its chunks with their buckets, which only the writing has read
        inverted.write_postings(inverted.build_postings(policies.read_index(spark, f"{path}/chunks")), f"{path}/postings")
        _INDEXES[key] = (path, model)
    path, model = _INDEXES[key]
    return policies.read_index(spark, f"{path}/chunks"), model, inverted.read_postings(spark, f"{path}/postings")


def _vector_output(df, key):
    """A vector as its length, its weight along a ramp and its largest element."""
    ramp = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return df.select(key, F.size("embedding").alias("dim"), F.round(ramp, 3).alias("ramp"), F.round(F.array_max("embedding").cast("double"), 5).alias("largest"))


@query
def embed_text(spark, sf):
    docs = star.documents(spark, sf)
    return _vector_output(embed.embed(docs, embed.fit_embedder(docs)).where("embedding is not null"), "source_file")


@query
def build_index(spark, sf):
    return _vector_output(_build_lexical_index(spark, sf)[0], "chunk_id")


def _asked_vectors(spark, sf):
    """The stated query set: every vector whose id is divisible by 20."""
    return star.table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")


@query
def knn_l2(spark, sf):
    nearest = knn.knn_l2(star.table(spark, sf, "embeddings"), _asked_vectors(spark, sf), 10, id_col="vec_id")
    return nearest.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 4).alias("distance"), "rank")


@query
def cosine_from_l2_query(spark, sf):
    nearest = knn.knn_l2(star.table(spark, sf, "embeddings"), _asked_vectors(spark, sf), 3, id_col="vec_id")
    return nearest.select("query_id", F.col("id").alias("vec_id"), F.round(cosine_from_l2("distance"), 4).alias("cosine"))


REGISTRY["cosine_from_l2"] = REGISTRY.pop("cosine_from_l2_query")


@query
def topk_chunks(spark, sf):
    index, model, postings = _lexical_index(spark, sf)
    asked = embed.embed(retrieval.expand_flag_query(_all_flags(spark, sf)), model, "query")
    nearest = stage(inverted.search(postings, asked, 3, "flag", index), "neighbours")
    return knn.topk_chunks(index, nearest).select(
        "query_id", "rank", "chunk_id", "source_file", F.md5("text").alias("text_md5"), F.round("distance", 4).alias("distance"))


def _all_flags(spark, sf):
    """Flags that occur in the claims, and event types as flags nobody mapped."""
    known = retrieval.distinct_flags(validated(spark, sf))
    return known.union(star.table(spark, sf, "events").select(F.upper("event_type")).distinct())


@query
def expand_flag_query(spark, sf):
    return retrieval.expand_flag_query(_all_flags(spark, sf))


def _retrieved_lexical(spark, sf, top_k):
    index, model, postings = _lexical_index(spark, sf)
    return retrieval.retrieve_multiple(_all_flags(spark, sf), index, model, top_k, postings)


@query
def retrieve(spark, sf):
    return _retrieved_lexical(spark, sf, 3).select(
        "flag", "query", F.size("chunks").alias("n_chunks"), F.array_join("chunks.chunk_id", ",").alias("chunk_ids"), "source_file",
        F.md5("top_text").alias("text_md5"), "found")


@query
def retrieve_multiple(spark, sf):
    found = _retrieved_lexical(spark, sf, 1)
    return found.select("flag", "source_file", F.round(F.col("chunks")[0]["distance"], 4).alias("distance"), "found")


def _retrieved(spark, sf):
    """Best chunk of the whole corpus for every flag of the rules."""
    flags = spark.createDataFrame([(label,) for _, label, _ in K.RULES], "flag string")
    index, model, postings = _lexical_index(spark, sf)
    return retrieval.retrieve_multiple(flags, index, model, 1, postings)


# --- model ---------------------------------------------------------------------------------------------


# Where this process has written its gold table, and the model tuned and trained on it, by application and data.
_MODELS: dict[tuple[str, str], tuple[str, training.Trained]] = {}


def _shared(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS or not tables.path_exists(spark, _MODELS[key][0]):
        path = tables.write_layer(gold(spark, sf), scratch_path(spark, "gold"))
        _MODELS[key] = (path, training.train_model(spark.read.parquet(path)))
    return _MODELS[key]


def _trained(spark, sf):
    return _shared(spark, sf)[1]


def _gold_table(spark, sf):
    return spark.read.parquet(_shared(spark, sf)[0])


@query
def prepare_features(spark, sf):
    return prepare.prepare_features(stage(gold(spark, sf), "gold"))


@query
def stratified_split(spark, sf):
    labelled = stage(_labelled(spark, sf).select("claim_id", F.col("denial_label").cast("int").alias("denial_label")), "labelled")
    return prepare.stratified_split(labelled)


def _in_ranges():
    spans = {"max_depth": (3, 6), "step_size": (0.01, 0.2), "trees": train.TREES, "row_share": (0.6, 1.0), "column_share": (0.6, 1.0)}
    return F.array_min(F.array(*[F.col(c).between(*span) for c, span in spans.items()]))


@query
def tune_random_cv(spark, sf):
    """Of each trial whether its settings are in the established ranges and whether it learned: AUC over held-out folds above 0.85."""
    return _trained(spark, sf).trials.select("trial", _in_ranges().alias("in_ranges"), F.col("mean_auc").between(0.85, 1.0).alias("learned"))


@query
def train_gbt(spark, sf):
    """The tuned model: its settings are the best trial's, its threshold the best on the training scores, its AUC that of the test part."""
    t = _trained(spark, sf)
    best = t.trials.orderBy(F.desc("mean_auc"), "trial").first()
    same = train.settings_of(best) == t.settings and len(t.model.feature) == best["trees"]
    return spark.createDataFrame([(same, 0.10 <= t.threshold <= 0.90, 0.8 < t.best_f1 <= 1.0, 0.85 < t.auc <= 1.0)], "tuned boolean, threshold_in_range boolean, f1_in_range boolean, auc_in_range boolean")


def _rule_scores(spark, sf):
    """Labels with a score that is no model: risk score and provider rate, scaled to at most one."""
    return gold(spark, sf).select(
        F.col("denial_label").cast("int").alias("label"),
        ((F.col("risk_score") + F.col("provider_denial_rate")) / 12.0).alias("score"))


@query
def score_auc(spark, sf):
    return evaluate.score_auc(_rule_scores(spark, sf)).transform(rounded, 6, "auc")


@query
def best_f1_threshold(spark, sf):
    return evaluate.best_f1_threshold(_rule_scores(spark, sf)).transform(rounded, 6, "best_f1")


@query
def classification_report(spark, sf):
    predicted = _rule_scores(spark, sf).withColumn("prediction", (F.col("score") >= 0.37).cast("int"))
    return evaluate.classification_report(predicted).transform(rounded, 6, "precision", "recall", "f1_score")


@query
def feature_importance(spark, sf):
    """Every feature with whether its share is one, and what all shares sum to."""
    shares = train.feature_importance(_trained(spark, sf).model, spark)
    total = shares.agg(F.round(F.sum("importance"), 6)).first()[0]
    return shares.select("feature", F.col("importance").between(0, 1).alias("in_range"), F.lit(total).alias("total"))


@query
def importance_sorted(spark, sf):
    """The shares in ascending order: each place with whether it holds at least the share of the place before."""
    rows = train.importance_sorted(train.feature_importance(_trained(spark, sf).model, spark), ascending=True).collect()
    shares = [r["importance"] for r in rows]
    return spark.createDataFrame([(i + 1, i == 0 or shares[i - 1] <= x, r["feature"] in K.FEATURES) for i, (x, r) in enumerate(zip(shares, rows))], "place int, in_order boolean, known boolean")


@query
def score_claims(spark, sf):
    """Every claim with its threshold's label and level worked out again from the model's own probability."""
    t = _trained(spark, sf)
    gold = _gold_table(spark, sf)
    raw = score.with_log_odds(prepare.impute(gold, t.medians), t.model).select("claim_id", "raw_probability")
    scored = score.score_claims(gold, t.model, t.medians, t.threshold).select("claim_id", "probability", "predicted_label", "risk_level", "threshold")
    p = F.col("raw_probability")
    level = F.when(p < 0.4, "LOW").when(p < 0.7, "MEDIUM").otherwise("HIGH")
    return scored.join(raw, "claim_id").select(
        "claim_id", F.col("probability").between(0, 1).alias("in_range"), (F.abs(F.col("probability") - p) <= 5.0001e-5).alias("rounded"),
        (F.col("predicted_label") == (p >= t.threshold).cast("int")).alias("label_fits"), (F.col("risk_level") == level).alias("level_fits"),
        (F.col("threshold") == t.threshold).alias("threshold_fits"))


@query
def risk_level(spark, sf):
    scored = gold(spark, sf).select("claim_id", ((F.col("risk_score") * 2 + F.col("provider_denial_rate")) / 12.0).alias("raw_probability"))
    return serving.decide(scored, 0.37).select("claim_id", "probability", "predicted_label", "risk_level", "threshold")


@query
def attribute_claims(spark, sf):
    """Seven ranked features of every claim."""
    t = _trained(spark, sf)
    return score.attribute_claims(_gold_table(spark, sf), t.model, t.medians)


@query
def attribution_sorted(spark, sf):
    """Per claim whether its features are ranked by size and add up to its log-odds above the expected ones."""
    t = _trained(spark, sf)
    gold = _gold_table(spark, sf)
    scored = score.with_log_odds(prepare.impute(gold, t.medians), t.model).select("claim_id", "log_odds")
    ranked = score.attribute_claims(gold, t.model, t.medians).groupBy("claim_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "shap_value"))).alias("x"))
    sizes = F.transform("x", lambda e: F.abs(e["shap_value"]))
    total = F.aggregate("x", F.lit(0.0), lambda n, e: n + e["shap_value"])
    return ranked.join(scored, "claim_id").select(
        "claim_id", F.size("x").alias("features"), (F.col("x.rank") == F.sequence(F.lit(1), F.lit(7))).alias("ranked"),
        (sizes == F.sort_array(sizes, asc=False)).alias("in_order"), (F.abs(total - (F.col("log_odds") - t.model.expected)) < 1e-3).alias("adds_up"))


@query
def explanation_text(spark, sf):
    """Sentences for a given attribution: the weights of the rules that fired, and the amount ratio."""
    rows = features.add_missing_fields_count(features.add_claim_amount_ratio(validated(spark, sf)))
    given = F.array(
        F.struct(F.lit(1).alias("rank"), F.lit("missing_fields_count").alias("feature_name"), F.col("missing_fields_count").cast("double").alias("feature_value"),
                 (F.col("missing_fields_count") * 0.25 - 0.25).alias("shap_value")),
        F.struct(F.lit(2).alias("rank"), F.lit("claim_amount_ratio").alias("feature_name"), py_round(F.coalesce("claim_amount_ratio", F.lit(1.0)), 4).alias("feature_value"),
                 py_round(F.coalesce("claim_amount_ratio", F.lit(1.0)) / 10 - 0.2, 4).alias("shap_value")),
    )
    labels = F.create_map(*[F.lit(x) for pair in K.FEATURE_LABELS.items() for x in pair])
    attributed = rows.select("claim_id", F.inline(given)).withColumns({
        "feature_label": F.element_at(labels, F.col("feature_name")),
        "direction": F.when(F.col("shap_value") > 0, "INCREASES_RISK").otherwise("REDUCES_RISK"),
    })
    return score.explanation_text(attributed)


# --- decisions and remediation ---------------------------------------------------------------------------


def rule_scorer(df):
    """A score without a model, for results that plain SQL can check."""
    raw = (F.col("missing_fields_count") + F.col("is_high_biller") * 2 + F.coalesce("provider_denial_rate", F.lit(0.1))) / 8.0
    return serving.decide(df.withColumn("raw_probability", raw), 0.37)


@query
def serving_features(spark, sf):
    return serving.serving_features(_batch(spark, sf)).select("claim_id", *K.FEATURES)


@query
def strict_override(spark, sf):
    scored = rule_scorer(serving.serving_features(_batch(spark, sf)))
    return serving.strict_override(scored).select("claim_id", "probability", "predicted_label", "risk_level")


@query
def canned_contributions(spark, sf):
    decided = decisions.decide_claims(_batch(spark, sf), rule_scorer)
    return decided.select("claim_id", F.array_join(F.transform(
        "feature_contributions", lambda c: F.concat_ws("/", c["feature"], c["score"], c["suggestion"])), "; ").alias("contributions"))


def _flagged(spark, sf):
    """Claims with their flags as an array, as a written table."""
    return stage(_with_flags(spark, sf), "flagged")


def _with_flags(spark, sf):
    return validated(spark, sf).select("claim_id", F.filter(F.split("validation_flags", r"\|"), lambda f: f != "").alias("flags"))


def _report_output(df):
    return df.select(
        "claim_id", F.size("flags").alias("n_flags"), F.array_join("sources", ",").alias("sources"),
        F.length("full_report").alias("report_length"), F.md5("full_report").alias("report_md5"))


@query
def action_steps(spark, sf):
    return _with_flags(spark, sf).select("claim_id", F.md5(remediate.action_steps("flags")).alias("steps_md5"))


@query
def rag_evidence(spark, sf):
    return remediate.rag_evidence(_retrieved(spark, sf)).select("evidence.*", F.md5("block").alias("block_md5"))


@query
def remediation_plan(spark, sf):
    return _report_output(remediate.remediation_plan(_flagged(spark, sf), _retrieved(spark, sf)))


@query
def plan_sources(spark, sf):
    plans = remediate.remediation_plan(_flagged(spark, sf), _retrieved(spark, sf))
    return plans.select("claim_id", F.explode("sources").alias("source_file"))


@query
def fallback_plan(spark, sf):
    return _report_output(remediate.fallback_plan(_flagged(spark, sf)))


def _decision_output(df):
    return df.select(
        "claim_id", "probability", "predicted_label", "risk_level", F.array_join("flags", "|").alias("flags"),
        F.size("feature_contributions").alias("n_contributions"), F.array_join("sources", ",").alias("sources"),
        F.md5("full_report").alias("report_md5"))


@query
def evaluate_claims(spark, sf):
    return _decision_output(decisions.evaluate_claims(_batch(spark, sf), rule_scorer, _retrieved(spark, sf)))


@query
def evaluate_claims_model(spark, sf):
    """Decisions by a model directory and an index that were written before and are loaded here."""
    t, path = _trained(spark, sf), scratch_path(spark, "model")
    artifacts.write_artifacts(spark, path, t.model, t.medians, t.threshold, t.best_f1, t.auc, train.feature_importance(t.model, spark))
    scorer = decisions.model_scorer(artifacts.read_artifacts(spark, path))
    return _decision_output(decisions.evaluate_claims(_batch(spark, sf), scorer, _retrieved(spark, sf)))


def _stream(spark, sf):
    schema = star.table(spark, sf, "lineitem").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    return star.lines_to_claims(lines).withColumn("patient_id", F.lit("P0"))


@query
def stream_claims(spark, sf):
    """Order lines read as a stream, scored in micro-batches and read back from the history."""
    path = scratch_path(spark, "history")
    stream_score_claims(_stream(spark, sf), rule_scorer, path, scratch_path(spark, "stream-state")).awaitTermination()
    return tables.read_history(spark, path).select("claim_id", "username", "denial_probability", "risk_level", "is_denied", "flags")


REGISTRY["stream_score_claims"] = REGISTRY.pop("stream_claims")


# --- provider audits -------------------------------------------------------------------------------------


@query
def provider_tier(spark, sf):
    return audit.provider_tier(validated(spark, sf)).transform(rounded, 9, "denial_rate")


@query
def audit_trigger(spark, sf):
    return audit.audit_trigger(validated(spark, sf))


@query
def high_billing_notice(spark, sf):
    return audit.high_billing_notice(validated(spark, sf)).transform(rounded, 9, "high_billing_rate")


@query
def high_volume_provider(spark, sf):
    return audit.high_volume_provider(validated(spark, sf))


# --- announced checks ------------------------------------------------------------------------------------


@query
def schema_check(spark, sf):
    return quality.schema_check(star.raw_claims(spark, sf), "bronze_claims", RAW_CLAIMS)


@query
def join_null_check(spark, sf):
    lookups = {"doctor_name": "provider_id", "category": "diagnosis_code", "expected_cost": "procedure_code"}
    return quality.join_null_check(silver(spark, sf), lookups)


@query
def all_null_check(spark, sf):
    return quality.all_null_check(gold(spark, sf))


# --- approximate search ------------------------------------------------------------------------------------


def _cells(spark, sf):
    """Cell index of all vectors, and the number of cells that a bounded sample of the queries needs for 95 %."""
    vectors = star.table(spark, sf, "embeddings")
    index = cells.read_cells(spark, cells.write_cells(vectors, scratch_path(spark, "cells"), id_col="vec_id"))
    return index, cells.choose_probes(index, vectors, _asked_vectors(spark, sf), 10, 0.95, "vec_id")


@query
def knn_cells(spark, sf):
    """The ten nearest vectors of each query in the cells nearest to it."""
    index, probes = _cells(spark, sf)
    found = cells.search(index, _asked_vectors(spark, sf), 10, probes)
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 4).alias("distance"), "rank")


@query
def knn_cells_recall(spark, sf):
    """Whether the cells give nine of ten true neighbours, measured over the whole query set."""
    index, probes = _cells(spark, sf)
    asked = _asked_vectors(spark, sf)
    exact = knn.knn_l2(star.table(spark, sf, "embeddings"), asked, 10, id_col="vec_id")
    return cells.recall(cells.search(index, asked, 10, probes), exact).select("neighbours", (F.col("recall") >= 0.9).alias("reached"))


# --- growing tables ----------------------------------------------------------------------------------------


def _claim_batches(spark, sf):
    """Raw claims in three deliveries of like size, in the order of the source, whatever the number of its files."""
    raw = stage(star.raw_claims(spark, sf, patient=True, position=True), "deliveries")
    # a place counts rows within a file only, so the cuts are found among the places and the ends are open
    cuts = raw.approxQuantile("source_position", [1 / 3, 2 / 3], 0.001) or [0.0, 0.0]
    place = F.col("source_position")
    return [raw.where(place < cuts[0]), raw.where((place >= cuts[0]) & (place < cuts[1])), raw.where(place >= cuts[1])]


@query
def upsert_silver(spark, sf):
    """Clean claims delivered in three batches, the second twice: the table of a rebuild over all of them."""
    path = scratch_path(spark, "upsert")
    first, second, third = (clean.clean_claims(b) for b in _claim_batches(spark, sf))
    changed = [upsert.upsert_layer(df, path, name) for df, name in ((first, "a"), (second, "b"), (second, "b"), (third, "c"), (first, "a"))]
    if changed != [True, True, False, True, False]:
        raise AssertionError(f"replayed batches changed the table: {changed}")
    return upsert.read_upserted(spark, path).withColumn("claim_date", F.to_date("claim_date"))


@query
def quarantine_csv(spark, sf):
    """Raw claims as CSV lines, some cut off, some with a further field, some with an amount that is no number."""
    path = scratch_path(spark, "raw") + "/claims.csv"
    names = RAW_CLAIMS.names
    raw = star.raw_claims(spark, sf, patient=True).select(*names)
    key = F.regexp_replace("claim_id", r"\D", "").cast("long")
    amount = F.when(key % 97 == 3, F.lit("n/a")).otherwise(F.col("billed_amount").cast("string"))
    line = F.concat_ws(",", *[F.coalesce(amount if c == "billed_amount" else F.col(c), F.lit("")) for c in names])
    line = F.when(key % 89 == 1, F.regexp_replace(line, ",[^,]*$", "")).when(key % 83 == 2, F.concat(line, F.lit(",more"))).otherwise(line)
    raw.select(line.alias(",".join(names))).write.option("sep", "\u0001").option("quote", "\u0000").option("header", True).csv(path)
    good, bad = quarantine.read_with_quarantine(spark, path, RAW_CLAIMS)
    return good.select(F.lit("good").alias("kind"), "claim_id", "billed_amount", "date", F.lit(None).cast("string").alias("line"), F.lit(None).cast("int").alias("n_fields")).unionByName(
        bad.select(F.lit("rejected").alias("kind"), F.lit(None).cast("string").alias("claim_id"), F.lit(None).cast("double").alias("billed_amount"),
                   F.lit(None).cast("string").alias("date"), "line", "n_fields"))


@query
def stream_audit_trigger(spark, sf):
    """Validated claims delivered in five slices of time, judged as a stream: the last outcome of every provider."""
    rows = stage(validated(spark, sf).select("provider_id", "claim_date", "validation_flags", "billed_amount", "expected_cost"), "validated")
    folder, day = scratch_path(spark, "deliveries"), F.unix_date(F.to_date("claim_date"))
    edges = rows.select(day.cast("double").alias("day")).approxQuantile("day", [0.2, 0.4, 0.6, 0.8], 0.01)
    slices = [float("-inf"), *edges, float("inf")]
    path, state, stream = scratch_path(spark, "audits"), scratch_path(spark, "stream-state"), None
    for low, high in zip(slices, slices[1:]):
        some = (day > low) & (day <= high)
        rows.where(some if low != slices[0] else some | day.isNull()).write.mode("append").parquet(folder)
        # a delivery has as many files as tasks wrote it; the stream goes on where it stopped and takes them as one micro-batch
        stream = stream or spark.readStream.schema(rows.schema).parquet(folder)
        audits.write_audit_triggers(stream, path, state).awaitTermination()
    return audits.latest_audit_triggers(spark, path).drop("open_days")


@query
def profile_sketches(spark, sf):
    """Order lines profiled in three partitions and merged: exact counts and extremes, and whether the estimates keep their bounds."""
    lines, path = star.table(spark, sf, "lineitem"), scratch_path(spark, "profiles")
    for k in range(3):
        sketches.write_partition_profile(lines.where(F.col("l_orderkey") % 3 == k), path, str(k))
    merged = stage(sketches.merged_profile(spark, path), "merged")
    spans = sketches.rank_span(lines, merged.select("column_name", *sketches.QUARTILES))
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in sketches.QUARTILES.items() for x in pair]), F.col("name"))
    ranks = spans.groupBy("column_name").agg(F.bool_and((F.col("below") <= wanted + 0.01) & (F.col("upto") >= wanted - 0.01)).alias("ranks_fit"))
    numbers = profile.numeric_columns(lines)
    true = lines.agg(*[F.struct(F.lit(c).alias("column_name"), F.avg(F.col(c).cast("double")).alias("true_mean"), F.stddev_samp(F.col(c).cast("double")).alias("true_std")).alias(c) for c in numbers])
    true = true.select(F.inline(F.array(*numbers)))
    exact = profile.distinct_counts(lines).join(true, "column_name", "left")
    near = {c: F.abs(F.col(c) - F.col(f"true_{c}")) <= 1e-9 * (1 + F.abs(F.col(f"true_{c}"))) for c in ("mean", "std")}
    fits = F.abs(F.col("distinct_estimate") - F.col("distinct_values")) <= F.greatest(F.lit(1.0), 0.04 * F.col("distinct_values"))
    return merged.join(exact, "column_name").join(ranks, "column_name", "left").select(
        "column_name", "rows", "missing", "min", "max", near["mean"].alias("mean_fits"), near["std"].alias("std_fits"), fits.alias("distinct_fits"), "ranks_fit")


@query
def read_marked_docs(spark, sf):
    """All documents in large text files, one for each task that writes, read by splits."""
    docs = star.table(spark, sf, "documents").select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("text"))
    path = documents.write_marked_docs(docs, scratch_path(spark, "marked"))
    found, cut = documents.read_marked_docs(spark, path), F.split("text", "\t", 2)
    return found.select(cut[0].cast("long").alias("doc_id"), F.length(cut[1]).cast("long").alias("characters"), F.md5(cut[1]).alias("text_md5"))


def _dated_costs(spark, sf):
    """Costs of procedures that change from day to day: one row per part."""
    return star.table(spark, sf, "part").select(
        F.concat(F.lit("PROC"), 1 + F.col("p_partkey") % 6).alias("procedure_code"), F.date_add(F.lit("1992-01-01").cast("date"), (F.col("p_partkey") * 37 % 2500).cast("int")).alias("valid_from"),
        F.col("p_retailprice").alias("dated_cost"))


@query
def cost_valid_on(spark, sf):
    """Claims with the cost that was valid on their day."""
    rows = claims(spark, sf).select("claim_id", "procedure_code", "claim_date")
    return validity.valid_on(rows, _dated_costs(spark, sf), "procedure_code", ["dated_cost"]).withColumn("claim_date", F.to_date("claim_date"))


@query
def layer_problems(spark, sf):
    """What the checks of all layers announce when claims come without a patient."""
    return spark.read.parquet(_layers(spark, sf, patient=False, strict=False)["layer_problems"])
