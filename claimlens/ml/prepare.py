"""Model inputs: medians, imputation, split and folds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.quantiles import exact_quantiles
from ..session import stage


def feature_medians(gold: DataFrame, approx: bool = False) -> DataFrame:
    """Rows ``(feature, median)`` ignoring nulls; exact and interpolated unless ``approx``."""
    if approx:
        one = gold.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5).alias(c) for c in K.FEATURES])
        return one.unpivot([], list(K.FEATURES), "feature", "median")
    medians = exact_quantiles(gold, K.FEATURES, (0.5,))
    return medians.select(F.col("column_name").alias("feature"), F.col("value").alias("median"))


def medians_dict(medians: DataFrame) -> dict[str, float]:
    """The medians as numbers on the driver: one per feature that has values."""
    return {r["feature"]: r["median"] for r in medians.collect() if r["median"] is not None}


def impute(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """Every feature as double; null or absent becomes the median, 0.0 if that is unknown."""
    def filled(c):
        default = F.lit(float(medians.get(c, 0.0)))
        return F.coalesce(F.col(c).cast("double"), default) if c in df.columns else default

    return df.withColumns({c: filled(c) for c in K.FEATURES})


def prepare_features(gold: DataFrame, medians: Mapping[str, float] | None = None, keep: tuple[str, ...] = ("claim_id",)) -> DataFrame:
    """The seven imputed features and the target, with ``keep`` columns in front.

    By default the medians come from the whole table, before any split.
    """
    medians = medians_dict(feature_medians(gold)) if medians is None else medians
    present = [c for c in keep if c in gold.columns]
    return impute(gold, medians).select(*present, *K.FEATURES, F.col(K.TARGET).cast("int").alias(K.TARGET))


def class_balance(gold: DataFrame) -> DataFrame:
    denied = F.avg(F.col(K.TARGET).cast("int")) * 100
    return gold.agg(denied.alias("denied_pct"), (100 - denied).alias("approved_pct"))


def scale_pos_weight(gold: DataFrame) -> DataFrame:
    """Negatives per positive, 1.0 without positives."""
    pos, neg = F.count_if(F.col(K.TARGET) == 1), F.count_if(F.col(K.TARGET) == 0)
    weight = F.when(pos > 0, neg.cast("double") / F.nullif(pos, F.lit(0))).otherwise(1.0)
    return gold.agg(neg.alias("negatives"), pos.alias("positives"), weight.alias("scale_pos_weight"))


def stratified_split(
    df: DataFrame, label: str = K.TARGET, key: str = "claim_id", test_share: float = K.TEST_SHARE
) -> DataFrame:
    """Adds ``is_test`` for an exact share of every label, chosen by the hash order of the key.

    Ranking a whole label would put half the table into one task. Instead rows are counted per label
    and leading 16 hash bits; that locates the bucket in which the quota is reached. Buckets before
    it are test rows, buckets after it training rows, and only the bucket itself is ranked. ``df`` is
    read three times and should be a written table.
    """
    digest = F.md5(F.col(key).cast("string"))
    df = df.withColumn("_bucket", F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"))
    counted = df.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_bucket = Window.partitionBy(label).orderBy("_bucket")
    quota = F.floor(F.sum("_n").over(Window.partitionBy(label)) * test_share + 0.5)
    edge = (
        counted.withColumn("_end", F.sum("_n").over(by_bucket)).withColumn("_quota", quota)
        .where((F.col("_end") >= F.col("_quota")) & (F.col("_end") - F.col("_n") < F.col("_quota")))
        .select(label, F.col("_bucket").alias("_edge"), (F.col("_quota") - F.col("_end") + F.col("_n")).alias("_take"))
    )
    # one row per label
    edge = F.broadcast(stage(edge, "split-edges"))
    placed = df.join(edge, label, "left")
    at_edge = F.coalesce(F.col("_bucket") == F.col("_edge"), F.lit(False))
    clear = placed.where(~at_edge).withColumn("is_test", F.coalesce(F.col("_bucket") < F.col("_edge"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(digest, key))
    ranked = placed.where(at_edge).withColumn("is_test", rank <= F.col("_take"))
    return clear.unionByName(ranked).drop("_bucket", "_edge", "_take")


def add_fold(df: DataFrame, label: str = K.TARGET, key: str = "claim_id", folds: int = 3) -> DataFrame:
    """Cross-validation folds with like shares of every label: rows take turns by the hash order of their key.

    Turns are counted within (label, leading 12 hash bits), a group far smaller than a label, and start at another fold
    in each. A fold's share of a label differs from the others' by at most one row per group.
    """
    digest = F.md5(F.col(key).cast("string"))
    bucket = F.conv(F.substring(digest, 9, 3), 16, 10).cast("long")
    turn = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy(digest, key))
    return df.withColumn("_bucket", bucket).withColumn("fold", F.pmod(turn + F.col("_bucket"), F.lit(folds)).cast("int")).drop("_bucket")
