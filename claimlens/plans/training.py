"""Gold table to model directory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..ml import evaluate, prepare, train
from ..ml.boost import Settings
from ..ml.forest import Forest
from ..ml.score import with_log_odds
from ..session import stage
from ..sources.artifacts import write_artifacts


@dataclass(frozen=True)
class Trained:
    model: Forest
    settings: Settings
    medians: dict[str, float]
    threshold: float
    best_f1: float
    auc: float
    report: DataFrame
    trials: DataFrame | None  # the search, if there was one


def with_score(prepared: DataFrame, model: Forest) -> DataFrame:
    return with_log_odds(prepared, model).select(F.col(K.TARGET).alias("label"), F.col("raw_probability").alias("score"))


def train_model(
    gold: DataFrame, out_dir: str | None = None, settings: Settings | None = None, trials: int = 10, **tuning
) -> Trained:
    """Impute, split, tune, fit, choose the threshold on training scores, test and save.

    ``settings`` skips the tuning; else the final model has the settings of the best trial.
    """
    spark = gold.sparkSession
    medians = prepare.medians_dict(prepare.feature_medians(gold))
    prepared = stage(prepare.prepare_features(gold, medians), "prepared")
    split = stage(prepare.stratified_split(prepared), "split")
    fit_rows, test_rows = split.where(~F.col("is_test")), split.where("is_test")
    found = None
    if settings is None:
        settings, found = train.tune_random_cv(fit_rows, trials=trials, **tuning)
    model = train.train_gbt(fit_rows, settings)
    best = evaluate.best_f1_threshold(with_score(fit_rows, model)).first()
    tested = stage(with_score(test_rows, model), "test-scores")
    auc = evaluate.score_auc(tested).first()["auc"]
    predicted = tested.withColumn("prediction", (F.col("score") >= best["best_threshold"]).cast("int"))
    trained = Trained(model, settings, medians, best["best_threshold"], best["best_f1"], auc, evaluate.classification_report(predicted), found)
    if out_dir:
        write_artifacts(spark, out_dir, model, medians, trained.threshold, trained.best_f1, auc,
                        train.feature_importance(model, spark))
    return trained
