"""Audit triggers over a stream of claims: keyed state of the last days, a watermark, and counts of late rows.

Per provider the state holds one row of sums for each day that is still open or inside the longest window before it. A day
closes when the watermark passes it: its windows are then judged for good, and their outcome is kept as flags. Open days are
judged anew with every batch, so the last output of a provider always tells what a batch query over all rows but the late
ones would. A row whose day has closed is late: it is counted and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as K
from ..operators.audit import _has

DAY_MS = 86_400_000
SUMS = ("claims", "flagged", "high", "incomplete")
_STATE = "days array<int>, sums array<array<long>>, rate boolean, high boolean, incomplete boolean, cost boolean, late long"
_OUT = ("provider_id string, denial_rate_90d boolean, high_billing_30d boolean, incomplete_30d boolean, single_claim boolean, triggered boolean, "
        "late_rows long, open_days int")


def judge(days: np.ndarray, sums: np.ndarray, judged: np.ndarray) -> tuple[bool, bool, bool]:
    """Whether any window that ends at a judged day breaks a limit: share of flagged claims, high billings, incomplete claims.

    ``days`` ascend, ``sums`` has a row of SUMS for each.
    """
    total = np.vstack([np.zeros(len(SUMS), np.int64), np.cumsum(sums, axis=0)])
    end = np.arange(1, len(days) + 1)

    def last(length: int) -> np.ndarray:
        return total[end] - total[np.searchsorted(days, days - (length - 1), "left")]

    long, short = last(K.AUDIT_RATE_DAYS), last(K.AUDIT_COUNT_DAYS)
    share = long[:, 1] / np.maximum(1, long[:, 0])
    found = share > K.AUDIT_HIGH_RATE, short[:, 2] > K.AUDIT_HIGH_BILLINGS, short[:, 3] > K.AUDIT_INCOMPLETE
    return tuple(bool((f & judged).any()) for f in found)


def advance(state: tuple | None, rows: pd.DataFrame, closed: int | None) -> tuple[tuple, tuple]:
    """New state and outcome of a provider after rows (day, claims, ..., cost); days up to ``closed`` are closed for them."""
    days, sums, rate, high, incomplete, cost, late = state or ([], [], False, False, False, False, 0)
    table = {d: np.array(s, np.int64) for d, s in zip(days, sums)}
    cost = bool(cost or rows["cost"].any())
    dated = rows[rows["day"].notna()]
    is_late = dated["day"] <= closed if closed is not None else dated["day"] != dated["day"]
    late += int(dated.loc[is_late, "claims"].sum())
    for row in dated[~is_late].itertuples(index=False):
        table[int(row.day)] = table.get(int(row.day), np.zeros(len(SUMS), np.int64)) + np.array([getattr(row, c) for c in SUMS], np.int64)
    order = np.array(sorted(table), np.int64)
    values = np.array([table[d] for d in order], np.int64).reshape(-1, len(SUMS))
    now = judge(order, values, np.ones(len(order), bool)) if len(order) else (False, False, False)
    outcome = (rate or now[0], high or now[1], incomplete or now[2], cost)
    if closed is not None and len(order):
        done = judge(order, values, order <= closed)
        rate, high, incomplete = rate or done[0], high or done[1], incomplete or done[2]
        kept = order > closed - (K.AUDIT_RATE_DAYS - 1)
        order, values = order[kept], values[kept]
    open_days = int((order > closed).sum()) if closed is not None else len(order)
    return ([int(d) for d in order], values.tolist(), rate, high, incomplete, cost, late), (*outcome, any(outcome), late, open_days)


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.getCurrentWatermarkMs()
    # the watermark itself is still on time; before the first one nothing is late
    closed = now // DAY_MS - 1 if now > 0 else None
    held, outcome = (state.get if state.exists else None), None
    for rows in frames:
        held, outcome = advance(held, rows, closed)
    if outcome is not None:
        state.update(held)
        yield pd.DataFrame([(key[0], *outcome)], columns=[c.split()[0] for c in _OUT.split(", ")])


def stream_audit_triggers(claims: DataFrame, delay_days: int = 30) -> DataFrame:
    """A stream of outcomes per provider: the columns of the batch query, late rows so far and days that are still open.

    ``claims`` is a streaming table of validated claims (provider_id, claim_date, validation_flags, billed_amount,
    expected_cost). Claims without a provider are left out; one without a date has no window, as in the batch. To be written in update
    mode; the last row of a provider counts. A day stays open for ``delay_days`` after the newest claim of earlier batches.
    """
    multiple = F.when(F.col("expected_cost") > 0, F.col("billed_amount") / F.col("expected_cost"))
    # claims without a date have no event time; they carry the earliest, which is never late by Spark's own account
    rows = claims.where("provider_id is not null").select(
        "provider_id", F.unix_date(F.to_date("claim_date")).alias("day"), F.lit(1).cast("long").alias("claims"), (F.col("validation_flags") != "").cast("long").alias("flagged"),
        _has("WARN_HIGH_BILLING").cast("long").alias("high"), _has("ERR_INCOMPLETE_CLAIM").cast("long").alias("incomplete"),
        F.coalesce(multiple > K.AUDIT_COST_MULTIPLE, F.lit(False)).alias("cost"), F.to_timestamp("claim_date").alias("event_time"),
    ).withWatermark("event_time", f"{delay_days} days")
    return rows.groupBy("provider_id").applyInPandasWithState(_update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def write_audit_triggers(claims: DataFrame, path: str, checkpoint: str, delay_days: int = 30, available_now: bool = True) -> StreamingQuery:
    """Write the outcomes of each micro-batch to its own folder; a batch that is replayed overwrites it."""

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream_audit_triggers(claims, delay_days).writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_audit_triggers(spark: SparkSession, path: str) -> DataFrame:
    """The last outcome of every provider."""
    outcomes = spark.read.schema(f"{_OUT}, batch_id long").parquet(path)
    names = [c for c in outcomes.columns if c not in ("provider_id", "batch_id")]
    return outcomes.groupBy("provider_id").agg(F.max_by(F.struct(*names), "batch_id").alias("x")).select("provider_id", "x.*")
