"""Exact interpolated quantiles of many columns that stay distributed on very large tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import stage

# Half width of the rank bracket that a sketch draws around a quantile; above the sketch's rank error, one in _ACCURACY.
_MARGIN = 0.0002
_ACCURACY = 10_000
# Distinct values in a bracket that are ranked one by one. A larger bracket is first cut at _CUTS sketched places.
_RANKED = 1000
_CUTS = 32


def number(column: str) -> Column:
    """A numeric column as double; NaN is a missing number."""
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def _clamp(p: float) -> float:
    return min(1.0, max(0.0, p))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Rows ``(column_name, p, value)`` with linear interpolation between neighbouring ranks.

    The built-in exact percentile keeps every distinct value of a column in one task. Here three scans do: sketches, all
    side by side in one aggregate, bracket the wanted ranks; counts below and inside each bracket prove that the ranks are
    in it (else it is widened and counted again); the distinct values inside, some thousandth of all, are written with their
    counts. All else reads that small table: brackets with many values are cut further until few are left, and only
    those are ranked. No row is copied per column, and what comes back to the driver is a few numbers per column and
    probability. ``df`` should be a written table. Nulls and NaN do not count; a column without values has no row.
    """
    return quantiles_and(df, columns, probabilities, [])[0]


def quantiles_and(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], more: Sequence[Column]) -> tuple[DataFrame, Row | None]:
    """The quantiles, and a row of other aggregates that the first scan computes beside its sketches."""
    wanted = [(c, float(p)) for c in columns for p in probabilities]
    schema = "column_name string, p double, value double"
    if not wanted:
        return df.sparkSession.createDataFrame([], schema), df.agg(*more).first() if more else None
    edges = [e for p in probabilities for e in (_clamp(p - _MARGIN), _clamp(p + _MARGIN))]
    first = df.agg(*[x for i, c in enumerate(columns) for x in (
        F.count(number(c)).alias(f"n{i}"), F.percentile_approx(number(c), edges, _ACCURACY).alias(f"e{i}"))], *more).first()
    n = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    wanted = [(c, p) for c, p in wanted if n[c]]
    ranks = {(c, p): (math.floor(_clamp(p) * (n[c] - 1)), math.ceil(_clamp(p) * (n[c] - 1))) for c, p in wanted}
    bracket = {(c, float(p)): tuple(first[f"e{i}"][2 * j : 2 * j + 2]) for i, c in enumerate(columns) if n[c] for j, p in enumerate(probabilities)}
    below = _proven(df, wanted, bracket, ranks)
    # a bracket of one value needs no ranking
    values = {key: [(bracket[key][0], math.inf)] for key in wanted if bracket[key][0] == bracket[key][1]}
    values |= _inside(df, [key for key in wanted if key not in values], bracket, below, ranks)
    out = []
    for key in wanted:
        low, high = ranks[key]
        place, found = below[key], {}
        for value, count in values[key]:
            found |= {rank: value for rank in (low, high) if place <= rank < place + count}
            place += count
        share = _clamp(key[1]) * (n[key[0]] - 1) - low
        out.append((*key, found[low] + (found[high] - found[low]) * share if high > low else found[low]))
    return df.sparkSession.createDataFrame(out, schema), first


Key = tuple[str, float]


def _proven(df: DataFrame, wanted: list[Key], bracket: dict[Key, tuple[float, float]], ranks: dict[Key, tuple[int, int]]) -> dict[Key, int]:
    """Values below each bracket, by one scan; brackets that miss their ranks are widened in place and counted again."""
    below, margin, open_ = {}, dict.fromkeys(wanted, _MARGIN), wanted
    while open_:
        aggregates = []
        for i, key in enumerate(open_):
            value, (lo, hi) = number(key[0]), bracket[key]
            aggregates += [F.count_if(value < lo).alias(f"b{i}"), F.count_if((value >= lo) & (value <= hi)).alias(f"i{i}")]
        counted = df.agg(*aggregates).first()
        missed = []
        for i, key in enumerate(open_):
            low, high = ranks[key]
            if counted[f"b{i}"] <= low and high < counted[f"b{i}"] + counted[f"i{i}"]:
                below[key] = counted[f"b{i}"]
            else:
                missed.append(key)
        for key in missed:
            if margin[key] > 1:
                raise ArithmeticError("a bracket around a quantile cannot be proven")
            margin[key] *= 10
        if missed:
            drawn = df.agg(*[F.percentile_approx(number(c), [_clamp(p - margin[c, p]), _clamp(p + margin[c, p])], _ACCURACY).alias(f"e{i}") for i, (c, p) in enumerate(missed)]).first()
            bracket |= {key: tuple(drawn[f"e{i}"]) for i, key in enumerate(missed)}
        open_ = missed
    return below


def _inside(
    df: DataFrame, wanted: list[Key], bracket: dict[Key, tuple[float, float]], below: dict[Key, int], ranks: dict[Key, tuple[int, int]]
) -> dict[Key, list[tuple[float, int]]]:
    """Values around the wanted ranks in order, with their counts; ``below`` comes to count what lies before the first."""
    if not wanted:
        return {}
    inside = [number(c).between(*bracket[c, p]) for c, p in wanted]
    each = F.array(*[F.when(test, F.struct(F.lit(k).alias("k"), number(c).alias("value"))) for k, ((c, _), test) in enumerate(zip(wanted, inside))])
    few = df.where(reduce(or_, [F.coalesce(test, F.lit(False)) for test in inside])).select(F.explode(F.array_compact(each)).alias("x"))
    held = stage(few.groupBy("x.k", "x.value").agg(F.count(F.lit(1)).alias("n")), "quantile-values")
    size = {r["k"]: r["count"] for r in held.groupBy("k").count().collect()}
    open_ = [k for k in range(len(wanted)) if size[k] > _RANKED]
    limits = {k: bracket[key] for k, key in enumerate(wanted)}

    def within(ks: list[int]) -> DataFrame:
        return held.where(reduce(or_, [(F.col("k") == k) & F.col("value").between(*limits[k]) for k in ks]))

    while open_:
        places = [i / _CUTS for i in range(_CUTS + 1)]
        cuts = {r["k"]: sorted(set(r["cuts"])) for r in within(open_).groupBy("k").agg(F.percentile_approx("value", places, _ACCURACY).alias("cuts")).collect()}
        part = reduce(lambda c, k: c.when(F.col("k") == k, F.size(F.filter(F.array(*[F.lit(x) for x in cuts[k]]), lambda x: x <= F.col("value")))), open_, F.when(F.lit(False), 0))
        counted = within(open_).groupBy("k", part.alias("part")).agg(F.sum("n").alias("n"), F.count("*").alias("size"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
        for k in list(open_):
            low, high = ranks[wanted[k]]
            start, chosen = below[wanted[k]], []
            for r in sorted((r for r in counted if r["k"] == k), key=lambda r: r["part"]):
                if start <= high and low < start + r["n"]:
                    if not chosen:
                        below[wanted[k]] = start
                    chosen.append(r)
                start += r["n"]
            shrunk = (chosen[0]["lo"], chosen[-1]["hi"])
            left = sum(r["size"] for r in chosen)
            if left <= _RANKED or shrunk == limits[k]:
                open_.remove(k)
            limits[k] = shrunk
    rows = within(list(range(len(wanted)))).collect()
    return {key: sorted((r["value"], r["n"]) for r in rows if r["k"] == k) for k, key in enumerate(wanted)}
