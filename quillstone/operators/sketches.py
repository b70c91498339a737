"""Sketches that are stored by day and united for longer times: distinct keys, ranks of values, keys in common.

A day's sketches are made in one pass, with partial ones in each task. United, they answer for any set of days without
another look at the rows. Their sizes are fixed, whatever they have seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct count, as a power of two, and entries of a rank sketch; with these the errors below hold.
LOG_REGISTERS, ENTRIES = 14, 400
#: Standard errors: of a distinct count 1.04 / sqrt(2 ** 14) = 0.8 %, of a common one the same share of the union; of a rank under 0.7 %.
COUNT_ERROR, RANK_ERROR = 0.0082, 0.007


def by_day(rows: DataFrame, day: Column, key: Column, value: Column) -> DataFrame:
    """(day, n, keys, ranks, common): rows, and sketches of the keys and values, of each day."""
    named = rows.select(day.alias("day"), key.alias("k"), value.cast("double").alias("v"))
    return named.groupBy("day").agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg("k", LOG_REGISTERS).alias("keys"),
        F.kll_sketch_agg_double("v", ENTRIES).alias("ranks"),
        F.theta_sketch_agg("k", LOG_REGISTERS).alias("common"),
    )


def united(days: DataFrame, period: Column) -> DataFrame:
    """(period, n, keys, ranks, common) of the days of each period."""
    return days.groupBy(period.alias("period")).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("keys").alias("keys"),
        F.kll_merge_agg_double("ranks", ENTRIES).alias("ranks"),
        F.theta_union_agg("common", LOG_REGISTERS).alias("common"),
    )


def estimates(sketches: DataFrame, at: Sequence[float] = (), quantiles: Sequence[float] = ()) -> DataFrame:
    """Columns n_keys, rank_i (the share of values of at most the i-th of ``at``) and quantile_i beside the sketches' own."""
    found = {"n_keys": F.hll_sketch_estimate("keys")}
    found |= {f"rank_{i}": F.kll_sketch_get_rank_double("ranks", F.lit(float(v))) for i, v in enumerate(at)}
    found |= {f"quantile_{i}": F.kll_sketch_get_quantile_double("ranks", F.lit(float(q))) for i, q in enumerate(quantiles)}
    return sketches.withColumns(found)


def shared_keys(one: Column, other: Column) -> Column:
    """About how many keys two ``common`` sketches have both seen."""
    return F.theta_sketch_estimate(F.theta_intersection(one, other))
