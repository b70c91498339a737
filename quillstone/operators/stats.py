"""Summaries of columns and of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranks are found within brackets of about this share of the rows.
_FINE = 1e-4


def quantiles(rows: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(name, share, value): exact quantiles, interpolated between neighbours, of columns without their nulls.

    A first pass sketches brackets that are sure to hold each rank; a second one counts what lies below a bracket and the
    different values within it, so that no task holds more than about 6 * _FINE of the rows.
    """
    fine = int(1 / _FINE)
    around = [min(1.0, max(0.0, q + d * 3 * _FINE)) for q in shares for d in (-1, 1)]
    double = {c: F.col(c).cast("double") for c in columns}
    sketch = rows.agg(*[F.percentile_approx(x, F.array(*[F.lit(v) for v in around]), F.lit(fine)).alias(c) for c, x in double.items()], *[F.count(x).alias(f"n {c}") for c, x in double.items()]).first()
    found = []
    for c, x in double.items():
        for k, q in enumerate(shares):
            if sketch[c] is not None:
                low, high, n = sketch[c][2 * k], sketch[c][2 * k + 1], sketch[f"n {c}"]
                few = n * _FINE < 4  # too few rows for a bracket
                found.append((c, float(q), (n - 1) * q, x, float("-inf") if few or q < 4 * _FINE else float(low), float("inf") if few or q > 1 - 4 * _FINE else float(high)))
    cases = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(q).alias("share"), F.lit(at).alias("at"), F.when(x >= low, x).alias("value"), (x <= high).alias("near")) for c, q, at, x, low, high in found])
    if not found:
        return rows.sparkSession.createDataFrame([], "name string, share double, value double")
    counts = rows.select(F.inline(cases)).filter("near").groupBy("name", "share", "at", "value").agg(F.count("*").alias("n"))
    running = Window.partitionBy("name", "share").orderBy(F.col("value").asc_nulls_first())  # what lies below comes first
    upto = counts.withColumn("upto", F.sum("n").over(running))
    at = lambda rank: F.min(F.when((F.col("upto") > rank) & F.col("value").isNotNull(), F.col("value")))
    picked = upto.groupBy("name", "share").agg(at(F.floor("at")).alias("a"), at(F.ceil("at")).alias("b"), (F.max("at") - F.floor(F.max("at"))).alias("part"))
    return picked.select("name", "share", (F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("value"))


def describe(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: count, mean, sample deviation, least, exact quartiles, greatest."""
    plain = rows.agg(*[f(F.col(c).cast("double")).alias(f"{c} {k}") for c in columns for k, f in (("n", F.count), ("mean", F.avg), ("deviation", F.stddev_samp), ("least", F.min), ("greatest", F.max))])
    of = lambda c: F.struct(F.lit(c).alias("name"), F.col(f"{c} n").alias("n"), F.round(f"{c} mean", 4).alias("mean"), F.round(f"{c} deviation", 4).alias("deviation"), F.col(f"{c} least").alias("least"), F.col(f"{c} greatest").alias("greatest"))
    long = plain.select(F.inline(F.array(*[of(c) for c in columns])))
    quartile = lambda q: F.round(F.max(F.when(F.col("share") == q, F.col("value"))), 4)
    quarters = quantiles(rows, columns, (0.25, 0.5, 0.75)).groupBy("name").agg(quartile(0.25).alias("q1"), quartile(0.5).alias("median"), quartile(0.75).alias("q3"))
    return long.join(F.broadcast(quarters), "name", "left").select("name", "n", "mean", "deviation", "least", "q1", "median", "q3", "greatest")  # one row a column


def null_columns(rows: DataFrame) -> DataFrame:
    """One row: for each column, whether any value is null."""
    return rows.agg(*[F.coalesce(F.max(F.col(c).isNull()), F.lit(False)).alias(c) for c in rows.columns])


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def standardise(rows: DataFrame, column: str) -> DataFrame:
    """Rows with z: distance from the mean in population deviations. The two figures are one row, sent to every task."""
    figures = rows.agg(F.avg(column).alias("__mean"), F.stddev_pop(column).alias("__deviation"))
    return rows.crossJoin(F.broadcast(figures)).withColumn("z", (F.col(column) - F.col("__mean")) / F.col("__deviation")).drop("__mean", "__deviation")


def label_encode(rows: DataFrame, column: str) -> DataFrame:
    """Rows with code: place of the value among the distinct ones in order, from 0. The window sees distinct values."""
    codes = rows.select(column).distinct().withColumn("code", F.row_number().over(Window.orderBy(column)) - 1)
    return rows.join(codes, column)


def accuracy(predictions: DataFrame, truth: str, predicted: str, by: str | None = None) -> DataFrame:
    keys = [by] if by else []
    return predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg((F.col(truth) == F.col(predicted)).cast("double")), 6).alias("accuracy"))


def confusion(predictions: DataFrame, truth: str, predicted: str) -> DataFrame:
    return predictions.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def report(predictions: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row a label: precision, recall, F1 and support, 0 where undefined; labels that are only predicted count too."""
    both = predictions.select(F.inline(F.array(
        F.struct(F.col(truth).alias("label"), F.lit(1).alias("true"), F.lit(0).alias("said"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).alias("true"), F.lit(1).alias("said"), F.lit(0).alias("hit")),
    )))
    per = both.groupBy("label").agg(F.sum("true").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    per = per.withColumns({"precision": ratio(F.col("hit"), F.col("said")), "recall": ratio(F.col("hit"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return per.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"), "support")


def weighted_report(predictions: DataFrame, truth: str, predicted: str, ignore: int | None = None) -> DataFrame:
    """One row: precision, recall and F1 as means over labels weighted by support, and the support; tokens whose truth is
    ``ignore`` don't count."""
    rows = predictions if ignore is None else predictions.filter(F.col(truth) != ignore)
    per = report(rows, truth, predicted)
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 6).alias(c)
    return per.agg(mean("precision"), mean("recall"), mean("f1"), F.sum("support").alias("support"))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): rows by equal parts of [low, high], the last part closed; values outside and nulls aren't counted."""
    x = F.col(column)
    at = F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)).cast("long")
    return rows.filter((x >= low) & (x <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
