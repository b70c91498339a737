"""Mixing sources to target weights, with DataFrame functions only.

Rates come from one aggregate over sources; each document then gets floor(rate) copies and one more if a hash of
its id and the seed falls under the fraction. The draw depends on nothing but the id and the seed, so reruns and
retried tasks agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST, SEED = 1.5, 2.0, "mix-1"


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_rates(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row a source: its size, weight, target and repetition rate.

    Sources by code point, null last, take the weights in turn. The budget is ``share`` of all sizes, dealt by
    weight; a target stops at ``most`` times its source's size and the excess is dealt again. Sources in rising
    order of size / weight reach that stop first, so the fixed point is a running sum: while what the earlier ones
    leave, dealt by weight, exceeds this one's stop, it stops too. The windows see one row a source.
    """
    by_size = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = by_size.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    table = table.withColumns({
        "__before": F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "__weight": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "__all": F.sum("source_size").over(everything),
    })
    level = (F.lit(float(share)) * F.col("__all") - F.lit(float(most)) * F.col("__before")) / F.col("__weight")
    table = table.withColumn("__level", level).withColumn("__open", F.col("__level") * F.col("weight") < F.lit(float(most)) * F.col("source_size"))
    first = F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "__level")
    table = table.withColumn("__shared", F.min(F.when(F.col("__open"), first)).over(everything)["__level"])
    stop = F.lit(float(most)) * F.col("source_size")
    table = table.withColumn("target", F.when(F.col("__shared").isNull(), stop).otherwise(F.least(stop, F.col("__shared") * F.col("weight"))))
    return table.select("source", "source_size", "weight", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def copies(rate: Column, key: Column, seed: str = SEED) -> Column:
    """floor(rate), plus one where 32 bits of md5(key, seed) are under the fraction of the rate."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """What the mix takes of each row: doc_id, source, size, source_size, target, rate, n_copies, taken.

    Null texts have size 0; a null source is a source of its own. Rows that repeat an id share its draw; a null id
    draws as the empty string. Empty tables give no rows. Extra columns are not looked at.
    """
    sizes = cut(docs.select("doc_id", "source", word_count().alias("size")))
    rates = source_rates(sizes, weights, share, most)
    a, b = sizes.alias("a"), rates.alias("b")
    rows = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.doc_id", "a.source", "a.size", "b.source_size", "b.target", "b.rate")
    return rows.withColumn("n_copies", copies(F.col("rate"), F.col("doc_id"), seed)).withColumn("taken", F.col("n_copies") * F.col("size"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every row as often as the mix takes it, with the columns of ``docs``, whatever these are called.

    Null texts have size 0 and are taken at their source's rate; a null source is one of its own. Rows that repeat an id
    share its draw. An empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"))
    rates = source_rates(docs.select("source", word_count().alias("size")), weights, share, most)
    taken = rows.alias("a").join(rates.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.row", copies(F.col("b.rate"), F.col("a.doc_id"), seed).cast("int").alias("n"))
    return taken.filter("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*")
