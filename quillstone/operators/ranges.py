"""Numbers by order; joins by order and by overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.lineage import cut


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with the values of the last row of ``right`` that agrees in ``by`` and isn't later; null where there
    is none. Of right rows just as late the greatest values are taken.

    Both sides go through one shuffle by key and one sort, in which the last values are carried along, so no pairs are made.
    """
    pack = F.struct(*values)
    a = left.select(*by, F.col(order).alias("__at"), F.lit(1).alias("__side"), F.struct("*").alias("__row"), F.lit(None).cast(right.select(pack.alias("x")).schema["x"].dataType).alias("__value"))
    b = right.groupBy(*by, F.col(order).alias("__at")).agg(F.max(pack).alias("__value")).select(*by, "__at", F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), "__value")
    before = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("__last", F.last("__value", ignorenulls=True).over(before)).filter("__side = 1")
    return carried.select("__row.*", *[F.col("__last")[v].alias(v) for v in values])


def overlapping(left: DataFrame, right: DataFrame, by: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Rows of both sides that agree in ``by`` (names that both have) and whose spans overlap, with the columns of both.

    Spans are whole numbers, from the first up to but without the second; empty ones and nulls overlap nothing. A span lies
    in one or two bins of the least power of two that is as wide as itself, and of each greater one that some span needs.
    A pair meets at the level of its longer span, in the later of the two first bins there, so it is found once; no row is
    copied more than twice a level, however long it is.
    """

    def spans(df: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        start, end = (F.col(c).cast("long") for c in span)
        rows = df.withColumns({f"__{side}s": start, f"__{side}e": end}).filter(F.col(f"__{side}s") < F.col(f"__{side}e"))
        # The bits of length - 1 are those of the least power of two that isn't shorter.
        return rows.withColumn(f"__{side}l", F.length(F.bin(F.col(f"__{side}e") - F.col(f"__{side}s") - 1)).cast("int"))

    a, b = spans(left, left_span, "a"), spans(right, right_span, "b")
    found = a.select(F.col("__al").alias("l")).distinct().unionByName(b.select(F.col("__bl").alias("l")).distinct()).distinct()
    levels = sorted(r[0] for r in found.collect())  # 64 at most
    if not levels:
        levels = [1]

    def dealt(df: DataFrame, side: str) -> DataFrame:
        at = F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k >= F.col(f"__{side}l"))
        rows = df.withColumn("__level", F.explode(at))
        first = F.expr(f"shiftright(__{side}s, __level)")
        last = F.expr(f"shiftright(__{side}e - 1, __level)")
        return rows.withColumns({f"__{side}f": first, "__bin": F.explode(F.array_distinct(F.array(first, last)))})

    met = dealt(a, "a").join(dealt(b, "b"), [*by, "__level", "__bin"])
    once = (F.col("__level") == F.greatest("__al", "__bl")) & (F.col("__bin") == F.greatest("__af", "__bf"))
    shared = (F.col("__as") < F.col("__be")) & (F.col("__bs") < F.col("__ae"))
    return met.filter(once & shared).drop("__level", "__bin", *[f"__{s}{c}" for s in "ab" for c in "self"])


def counted_within(spans: DataFrame, key: str, span: tuple[str, str], points: DataFrame, at: str) -> DataFrame:
    """(key, n): how many points lie in the spans of a key, from the first number up to but without the second; keys without
    any are left out.

    No pairs are made: the points below each place where a span begins or ends are counted in one sort over all tasks.
    """
    start, end = (F.col(c).cast("long") for c in span)
    rows = cut(spans.select(key, start.alias("__s"), end.alias("__e")).filter("__s < __e"))
    seen = points.select(F.col(at).cast("long").alias("__at")).dropna().groupBy("__at").agg(F.count("*").alias("__n"))
    ends = rows.select(F.explode(F.array("__s", "__e")).alias("__at")).distinct().withColumn("__n", F.lit(0).cast("long"))
    places = seen.unionByName(ends).groupBy("__at").agg(F.sum("__n").alias("__n"))
    spread = cut(places.repartitionByRange("__at").withColumn("__part", F.spark_partition_id()))
    sizes = spread.groupBy("__part").agg(F.sum("__n").alias("__whole"))
    before = F.coalesce(F.sum("__whole").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__before")))  # a row a range
    running = F.sum("__n").over(Window.partitionBy("__part").orderBy("__at")) - F.col("__n")
    below = cut(spread.join(starts, "__part").select("__at", (F.col("__before") + running).alias("__below")))
    one, two = (below.select(F.col("__at").alias(f"__{c}"), F.col("__below").alias(f"__below_{c}")) for c in "se")
    found = rows.join(one, "__s").join(two, "__e").groupBy(key).agg(F.sum(F.col("__below_e") - F.col("__below_s")).alias("n"))
    return found.filter("n > 0")


def last_of(keys: DataFrame, rows: DataFrame, key: str, order: Sequence[Column], k: int, how: str = "inner") -> DataFrame:
    """Each row of ``keys`` with the first ``k`` of its rows in an order: a lateral join. The rows of a key are cut to k
    in each task before they are shuffled."""
    own = rows.alias("__rows").filter(F.col(f"__rows.{key}") == F.col(f"__keys.{key}").outer())
    mine = own.orderBy(*order).limit(k).select(*[c for c in rows.columns if c != key])
    return keys.alias("__keys").lateralJoin(mine, how=how)


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str = "number") -> DataFrame:
    """The rows with their number in an order, from 1. Equal rows are numbered one way or another.

    Rows are sorted over all tasks, by ranges; a window sees one row a range only.
    """
    spread = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)  # the rest of the id counts the rows of a range
    sizes = spread.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    found = spread.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return found.select(*rows.columns, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).alias(name))
