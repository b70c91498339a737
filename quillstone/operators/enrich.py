"""Gaps in records and how to fill them: candidates, merges, suggestions, patches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.isbn import bare


def empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def any_of(tests: Sequence[Column]) -> Column:
    """Whether any holds; without tests, all rows pass."""
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def missing(flags: Mapping[str, Column]) -> Column:
    """Names of the flags that hold, in their order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags.items()]))


def not_like_any(c: Column, words: Sequence[str]) -> Column:
    """None of the words occurs, whatever their case; a null drops its row."""
    return reduce(lambda a, b: a & b, [~c.ilike(f"%{w}%") for w in words])


def bad_title(c: Column, patterns: Sequence[str]) -> Column:
    return empty(c) | c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def capped_scan(rows: DataFrame, order: Sequence[Column], examined: int, want: Column, limit: int) -> DataFrame:
    """The first ``limit`` rows that are wanted among the first ``examined - 1`` in order."""
    head = rows.orderBy(*order).limit(examined - 1)
    return head.filter(want).orderBy(*order).limit(limit)


def fill_only(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], no_value: Mapping[str, str] | None = None) -> DataFrame:
    """New values where the old ones are empty or stand for none; n_updated counts them."""
    stand_in = no_value or {}
    have = {f: ~empty(F.nullif(F.col(f"o.{f}"), F.lit(stand_in[f])) if f in stand_in else F.col(f"o.{f}")) for f in fields}
    return _merge(old, new, key, fields, {f: ~have[f] & ~empty(F.col(f"n.{f}")) for f in fields})


def overwrite(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], guarded: Sequence[str] = ()) -> DataFrame:
    """New values wherever there are any, but for the guarded fields."""
    return _merge(old, new, key, fields, {f: F.lit(False) if f in guarded else ~empty(F.col(f"n.{f}")) for f in fields})


def _merge(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], take: Mapping[str, Column]) -> DataFrame:
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "left")
    chosen = [F.when(F.coalesce(take[f], F.lit(False)), F.col(f"n.{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in fields]
    n = reduce(lambda a, b: a + b, [F.coalesce(take[f], F.lit(False)).cast("int") for f in fields])
    return joined.select(F.col(f"o.{key}").alias(key), *chosen, n.alias("n_updated"))


def suggestions(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, current, suggested, reason): 'Missing' where the old value is empty, 'Different' where both differ."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"))
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("current"), F.col(f"n.{f}").cast("string").alias("suggested")) for f in fields])
    rows = joined.select(F.col(f"o.{key}").alias(key), F.inline(items)).filter(~empty(F.col("suggested")))
    reason = F.when(empty(F.col("current")), "Missing").when(F.col("current") != F.col("suggested"), "Different")
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL")


def apply_selected(found: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """For each key: suggested fields that were asked for, asked-for ones without a suggestion, and a status."""
    names = F.array(*[F.lit(w) for w in wanted])
    per = found.groupBy(key).agg(F.array_sort(F.collect_set("field")).alias("have"))
    done = F.col("have") if list(wanted) == ["all"] else F.array_intersect("have", names)
    failed = F.array().cast("array<string>") if list(wanted) == ["all"] else F.array_except(names, "have")
    per = per.select(key, F.array_join(F.array_sort(done), ",").alias("applied"), F.array_join(F.array_sort(failed), ",").alias("failed"))
    return per.withColumn("status", F.when(F.col("applied") == "", "no_updates_needed").when(F.col("failed") != "", "partial").otherwise("success"))


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the non-null values of the changes in place of theirs; the inputs stay as they are."""
    fields = [c for c in changes.columns if c != key]
    joined = rows.alias("o").join(changes.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "left")
    return joined.select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in fields else F.col(f"o.{c}") for c in rows.columns])


def bulk_outcome(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """One row: how many of the ids exist and take the update, and how many don't."""
    found = ids.select(key).distinct().join(rows.select(key).withColumn("here", F.lit(1)), key, "left")
    return found.agg(F.count_if(F.expr("here IS NOT NULL")).alias("n_success"), F.count_if(F.expr("here IS NULL")).alias("n_failure"), F.count("*").alias("n_total"))


def lookup(rows: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Rows with what a table of metadata says of their key; success tells whether it says anything."""
    known = metadata.withColumn("success", F.lit(True))
    return rows.join(known, key, "left").withColumn("success", F.coalesce("success", F.lit(False)))


def found_by_identifier(rows: DataFrame, metadata: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, identifier, success, error, found) of rows (id, identifier), the identifier as 'kind:value' or null.

    ``metadata`` has a column ``isbn`` and, where other kinds are known, ``identifiers``, a map from kind to value. What it
    says of an identifier is a struct of its columns; of several rows for one identifier the least is taken.
    """
    fields = metadata.columns
    numbers = metadata.filter("isbn IS NOT NULL").select(F.concat(F.lit("isbn:"), bare(F.col("isbn"))).alias("identifier"), F.struct(*[c for c in fields if c != "identifiers"]).alias("found"))
    if "identifiers" in fields:
        pairs = metadata.select(F.explode("identifiers").alias("kind", "value"), F.struct(*[c for c in fields if c != "identifiers"]).alias("found"))
        numbers = numbers.unionByName(pairs.filter("value IS NOT NULL").select(F.concat("kind", F.lit(":"), "value").alias("identifier"), "found"))
    known = numbers.groupBy("identifier").agg(F.min("found").alias("found"))
    joined = rows.join(known, "identifier", "left")
    error = F.when(F.col("identifier").isNull(), "No ISBN or ASIN found").when(F.col("found").isNull(), "nothing found")
    return joined.select(id_col, "identifier", F.col("found").isNotNull().alias("success"), error.alias("error"), "found")


def counted(results: DataFrame) -> DataFrame:
    """One row: how many lookups there were, and how many of them found something."""
    return results.agg(F.count("*").alias("total_processed"), F.count_if(F.col("success")).alias("successful"), F.count_if(~F.col("success")).alias("failed"))


def add_identifier(identifiers: Column, kind: str, value: Column) -> Column:
    """The map with one more identifier, stored bare; an old one of the kind gives way."""
    rest = F.map_filter(identifiers, lambda k, _: k != kind)
    return F.map_concat(rest, F.create_map(F.lit(kind), bare(value)))

