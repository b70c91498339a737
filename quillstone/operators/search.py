"""Vector search, exact; and the small field query language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import vectors as V


def top_k(items: DataFrame, query: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k items nearest one query vector by cosine, ties by id. The query is one row and is sent to every task."""
    one = query.limit(1).select(F.col(vec).alias("q"))
    scored = items.crossJoin(F.broadcast(one)).select(id_col, F.round(V.cosine(F.col(vec), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.col("score").desc_nulls_last(), id_col).limit(k)


def top_k_by(items: DataFrame, query: DataFrame, k: int, group: str, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k nearest of each group."""
    one = query.limit(1).select(F.col(vec).alias("q"))
    scored = items.crossJoin(F.broadcast(one)).select(id_col, group, F.round(V.cosine(F.col(vec), F.col("q")), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("score").desc_nulls_last(), id_col))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def neighbours(items: DataFrame, key: int, k: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k nearest to one item, without itself."""
    return top_k(items.filter(F.col(id_col) != key), items.filter(F.col(id_col) == key), k, id_col, vec)


def analogy(items: DataFrame, a: int, b: int, c: int, k: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k nearest to a - b + c, without these three."""
    one = lambda key, name: items.filter(F.col(id_col) == key).select(F.col(vec).alias(name))
    q = one(a, "a").crossJoin(one(b, "b")).crossJoin(one(c, "c")).select(V.add(V.subtract(F.col("a"), F.col("b")), F.col("c")).alias(vec))
    return top_k(items.filter(~F.col(id_col).isin(a, b, c)), q, k, id_col, vec)


def mean_pool(items: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """(group, position, value): element-wise means. Rows are summed in parts before they are shuffled."""
    long = items.select(group, F.posexplode(V.doubles(F.col(vec))).alias("position", "x"))
    return long.groupBy(group, "position").agg(F.avg("x").alias("value"))


def gram(items: DataFrame, vec: str = "embedding") -> DataFrame:
    """(i, j, product): the vectors' matrix, transposed, times itself. Each batch gives its own small product, and these are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)) if batch.num_rows else None
            if x is not None:
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int64)), pa.array(j.ravel().astype(np.int64)), pa.array(total.ravel())], names=["i", "j", "x"])

    rows = items.filter(F.col(vec).isNotNull()).select(V.doubles(F.col(vec)).alias("e"))
    return rows.mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("product"))


def predicate(text: str, fields: dict[str, Column]) -> Column:
    """A column for 'field:value AND field:value'; values are looked for anywhere in the field, whatever their case;
    ``id:n`` is an exact match; a value may be quoted."""
    tests = []
    for part in re.split(r"\s+AND\s+", text.strip(), flags=re.IGNORECASE):
        name, _, value = part.partition(":")
        value = value.strip().strip('"')
        if name not in fields or not value:
            raise ValueError(f"can't search by {part!r}")
        tests.append(fields[name] == int(value) if name == "id" else fields[name].ilike(f"%{value}%"))
    return reduce(lambda a, b: a & b, tests)


def encoded(rows: DataFrame, key: str, words: Column, size: int = 64) -> DataFrame:
    """(key, embedding): a stand-in for a trained encoder. Each word adds one, with a sign, at a place that its md5 names, and
    the sums are scaled to unit length; a text without words has a null embedding."""
    code = F.md5("word")
    place = F.conv(F.substring(code, 1, 4), 16, 10).cast("int") % size
    sign = F.when(F.conv(F.substring(code, 5, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)
    cells = rows.select(key, F.explode(words).alias("word")).groupBy(key, place.alias("place")).agg(F.sum(sign).alias("x"))
    maps = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("m"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    found = maps.select(key, whole.alias("e"))
    scaled = F.when(V.norm(F.col("e")) > 0, F.transform("e", lambda x: x / V.norm(F.col("e"))))
    return rows.select(key).join(found.select(key, scaled.alias("embedding")), key, "left")


#: What a hit says of its book, in order, beside the score and the preview.
HIT_FIELDS = ("title", "authors", "id", "isbn", "publisher", "pubdate", "series", "series_index", "tags", "rating", "languages", "identifiers", "formats", "last_modified", "comments")


def hits(found: DataFrame, books: DataFrame, preview: Column) -> DataFrame:
    """What search found (id, score), with all fields of each book; a field that the books don't have is null, a missing
    title or author 'Unknown'."""
    joined = found.join(books, "id", "left")
    known = {c: F.col(c) for c in books.columns}
    text = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))
    shown = []
    for f in HIT_FIELDS:
        c = known.get(f, F.lit(None).cast("string"))
        c = text(F.array_join(c, ", ") if dict(books.dtypes).get(f, "").startswith("array") else c) if f in ("title", "authors") else c
        shown.append(c.alias(f))
    return joined.select("score", *shown, preview.alias("description_preview")).orderBy(F.col("score").desc(), "id")
