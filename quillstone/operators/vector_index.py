"""An inverted file of vectors: cells of k-means, bounded probing, exact scores within the probed cells.

Cells are fitted to a sample of at most SAMPLE vectors; every vector is assigned to its nearest cell, and the index is a
Parquet table partitioned by cell. A query looks through the cells nearest to it, so a search reads their part of the
table; with all cells probed it is exact. Cells are cut into blocks and a cell's queries into others, so no group grows
with the data. A refresh encodes only texts whose digest has changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import vectors as V
from quillstone.operators.lineage import cut, prepare

#: Vectors that cells are fitted to, cells at most, rounds of the fit; vectors and queries of one block.
SAMPLE, MOST_CELLS, ROUNDS, BLOCK = 20_000, 1024, 12, 4096


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fit_cells(items: DataFrame, cells: int | None = None, id_col: str = "vec_id", vec: str = "embedding", sample: int = SAMPLE) -> np.ndarray:
    """Unit centres of spherical k-means on vectors chosen by a hash of their ids: about 4 * sqrt(n) cells if not given.

    Vectors that are null, or without length, fit no cell. Centres that lose all their vectors are dropped.
    """
    known = items.filter(F.col(vec).isNotNull())
    total = known.count()
    picked = known.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1, sample / max(total, 1))))
    rows = picked.select(id_col, V.doubles(F.col(vec)).alias("e")).orderBy(F.xxhash64(F.col(id_col), F.lit(8)), id_col).limit(2 * sample).collect()
    x = np.array([r["e"] for r in rows], np.float64) if rows else np.zeros((0, 1))
    x = _unit(x[np.linalg.norm(x, axis=1) > 0]) if len(x) else x
    k = min(len(x), MOST_CELLS, cells or max(1, round(4 * total**0.5)))
    if not k:
        return np.zeros((0, 1))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]  # the order is a hash's, so these are a random choice
    for _ in range(ROUNDS):
        at = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = _unit(sums[np.bincount(at, minlength=len(centres)) > 0])
    return centres


def _nearest(centres: np.ndarray, n: int, keep: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first ``keep`` columns and the vector, last, with its ``n`` nearest cells; one without length goes to cell 0."""
    for batch in batches:
        column = batch.column(keep)
        score = _unit(_matrix(column)) @ centres.T
        best = np.argsort(-score, axis=1, kind="stable")[:, :n]
        rows = np.repeat(np.arange(batch.num_rows), best.shape[1])
        taken = batch.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(best.ravel().astype(np.int32))], names=[*batch.schema.names, "cell"])


def assigned(items: DataFrame, centres: np.ndarray, columns: list[str], vec: str = "embedding", probes: int = 1) -> DataFrame:
    """(columns, embedding, cell) of each vector that isn't null; with more probes a row for each of its nearest cells."""
    prepare(items.sparkSession)
    rows = items.filter(F.col(vec).isNotNull()).select(*columns, V.doubles(F.col(vec)).alias("embedding"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell int"
    if not len(centres):
        return rows.limit(0).withColumn("cell", F.lit(0))
    n, keep = min(probes, len(centres)), len(columns)
    return rows.mapInArrow(lambda b: _nearest(centres, n, keep, b), schema)


def _scores(k: int, queries: pa.Table, items: pa.Table) -> pa.Table:
    """The k best items of a block for each query of a block, the query itself left out."""
    names = ["query_id", "vec_id", "score"]
    if not queries.num_rows or not items.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
    q, x = (_matrix(t["embedding"].combine_chunks()) for t in (queries, items))
    own, ids = queries["query_id"].to_numpy(), items["vec_id"].to_numpy()
    score = np.round(_unit(q) @ _unit(x).T, 6)
    score[own[:, None] == ids[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
    found = np.take_along_axis(score, order, 1)
    rows = np.repeat(np.arange(len(own)), order.shape[1])
    real = np.isfinite(found.ravel())
    return pa.table([pa.array(own[rows][real]), pa.array(ids[order.ravel()][real]), pa.array(found.ravel()[real])], names=names)


class Index:
    """Vectors by cell: a table (vec_id, embedding, cell, and digest where it was built from texts) and the cells' centres."""

    def __init__(self, rows: DataFrame, centres: np.ndarray) -> None:
        self.rows, self.centres = rows, centres

    @classmethod
    def build(cls, items: DataFrame, cells: int | None = None, id_col: str = "vec_id", vec: str = "embedding", extra: list[str] | None = None) -> Index:
        named = items.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec).alias("embedding"), *(extra or []))
        centres = fit_cells(named, cells)
        return cls(assigned(named, centres, ["vec_id", *(extra or [])]), centres)

    def save(self, path: str) -> Index:
        """Writes the index to a folder and gives the one that reads it from there."""
        self.rows.write.partitionBy("cell").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(self.centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
        return Index.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # MOST_CELLS at most
        return cls(spark.read.parquet(f"{path}/rows"), np.array([r["centre"] for r in centres]) if centres else np.zeros((0, 1)))

    def search(self, queries: DataFrame, k: int, probes: int = 8, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
        """(query_id, place, vec_id, score): of each query (an id and a vector) the k nearest other vectors by cosine,
        rounded to six places, ties by id, in the cells probed."""
        asked = assigned(queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec).alias("embedding")), self.centres, ["query_id"], probes=probes)
        sizes = {r["cell"]: r["count"] for r in self.rows.groupBy("cell").count().collect()}  # a row a cell
        wanted = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
        blocks = lambda n: {c: -(-m // BLOCK) for c, m in n.items()}
        of_items, of_queries = blocks(sizes), blocks(wanted)

        def number(name: str) -> Column:
            counts = of_items if name == "item" else of_queries
            many = {c: n for c, n in counts.items() if n > 1}
            found = F.lit(1)
            for c, n in many.items():
                found = F.when(F.col("cell") == c, n).otherwise(found)
            return found

        own = lambda key, name: F.pmod(F.xxhash64(key, F.lit(3)), number(name)).cast("int")
        every = lambda name: F.explode(F.sequence(F.lit(0), number(name) - 1))
        left = asked.withColumns({"qb": own("query_id", "query")}).withColumn("ib", every("item"))
        right = self.rows.filter(F.col("cell").isin(*wanted)) if len(wanted) < len(sizes) else self.rows
        right = right.select("vec_id", "embedding", "cell").withColumns({"ib": own("vec_id", "item")}).withColumn("qb", every("query"))
        key = ["cell", "qb", "ib"]
        best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda q, x: _scores(k, q, x), "query_id long, vec_id long, score double")
        order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("away"), "vec_id", "score")))
        top = best.groupBy("query_id").agg(F.slice(order, 1, k).alias("best"))
        return top.select("query_id", F.posexplode("best").alias("place", "x")).select("query_id", (F.col("place") + 1).alias("place"), "x.vec_id", "x.score")

    def exact(self, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
        return self.search(queries, k, len(self.centres), id_col, vec)


def digested(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    return texts.select(F.col(id_col).cast("long").alias("vec_id"), F.col(text).alias("text"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"))


def build_texts(texts: DataFrame, encode: Callable[[DataFrame], DataFrame], cells: int | None = None, id_col: str = "id", text: str = "text") -> Index:
    """An index of texts. encode: (vec_id, text) to (vec_id, embedding)."""
    rows = digested(texts, id_col, text)
    return Index.build(encode(rows.select("vec_id", "text")).join(rows.select("vec_id", "digest"), "vec_id"), cells, extra=["digest"])


def refresh(index: Index, texts: DataFrame, encode: Callable[[DataFrame], DataFrame], id_col: str = "id", text: str = "text") -> tuple[Index, DataFrame]:
    """The index of the texts as they are now, in the same cells, and (vec_id) of those that were encoded anew: they are
    new, or their digest differs. Vectors of texts that are gone go."""
    now = digested(texts, id_col, text)
    kept = index.rows.join(now.select("vec_id", "digest"), ["vec_id", "digest"], "left_semi")
    changed = cut(now.join(index.rows.select("vec_id", "digest"), ["vec_id", "digest"], "left_anti"))
    fresh = encode(changed.select("vec_id", "text")).join(changed.select("vec_id", "digest"), "vec_id")
    found = assigned(fresh, index.centres, ["vec_id", "digest"])
    columns = ["vec_id", "digest", "embedding", "cell"]
    return Index(kept.select(*columns).unionByName(found.select(*columns)), index.centres), changed.select("vec_id")


def saved(spark: SparkSession, items: DataFrame, cells: int | None = None) -> Index:
    """An index of the vectors, written to the shared folder."""
    prepare(spark)
    return Index.build(items, cells).save(f"{spark.sparkContext.getCheckpointDir()}/index-{uuid4().hex}")
