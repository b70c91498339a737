"""Texts as means of their words' skip-gram vectors, for pipelines of Spark ML.

The table of vectors has a row a word and stays in the cluster, whatever the vocabulary: neither the driver nor a broadcast
holds it. Texts lie in parts. In each round a part is given the rows of its own words, trains a copy of them on its texts and
hands on their changes, which are averaged over the parts that changed a row. The means are taken in parts, too. Random
numbers are seeded by round and part, and changes are summed as whole numbers, so order doesn't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.lineage import cut, prepare
from quillstone.operators.word_vectors import Settings, Tables, passed

#: Texts of a part whose means are taken at once; changes are whole numbers of one of so many.
ROWS, UNIT = 2000, 1 << 40


def _joined(words: str) -> Column:
    """A text's words with spaces between: they have none."""
    return F.concat_ws(" ", words)


def _words(texts: DataFrame) -> DataFrame:
    return texts.select("part", F.explode(F.split("text", " ")).alias("word"))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float32).reshape(-1, size)


def _trained(settings: Settings, turn: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Gives (word, nv, nc, changes) of a part's words that were trained on, each in its two vectors."""

    def run(texts: pa.Table, given: pa.Table) -> pa.Table:
        given = given.sort_by("word")
        words = given["word"].to_pylist()
        old = [_matrix(given[c], settings.size) for c in ("v", "c")]
        tables = Tables(*old, settings, words)
        known = set(words)
        part = texts["part"][0].as_py() if len(texts) else 0
        passed(tables, ([w for w in t.split(" ") if w in known] for t in sorted(texts["text"].to_pylist())), np.random.default_rng([settings.seed, turn, part]))
        change = np.concatenate([tables.parts - old[0], tables.contexts - old[1]], 1).astype(np.float64)
        columns = [pa.array(words, pa.string()), *(pa.array((s > 0).astype(np.int32)) for s in tables.steps)]
        columns += [pa.array(np.rint(x * UNIT).astype(np.int64)) for x in change.T]
        return pa.table(columns, names=["word", "nv", "nc", *(f"x{k}" for k in range(2 * settings.size))])

    return run


def _means(size: int, texts: pa.Table, given: pa.Table) -> pa.Table:
    """(key, mean) of a part's texts: the sum of the vectors of the words that have one, by the number of all its words."""
    at = {w: k for k, w in enumerate(given["word"].to_pylist())}
    table = np.concatenate([_matrix(given["v"], size), np.zeros((1, size), np.float32)]).astype(np.float64)
    means = [table[[at.get(w, -1) for w in t.split(" ")]].mean(0) for t in texts["text"].to_pylist()]
    return pa.table([texts["key"], pa.array(means, pa.list_(pa.float64()))], names=["key", "mean"])


class TextVectors(Estimator):
    """Trains vectors of the words of ``words`` that come ``least`` times or more, in ``parts`` parts at once."""

    def __init__(self, parts: int, settings: Settings, least: int = 2, words: str = "words", features: str = "features") -> None:
        super().__init__()
        self.parts, self.settings, self.least, self.words, self.features = parts, settings, least, words, features

    def getNumPartitions(self) -> int:  # noqa: N802, as Spark ML's estimators
        return self.parts

    def _fit(self, dataset: DataFrame) -> TextVectorsModel:
        s = self.settings
        prepare(dataset.sparkSession)
        texts = cut(dataset.select(_joined(self.words).alias("text")).filter("text <> ''").repartition(self.parts).withColumn("part", F.spark_partition_id()))
        counts = cut(_words(texts).groupBy("part", "word").agg(F.count("*").alias("n")))
        kept = counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= self.least).select("word")
        start = lambda k: ((F.xxhash64("word", F.lit(s.seed), F.lit(k)) / 2.0**64) / s.size).cast("float")
        table = cut(kept.select("word", F.array(*map(start, range(s.size))).alias("v"), F.array_repeat(F.lit(0.0).cast("float"), s.size).alias("c")))
        wanted = cut(counts.join(table.select("word"), "word").select(F.col("part").alias("of"), "word"))
        sums = [F.sum(c).alias(c) for c in ("nv", "nc", *(f"x{k}" for k in range(2 * s.size)))]
        schema = ", ".join(["word string", "nv int", "nc int", *(f"x{k} long" for k in range(2 * s.size))])
        moved = lambda c, n, k, x: F.when(F.col(n) > 0, F.col(c)[k] + F.col(f"x{x}") / float(UNIT) / F.col(n)).otherwise(F.col(c)[k]).cast("float")
        for turn in range(s.rounds):
            given = wanted.join(table, "word").groupBy("of")
            changes = texts.groupBy("part").cogroup(given).applyInArrow(_trained(s, turn), schema).groupBy("word").agg(*sums)
            v = F.array(*(moved("v", "nv", k, k) for k in range(s.size)))
            c = F.array(*(moved("c", "nc", k, s.size + k) for k in range(s.size)))
            table = cut(table.join(changes, "word", "left").select("word", v.alias("v"), c.alias("c")))
        return TextVectorsModel(table.select("word", "v"), s.size, self.words, self.features)


class TextVectorsModel(Model, MLReadable, MLWritable):
    def __init__(self, table: DataFrame, size: int, words: str, features: str) -> None:
        super().__init__()
        self.table, self.size, self.words, self.features = table, size, words, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """The rows with the mean of their words' vectors. Texts alike are looked up once, and found again by their code."""
        prepare(dataset.sparkSession)
        size = self.size
        coded = dataset.withColumn("__key", F.sha2(_joined(self.words), 256))
        texts = cut(coded.select(F.col("__key").alias("key"), _joined(self.words).alias("text")).filter("text <> ''").groupBy("key").agg(F.first("text").alias("text")))
        parts = max(1, math.ceil(texts.count() / ROWS))
        texts = texts.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
        given = _words(texts).select(F.col("part").alias("of"), "word").distinct().join(self.table, "word").groupBy("of")
        run = lambda texts, given: _means(size, texts, given)
        means = cut(texts.groupBy("part").cogroup(given).applyInArrow(run, "key string, mean array<double>"))
        found = coded.join(means.withColumnRenamed("key", "__key"), "__key", "left")
        mean = F.coalesce("mean", F.array_repeat(F.lit(0.0), size))
        return found.select(*dataset.columns, array_to_vector(mean).alias(self.features))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: TextVectorsModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802, Spark ML's name
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, {"size": m.size, "words": m.words, "features": m.features})
        m.table.write.parquet(f"{path}/table")


class _Reader(MLReader):
    def load(self, path: str) -> TextVectorsModel:
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TextVectorsModel(self.sparkSession.read.parquet(f"{path}/table"), about["size"], about["words"], about["features"])
        model._resetUid(about["uid"])
        return model
