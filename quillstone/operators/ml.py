"""Splits and classifiers on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, RegexTokenizer, StandardScaler, StopWordsRemover, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators import ranges
from quillstone.operators import word_vectors as word_vector_model
from quillstone.operators.text_vectors import TextVectors

#: Texts that one part of the training of word vectors holds.
PART_ROWS = 2000


def split_by_id(rows: DataFrame, key: str, parts: int, test: int) -> DataFrame:
    """Rows with is_test: ids of one residue."""
    return rows.withColumn("is_test", F.col(key) % parts == test)


def split_stratified(rows: DataFrame, key: str, label: str, every: int) -> DataFrame:
    """Rows with is_test: each ``every``-th row of a label, in order of the key's hash."""
    named = rows.withColumn("__code", F.md5(F.col(key).cast("string")))
    found = ranges.numbered(named, [label, "__code", key], "__k")
    first = found.groupBy(F.col(label).alias("__label")).agg(F.min("__k").alias("__first"))  # a row a label
    placed = found.join(first, found[label].eqNullSafe(first["__label"]))
    return placed.withColumn("is_test", (F.col("__k") - F.col("__first") + 1) % every == 0).select(*rows.columns, "is_test")


def text_parts(rows: DataFrame, least: int = 4) -> int:
    """In how many parts word vectors are trained on so many texts: the work of a part doesn't grow with the table."""
    return max(least, math.ceil(rows.count() / PART_ROWS))


def text_pipeline(kind: str, size: int = 512, parts: int = 4) -> Pipeline:
    """Words without stop words, weighted by tf-idf, into a forest, a two-layer network or a linear model; or the mean of the
    words' vectors, trained in ``parts`` parts at once and never gathered, into a linear model."""
    words = [RegexTokenizer(inputCol="text", outputCol="raw", pattern=r"[^\p{L}]+"), StopWordsRemover(inputCol="raw", outputCol="words")]
    if kind == "forest":
        return Pipeline(stages=[*words, CountVectorizer(inputCol="words", outputCol="tf", vocabSize=size), IDF(inputCol="tf", outputCol="features"), RandomForestClassifier(numTrees=100, seed=42)])
    if kind == "network":
        return Pipeline(stages=[*words, HashingTF(inputCol="words", outputCol="tf", numFeatures=128), IDF(inputCol="tf", outputCol="features"), MultilayerPerceptronClassifier(layers=[128, 16, 2], seed=42, maxIter=30)])
    return Pipeline(stages=[*words, TextVectors(parts, word_vector_model.Settings(size=16, window=5, rounds=4, seed=42), least=2), LogisticRegression(maxIter=30)])


def tabular_pipeline(columns: list[str], kind: str = "linear") -> Pipeline:
    """Standardised columns into a linear model, a network with a hidden layer, a perceptron (one without) or a forest."""
    n = len(columns)
    last = {
        "linear": lambda: LogisticRegression(maxIter=30),
        "network": lambda: MultilayerPerceptronClassifier(layers=[n, 16, 2], seed=42, maxIter=60),
        "perceptron": lambda: MultilayerPerceptronClassifier(layers=[n, 2], seed=42, maxIter=60),
        "forest": lambda: RandomForestClassifier(numTrees=100, seed=42),
    }[kind]()
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), last])


def map_batches(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, parts: int | None = None) -> DataFrame:
    """The rows batch by batch through a function, in ``parts`` tasks or as many as there are."""
    dealt = rows if parts is None else rows.repartition(parts)
    return dealt.mapInPandas(lambda batches: map(run, batches), schema)


def fit_predict(pipeline: Pipeline, rows: DataFrame, label: Column, is_test: Column) -> DataFrame:
    """The test rows with label and prediction."""
    named = rows.withColumn("label", label.cast("double"))
    return pipeline.fit(named.filter(~is_test)).transform(named.filter(is_test))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def word_vectors(docs: DataFrame, words: Column, key: str, least: int = 5, settings: word_vector_model.Settings | None = None) -> DataFrame:
    """(word, vector) of words seen ``least`` times or more: skip-gram vectors from the words' parts, of unit length."""
    model = word_vector_model.train(docs, key, words, settings)
    seen = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return model.vectors(seen.select("word"))
