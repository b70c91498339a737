"""Summaries without a model: sentences ranked by the words that they share.

Two sentences are as alike as the cosine of their sets of words. A sentence's rank is what a walk over such likenesses
comes to: the power iteration of a damped graph within each text. The graph is never written out. A step goes from
sentences to their words and from words back to sentences, so its cost is that of the words, not of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.lineage import prepare

DAMPING, STEPS = 0.85, 30


def sentence_words(text: Column) -> Column:
    """Arrays of distinct lower-case words of the sentences, which end with . ! ? or a line; those without words are empty."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[.!?\n]+")
    return F.transform(parts, lambda s: F.array_distinct(F.filter(F.split(s, r"[^\p{L}]+"), lambda w: w != "")))


def ranks(sentence: np.ndarray, word: np.ndarray, n: int, damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """Ranks of n sentences, given as (sentence, word) pairs, each once. Sentences without a word in common with another pass nothing on."""
    words = int(word.max()) + 1 if len(word) else 0
    norm = np.sqrt(np.maximum(np.bincount(sentence, minlength=n), 1))

    def step(x: np.ndarray) -> np.ndarray:
        """What comes to each sentence from the others; likeness to itself is 1 and taken off."""
        by_word = np.bincount(word, (x / norm)[sentence], words)
        return np.bincount(sentence, by_word[word], n) / norm - x

    degree = step(np.ones(n))
    x, way = np.full(n, 1.0 / n), np.where(degree > 1e-9, 1 / np.maximum(degree, 1e-9), 0)
    for _ in range(steps):
        x = (1 - damping) / n + damping * step(x * way)
    return x


def ranked_sentences(docs: DataFrame, key: str, text: Column, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(key, place, score): the rank of each sentence that has a word, by its place among these in its text, from 1.

    Texts that are null or without words have no rows; repeated rows have theirs each.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key), F.filter(sentence_words(text), lambda s: F.size(s) > 0).alias("s")).filter(F.size("s") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lists = batch.column(1).slice(k, 1).flatten()
                sentence = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                word = lists.flatten().dictionary_encode().indices.to_numpy()
                found = ranks(sentence, word, len(lists), damping, steps)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(found), k))), pa.array(np.arange(1, len(found) + 1)), pa.array(found)], names=[key, "place", "score"])

    return rows.mapInArrow(run, f"`{key}` {kind}, place long, score double")


def summaries(docs: DataFrame, key: str, text: Column, k: int = 3) -> DataFrame:
    """(key, place, score, rank): the k highest sentences of each text, scores to nine places, ties by place."""
    ranked = ranked_sentences(docs, key, text).withColumn("score", F.round("score", 9))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "place", "score"))), 1, k)
    top = ranked.groupBy(key).agg(best.alias("b"))
    return top.select(key, F.posexplode("b").alias("rank", "x")).select(key, "x.place", "x.score", (F.col("rank") + 1).alias("rank"))
