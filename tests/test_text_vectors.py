"""Means of word vectors whose table stays in the cluster: rows, means by hand, reruns, saved models, and what the driver holds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import ml
from quillstone.operators.text_vectors import TextVectors
from quillstone.operators.word_vectors import Settings

SMALL = Settings(size=4, window=3, rounds=2, seed=1)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    themes = [[f"{a}{b}" for b in "bcdfg"] for a in ("ka", "mo")]
    rows = [(k, [r.choice(themes[k % 2]) for _ in range(12)] + [f"once{k}"]) for k in range(60)]
    rows += [(60, []), (61, None), (62, ["alone"]), (63, rows[0][1]), (64, rows[0][1])]
    return spark.createDataFrame(rows, "id long, words array<string>")


def test_means_are_of_all_words_of_a_text(spark, docs):
    model = TextVectors(3, SMALL).fit(docs)
    table = {r["word"]: np.array(r["v"]) for r in model.table.collect()}
    assert "alone" not in table and "kab" in table and {f"once{k}" for k in range(60)} & set(table) == {"once0"}
    got = {r["id"]: r for r in model.transform(docs).collect()}
    assert len(got) == docs.count() and list(got[0].asDict()) == ["id", "words", "features"]
    for r in got.values():
        words = r["words"] or []
        want = sum((table.get(w, np.zeros(4)) for w in words), np.zeros(4)) / max(len(words), 1)
        assert np.allclose(r["features"].toArray(), want)


def test_reruns_agree_and_words_of_a_theme_are_near(spark, docs):
    first, again = (sorted(map(tuple, TextVectors(3, Settings(size=8, window=3, rounds=4)).fit(docs).table.collect())) for _ in range(2))
    assert first == again
    v = {w: np.array(x) / np.linalg.norm(x) for w, x in first}
    within, across = (np.mean([v[a + x] @ v[b + y] for a, b in pairs for x in "bcdfg" for y in "bcdfg" if a + x != b + y]) for pairs in ([("ka", "ka"), ("mo", "mo")], [("ka", "mo")]))
    assert within > across + 0.2


def test_vocabulary_is_not_gathered(spark, monkeypatch):
    """3,000 words, of which none comes to the driver: neither as rows nor in a broadcast."""
    docs = spark.createDataFrame([(k, " ".join(["good" if k % 2 else "bad", *(f"w{'abcdefghij'[d]}{'xyz'[k % 3]}" * (1 + k % 9) for d in range(10))]), k % 2) for k in range(300)], "id long, text string, y int")
    held = []
    for name in ("collect", "toPandas"):
        of = getattr(type(docs), name)
        monkeypatch.setattr(type(docs), name, lambda self, of=of: held.append(of(self)) or held[-1])
    sent = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: held.append(x) or sent(self, x))
    pipeline = ml.text_pipeline("vectors", parts=4)
    assert not any(type(s).__module__ == "pyspark.ml.feature" and hasattr(s, "getVectorSize") for s in pipeline.getStages())
    got = ml.fit_predict(pipeline, docs, F.col("y"), F.col("id") % 4 == 0)
    assert got.count() == 75
    assert sum(map(len, held)) < 100


def test_saved_models_predict_the_same(spark, tmp_path):
    docs = spark.createDataFrame([(k, "good word here" if k % 2 else "bad term there", float(k % 2)) for k in range(40)], "id long, text string, label double")
    model = ml.text_pipeline("vectors", parts=2).fit(docs)
    ml.save(model, str(tmp_path / "model"))
    first, again = (sorted(map(tuple, m.transform(docs).select("id", "prediction").collect())) for m in (model, ml.load(str(tmp_path / "model"))))
    assert first == again and {p for k, p in first if k % 2} == {1.0}
