"""Ranks of sentences against the whole graph's power iteration."""

import re

import numpy as np
from oracle import check, connect
from pyspark.sql import functions as F

from quillstone.operators import summary
from quillstone.plans import registry


def by_matrix(sentences, steps=summary.STEPS, d=summary.DAMPING):
    n = len(sentences)
    c = np.array([[0.0 if i == j else len(a & b) / np.sqrt(len(a) * len(b)) for j, b in enumerate(sentences)] for i, a in enumerate(sentences)])
    total = c.sum(1, keepdims=True)
    c = np.divide(c, total, out=np.zeros_like(c), where=total > 0)
    x = np.full(n, 1 / n)
    for _ in range(steps):
        x = (1 - d) / n + d * (x @ c)
    return x


def test_ranks_are_those_of_the_graph(spark):
    r = np.random.default_rng(3)
    texts = []
    for n in (1, 2, 9, 40):
        texts.append(". ".join(" ".join(f"{chr(97 + int(k))}{chr(97 + int(k) % 7)}" for k in r.integers(0, 20, r.integers(1, 9))) for _ in range(n)))
    texts += ["zz yy. aa bb. zz qq!", "É è. è ü? \n\n ü", None, "", "... !!"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {}
    for x in summary.ranked_sentences(rows, "id", F.col("text")).orderBy("id", "place").collect():
        found.setdefault(x["id"], []).append(x["score"])
    want = {}


    for k, t in enumerate(texts):
        parts = [set(re.findall(r"[^\W\d_]+", s.lower())) for s in re.split(r"[.!?\n]+", t or "")]
        parts = [p for p in parts if p]
        if parts:
            want[k] = by_matrix(parts)
    assert found.keys() == want.keys()
    for k in want:
        assert np.allclose(found[k], want[k], atol=1e-12)
    assert summary.summaries(rows.limit(0), "id", F.col("text")).count() == 0
    assert [x["rank"] for x in summary.summaries(rows.filter("id = 3"), "id", F.col("text"), 5).collect()] == [1, 2, 3, 4, 5]


def test_query(spark):
    found = registry.all_queries()["top_sentences"]
    got, want = check(found.run(spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), found.sql)
    assert got == want and got
