"""The inverted file against brute force: exact with all cells, recall with some, refreshed by digest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import search as S
from quillstone.operators import vector_index as X
from quillstone.plans import registry

FOLDER = "/root/testdata/sf0.01"


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    at = {i: n for n, i in enumerate(ids.tolist())}
    out = {}
    for q in queries:
        score = np.round(x @ x[at[q]], 6)
        order = [n for n in np.lexsort((ids, -score)).tolist() if ids[n] != q][:k]
        out[q] = [(int(ids[n]), float(score[n])) for n in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "place").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{FOLDER}/embeddings.parquet")


def test_all_cells_are_exact_and_some_recall(spark, items, monkeypatch):
    rows = [(r["vec_id"], r["embedding"]) for r in items.collect()]
    every = [i for i, _ in rows]
    want = brute(rows, every, 10)
    index = X.saved(spark, items)
    assert len(index.centres) > 20 and index.rows.count() == len(rows)
    got = found(index.exact(items, 10))
    assert {q: [round(s, 5) for _, s in v] for q, v in got.items()} == {q: [round(s, 5) for _, s in v] for q, v in want.items()}
    some = found(index.search(items, 10, probes=len(index.centres) // 2))
    hit = sum(len({i for i, _ in some[q]} & {i for i, _ in want[q]}) for q in every)
    assert hit / (10 * len(every)) >= 0.9
    monkeypatch.setattr(X, "BLOCK", 7)  # many blocks of items and queries give the same
    assert found(index.exact(items.filter("vec_id % 50 = 0"), 10)) == {q: v for q, v in got.items() if q % 50 == 0}


def test_query_recall(spark):
    exact, some = (found(registry.all_queries()[n].run(spark, FOLDER)) for n in ("index_exact", "index_neighbours"))
    assert exact.keys() == some.keys() and len(exact) == 10
    assert sum(len({i for i, _ in exact[q]} & {i for i, _ in some[q]}) for q in exact) >= 0.9 * 10 * len(exact)


def test_odd_vectors_and_none(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(X.Index.build(frame).exact(frame, 2))
    assert got[1] == [(5, 1.0), (2, 0.993884)] and 4 not in got and [s for _, s in got[3]] == [0.0, 0.0]
    nothing = X.Index.build(frame.limit(0))
    assert nothing.rows.count() == 0 and nothing.search(frame.limit(0), 3).count() == 0


def test_refresh_encodes_what_changed(spark, tmp_path):
    encode = lambda rows: S.encoded(rows, "vec_id", F.split("text", " "))
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    old = [(k, f"word{k} word{k % 3} common") for k in range(30)]
    index = X.build_texts(frame(old), encode, cells=4).save(str(tmp_path / "index"))
    new = [(k, t) if k != 5 else (5, "another text") for k, t in old if k != 7] + [(99, "word1 new")]
    fresh, changed = X.refresh(index, frame(new), encode)
    assert sorted(r[0] for r in changed.collect()) == [5, 99]
    want = {r["vec_id"]: (r["digest"], [round(x, 9) for x in r["embedding"]]) for r in X.build_texts(frame(new), encode, cells=4).rows.collect()}
    assert {r["vec_id"]: (r["digest"], [round(x, 9) for x in r["embedding"]]) for r in fresh.rows.collect()} == want
