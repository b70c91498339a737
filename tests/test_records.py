"""Operators on literal rows, against plain Python."""

import datetime
import difflib
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.functions import vectors as V
from quillstone.operators import duplicates as D
from quillstone.operators import enrich as E
from quillstone.operators import ml
from quillstone.operators import ranges as R
from quillstone.operators import search as S
from quillstone.operators import stats as A
from quillstone.operators import text as T
from quillstone.sources import files


def test_quantiles_are_exact(spark):
    r = random.Random(1)
    for values in ([r.gauss(0, 1) for _ in range(997)], [float(r.randint(0, 3)) for _ in range(500)], [5.0], [1.0, 2.0]):
        rows = spark.createDataFrame([(v, -v) for v in values] + [(None, None)], "a double, b double")
        got = {(x["name"], x["share"]): x["value"] for x in A.quantiles(rows, ["a", "b"], (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
        for share in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert got["a", share] == pytest.approx(np.quantile(values, share))
            assert got["b", share] == pytest.approx(np.quantile([-v for v in values], share))
    none = spark.createDataFrame([(None,)], "a double")
    assert A.quantiles(none, ["a"], (0.5,)).count() == 0
    one = A.describe(rows, ["a"]).first()
    assert one["n"] == 2 and one["median"] == 1.5 and one["deviation"] == round(statistics.stdev([1.0, 2.0]), 4)


def test_as_of_takes_the_last_before(spark):
    r = random.Random(2)
    left = [(k, r.randint(0, 4), r.randint(0, 50)) for k in range(200)]
    right = [(r.randint(0, 4), r.randint(0, 50), k) for k in range(60)]
    a, b = spark.createDataFrame(left, "id long, who long, at long"), spark.createDataFrame(right, "who long, at long, value long")
    got = {x["id"]: x["value"] for x in R.as_of(a, b, ["who"], "at", ["value"]).collect()}
    want = {}
    for k, who, at in left:
        before = [(t, v) for w, t, v in right if w == who and t <= at]
        want[k] = max(before)[1] if before else None
    assert got == want
    assert R.as_of(a, b.limit(0), ["who"], "at", ["value"]).filter("value IS NULL").count() == 200


def test_similar_titles_against_all_pairs(spark):
    r = random.Random(3)
    titles = ["The Return of the King", "the return of a king", "Return of the King, The", "War and Peace", "War & Peace", "A", "AB", "", "  ", "The Return of the Kings!"]
    titles += [" ".join(r.choice(["red", "blue", "grey", "old", "new", "sea"]) for _ in range(r.randint(1, 5))) for _ in range(60)]
    rows = spark.createDataFrame([(k, t, "x" if k % 2 else "y") for k, t in enumerate(titles)], "id long, title string, by string")
    plain = [" ".join("".join(c for c in t.lower() if c.isalnum() or c in "_ ").split()) for t in titles]
    for least in (0.6, 0.85):
        got = {(x["id1"], x["id2"]): x["ratio"] for x in D.similar_titles(rows, ["by"], "title", least, "sequence", True, normal=True).collect()}
        want = {}
        for i, a in enumerate(plain):
            for j, b in enumerate(plain):
                if i != j and i % 2 == j % 2 and a and b and (q := difflib.SequenceMatcher(None, a, b).ratio()) >= least:
                    want[i, j] = q
        assert got == pytest.approx(want)
        groups = {x["group_id"]: x["ids"] for x in D.similar_groups(spark.createDataFrame([(i, j) for i, j in want], "id1 long, id2 long")).collect()}
        assert groups == {i: sorted({i} | {j for a, j in want if a == i}) for i, _ in want}


def test_modes_of_a_run(spark):
    books = spark.createDataFrame([(k, f"t{k}") for k in range(6)], "id long, title string")
    planned = spark.createDataFrame([(0, 0, "KEEP"), (0, 1, "DELETE"), (2, 2, "KEEP"), (2, 3, "DELETE"), (4, 4, "KEEP"), (4, 5, "DELETE")], "group_id long, id long, action string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    for mode, left, gone in (("find-only", 6, []), ("dry-run", 6, []), ("auto-delete", 3, [1, 3, 5])):
        rest, log, summary = D.carry_out(books, planned, mode)
        assert rest.count() == left and ids(log) == gone and tuple(summary.first()) == (mode, 3, 3)
    answers = spark.createDataFrame([(0, 1), (2, None), (4, 99)], "group_id long, keeper long")
    rest, log, summary = D.carry_out(books, planned, "interactive", answers)
    assert ids(log) == [0, 5] and ids(rest) == [1, 2, 3, 4] and tuple(summary.first()) == ("interactive", 2, 2)
    for bad in ("delete", "interactive"):
        with pytest.raises(ValueError):
            D.carry_out(books, planned, bad)


def test_prompts_need_a_known_name_and_their_arguments(spark):
    given = lambda name, **a: spark.range(1).select(X.filled(F.lit(name), F.create_map(*[F.lit(x) for kv in a.items() for x in kv])).alias("p")).first()["p"]
    assert given("analyze-menu", menu="m1") == "Menu: m1\nFocus: all"
    assert given("recommend-dish", preference="hot", budget="low") == "Wanted: hot\nBudget: low"
    for name, a in (("nothing", {"menu": "m"}), ("explain-dish", {"menu": "m"})):
        with pytest.raises(Exception, match="unknown prompt|needs"):
            given(name, **a)


def test_menu_items(spark):
    menu = "Menu\n\n【Drinks】\nTea - ¥450\nWater - 無料\n\n【Food】\nBread (hot) - ¥1,350\nnot an item\n"
    got = [tuple(r) for r in X.menu_items(spark.createDataFrame([(1, menu), (2, None), (3, "")], "k long, t string"), "k", F.col("t")).collect()]
    assert sorted(got) == [(1, "【Drinks】", "Tea", 450), (1, "【Drinks】", "Water", 0), (1, "【Food】", "Bread (hot)", 1350)]


def test_calculator_refuses(spark):
    value = lambda op, a, b: spark.createDataFrame([(op, a, b)], "op string, a double, b double").select(V.calculate(F.col("op"), F.col("a"), F.col("b")).alias("x")).first()["x"]
    assert [value(op, 6.0, 3.0) for op in ("add", "subtract", "multiply", "divide")] == [9.0, 3.0, 18.0, 2.0]
    for op, b in (("divide", 0.0), ("power", 2.0)):
        with pytest.raises(Exception, match="zero|unknown operation"):
            value(op, 1.0, b)


def test_encoder_and_hits(spark):
    rows = spark.createDataFrame([(1, "red fox"), (2, "fox red"), (3, "blue sea"), (4, ""), (5, None)], "id long, text string")
    found = {r["id"]: r["embedding"] for r in S.encoded(rows, "id", X.words(F.col("text"))).collect()}
    assert found[1] == found[2] != found[3] and found[4] is None and found[5] is None
    assert all(abs(sum(x * x for x in found[k]) - 1) < 1e-9 for k in (1, 2, 3))
    shown = S.hits(spark.createDataFrame([(1, 0.5), (9, 0.4)], "id long, score double"), rows.withColumn("title", F.lit("")), F.col("text")).collect()
    assert shown[0]["title"] == "Unknown" and set(S.HIT_FIELDS) <= set(shown[0].asDict()) and len(shown) == 2


def test_gram_matrix(spark):
    x = np.random.default_rng(1).normal(size=(37, 5))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, None)], "id long, embedding array<double>").repartition(3)
    got = {(r["i"], r["j"]): r["product"] for r in S.gram(rows).collect()}
    assert got == pytest.approx({(i, j): (x.T @ x)[i, j] for i in range(5) for j in range(5)})


def test_lookup_by_identifier(spark):
    rows = spark.createDataFrame([(1, "isbn:9780306406157"), (2, "amazon:B000000001"), (3, "isbn:0"), (4, None)], "id long, identifier string")
    known = spark.createDataFrame([("978-0-306-40615-7", "A", {"amazon": "B000000009"}), (None, "B", {"amazon": "B000000001"})], "isbn string, title string, identifiers map<string,string>")
    got = {r["id"]: (r["success"], r["error"], r["found"] and r["found"]["title"]) for r in E.found_by_identifier(rows, known).collect()}
    assert got == {1: (True, None, "A"), 2: (True, None, "B"), 3: (False, "nothing found", None), 4: (False, "No ISBN or ASIN found", None)}
    assert tuple(E.counted(E.found_by_identifier(rows, known)).first()) == (4, 2, 2)


def test_profiles_too_many_to_send(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "abab", "x"), (2, "cdcd", "y"), (3, "abcd", "x")], "id long, t string, lang string")
    profile = T.ngram_profile(docs, F.col("t"), "lang", (2, 3), 3)
    few = sorted(map(tuple, T.profile_scores(docs, F.col("t"), "id", profile, "lang", (2, 3)).collect()))
    monkeypatch.setattr(T, "FEW_PROFILES", 1)
    assert sorted(map(tuple, T.profile_scores(docs, F.col("t"), "id", profile, "lang", (2, 3)).collect())) == few
    tf = sorted(map(tuple, T.tfidf(docs, "id", F.split("t", "b")).collect()))
    monkeypatch.setattr(T, "FEW_WORDS", 0)
    assert sorted(map(tuple, T.tfidf(docs, "id", F.split("t", "b")).collect())) == tf


def test_files_and_caches(spark, tmp_path):
    folder = tmp_path / "meta"
    folder.mkdir()
    (folder / "a.txt").write_text("Title : One\nIdentifiers : isbn:9780306406157, amazon:B0\nComments : see 0-306-40615-2\n")
    (folder / "b.txt").write_text("Title : Two\n")
    assert {r["name"]: r["isbns"] for r in files.isbns_in_files(spark, str(folder)).collect()} == {"a.txt": ["0306406152", "9780306406157"], "b.txt": []}
    assert [r["name"] for r in files.resources(spark, str(folder)).collect()] == ["a", "b"]
    rows = spark.createDataFrame([(1, [0.5, 1.5])], "id long, embedding array<double>")
    files.write_vectors(rows, str(tmp_path / "v"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "v")).collect()] == [(1, [0.5, 1.5])]
    files.write_json(rows, str(tmp_path / "j"))
    assert [tuple(r) for r in files.read_json(spark, str(tmp_path / "j"), "id long, embedding array<double>").collect()] == [(1, [0.5, 1.5])]
    (tmp_path / "n.csv").write_text("Basket,Apples,Bananas\nB1,3,0.5\nB2,,7\n")
    table = files.csv(spark, str(tmp_path / "n.csv"), "Basket string, Apples int, Bananas double")
    assert [tuple(r) for r in table.collect()] == [("B1", 3, 0.5), ("B2", None, 7.0)]


def test_models_persist_and_predict(spark, tmp_path):
    r = random.Random(4)
    rows = spark.createDataFrame([(k, (k % 2) * 2.0 + r.random(), r.random(), float(k % 2)) for k in range(200)], "id long, a double, b double, label double")
    for kind in ("linear", "network", "perceptron", "forest"):
        model = ml.tabular_pipeline(["a", "b"], kind).fit(rows.filter("id % 4 <> 0"))
        ml.save(model, str(tmp_path / kind))
        test = rows.filter("id % 4 = 0")
        first, again = model.transform(test), ml.load(str(tmp_path / kind)).transform(test)
        assert first.filter("prediction = label").count() >= 48
        assert [x["prediction"] for x in first.orderBy("id").collect()] == [x["prediction"] for x in again.orderBy("id").collect()]


def test_batches_mapped(spark):
    rows = spark.createDataFrame([(k, k * 2) for k in range(10)], "id long, x long")
    got = ml.map_batches(rows, lambda batch: batch.assign(x=batch["x"] + 1), "id long, x long", parts=3)
    assert sorted(tuple(r) for r in got.collect()) == [(k, 2 * k + 1) for k in range(10)] and got.rdd.getNumPartitions() == 3


def test_histogram_and_masked_scores(spark):
    rows = spark.createDataFrame([(0.0,), (0.49,), (0.5,), (1.0,), (1.2,), (None,)], "x double")
    assert {r["bin"]: r["n"] for r in A.histogram(rows, "x", 0.0, 1.0, 2).collect()} == {0: 2, 1: 2}
    said = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (-100, 1)], "truth int, predicted int")
    assert tuple(A.weighted_report(said, "truth", "predicted", -100).first()) == (round((1 * 2 + 0.5) / 3, 6), round((0.5 * 2 + 1) / 3, 6), round((0.666667 * 2 + 0.666667) / 3, 6), 3)


def test_sentences_and_tokens(spark):
    row = spark.createDataFrame([("One two. Don't stop?!  Yes\nno.",)], "t string").select(X.sentences(F.col("t")).alias("s"), X.word_tokens(F.lit("Don't stop?!")).alias("w")).first()
    assert row["s"] == ["One two.", "Don't stop?!", "Yes\nno."] and row["w"] == ["Don't", "stop", "?", "!"]


def test_dates_stay(spark):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1))], "id long, at timestamp")
    assert R.as_of(rows.withColumn("k", F.lit(1)), rows.select(F.lit(1).alias("k"), "at", F.lit(7).alias("v")), ["k"], "at", ["v"]).first()["v"] == 7
