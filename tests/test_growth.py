"""Large groups, frequent values and ties: whole results, without making all pairs."""

import numpy as np
from oracle import check, connect
from pyspark.sql import functions as F

from quillstone.functions import isbn
from quillstone.operators import duplicates as D
from quillstone.operators import ml
from quillstone.operators import ranges as R
from quillstone.operators import text as T
from quillstone.plans import registry

ALL = registry.all_queries()


def same_as_sql(spark, folder, name):
    got, want = check(ALL[name].run(spark, str(folder)), connect(str(folder)), ALL[name].sql)
    assert got == want
    return got


def n_exchanged(spark, run):
    """Rows written to shuffles while ``run`` collects."""
    sc = spark.sparkContext
    group = f"count-{run.__name__}"
    sc.setJobGroup(group, group)
    try:
        out = run()
        store, total, seen = sc._jsc.sc().statusStore(), 0, set()
        for job in sc.statusTracker().getJobIdsForGroup(group):
            for stage in sc.statusTracker().getJobInfo(job).stageIds:
                seen.add(stage)
        for stage in seen:
            if sc.statusTracker().getStageInfo(stage):
                total += store.lastStageAttempt(stage).shuffleWriteRecords()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return out, total


def test_padded_floats_are_rounded_as_floats(spark, tmp_path):
    """Products just below a half as doubles, which are a half as floats."""
    x = (np.arange(500, dtype=np.float32) + np.float32(0.5)) / np.float32(1000)
    off = x[np.floor(x * np.float32(1000) + np.float32(0.5)) != np.floor(x.astype(np.float64) * 1000 + 0.5)][:40]
    assert len(off) > 8
    spark.createDataFrame([(i, [float(v), -float(v), 0.25, 1.0, 2.0]) for i, v in enumerate(off)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    same_as_sql(spark, tmp_path, "crop_and_pad")


def test_events_during_errors_are_counted_without_pairs(spark):
    """900 spans over 900 points at 30 places: 405,000 pairs at least, of which none may be shuffled."""
    points = spark.range(900).select((F.col("id") % 30).alias("t"))
    spans = spark.range(900).select("id", (F.col("id") % 20).alias("s"), (F.col("id") % 20 + 15).alias("e"))

    def run():
        return sorted(map(tuple, R.counted_within(spans, "id", ("s", "e"), points, "t").collect()))

    got, moved = n_exchanged(spark, run)
    assert got == [(i, 30 * 15 - 30 * max(0, i % 20 + 15 - 30)) for i in range(900)]
    assert moved < 20_000


def test_events_within_spans_of_all_kinds(spark):
    """Ends are out, empty and reversed spans and nulls hold nothing, spans of one key add up."""
    points = spark.createDataFrame([(1,), (1,), (5,), (9,), (None,), (-3,)], "t long")
    spans = spark.createDataFrame([(1, 1, 5), (2, 5, 5), (3, 9, 2), (4, None, 7), (5, 6, 8), (6, 9, 10), (7, 1, 2), (7, 0, 100), (None, 1, 6)], "k long, s long, e long")
    assert {tuple(r) for r in R.counted_within(spans, "k", ("s", "e"), points, "t").collect()} == {(1, 2), (6, 1), (7, 6), (None, 3)}
    assert R.counted_within(spans, "k", ("s", "e"), points.limit(0), "t").count() == 0


def test_exact_keys_are_not_counted_beside_a_sketch(spark):
    """A sketch a flag and key would be made and shuffled if both were of one aggregate."""
    plan = ALL["approximate"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "percentile_approx" in x and "count(distinct" in x]
    assert not [x for x in plan.splitlines() if "Aggregate [l_returnflag" in x and "l_orderkey" in x.split("]")[0] and "percentile_approx" in x]


def test_approximate_keeps_a_null_flag(spark, tmp_path):
    spark.createDataFrame([(i, None if i % 2 else "A", float(i)) for i in range(1000)], "l_orderkey long, l_returnflag string, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert len(same_as_sql(spark, tmp_path, "approximate")) == 2


def parts(spark, folder, rows):
    """Tables of which the catalog makes books: ids, titles and authors."""
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(str(folder / "part.parquet"))
    spark.createDataFrame([(i, "Worthless" if i % 5 == 0 else None if i % 7 == 0 else "good") for i in range(1, 40)], "doc_id long, text string").write.parquet(str(folder / "documents.parquet"))


def test_pairs_of_repeated_ids_and_large_groups(spark, tmp_path, monkeypatch):
    """Ids that come twice, under one key or several, nulls, and a group of several blocks."""
    monkeypatch.setattr(D, "BLOCK", 8)
    monkeypatch.setattr(D, "PAIRS", 50)
    rows = [(i, "One ", "a") for i in range(1, 31)] + [(i, "two", "b") for i in range(25, 35)]
    rows += [(40, "two", "B"), (40, "two", "b"), (41, None, "b"), (42, "two", None), (50, "alone", "x"), (60, "three", "x"), (60, "Three", "x"), (61, "three", "x")]
    parts(spark, tmp_path, rows)
    got = same_as_sql(spark, tmp_path, "list_extend")
    assert (50, 1) not in got and len({r[0] for r in got}) == 34 + 1 + 2
    same_as_sql(spark, tmp_path, "dup_groups_pairs")
    same_as_sql(spark, tmp_path, "dup_pairs")


def test_lists_are_counted_without_pairs(spark, tmp_path):
    parts(spark, tmp_path, [(i, "title", "x") for i in range(800)])

    def run():
        return sorted(map(tuple, ALL["list_extend"].run(spark, str(tmp_path)).collect()))

    got, moved = n_exchanged(spark, run)
    assert got == [(i, i + 1 if i < 799 else 799) for i in range(800)]
    assert moved < 10_000  # of 319,600 pairs


def test_groups_of_pairs_are_not_shuffled(spark, tmp_path):
    parts(spark, tmp_path, [(i, "title", "x") for i in range(400)])

    def run():
        return ALL["dup_groups_pairs"].run(spark, str(tmp_path)).count()

    def pairs():
        return ALL["dup_pairs"].run(spark, str(tmp_path)).count()

    got, moved = n_exchanged(spark, run)
    assert got == 400 * 399 // 2 + 399 and moved < 10_000
    assert n_exchanged(spark, pairs)[1] < 10_000


def test_numbers_are_made_once(spark):
    """A number that is used in several places of an expression was made at each, within loops over its digits."""
    plan = ALL["isbn_generate"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("p_partkey#") <= 12
    rows = spark.createDataFrame([("0-306-40615-2",), ("030640615x",), (None,), ("978 0306406157",)], "v string")
    got = rows.select(isbn.valid10(F.col("v")), isbn.valid13(F.col("v")), isbn.valid(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (False, False, False), (False, False, False), (False, True, True)]


def test_grams_are_counted_where_they_are_read(spark, monkeypatch):
    """Any characters, null labels, repeated keys; a text's grams are no rows of their own."""
    monkeypatch.setattr(T, "SLICE", 7)
    texts = ["abcabca", "ab", "", None, "ébé漢😀漢😀漢", "a", "abcé", "zzz"]
    docs = spark.createDataFrame([(i % 6, t, [None, "x", "y"][i % 3]) for i, t in enumerate(texts)], "id long, text string, lang string").coalesce(1)
    n = {}
    for i, t in enumerate(texts):
        for size in (2, 3):
            for k in range(len(t or "") - size + 1):
                key = ([None, "x", "y"][i % 3], t[k : k + size])
                n[key] = n.get(key, 0) + 1
    profile = T.ngram_profile(docs, F.col("text"), "lang", (2, 3), 100)
    assert {(r["lang"], r["gram"]): r["n"] for r in profile.collect()} == n
    scores = {}
    for i, t in enumerate(texts):
        for lang in (None, "x", "y"):
            s = sum((lang, t[k : k + size]) in n for size in (2, 3) for k in range(len(t or "") - size + 1))
            if s:
                scores[i % 6, lang] = scores.get((i % 6, lang), 0) + s
    got = T.profile_scores(docs, F.col("text"), "id", profile, "lang", (2, 3))
    assert {(r["id"], r["lang"]): r["score"] for r in got.collect()} == scores
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    long = T.ngram_profile(docs, F.col("text"), "lang", (4,), 100)
    assert T.profile_scores(docs, F.col("text"), "id", long, "lang", (4,)).count() > 0


def test_groups_of_like_titles_without_pairs_of_records(spark):
    """Records of one title share their group; of repeated ids the groups are those of pairs."""
    rows = [(i, ["green metal box", "green metal bax", "other", "alone"][i % 4 if i > 1 else 3], "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, title string, kind string").coalesce(1)

    def run():
        return D.like_groups(docs.filter("id < 397 OR title <> 'alone'"), ["kind"], "title", 0.85).collect()

    got, moved = n_exchanged(spark, run)
    by = lambda *names: sorted(i for i, t, _ in rows if t in names)
    want = {i: by("green metal box", "green metal bax") if "green" in t else by(t) for i, t, _ in rows}
    assert {r["group_id"]: r["ids"] for r in got} == {i: [j for j in v if j != 399 or "alone" != rows[i][1]] for i, v in want.items() if i != 399}
    assert moved < 10_000
    twice = docs.filter("id < 12").unionByName(docs.filter("id = 2 OR id = 4"))
    pairs = D.similar_groups(D.similar_titles(twice, ["kind"], "title", 0.85, both_ways=True))
    assert sorted(map(tuple, D.like_groups(twice, ["kind"], "title", 0.85).collect())) == sorted(map(tuple, pairs.collect()))


def test_groups_of_page_titles_without_pairs(spark, tmp_path):
    """Titles of 20 syllables: nearly all pairs share common grams, and none of them may be shuffled."""
    r = np.random.default_rng(3)
    parts = [a + b for a in "thrnd" for b in "aeio"]
    rows = [(k, f"<title>{''.join(r.choice(parts, 20))}</title>") for k in range(1200)]
    rows += [(k + 1200, rows[k][1].replace("<title>", "<title>x")) for k in range(0, 1200, 100)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))

    def groups():
        return [tuple(x) for x in ALL["title_groups"].run(spark, str(tmp_path)).select("page_id", "group_id", "n_links").collect()]

    got, moved = n_exchanged(spark, groups)
    assert len(got) == 1212 and {(k + 1200, k) for k in range(0, 1200, 100)} <= {x[:2] for x in got}
    assert moved < 1212 * 1211 // 4


def test_parts_of_word_vectors_grow_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(ml, "PART_ROWS", 10)
    docs = spark.createDataFrame([(k, f"good word{k % 7}" if k % 2 else f"bad term{k % 5}", k % 2) for k in range(100)], "id long, text string, y int")
    parts = ml.text_parts(docs)
    pipeline = ml.text_pipeline("vectors", parts=parts)
    assert parts == 10 and [s.getNumPartitions() for s in pipeline.getStages() if hasattr(s, "getNumPartitions")] == [10]
    assert ml.text_parts(docs.limit(0)) == 4
    got = ml.fit_predict(pipeline, docs, F.col("y"), F.col("id") % 4 == 0)
    assert got.count() == 25 and got.filter("prediction IS NULL").count() == 0


def test_letters_are_kept_as_by_sql(spark, tmp_path):
    """Every character below 256 and some beyond, white space of all kinds, and letters whose lower case is ASCII."""
    odd = "".join(map(chr, [*range(1, 256), 0x130, 0x212A, 0x2028, 0x3000, 0xFFFF, 0x1F600]))
    texts = [odd, odd[::-1], "a\x0bb", "A.. b--C\t\n d\r\x0c", "", None, "  ", "😀x😀"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    same_as_sql(spark, tmp_path, "clean_alpha")


def test_best_weights_of_a_vocabulary_that_is_not_sent_whole(spark, tmp_path, monkeypatch):
    """Of 900 words only a few are sent to tasks; rows of the others alone are shuffled by word."""
    monkeypatch.setattr(T, "FEW_WORDS", 40)
    name = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3))
    texts = [" ".join([name(k % 9), name(k % 9), name(k % 30), *(name(k * j % 41) for j in range(60)), *(name(100 + 4 * k + j) for j in range(4))]) for k in range(200)]
    rows = [(k, t) for k, t in enumerate([*texts, "", None, "aaa", " ".join(name(i) for i in range(100, 150))])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def best():
        return same_as_sql(spark, tmp_path, "tfidf_top")

    got, moved = n_exchanged(spark, best)
    assert len(got) == 3 * 201 + 1
    # Texts, partitions' different words, rare words' rows by word and by text: not each text's words by word and by text.
    assert moved < 1.6 * sum(len(set(t.split())) for t in texts)
