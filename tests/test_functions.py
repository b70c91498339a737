"""Expressions and operators on literal rows."""

from difflib import SequenceMatcher

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import dates, isbn, text
from quillstone.functions import vectors as V
from quillstone.operators import duplicates as D
from quillstone.operators import enrich as E
from quillstone.operators import search as S
from quillstone.operators import text as T
from quillstone.sources import files
from quillstone.sources.sqltool import NotAQuery, answer, run_query


def values(spark, rows, kind, make):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"v {kind}").select(make(F.col("v"))).collect()]


def test_ten_digit_numbers(spark):
    good = ["0306406152", "0-306-40615-2", "043942089X", "0-439-42089-X", "0451524934"]
    bad = ["0306406153", "1234567890", "123", "abcdefghij", "043942089x", "", None]
    assert values(spark, good + bad, "string", isbn.valid10) == [True] * 5 + [False] * 7


def test_thirteen_digit_numbers(spark):
    good = ["9780306406157", "978-0-306-40615-7", "9780547928227", "9780451524935"]
    bad = ["9780306406158", "1234567890123", "123456789012", "12345", None]
    assert values(spark, good + bad, "string", isbn.valid13) == [True] * 4 + [False] * 5
    assert values(spark, ["0306406152", "9780306406157", "12"], "string", isbn.valid) == [True, True, False]


def test_numbers_in_text(spark):
    found = values(spark, ["ISBN: 0-306-40615-2", "ISBN-10: 0306406152", "ISBN-13: 978-0-306-40615-7", "978-0306406157", "Random number: 1234567890", "", None], "string", isbn.extract)
    assert found[:2] == [["0306406152"]] * 2
    assert found[2] == ["9780306406157"] and found[3] == ["9780306406157"]
    assert found[4:] == [[], [], []]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 999_999_999), min_size=1, max_size=20))
def test_made_numbers_are_valid(spark, keys):
    assert all(values(spark, keys, "long", lambda k: isbn.valid13(isbn.isbn13_of(k))))


def test_normal_form(spark):
    assert values(spark, ["The Hobbit", "The Hobbit!!!", "The   Hobbit", "", None, "Café_1"], "string", text.normalize) == ["the hobbit"] * 3 + ["", "", "café_1"]


def test_names(spark):
    assert values(spark, ["Doe, Jane", "Doe, Jane & Roe, Ann", "Solo", "Doe,", "", None], "string", text.names_from_sort) == ["Jane Doe", "Jane Doe & Ann Roe", "Solo", "Doe", "", ""]


def test_previews(spark):
    assert values(spark, ["x" * 200, "x" * 201, None], "string", text.preview) == ["x" * 200, "x" * 200 + "...", None]
    assert values(spark, ["a b  c d"], "string", lambda c: text.first_words(c, 3)) == ["a b c"]


def test_character_runs(spark):
    assert values(spark, ["abcd", "a", ""], "string", lambda c: text.char_ngrams(c, 2)) == [["ab", "bc", "cd"], [], []]


def test_days(spark):
    assert values(spark, ["1970-01-02T12:00:00+00:00", "nonsense", None], "string", dates.day_number) == [1, None, None]


def test_vectors(spark):
    row = spark.sql("SELECT array(1.0D, 0.0D) AS a, array(1.0D, 1.0D) AS b, array(0.0D, 0.0D) AS z")
    got = row.select(F.round(V.cosine(F.col("a"), F.col("b")), 6), V.cosine(F.col("a"), F.col("z")), V.pad(F.col("a"), 3, F.lit(9.0)), V.softmax(F.col("b"))).first()
    assert list(got) == [0.707107, None, [1.0, 0.0, 9.0], [0.5, 0.5]]


def test_overlapping_and_closed_groups(spark):
    rows = spark.createDataFrame([(1, "A"), (2, "a "), (3, "a"), (4, "b"), (5, None), (6, None)], "id int, t string")
    keys = [F.lower(F.trim("t"))]
    assert sorted(map(tuple, D.groups_from_pairs(D.pairs(rows, keys)).collect())) == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3)]
    assert sorted(map(tuple, D.groups_by_key(rows, keys).collect())) == [(1, 1), (1, 2), (1, 3), (5, 5), (5, 6)]


def test_exact_groups_with_lists(spark):
    rows = spark.createDataFrame([(1, "The Hobbit", ["Tolkien"]), (2, "the hobbit!", ["tolkien"]), (3, "The Hobbit Two", ["Tolkien"])], "id int, title string, authors array<string>")
    assert [r["ids"] for r in D.exact_groups(rows, ["title", "authors"]).collect()] == [[1, 2]]
    assert D.exact_groups(rows.limit(0), ["title", "authors"]).collect() == []


def test_identifiers_count_rows_or_records(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "y"), (4, "")], "id int, value string")
    assert sorted(map(tuple, D.identifier_groups(rows, False).collect())) == [("x", 2), ("y", 2)]
    assert sorted(map(tuple, D.identifier_groups(rows, True).collect())) == [("y", 2)]


def test_sequence_ratio_keeps_its_order(spark):
    got = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string").select(D.sequence_ratio("a", "b")).collect()
    assert [r[0] for r in got] == [SequenceMatcher(None, "tide", "diet").ratio(), SequenceMatcher(None, "diet", "tide").ratio()] == [0.25, 0.5]


def test_keeper(spark):
    rows = spark.createDataFrame([(1, 1, ["EPUB"]), (1, 2, ["PDF", "MOBI"]), (1, 3, ["PDF", "MOBI"]), (1, 4, [])], "group_id int, id int, f array<string>")
    scored = rows.select("group_id", "id", D.keeper_score(F.col("f"), ("MOBI", "EPUB", "PDF"), F.lit(5)).alias("score"))
    assert {r["id"]: (r["score"], r["action"]) for r in D.plan(scored).collect()} == {1: (1015, "DELETE"), 2: (2025, "KEEP"), 3: (2025, "DELETE"), 4: (5, "DELETE")}


def test_merges(spark):
    old = spark.createDataFrame([(1, "", "t"), (2, "p", "t"), (3, "0101-01-01T00:00:00+00:00", None)], "id int, p string, title string")
    new = spark.createDataFrame([(1, "q", "u"), (2, "q", "u"), (3, "q", None)], "id int, p string, title string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(E.fill_only(old, new, "id", ["p", "title"], {"p": dates.NO_DATE})) == [(1, "q", "t", 1), (2, "p", "t", 0), (3, "q", None, 1)]
    assert rows(E.overwrite(old, new, "id", ["p", "title"], guarded=["title"])) == [(1, "q", "t", 1), (2, "q", "t", 1), (3, "q", None, 1)]


def test_search_language(spark):
    rows = spark.createDataFrame([(1, "Red Ring", "Ann"), (2, "red box", "Bob")], "id int, title string, author string")
    fields = {c: F.col(c) for c in rows.columns}
    assert [r["id"] for r in rows.filter(S.predicate('title:red AND author:"ann"', fields)).collect()] == [1]
    assert [r["id"] for r in rows.filter(S.predicate("id:2", fields)).collect()] == [2]
    with pytest.raises(ValueError):
        S.predicate("colour:red", fields)


def test_label_alignment(spark):
    row = spark.sql("SELECT array(NULL, 0, 0, 1, NULL) AS w, array(7, 8) AS l")
    assert row.select(T.aligned_labels(F.col("w"), F.col("l"))).first()[0] == [-100, 7, -100, 8, -100]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one,two,en\nno label\n")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "c.dat").write_text("y")
    assert sorted(r["name"] for r in files.text_files(spark, str(tmp_path)).collect()) == ["a.txt", "b.txt"]
    assert list(map(tuple, files.labelled_lines(spark, str(tmp_path / "a.txt")).collect())) == [("one,two", "en")]
    assert files.resource(spark, str(tmp_path), "b") == "x"
    with pytest.raises(KeyError):
        files.resource(spark, str(tmp_path), "zz")
    lines = spark.createDataFrame([(1, 1, "Title : A: B"), (1, 2, "skip"), (1, 3, "Tag: x"), (1, 4, "Tag: y")], "id int, line_no int, line string")
    assert files.fields_of(lines).first()["fields"] == {"Title": ["A: B"], "Tag": ["x", "y"]}


def test_tables_in_files(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("v1,v2\nham,caf\xe9\n".encode("latin-1"))
    assert tuple(files.csv(spark, str(tmp_path / "t.csv"), "v1 string, v2 string", encoding="ISO-8859-1").first()) == ("ham", "café")
    (tmp_path / "t.json").write_text('[{"text": "a", "label": "x"},\n {"text": "b"}]')
    assert sorted(map(tuple, files.json_array(spark, str(tmp_path / "t.json"), "text string, label string").collect())) == [("a", "x"), ("b", None)]
    rows = spark.createDataFrame([("a, b", "en"), ("c", "fr")], "text string, label string")
    files.write_labelled_lines(rows, str(tmp_path / "lines"), seed=1)
    assert sorted(map(tuple, files.labelled_lines(spark, str(tmp_path / "lines")).collect())) == [("a, b", "en"), ("c", "fr")]
    files.append_log(rows, str(tmp_path / "log"))
    files.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert files.concatenated(spark, str(tmp_path), "*.csv").count() == 2


def test_cache_age(spark, tmp_path):
    built = []
    make = lambda: built.append(1) or spark.range(1)
    path = str(tmp_path / "t")
    import time

    for now, force, n in ((None, False, 1), (None, False, 1), (None, True, 2), (time.time() + 3 * 86400, False, 3)):
        files.cached(spark, make, path, 2, now=now, force=force)
        assert len(built) == n


def test_only_queries_run(spark):
    small = "/root/testdata/sf0.001"
    assert run_query(spark, small, "SELECT count(*) AS n FROM region").first()["n"] == 5
    assert answer(spark, small, "SELECT r_name FROM region ORDER BY 1 LIMIT 1")["row_count"] == 1
    assert "error" in answer(spark, small, "SELECT nothing FROM region")
    for bad in ("DROP VIEW region", "CREATE TABLE x AS SELECT 1", "INSERT INTO region SELECT * FROM region", "SET a=b"):
        with pytest.raises(NotAQuery):
            run_query(spark, small, bad)


def test_stream_equals_batch(spark, tmp_path):
    from quillstone.streaming import events as ev

    small = "/root/testdata/sf0.001"
    batch = ev.windowed(spark.read.parquet(f"{small}/events.parquet"))
    stream = ev.run_once(spark, small, "windows_once", str(tmp_path / "cp"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(stream) == rows(batch)
