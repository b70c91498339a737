"""The library object on the records of a small shelf."""

import pytest
from pyspark.sql import functions as F

from quillstone import api


@pytest.fixture(scope="module")
def shelf(spark):
    rows = [
        {"id": 1, "title": "The Lantern", "authors": ["Amara Voss"], "publisher": "A", "tags": ["fantasy"], "comments": "<p>One</p>", "identifiers": {"isbn": "9781402894626"}},
        {"id": 2, "title": "the lantern!", "authors": ["amara voss"], "publisher": None, "tags": [], "comments": None, "identifiers": {"isbn": "9781402894626"}},
        {"id": 3, "title": "1977", "authors": ["Jun Okafor"], "publisher": "B", "tags": ["x"], "comments": "ISBN 0198526636", "identifiers": {}},
    ]
    library = api.of_rows(spark, rows)
    known = spark.createDataFrame([("9781402894626", "The Lantern", "C")], "isbn string, title string, publisher string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "id long, embedding array<double>")
    return api.Library(library.books, vectors, known)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_reading(shelf):
    assert ids(shelf.list_books()) == [3, 1, 2] and ids(shelf.list_books("lantern", limit=1)) == [1]
    assert ids(shelf.search("author:okafor AND title:19")) == [3] and ids(shelf.details(2)) == [2]
    assert shelf.numbered.filter("id = 3").first()["isbn"] == "0198526636"
    assert sorted(ids(shelf.books_with_isbn("978-1-4028-9462-6"))) == [1, 2]
    assert shelf.isbns_in("ISBN: 0-306-40615-2") == ["0306406152"] and shelf.isbn_is_valid("9781402894626")


def test_duplicates(shelf, tmp_path):
    assert sorted((r["kind"], r["ids"]) for r in shelf.find_duplicates().collect()) == [("exact", [1, 2]), ("isbn", [1, 2])]
    assert shelf.similar_titles().count() == 0  # written unlike, the authors are two
    two = shelf.add(shelf.books.filter("id = 1").withColumn("id", F.lit(7).cast("long")).withColumn("title", F.lit("The Lanterns")))
    assert sorted((r["kind"], r["ids"]) for r in two.find_duplicates().collect()) == [("exact", [1, 2]), ("isbn", [1, 2, 7]), ("similar", [1, 7]), ("similar", [1, 7])]
    report = two.duplicate_report()
    assert report.index("## exact") < report.index("## isbn") < report.index("## similar") and "- 7: The Lanterns" in report
    two.write_duplicate_report(str(tmp_path / "report"))
    written = {r["kind"]: r["value"] for r in shelf.spark.read.text(str(tmp_path / "report")).filter("value LIKE '- 7:%'").collect()}
    assert sorted(written) == ["isbn", "similar"]
    planned = shelf.spark.createDataFrame([(1, 1, "KEEP"), (1, 2, "DELETE")], "group_id long, id long, action string")
    left, log, summary = shelf.remove_duplicates(planned, "auto-delete")
    assert sorted(ids(left.books)) == [1, 3] and ids(log) == [2] and summary.first()["n_deleted"] == 1


def test_gaps_and_updates(shelf):
    assert [(r["id"], r["missing"]) for r in shelf.needing_enrichment(["publisher"]).collect()] == [(2, ["publisher", "tags", "comments"])]
    found = sorted((r["id"], r["field"], r["reason"]) for r in shelf.suggestions().collect())
    assert found == [(1, "publisher", "Different"), (2, "publisher", "Missing"), (2, "title", "Different")]
    after = {r["id"]: (r["title"], r["publisher"]) for r in shelf.apply(["publisher"]).books.collect()}
    assert after == {1: ("The Lantern", "C"), 2: ("the lantern!", "C"), 3: ("1977", "B")}
    assert shelf.fetch_metadata(title="the lantern").count() == 1
    with pytest.raises(ValueError):
        shelf.fetch_metadata()


def test_writing(spark, shelf):
    assert sorted(ids(shelf.remove([1]).books)) == [2, 3]
    assert shelf.add(shelf.books.filter("id = 3").withColumn("id", F.lit(9).cast("long"))).books.count() == 4
    changed, outcome = shelf.bulk_comments(spark.createDataFrame([(1,), (7,)], "id long"), "note")
    assert changed.details(1).first()["comments"] == "note" and tuple(outcome.first()) == (1, 1, 2)
    assert shelf.add_isbn(3, "978-0-19-852663-6").details(3).first()["isbn"] == "9780198526636"


def test_vector_search(spark, shelf):
    query = spark.createDataFrame([([1.0, 0.1],)], "embedding array<double>")
    assert [(r["id"], r["description_preview"]) for r in shelf.semantic_search(query, 2).collect()] == [(1, "One"), (3, "ISBN 0198526636")]


def test_enrichment(spark, shelf):
    got = {r["id"]: (r["identifier"], r["success"]) for r in shelf.enrich().collect()}
    assert got == {1: ("isbn:9781402894626", True), 2: ("isbn:9781402894626", True), 3: (None, False)}
    assert [r["id"] for r in shelf.batch_enrich(["publisher"], 5).collect()] == [2]
    assert shelf.fetch_metadata(identifiers=["isbn:9781402894626"]).count() == 1 and shelf.fetch_metadata(identifiers=["goodreads:1"]).count() == 0


def test_search_by_text_and_cache(spark, shelf, tmp_path):
    query = spark.createDataFrame([("a lantern",)], "text string")
    found = shelf.indexed().search_text(query, 2).collect()
    assert [r["id"] for r in found][0] in (1, 2) and found[0]["score"] > 0
    path = str(tmp_path / "index")
    first = shelf.cached_index(path)
    assert first.vectors.count() == 3 and shelf.remove([3]).cached_index(path).vectors.count() == 3
    assert shelf.remove([3]).cached_index(path, force=True).vectors.count() == 2


def test_forms_of_a_record(shelf):
    xml = shelf.details(1, as_opf=True).first()["opf"]
    assert "<dc:title>The Lantern</dc:title><dc:creator>Amara Voss</dc:creator>" in xml and 'scheme="isbn">9781402894626<' in xml
    assert shelf.convert(3, "TXT").first()["text"].startswith("Title: 1977\n") and '"id":3' in shelf.convert(3, "json").first()["text"]
    with pytest.raises(ValueError):
        shelf.convert(1, "mobi")


def test_tools(spark, shelf):
    tools = shelf.tools("/root/testdata/sf0.001")
    assert len(tools.names) == 22 and tools.call("nothing", {}) == "Unknown tool: nothing"
    assert tools.call("isbn_validate", {"isbn": "9781402894626"}) is True and tools.call("isbn_extract_from_text", {"text": "0198526636"}) == ["0198526636"]
    assert tools.call("sql", {"query": "SELECT count(*) AS n FROM region"}).first()["n"] == 5
    assert ids(tools.call("isbn_get_book_isbn", {"book_id": 3})) == [3] and tools.call("semantic_search", {"query": "lantern", "top_n": 1}).count() == 1
    tools.call("remove_book", {"book_id": 3})
    assert sorted(ids(tools.call("list_books", {}))) == [1, 2]
    assert tools.call("batch_enrich_books", {}).count() == 1 and tools.call("enrich_book_metadata", {"book_id": 1}).first()["success"]
    assert tools.call("bulk_update_comments", {"book_ids": [1], "comments": "x"}).details(1).first()["comments"] == "x"
    steps = iter([("isbn_validate", {"isbn": "1"}), ("unheard", {}), None])
    assert tools.converse(lambda done: next(steps)) == [("isbn_validate", False), ("unheard", "Unknown tool: unheard")]
    for name, a in (("set_book_metadata", {"changes": spark.createDataFrame([(1, "T")], "id long, title string")}), ("add_book", {"rows": shelf.books.filter("id = 3")}), ("apply_metadata_updates", {}), ("find_books_needing_enrichment", {}), ("convert_book", {"book_id": 1, "output_format": "opf"}), ("get_book_details", {"book_id": 1, "as_opf": True}), ("fetch_metadata_by_title", {"title": "the lantern"}), ("fetch_metadata_by_identifier", {"identifier_type": "isbn", "identifier_value": "9781402894626"}), ("isbn_find_books", {"isbn": "9781402894626"}), ("find_duplicates", {}), ("search_library", {"query": "title:lantern"})):
        result = tools.call(name, a)
        assert (result.books if isinstance(result, api.Library) else result).count() > 0, name
