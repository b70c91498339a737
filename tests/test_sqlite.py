"""Databases written by tasks and by SQLite itself, read back range by range with pushed filters."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from quillstone.sources import sqlite

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def catalog(tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "metadata.db"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE books (id INTEGER PRIMARY KEY, title TEXT COLLATE NOCASE, sort TEXT, timestamp TIMESTAMP, series_index REAL, has_cover BOOL, cover BLOB, flags)")
    rows = [(k, f"Title {k}" if k % 2 else f"TITLE {k}", None if k % 3 else "s", "2024-01-01 00:00:00+00:00", k / 4, k % 2, b"\x00\xff", "x") for k in range(1, 101)]
    con.executemany("INSERT INTO books VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    con.execute("INSERT INTO books VALUES (1000000, '', NULL, NULL, 'not a number', NULL, NULL, 7)")
    con.execute("CREATE TABLE pairs (a INTEGER, b TEXT, PRIMARY KEY (a, b)) WITHOUT ROWID")
    con.execute("INSERT INTO pairs VALUES (1, 'x'), (2, 'y')")
    con.execute("CREATE VIEW shown AS SELECT id, title FROM books WHERE id < 5")
    con.execute('CREATE TABLE "odd ""name" ("a b" TEXT)')
    con.commit()
    con.close()
    return str(path)


def test_types_ranges_and_odd_values(spark, catalog):
    books = sqlite.read(spark, catalog, "books")
    assert dict(books.dtypes) == {"id": "bigint", "title": "string", "sort": "string", "timestamp": "string", "series_index": "double", "has_cover": "bigint", "cover": "binary", "flags": "string"}
    got = {x["id"]: x for x in books.collect()}
    assert len(got) == 101 and got[5]["cover"] == b"\x00\xff" and got[8]["series_index"] == 2.0
    assert got[1000000]["series_index"] is None and got[1000000]["flags"] == "7" and got[1000000]["title"] == ""
    assert books.rdd.getNumPartitions() == 5  # ranges of row ids
    assert sqlite.read(spark, catalog, "books", "id", "sort").columns == ["id", "sort"]


@pytest.mark.parametrize("where, n", [("id = 7", 1), ("id > 90 AND id <= 95", 5), ("title = 'Title 7'", 1), ("title = 'title 7'", 0), ("title < 'a'", 101), ("sort IS NULL", 68), ("sort IS NOT NULL", 33), ("id IN (1, 2, 500)", 2), ("title LIKE 'TITLE 1%'", 6), ("series_index >= 20", 21), ("id <=> 3", 1), ("NOT id = 3", 100), ("cover = x'00ff'", 100), ("length(title) = 0", 1)])
def test_filters(spark, catalog, where, n):
    assert sqlite.read(spark, catalog, "books").filter(where).count() == n


def test_filters_reach_the_database(spark, catalog):
    asked = []
    reader = sqlite.Reader({"path": catalog, "dbtable": "books"}, sqlite.read(spark, catalog, "books").schema)
    assert list(reader.pushFilters([sqlite.GreaterThan(("id",), 98), sqlite.StringStartsWith(("title",), "TITLE")])) == [sqlite.GreaterThan(("id",), 98), sqlite.StringStartsWith(("title",), "TITLE")]
    for part in reader.partitions():
        asked += [r for b in reader.read(part) for r in b.column(0).to_pylist()]
    assert asked == [100]  # one row leaves SQLite
    plan = sqlite.read(spark, catalog, "books").filter("id > 98 AND sort = 's'")._jdf.queryExecution().executedPlan().toString()
    assert "quillstone_sqlite" in plan


def test_views_tables_without_row_ids_and_names(spark, catalog):
    found = sqlite.Catalog(spark, catalog)
    assert found.tables() == ["books", 'odd "name', "pairs", "shown"]
    assert found.table("pairs").count() == 2 and found.table("shown").filter("id = 2").count() == 1
    assert found.table('odd "name').count() == 0
    found.register()
    assert spark.sql("SELECT count(*) AS n FROM books b JOIN pairs p ON b.id = p.a").first()["n"] == 2
    with pytest.raises(Exception):
        found.table("elsewhere").count()


def test_nothing_can_be_written_to_a_read_only_database(catalog):
    with sqlite.opened(catalog) as con, pytest.raises(sqlite3.OperationalError):
        con.execute("DELETE FROM books")
    with pytest.raises(FileNotFoundError):
        sqlite.files("/nowhere/at/all.db")
    with pytest.raises(ValueError):
        sqlite.local_path("viewfs://store/x.db")


def test_round_trip(spark, tmp_path):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").repartition(3)
    sqlite.write(lines, str(tmp_path / "lines"), "lineitem")
    assert len(sqlite.files(str(tmp_path / "lines"))) == 3
    back = sqlite.read(spark, str(tmp_path / "lines"), "lineitem").withColumn("l_shipdate", F.to_timestamp_ntz("l_shipdate"))
    back = back.select(*lines.columns)
    assert back.exceptAll(lines.select(*[F.col(c).cast("bigint") if k == "int" else F.col(c) for c, k in lines.dtypes])).count() == 0 and back.count() == lines.count()
    with pytest.raises(Exception):
        sqlite.write(lines, str(tmp_path / "lines"), "lineitem")  # the folder holds databases
    with pytest.raises(Exception):
        sqlite.write(spark.sql("SELECT array(1) AS a"), str(tmp_path / "arrays"), "t")
