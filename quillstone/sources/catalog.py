"""The catalog: a star of books and link tables, made of the star-schema tables, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import isbn

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


class Catalog:
    """Lazy views; nothing is read that a query doesn't use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._read = lambda name: table(spark, sf_dir, name)

    @property
    def books(self) -> DataFrame:
        return self._read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author_sort"), (F.lit(18262) + F.col("p_partkey") % 1000).alias("modified_day"))

    @property
    def identifiers(self) -> DataFrame:
        part = self._read("part")
        numbers = part.filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("book"), F.lit("isbn").alias("type"), isbn.isbn13_of(F.col("p_partkey")).alias("val"))
        other = part.filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("book"), F.lit("goodreads").alias("type"), F.col("p_partkey").cast("string").alias("val"))
        return numbers.unionByName(other)

    @property
    def isbns(self) -> DataFrame:
        return self.identifiers.filter("type = 'isbn'").select("book", F.col("val").alias("isbn"))

    @property
    def comments(self) -> DataFrame:
        part = self._read("part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("book"))
        return part.join(self._read("documents").select(F.col("doc_id").alias("book"), "text"), "book")

    @property
    def publishers(self) -> DataFrame:
        return self._read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))

    @property
    def books_publishers_link(self) -> DataFrame:
        n = self._read("supplier").agg(F.count("*").alias("n"))  # one row
        return self._read("part").filter("p_partkey % 5 <> 0").crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("book"), (F.col("p_partkey") % F.col("n")).alias("publisher"))

    @property
    def books_tags(self) -> DataFrame:
        """Book and tag name: the words of title and type."""
        part = self._read("part").filter("p_partkey % 3 <> 0")
        return part.select(F.col("p_partkey").alias("book"), F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("tag"))

    @property
    def books_ratings(self) -> DataFrame:
        return self._read("part").select(F.col("p_partkey").alias("book"), (F.col("p_size") % 6).alias("rating"))

    @property
    def data(self) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "R", "PDF").when(F.col("l_returnflag") == "A", "EPUB").otherwise("MOBI")
        return self._read("lineitem").select(F.col("l_partkey").alias("book"), kind.alias("format")).distinct()


_CHECK = "CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(s, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS VARCHAR)"
#: The same views for DuckDB, to begin a query with.
SQL = f"""WITH books AS (SELECT p_partkey AS id, p_name AS title, p_brand AS author_sort, 18262 + p_partkey % 1000 AS modified_day FROM part),
keyed AS (SELECT p_partkey, '978' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS s FROM part),
identifiers AS (
  SELECT p_partkey AS book, 'isbn' AS type, s || {_CHECK} AS val FROM keyed WHERE p_partkey % 4 <> 0
  UNION ALL SELECT p_partkey, 'goodreads', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 7 = 0),
isbns AS (SELECT book, val AS isbn FROM identifiers WHERE type = 'isbn'),
comments AS (SELECT p_partkey AS book, text FROM part JOIN documents ON doc_id = p_partkey WHERE p_partkey % 3 <> 0),
publishers AS (SELECT s_suppkey AS id, s_name AS name FROM supplier),
books_publishers_link AS (SELECT p_partkey AS book, p_partkey % (SELECT count(*) FROM supplier) AS publisher FROM part WHERE p_partkey % 5 <> 0),
books_tags AS (SELECT p_partkey AS book, unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS tag FROM part WHERE p_partkey % 3 <> 0),
books_ratings AS (SELECT p_partkey AS book, p_size % 6 AS rating FROM part),
data AS (SELECT DISTINCT l_partkey AS book, CASE l_returnflag WHEN 'R' THEN 'PDF' WHEN 'A' THEN 'EPUB' ELSE 'MOBI' END AS format FROM lineitem)
"""
