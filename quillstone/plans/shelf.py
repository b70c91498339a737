"""Queries through the library object: enrichment in batches, identifiers, search by meaning, metadata records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.api import Library
from quillstone.functions import isbn, text
from quillstone.functions import vectors as V
from quillstone.operators import enrich as E
from quillstone.operators import search as S
from quillstone.plans.registry import query
from quillstone.sources.catalog import SQL, Catalog, table


def _library(spark: SparkSession, sf_dir: str) -> Library:
    """The catalog's books as records, and as an outside source what every third number's book is said to be."""
    cat = Catalog(spark, sf_dir)
    numbers = cat.identifiers.groupBy(F.col("book").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("type", "val"))).alias("identifiers"))
    tags = cat.books_tags.groupBy(F.col("book").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    comments = cat.comments.select(F.col("book").alias("id"), F.col("text").alias("comments"))
    books = cat.books.select("id", "title", F.array("author_sort").alias("authors"), F.when(F.col("id") % 5 != 0, "Some House").alias("publisher"))
    books = books.join(tags, "id", "left").join(comments, "id", "left").join(numbers, "id", "left")
    known = cat.isbns.filter("book % 3 = 1").select("isbn", F.concat(F.lit("Title "), F.col("book").cast("string")).alias("title"), F.lit("Other House").alias("publisher"))
    return Library(books, metadata=known)


@query("C14 C15 S5", SQL + """SELECT b.id, CASE WHEN i.isbn IS NOT NULL THEN 'isbn:' || i.isbn END AS identifier, b.id % 3 = 1 AND i.isbn IS NOT NULL AS success,
  CASE WHEN i.isbn IS NULL THEN 'No ISBN or ASIN found' WHEN b.id % 3 <> 1 THEN 'nothing found' END AS error, CASE WHEN b.id % 3 = 1 AND i.isbn IS NOT NULL THEN 'Title ' || b.id END AS found_title FROM books b LEFT JOIN isbns i ON i.book = b.id""")
def enrich_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book looked up by the identifier that is chosen for it; those without one, or unknown to the source, fail."""
    found = _library(spark, sf_dir).enrich()
    return found.select("id", "identifier", "success", "error", F.col("found")["title"].alias("found_title"))


@query("C15 A10", SQL + """, c AS (SELECT b.id, i.isbn FROM books b JOIN isbns i ON i.book = b.id LEFT JOIN comments m ON m.book = b.id WHERE coalesce(m.text, '') = '' OR b.id % 3 = 0 ORDER BY b.id LIMIT 50)
SELECT count(*) AS total_processed, count(*) FILTER (WHERE id % 3 = 1) AS successful, count(*) FILTER (WHERE id % 3 <> 1) AS failed FROM c""")
def enrich_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with a number that lack tags or comments, fifty at most, looked up; the counters of the run."""
    return E.counted(_library(spark, sf_dir).batch_enrich(("comments", "tags"), 50))


@query("S4", SQL + """SELECT b.id, '<?xml version="1.0"?>' || chr(10) || '<package><metadata><dc:title>' || replace(replace(replace(b.title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</dc:title><dc:creator>' || b.author_sort || '</dc:creator>' ||
  CASE WHEN b.id % 5 <> 0 THEN '<dc:publisher>Some House</dc:publisher>' ELSE '' END || CASE WHEN i.isbn IS NOT NULL THEN '<dc:identifier scheme="isbn">' || i.isbn || '</dc:identifier>' ELSE '' END || '</metadata></package>' AS opf
FROM books b LEFT JOIN isbns i ON i.book = b.id""")
def metadata_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata record of each book as XML."""
    books = _library(spark, sf_dir).numbered.withColumn("isbn", F.try_element_at("identifiers", F.lit("isbn")))
    return books.select("id", text.opf(F.col("title"), F.col("authors"), F.col("publisher"), F.col("isbn")).alias("opf"))


@query("P17 J14", SQL + """SELECT id, CASE WHEN regexp_matches(title, '\\b97[89]\\d{10}\\b') THEN 'isbn' WHEN regexp_matches(title, '\\bB[A-Z0-9]{9}\\b') THEN 'asin' END AS kind FROM (SELECT id, CASE WHEN id % 7 = 0 THEN '978' || lpad(CAST(id AS VARCHAR), 10, '0') WHEN id % 11 = 0 THEN 'B' || lpad(CAST(id AS VARCHAR), 9, 'Z') ELSE title END AS title FROM books)
WHERE regexp_matches(title, '\\b97[89]\\d{10}\\b') OR regexp_matches(title, '\\bB[A-Z0-9]{9}\\b')""")
def titles_that_are_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("id") % 7 == 0, F.concat(F.lit("978"), F.lpad(F.col("id").cast("string"), 10, "0"))).when(F.col("id") % 11 == 0, F.concat(F.lit("B"), F.lpad(F.col("id").cast("string"), 9, "Z"))).otherwise(F.col("title"))
    rows = Catalog(spark, sf_dir).books.select("id", made.alias("title"))
    kind = F.when(isbn.first_match(F.col("title"), "isbn13").isNotNull(), "isbn").when(isbn.first_match(F.col("title"), "asin").isNotNull(), "asin")
    return rows.select("id", kind.alias("kind")).filter("kind IS NOT NULL")


_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')"
_PLACE = "CAST('0x' || substr(md5(word), 1, 4) AS INT) % 64"
_SIGN = "CASE WHEN CAST('0x' || substr(md5(word), 5, 1) AS INT) < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
_CELLS = f"cells AS (SELECT k, {_PLACE} AS place, sum({_SIGN}) AS x FROM (SELECT {{key}} AS k, unnest({_WORDS}) AS word FROM {{table}}) GROUP BY 1, 2), norms AS (SELECT k, sqrt(sum(x * x)) AS norm FROM cells GROUP BY k)"


def _plain_words():
    return F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")


@query("E1", f"WITH {_CELLS.format(key='item_id', table='benchmark')} SELECT k AS item_id, place AS position, round(x / norm, 6) AS value FROM cells JOIN norms USING (k) WHERE x <> 0")
def encode_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in encoder's vectors, cell by cell."""
    found = S.encoded(table(spark, sf_dir, "benchmark"), "item_id", _plain_words())
    return found.select("item_id", F.posexplode("embedding").alias("position", "value")).filter("value <> 0").select("item_id", F.col("position").cast("long").alias("position"), F.round("value", 6).alias("value"))


@query("E8", f"WITH {_CELLS.format(key='item_id', table='benchmark')}, p AS (SELECT a.k AS a, a.k + 1 AS b, sum(a.x * coalesce(c.x, 0)) AS s FROM cells a LEFT JOIN cells c ON c.k = a.k + 1 AND c.place = a.place GROUP BY a.k) SELECT a, b, round(s / (n.norm * m.norm), 6) + 0.0 AS similarity FROM p JOIN norms n ON n.k = a JOIN norms m ON m.k = b")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike each text is to the next, by their vectors."""
    found = S.encoded(table(spark, sf_dir, "benchmark"), "item_id", _plain_words())
    other = found.select((F.col("item_id") - 1).alias("item_id"), F.col("embedding").alias("next"))
    return found.join(other, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), (F.round(V.cosine(F.col("embedding"), F.col("next")), 6) + 0.0).alias("similarity"))


@query("C22 C21", SQL + f""", {_CELLS.format(key='id', table="(SELECT id, title AS text FROM books)").replace('cells AS', 'cells AS MATERIALIZED')}, q AS (SELECT place, x FROM cells WHERE k = 2), best AS (SELECT c.k AS id, round(sum(c.x * q.x) / (any_value(n.norm) * (SELECT norm FROM norms WHERE k = 2)), 6) AS score FROM cells c JOIN q USING (place) JOIN norms n ON n.k = c.k GROUP BY c.k ORDER BY score DESC, id LIMIT 8)
SELECT id, score, title, author_sort AS authors, isbn, CASE WHEN id % 5 <> 0 THEN 'Some House' END AS publisher, CASE WHEN length(c.text) > 200 THEN left(c.text, 200) || '...' ELSE coalesce(c.text, '') END AS preview
FROM best JOIN books b USING (id) LEFT JOIN isbns i ON i.book = id LEFT JOIN comments c ON c.book = id""")
def search_by_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The books whose titles are nearest to one book's title, with what is known of them."""
    library = _library(spark, sf_dir).indexed(F.col("title"))
    wanted = library.books.filter("id = 2").select(F.col("title").alias("text"))
    found = library.search_text(wanted, 8)
    return found.select("id", "score", "title", "authors", "isbn", "publisher", F.col("description_preview").alias("preview"))


@query("X1 X6", "SELECT count(*) AS n_books, count(*) FILTER (WHERE p_name ILIKE '%red%') AS n_found, 22 AS n_tools, 'Unknown tool: nothing' AS said FROM part")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations called by name; an unknown name is answered with a message."""
    tools = _library(spark, sf_dir).tools()
    books = tools.call("list_books", {}).agg(F.count("*").alias("n_books"))
    found = tools.call("search_library", {"query": "title:red"}).agg(F.count("*").alias("n_found"))
    return books.crossJoin(found).select("n_books", "n_found", F.lit(len(tools.names)).alias("n_tools"), F.lit(tools.call("nothing", {})).alias("said"))  # one row each
