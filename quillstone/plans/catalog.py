"""Relational queries over the catalog: details, gaps, candidates, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import isbn
from quillstone.functions.text import or_default
from quillstone.operators import enrich as E
from quillstone.operators import search as S
from quillstone.plans.registry import query
from quillstone.sources.catalog import SQL, Catalog, table

# Words and patterns of titles and authors that stand for missing data.
BAD_WORDS = ("unknown", "untitled", "widget")
BAD_PATTERNS = ("^unknown", "^untitled", r"^\d+$", r"\bring$")


@query("Q2 A3 A5 P12 J10", SQL + """
SELECT b.id, b.title, min(i.isbn) AS isbn, string_agg(d.format, ',' ORDER BY d.format) AS formats
FROM books b LEFT JOIN isbns i ON i.book = b.id LEFT JOIN data d ON d.book = b.id WHERE b.id IN (1, 2, 3, 50, 51, 999) GROUP BY b.id, b.title
""")
def book_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    wanted = cat.books.filter(F.col("id").isin(1, 2, 3, 50, 51, 999))
    rows = wanted.join(cat.isbns.withColumnRenamed("book", "id"), "id", "left").join(cat.data.withColumnRenamed("book", "id"), "id", "left")
    return rows.groupBy("id", "title").agg(F.min("isbn").alias("isbn"), F.nullif(F.array_join(F.array_sort(F.collect_list("format")), ","), F.lit("")).alias("formats"))


@query("Q10 A3 A4 A5 J3 J8", SQL + """
SELECT b.id, b.title, b.author_sort, p.name AS publisher, t.tags, r.rating, i.isbn, length(c.text) AS comment_length, f.formats
FROM books b LEFT JOIN books_publishers_link l ON l.book = b.id LEFT JOIN publishers p ON p.id = l.publisher
LEFT JOIN (SELECT book, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM books_tags GROUP BY book) t ON t.book = b.id
LEFT JOIN books_ratings r ON r.book = b.id LEFT JOIN isbns i ON i.book = b.id LEFT JOIN comments c ON c.book = b.id
LEFT JOIN (SELECT book, string_agg(format, ',' ORDER BY format) AS formats FROM data GROUP BY book) f ON f.book = b.id
""")
def full_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    tags = cat.books_tags.groupBy("book").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    formats = cat.data.groupBy("book").agg(F.array_join(F.array_sort(F.collect_list("format")), ",").alias("formats"))
    publisher = cat.books_publishers_link.join(cat.publishers, F.col("publisher") == F.col("id")).select("book", F.col("name").alias("publisher"))
    comments = cat.comments.select("book", F.length("text").cast("long").alias("comment_length"))
    out = cat.books.withColumnRenamed("id", "book")
    for side in (publisher, tags, cat.books_ratings, cat.isbns, comments, formats):
        out = out.join(side, "book", "left")
    return out.select(F.col("book").alias("id"), "title", "author_sort", "publisher", "tags", "rating", "isbn", "comment_length", "formats")


_FLAGS_SQL = """
SELECT b.id, b.title, b.modified_day, i.isbn,
  c.text IS NULL OR c.text = '' AS no_comments, l.book IS NULL AS no_publisher, t.book IS NULL AS no_tags, coalesce(r.rating, 0) = 0 AS no_rating
FROM books b JOIN isbns i ON i.book = b.id LEFT JOIN comments c ON c.book = b.id LEFT JOIN books_publishers_link l ON l.book = b.id
LEFT JOIN (SELECT DISTINCT book FROM books_tags) t ON t.book = b.id LEFT JOIN (SELECT book, max(rating) AS rating FROM books_ratings GROUP BY book) r ON r.book = b.id
"""
_NAMES = ("comments", "publisher", "tags", "rating")


def _flagged(cat: Catalog) -> DataFrame:
    rows = cat.books.withColumnRenamed("id", "book").join(cat.isbns, "book")
    rows = rows.join(cat.comments, "book", "left").join(cat.books_publishers_link, "book", "left")
    rows = rows.join(cat.books_tags.select("book", F.lit(1).alias("tagged")).distinct(), "book", "left").join(cat.books_ratings.groupBy("book").agg(F.max("rating").alias("rating")), "book", "left")
    return rows.select(F.col("book").alias("id"), "title", "modified_day", "isbn", E.empty(F.col("text")).alias("no_comments"), F.col("publisher").isNull().alias("no_publisher"), F.col("tagged").isNull().alias("no_tags"), (F.coalesce("rating", F.lit(0)) == 0).alias("no_rating"))


def _gaps(cat: Catalog, wanted: tuple[str, ...], limit: int) -> DataFrame:
    rows = _flagged(cat).filter(E.any_of([F.col(f"no_{n}") for n in wanted])).distinct()
    rows = rows.orderBy(F.col("modified_day").desc(), "id").limit(limit)
    return rows.select("id", "title", "isbn", F.array_join(E.missing({n: F.col(f"no_{n}") for n in _NAMES}), ",").alias("missing"))


def _gaps_sql(wanted: tuple[str, ...], limit: int) -> str:
    test = " OR ".join(f"no_{n}" for n in wanted) or "1=1"
    names = ", ".join(f"CASE WHEN no_{n} THEN '{n}' END" for n in _NAMES)
    return SQL + f", flagged AS ({_FLAGS_SQL}) SELECT id, title, isbn, concat_ws(',', {names}) AS missing FROM flagged WHERE {test} ORDER BY modified_day DESC, id LIMIT {limit}"


@query("Q3 C10 A2 A6 J1 J2 J5 O2 O3 P8 P9 P11 P18 P19 T3 T24", _gaps_sql(_NAMES, 50))
def gaps_sql_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(Catalog(spark, sf_dir), _NAMES, 50)


@query("Q3 P7 P11", _gaps_sql(("comments",), 50))
def gaps_sql_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(Catalog(spark, sf_dir), ("comments",), 50)


@query("Q3 P8 P11", _gaps_sql(("publisher",), 50))
def gaps_sql_publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(Catalog(spark, sf_dir), ("publisher",), 50)


@query("Q3 P11", _gaps_sql(("tags", "rating"), 50))
def gaps_sql_tags_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(Catalog(spark, sf_dir), ("tags", "rating"), 50)


@query("Q3 P11", _gaps_sql((), 40))
def gaps_sql_no_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a field to look at, all rows pass."""
    return _gaps(Catalog(spark, sf_dir), (), 40)


_SCAN = {"limit": 20, "examined": 200}


@query("C9 P22 T9", SQL + f""", flagged AS ({_FLAGS_SQL}), head AS (SELECT * FROM flagged ORDER BY id LIMIT {_SCAN['examined'] - 1})
SELECT id, title, concat_ws(',', CASE WHEN no_comments THEN 'comments' END, CASE WHEN no_tags THEN 'tags' END) AS missing FROM head WHERE no_comments OR no_tags ORDER BY id LIMIT {_SCAN['limit']}""")
def gaps_scan_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flagged(Catalog(spark, sf_dir))
    found = E.capped_scan(rows, [F.col("id")], _SCAN["examined"], F.col("no_comments") | F.col("no_tags"), _SCAN["limit"])
    return found.select("id", "title", F.array_join(E.missing({"comments": F.col("no_comments"), "tags": F.col("no_tags")}), ",").alias("missing"))


_BAD_SQL = " AND ".join(f"title NOT ILIKE '%{w}%'" for w in BAD_WORDS)


@query("Q4 C11 J6 P13 P14 P15 P16 T2 T10", SQL + f""", head AS (
  SELECT b.id, b.title, b.author_sort FROM books b LEFT JOIN isbns i ON i.book = b.id LEFT JOIN comments c ON c.book = b.id
  WHERE i.book IS NULL AND c.book IS NULL AND length(title) > 7 AND {_BAD_SQL} ORDER BY b.id LIMIT 40)
SELECT id, title, author_sort FROM head WHERE NOT regexp_matches(title, '(?i)(?:^unknown)|(?:^untitled)|(?:^\\d+$)|(?:\\bring$)') AND NOT contains(lower(author_sort), '#1')
""")
def title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit comes before the last tests, so fewer rows may come out."""
    cat = Catalog(spark, sf_dir)
    books = cat.books.join(cat.isbns.withColumnRenamed("book", "id"), "id", "left_anti").join(cat.comments.withColumnRenamed("book", "id"), "id", "left_anti")
    head = books.filter((F.length("title") > 7) & E.not_like_any(F.col("title"), BAD_WORDS)).orderBy("id").limit(40)
    return head.filter(~E.bad_title(F.col("title"), BAD_PATTERNS) & ~(E.empty(F.col("author_sort")) | F.lower("author_sort").contains("#1"))).select("id", "title", "author_sort")


@query("Q5 C12 J6 P6 P12 P18 T11", SQL + """
SELECT id, title, format, has_comments FROM (
  SELECT DISTINCT b.id, b.title, d.format, CASE WHEN c.book IS NOT NULL THEN 1 ELSE 0 END AS has_comments, b.modified_day
  FROM books b JOIN data d ON d.book = b.id LEFT JOIN isbns i ON i.book = b.id LEFT JOIN comments c ON c.book = b.id
  WHERE i.book IS NULL AND d.format IN ('PDF', 'EPUB')) ORDER BY modified_day DESC, id, format LIMIT 60
""")
def no_isbn_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a book and format: the limit counts formats."""
    cat = Catalog(spark, sf_dir)
    rows = cat.books.withColumnRenamed("id", "book").join(cat.isbns, "book", "left_anti").join(cat.data.filter(F.col("format").isin("PDF", "EPUB")), "book")
    rows = rows.join(cat.comments.select("book", F.lit(1).alias("c")), "book", "left")
    rows = rows.select(F.col("book").alias("id"), "title", "format", F.when(F.col("c").isNotNull(), 1).otherwise(0).alias("has_comments"), "modified_day").distinct()
    return rows.orderBy(F.col("modified_day").desc(), "id", "format").limit(60).drop("modified_day")


@query("C12 F23", SQL + "SELECT b.id, d.format, 'library/' || replace(b.title, ' ', '_') || '/' || b.title || '.' || lower(d.format) AS path FROM books b JOIN data d ON d.book = b.id")
def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    rows = cat.books.join(cat.data.withColumnRenamed("book", "id"), "id")
    return rows.select("id", "format", F.concat(F.lit("library/"), F.replace("title", F.lit(" "), F.lit("_")), F.lit("/"), "title", F.lit("."), F.lower("format")).alias("path"))


@query("Q6 P5 T1 J8", "SELECT s_suppkey AS id, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name ILIKE '%eur%' AND s_name ILIKE '%1%'")
def by_author_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.filter(F.col("r_name").ilike("%eur%") & F.col("s_name").ilike("%1%")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


@query("Q7 J6", SQL + "SELECT b.id, b.title FROM books b LEFT JOIN isbns i ON i.book = b.id WHERE i.book IS NULL")
def without_isbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    return cat.books.join(cat.isbns.withColumnRenamed("book", "id"), "id", "left_anti").select("id", "title")


@query("Q8 A1 A13", SQL + "SELECT p.name, count(*) AS n_books FROM publishers p JOIN books_publishers_link l ON l.publisher = p.id GROUP BY p.id, p.name")
def count_by_publisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts first, then joins names to the few sums."""
    cat = Catalog(spark, sf_dir)
    counts = cat.books_publishers_link.groupBy("publisher").agg(F.count("*").alias("n_books"))
    return counts.join(cat.publishers, F.col("publisher") == F.col("id")).select("name", "n_books").orderBy(F.col("n_books").desc(), "name")


@query("Q9 P7", SQL + "SELECT b.id, b.title FROM books b LEFT JOIN comments c ON c.book = b.id WHERE c.text IS NULL OR c.text = ''")
def empty_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    return cat.books.join(cat.comments.filter("text <> ''").select(F.col("book").alias("id")), "id", "left_anti").select("id", "title")


@query("S2 O1 O4", "SELECT p_partkey AS id, p_name AS title, p_brand AS author FROM part WHERE p_name ILIKE '%red%' ORDER BY p_name, p_partkey LIMIT 25")
def list_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = Catalog(spark, sf_dir).books
    return books.filter(F.col("title").ilike("%red%")).orderBy("title", "id").limit(25).select("id", "title", F.col("author_sort").alias("author"))


@query("S3 P17", "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_brand ILIKE '%brand#2%' AND p_name ILIKE '%small%'")
def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = Catalog(spark, sf_dir).books
    return books.filter(S.predicate('author:"brand#2" AND title:small', {"author": F.col("author_sort"), "title": F.col("title"), "id": F.col("id")})).select("id", "title")


@query("J14 F18", SQL + "SELECT b.id, b.title, i.isbn FROM books b JOIN isbns i ON i.book = b.id WHERE replace(i.isbn, '-', '') = (SELECT max(isbn) FROM isbns)")
def isbn_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    greatest = cat.isbns.agg(F.max("isbn").alias("isbn"))  # one row
    return cat.books.join(cat.isbns.withColumnRenamed("book", "id"), "id").withColumn("isbn", isbn.bare(F.col("isbn"))).join(greatest, "isbn", "left_semi").select("id", "title", "isbn")


@query("J14", SQL + "SELECT count(*) > 0 AS is_there FROM isbns WHERE isbn = '9780000000017' OR book = 17")
def isbn_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog(spark, sf_dir).isbns.agg((F.count_if(F.expr("isbn = '9780000000017' OR book = 17")) > 0).alias("is_there"))


@query("F20 T8 F19", SQL + """
SELECT b.id, CASE WHEN i.isbn IS NOT NULL THEN 'isbn:' || replace(i.isbn, '-', '') WHEN g.val IS NOT NULL THEN 'amazon:' || g.val
 WHEN regexp_extract(t, '\\b(B[A-Z0-9]{9})\\b', 1) <> '' THEN 'asin:' || regexp_extract(t, '\\b(B[A-Z0-9]{9})\\b', 1) WHEN regexp_extract(t, '\\b(97[89]\\d{10})\\b', 1) <> '' THEN 'isbn:' || regexp_extract(t, '\\b(97[89]\\d{10})\\b', 1) END AS pick
FROM (SELECT id, CASE WHEN id % 11 = 0 THEN title || ' B' || lpad(CAST(id AS VARCHAR), 9, '0') WHEN id % 13 = 0 THEN title || ' 978' || lpad(CAST(id AS VARCHAR), 10, '0') ELSE title END AS t FROM books) b
LEFT JOIN isbns i ON i.book = b.id LEFT JOIN identifiers g ON g.book = b.id AND g.type = 'goodreads'
""")
def identifier_pick_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titled(Catalog(spark, sf_dir))
    return rows.select("id", isbn.pick_for_batch(F.col("isbn"), F.col("val"), F.col("t")).alias("pick"))


def _titled(cat: Catalog) -> DataFrame:
    """Titles of which some hold numbers, with the stored numbers."""
    t = F.when(F.col("id") % 11 == 0, F.concat("title", F.lit(" B"), F.lpad(F.col("id").cast("string"), 9, "0"))).when(F.col("id") % 13 == 0, F.concat("title", F.lit(" 978"), F.lpad(F.col("id").cast("string"), 10, "0"))).otherwise(F.col("title"))
    other = cat.identifiers.filter("type = 'goodreads'").select(F.col("book").alias("id"), "val")
    return cat.books.select("id", t.alias("t")).join(cat.isbns.withColumnRenamed("book", "id"), "id", "left").join(other, "id", "left")


@query("F20 T8 F19", SQL + """
SELECT b.id, CASE WHEN regexp_extract(t, '\\b(B[A-Z0-9]{9})\\b', 1) <> '' THEN 'asin:' || regexp_extract(t, '\\b(B[A-Z0-9]{9})\\b', 1) WHEN regexp_extract(t, '\\b(97[89]\\d{10})\\b', 1) <> '' THEN 'isbn:' || regexp_extract(t, '\\b(97[89]\\d{10})\\b', 1)
 WHEN regexp_extract(t, '\\b(\\d{9}[\\dX])\\b', 1) <> '' THEN 'isbn:' || regexp_extract(t, '\\b(\\d{9}[\\dX])\\b', 1) WHEN i.isbn IS NOT NULL THEN 'isbn:' || i.isbn WHEN g.val IS NOT NULL THEN 'goodreads:' || g.val END AS pick
FROM (SELECT id, CASE WHEN id % 11 = 0 THEN title || ' B' || lpad(CAST(id AS VARCHAR), 9, '0') WHEN id % 13 = 0 THEN title || ' 978' || lpad(CAST(id AS VARCHAR), 10, '0') ELSE title END AS t FROM books) b
LEFT JOIN isbns i ON i.book = b.id LEFT JOIN identifiers g ON g.book = b.id AND g.type = 'goodreads'
""")
def identifier_pick_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titled(Catalog(spark, sf_dir))
    return rows.select("id", isbn.pick_for_tool(F.col("isbn"), F.lit(None).cast("string"), F.col("val"), F.col("t")).alias("pick"))


@query("P21 P3", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END, ''), 'Unknown') AS source FROM documents")
def falsy_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").drop("n_chars", "text")
    return docs.select("doc_id", or_default(F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("source"))).alias("source"))


@query("P10", "SELECT doc_id, nullif(CASE WHEN doc_id % 4 = 0 THEN '0101-01-01T00:00:00+00:00' ELSE '2020-01-02T03:04:05+00:00' END, '0101-01-01T00:00:00+00:00') IS NULL AS no_date FROM documents")
def sentinel_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.functions.dates import NO_DATE, known_date

    stored = F.when(F.col("doc_id") % 4 == 0, NO_DATE).otherwise("2020-01-02T03:04:05+00:00")
    return table(spark, sf_dir, "documents").select("doc_id", known_date(stored).isNull().alias("no_date"))


# Fills and merges: documents are the records, labels what a lookup found.
_OLD = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS source, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS lang FROM documents"
_NEW = "SELECT doc_id, CASE WHEN quality = 1 THEN 'good' END AS source, CASE WHEN toxic = 1 THEN 'xx' ELSE 'en' END AS lang FROM labels"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    old = docs.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("source"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")).alias("lang"))
    return old, labels.select("doc_id", F.when(F.col("quality") == 1, "good").alias("source"), F.when(F.col("toxic") == 1, "xx").otherwise("en").alias("lang"))


def _merge_sql(source: str, lang: str) -> str:
    return f"""SELECT doc_id, CASE WHEN ts THEN nsource ELSE source END AS source, CASE WHEN tl THEN nlang ELSE lang END AS lang, CAST(ts AS INT) + CAST(tl AS INT) AS n_updated FROM (
    SELECT o.*, n.source AS nsource, n.lang AS nlang, coalesce({source}, false) AS ts, coalesce({lang}, false) AS tl FROM ({_OLD}) o LEFT JOIN ({_NEW}) n USING (doc_id))"""


@query("C16 J3", _merge_sql("coalesce(o.source, '') = '' AND coalesce(n.source, '') <> ''", "coalesce(o.lang, '') = '' AND coalesce(n.lang, '') <> ''"))
def merge_fill_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fill_only(*_sides(spark, sf_dir), "doc_id", ["source", "lang"])


@query("C17", _merge_sql("coalesce(n.source, '') <> ''", "coalesce(n.lang, '') <> ''"))
def merge_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.overwrite(*_sides(spark, sf_dir), "doc_id", ["source", "lang"])


@query("C18", _merge_sql("false", "coalesce(n.lang, '') <> ''"))
def merge_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.overwrite(*_sides(spark, sf_dir), "doc_id", ["source", "lang"], guarded=["source"])


_SUGGEST = f"""SELECT doc_id, field, current, suggested, CASE WHEN coalesce(current, '') = '' THEN 'Missing' ELSE 'Different' END AS reason FROM (
  SELECT o.doc_id, 'source' AS field, o.source AS current, n.source AS suggested FROM ({_OLD}) o JOIN ({_NEW}) n USING (doc_id)
  UNION ALL SELECT o.doc_id, 'lang', o.lang, n.lang FROM ({_OLD}) o JOIN ({_NEW}) n USING (doc_id)
) WHERE coalesce(suggested, '') <> '' AND (coalesce(current, '') = '' OR current <> suggested)"""


@query("C19 T25", _SUGGEST)
def suggest_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.suggestions(*_sides(spark, sf_dir), "doc_id", ["source", "lang"])


@query("C20", f"""SELECT doc_id, CASE WHEN bool_or(field = 'lang') THEN 'lang' ELSE '' END AS applied, CASE WHEN bool_or(field = 'lang') THEN 'isbn' ELSE 'isbn,lang' END AS failed,
  CASE WHEN bool_or(field = 'lang') THEN 'partial' ELSE 'no_updates_needed' END AS status FROM ({_SUGGEST}) GROUP BY doc_id""")
def apply_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.apply_selected(E.suggestions(*_sides(spark, sf_dir), "doc_id", ["source", "lang"]), "doc_id", ["lang", "isbn"])


@query("C14 S5 J10", SQL + """SELECT b.id, i.isbn, m.published, m.published IS NOT NULL AS success FROM books b JOIN isbns i ON i.book = b.id
LEFT JOIN (SELECT isbn, 1900 + book % 120 AS published FROM isbns WHERE book % 3 = 1) m ON m.isbn = i.isbn""")
def enrich_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with what a table of metadata says of their number; a lookup that finds nothing is a row too."""
    cat = Catalog(spark, sf_dir)
    known = cat.isbns.filter("book % 3 = 1").select("isbn", (F.lit(1900) + F.col("book") % 120).alias("published"))
    rows = cat.books.join(cat.isbns.withColumnRenamed("book", "id"), "id").select("id", "isbn")
    return E.lookup(rows, known, "isbn").select("id", "isbn", "published", "success")


@query("C15 A10", SQL + """, r AS (SELECT i.book, m.book IS NOT NULL AS success FROM (SELECT * FROM isbns ORDER BY book LIMIT 50) i LEFT JOIN isbns m ON m.book = i.book AND m.book % 3 = 1)
SELECT count(*) FILTER (WHERE success) AS n_success, count(*) FILTER (WHERE NOT success) AS n_failed, count(*) AS n_total FROM r""")
def batch_enrich_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    known = cat.isbns.filter("book % 3 = 1").select("isbn", F.lit(1).alias("m"))
    rows = E.lookup(cat.isbns.orderBy("book").limit(50), known, "isbn")
    return rows.agg(F.count_if(F.expr("success")).alias("n_success"), F.count_if(F.expr("NOT success")).alias("n_failed"), F.count("*").alias("n_total"))


@query("S18 C24", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return E.patch(customer, customer.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("PATCHED").alias("c_mktsegment")), "c_custkey")


@query("C24 A10", "WITH ids AS (SELECT DISTINCT c_custkey * 3 AS k FROM customer) SELECT count(*) FILTER (WHERE c_custkey IS NOT NULL) AS n_success, count(*) FILTER (WHERE c_custkey IS NULL) AS n_failure, count(*) AS n_total FROM ids LEFT JOIN customer ON c_custkey = k")
def bulk_update_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return E.bulk_outcome(customer, customer.select((F.col("c_custkey") * 3).alias("c_custkey")), "c_custkey")


@query("S18", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey + 1000000000, c_name FROM customer WHERE c_custkey % 7 = 1")
def add_and_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    left = customer.join(customer.filter("c_custkey % 7 = 0").select("c_custkey"), "c_custkey", "left_anti")
    return left.unionByName(customer.filter("c_custkey % 7 = 1").withColumn("c_custkey", F.col("c_custkey") + 1000000000))


@query("S19 F32", SQL + "SELECT book AS id, 'goodreads=' || val || ';isbn=978' || lpad(val, 10, '0') AS identifiers FROM identifiers WHERE type = 'goodreads'")
def add_isbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = Catalog(spark, sf_dir).identifiers.filter("type = 'goodreads'")
    added = E.add_identifier(F.create_map("type", "val"), "isbn", F.concat(F.lit("978-"), F.lpad("val", 10, "0")))
    return ids.select(F.col("book").alias("id"), F.array_join(F.array_sort(F.transform(F.map_entries(added), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("identifiers"))


@query("C13", SQL + """SELECT b.id, coalesce(i.isbn, nullif(CASE WHEN id % 5 = 0 THEN '9780306406157' ELSE '' END, '')) AS isbn FROM books b LEFT JOIN isbns i ON i.book = b.id""")
def book_isbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored number, else the first valid one in title or comments."""
    cat = Catalog(spark, sf_dir)
    rows = cat.books.join(cat.isbns.withColumnRenamed("book", "id"), "id", "left").withColumn("comment", F.when(F.col("id") % 5 == 0, "see ISBN 978-0-306-40615-7 there"))
    return rows.select("id", F.coalesce("isbn", F.get(F.concat(isbn.extract(F.col("title")), isbn.extract(F.col("comment"))), F.lit(0))).alias("isbn"))


@query("C23", "SELECT count(*) AS n, count(*) >= 100 AS enough FROM part")
def field_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog(spark, sf_dir).books.agg(F.count("*").alias("n"), (F.count("*") >= 100).alias("enough"))


@query("Q11 X1", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment")
def sql_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.sources.sqltool import run_query

    return run_query(spark, sf_dir, "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment")
