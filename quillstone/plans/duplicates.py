"""Duplicate queries over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import dates, isbn
from quillstone.functions.text import normalize
from quillstone.operators import duplicates as D
from quillstone.operators import likeness
from quillstone.operators.components import components, tallied
from quillstone.operators.lineage import cut
from quillstone.plans.registry import query
from quillstone.sources.catalog import SQL, Catalog, table


def _keys() -> list[Column]:
    return [F.lower(F.trim("title")), F.lower(F.trim("author_sort"))]


_SAME = "lower(trim(a.title)) = lower(trim(b.title)) AND lower(trim(a.author_sort)) = lower(trim(b.author_sort))"
PRIORITY = ("MOBI", "EPUB", "PDF")
_PAIRS = f"SELECT a.id AS id1, b.id AS id2 FROM books a JOIN books b ON {_SAME} AND a.id < b.id"


@query("Q1 J3 J4 J7 P5 P6 F1 O1", SQL + f"""
SELECT a.id AS id1, b.id AS id2, a.title, a.author_sort, i1.isbn AS isbn1, i2.isbn AS isbn2 FROM books a
JOIN books b ON {_SAME} AND a.id < b.id LEFT JOIN isbns i1 ON i1.book = a.id LEFT JOIN isbns i2 ON i2.book = b.id
LEFT JOIN comments c ON c.book = a.id WHERE (c.text IS NULL OR c.text NOT ILIKE '%worthless%')
""")
def dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    books = cat.books.select("id", "title", "author_sort", *[k.alias(f"k{i}") for i, k in enumerate(_keys())])
    numbered = books.join(cat.isbns.select(F.col("book").alias("id"), "isbn"), "id", "left")
    said = cat.comments.select(F.col("book").alias("id"), F.coalesce(F.col("text").ilike("%worthless%"), F.lit(False)).alias("worthless"))
    first = numbered.join(said, "id", "left").filter(F.col("worthless").isNull() | ~F.col("worthless")).drop("worthless")
    second = numbered.select(F.col("id").alias("id2"), "k0", "k1", F.col("isbn").alias("isbn2"))
    found = D.meet(first.withColumnsRenamed({"id": "id1", "isbn": "isbn1"}), second, ["k0", "k1"])
    return found.select("id1", "id2", "title", "author_sort", "isbn1", "isbn2")


@query("C6 A8 T6", SQL + f", p AS ({_PAIRS}) SELECT id1 AS group_id, id2 AS id FROM p UNION SELECT id1, id1 FROM p")
def dup_groups_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.overlapping_groups(Catalog(spark, sf_dir).books, _keys())


_BY_KEY = "SELECT min(id) OVER (PARTITION BY lower(trim(title)), lower(trim(author_sort))) AS group_id, id, count(*) OVER (PARTITION BY lower(trim(title)), lower(trim(author_sort))) AS n FROM books"


@query("C6 A7", SQL + f"SELECT group_id, id FROM ({_BY_KEY}) WHERE n > 1")
def dup_groups_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.groups_by_key(Catalog(spark, sf_dir).books, _keys())


_NORMAL = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"


@query("C1 F2 A7 T13 T19", f"SELECT md5({_NORMAL}) AS key_md5, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_exact_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.md5(normalize(F.col("text"))).alias("key_md5")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


_VALUES = "SELECT book AS id, isbn AS value FROM isbns UNION ALL SELECT book, isbn FROM isbns WHERE book % 2 = 0 UNION ALL SELECT id, (SELECT min(isbn) FROM isbns) FROM books WHERE id % 97 = 5"


def _values(cat: Catalog) -> DataFrame:
    """Numbers from the record's own column, from its identifiers, and one that many records share."""
    isbns = cat.isbns.select(F.col("book").alias("id"), F.col("isbn").alias("value"))
    least = isbns.agg(F.min("value").alias("value"))  # one row
    shared = cat.books.filter("id % 97 = 5").select("id").crossJoin(F.broadcast(least))
    return isbns.unionByName(isbns.filter("id % 2 = 0")).unionByName(shared)


@query("C3 A9 T12", SQL + f"SELECT value, count(*) AS n FROM ({_VALUES}) GROUP BY value HAVING count(*) > 1")
def dup_isbn_faithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.identifier_groups(_values(Catalog(spark, sf_dir)), by_record=False)


@query("C3 A9", SQL + f"SELECT value, count(DISTINCT id) AS n FROM ({_VALUES}) GROUP BY value HAVING count(DISTINCT id) > 1")
def dup_isbn_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.identifier_groups(_values(Catalog(spark, sf_dir)), by_record=True)


@query("C2 J9 F25", """
WITH r AS (SELECT p_partkey AS id, p_brand, p_type, lower(trim(p_name)) AS t FROM part WHERE trim(p_name) <> '')
SELECT a.id AS id1, b.id AS id2, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 6) AS ratio
FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.id < b.id
WHERE round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 6) >= 0.7
""")
def dup_similar_lev(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return D.similar_titles(part, ["p_brand", "p_type"], "p_name", 0.7)


@query("C2 F25 T14 T15 T16 X3")
def dup_similar_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return D.similar_titles(part, ["p_brand", "p_type"], "p_name", 0.85, ratio="sequence", both_ways=True)


_PAGE_TITLE = r"regexp_replace(lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))), '[^a-z0-9 ]', '?', 'g')"


def _page_titles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Different page titles in ASCII, as classes (id, t), and the pages of each."""
    title = F.regexp_replace(F.lower(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))), "[^a-z0-9 ]", "?")
    strings, members = likeness.classes(table(spark, sf_dir, "pages"), title, id_col="page_id")
    return cut(strings), cut(members)


def _title_links(least: float) -> str:
    measure = "round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 6)"
    return f"c AS (SELECT t, min(page_id) AS id FROM (SELECT page_id, {_PAGE_TITLE} AS t FROM pages) WHERE t <> '' GROUP BY t), l AS (SELECT a.id AS a, b.id AS b, {measure} AS ratio FROM c a JOIN c b ON a.id < b.id AND {measure} >= {least})"


@query("C2 J9 F25 X3", f"WITH {_title_links(0.85)} SELECT a, b, ratio FROM l")
def title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different page titles that are alike, without blocks."""
    return likeness.similar_strings(_page_titles(spark, sf_dir)[0], 0.85).select("a", "b", "ratio")


@query("C2 J9 F25", f"WITH {_title_links(0.7)} SELECT a, b, ratio FROM l")
def title_links_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return likeness.similar_strings(_page_titles(spark, sf_dir)[0], 0.7).select("a", "b", "ratio")


@query("C2 T6 T15 J9", f"""WITH RECURSIVE {_title_links(0.7)}, e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT id, id AS x FROM c UNION SELECT r.id, e.b FROM r JOIN e ON r.x = e.a),
m AS (SELECT id, min(x) AS group_id FROM r GROUP BY id), n AS (SELECT a AS id, count(*) AS n_links FROM e GROUP BY a)
SELECT page_id, c.id AS class_id, group_id, coalesce(n_links, 0) AS n_links FROM (SELECT page_id, {_PAGE_TITLE} AS t FROM pages) p JOIN c USING (t) JOIN m ON m.id = c.id LEFT JOIN n ON n.id = c.id""")
def title_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with its title's class, the other titles like it, and the group that links lead to: groups don't overlap."""
    strings, members = _page_titles(spark, sf_dir)
    # Links are counted and united in the tasks that find them: titles that are all alike have as many as there are pairs.
    links = cut(tallied(likeness.similar_strings(strings, 0.7)))
    groups = components(strings, links.select(F.col("id").alias("a"), F.col("leads").alias("b"))).select(F.col("id").alias("class_id"), F.col("component").alias("group_id"))
    counts = links.groupBy(F.col("id").alias("class_id")).agg(F.sum("n").alias("n_links"))
    per_class = groups.join(counts, "class_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return members.withColumnRenamed("id", "page_id").join(per_class, "class_id")


@query("C4 C5 A11", SQL + f", g AS (SELECT group_id, count(*) AS n FROM ({_BY_KEY}) WHERE n > 1 GROUP BY group_id) SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_members, CAST(sum(n - 1) AS BIGINT) AS n_extra FROM g")
def dup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.summary(D.groups_by_key(Catalog(spark, sf_dir).books, _keys()))


_TITLE = r"trim(regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_WHO = "list_sort(list_transform([p_brand, split_part(p_type, ' ', 1)], lambda x: trim(regexp_replace(regexp_replace(lower(x), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))))"
_EXACT = f"SELECT {_TITLE} || chr(31) || array_to_string({_WHO}, chr(31)) AS name, list(p_partkey ORDER BY p_partkey) AS ids FROM part GROUP BY 1 HAVING count(*) > 1"
_SIMILAR = f"""SELECT CAST(a.id AS VARCHAR) AS name, list_sort(list_append(list(b.id), a.id)) AS ids FROM (SELECT p_partkey AS id, p_brand, p_type, {_TITLE} AS t FROM part) a JOIN (SELECT p_partkey AS id, p_brand, p_type, {_TITLE} AS t FROM part) b
  ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.id <> b.id AND a.t <> '' AND b.t <> '' AND round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 6) >= 0.85 GROUP BY a.id"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_brand", F.substring_index("p_type", " ", 1)).alias("authors"), "p_brand", "p_type")


def _likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, ids), the ids joined: once a title, as all its records have the same ones."""
    return D.like_groups(_records(spark, sf_dir), ["p_brand", "p_type"], "title", 0.85, lambda ids: F.array_join(ids, ","), normal=True)


@query("C1 F2", f"SELECT md5(name) AS name, array_to_string(ids, ',') AS ids FROM ({_EXACT})")
def dup_exact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records alike in title and authors, whose order doesn't matter."""
    found = D.exact_groups(_records(spark, sf_dir), ["title", "authors"])
    return found.select(F.md5("key").alias("name"), F.array_join("ids", ",").alias("ids"))


@query("C2 J9", f"SELECT CAST(name AS BIGINT) AS group_id, array_to_string(ids, ',') AS ids FROM ({_SIMILAR})")
def dup_similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group for each record that has others of its block like it; groups overlap."""
    return _likes(spark, sf_dir)


@query("C4", SQL + f"""
SELECT 'exact' AS kind, md5(name) AS name, array_to_string(ids, ',') AS ids FROM ({_EXACT}) UNION ALL SELECT 'similar', md5(name), array_to_string(ids, ',') FROM ({_SIMILAR})
UNION ALL SELECT 'isbn', md5(value), string_agg(DISTINCT CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) FROM ({_VALUES}) GROUP BY value HAVING count(DISTINCT id) > 1
""")
def dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of three kinds: alike in title and authors, with one number, with titles alike."""
    joined = F.array_join("ids", ",").alias("ids")
    exact = D.exact_groups(_records(spark, sf_dir), ["title", "authors"]).select(F.col("key").alias("name"), joined)
    numbered = _values(Catalog(spark, sf_dir)).groupBy(F.col("value").alias("name")).agg(F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("ids")).filter("size(ids) > 1").select("name", joined)
    similar = _likes(spark, sf_dir).withColumnRenamed("group_id", "name")
    return D.report(exact, numbered, similar).select("kind", F.md5("name").alias("name"), "ids")


_SCORED = f"""g AS (SELECT group_id, id FROM ({_BY_KEY}) WHERE n > 1),
f AS (SELECT book, count(*) AS n_formats, max(CASE format WHEN 'PDF' THEN 2 WHEN 'EPUB' THEN 1 ELSE 0 END) AS best FROM data GROUP BY book),
scored AS (SELECT group_id, g.id, CAST(coalesce(best, 0) * 1000 + modified_day + 10 * coalesce(n_formats, 0) AS BIGINT) AS score FROM g JOIN books USING (id) LEFT JOIN f ON f.book = g.id)
"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    formats = cat.data.groupBy("book").agg(F.collect_set("format").alias("formats")).withColumnRenamed("book", "id")
    rows = D.groups_by_key(cat.books, _keys()).join(cat.books.select("id", "modified_day"), "id").join(formats, "id", "left")
    score = D.keeper_score(F.coalesce("formats", F.array().cast("array<string>")), PRIORITY, F.col("modified_day"))
    return D.plan(rows.select("group_id", "id", score.alias("score")))


@query("C7 C8 F22 W1 O6 U5 T20", SQL + f", {_SCORED} SELECT group_id, id, score, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY score DESC, id) = 1 THEN 'KEEP' ELSE 'DELETE' END AS action FROM scored")
def dedup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query("C7 W1", SQL + f", {_SCORED} SELECT group_id, id, score FROM scored QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, id) = 1")
def keeper_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).filter("action = 'KEEP'").drop("action")


@query("C7 F21 F22 T7", """
SELECT o_custkey, o_orderkey, CAST((list_position(['P', 'F', 'O'], o_orderstatus) - 1) * 1000 + floor(epoch(o_orderdate) / 86400) AS BIGINT) AS score FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (list_position(['P', 'F', 'O'], o_orderstatus) - 1) * 1000 + floor(epoch(o_orderdate) / 86400) DESC, o_orderkey) = 1
""")
def keeper_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.array_position(F.array(*[F.lit(x) for x in "PFO"]), F.col("o_orderstatus")) - 1
    scored = orders.select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("id"), (status * 1000 + dates.day_of(F.col("o_orderdate"))).cast("long").alias("score"))
    return D.plan(scored).filter("action = 'KEEP'").select(F.col("group_id").alias("o_custkey"), F.col("id").alias("o_orderkey"), "score")


@query("C8 A10", SQL + f", {_SCORED}, p AS (SELECT group_id, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY score DESC, id) = 1 THEN 'KEEP' ELSE 'DELETE' END AS action FROM scored) SELECT action, count(*) AS n FROM p GROUP BY action")
def dedup_plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


_PLAN = f"p AS (SELECT group_id, id, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, id) AS k FROM scored)"


@query("C8", SQL + f""", {_SCORED}, {_PLAN}, a AS (SELECT * FROM p JOIN (SELECT group_id, max(id) AS keeper FROM p WHERE group_id % 3 = 1 GROUP BY group_id) USING (group_id))
SELECT 'find-only' AS mode, count(DISTINCT group_id) AS n_groups, count(DISTINCT id) FILTER (WHERE k > 1) AS n_deleted, (SELECT count(*) FROM books) AS n_left, 0 AS n_logged FROM p
UNION ALL SELECT 'dry-run', count(DISTINCT group_id), count(DISTINCT id) FILTER (WHERE k > 1), (SELECT count(*) FROM books), 0 FROM p
UNION ALL SELECT 'interactive', count(DISTINCT group_id), count(DISTINCT id) FILTER (WHERE id <> keeper), (SELECT count(*) FROM books) - count(DISTINCT id) FILTER (WHERE id <> keeper), count(DISTINCT id) FILTER (WHERE id <> keeper) FROM a
UNION ALL SELECT 'auto-delete', count(DISTINCT group_id), count(DISTINCT id) FILTER (WHERE k > 1), (SELECT count(*) FROM books) - count(DISTINCT id) FILTER (WHERE k > 1), count(DISTINCT id) FILTER (WHERE k > 1) FROM p""")
def dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four modes of a run over one plan: in an interactive one a third of the groups is answered, with the last id."""
    books, planned = Catalog(spark, sf_dir).books, _plan(spark, sf_dir)
    answers = planned.filter("group_id % 3 = 1").groupBy("group_id").agg(F.max("id").alias("keeper"))
    out = None
    for mode in D.MODES:
        left, log, summary = D.carry_out(books, planned, mode, answers if mode == "interactive" else None)
        count = lambda df, name: df.agg(F.count("*").alias(name))  # noqa: E731  one row each
        one = summary.crossJoin(count(left, "n_left")).crossJoin(count(log, "n_logged"))
        out = one if out is None else out.unionByName(one)
    return out


_WRITTEN = """SELECT p_partkey AS id, CASE p_partkey % 8
  WHEN 0 THEN n9 || c10 WHEN 1 THEN left(n9, 1) || '-' || substr(n9, 2) || '-' || lower(c10) WHEN 2 THEN n9 || CAST((CASE WHEN c10 = 'X' THEN 10 ELSE CAST(c10 AS INT) END + 1) % 10 AS VARCHAR)
  WHEN 3 THEN '978 ' || n9 || c13 WHEN 4 THEN '978-' || n9 || '-' || CAST((CAST(c13 AS INT) + 3) % 10 AS VARCHAR) WHEN 5 THEN n9 WHEN 6 THEN '977' || n9 || c13 ELSE 'ab' || n9 || c10 END AS v
FROM (SELECT p_partkey, n9, substr('0123456789X', CAST((11 - list_sum(list_transform(range(1, 10), lambda i: (11 - i) * CAST(substr(n9, i, 1) AS INT))) % 11) % 11 AS INT) + 1, 1) AS c10,
  CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr('978' || n9, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS VARCHAR) AS c13 FROM (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS n9 FROM part))"""
_TEN = r"regexp_full_match(s, '\d{9}[\dX]') AND list_sum(list_transform(range(1, 11), lambda i: (11 - i) * CASE WHEN substr(s, i, 1) = 'X' THEN 10 ELSE coalesce(TRY_CAST(substr(s, i, 1) AS INT), 0) END)) % 11 = 0"
_THIRTEEN = r"regexp_full_match(s, '97[89]\d{10}') AND list_sum(list_transform(range(1, 14), lambda i: coalesce(TRY_CAST(substr(s, i, 1) AS INT), 0) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0"


@query("F14 F15 F16", rf"SELECT id, {_TEN} AS is10, {_THIRTEEN} AS is13, ({_TEN}) OR ({_THIRTEEN}) AS is_any FROM (SELECT id, regexp_replace(v, '[-\s]', '', 'g') AS s FROM ({_WRITTEN}))")
def isbn_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers right and wrong in eight ways: a small x, other last digits, other lengths and beginnings, letters."""
    nine = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda a, i: a + (F.lit(11) - i) * F.substring(nine, i, F.lit(1)).cast("int"))
    check = (F.lit(11) - total % 11) % 11
    ten, thirteen = F.substring(F.lit("0123456789X"), check + 1, F.lit(1)), F.substring(isbn.isbn13_of(F.col("p_partkey")), 13, 1)
    forms = [
        F.concat(nine, ten),
        F.concat(F.substring(nine, 1, 1), F.lit("-"), F.substring(nine, 2, 8), F.lit("-"), F.lower(ten)),
        F.concat(nine, ((check + 1) % 10).cast("string")),
        F.concat(F.lit("978 "), nine, thirteen),
        F.concat(F.lit("978-"), nine, F.lit("-"), ((thirteen.cast("int") + 3) % 10).cast("string")),
        nine,
        F.concat(F.lit("977"), nine, thirteen),
        F.concat(F.lit("ab"), nine, ten),
    ]
    v = F.element_at(F.array(*forms), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), v.alias("v")).select("id", isbn.valid10(F.col("v")).alias("is10"), isbn.valid13(F.col("v")).alias("is13"), isbn.valid(F.col("v")).alias("is_any"))
