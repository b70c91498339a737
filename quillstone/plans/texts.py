"""Text queries: scalar functions over texts, tokens, profiles, weights, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import isbn
from quillstone.functions import text as X
from quillstone.operators import stats as A
from quillstone.operators import tagging as G
from quillstone.operators import text as T
from quillstone.operators.summary import summaries
from quillstone.plans.registry import query
from quillstone.sources.catalog import SQL, Catalog, table

LANGS = ("en", "de", "fr")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("F2 F6 T19", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))) AS normal, md5(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g')) AS bare FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.normalize(F.col("text"))).alias("normal"), F.md5(X.remove_punctuation(F.col("text"))).alias("bare"))


@query("F7", "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS plain, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = X.strip_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(plain).alias("plain"), F.length(plain).cast("long").alias("n"))


@query("N1", "SELECT doc_id, md5(replace(regexp_replace(text, '([[:punct:]])', ' \\1', 'g'), ' ', chr(10))) AS lines FROM documents")
def tokenize_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.spaced_tokens(F.col("text"))).alias("lines"))


@query("F3 F4 F5", r"SELECT doc_id, md5(lower(regexp_replace(text, '[^a-zA-Z\s]', '', 'g'))) AS letters_first, md5(regexp_replace(lower(text), '[^a-z\s]', '', 'g')) AS lower_first, length(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS n_alpha FROM documents")
def clean_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.letters_then_lower(t)).alias("letters_first"), F.md5(X.lower_then_letters(t)).alias("lower_first"), F.length(X.alpha_only(t)).cast("long").alias("n_alpha"))


_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"


@query("F8 F9 F10", rf"""SELECT doc_id, array_to_string(list_slice({_WORDS}, 1, 12), ' ') AS head, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview,
  md5(array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10))) AS lines FROM documents""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", X.first_words(t, 12).alias("head"), X.preview(t).alias("preview"), F.md5(X.first_lines(t, 3)).alias("lines"))


@query("F11", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN split_part(c_name, '#', 2) || ' ' || split_part(c_name, '#', 1) WHEN 1 THEN c_name ELSE 'Ann ' || c_mktsegment || ' & Solo' END AS names FROM customer""")
def author_sort_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_custkey") % 3
    stored = F.when(kind == 0, F.concat(F.substring_index("c_name", "#", 1), F.lit(", "), F.substring_index("c_name", "#", -1))).when(kind == 1, F.col("c_name")).otherwise(F.concat("c_mktsegment", F.lit(", Ann & Solo")))
    return table(spark, sf_dir, "customer").select("c_custkey", X.names_from_sort(stored).alias("names"))


@query("F12 F13 F21", SQL + """SELECT b.id, concat_ws(' | ', 'Title: ' || title, 'Authors: ' || author_sort, CASE WHEN tags <> '' THEN 'Tags: ' || tags END, CASE WHEN isbn <> '' THEN 'ISBN: ' || isbn END, 'Title: ' || title) AS searchable
FROM books b LEFT JOIN isbns i ON i.book = b.id LEFT JOIN (SELECT book, string_agg(DISTINCT tag, ', ' ORDER BY tag) AS tags FROM books_tags GROUP BY book) t ON t.book = b.id""")
def searchable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    tags = cat.books_tags.groupBy("book").agg(F.array_sort(F.collect_set("tag")).alias("tags")).withColumnRenamed("book", "id")
    rows = cat.books.join(cat.isbns.withColumnRenamed("book", "id"), "id", "left").join(tags, "id", "left")
    front = X.labelled_parts({"Title": F.col("title"), "Authors": F.col("author_sort"), "Tags": F.array_join("tags", ", "), "ISBN": F.col("isbn")})
    return rows.select("id", F.concat_ws(" | ", front, X.labelled_parts({"Title": F.col("title")})).alias("searchable"))


@query("F24", "SELECT p_partkey AS id, repeat('★', p_size % 6) || repeat('☆', 5 - p_size % 6) AS stars FROM part")
def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.stars((F.col("p_size") % 6).cast("int")).alias("stars"))


_CHECK10 = "list_sum(list_transform(range(1, 11), lambda i: (11 - i) * CASE WHEN substr(s, i, 1) = 'X' THEN 10 ELSE coalesce(TRY_CAST(substr(s, i, 1) AS INT), 0) END)) % 11 = 0"
_CHECK13 = "list_sum(list_transform(range(1, 14), lambda i: coalesce(TRY_CAST(substr(s, i, 1) AS INT), 0) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0"
#: Numbers that are put into texts: right and wrong ones of both lengths, with hyphens, spaces, a small x, and one within the other.
_ADDED = (" ISBN-10: 0-306-40615-2 and 0306406153", " ISBN-13: 978-0-306-40615-7, ISBN 9780306406158", " 043942089X or 043942089x", " 979 10 90636 07 1 and 97803064061571", "")


def _found_sql(pattern: str, right: str, check: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(t, '{pattern}', 1), lambda x: regexp_replace(x, '[-\\s]', '', 'g')), lambda s: regexp_full_match(s, '{right}') AND {check})"


@query("F17 T17 T18", rf"""WITH d AS (SELECT doc_id, text || [{', '.join(repr(x) for x in _ADDED)}][doc_id % {len(_ADDED)} + 1] AS t FROM documents),
c AS (SELECT doc_id, {_found_sql(isbn.SCAN10, '[0-9]{9}[0-9X]', _CHECK10)} AS ten, {_found_sql(isbn.SCAN13, '97[89][0-9]{10}', _CHECK13)} AS thirteen FROM d)
SELECT doc_id, array_to_string(list_concat(ten, thirteen), ',') AS found, len(ten) + len(thirteen) AS n FROM c""")
def isbn_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid numbers in texts, those of ten digits first, in order."""
    added = F.element_at(F.array(*[F.lit(x) for x in _ADDED]), (F.col("doc_id") % len(_ADDED) + 1).cast("int"))
    found = isbn.extract(F.concat("text", added))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(found, ",").alias("found"), F.size(found).cast("long").alias("n"))


@query("F14 F15", SQL + f"SELECT p_partkey AS id, v AS isbn, {_CHECK13.replace('substr(s,', 'substr(v,')} AND regexp_full_match(v, '97[89][0-9]{{10}}') AS is_valid FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN left(w, 12) || CAST((CAST(right(w, 1) AS INT) + 1 + p_partkey % 9) % 10 AS VARCHAR) ELSE w END AS v FROM (SELECT p_partkey, s || " + "CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(s, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS VARCHAR) AS w FROM keyed))")
def isbn_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made numbers, of which every third has another last digit."""
    wrong = lambda made: F.concat(F.substring(made, 1, 12), ((F.substring(made, 13, 1).cast("int") + 1 + F.col("p_partkey") % 9) % 10).cast("string"))
    value = isbn.once(isbn.isbn13_of(F.col("p_partkey")), lambda made: F.when(F.col("p_partkey") % 3 == 0, wrong(made)).otherwise(made))
    judged = isbn.once(value, lambda v: F.struct(v.alias("isbn"), isbn.valid13(v).alias("is_valid")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.inline(F.array(judged)))


@query("F27", rf"""SELECT doc_id, length(text) AS n_characters, len(w) AS n_words, len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x) <> '')) AS n_sentences,
  round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 4) AS word_length, list_max(list_transform(w, lambda x: length(x))) AS longest, list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))))[1] AS longest_word FROM (SELECT *, {_WORDS} AS w FROM documents)""")
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", "text", X.words(F.col("text")).alias("w"))
    sizes = F.transform("w", lambda x: F.length(x))
    sentences = F.filter(F.split("text", r"[.!?]+"), lambda x: F.trim(x) != "")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_characters"), F.size("w").cast("long").alias("n_words"), F.size(sentences).cast("long").alias("n_sentences"), F.round(F.aggregate(sizes, F.lit(0), lambda a, x: a + x) / F.size("w"), 4).alias("word_length"), F.array_max(sizes).cast("long").alias("longest"), F.element_at("w", F.array_position(sizes, F.array_max(sizes)).cast("int")).alias("longest_word"))


@query("F28", """SELECT p_partkey AS id, upper(p_name) AS upper, lower(p_name) AS lower, reverse(p_name) AS reverse, replace(p_name, ' ', '_') AS snake,
  upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS capitalized, split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS camel,
  upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS title FROM part""")
def string_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.upper(n).alias("upper"), F.lower(n).alias("lower"), F.reverse(n).alias("reverse"), X.snake_case(n).alias("snake"), F.concat(F.upper(F.substring(n, 1, 1)), F.lower(F.substr(n, F.lit(2)))).alias("capitalized"), X.camel_case(n).alias("camel"), X.title_case(n).alias("title"))


_Z = "lower(regexp_replace(text, '[^a-zA-Z]', '', 'g'))"
_GRAMS = f"SELECT doc_id, lang, unnest(list_transform(range(1, length(z) - {{n}} + 2), lambda i: substr(z, i, {{n}}))) AS gram FROM (SELECT doc_id, lang, {_Z} AS z FROM documents)"
_PROFILE = "SELECT lang, gram, n FROM (SELECT lang, gram, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) AS k FROM ({grams}) GROUP BY lang, gram) WHERE k <= 100"


def _letters():
    return F.lower(F.regexp_replace("text", "[^a-zA-Z]+", ""))


@query("N3 N4 W2 A12 T22", _PROFILE.format(grams=_GRAMS.format(n=2)))
def char_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ngram_profile(_docs(spark, sf_dir), _letters(), "lang", (2,), 100)


_DECIDE = f"""WITH g2 AS ({_GRAMS.format(n=2)}), g3 AS ({_GRAMS.format(n=3)}), p2 AS ({_PROFILE.format(grams='SELECT * FROM g2')}), p3 AS ({_PROFILE.format(grams='SELECT * FROM g3')}),
s AS (SELECT doc_id, lang, count(*) AS score FROM (SELECT g2.doc_id, p2.lang FROM g2 JOIN p2 USING (gram) UNION ALL SELECT g3.doc_id, p3.lang FROM g3 JOIN p3 USING (gram)) GROUP BY doc_id, lang),
r AS (SELECT doc_id, lang AS predicted FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END, lang) = 1),
d AS (SELECT d.doc_id, d.lang, coalesce(predicted, 'en') AS predicted FROM documents d LEFT JOIN r USING (doc_id))"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language by bigram and trigram profiles; a text that matches none is in the first declared."""
    docs = _docs(spark, sf_dir)
    scores = T.profile_scores(docs, _letters(), "doc_id", T.ngram_profile(docs, _letters(), "lang", (2, 3), 100), "lang", (2, 3))
    best = T.best_label(scores, "doc_id", "lang", LANGS).withColumnRenamed("lang", "predicted")
    return docs.select("doc_id", "lang").join(best, "doc_id", "left").withColumn("predicted", F.coalesce("predicted", F.lit(LANGS[0])))


@query("N5 N6 W3 J13 T23", _DECIDE + " SELECT doc_id, predicted FROM d")
def lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("doc_id", "predicted")


@query("A20", _DECIDE + " SELECT lang, count(*) AS n, round(avg(CASE WHEN lang = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM d GROUP BY lang")
def lang_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.accuracy(_decided(spark, sf_dir), "lang", "predicted", by="lang")


@query("A21", _DECIDE + " SELECT lang AS truth, predicted, count(*) AS n FROM d GROUP BY lang, predicted")
def lang_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.confusion(_decided(spark, sf_dir), "lang", "predicted")


_TOKENS = r"list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')"


def _tokens():
    return F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")


@query("W4 N7", f"WITH w AS (SELECT {_TOKENS} AS w FROM conversations) SELECT a, b, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: {{'a': w[i], 'b': w[i + 1]}}), recursive := true) FROM w) GROUP BY a, b")
def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bigrams(table(spark, sf_dir, "conversations"), _tokens())


@query("N9 A12 O3", f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 40")
def freq_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.frequencies(_docs(spark, sf_dir), _tokens(), 40)


# Function words of the sample languages.
STOP = ("the", "and", "of", "to", "in", "la", "le", "de", "der", "die", "und", "que", "el", "en")


@query("N8 U4", f"SELECT doc_id, len(list_filter({_TOKENS}, lambda x: NOT list_contains([{', '.join(repr(w) for w in STOP)}], x))) AS n_left, len({_TOKENS}) AS n_all FROM documents")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(_tokens(), lambda x: ~x.isin(*STOP))
    return _docs(spark, sf_dir).select("doc_id", F.size(kept).cast("long").alias("n_left"), F.size(_tokens()).cast("long").alias("n_all"))


@query("N10", f"""WITH tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), s AS (SELECT doc_id, token, tf, df, round(tf * ln((1 + (SELECT count(*) FROM documents)) / (df + 1)), 4) AS weight FROM tf JOIN df USING (token))
SELECT doc_id, token, tf, df, weight FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, token) <= 3""")
def tfidf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tfidf_best(_docs(spark, sf_dir), "doc_id", _tokens(), 3, 4)


@query("N10", f"""WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents), train AS (SELECT * FROM t WHERE doc_id % 4 <> 0 AND token NOT IN ({', '.join(repr(w) for w in STOP)})),
model AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS i, ln((1 + (SELECT count(*) FROM documents WHERE doc_id % 4 <> 0)) / (1 + df)) AS idf FROM (SELECT token, count(*) AS n, count(DISTINCT doc_id) AS df FROM train GROUP BY token ORDER BY n DESC, token LIMIT 300)),
x AS (SELECT doc_id, i, count(*) * max(idf) AS x FROM t JOIN model USING (token) WHERE doc_id % 4 = 0 GROUP BY doc_id, i)
SELECT doc_id, i AS "index", round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""")
def tfidf_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on three quarters of the documents, without stop words, 300 words at most; weights of the other quarter's texts."""
    docs = _docs(spark, sf_dir)
    model = T.tfidf_fit(docs.filter("doc_id % 4 <> 0"), _tokens(), STOP, 300)
    found = T.tfidf_transform(docs.filter("doc_id % 4 = 0"), "doc_id", _tokens(), model)
    return found.select("doc_id", F.col("index").cast("long").alias("index"), F.round("weight", 6).alias("weight"))


_VOCAB = f"vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS i FROM (SELECT unnest({_TOKENS}) AS token FROM conversations) GROUP BY token ORDER BY count(*) DESC, token LIMIT 50)"


@query("N11 A18 T29", f'WITH {_VOCAB} SELECT token, i AS "index" FROM vocab')
def vocab_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.vocabulary(table(spark, sf_dir, "conversations"), _tokens(), 50).withColumn("index", F.col("index").cast("long"))


@query("N11 N12 E11", f"""WITH {_VOCAB}, t AS (SELECT conv_id * 1000 + turn AS k, unnest({_TOKENS}) AS token, generate_subscripts({_TOKENS}, 1) AS p FROM conversations),
s AS (SELECT k, list(coalesce(i, 51) ORDER BY p) AS ids FROM t LEFT JOIN vocab USING (token) GROUP BY k) SELECT k, array_to_string(list_transform(range(1, 17), lambda j: coalesce(ids[j], 0)), ',') AS ids FROM s""")
def pad_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.functions.vectors import pad

    talks = table(spark, sf_dir, "conversations").withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    vocab = T.vocabulary(talks, _tokens(), 50)
    return T.indexed(talks, "k", _tokens(), vocab, 51).select("k", F.array_join(pad(F.col("ids"), 16, F.lit(0)), ",").alias("ids"))


@query("N13 W5", "SELECT previous, tag, count(*) AS n FROM (SELECT role AS tag, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS previous FROM conversations) GROUP BY previous, tag")
def tag_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.transitions(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("N13", f"SELECT role AS tag, word, count(*) AS n FROM (SELECT role, ({_TOKENS})[1] AS word FROM conversations) GROUP BY role, word")
def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").withColumn("word", F.get(_tokens(), F.lit(0)))
    return T.emissions(talks, "role", "word")


_HMM = f"""WITH RECURSIVE w AS (SELECT conv_id, role, coalesce(({_TOKENS})[1], '') AS word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(({_TOKENS})[1], ''), role) AS p, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations),
train AS (SELECT * FROM w WHERE conv_id % 4 <> 0), tags AS (SELECT role AS tag, row_number() OVER (ORDER BY role) AS k, count(*) AS size FROM train GROUP BY role), n AS (SELECT count(*) AS n_tags FROM tags),
steps AS MATERIALIZED (SELECT f.tag AS a, t.tag AS b, t.k, ln((1 + coalesce(c, 0))::DOUBLE / (n_tags + sum(coalesce(c, 0)) OVER (PARTITION BY f.tag))) AS s FROM (SELECT tag FROM tags UNION ALL SELECT '') f, tags t, n LEFT JOIN (SELECT coalesce(previous, '') AS a, role AS b, count(*) AS c FROM train GROUP BY 1, 2) m ON m.a = f.tag AND m.b = t.tag),
shown AS MATERIALIZED (SELECT x.conv_id, x.p, t.tag, t.k, ln((1 + coalesce(c, 0))::DOUBLE / (size + (SELECT count(DISTINCT word) FROM train) + 1)) AS e FROM w x JOIN tags t ON x.conv_id % 4 = 0 LEFT JOIN (SELECT role AS tag, word, count(*) AS c FROM train GROUP BY 1, 2) m ON m.tag = t.tag AND m.word = x.word),
v AS (SELECT conv_id, p, tag, shown.k, s + e AS score, [tag] AS path FROM shown JOIN steps ON a = '' AND b = tag WHERE p = 1
  UNION ALL SELECT conv_id, p, tag, k, score, path FROM (SELECT x.conv_id, x.p, x.tag, x.k, v.score + s + e AS score, list_append(v.path, x.tag) AS path, row_number() OVER (PARTITION BY x.conv_id, x.tag ORDER BY v.score + s DESC, v.k) AS best FROM v JOIN shown x ON x.conv_id = v.conv_id AND x.p = v.p + 1 JOIN steps ON a = v.tag AND b = x.tag) WHERE best = 1),
ends AS (SELECT conv_id, path FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p DESC, score DESC, k) = 1)
SELECT role AS truth, count(*) AS n, round(avg(CASE WHEN path[p] = role THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM w JOIN ends USING (conv_id) GROUP BY role"""


@query("N13 J12 A14", _HMM)
def hmm_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of turns tagged from their first words, per role. Counts of words are joined; the driver holds those of tags."""
    talks = table(spark, sf_dir, "conversations").withColumn("word", F.coalesce(F.get(_tokens(), F.lit(0)), F.lit("")))
    train, test = talks.filter("conv_id % 4 <> 0"), talks.filter("conv_id % 4 = 0")
    moves = T.transitions(train, "conv_id", "turn", "role").toPandas()
    shown = T.emissions(train, "role", "word")
    sizes = shown.groupBy("tag").agg(F.sum("n").alias("n")).toPandas()
    n_words = shown.select(F.count_distinct("word")).first()[0]
    counted = T.with_counts(test, "word", shown, sorted(set(moves["tag"])))
    turn = F.struct("turn", "word", "role", "counts")
    rows = counted.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t")).select("conv_id", F.col("t.counts").alias("counts"), F.col("t.role").alias("truth"))
    tagged = T.viterbi(rows, "counts", moves, sizes, n_words).select(F.inline(F.arrays_zip("truth", "tags")))
    return A.accuracy(tagged, "truth", "tags", by="truth")


_HMM_WORDS = f"""WITH RECURSIVE w AS (SELECT conv_id, turn, role, word, p FROM (SELECT conv_id, turn, role, unnest({_TOKENS}) AS word, generate_subscripts({_TOKENS}, 1) AS p FROM conversations)),
train AS (SELECT * FROM w WHERE conv_id % 4 <> 0), tags AS (SELECT role AS tag, row_number() OVER (ORDER BY role) AS k, count(*) AS size FROM train GROUP BY role), n AS (SELECT count(*) AS n_tags FROM tags),
moved AS (SELECT coalesce(lag(role) OVER (PARTITION BY conv_id, turn ORDER BY p), '') AS a, role AS b FROM train),
steps AS MATERIALIZED (SELECT f.tag AS a, t.tag AS b, ln((1 + coalesce(c, 0))::DOUBLE / (n_tags + sum(coalesce(c, 0)) OVER (PARTITION BY f.tag))) AS s FROM (SELECT tag FROM tags UNION ALL SELECT '') f, tags t, n LEFT JOIN (SELECT a, b, count(*) AS c FROM moved GROUP BY 1, 2) m ON m.a = f.tag AND m.b = t.tag),
shown AS MATERIALIZED (SELECT x.conv_id, x.turn, x.p, t.tag, t.k, ln((1 + coalesce(c, 0))::DOUBLE / (size + (SELECT count(DISTINCT word) FROM train) + 1)) AS e FROM w x JOIN tags t ON x.conv_id % 4 = 0 LEFT JOIN (SELECT role AS tag, word, count(*) AS c FROM train GROUP BY 1, 2) m ON m.tag = t.tag AND m.word = x.word),
v AS (SELECT conv_id, turn, p, tag, shown.k, s + e AS score, [tag] AS path FROM shown JOIN steps ON a = '' AND b = tag WHERE p = 1
  UNION ALL SELECT conv_id, turn, p, tag, k, score, path FROM (SELECT x.conv_id, x.turn, x.p, x.tag, x.k, v.score + s + e AS score, list_append(v.path, x.tag) AS path, row_number() OVER (PARTITION BY x.conv_id, x.turn, x.tag ORDER BY v.score + s DESC, v.k) AS best FROM v JOIN shown x ON x.conv_id = v.conv_id AND x.turn = v.turn AND x.p = v.p + 1 JOIN steps ON a = v.tag AND b = x.tag) WHERE best = 1),
ends AS (SELECT conv_id, turn, path FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY p DESC, score DESC, k) = 1)
SELECT role AS truth, count(*) AS n, round(avg(CASE WHEN path[p] = role THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM w JOIN ends USING (conv_id, turn) GROUP BY role"""


def _tagged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every turn, with its place and the turn's role for a tag."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(_tokens()).alias("p", "word"))


@query("N13 J12 A14 A20", _HMM_WORDS)
def hmm_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each turn tagged with roles, per role; three quarters of the conversations train."""
    words = _tagged_words(spark, sf_dir)
    counts = G.count(words.filter("conv_id % 4 <> 0"), ["conv_id", "turn"], "p", "role", "word")
    tagged = G.tag(words.filter("conv_id % 4 = 0"), ["conv_id", "turn"], "p", "word", counts)
    return A.accuracy(tagged, "role", "tagged", by="role").withColumnRenamed("role", "truth")


@query("N13", f"SELECT role AS tag, word, count(*) AS n FROM (SELECT role, unnest({_TOKENS}) AS word FROM conversations) GROUP BY role, word")
def emissions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.emissions(_tagged_words(spark, sf_dir), "role", "word")


_RANKED = r"""WITH RECURSIVE s AS (
  SELECT doc_id, p, w FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM (
    SELECT doc_id, list_filter(list_transform(string_split_regex(lower(text), '[.!?
]+'), lambda x: list_distinct(list_filter(string_split_regex(x, '[^\p{L}]+'), lambda y: y <> ''))), lambda x: len(x) > 0) AS l FROM documents))
), size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
words AS MATERIALIZED (SELECT doc_id, p, unnest(w) AS word, sqrt(len(w)) AS norm FROM s),
likeness AS MATERIALIZED (SELECT a.doc_id, a.p AS a, b.p AS b, count(*) / (any_value(a.norm) * any_value(b.norm)) AS c FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.word = b.word AND a.p <> b.p GROUP BY 1, 2, 3),
steps AS MATERIALIZED (SELECT doc_id, a, b, c / sum(c) OVER (PARTITION BY doc_id, a) AS c FROM likeness),
x AS (SELECT 0 AS k, doc_id, p, 1.0::DOUBLE / n AS score FROM s JOIN size USING (doc_id)
  UNION ALL SELECT any_value(x.k) + 1, x.doc_id, x.p, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * coalesce(sum(y.score * steps.c), 0)
  FROM x JOIN size USING (doc_id) LEFT JOIN steps ON steps.doc_id = x.doc_id AND steps.b = x.p LEFT JOIN x AS y ON y.doc_id = x.doc_id AND y.p = steps.a WHERE x.k < 30 GROUP BY x.doc_id, x.p)
SELECT doc_id, p AS place, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, p) AS INT) AS rank FROM x WHERE k = 30 QUALIFY rank <= 3"""


@query("N14 N2 O5", _RANKED)
def top_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sentences of each document that share most with its others."""
    return summaries(_docs(spark, sf_dir), "doc_id", F.col("text"))


@query("N15", r"""SELECT p_partkey AS id, array_to_string(list_concat(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)), list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4))), ' ') AS parts FROM (SELECT p_partkey, '<' || split_part(p_name, ' ', 1) || '>' AS w FROM part)""")
def subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(X.subwords(F.substring_index("p_name", " ", 1), 3, 4), " ").alias("parts"))


@query("N17", """SELECT conv_id, turn, array_to_string(list_concat([-100], flatten(list_transform(w, lambda x: list_concat([ascii(x) % 7], list_transform(range(1, (length(x) + 2) // 3), lambda i: -100)))), [-100]), ',') AS labels
FROM (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM conversations)""")
def label_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in pieces of three letters, a special token before and after: a word's label stands at its first piece."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", _tokens().alias("w"))
    ids = F.flatten(F.transform("w", lambda x, i: F.array_repeat(i, F.ceil(F.length(x) / 3).cast("int"))))
    none = F.array(F.lit(None).cast("int"))
    labels = T.aligned_labels(F.col("ids"), F.transform("w", lambda x: F.ascii(x) % 7))
    return rows.select("conv_id", "turn", "w", F.concat(none, ids, none).alias("ids")).select("conv_id", "turn", F.array_join(labels, ",").alias("labels"))


@query("N18 F34", "SELECT lang, code, code * 10 AS ten FROM (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM documents))")
def class_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and numbers of classes, there and back through maps."""
    names = F.array_sort(F.collect_set("lang"))
    one = _docs(spark, sf_dir).agg(F.map_from_arrays(names, F.sequence(F.lit(0), F.size(names) - 1)).alias("m"))
    return one.select(F.explode("m").alias("lang", "code")).select("lang", F.col("code").cast("long").alias("code"), (F.col("code") * 10).cast("long").alias("ten"))


@query("S4 F33 T28", "SELECT event_id, event_type AS kind, concat_ws(';', CAST(user_id AS VARCHAR), CAST(user_id + 1 AS VARCHAR)) AS users, 'a: b' AS note FROM events")
def kv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key : value lines, of which a repeated key becomes a list and a line without a colon says nothing."""
    events = table(spark, sf_dir, "events")
    text = F.concat_ws("\n", F.concat(F.lit("Kind  : "), "event_type"), F.lit("no colon here"), F.concat(F.lit("User: "), F.col("user_id").cast("string")), F.concat(F.lit("User : "), (F.col("user_id") + 1).cast("string")), F.lit("Note: a: b"))
    lines = events.select("event_id", F.posexplode(F.split(text, "\n")).alias("at", "line")).filter(F.col("line").contains(":"))
    key, value = X.field_value(F.col("line"))
    values = lines.select("event_id", key.alias("key"), F.struct("at", value.alias("v")).alias("x")).groupBy("event_id", "key").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("v"))
    maps = values.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("m"))
    return maps.select("event_id", F.col("m")["Kind"][0].alias("kind"), F.array_join(F.col("m")["User"], ";").alias("users"), F.col("m")["Note"][0].alias("note"))


@query("F30 F31", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, '{\"id\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    return rows.withColumn("again", F.to_json(F.struct(F.col("event_id").alias("id"), "k")))


@query("S14", "SELECT doc_id, lang, md5(replace(text, chr(10), ' ')) AS sentence FROM documents")
def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as lines 'sentence,label', parted at the last comma."""
    return _parted(_docs(spark, sf_dir)).withColumn("sentence", F.md5("sentence"))


def _parted(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(","), "lang").alias("value"))
    pattern = r"(?s)^(.*),([^,]*)$"
    return lines.select("doc_id", F.regexp_extract("value", pattern, 2).alias("lang"), F.regexp_extract("value", pattern, 1).alias("sentence"))


@query("N2 F27", r"""SELECT doc_id, len(s) AS n_sentences, list_max(list_transform(s, lambda x: len(regexp_extract_all(x, '[\p{L}\p{N}]+(?:[''’][\p{L}]+)*|[^\p{L}\p{N}\s]')))) AS most_tokens, md5(array_to_string(s, chr(10))) AS parted
FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?]+)\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: x <> '') AS s FROM documents)""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences end with a run of stops before white space; tokens are words, with what follows an apostrophe, and single marks."""
    rows = _docs(spark, sf_dir).select("doc_id", X.sentences(F.col("text")).alias("s"))
    most = F.array_max(F.transform("s", lambda x: F.size(X.word_tokens(x))))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), most.cast("long").alias("most_tokens"), F.md5(F.array_join("s", "\n")).alias("parted"))


@query("S13", "SELECT kind, count(*) AS n_rows, CAST(sum(len(string_split(t, chr(10)))) AS BIGINT) AS n_lines, CAST(sum(length(t)) AS BIGINT) AS n_characters FROM (SELECT 'documents' AS kind, text AS t FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY kind")
def corpus_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four corpora as one, and what each brings."""
    one = lambda name, c: table(spark, sf_dir, name).select(F.lit(name).alias("kind"), F.col(c).alias("t"))
    whole = one("documents", "text").unionByName(one("pages", "html")).unionByName(one("conversations", "text")).unionByName(one("benchmark", "text"))
    return whole.groupBy("kind").agg(F.count("*").alias("n_rows"), F.sum(F.size(F.split("t", "\n"))).cast("long").alias("n_lines"), F.sum(F.length("t")).cast("long").alias("n_characters"))


@query("P20 S13", r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_lines FROM documents WHERE trim(text) <> ''")
def nonempty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter(F.trim("text") != "").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("n_lines"))


@query("X7", """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Menu: ' || p_brand || chr(10) || 'Focus: ' || CASE WHEN p_size > 25 THEN p_type ELSE 'all' END WHEN 1 THEN 'Order: "' || p_name || '"'
  WHEN 2 THEN 'Wanted: ' || p_name || chr(10) || 'Budget: ' || CASE WHEN p_size > 25 THEN 'high' ELSE 'medium' END ELSE 'Dish: ' || p_name END AS prompt FROM part""")
def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four templates filled in, with their defaults where an argument is missing."""
    big = F.col("p_size") > 25
    given = F.create_map(F.lit("menu"), F.col("p_brand"), F.lit("focus"), F.when(big, F.col("p_type")), F.lit("order"), F.col("p_name"), F.lit("preference"), F.col("p_name"), F.lit("budget"), F.when(big, F.lit("high")), F.lit("dish"), F.col("p_name"))
    name = F.element_at(F.array(*[F.lit(n) for n in X.PROMPTS]), (F.col("p_partkey") % len(X.PROMPTS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.filled(name, given).alias("prompt"))


@query("N19", """SELECT '【' || p_brand || '】' AS section, count(*) AS n_items, min(p) AS least, max(p) AS greatest, count(*) FILTER (WHERE p = 0) AS n_free
FROM (SELECT p_brand, CASE WHEN p_size % 10 = 0 THEN 0 ELSE p_size * 10 END AS p FROM part) GROUP BY p_brand""")
def menu_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menus as text, a section heading and a line an item, parsed back: items and price range of each section."""
    item = F.concat("p_name", F.lit(" - "), F.when(F.col("p_size") % 10 == 0, "無料").otherwise(F.concat(F.lit("¥"), F.format_number(F.col("p_size") * 10, 0))))
    menus = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 50).alias("menu"), "p_brand").agg(F.array_join(F.array_sort(F.collect_list(item)), "\n").alias("items"))
    text = menus.groupBy("menu").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("【"), "p_brand", F.lit("】\n"), "items"))), "\n\n").alias("text"))
    lines = X.menu_items(text, "menu", F.col("text"))
    return lines.groupBy("section").agg(F.count("*").alias("n_items"), F.min("price").alias("least"), F.max("price").alias("greatest"), F.count_if(F.col("price") == 0).alias("n_free"))
