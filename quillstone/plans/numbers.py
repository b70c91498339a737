"""Vector, statistics, set and learning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import dates
from quillstone.functions import vectors as V
from quillstone.operators import duplicates as D
from quillstone.operators import ml
from quillstone.operators import network as N
from quillstone.operators import ranges as R
from quillstone.operators import search as S
from quillstone.operators import sketches as K
from quillstone.operators import stats as A
from quillstone.operators import text as T
from quillstone.operators import vector_index as X
from quillstone.operators.lineage import cut
from quillstone.plans.registry import query
from quillstone.sources.catalog import SQL, Catalog, table

_COS = "round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


@query("E2 E3 E4 O5 J11 T21 C22", f"SELECT vec_id, {_COS} AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return S.top_k(items, items.filter("vec_id = 7"), 20)


@query("E2 W6", f'SELECT vec_id, label, score, place FROM (SELECT vec_id, label, {_COS} AS score, row_number() OVER (PARTITION BY label ORDER BY {_COS} DESC, vec_id) AS place FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7)) WHERE place <= 3')
def cosine_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return S.top_k_by(items, items.filter("vec_id = 7"), 3, "label").withColumn("place", F.col("place").cast("long"))


@query("E5 E7", f"SELECT vec_id, {_COS} AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 11) WHERE vec_id <> 11 ORDER BY score DESC, vec_id LIMIT 10")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.neighbours(_items(spark, sf_dir), 11, 10)


_KNN = """SELECT q.vec_id AS query_id, i.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) + 0.0 AS score FROM embeddings q JOIN embeddings i ON q.vec_id % 50 = 0 AND i.vec_id <> q.vec_id"""


@query("E2 E5 E7", f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS place, vec_id, score FROM ({_KNN}) QUALIFY place <= 10")
def index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id 50 divides, among all: the index with all cells probed."""
    items = _items(spark, sf_dir)
    return X.saved(spark, items).exact(items.filter("vec_id % 50 = 0"), 10).withColumn("score", F.col("score") + 0.0)


@query("E5 E7 C21")
def index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from half of the cells, as these vectors lie evenly; a test holds its recall against the exact one."""
    items = _items(spark, sf_dir)
    index = X.saved(spark, items)
    return index.search(items.filter("vec_id % 50 = 0"), 10, probes=max(1, len(index.centres) // 2))


@query("E6", f"""WITH q AS (SELECT list_transform(range(1, 65), lambda i: a[i]::DOUBLE - b[i]::DOUBLE + c[i]::DOUBLE) AS q FROM (SELECT max(embedding) FILTER (WHERE vec_id = 1) AS a, max(embedding) FILTER (WHERE vec_id = 2) AS b, max(embedding) FILTER (WHERE vec_id = 3) AS c FROM embeddings))
SELECT vec_id, {_COS} AS score FROM embeddings, q WHERE vec_id NOT IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 10""")
def analogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.analogy(_items(spark, sf_dir), 1, 2, 3, 10)


@query("A19 E10", 'SELECT label, position, round(avg(x), 6) AS value FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS position, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, position')
def mean_pool_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mean_pool(_items(spark, sf_dir), "label").select("label", F.col("position").cast("long").alias("position"), F.round("value", 6).alias("value"))


_RANKED = "SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS vec_id FROM t GROUP BY token"


@query("E9", f"WITH t AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')) AS token FROM conversations) SELECT conv_id, turn, count(*) AS n_known FROM t JOIN ({_RANKED}) USING (token) JOIN embeddings USING (vec_id) GROUP BY conv_id, turn")
def vector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that have a vector; others drop out. The frequent words have vectors, by their rank, as many as there are."""
    items = _items(spark, sf_dir)
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    talks = table(spark, sf_dir, "conversations")
    counts = talks.select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranked = R.numbered(counts, [F.col("n").desc(), "token"], "k").select("token", (F.col("k") - 1).alias("vec_id"))
    known = ranked.join(items, "vec_id").select("token", "embedding")
    tokens = talks.select("conv_id", "turn", F.explode(words).alias("token"))
    return tokens.join(known, "token").groupBy("conv_id", "turn").agg(F.count("embedding").alias("n_known"))


@query("E11", "SELECT vec_id, array_to_string(list_transform(list_concat(list_slice(embedding, 1, 4), [0.0, 0.0]), lambda x: CAST(round(x * 1000) AS INT)), ',') AS padded FROM embeddings")
def crop_and_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = V.pad(F.slice("embedding", 1, 4), 6, F.lit(0.0).cast("float"))
    # Floats are multiplied as floats; as doubles some would fall on the other side of a half.
    return _items(spark, sf_dir).select("vec_id", F.array_join(F.transform(cut, lambda x: F.round(x * F.lit(1000).cast("float")).cast("int").cast("string")), ",").alias("padded"))


@query("F29 O7", """SELECT vec_id, round(list_sum(e), 5) + 0.0 AS total, round(list_sum(e) / len(e), 6) + 0.0 AS mean, list_min(e) AS least, list_max(e) AS greatest, len(list_distinct(e)) AS n_distinct, list_sort(e)[1] AS first_sorted, list_reverse(e)[1] AS first_reversed
FROM (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 2) + 0.0) AS e FROM embeddings)""")
def list_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    rows = _items(spark, sf_dir).select("vec_id", F.transform(V.doubles(F.col("embedding")), lambda x: F.round(x, 2) + 0.0).alias("e"))
    return rows.select("vec_id", (F.round(V.total(e), 5) + 0.0).alias("total"), (F.round(V.total(e) / F.size(e), 6) + 0.0).alias("mean"), F.array_min(e).alias("least"), F.array_max(e).alias("greatest"), F.size(F.array_distinct(e)).cast("long").alias("n_distinct"), F.sort_array(e)[0].alias("first_sorted"), F.reverse(e)[0].alias("first_reversed"))


@query("F35", """SELECT vec_id, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(tanh(x), 6) AS tanh, round(greatest(x, 0), 6) AS relu, round(exp(x) / list_sum(list_transform(e, lambda y: exp(y))), 6) AS first_share, list_position(e, list_max(e)) - 1 AS top
FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding::DOUBLE[] AS e FROM embeddings)""")
def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).select("vec_id", V.doubles(F.col("embedding")).alias("e")).withColumn("x", F.col("e")[0])
    x = F.col("x")
    return rows.select("vec_id", F.round(V.sigmoid(x), 6).alias("sigmoid"), F.round(F.tanh(x), 6).alias("tanh"), F.round(V.relu(x), 6).alias("relu"), F.round(V.softmax(F.col("e"))[0], 6).alias("first_share"), V.argmax(F.col("e")).alias("top"))


@query("F36", """SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: e[i] + e[i])), 5) AS doubled, round(list_sum(list_slice(e, 1, 8)), 6) AS first_row, round(e[1] + e[9] + e[17] + e[25] + e[33] + e[41] + e[49] + e[57], 6) AS first_column, len(list_concat(e, e)) AS joined
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def tensor_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight by eight: element-wise sum, sums along both ways, joining."""
    rows = _items(spark, sf_dir).select("vec_id", V.doubles(F.col("embedding")).alias("e")).withColumn("m", V.reshape(F.col("e"), 8)).withColumn("t", V.transpose(F.col("m")))
    e = F.col("e")
    return rows.select("vec_id", F.round(V.total(V.add(e, e)), 5).alias("doubled"), F.round(V.total(F.col("m")[0]), 6).alias("first_row"), F.round(V.total(F.col("t")[0]), 6).alias("first_column"), F.size(F.concat(e, e)).cast("long").alias("joined"))


@query("F36", """WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT a.i, b.i AS j, round(sum(a.x * b.x), 6) + 0.0 AS product FROM l a JOIN l b USING (vec_id) GROUP BY a.i, b.i""")
def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transpose of the whole matrix times the matrix: one small product a batch of rows, then their sums."""
    return S.gram(_items(spark, sf_dir)).select("i", "j", (F.round("product", 6) + 0.0).alias("product"))


@query("F26", """SELECT l_linenumber AS n, count(*) AS rows, round(sum(l_quantity + l_tax), 2) AS added, round(sum(l_quantity - l_tax), 2) AS taken, round(sum(l_quantity * l_tax), 2) AS times,
round(sum(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END), 2) AS per, count(*) FILTER (WHERE l_discount = 0) AS undivided FROM lineitem GROUP BY l_linenumber""")
def calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    of = lambda op, a, b: V.calculate(F.lit(op), a, b)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("n"))
    return rows.agg(F.count("*").alias("rows"), F.round(F.sum(of("add", q, t)), 2).alias("added"), F.round(F.sum(of("subtract", q, t)), 2).alias("taken"), F.round(F.sum(of("multiply", q, t)), 2).alias("times"), F.round(F.sum(F.when(d != 0, of("divide", t, d))), 2).alias("per"), F.count_if(d == 0).alias("undivided"))


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("A16 T34", " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS deviation, min({c}) AS least, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, max({c}) AS greatest FROM lineitem" for c in _NUMERIC))
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.describe(table(spark, sf_dir, "lineitem"), _NUMERIC)


@query("A17", "SELECT bool_or(doc_id IS NULL) AS doc_id, bool_or(CASE WHEN doc_id % 50 = 3 THEN NULL ELSE lang END IS NULL) AS lang, bool_or(source IS NULL) AS source FROM documents")
def null_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 50 != 3, F.col("lang")).alias("lang"), "source")
    return A.null_columns(docs)


@query("A13 P4", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY event_type")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.value_counts(table(spark, sf_dir, "events").filter("event_type <> 'error'"), "event_type")


@query("F38 T34", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS z FROM customer")
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.standardise(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", F.round("z", 6).alias("z"))


@query("F34 P2", "SELECT c_custkey AS id, c_mktsegment AS segment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return A.label_encode(rows, "segment").select("id", "segment", F.col("code").cast("long").alias("code"))


_JUDGED = "SELECT quality AS truth, CASE WHEN n_chars > 900 THEN 1 ELSE 0 END AS predicted FROM documents JOIN labels USING (doc_id)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 900, 1).otherwise(0).alias("predicted"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth")), "doc_id")


@query("A22", f"""WITH r AS ({_JUDGED}), l AS (SELECT unnest([0, 1]) AS label), c AS (SELECT label, count(*) FILTER (WHERE truth = label AND predicted = label) AS hit, count(*) FILTER (WHERE predicted = label) AS said, count(*) FILTER (WHERE truth = label) AS support FROM l, r GROUP BY label),
p AS (SELECT label, support, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM c)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support FROM p""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.report(_judged(spark, sf_dir), "truth", "predicted")


@query("A20 A14 A24", f"SELECT count(*) AS n, round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({_JUDGED})")
def overall_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.accuracy(_judged(spark, sf_dir), "truth", "predicted")


@query("A15 A24", "SELECT n_regionkey, count(*) AS n, round(sum(c_acctbal), 2) AS total, min(c_acctbal) AS least, max(c_acctbal) AS greatest, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS richest FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def column_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    best = F.max(F.struct("c_acctbal", (-F.col("c_custkey")).alias("k")))["k"]
    return rows.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.min("c_acctbal").alias("least"), F.max("c_acctbal").alias("greatest"), (-best).alias("richest"))


@query("U1 U3 A6", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("name"))
    return one("nation", "n_name").unionByName(one("region", "r_name")).unionByName(one("customer", "c_mktsegment")).distinct()


@query("U7", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("U7 U4", "SELECT p_partkey AS k FROM part EXCEPT SELECT doc_id FROM documents")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, sf_dir, "documents").select("doc_id"))


@query("U6 O8", "SELECT p_partkey AS id, CASE WHEN p_partkey < 100 THEN 'first' ELSE 'second' END AS part FROM part ORDER BY p_partkey LIMIT 200")
def disjoint_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).orderBy("id").limit(200)
    return head.withColumn("part", F.when(F.row_number().over(Window.orderBy("id")) <= 100, "first").otherwise("second"))


@query("O9", "SELECT p_partkey AS id FROM part ORDER BY md5(CAST(p_partkey AS VARCHAR) || ':42'), p_partkey LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return part.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":42"))), "id").limit(100)


@query("J15", "SELECT vec_id, label, doc_id, toxic FROM embeddings FULL OUTER JOIN labels ON vec_id = doc_id")
def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and labels, whole: some ids are in one of them only, on either side."""
    items, labels = _items(spark, sf_dir).select("vec_id", "label"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return items.join(labels, F.col("vec_id") == F.col("doc_id"), "full")


@query("J15", "SELECT doc_id, quality, label FROM embeddings RIGHT JOIN labels ON vec_id = doc_id")
def right_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, labels = _items(spark, sf_dir).select("vec_id", "label"), table(spark, sf_dir, "labels")
    return items.join(labels, F.col("vec_id") == F.col("doc_id"), "right").select("doc_id", "quality", "label")


@query("J15", "SELECT c_custkey FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON o_custkey = c_custkey")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_semi")


@query("J15", """SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error, the user's last purchase until then."""
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return R.as_of(left, right, ["user_id"], "ts", ["purchase_id"]).select("event_id", "purchase_id")


@query("J15", "SELECT e.event_id, count(x.event_id) AS n_before FROM (SELECT * FROM events WHERE event_type = 'error') e LEFT JOIN events x ON x.user_id = e.user_id AND x.ts < e.ts AND x.ts >= e.ts - INTERVAL 1 DAY GROUP BY e.event_id")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error, the user's events of the day before it: a range over the user's time, without a join."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").withColumn("at", seconds)
    before = Window.partitionBy("user_id").orderBy("at").rangeBetween(-86_400_000_000, -1)
    return rows.withColumn("n_before", F.count("*").over(before)).filter("event_type = 'error'").select("event_id", "n_before")


@query("J15", """WITH o AS (SELECT o_orderkey, o_custkey, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS s, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) + 1 + o_orderkey % 60 AS e FROM orders),
l AS (SELECT o_custkey, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS s, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) + CAST(l_quantity AS BIGINT) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderkey, count(*) AS n_shipped, CAST(sum(least(o.e, l.e) - greatest(o.s, l.s)) AS BIGINT) AS days FROM o JOIN l ON o.o_custkey = l.o_custkey AND o.s < l.e AND l.s < o.e GROUP BY o_orderkey""")
def ship_order_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order, open for up to 60 days, the customer's shipments under way meanwhile, and the days they share."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", dates.day_of(F.col("o_orderdate")).cast("long").alias("s1"))
    opened = orders.withColumn("e1", F.col("s1") + 1 + F.col("o_orderkey") % 60)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), dates.day_of(F.col("l_shipdate")).cast("long").alias("s2"), F.col("l_quantity").cast("long").alias("n"))
    shipped = lines.join(orders, "o_orderkey").select("o_custkey", "s2", (F.col("s2") + F.col("n")).alias("e2"))
    found = R.overlapping(opened, shipped, ["o_custkey"], ("s1", "e1"), ("s2", "e2"))
    return found.groupBy("o_orderkey").agg(F.count("*").alias("n_shipped"), F.sum(F.least("e1", "e2") - F.greatest("s1", "s2")).alias("days"))


@query("J15", """WITH x AS (SELECT event_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS e FROM events WHERE event_type = 'error')
SELECT x.event_id, count(*) AS n_during FROM x JOIN (SELECT epoch_us(ts) AS t FROM events) y ON x.s < t + 1 AND t < x.e GROUP BY x.event_id""")
def during_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of anyone fall in the time an error lasts, its value in minutes; pairs are counted, not made."""
    events = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    errors = events.filter("event_type = 'error'").select("event_id", F.col("t").alias("s1"), (F.col("t") + F.round(F.col("value") * 60_000_000).cast("long")).alias("e1"))
    found = R.counted_within(errors, "event_id", ("s1", "e1"), events, "t")
    return found.select("event_id", F.col("n").alias("n_during"))


@query("J15", """SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3) ON o_custkey = c_custkey""")
def last_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the last three orders, or none: a lateral join."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    found = R.last_of(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 3, "left")
    return found.select("c_custkey", "o_orderkey", "o_totalprice")


@query("W7", """SELECT o_orderkey, rank() OVER w AS place, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS quarter, coalesce(lag(o_orderkey) OVER t, -1) AS previous, coalesce(lead(o_orderkey) OVER t, -1) AS next,
max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC), t AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, quarter, neighbours in time, greatest of three in a row and running sum, in cents, of each customer's orders: one shuffle by customer."""
    mine = Window.partitionBy("o_custkey")
    time = mine.orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.rank().over(mine.orderBy(F.col("o_totalprice").desc())).cast("long").alias("place"),
        F.ntile(4).over(mine.orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long").alias("quarter"),
        F.coalesce(F.lag("o_orderkey").over(time), F.lit(-1)).alias("previous"),
        F.coalesce(F.lead("o_orderkey").over(time), F.lit(-1)).alias("next"),
        F.max("o_totalprice").over(time.rowsBetween(-2, 0)).alias("moving"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(time.rowsBetween(Window.unboundedPreceding, 0)).alias("running"),
    )


@query("A25", """SELECT l_returnflag, abs(n - exact) <= 0.05 * exact AS count_is_near, abs(below - 0.5) <= 0.01 AS median_is_near FROM (SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact, count(DISTINCT l_orderkey) AS n, 0.5 AS below FROM lineitem GROUP BY l_returnflag)""")
def approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of distinct counts and medians, and whether they are as near as they should be."""
    rows = table(spark, sf_dir, "lineitem")
    sketch = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.01).alias("n"), F.percentile_approx("l_extendedprice", F.lit(0.5), F.lit(10000)).alias("median"))
    # Counted by itself: beside a sketch, each different key would hold a sketch of its own.
    exact = rows.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_distinct("l_orderkey").alias("exact"))
    known = sketch.join(exact, F.col("l_returnflag").eqNullSafe(F.col("flag"))).drop("l_returnflag")  # a row a flag
    both = rows.join(F.broadcast(known), F.col("l_returnflag").eqNullSafe(F.col("flag"))).groupBy("l_returnflag").agg(F.first("n").alias("n"), F.first("exact").alias("exact"), F.avg((F.col("l_extendedprice") <= F.col("median")).cast("double")).alias("below"))
    return both.select("l_returnflag", (F.abs(F.col("n") - F.col("exact")) <= 0.05 * F.col("exact")).alias("count_is_near"), (F.abs(F.col("below") - 0.5) <= 0.01).alias("median_is_near"))


_SKETCHED = "SELECT CASE k WHEN 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR) WHEN 1 THEN strftime(ts, '%G-W%V') ELSE 'all' END AS period, user_id, value FROM events, (SELECT unnest([0, 1, 2]) AS k)"


@query("A25", f"SELECT period, count(*) AS n_events, count(DISTINCT user_id) AS n_users, round(avg(CASE WHEN value <= 10 THEN 1.0 ELSE 0.0 END), 6) AS share_10, round(avg(CASE WHEN value <= 40 THEN 1.0 ELSE 0.0 END), 6) AS share_40, true AS users_near, true AS shares_near FROM ({_SKETCHED}) GROUP BY period")
def sketch_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches made by day and united by week and for all: the exact figures, and whether the estimates are within three
    standard errors of them."""
    events = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    days = cut(K.by_day(events, day, F.col("user_id"), F.col("value")))
    week = lambda c: F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))
    periods = lambda c: [c.cast("string"), week(c), F.lit("all")]
    sketched = None
    for p in periods(F.col("day")):
        one = K.estimates(K.united(days, p), at=(10, 40)).select("period", "n_keys", "rank_0", "rank_1")
        sketched = one if sketched is None else sketched.unionByName(one)
    per = events.withColumn("period", F.explode(F.array(*periods(day)))).groupBy("period")
    share = lambda v: F.round(F.avg((F.col("value") <= v).cast("double")), 6)
    exact = per.agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users"), share(10).alias("share_10"), share(40).alias("share_40"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 3 * K.RANK_ERROR
    return exact.join(sketched, "period").select("period", "n_events", "n_users", "share_10", "share_40", (F.abs(F.col("n_keys") - F.col("n_users")) <= F.greatest(3 * K.COUNT_ERROR * F.col("n_users"), F.lit(1))).alias("users_near"), (near("rank_0", "share_10") & near("rank_1", "share_40")).alias("shares_near"))


@query("A25", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("A23", f"""WITH j AS ({_JUDGED.replace('quality AS truth', "CASE WHEN doc_id % 6 = 0 THEN -100 ELSE quality END AS truth")}), r AS (SELECT * FROM j WHERE truth <> -100),
l AS (SELECT unnest([0, 1]) AS label), c AS (SELECT label, count(*) FILTER (WHERE truth = label AND predicted = label) AS hit, count(*) FILTER (WHERE predicted = label) AS said, count(*) FILTER (WHERE truth = label) AS support FROM l, r GROUP BY label),
p AS (SELECT support, round(CASE WHEN said > 0 THEN hit / said ELSE 0 END, 6) AS p, round(CASE WHEN support > 0 THEN hit / support ELSE 0 END, 6) AS r, round(CASE WHEN hit > 0 THEN 2 * (hit / said) * (hit / support) / (hit / said + hit / support) ELSE 0 END, 6) AS f FROM c)
SELECT round(sum(p * support) / sum(support), 6) AS precision, round(sum(r * support) / sum(support), 6) AS recall, round(sum(f * support) / sum(support), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM p""")
def masked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores weighted by support; rows whose truth is -100 don't count."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 900, 1).otherwise(0).alias("predicted"))
    truth = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 6 == 0, -100).otherwise(F.col("quality")).alias("truth"))
    return A.weighted_report(docs.join(truth, "doc_id"), "truth", "predicted", ignore=-100)


@query("M11", "SELECT CAST(least(floor((embedding[1]::DOUBLE + 0.5) / 1.0 * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM embeddings WHERE embedding[1]::DOUBLE BETWEEN -0.5 AND 0.5 GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).select(V.doubles(F.col("embedding"))[0].alias("x"))
    return A.histogram(rows, "x", -0.5, 0.5, 20)


@query("U2", SQL + """, p AS (SELECT a.id AS g, b.id FROM books a JOIN books b ON lower(trim(a.title)) = lower(trim(b.title)) AND lower(trim(a.author_sort)) = lower(trim(b.author_sort)) AND a.id < b.id)
SELECT id, count(*) AS n_lists FROM (SELECT g AS id, g FROM p GROUP BY g UNION ALL SELECT id, g FROM p) GROUP BY id""")
def list_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all groups, each group a list, put end to end; how often each comes."""
    return D.list_counts(Catalog(spark, sf_dir).books, [F.lower(F.trim("title")), F.lower(F.trim("author_sort"))])


@query("A25", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("level"))


@query("F21", "SELECT o_orderkey, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS day FROM orders")
def day_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.day_number(iso).alias("day"))


@query("M1", "SELECT doc_id, quality, doc_id % 5 = 0 AS is_test FROM labels")
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.split_by_id(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", 5, 0)


@query("M1", "SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) % 4 = 0 AS is_test FROM labels")
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.split_stratified(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", 4)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")


@query("M2 M3 N10")
def doc_classifier_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.fit_predict(ml.text_pipeline("forest"), _labelled(spark, sf_dir), F.col("quality"), F.col("doc_id") % 4 == 0).select("doc_id", "label", "prediction")


@query("M4 M5")
def doc_classifier_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.fit_predict(ml.text_pipeline("network"), _labelled(spark, sf_dir), F.col("quality"), F.col("doc_id") % 4 == 0).select("doc_id", "label", "prediction")


@query("M6 N16")
def doc_classifier_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    is_test = F.col("doc_id") % 4 == 0
    pipeline = ml.text_pipeline("vectors", parts=ml.text_parts(rows.filter(~is_test)))
    return ml.fit_predict(pipeline, rows, F.col("quality"), is_test).select("doc_id", "label", "prediction")


_PAID = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("M4 M5 A24 F38")
def network_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a line comes to over 40,000 with discount and tax, learned from four columns by a network: lines of a fifth
    of the orders, held out, with the prediction."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    rows = table(spark, sf_dir, "lineitem").withColumns({"label": (price > 40_000).cast("int"), "out": F.col("l_orderkey") % 5 == 0})
    model = N.train(rows, _PAID, F.col("label"), F.col("out"), F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return model.predict(rows.filter("out")).select("l_orderkey", "l_linenumber", "label", "prediction", F.round("chance", 4).alias("chance"))


@query("N16 E5")
def word2vec_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")
    talks = table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    vectors = cut(ml.word_vectors(talks, words, "key").select("word", F.col("vector").alias("embedding")))
    return S.top_k(vectors.filter("word <> 'the'"), vectors.filter("word = 'the'"), 5, id_col="word")
