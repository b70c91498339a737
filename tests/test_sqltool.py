"""What read-only SQL lets through."""

import pytest

from quillstone.sources import sqltool

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sql", [
    "SELECT r_name FROM region ORDER BY 1",
    "WITH x AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1) SELECT r_name, n FROM x JOIN region ON k = r_regionkey WHERE n > (SELECT min(n) - 1 FROM x) ORDER BY 1",
    "SELECT r_name FROM region UNION SELECT n_name FROM nation",
    "SELECT id FROM range(5) WHERE id IN (SELECT r_regionkey FROM region) AND EXISTS (SELECT 1 FROM nation)",
    "SELECT n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS p FROM nation",
    "SELECT upper(r_name) AS u, explode(array(1, 2)) AS k FROM region",
    "VALUES (1), (2)",
    "SELECT filter(array(1, 2, 3), x -> x > 1) AS f, CAST(1 AS string) AS s, date_add(DATE'2024-01-01', 1) AS d, count(*) OVER () AS n FROM region WHERE r_name LIKE 'A%' AND r_regionkey IN (0, 1, 2) GROUP BY r_name",
    "SELECT first(r_name) FILTER (WHERE r_regionkey > 0) AS x, coalesce(max(r_regionkey), 0) AS y, percentile_approx(r_regionkey, 0.5) AS z FROM region",
])
def test_queries_run(spark, sql):
    assert sqltool.run_query(spark, SMALL, sql).count() > 0


@pytest.mark.parametrize("sql", [
    "SELECT java_method('java.lang.System', 'currentTimeMillis')",
    "SELECT r_name FROM region WHERE r_name = reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT (SELECT try_reflect('java.lang.System', 'currentTimeMillis')) AS t",
    "WITH x AS (SELECT java_method('java.lang.System', 'currentTimeMillis') AS t) SELECT * FROM x",
    "SELECT * FROM region JOIN LATERAL (SELECT java_method('java.lang.System', 'currentTimeMillis') AS t)",
    "SELECT sum(x) FROM (SELECT CASE WHEN true THEN reflect('java.lang.Math', 'random') END AS x)",
    "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home')",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getenv', 'HOME')",
    "SELECT upper(IDENTIFIER('java_' || 'method')('java.lang.System', 'currentTimeMillis'))",
    "SELECT transform(array(1), x -> IDENTIFIER('try_reflect')('java.lang.System', 'currentTimeMillis')) AS t",
    "SELECT transform(array(1), x -> java_method('java.lang.System', 'currentTimeMillis')) AS t",
    "SELECT r_name FROM region WHERE EXISTS (SELECT IDENTIFIER('reflect')('java.lang.Math', 'random'))",
    "SELECT r_name FROM region ORDER BY IDENTIFIER('reflect')('java.lang.Math', 'random')",
    "SELECT * FROM IDENTIFIER('region')",
    "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
    "SELECT a_function_of_the_session(1)",
    "SELECT `java_method`('java.lang.System', 'currentTimeMillis')",
    "SELECT * FROM text.`/etc/hostname`",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
    "SELECT r_name FROM region WHERE EXISTS (SELECT * FROM csv.`/etc/passwd`)",
    "SELECT * FROM elsewhere",
    "SELECT * FROM spark_catalog.default.region",
    "DROP TABLE region",
    "CREATE TABLE t AS SELECT 1",
    "INSERT INTO region VALUES (9, 'x')",
    "CACHE TABLE region",
    "SET spark.sql.ansi.enabled = false",
    "SHOW TABLES",
    "EXPLAIN SELECT 1",
    "FROM region INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT *",
])
def test_others_are_refused(spark, sql):
    with pytest.raises(sqltool.NotAQuery):
        sqltool.run_query(spark, SMALL, sql)


def test_answers_are_plain_values(spark):
    assert sqltool.answer(spark, SMALL, "SELECT count(*) AS n FROM region") == {"columns": ["n"], "rows": [[5]], "row_count": 1}
    assert "error" in sqltool.answer(spark, SMALL, "SELECT nothing FROM region")
    assert "error" in sqltool.answer(spark, SMALL, "SELECT * FROM text.`/etc/hostname`")
