"""Queries over databases: the tables are written as SQLite files to the shared folder and read from there."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.lineage import prepare
from quillstone.plans.registry import query
from quillstone.sources import sqlite
from quillstone.sources.catalog import table


def _stored(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The folder of a table's databases, one a task of its scan."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/databases-{uuid4().hex}"
    sqlite.write(table(spark, sf_dir, name), folder, name)
    return folder


@query("S1 P4 P12", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag, CAST(l_shipdate AS TIMESTAMP) AS l_shipdate FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def sqlite_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of large quantities that came back: both conditions are SQLite's to test, and only named columns are read."""
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
    rows = sqlite.read(spark, _stored(spark, sf_dir, "lineitem"), "lineitem", *names).filter("l_quantity >= 45 AND l_returnflag = 'R'")
    return rows.withColumns({"l_linenumber": F.col("l_linenumber").cast("int"), "l_shipdate": F.to_timestamp_ntz("l_shipdate")})


@query("S1 A1", "SELECT p_brand, p_type, count(*) AS n, max(p_size) AS largest, round(sum(p_retailprice), 2) AS price FROM part WHERE p_name LIKE 'red%' GROUP BY p_brand, p_type")
def sqlite_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose names begin alike, counted by brand and type, from a database's table."""
    parts = sqlite.Catalog(spark, _stored(spark, sf_dir, "part")).table("part").filter("p_name LIKE 'red%'")
    return parts.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.max("p_size").cast("int").alias("largest"), F.round(F.sum("p_retailprice"), 2).alias("price"))
