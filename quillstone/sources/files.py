"""Readers and writers of the plain formats."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import isbn
from quillstone.functions.text import field_value


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(name, text): one row a file."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))


def concatenated(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """The lines of all files."""
    return spark.read.text(folder, pathGlobFilter=pattern)


def csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=header, encoding=encoding)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of objects."""
    return spark.read.schema(schema).json(path, multiLine=True)


def labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text, label) of 'text,label' lines, parted at the last comma; lines without one are left out."""
    pattern = r"^(.*),([^,]*)$"
    lines = spark.read.text(path).filter(F.col("value").contains(","))
    return lines.select(F.regexp_extract("value", pattern, 1).alias("text"), F.regexp_extract("value", pattern, 2).alias("label"))


def write_labelled_lines(rows: DataFrame, path: str, seed: int) -> None:
    """Writes 'text,label' lines, dealt out by a seeded hash."""
    lines = rows.select(F.concat("text", F.lit(","), "label").alias("value"))
    lines.sort(F.xxhash64("value", F.lit(seed)), "value").write.mode("overwrite").text(path)


def fields_of(lines: DataFrame, key: str = "id") -> DataFrame:
    """(key, fields): 'Name : value' lines (key, line_no, line) as a map to lists; lines without a colon say nothing."""
    name, value = field_value(F.col("line"))
    found = lines.filter(F.col("line").contains(":")).select(key, name.alias("name"), F.struct("line_no", value.alias("v")).alias("x"))
    lists = found.groupBy(key, "name").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("v"))
    return lists.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("fields"))


def resource(spark: SparkSession, folder: str, name: str) -> str:
    """The text of one named resource; an unknown one is an error."""
    if "/" in name or not name:
        raise ValueError(f"not a resource name: {name!r}")
    found = text_files(spark, folder).filter(F.col("name") == f"{name}.txt").select("text").first()
    if found is None:
        raise KeyError(f"no resource {name!r}")
    return found["text"]


def resources(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the named resources of a folder, in order."""
    return text_files(spark, folder).select(F.regexp_replace("name", r"\.txt$", "").alias("name")).orderBy("name")


def write_json(rows: DataFrame, path: str) -> None:
    """A table as lines of JSON, as read_json reads them."""
    rows.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_vectors(rows: DataFrame, path: str) -> None:
    """(id, embedding) as Parquet, which keeps arrays of numbers as they are."""
    rows.select("id", F.col("embedding").cast("array<double>").alias("embedding")).write.mode("overwrite").parquet(path)


def isbns_in_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(name, isbns): valid numbers in the metadata text of each file, those of its 'Identifiers' line that are new last."""
    files = text_files(spark, folder, pattern)
    line = F.regexp_extract("text", r"Identifiers\s*:\s*(.+)", 1)
    other = F.trim(F.regexp_extract(line, r"(?i)isbn:([^\s,]+)", 1))
    found = isbn.extract(F.col("text"))
    more = F.when(isbn.valid(other) & ~F.array_contains(found, other), F.array(other)).otherwise(F.array().cast("array<string>"))
    return files.select("name", F.concat(found, more).alias("isbns"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def cached(spark: SparkSession, build, path: str, days: float, now: float | None = None, force: bool = False) -> DataFrame:
    """The table at ``path``, built anew if it is missing, forced, or older than ``days`` (a table just as old stays)."""
    now = time.time() if now is None else now
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if force or not fs.exists(done) or now - fs.getFileStatus(done).getModificationTime() / 1000 > days * 86400:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
