"""Cutting lineage in the shared folder, and joins of skewed rows."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of over a HOT-th of all rows are broadcast, at most HOT of them.
HOT = 1000


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import the package, and gives checkpoints a folder where none is set.

    spark.checkpoint.dir is used as it is and must be set on a cluster. Only a session whose executors are threads of this
    process gets a temporary folder, which goes when the process ends.
    """
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="quillstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them from there: later steps don't recompute them."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def join_counted(rows: DataFrame, table: DataFrame, key: Sequence[str], n: Column, total: int) -> DataFrame:
    """Inner join with a table of one row a key, n rows of ``rows`` each of ``total``: frequent keys by broadcast, others shuffled."""
    hot = F.broadcast(table.filter(n * HOT > total))
    rest = rows.join(hot.select(*key), list(key), "left_anti").join(table.filter(n * HOT <= total), list(key))
    return rows.join(hot, list(key)).unionByName(rest)
