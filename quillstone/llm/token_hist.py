"""Exact histogram of encoded lengths, with suffix sums that answer every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import pieces, prepare, text_or_empty
from quillstone.llm.packing import default_tokenizer
from quillstone.llm.word_bpe import tokenizer

#: Lengths are summed in blocks of this many values, then over the blocks.
BLOCK = 1024


def length_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """length, n_docs: documents by encoded length, null text as empty. Tasks pass on sums, not documents."""
    prepare(docs.sparkSession)
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for _, data, off in pieces(batches, limit=2 << 20):
            length, n = np.unique(np.diff(coder.encode(data, off)[1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n.astype(np.int64))], names=["length", "n"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For each length: documents and tokens of that length or more, tokens left when cut there, share of documents no longer.

    Sums run within blocks of lengths, then over the blocks, of which there are longest / BLOCK.
    """
    rows = counts.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    down = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    whole = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(down), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(down), F.lit(0)).alias("t_above"), F.sum("d").over(whole).alias("d_all"), F.sum("t").over(whole).alias("t_all"))
    within = Window.partitionBy("block").orderBy(F.col("length").desc())
    sums = rows.withColumns({"d_in": F.sum("n_docs").over(within), "t_in": F.sum("n_tokens").over(within)}).join(blocks, "block")
    docs_ge, tokens_ge = F.col("d_in") + F.col("d_above"), F.col("t_in") + F.col("t_above")
    return sums.select(
        "length", "n_docs", "n_tokens",
        docs_ge.cast("long").alias("docs_at_least"),
        tokens_ge.cast("long").alias("tokens_at_least"),
        (F.col("t_all") - tokens_ge + F.col("length") * docs_ge).cast("long").alias("truncated_total"),
        ((F.col("d_all") - docs_ge + F.col("n_docs")) / F.col("d_all")).alias("share_up_to"),
    )


def length_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The histogram with its sums, one row for each length that occurs. An empty table gives no rows."""
    return suffix_sums(length_counts(docs, path))


def truncated_total(table: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``: one row, the least length of at least the limit, answers."""
    above = table.filter(F.col("length") >= limit).agg(F.min(F.struct("length", "docs_at_least", "tokens_at_least")).alias("r")).first()["r"]
    everything = table.agg(F.max("tokens_at_least")).first()[0] or 0
    return everything if above is None else everything - above["tokens_at_least"] + limit * above["docs_at_least"]


def quantile(table: DataFrame, q: float) -> int | None:
    """The least length that a share ``q`` of the documents doesn't exceed."""
    return table.filter(F.col("share_up_to") >= q).agg(F.min("length")).first()[0]
