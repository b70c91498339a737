"""Exact deduplication through cuckoo-filter indexes of content digests.

Each scan task indexes the digests of its own rows and passes on one row a distinct text, so a group of copies
reaches the second round as a few rows a task; there, shards of the digest space, as many as the rows call for, are
merged one after the other by an index of the same kind. An index never holds more than about SHARD keys. A hit in the
filter counts only if the full digest and the content key (length and a second, independent digest) stored in the
bucket agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import as_bytes, cut, prepare, text_or_empty
from quillstone.llm.cuckoo import CuckooIndex

WHITE = b" \t\n\x0b\x0c\r"
_LAST = (1 << 63) - 1
#: Keys of an index, of about half a kilobyte each. A group of over a HOT-th of all rows is one of at most HOT, which are broadcast.
SHARD, HOT = 1 << 16, 1000


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = as_bytes(batch.column(1))
        data = data.tobytes()
        shas, checks = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            plain = data[a:b].translate(None, WHITE)
            shas.append(hashlib.sha256(plain).digest())
            checks.append(len(plain).to_bytes(8, "little") + hashlib.blake2b(plain, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.binary()), pa.array(checks, pa.binary()), batch.column(2)], names=["doc_id", "digest", "content", "points"])


def _better(a: tuple, b: tuple) -> tuple:
    """Of (points, doc_id, ties): more points, then the smaller id (null last); equal ones add their ties."""
    x, y = ((-v[0], _LAST if v[1] is None else v[1], v[1] is None) for v in (a, b))
    if x == y:
        return (a[0], a[1], a[2] + b[2])
    return a if x < y else b


def _merged(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.rows())
    for i in range(0, len(rows), 10_000):
        part = rows[i : i + 10_000]
        flat = [[r[0] for r in part], [r[1] for r in part], [r[2][0] for r in part], *([r[2][1][k] for r in part] for k in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(flat, (pa.binary(), pa.binary(), *[pa.int64()] * 4))], names=["digest", "content", "group_size", "points", "keep_id", "ties"])


def _index(batches: Iterator[pa.RecordBatch], most: int = SHARD) -> Iterator[pa.RecordBatch]:
    """Merges rows of one key: those of a shard, where a last column numbers shards in rising order, else as many as ``most`` keys have."""
    index, at = CuckooIndex(), None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        shards = columns[6] if len(columns) > 6 else None
        for i, (digest, content, n, points, doc, ties) in enumerate(zip(*columns[:6])):
            if shards[i] != at if shards else index.size >= most:
                yield from _merged(index)
                index, at = CuckooIndex(), shards and shards[i]
            row = index.find(digest, content)
            if row is None:
                index.insert(digest, content, (n, (points, doc, ties)))
            else:
                row[2] = (row[2][0] + n, _better(row[2][1], (points, doc, ties)))
    yield from _merged(index)


_GROUP = "digest binary, content binary, group_size long, points long, keep_id long, ties long"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256 of the text without ASCII white space), content key and code points of each row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("points", F.length("text").cast("long"))
    return rows.mapInArrow(_digests, "doc_id long, digest binary, content binary, points long")


def groups(rows: DataFrame, total: int | None = None) -> DataFrame:
    """One row for each distinct text: its size, its keeper and how many rows tie for keeper."""
    shards = -(-(rows.count() if total is None else total) // SHARD)
    one = rows.select("digest", "content", F.lit(1).cast("long").alias("group_size"), "points", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("ties"))
    some = one.mapInArrow(_index, _GROUP).withColumn("shard", F.pmod(F.xxhash64("digest", F.lit(5)), F.lit(max(1, shards))))
    return some.repartition("digest").sortWithinPartitions("shard").mapInArrow(_index, _GROUP)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The verdict on each row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts are one group. Of equal texts the row with the most code points
    stays, then the smallest id, a null id last. Rows that repeat an id and a text share the verdict of that id.
    An empty table gives no rows; other columns of the input are not looked at.
    """
    rows = cut(digests(docs, id_col, text_col))
    total = rows.count()
    best = cut(groups(rows, total)).withColumnRenamed("points", "most")
    key = ["digest", "content"]
    hot = F.broadcast(best.filter(F.col("group_size") * HOT > total))  # at most HOT rows
    found = rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(best.filter(F.col("group_size") * HOT <= total), key))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("most"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their columns, whatever these are called: exactly one of each group, also where rows repeat
    an id and a text. Null texts are one group with the empty ones. An empty table gives no rows."""
    best = cut(groups(cut(digests(docs, id_col, text_col))))
    plain = F.sha2(F.translate(text_or_empty(text_col), WHITE.decode(), ""), 256)
    keys = best.select(F.lower(F.hex("digest")).alias("sha"), F.col("keep_id").alias("id"), "points", "ties")
    named = docs.select(F.struct("*").alias("row"), plain.alias("sha"), F.col(id_col).cast("long").alias("id"), F.length(text_or_empty(text_col)).cast("long").alias("points"))
    a, b = named.alias("a"), keys.alias("b")
    kept = a.join(b, (F.col("a.sha") == F.col("b.sha")) & F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.points") == F.col("b.points"))).select("a.sha", "a.row", "b.ties")
    if best.filter("ties > 1").isEmpty():
        return kept.select("row.*")
    return kept.filter("ties = 1").unionByName(kept.filter("ties > 1").dropDuplicates(["sha"])).select("row.*")
