"""Prefix trie of conversations by most-significant-digit radix partitioning.

Turns are dictionary-encoded. A bucket is a trie node with all rows behind it: its conversations' further turns. Each
round passes over the turns that all conversations of a bucket share, deals the rest by their next turn to smaller
buckets, and goes on with those of more than LOCAL turns. The others are local: a task sorts one at a time by multikey
quicksort, and its recursion emits the nodes. A bucket too large to be local that holds one conversation is a plain chain
and is emitted row by row, so no conversation, prefix or bucket has to fit in a task. When all buckets are done, sums over
subtrees are carried up through the rounds.

A node is named by its smallest member and its depth: a member has one prefix of each depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import cut, prepare

#: Turns of a local bucket at most. Keys of over a HOT-th of all rows are broadcast, at most HOT of them; and tables of buckets up to SMALL rows.
LOCAL, HOT, SMALL = 1 << 12, 1000, 1 << 15
#: Conversations that share a base, and the number of shares of it that they may take over.
BLOCK, SHARES = 100, 6

_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def join_counted(rows: DataFrame, table: DataFrame, key: list[str], n: str, total: int, most: int) -> DataFrame:
    """Rows with the columns of a table that has one row a key, n rows of ``rows`` each, ``total`` in all and ``most`` at
    most: frequent keys by broadcast."""
    if most * HOT <= total:
        return rows.join(table, key)
    frequent = F.col(n) * HOT > total
    hot = F.broadcast(table.filter(frequent))
    rest = rows.join(hot.select(*key), key, "left_anti").join(table.filter(~frequent), key)
    return rows.join(hot, key).unionByName(rest)


def _counts(table: DataFrame, n: str) -> tuple[int, int]:
    """Sum and greatest of a column."""
    return tuple(x or 0 for x in table.agg(F.sum(n), F.max(n)).first())


def _if_small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= SMALL else table


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each conversation within a range of sorted rows."""
    last, n = None, 0
    for batch in batches:
        conv = batch.column(0).to_numpy()
        fresh = np.append(True, conv[1:] != conv[:-1])
        at = np.arange(len(conv)) - np.maximum.accumulate(np.where(fresh, np.arange(len(conv)), 0)) + 1
        if last is not None and conv[0] == last:
            same = int(np.argmax(fresh[1:])) + 1 if fresh[1:].any() else len(conv)
            at[:same] += n
        last, n = conv[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "local"])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest and points (code points of the text) of each turn.

    Order is by turn, null first, then role and the text's digest. Null role and text count as empty. Rows without a
    conv_id belong to no conversation. Rows are sorted over all tasks, so that a long conversation spans several.
    """
    prepare(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.length(text).cast("long").alias("points"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "points")
    placed = cut(placed.mapInArrow(_numbered, "conv_id long, digest binary, points long, local long").withColumn("part", F.spark_partition_id()))
    # Ranges follow one another, so only the first conversation of each has turns before it. A row a task comes back.
    edges = placed.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "local")).alias("last")).orderBy("part").collect()
    shifts, last, before = [], None, 0
    for part, first, (conv, n) in edges:
        if first == last:
            shifts.append((part, first, before))
        before = before + n if conv == last else n
        last = conv
    if not shifts:
        return placed.select("conv_id", F.col("local").alias("pos"), "digest", "points")
    shift = placed.sparkSession.createDataFrame(shifts, "part int, conv_id long, before long")
    return placed.join(F.broadcast(shift), ["conv_id", "part"], "left").select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "points")


def encoded(rows: DataFrame) -> DataFrame:
    """Turns with a number for each distinct one in place of its digest."""
    entries = rows.groupBy("digest").agg(F.count("*").alias("n"), F.first("points").alias("p"))
    book = cut(entries.withColumn("id", F.monotonically_increasing_id()))
    return join_counted(rows, book.drop("p"), ["digest"], "n", *_counts(book, "n")).select("conv_id", "pos", "id", "points")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of their block's base: (conv, length), and (conv, length, depth, id, points) of each turn.

    The base of conversation c is c - c % 100; the first h of its turns, h = crc32(c) % 6, stand before those of c behind
    its own first h.
    """
    own = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = rows.filter(F.col("pos") < SHARES).withColumnRenamed("conv_id", "base")
    convs = own.withColumns({"base": F.col("conv_id") - F.pmod("conv_id", F.lit(BLOCK)), "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARES})
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = cut(convs.withColumn("length", F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "n", "base", "h", "shared", "length"))
    first = convs.filter("shared > 0").join(heads, "base").filter("pos <= shared").select(F.col("conv_id").alias("conv"), "length", F.col("pos").alias("depth"), "id", "points")
    last = join_counted(rows, convs, ["conv_id"], "n", *_counts(convs, "n")).filter("pos > h").select(F.col("conv_id").alias("conv"), "length", (F.col("pos") - F.col("h") + F.col("shared")).alias("depth"), "id", "points")
    return convs.select(F.col("conv_id").alias("conv"), "length"), first.unionByName(last)


def quicksort(ids: np.ndarray, start: np.ndarray, length: np.ndarray, conv: np.ndarray, points: np.ndarray, depth: int, parent: int) -> tuple[list[list], list[tuple[int, int, int]]]:
    """Multikey quicksort of the sequences ids[start:start + length], whose nodes are emitted as they are met.

    The nodes begin at ``depth``, below one with smallest member ``parent``. Gives a list for each node in the order of
    _NODE, and (conv, smallest member, depth) of where each sequence ends.
    """
    nodes: list[list] = []
    above: list[int] = []
    ends: list[tuple[int, int, int]] = []
    open_ = [(np.arange(len(start)), 0, -1)]
    while open_:
        members, at, up = open_.pop()
        over = length[members] == at
        if over.any():
            ends += [(int(c), nodes[up][0], depth + at - 1) for c in conv[members[over]].tolist()]
            members = members[~over]
        if not len(members):
            continue
        digit = ids[start[members] + at]
        pivot = digit[len(digit) // 2]
        same = digit == pivot
        if not same.all():
            open_ += [(part, at, up) for part in (members[digit < pivot], members[digit > pivot]) if len(part)]
        members = members[same]
        smallest, turn = int(conv[members].min()), int(points[start[members[0]] + at])
        nodes.append([smallest, depth + at, parent if up < 0 else nodes[up][0], len(members), 0, 0, (len(members) - 1) * turn])
        above.append(up)
        open_.append((members, at + 1, len(nodes) - 1))
    for k in range(len(nodes) - 1, -1, -1):  # a node comes before those below it
        node = nodes[k]
        node[5] = max(node[5], 1)
        if above[k] >= 0:
            over = nodes[above[k]]
            over[4] += 1
            over[5] += node[5]
            over[6] += node[6]
    return nodes, ends


_FOUND = "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, parent, conv, depth, id, points) sorted by bucket, conv and depth: nodes as kind 0, ends as kind 1."""
    out: list[list] = []

    def flush() -> pa.RecordBatch:
        names = [f.split()[0] for f in _FOUND.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32() if k == 0 else pa.int64()) for k in range(8)], names=names)
        out.clear()
        return batch

    rows = ((b.column(0).to_numpy(), np.stack([b.column(k).to_numpy() for k in range(1, 6)])) for b in batches if b.num_rows)
    runs = ((int(bucket[a]), part[:, a:z]) for bucket, part in rows for a, z in _same(bucket))
    for _, group in groupby(runs, lambda r: r[0]):
        parent, conv, depth, ids, points = np.concatenate([part for _, part in group], axis=1)
        edge = np.array([a for a, _ in _same(conv)])
        nodes, ends = quicksort(ids, edge, np.diff(np.append(edge, len(conv))), conv[edge], points, int(depth[0]), int(parent[0]))
        out += [[0, *n] for n in nodes]
        out += [[1, c, d, smallest, 0, 0, 0, 0] for c, smallest, d in ends]
        if len(out) > 10_000:
            yield flush()
    yield flush()


def _same(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal values."""
    edge = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return zip(edge.tolist(), np.append(edge[1:], len(values)).tolist())


def trie(convs: DataFrame, rows: DataFrame, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """The trie of sequences: nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens), and ends
    (conv, conv_id, depth), the node where each conversation ends.

    convs: conv, length. rows: conv, length, depth (from 1), id, points. The root has depth 0 and no parent, and is there
    unless convs is empty.
    """
    bucket = ["b_conv", "b_at"]
    begun = convs.agg(F.min("conv").alias("b_conv"), F.lit(0).cast("long").alias("b_at"), F.lit(None).cast("long").alias("parent"), F.count("*").alias("n"), F.lit(0).cast("long").alias("points")).filter("n > 0")
    buckets, n_buckets, rounds, made = cut(begun), 1, [], []
    root = F.lit((buckets.first() or [None])[0]).cast("long")
    total, longest = _counts(convs, "length")
    ends = [convs.filter("length = 0").select("conv", root.alias("conv_id"), F.lit(0).cast("long").alias("depth"))]
    rows = cut(rows.withColumns({"b_conv": root, "b_at": F.lit(0).cast("long")}))
    while True:
        stats = cut(rows.groupBy(*bucket, "depth").agg(F.count("*").alias("n_at"), F.min("id").alias("low"), F.max("id").alias("high"), F.min("points").alias("points")))
        reach = stats.join(_if_small(buckets.select(*bucket, "n"), n_buckets), bucket).groupBy(*bucket).agg(F.max("depth").alias("far"), F.min(F.when((F.col("n_at") < F.col("n")) | (F.col("low") != F.col("high")), F.col("depth") - 1)).alias("near"))
        held = cut(buckets.join(_if_small(reach, n_buckets), bucket, "left").select(*buckets.columns, F.coalesce("near", "far", "b_at").alias("stop")))
        stops = _if_small(held.select(*bucket, "n", "stop"), n_buckets)
        chain = stats.join(stops, bucket).filter(F.col("depth") <= F.col("stop")).select(*bucket, "depth", "n", "points")
        placed = rows.join(stops.drop("n"), bucket)
        if held.filter("stop > b_at").count():
            done = placed.filter((F.col("depth") == F.col("length")) & (F.col("depth") <= F.col("stop")))
            ends.append(done.select("conv", F.col("b_conv").alias("conv_id"), "depth"))
        placed = placed.filter(F.col("depth") > F.col("stop"))
        first = placed.filter(F.col("depth") == F.col("stop") + 1)
        below = first.groupBy(*bucket, "stop", "id").agg(F.min("conv").alias("c_conv"), F.count("*").alias("n"), F.sum(F.col("length") - F.col("stop")).alias("size"), F.min("points").alias("points"))
        below = cut(below.withColumn("kind", F.when(F.col("size") <= local, 0).when(F.col("n") == 1, 1).otherwise(2)))
        sorts = {kind: (n, most) for kind, n, most in below.groupBy("kind").agg(F.count("*"), F.max("n")).collect()}
        n_below, most = sum(n for n, _ in sorts.values()), max([0, *(m for _, m in sorts.values())])
        # Where each conversation goes; long ones have many rows.
        child, of = below.select(*bucket, "id", "c_conv", "kind", "n"), first.select(*bucket, "id", "conv", "length")
        to = of.join(F.broadcast(child), [*bucket, "id"]) if n_below <= SMALL else join_counted(of, child, [*bucket, "id"], "n", total, most)
        to = to.select("conv", F.col("length").alias("long"), "c_conv", "kind")
        moved = cut(join_counted(placed, to, ["conv"], "long", total, longest).select("kind", "c_conv", "b_conv", "stop", "conv", "length", "depth", "id", "points"))
        near = moved.filter("kind = 0").select("c_conv", "b_conv", "conv", "depth", "id", "points").repartition("c_conv").sortWithinPartitions("c_conv", "conv", "depth")
        found = cut(near.mapInArrow(_local, _FOUND))
        made.append(found.filter("kind = 0").select(*_NODE))
        ends.append(found.filter("kind = 1").select(F.col("conv_id").alias("conv"), F.col("parent_conv_id").alias("conv_id"), "depth"))
        if 1 in sorts:
            alone = moved.filter("kind = 1")
            one = {"n_convs": F.lit(1).cast("long"), "n_children": (F.col("depth") < F.col("length")).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long")}
            made.append(alone.select(F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("stop") + 1, F.col("b_conv")).otherwise(F.col("conv")).alias("parent_conv_id"), *[c.alias(n) for n, c in one.items()]))
            ends.append(alone.filter("depth = length").select("conv", F.col("conv").alias("conv_id"), "depth"))
        ground = below.select(*bucket, F.col("c_conv").alias("conv_id"), (F.col("stop") + 1).alias("depth"), "kind")
        rounds.append((held, chain, ground, found, n_buckets, n_below, set(sorts)))
        if 2 not in sorts:
            break
        over = moved.filter("kind = 2")
        ends.append(over.filter("depth = stop + 1 AND depth = length").select("conv", F.col("c_conv").alias("conv_id"), "depth"))
        buckets, n_buckets = cut(below.filter("kind = 2").select(F.col("c_conv").alias("b_conv"), (F.col("stop") + 1).alias("b_at"), F.col("b_conv").alias("parent"), "n", "points")), sorts[2][0]
        rows = over.select("conv", "length", "depth", "id", "points", F.col("c_conv").alias("b_conv"), (F.col("stop") + 1).alias("b_at")).filter(F.col("depth") > F.col("b_at"))
    totals = None
    for held, chain, ground, found, n_buckets, n_below, sorts in reversed(rounds):
        tops = found.filter("kind = 0").select("conv_id", "depth", "n_leaves", "saved_tokens")
        known = [tops.join(_if_small(ground.filter("kind = 0"), n_below), ["conv_id", "depth"])]
        if 1 in sorts:
            known.append(ground.filter("kind = 1").withColumns({"n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long")}))
        if 2 in sorts:
            known.append(ground.filter("kind = 2").join(_if_small(totals, n_below), ["conv_id", "depth"]))
        columns = [*bucket, "n_leaves", "saved_tokens"]
        below = known[0].select(*columns)
        for more in known[1:]:
            below = below.unionByName(more.select(*columns))
        sums = below.groupBy(*bucket).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        own = held.select(*bucket, F.col("b_at").alias("depth"), "n", "points").unionByName(chain)
        up = Window.partitionBy(*bucket).orderBy(F.col("depth").desc())
        joined = own.join(_if_small(held.select(*bucket, "stop", "parent"), n_buckets), bucket).join(_if_small(sums, n_buckets), bucket, "left")
        nodes = cut(joined.select(
            F.col("b_conv").alias("conv_id"),
            "depth",
            F.when(F.col("depth") == F.col("b_at"), F.col("parent")).otherwise(F.col("b_conv")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.when(F.col("depth") < F.col("stop"), 1).otherwise(F.coalesce("children", F.lit(0))).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + F.sum((F.col("n") - 1) * F.col("points")).over(up)).cast("long").alias("saved_tokens"),
            (F.col("depth") == F.col("b_at")).alias("top"),
        ))
        totals = nodes.filter("top").select("conv_id", "depth", "n_leaves", "saved_tokens")
        made.append(nodes.select(*_NODE))
    return _union(made), _union(ends)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def build(conversations: DataFrame, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends (see ``trie``) of the rebuilt conversations of a table with conv_id, turn, role and text.

    Two turns are the same if their role and text are, null being empty. Repeated rows are turns each. Rows without a
    conv_id are left out; an empty table gives no nodes; other columns are not looked at.
    """
    return trie(*rebuilt(cut(encoded(turns(conversations)))), local=local)


def _member_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, depth, conv) in order: the SHA-256 of each node's list, of which one number is held at a time."""
    key, state, out = None, None, []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], names=["conv_id", "depth", "ends_sha256"])
        out.clear()
        return batch

    for batch in batches:
        for node, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (node, depth) != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (node, depth), hashlib.sha256(b"%d" % conv)
            else:
                state.update(b",%d" % conv)
        if len(out) > 10_000:
            yield flush()
    if key:
        out.append((*key, state.hexdigest()))
    yield flush()


def end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of nodes where conversations end: their ids, rising, with commas between."""
    rows = ends.select("conv_id", "depth", "conv").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "conv")
    return rows.mapInArrow(_member_digests, "conv_id long, depth long, ends_sha256 string")
