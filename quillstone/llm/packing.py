"""Packing documents into sequences by linear grouping.

Documents become token pieces of at most the capacity. Full pieces are sequences by themselves. The others are dealt
evenly over shards of a bounded number of pieces, and each shard is packed by linear grouping: its large lengths fall
into groups of equal cardinality and are rounded up to the largest of their group; a linear programme over
configurations of the few rounded sizes, solved by column generation, says how often to use which; real pieces take the
rounded ones' places; what is left over goes by best fit, long ones first. There are as many groups as it takes for the
small pieces to fill what rounding wastes. Where best fit alone needs fewer sequences for a shard, its packing is taken.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import cut, pieces, prepare, text_or_empty
from quillstone.llm.word_bpe import tokenizer

CAPACITY, END_ID, SHARD = 4096, 1, 65536
#: Lengths over this share of the capacity are grouped; least and greatest number of groups; unit to which rounded sizes are rounded up.
LARGE, FEW_GROUPS, MANY_GROUPS, UNIT = 1 / 8, 24, 192, 8

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32. Null text: the end id alone."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path or default_tokenizer())  # where the vocabulary lies on this machine
        for part, data, off in pieces(batches, limit=2 << 20):
            ids, at = coder.encode(data, off)
            n_docs = len(off) - 1
            flat = np.full(len(ids) + n_docs, end_id, "<u4")  # an end id after each row's
            flat[np.arange(len(ids)) + np.repeat(np.arange(n_docs), np.diff(at))] = ids
            begin = at[:-1] + np.arange(n_docs)
            size = np.diff(at) + 1
            count = -(-size // capacity)
            row = np.repeat(np.arange(n_docs), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, size[row] - start)
            raw = memoryview(flat.tobytes())
            first = begin[row] + start
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(first.tolist(), (first + length).tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, _PIECE)


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Configurations of the sizes and how often each is used in an optimal fractional packing (column generation)."""
    k = len(sizes)
    columns = [np.where(np.arange(k) == i, capacity // sizes[i], 0) for i in range(k)]
    basis = np.array(columns, float).T
    x = demand / np.diag(basis)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        best = np.zeros(capacity + 1)
        chosen = np.full(capacity + 1, -1)
        order = np.argsort(sizes, kind="stable")
        ordered, worth = sizes[order], price[order]
        reach = np.searchsorted(ordered, np.arange(capacity + 1), "right")
        for c in range(int(ordered[0]), capacity + 1):
            m = reach[c]
            value = best[c - ordered[:m]] + worth[:m]
            i = value.argmax()
            if value[i] > best[c - 1] + 1e-12:
                best[c], chosen[c] = value[i], order[i]
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        new, c = np.zeros(k), capacity
        while c > 0:
            if chosen[c] < 0:
                c -= 1
            else:
                new[chosen[c]] += 1
                c -= sizes[chosen[c]]
        move = np.linalg.solve(basis, new)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(move > 1e-9, x / move, np.inf)
        out = int(step.argmin())
        x = x - step[out] * move
        x[out] = step[out]
        basis[:, out] = new
    return [(basis[:, i].astype(int), max(0.0, float(x[i]))) for i in range(k)]


def groups(lengths: np.ndarray, large: np.ndarray, spare: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Groups of equal cardinality of the large pieces, longest first, and their rounded sizes in units.

    The fewest groups of which rounding wastes no more than ``spare``, doubled up to MANY_GROUPS.
    """
    large = large[np.argsort(-lengths[large], kind="stable")]
    k = FEW_GROUPS
    while True:
        parts = np.array_split(large, min(k, len(large)))
        rounded = np.array([-(-int(lengths[g[0]]) // UNIT) for g in parts])
        waste = sum(int(r) * UNIT * len(g) for r, g in zip(rounded, parts)) - int(lengths[large].sum())
        if waste <= spare or k >= min(MANY_GROUPS, len(large)):
            return parts, rounded
        k *= 2


def by_linear_grouping(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of large pieces, as the whole part of an optimal fractional use of configurations has them."""
    large = np.flatnonzero(lengths > capacity * LARGE)
    if not len(large):
        return []
    parts, rounded = groups(lengths, large, int(lengths.sum() - lengths[large].sum()))
    sizes, same = np.unique(rounded, return_inverse=True)
    pools = [[i for g, s in zip(parts, same) if s == k for i in g.tolist()][::-1] for k in range(len(sizes))]
    members = []
    for config, times in configurations(np.minimum(sizes, capacity // UNIT), np.array([len(p) for p in pools], float), capacity // UNIT):
        for _ in range(int(times + 1e-6)):
            took = [pools[k].pop() for k in np.flatnonzero(config) for _ in range(config[k]) if pools[k]]
            if took:
                members.append(took)
    return members


def best_fit(lengths: np.ndarray, members: list[list[int]], capacity: int) -> list[list[int]]:
    """The bins with all other pieces put in, long ones first, each where it leaves the least room."""
    where = np.zeros(len(lengths), bool)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, took in enumerate(members):
        where[took] = True
        r = capacity - int(lengths[took].sum())
        by_room[r].append(b)
        mask |= 1 << r
    rest = np.flatnonzero(~where)
    rest = rest[np.argsort(-lengths[rest], kind="stable")]
    for i, size in zip(rest.tolist(), lengths[rest].tolist()):
        fit = mask >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
            members[b].append(i)
        else:
            r, b = capacity, len(members)
            members.append([i])
        by_room[r - size].append(b)
        mask |= 1 << (r - size)
    return members


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; bins count from 0. Never more bins than best fit, long pieces first, needs."""
    members = best_fit(lengths, by_linear_grouping(lengths, capacity), capacity)
    if len(members) > -(-int(lengths.sum()) // capacity):
        members = min(members, best_fit(lengths, [], capacity), key=len)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, took in enumerate(members):
        where[took] = b
        ends = np.cumsum(lengths[took])
        offset[took] = ends - lengths[took]
    return where, offset


def pack_pieces(found: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Rows with a ``length`` of at most the capacity, with sequence_id and offset beside their columns.

    Pieces are dealt to shards by their row number in the written table, so repeated rows don't meet in one shard.
    """
    rows = cut(found).withColumn("__row", F.monotonically_increasing_id())
    short = rows.filter(F.col("length") < capacity)
    shards = max(1, -(-short.count() // shard))
    fields = [f for f in rows.schema.fields if f.name != "__row"]
    names = [f.name for f in fields]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__row")
        where, offset = pack(table["length"].to_numpy().astype(np.int64), capacity)
        base = table["__shard"][0].as_py() << 32
        out = table.select(names).append_column("sequence_id", pa.array(where.astype(np.int64) + base)).append_column("offset", pa.array(offset))
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    packed = short.withColumn("__shard", F.pmod(F.xxhash64("__row"), F.lit(shards)).cast("long")).groupBy("__shard").applyInArrow(run, schema)
    full = rows.filter(F.col("length") >= capacity).select(*names, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row.

    Null text counts as empty and packs as the end id alone. Rows that repeat an id are packed each for itself. An
    empty table gives no rows; columns other than doc_id and text are not looked at.
    """
    return pack_pieces(token_pieces(docs, path, capacity, end_id), capacity)
