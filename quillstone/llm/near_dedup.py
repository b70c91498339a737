"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian pruning, exact confirmation.

Rows with one and the same shingle set form a class, told by a commutative hash of the set, and need no comparing.
Every row falls into one bucket a band. First each row is held against two rows of its buckets: the least one, and the one whose buckets are
fullest, which in a family of copies is the text that they vary; so a bucket of any size gives two pairs a row. Of buckets
that still hold more than one component, the rows outside the largest one are compared with all rows of other
components, blocks with blocks, and only likely pairs become rows. A pair is pruned as soon as the posterior chance that its similarity reaches the threshold falls below the chosen miss probability;
survivors are confirmed on the word shingles of both whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import LOWER, as_bytes, cut, mix, pieces, prepare, shingles, text_or_empty
from quillstone.llm.components import components

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: A pair at the threshold shares no band with a chance of (1 - 0.75 ** 4) ** 32, about 5e-6.
BANDS, BAND_ROWS = 32, 4
#: Hashes of a signature, how many are compared at a time, and the posterior chance under which a pair is dropped. In a
#: family of copies most pairs are somewhat alike: many hashes keep those near the threshold few.
HASHES, STEP, MISS = 512, 32, 1e-5
#: Hashes that are kept in 16 bits, those of the bands; of the others 8 bits are. Fewer bits make more hashes agree, so no pair is lost by them.
WIDE = BANDS * BAND_ROWS
#: Rows of a bucket in a block; what a row is in a pair of blocks.
BLOCK = 2048
HOST, GUEST, BOTH = 0, 1, 2

_rng = np.random.default_rng(77003)
_A = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BAND_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, off in pieces(batches, most=4096):
        n = len(off) - 1
        h, row, _ = shingles(LOWER[data], off, WORDS)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        if len(h):
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
            h, row = h[new], row[new]
        size = np.bincount(row, minlength=n)
        filled = np.flatnonzero(size)
        begin = (np.cumsum(size) - size)[filled]
        sets, marks, keys = np.zeros((2, n), np.int64), np.zeros((n, HASHES), np.uint32), np.zeros((n, BANDS), np.uint64)
        if len(filled):
            sets[0, filled] = np.add.reduceat(h, begin).view(np.int64)
            sets[1, filled] = np.bitwise_xor.reduceat(mix(h + np.uint64(1)), begin).view(np.int64)
            short = (h >> np.uint64(32)).astype(np.uint32)
            for k in range(HASHES):
                marks[filled, k] = np.minimum.reduceat(short * _A[k] + _B[k], begin)
            banded = (marks[:, :WIDE] & 0xFFFF).reshape(n, BANDS, BAND_ROWS).astype(np.uint64)  # as signatures keep them: those that agree in a band meet there
            keys[:] = _BAND_SALT
            for k in range(BAND_ROWS):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, k])
        sig = np.concatenate((marks[:, :WIDE].astype("<u2").view(np.uint8), marks[:, WIDE:].astype(np.uint8)), 1)
        width = sig.shape[1]
        raw = sig.tobytes()
        sigs = pa.array([raw[width * i : width * (i + 1)] for i in range(n)], pa.binary())
        bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int64)), pa.array(sets[0]), pa.array(sets[1]), sigs, bands], names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "bands"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the shingle set, its signature and its band keys."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(_sketch, "doc_id long, n_shingles long, set_a long, set_b long, sig binary, bands array<long>")


@lru_cache(maxsize=None)
def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest equal hashes of n at which the chance of similarity >= threshold, prior uniform, is at least ``miss``."""
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _survivors(left: np.ndarray, right: np.ndarray, threshold: float = NUMERATOR / DENOMINATOR, miss: float = MISS) -> np.ndarray:
    """Which pairs of signatures are still likely after each batch of STEP hashes."""
    live, same = np.arange(len(left)), np.zeros(len(left), np.int64)
    for n in range(STEP, left.shape[1] + 1, STEP):
        same = same + (left[live, n - STEP : n] == right[live, n - STEP : n]).sum(1)
        keep = same >= least_matches(n, threshold, miss)
        live, same = live[keep], same[keep]
    return live


def _signatures(column: pa.Array) -> np.ndarray:
    raw = np.frombuffer(as_bytes(column)[0].tobytes(), np.uint8).reshape(len(column), 2 * WIDE + HASHES - WIDE)
    return np.concatenate((np.ascontiguousarray(raw[:, : 2 * WIDE]).view("<u2"), raw[:, 2 * WIDE :]), 1)


def _probable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        live = _survivors(_signatures(batch.column(2)), _signatures(batch.column(3)))
        yield batch.take(pa.array(live)).select(["a", "b"])


def _group_pairs(role: np.ndarray, edge: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of a host and a guest of each run of rows, ``most`` at a time or those of one host."""
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        hosts, guests = np.flatnonzero(role[a:b] != GUEST) + a, np.flatnonzero(role[a:b] != HOST) + a
        few = max(1, most // max(1, len(guests)))
        for k in range(0, len(hosts), few):
            part = hosts[k : k + few]
            yield np.repeat(part, len(guests)), np.tile(guests, len(part))


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likely pairs of different components in rows sorted by (key, low, high); no run of equal ones is parted."""

    def work(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, low, high, doc, comp, role = (rows.column(k).to_numpy() for k in range(6))
        minor = rows.column(6).to_numpy(zero_copy_only=False)
        sig, band = _signatures(rows.column(7)), rows.column(8).to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True])))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for i, j in _group_pairs(role, edge):
            other = (comp[i] != comp[j]) & (~minor[i] | (doc[i] < doc[j]))  # two guests of a bucket meet twice
            held.append((i[other], j[other]))
            size += len(held[-1][0])
            if size > 200_000:
                yield test(held, doc, sig, band)
                held, size = [], 0
        if held:
            yield test(held, doc, sig, band)

    def test(held: list[tuple[np.ndarray, np.ndarray]], doc: np.ndarray, sig: np.ndarray, band: np.ndarray) -> pa.RecordBatch:
        i, j = (np.concatenate(x) for x in zip(*held))
        live = np.zeros(0, np.int64)
        for k in range(0, len(i), 20_000):
            left, right = sig[i[k : k + 20_000]], sig[j[k : k + 20_000]]
            shared = (left[:, :WIDE] == right[:, :WIDE]).reshape(-1, BANDS, BAND_ROWS).all(2)
            mine = np.flatnonzero(shared.argmax(1) == band[i[k : k + 20_000]])  # the first band that the two share answers for the pair
            live = np.concatenate((live, k + mine[_survivors(left[mine], right[mine])]))
        x, y = doc[i[live]], doc[j[live]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) < 4096:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ends = np.any([x[1:] != x[:-1] for x in (rows.column(k).to_numpy() for k in range(3))], 0)
        last = int(np.flatnonzero(ends)[-1]) + 1 if ends.any() else 0
        if last:
            yield from work(rows.slice(0, last))
        held = [rows.slice(last)]
    if held:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        if rows:
            yield from work(rows[0])


def _words(text: bytes) -> set:
    words = text.lower().split()
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(WORDS))))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple = (None, None)
    for batch in batches:
        keep = []
        ids = batch.column(1).to_pylist()
        (a_data, a_off), (b_data, b_off) = as_bytes(batch.column(2)), as_bytes(batch.column(3))
        a_data, b_data = a_data.tobytes(), b_data.tobytes()
        for i, b in enumerate(ids):
            if last[0] != b:
                last = (b, _words(b_data[b_off[i] : b_off[i + 1]]))
            x, y = _words(a_data[a_off[i] : a_off[i + 1]]), last[1]
            both = len(x & y)
            if both and DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both):
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])


_BITS = 24


def _spot(col: str) -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64(col), F.lit(1 << _BITS)) + 1
    return F.bitmap_bucket_number(h), F.bitmap_bit_position(h)


def perhaps_in(rows: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id has its hash's bit set among those of ``ids`` (column id); a join must follow.

    The bits are a table of at most 2 ** 24 / 32768 = 512 rows of 4 KB, whatever the number of ids: small enough to
    broadcast. With very many ids all bits are set and all rows pass.
    """
    bucket, bit = _spot("id")
    bits = ids.select(bucket.alias("__bucket"), bit.alias("__bit")).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    bucket, bit = _spot(col)
    named = rows.withColumns({"__bucket": bucket, "__at": bit})
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = named.join(F.broadcast(bits), "__bucket")
    return joined.filter(F.floor(byte / F.pow(F.lit(2), F.col("__at") % 8)).cast("int") % 2 == 1).select(*rows.columns)


def _exact(likely: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by the shingles of both texts."""
    ids = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id")))
    texts = perhaps_in(docs.select("doc_id", "text"), "doc_id", ids)
    both = likely.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long"))


def _dealt(named: DataFrame) -> DataFrame:
    """Rows (key, band, doc_id, c) of buckets that hold more than one component c, dealt to pairs of blocks (low, high).

    Rows outside a bucket's largest component are minor. Each is a guest, with the minor ones of its own block ``high``, of
    every block ``low`` of hosts, and all rows are hosts; so each pair of components meets, and of n rows with m minor ones
    n * ceil(m / BLOCK) + m * (ceil(n / BLOCK) - 1) are sent out: where a row is host and guest it is sent once.
    """
    sizes = named.groupBy("key", "c").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    main = sizes.withColumnRenamed("n", "own").join(mixed, "key").filter("own = most").groupBy("key", "n", "most").agg(F.min("c").alias("main"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    rows = named.join(main, "key").withColumns({"minor": F.col("c") != F.col("main"), "lows": blocks(F.col("n")), "highs": blocks(F.col("n") - F.col("most"))})
    at = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), n)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cell = lambda low, high, role: F.struct(low.alias("low"), high.alias("high"), F.lit(role).cast("long").alias("role"))
    low, high = at(F.col("lows"), 1), at(F.col("highs"), 2)
    as_host = F.transform(every(F.col("highs")), lambda k: cell(low, k, HOST))
    as_minor = F.transform(every(F.col("highs")), lambda k: F.when(k == high, cell(low, k, BOTH)).otherwise(cell(low, k, HOST)))
    as_guest = F.transform(F.filter(every(F.col("lows")), lambda k: k != low), lambda k: cell(k, high, GUEST))
    return rows.select("key", "band", "doc_id", "c", "minor", F.inline(F.when(F.col("minor"), F.concat(as_minor, as_guest)).otherwise(as_host)))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    A-Z are lower-cased; a text's shingles are its runs of five words, fewer words are one shingle. Texts without a
    word, null ones too, have none and are linked with nothing. Rows that repeat an id are one document, that with the
    greatest of their texts, and share its verdict. Rows without an id are grouped with nothing and kept; their
    component is null. An empty table gives no rows; only doc_id and text are looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    every = cut(sketches(docs))
    rows = every.filter("doc_id IS NOT NULL")
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if not counts.isEmpty():
        docs = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("text").alias("text"))
        rows = cut(sketches(docs))
    classes = rows.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    members = cut(rows.select("doc_id", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))
    bands = rows.filter("n_shingles > 0").select(F.posexplode("bands").alias("band", "key"), "doc_id")
    buckets = bands.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n"), F.max("doc_id").alias("last")).filter("leader < last").select("key", "leader", "n")
    reps = members.filter("doc_id = rep AND n_shingles > 0").select("doc_id")
    crowd = cut(bands.join(buckets, "key").join(reps, "doc_id").select("key", "band", "doc_id", "leader", "n"))
    sig = rows.select("doc_id", "sig")
    weight = crowd.groupBy("doc_id").agg(F.sum("n").alias("w"))
    hubs = crowd.join(weight, "doc_id").groupBy("key").agg(F.max(F.struct("w", (-F.col("doc_id")).alias("h"))).alias("hub"))
    best = crowd.join(hubs, "key").groupBy("doc_id").agg(F.min("leader").alias("least"), (-F.max("hub")["h"]).alias("hub"))
    pairs = best.select(F.explode(F.array("least", "hub")).alias("b"), "doc_id").filter("b <> doc_id").select(F.greatest("doc_id", "b").alias("a"), F.least("doc_id", "b").alias("b")).distinct()
    signed = pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
    likely = cut(signed.select("a", "b", "sig_a", "sig_b").mapInArrow(_probable, "a long, b long"))
    group = components(_exact(likely, docs))
    named = crowd.select("key", "band", "doc_id").join(group.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "band", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    dealt = _dealt(named).join(sig, "doc_id").select("key", "low", "high", "doc_id", "c", "role", "minor", "sig", "band")
    more = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_between, "a long, b long").distinct()
    more = _exact(cut(more), docs)
    comp = lambda v, c: group.select(F.col("id").alias(v), F.col("component").alias(c))
    edges = more.join(comp("a", "ca"), "a", "left").join(comp("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(edges).select(F.col("id").alias("c"), F.col("component").alias("root"))
    found = members.join(group.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("c"), "n_shingles")
    found = found.join(joined, "c", "left").select("doc_id", F.coalesce("root", "c").alias("component_id"), "n_shingles")
    if not counts.isEmpty():
        found = every.filter("doc_id IS NOT NULL").select("doc_id").join(found, "doc_id")
    alone = every.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("component_id"), "n_shingles")
    return found.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame) -> DataFrame:
    """One document of each group, with its columns, whatever these are called.

    Of rows that repeat an id the one with the greatest text stands for them all. Rows without an id all stay, as do rows
    without a word, null ones too. An empty table gives no rows.
    """
    kept = near_groups(docs).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    if not rows.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        text = F.coalesce(F.col("row")["text"].cast("string"), F.lit(""))
        once = rows.filter("id IS NOT NULL").groupBy("id").agg(F.max_by("row", text).alias("row"))
        rows = once.select("row", "id").unionByName(rows.filter("id IS NULL"))
    return rows.join(kept, "id", "left_semi").unionByName(rows.filter("id IS NULL").select("id", "row")).select("row.*")
