"""Removal of passages that occur earlier in the corpus, by sharded suffix arrays.

Copies of whole texts are told by hashes and need no search. In every other text each 100-byte window belongs to its
anchor, the 32-byte string of least hash in it, so equal windows have equal anchors. Anchors that occur once are let
go. The stretches of windows around the others go to the shard of their anchor, where equal stretches collapse, and the
rest are put in order by an induced suffix array; windows that share 100 bytes with their neighbour in that order, as the
permuted common prefixes tell, form groups, of which all but the earliest are removed.

Anchors with very many occurrences don't go to one shard. Those that repeat within pieces of the corpus are tallied
there first and never gathered; others are known when their bucket is counted. Their windows are compared by 128-bit
hashes of their 100 bytes: within a piece of the corpus at once, so that one row a window and piece is dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import _BYTE_VALUES, as_bytes, cut, mix, pieces, prepare, span_hashes, text_or_empty
from quillstone.llm.near_dedup import perhaps_in
from quillstone.llm.suffix_sort import permuted_prefixes, suffix_array

LENGTH, GRAM = 100, 32
_SPREAD = LENGTH - GRAM + 1
#: Text bytes whose anchors share a bucket; occurrences, of at most 168 bytes each, beyond which an anchor is hot; bytes of a shard's suffix array.
BUCKET_BYTES, HOT, SHARD_BYTES = 16 << 20, 32768, 1 << 20
#: Hot anchors that are told from tallies at most (1 MB, sent to every task); others, if any, take the other way, with the same result.
MOST_HOT = 1 << 16
#: Copies of whole texts up to which their ids are broadcast (16 MB); beyond, the join shuffles.
FEW_COPIES = 1 << 20
_LAST = (1 << 63) - 1
_OTHER = np.random.default_rng(3).permutation(256).astype(np.uint8)


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one anchor: row, first window's start in the row, windows, hash of the anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    h, power = _BYTE_VALUES[data], 0x9E3779B97F4A7C15 | 1
    for s in (1, 2, 4, 8, 16):
        h = h[:-s] * np.uint64(power) + h[s:]
        power = power * power & (1 << 64) - 1
    h = mix(h)
    low = h >> np.uint64(32) << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-s], low[s:])
    low = np.minimum(low[: len(low) - (_SPREAD - 64)], low[_SPREAD - 64 :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int64)
    rows = np.flatnonzero(np.diff(off) >= LENGTH)
    inside[off[rows]] += 1
    inside[off[rows + 1] - LENGTH + 1] -= 1
    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    at = at[start]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    row = np.searchsorted(off, start[first], "right") - 1
    return row, start[first] - off[row], np.diff(np.append(first, len(start))), h[at[first]]


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of equal weight side by side, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T)


def _packed(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in pieces(batches, limit=2 << 20):
            row, _, _, h = anchors(data, off)
            if not len(row):
                continue
            ids = part.column(0).to_numpy().astype(np.int64)[row]
            place = (np.arange(len(row)) - np.searchsorted(row, row)).astype(np.uint32)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, h, ids, place = bucket[order], h[order] // np.uint64(buckets), ids[order], place[order]
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            load = [_planes(h[a:b])[:6].tobytes() + _planes(ids[a:b]).tobytes() + _planes(place[a:b]).tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), pa.array(load, pa.binary())], names=["bucket", "load"])

    return run


def _unpacked(load: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, ids and places of a load."""
    raw = np.frombuffer(load, np.uint8).reshape(18, -1)
    h = np.zeros((raw.shape[1], 8), np.uint8)
    h[:, :6] = raw[:6].T
    return h.view(np.uint64)[:, 0], np.ascontiguousarray(raw[6:14].T).view(np.int64)[:, 0], np.ascontiguousarray(raw[14:].T).view(np.uint32)[:, 0]


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, anchor, n) of the anchors that a load has twice or more."""
    for batch in batches:
        for bucket, load in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h, n = np.unique(_unpacked(load)[0], return_counts=True)
            h, n = h[n > 1], n[n > 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), bucket)), pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], names=["bucket", "anchor", "n"])


def _without(hot: dict[int, np.ndarray]):
    """Loads without the hot anchors of their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            loads = batch.column(1).to_pylist()
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket in hot:
                    raw = np.frombuffer(loads[i], np.uint8).reshape(18, -1)
                    loads[i] = raw[:, ~np.isin(_unpacked(loads[i])[0], hot[bucket])].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(loads, pa.binary())], names=["bucket", "load"])

    return run


def _hot_places(hot: dict[int, np.ndarray]):
    """(id, place) of the hot anchors' occurrences, places as _repeated gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, load in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket in hot:
                    h, ids, place = _unpacked(load)
                    keep = np.isin(h, hot[bucket])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array((-1 - place[keep].astype(np.int64)).astype(np.int32))], names=["id", "place"])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """id and place of the anchors that occur twice or more in a bucket; place is negative, less 1, for hot ones."""
    h, ids, places = (np.concatenate(x) for x in zip(*map(_unpacked, table["load"].to_pylist())))
    order = np.argsort(h)
    h = h[order]
    edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
    count = np.repeat(np.diff(edge), np.diff(edge))
    keep = order[count > 1]
    place = places[keep].astype(np.int64)
    place = np.where(count[count > 1] > HOT, -1 - place, place)
    return pa.table({"id": ids[keep], "place": place.astype(np.int32)})


def _chosen(part: pa.RecordBatch, data: np.ndarray, off: np.ndarray):
    """Row, id, start, windows and anchor of the stretches that the rows' lists of places name."""
    row, start, n, h = anchors(data, off)
    first = np.searchsorted(row, np.arange(part.num_rows))
    lists = part.column(part.schema.get_field_index("places"))
    size = np.diff(lists.offsets.to_numpy())
    at = np.repeat(first, size) + lists.flatten().to_numpy().astype(np.int64)
    at.sort()
    return row[at], part.column(0).to_numpy().astype(np.int64)[row[at]], start[at], n[at], h[at]


def _slices(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate(([0], np.cumsum(size)))
    return data[np.arange(off[-1]) + np.repeat(begin - off[:-1], size)], off


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, off in pieces(batches):
        row, ids, start, n, h = _chosen(part, data, off)
        total = np.cumsum(n + LENGTH - 1)
        cuts = np.searchsorted(total, np.arange(0, total[-1] if len(n) else 0, 64 << 20)[1:]) if len(n) else []
        for k in np.split(np.arange(len(n)), cuts):  # one very long text may have more bytes of stretches than an Arrow column holds
            if len(k):
                body, at = _slices(data, off[row[k]] + start[k], n[k] + LENGTH - 1)
                texts = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([pa.array(h[k].view(np.int64)), pa.array(ids[k]), pa.array(start[k]), pa.array(n[k]), texts], names=["anchor", "id", "start", "n", "body"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, id, from, to): of equal windows in a piece of the corpus the first, with its hashes; the later ones, as ranges."""
    for part, data, off in pieces(batches):
        row, ids, start, n, _ = _chosen(part, data, off)
        if not len(row):
            continue
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids, start, row = np.repeat(ids, n), np.repeat(start, n) + step, np.repeat(row, n)
        a = off[row] + start
        one, two = (span_hashes(x, a, a + LENGTH).view(np.int64) for x in (data, _OTHER[data]))
        order = np.lexsort((start, ids, two, one))
        first = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
        head, late = order[first], order[~first]
        late = late[np.lexsort((start[late], ids[late]))]
        new = np.concatenate(([True], (ids[late][1:] != ids[late][:-1]) | (start[late][1:] != start[late][:-1] + 1)))[: len(late)]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:] - 1, len(late) - 1)[: len(begin)]
        columns = [(one[head], None), (two[head], None), (ids[head], ids[late[begin]]), (start[head], start[late[begin]]), (start[head] + 1, start[late[end]] + 1)]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x), pa.nulls(len(begin), pa.int64()) if y is None else pa.array(y)]) for x, y in columns], names=["w1", "w2", "id", "from", "to"])


def later_windows(anchor: np.ndarray, ids: np.ndarray, start: np.ndarray, n: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches with their bytes: (id, from, to) of the windows that equal an earlier one."""
    a, b = off[:-1], off[1:]
    one, two = span_hashes(data, a, b), span_hashes(_OTHER[data], a, b)
    order = np.lexsort((start, ids, two, one))
    same = np.concatenate(([False], (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])))
    equal = ids[order] != np.roll(ids[order], 1)  # the same place twice isn't earlier than itself
    equal |= start[order] != np.roll(start[order], 1)
    copies, left = order[same & equal], np.sort(order[~same])
    names, back, count = np.unique(anchor[left], return_inverse=True, return_counts=True)
    left = left[count[back] > 1]
    out = [(ids[copies], start[copies], start[copies] + n[copies])]
    if len(left):
        text, at = _slices(data, a[left], (b - a)[left])
        order = suffix_array(text, LENGTH)
        shared = permuted_prefixes(text, order, LENGTH)
        group = np.empty(len(text), np.int64)
        group[order] = np.cumsum(shared[order] < LENGTH)
        k = n[left]
        step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        which = np.repeat(np.arange(len(left)), k)
        group, doc, pos = group[at[which] + step], ids[left][which], start[left][which] + step
        order = np.lexsort((pos, doc, group))
        g, d, p = group[order], doc[order], pos[order]
        fresh = np.concatenate(([True], g[1:] != g[:-1]))
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(g)), 0))
        late = np.zeros(len(g), bool)
        late[order] = (d != d[head]) | (p != p[head])
        hit = np.flatnonzero(late)
        if len(hit):
            new = np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (which[hit[1:]] != which[hit[:-1]])))
            f, t = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
            out.append((doc[f], pos[f], pos[t] + 1))
    return tuple(np.concatenate(x) for x in zip(*out))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Works through a partition in order of anchors, about SHARD_BYTES at a time, never parting an anchor."""

    def work(rows: pa.RecordBatch) -> pa.RecordBatch:
        data, off = as_bytes(rows.column(4))
        found = later_windows(*(rows.column(k).to_numpy().astype(np.int64) for k in range(4)), data, off)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["id", "from", "to"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        while size > SHARD_BYTES:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            anchor = rows.column(0).to_numpy()
            ends = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            if not len(ends):
                held = [rows]
                break
            sizes = as_bytes(rows.column(4))[1]
            end = int(ends[max(0, int(np.searchsorted(sizes[ends], SHARD_BYTES, "right")) - 1)])
            yield work(rows.slice(0, end))
            held = [rows.slice(end)]
            size = int(sizes[-1] - sizes[end])
    if held:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        if rows:
            yield work(rows[0])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of byte ranges as maximal runs."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, off in pieces(batches):
        begin, end = (part.column(k) for k in (3, 4))
        n_removed, n_spans, digest = [], [], []
        for i in range(part.num_rows):
            s, e = merged(begin[i].values.to_numpy().astype(np.int64), end[i].values.to_numpy().astype(np.int64) + LENGTH - 1)
            text = data[off[i] : off[i + 1]]
            keep = np.ones(len(text), bool)
            for a, b in zip(s.tolist(), e.tolist()):
                keep[a:b] = False
            n_removed.append(int(len(text) - keep.sum()))
            n_spans.append(len(s))
            digest.append(hashlib.sha256(text[keep].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest)], names=["id", "h1", "n_removed", "n_spans", "kept_sha256"])


def _with_places(texts: DataFrame, places: DataFrame) -> DataFrame:
    lists = places.groupBy("id").agg(F.collect_list("place").alias("places"))
    return perhaps_in(texts, "id", places.select("id")).join(lists, "id").select("id", "text", "places")


def repeated_ranges(texts: DataFrame, total: int) -> DataFrame:
    """(id, from, to): windows of the texts (id, text) that equal an earlier one, as ranges of their starts."""
    buckets = max(12, -(-total // BUCKET_BYTES))
    packed = cut(texts.select("id", "text").mapInArrow(_packed(buckets), "bucket long, load binary"))
    many = packed.mapInArrow(_tallies, "bucket long, anchor long, n long").groupBy("bucket", "anchor").agg(F.sum("n").alias("n"))
    told = many.filter(F.col("n") > HOT).orderBy(F.col("n").desc(), "bucket", "anchor").limit(MOST_HOT).select("bucket", "anchor").toArrow()
    bucket, anchor = told["bucket"].to_numpy(), told["anchor"].to_numpy().astype(np.uint64)
    known = {int(k): anchor[bucket == k] for k in np.unique(bucket)}
    gathered = packed.mapInArrow(_without(known), "bucket long, load binary") if known else packed
    places = gathered.groupBy("bucket").applyInArrow(_repeated, "id long, place int")
    if known:
        places = places.unionByName(packed.mapInArrow(_hot_places(known), "id long, place int"))
    places = cut(places)
    shards = _with_places(texts, places.filter("place >= 0")).mapInArrow(_stretches, "anchor long, id long, start long, n long, body binary")
    found = shards.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards, "id long, from long, to long")
    hot = places.filter("place < 0").select("id", (-1 - F.col("place")).alias("place"))
    if not hot.isEmpty():
        rows = cut(_with_places(texts, hot).select("id", "text", "places").mapInArrow(_windows, "w1 long, w2 long, id long, from long, to long"))
        heads = rows.filter("w1 IS NOT NULL")  # a text lies in one piece, so a window has one row a text at most
        first = heads.groupBy("w1", "w2").agg(F.min("id").alias("first"))
        late = heads.join(first, ["w1", "w2"]).filter("id <> first")
        found = found.unionByName(rows.filter("w1 IS NULL").select("id", "from", "to")).unionByName(late.select("id", "from", "to"))
    return found


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row.

    Null text counts as empty. A null id comes after all others. Rows that repeat an id are one document: of its texts
    the one with the least hash is searched, any other is cut only as a copy of a whole text of an earlier document;
    rows alike in id and text share their result. An empty table gives no rows; only doc_id and text are looked at.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumns({"id": F.coalesce("doc_id", F.lit(_LAST)), "h1": F.xxhash64("text")})
    base = cut(texts.select("doc_id", "id", "h1", F.xxhash64("text", F.lit(7)).alias("h2"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")))
    firsts = base.filter(f"n_bytes >= {LENGTH}").groupBy("h1", "h2", "n_bytes").agg(F.min("id").alias("first"))
    known = cut(base.join(firsts, ["h1", "h2", "n_bytes"], "left"))
    copies = known.filter("id > first").select("id", "h1").distinct()
    if not base.groupBy("id").agg(F.count_distinct("h1").alias("n")).filter("n > 1").isEmpty():
        once = base.groupBy("id").agg(F.min("h1").alias("h1"))
        texts = texts.join(once, ["id", "h1"]).dropDuplicates(["id", "h1"])
    elif not base.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        texts = texts.dropDuplicates(["id"])
    total, n_copies = base.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0], copies.count()
    copies = F.broadcast(copies) if n_copies <= FEW_COPIES else copies
    texts = texts.filter(F.octet_length("text") >= LENGTH).join(copies, ["id", "h1"], "left_anti")
    ranges = cut(repeated_ranges(texts, total))
    lists = ranges.groupBy("id").agg(F.collect_list("from").alias("begin"), F.collect_list("to").alias("end"))
    hit = perhaps_in(texts, "id", ranges.select("id")).join(lists, "id").select("id", "h1", "text", "begin", "end")
    done = hit.mapInArrow(_cut_out, "id long, h1 long, n_removed long, n_spans long, kept_sha256 string")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return known.join(done, ["id", "h1"], "left").select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )
