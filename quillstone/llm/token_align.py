"""Alignment of the tokens of two vocabularies over the same bytes, by a sweep over the places where tokens end.

Each side encodes the texts for itself. Its end events travel in runs: a row holds the ids of consecutive tokens of one
side from a byte offset on, and their lengths give the ends. Runs of both sides are put together, dealt by document and
sorted by offset; a machine reads them once. It keeps the tokens behind the last place where both sides end, which is
where a group closes, and what the document at hand has given so far. It emits one row a document: groups and links.

Texts are cut into units before each space that follows no white space. No token of either side crosses such a place, so
units are encoded once and remembered, a bounded number of them, told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import as_bytes, cut, pieces, prepare, span_hashes, text_or_empty
from quillstone.llm.word_bpe import _byte_symbols, _Store

#: Bytes of text in a run; tokens swept at once; links of a group that are listed one by one before equal ids are counted.
RUN, AT_ONCE, LISTED = 1 << 18, 1 << 19, 1 << 12
#: Id pairs that are broadcast, 24 bytes each; of more, those of over a HOT-th of all links, at most HOT.
MOST_PAIRS, HOT = 1 << 20, 1000
_BAD = 0xFFFF  # the only id of a unit whose tokens don't spell its bytes


def byte_level_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library; special tokens' strings are plain text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True
        byte = {c: bytes([b]) for b, c in enumerate(_byte_symbols())}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.spelt = [b"\xff\xff"] * (1 + max(vocab.values()))
        for name, k in vocab.items():
            if all(c in byte for c in name):
                self.spelt[k] = b"".join(byte[c] for c in name)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._library.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece vocabulary that puts a space before the text, which these texts have already."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(self._library.get_piece_size())
        self.spelt = [bytes([int(self._library.id_to_piece(k)[1:-1], 16)]) if self._library.is_byte(k) else self._library.id_to_piece(k).replace("▁", " ").encode() for k in size]
        self._space = self._library.piece_to_id("▁")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids if text != " " else [self._space] for text, ids in zip(texts, self._library.encode([t[1:] for t in texts], num_threads=1))]


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each unit: rows are cut before spaces whose character before is surely not white space."""
    begin = np.zeros(len(data) + 1, bool)
    begin[np.flatnonzero(data == 32)] = True
    at = np.flatnonzero(begin)
    at = at[at > 0]
    prior = data[at - 1]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = (two == 0xC2) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    begin[at[(prior < 33) | (prior == 127) | ((prior >= 0x80) & wide)]] = False
    begin[off] = True
    starts = np.flatnonzero(begin[:-1])
    return starts, np.append(starts[1:], len(data)), np.searchsorted(off, starts, "right") - 1


class UnitCoder:
    """Ids of texts that begin with a space, unit by unit; ``most`` bounds the units remembered."""

    def __init__(self, model, most: int = 500_000) -> None:
        self.model, self.most = model, most
        self.sizes = np.array([len(x) for x in model.spelt], np.int64)
        self._spelt = np.frombuffer(b"".join(model.spelt), np.uint8)
        self._at = np.cumsum(self.sizes) - self.sizes
        self._known = _Store()

    def spell(self, ids: np.ndarray) -> np.ndarray:
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self._spelt[np.repeat(self._at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        found = self.model.encode([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())])
        n = np.array([len(x) for x in found])
        ids = np.array([k for x in found for k in x], np.int64)
        first = np.concatenate(([0], np.cumsum(n)))
        sizes = np.diff(np.concatenate(([0], np.cumsum(self.sizes[ids])))[first])
        for k in np.flatnonzero(sizes != ends - starts).tolist() or ():
            found[k], n[k] = [_BAD], 1
        same = np.flatnonzero(sizes == ends - starts)
        if len(same):
            own = ids if len(same) == len(n) else np.array([k for x in same.tolist() for k in found[x]], np.int64)
            length = (ends - starts)[same]
            edge = np.cumsum(length)
            want = data[np.repeat(starts[same] - (edge - length), length) + np.arange(edge[-1])]
            wrong = np.flatnonzero(self.spell(own) != want)
            for k in np.unique(same[np.searchsorted(edge, wrong, "right")]).tolist():
                found[k], n[k] = [_BAD], 1
        self._known.add(hashes, np.array([k for x in found for k in x], np.uint16), n)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows end to end, the rows' offsets in them, and which rows' tokens don't spell their bytes."""
        starts, ends, row = units(data, off)
        unique, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        entry = self._known.find(unique)
        if (entry < 0).any():
            if len(self._known) + len(unique) > self.most:
                self._known = _Store()
                entry[:] = -1
            new = first[entry < 0]
            self._learn(data, starts[new], ends[new], unique[entry < 0])
            entry = self._known.find(unique)
        at, n = self._known.at[entry][back], self._known.n[entry][back]
        ends = np.cumsum(n)
        ids = self._known.ids[np.repeat(at - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        per_row = np.bincount(row, weights=n, minlength=len(off) - 1).astype(np.int64)
        place = np.concatenate(([0], np.cumsum(per_row)))
        bad = np.zeros(len(off) - 1, bool)
        bad[np.searchsorted(place, np.flatnonzero(ids == _BAD), "right") - 1] = True
        return ids, place, bad


@lru_cache(maxsize=4)
def coder(side: int, path: str) -> UnitCoder:
    """One a worker process; side 0 is byte-level, side 1 of pieces."""
    return UnitCoder((Pieces if side else ByteLevel)(path))


_RUNS = "doc_id long, digest string, at long, side int, copies long, bad boolean, ids binary"


def _spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a space before each."""
    n = np.diff(off)
    return np.insert(data, off[:-1], 32), np.concatenate(([0], np.cumsum(n + 1)))


def _events(side: int, path: str, run: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one side. Rows of a slice that repeat an id and a text go as one, with their number."""
    own = coder(side, path)
    for batch, data, off in pieces(batches):
        docs, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        copies: dict[tuple, int] = {}
        for key in zip(docs, digests):
            copies[key] = copies.get(key, 0) + 1
        if len(copies) < len(docs):
            seen: set = set()
            keep = np.array([k for k, key in enumerate(zip(docs, digests)) if not (key in seen or seen.add(key))])
            batch = batch.take(pa.array(keep))
            docs, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, off = as_bytes(batch.column(2))
        times = list(copies.values())
        empty = np.diff(off) == 0
        data, off = _spaced(data, off)
        if len(docs) == 1 and off[-1] > run:  # a long text, a run at a time
            starts = units(data, off)[0]
            edge = [0]
            while len(data) - edge[-1] > run:
                within = starts[np.searchsorted(starts, edge[-1] + run, "right") - 1]
                edge.append(int(within) if within > edge[-1] else int(starts[np.searchsorted(starts, edge[-1], "right")]) if starts[-1] > edge[-1] else len(data))
            rows = [(0, a, b) for a, b in zip(edge, [*edge[1:], len(data)]) if a < b]
        else:
            rows = None
        for k, a, b in rows or ((None, 0, len(data)),):
            ids, place, bad = own.encode(data[a:b], off if k is None else np.array([0, b - a]))
            ids, n = ids.astype("<u2"), len(place) - 1
            gone = bad | empty if k is None else bad
            flat = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((place * 2).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            if gone.any():
                flat = pa.array([b"" if g else x for g, x in zip(gone.tolist(), flat.to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(digests, pa.string()), pa.array(np.full(n, a)), pa.array(np.full(n, side, np.int32)), pa.array(times, pa.int64()), pa.array(bad), flat], names=["doc_id", "digest", "at", "side", "copies", "bad", "ids"])


class Sweep:
    """Reads runs in order and yields (key, copies, n_a, n_b, n_groups, n_links, groups, links) of each document."""

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray]) -> None:
        self.sizes = sizes
        self.key, self.copies, self.last = None, 0, None
        self.ids: tuple[list, list] = ([], [])  # runs not swept yet, and what lay behind the last common end
        self.held = 0
        self.docs: list[list] = []  # documents of those runs: key, copies, bytes, whether they have no tokens
        self.open: list = [0, 0, 0, 0, [], []]  # of the first of them: counts, groups and links so far

    def read(self, key: tuple, at: int, side: int, copies: int, bad: bool, ids: np.ndarray) -> None:
        if not self.docs or self.docs[-1][0] != key:
            self.docs.append([key, 0, 0, False])
            self.last = None
        elif self.last == (at, side):
            self.docs[-1][1] += copies if (at, side) == (0, 0) else 0
            return
        self.last = (at, side)
        doc = self.docs[-1]
        doc[1] += copies if (at, side) == (0, 0) else 0
        doc[3] |= bad
        if len(ids):
            self.ids[side].append((len(self.docs) - 1, ids))
            self.held += len(ids)

    def flush(self, all_read: bool) -> Iterator[tuple]:
        """Sweeps what is held; the last document stays open unless everything has been read."""
        if not self.docs:
            return
        bad = np.array([d[3] for d in self.docs])
        sides = []
        for side in (0, 1):
            runs = [(d, ids) for d, ids in self.ids[side] if not bad[d]]
            ids = np.concatenate([x for _, x in runs]).astype(np.int64) if runs else np.zeros(0, np.int64)
            doc = np.repeat(np.array([d for d, _ in runs], np.int64), [len(x) for _, x in runs]) if runs else np.zeros(0, np.int64)
            sides.append((ids, doc))
        (a, doc_a), (b, doc_b) = sides
        # A document's bytes are the same on both sides, but its last run may have been read on one side only.
        place = lambda ids, doc, sizes: np.cumsum(sizes[ids])
        end_a, end_b = place(a, doc_a, self.sizes[0]), place(b, doc_b, self.sizes[1])
        where = np.searchsorted(end_b, end_a)
        hit_a = np.zeros(len(a), bool)
        some = where < len(b)
        hit_a[some] = end_b[where[some]] == end_a[some]
        hit_b = np.zeros(len(b), bool)
        hit_b[where[hit_a]] = True
        n_groups = int(hit_a.sum())
        group_a, group_b = np.cumsum(hit_a) - hit_a, np.cumsum(hit_b) - hit_b
        left_a, left_b = int(np.searchsorted(group_a, n_groups)), int(np.searchsorted(group_b, n_groups))
        tail = [(doc_a[left_a:], a[left_a:]), (doc_b[left_b:], b[left_b:])]
        a, b, group_a, group_b, doc_a = a[:left_a], b[:left_b], group_a[:left_a], group_b[:left_b], doc_a[:left_a]
        doc_of = doc_a[hit_a[:left_a]]
        of_a, of_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        n_docs = len(self.docs)
        count = lambda w: np.bincount(doc_of, weights=w, minlength=n_docs).astype(np.int64)
        totals = np.stack([count(of_a), count(of_b), count(np.ones(n_groups)), count(of_a * of_b)])
        keys, times = self._links(a, b, group_a, group_b, of_a, of_b, doc_of)
        link_edge = np.searchsorted(keys, np.arange(n_docs + 1, dtype=np.uint64) << np.uint64(32))
        text, text_edge = self._groups(a, b, group_a, group_b, of_a, of_b, doc_of, n_docs)
        pairs = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for k in range(n_docs):
            own = [*totals[:, k].tolist(), [text[text_edge[k] : text_edge[k + 1]]], [(pairs[link_edge[k] : link_edge[k + 1]], times[link_edge[k] : link_edge[k + 1]])]]
            if k == 0:
                own = [x + y for x, y in zip(self.open, own)]
            if k == n_docs - 1 and not all_read:
                own[5] = [_added(own[5])]
                self.open = own
                break
            key, copies, _, none = self.docs[k]
            if none:
                own = [0, 0, 0, 0, [], []]
            yield key, copies, *own[:4], b"".join(x.tobytes() for x in own[4]).rstrip(b";"), _added(own[5])
        if all_read:
            self.docs, self.ids, self.held, self.open = [], ([], []), 0, [0, 0, 0, 0, [], []]
        else:
            self.docs = self.docs[-1:]
            self.ids = tuple([(0, ids)] if len(ids) and doc[-1] == n_docs - 1 else [] for doc, ids in tail)
            self.held = sum(len(x) for side in self.ids for _, x in side)

    def _links(self, a, b, group_a, group_b, of_a, of_b, doc_of) -> tuple[np.ndarray, np.ndarray]:
        """Document and id pair in one number, rising, and how often each pair is linked in its document."""
        first_b = np.cumsum(of_b) - of_b
        times = of_b[group_a] * ((of_a * of_b <= LISTED)[group_a])
        one = np.repeat(np.arange(len(a)), times)
        other = first_b[group_a[one]] + np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times)
        keys = (doc_of[group_a[one]].astype(np.uint64) << np.uint64(32)) | (a[one] << 16 | b[other]).astype(np.uint64)
        unique, n = np.unique(keys, return_counts=True)
        large = np.flatnonzero(of_a * of_b > LISTED)
        if not len(large):
            return unique, n
        more_k, more_n = [unique], [n]
        first_a = np.cumsum(of_a) - of_a
        for g in large.tolist():
            x, n_x = np.unique(a[first_a[g] : first_a[g] + of_a[g]], return_counts=True)
            y, n_y = np.unique(b[first_b[g] : first_b[g] + of_b[g]], return_counts=True)
            more_k.append((np.uint64(int(doc_of[g]) << 32) | (x[:, None] << 16 | y[None, :]).astype(np.uint64)).ravel())
            more_n.append((n_x[:, None] * n_y[None, :]).ravel())
        unique, back = np.unique(np.concatenate(more_k), return_inverse=True)
        return unique, np.bincount(back, weights=np.concatenate(more_n)).astype(np.int64)

    def _groups(self, a, b, group_a, group_b, of_a, of_b, doc_of, n_docs) -> tuple[np.ndarray, np.ndarray]:
        """a1,a2|b1;a3|b2,b3; of all documents end to end, and their offsets."""
        data, off = _decimals()
        before_b, through_a = np.cumsum(of_b) - of_b, np.cumsum(of_a)
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + through_a[group_b]
        ids[at_a], ids[at_b] = a, b
        last = np.cumsum(of_a + of_b)
        mark[last - of_b - 1], mark[last - 1] = ord("|"), ord(";")
        n = off[ids + 1] - off[ids]
        ends = np.cumsum(n)
        text = data[np.repeat(off[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        text[ends - 1] = mark
        group_end = np.concatenate(([0], ends[last - 1])) if len(last) else np.zeros(1, np.int64)
        return text, group_end[np.searchsorted(doc_of, np.arange(n_docs + 1))]


def _added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and counts of the parts of one document, each pair once."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    unique, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return unique, np.bincount(back, weights=np.concatenate([n for _, n in parts]), minlength=len(unique)).astype(np.int64)


@lru_cache(maxsize=1)
def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """Decimal spellings of ids with a byte to spare behind each."""
    spelt = [b"%d " % k for k in range(1 << 16)]
    return np.frombuffer(b"".join(spelt), np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in spelt])))


def _sweep(paths: tuple[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = Sweep((coder(0, paths[0]).sizes, coder(1, paths[1]).sizes))

    def rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out = [r for r in found for _ in range(r[1])]
        if out:
            edge = np.concatenate(([0], np.cumsum([len(r[7][0]) for r in out])))
            links = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(np.concatenate([r[7][1] << 32 | r[7][0] for r in out])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in out], pa.int64()), *(pa.array([r[k] for r in out], pa.int64()) for k in range(2, 6)), pa.array([r[6].decode() for r in out], pa.string()), links], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    for batch in batches:
        heads = zip(*(batch.column(k).to_pylist() for k in range(6)))
        for (doc, digest, at, side, copies, bad), ids in zip(heads, batch.column(6)):
            if machine.held >= AT_ONCE:
                yield from rows(machine.flush(False))
            machine.read((doc, digest), at, side, copies, bad, np.frombuffer(ids.as_buffer(), "<u2"))
    yield from rows(machine.flush(True))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups and links of each row, for space and text in vocabularies A and B.

    groups: ids as a1,a2|b1;a3|b2,b3. links: one number for each id pair linked in the text, its occurrences * 2**32 + A id
    * 2**16 + B id; ``linked`` takes it apart. Texts that are null or empty, or that either side's tokens don't spell byte
    by byte, have no tokens: zeros, an empty string, no links. Rows that repeat an id, or an id and a text, each give a
    row. An empty table gives none; other columns are not looked at.
    """
    prepare(docs.sparkSession)
    paths = (path_a or byte_level_path(), path_b or piece_path())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text_or_empty(text_col)).alias("digest"), text_or_empty(text_col).alias("text"))
    a, b = (rows.mapInArrow(lambda x, side=side: _events(side, paths[side], run, x), _RUNS) for side in (0, 1))
    swept = a.unionByName(b).repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "at", "side")
    return swept.mapInArrow(lambda x: _sweep(paths, x), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<long>")


def linked(aligned: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, and pair, n of each id pair linked in a row; pair is A id * 2**16 + B id."""
    one = aligned.select(*keep, F.explode("links").alias("link"))
    return one.select(*keep, F.col("link").bitwiseAND(0xFFFFFFFF).alias("pair"), F.shiftright("link", 32).alias("n"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_docs: rows that hold the id pair linked; best: no pair of the same A id has more."""
    counts = linked(aligned).groupBy("pair").agg(F.count("*").alias("n_docs")).withColumn("a_id", F.shiftright("pair", 16))
    most = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a_id").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """The rows of ``align``, which is read twice and so had better be cut, with n_best and count_sum in place of links."""
    counts = cut(pair_counts(aligned))
    rows = aligned.withColumn("__row", F.monotonically_increasing_id())
    found = linked(rows, "__row")
    if counts.count() <= most_pairs:
        met = found.join(F.broadcast(counts), "pair")
    else:
        total = counts.agg(F.sum("n_docs")).first()[0]
        hot = F.broadcast(counts.filter(F.col("n_docs") * HOT > total))
        met = found.join(hot, "pair").unionByName(found.join(hot.select("pair"), "pair", "left_anti").join(counts.filter(F.col("n_docs") * HOT <= total), "pair"))
    sums = met.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.drop("links").join(sums, "__row", "left").select(*[c for c in aligned.columns if c != "links"], zero("n_best"), zero("count_sum"))
