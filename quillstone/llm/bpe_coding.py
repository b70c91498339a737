"""Byte-pair ids of whole texts and their decoding, for a vocabulary of word pieces.

Texts of up to LEAF bytes are encoded where they are read. A longer one is cut at white space, which no token crosses,
and its parts are encoded in parallel. A stretch that the vocabulary's pattern doesn't split is cut into leaves wherever
LEAF bytes end; their ids are joined by a tree. At each join a window of tokens on both sides is encoded anew, and grows
until its first and last tokens are those that stood there before (or it holds all of a side).

That suffices: merges run by rank, then from the left. A series of tokens is the encoding of its bytes exactly if every
two neighbours are that of theirs: up to the first merge across a border both sides have merged as they would alone, so
the same merge would come first there too. The window's inner neighbours are right as it was just encoded, the others as
each side was, and the two at its ends belong to both.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import _SPACE, cut, pieces, prepare, text_or_empty
from quillstone.llm.packing import default_tokenizer
from quillstone.llm.word_bpe import tokenizer

#: Bytes of a leaf; nodes that one task joins in a round; tokens of the first window on either side; tokens handled at once.
LEAF, FAN, WINDOW, AT_ONCE = 1 << 16, 64, 8, 1 << 18

_TEXT, _LEAF, _IDS = range(3)
_PART = "doc_id long, digest string, copies long, part long, node long, nodes long"


def token_names(path: str) -> list[str]:
    """The name of each id of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    found = [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]
    names = [""] * (1 + max(k for _, k in found))
    for name, k in found:
        names[k] = name
    return names


class PieceCoder:
    """Encodes stretches of one word piece, also those that are cut off at their right end."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, models

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        make = lambda **end: Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, **end))
        self._inner, self._closed = make(), make(**{"end_of_word_suffix": suffix} if suffix else {})
        self._whole = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._plain = [x.removesuffix(suffix) if suffix else x for x in token_names(path)]

    def encode(self, symbols: str, closed: bool) -> np.ndarray:
        """Ids of printable stand-ins of bytes; closed: the word ends with them."""
        return np.array((self._closed if closed else self._inner).encode(symbols, add_special_tokens=False).ids, np.int32)

    def join(self, left: np.ndarray, right: np.ndarray, closed: bool, window: int = WINDOW) -> np.ndarray:
        """The encoding of two neighbouring stretches, given theirs."""
        if not len(left) or not len(right):
            return np.concatenate((left, right))
        while True:
            a, b = left[-window:], right[:window]
            new = self.encode("".join(self._plain[k] for k in (*a.tolist(), *b.tolist())), closed and len(b) == len(right))
            if (len(a) == len(left) or new[0] == a[0]) and (len(b) == len(right) or new[-1] == b[-1]):
                return np.concatenate((left[: len(left) - len(a)], new, right[len(b) :]))
            window *= 2

    def unsplit(self, word: str, leaf: int) -> Iterator[tuple[int, bytes, int, int]]:
        """Parts (kind, data, node, nodes) of text without ASCII white space: ids of short pieces, leaves of long ones."""
        ready: list[int] = []
        sections = re.split("(" + "|".join(map(re.escape, self.special)) + ")", word) if self.special else [word]
        for section in sections:
            if section in self.special:
                ready.append(self.special[section])
                continue
            for piece, _ in self._whole.pre_tokenizer.pre_tokenize_str(self._whole.normalizer.normalize_str(section)) if section else ():
                if len(piece) <= leaf:
                    ready += self.encode(piece, True).tolist()
                    if len(ready) < leaf:
                        continue
                yield _IDS, np.array(ready, np.int32).tobytes(), 0, 1
                ready = []
                if len(piece) > leaf:
                    nodes = -(-len(piece) // leaf)
                    for k in range(nodes):
                        yield _LEAF, piece[k * leaf : (k + 1) * leaf].encode(), k, nodes
        yield _IDS, np.array(ready, np.int32).tobytes(), 0, 1


@lru_cache(maxsize=2)
def piece_coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def parts(text: bytes, coder: PieceCoder, leaf: int) -> Iterator[tuple[int, bytes, int, int]]:
    """Parts of a long text in order: its leaves follow one another, node by node."""
    space = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8)])
    edge = np.concatenate(([-1], space, [len(text)]))
    at = 0
    for k in [*np.flatnonzero(np.diff(edge) > leaf).tolist(), len(edge) - 1]:
        until = int(edge[k]) if k < len(edge) - 1 else len(text)
        while until - at > leaf:
            to = int(space[np.searchsorted(space, at + leaf, "right") - 1])
            yield _TEXT, text[at:to], 0, 1
            at = to
        yield _TEXT, text[at : max(at, until)], 0, 1
        at = max(at, until)
        if k < len(edge) - 1:
            yield from coder.unsplit(text[edge[k] + 1 : edge[k + 1]].decode("utf-8", "replace"), leaf)
            at = int(edge[k + 1])


def _lists(ids: np.ndarray, off: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _short(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = tokenizer(path)
    for batch, data, off in pieces(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(*coder.encode(data, off))], names=["doc_id", "ids"])


def _cut(path: str, leaf: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = piece_coder(path)
    names = ["doc_id", "digest", "copies", "part", "node", "nodes", "kind", "data"]
    for batch in batches:
        for doc, digest, copies, text in zip(*(batch.column(k) for k in range(4))):
            part = 0
            for kind, data, node, nodes in parts(text.as_buffer().to_pybytes(), coder, leaf):
                yield pa.RecordBatch.from_pylist([dict(zip(names, (doc.as_py(), digest.as_py(), copies.as_py(), part, node, nodes, kind, data)))], schema=pa.schema(list(zip(names, [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary()]))))
                part += node == nodes - 1


def _encode_parts(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = tokenizer(path)
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            kind, data = row.column(6)[0].as_py(), row.column(7)[0].as_py()
            if kind == _TEXT:
                raw = np.frombuffer(data, np.uint8)
                ids = words.encode(raw, np.array([0, len(raw)]))[0]
            elif kind == _LEAF:
                ids = piece_coder(path).encode(data.decode(), row.column(4)[0].as_py() == row.column(5)[0].as_py() - 1)
            else:
                ids = np.frombuffer(data, np.int32)
            yield pa.RecordBatch.from_arrays([*row.columns[:6], _lists(ids, np.array([0, len(ids)]))], names=[*row.schema.names[:6], "ids"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The fixed columns of each row and its ids."""
    for batch in batches:
        heads = list(zip(*(batch.column(k).to_pylist() for k in range(6))))
        ids, off = batch.column(6).values.to_numpy(), batch.column(6).offsets.to_numpy()
        for head, a, b in zip(heads, off[:-1], off[1:]):
            yield head, ids[a:b]


def _join(path: str, fan: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins up to ``fan`` neighbouring nodes, two of one height at a time."""
    coder = piece_coder(path)
    for key, group in groupby(_rows(batches), lambda r: (*r[0][:4], r[0][4] // fan, r[0][5])):
        stack: list[tuple[int, np.ndarray]] = []
        for head, ids in group:
            height, last = 0, head[4] == head[5] - 1
            while stack and stack[-1][0] == height:
                ids = coder.join(stack.pop()[1], ids, last)
                height += 1
            stack.append((height, ids))
        while len(stack) > 1:
            _, right = stack.pop()
            stack[-1] = (stack[-1][0], coder.join(stack[-1][1], right, last))
        ids = stack[0][1]
        head = [*key[:5], -(-key[5] // fan)]
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.string() if k == 1 else pa.int64()) for k, x in enumerate(head)), _lists(ids, np.array([0, len(ids)]))], names=["doc_id", "digest", "copies", "part", "node", "nodes", "ids"])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, group in groupby(_rows(batches), lambda r: r[0][:3]):
        ids = np.concatenate([x for _, x in group])
        row = pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), _lists(ids, np.array([0, len(ids)]))], names=["doc_id", "ids"])
        for _ in range(key[2]):
            yield row


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """doc_id, ids (array of int) of every row, as the tokenizer library encodes its whole text without special tokens.

    Null and empty texts have no ids. Rows that repeat an id, or an id and a text, each give a row. An empty table gives
    none; other columns are not looked at. A document's ids are one row, as its text is.
    """
    prepare(docs.sparkSession)
    path = path or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    size = F.octet_length("text")
    short = rows.filter(size <= leaf).mapInArrow(lambda b: _short(path, b), "doc_id long, ids array<int>")
    texts = rows.filter(size > leaf).groupBy("doc_id", F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.first("text").cast("binary").alias("text"))
    found = texts.mapInArrow(lambda b: _cut(path, leaf, b), f"{_PART}, kind long, data binary").repartition("doc_id", "digest", "part", "node")
    coded = cut(found.mapInArrow(lambda b: _encode_parts(path, b), f"{_PART}, ids array<int>"))
    whole, nodes = coded.filter("nodes = 1"), coded.agg(F.max("nodes")).first()[0] or 1
    tree = coded.filter("nodes > 1")
    while nodes > 1:
        beside = tree.withColumn("up", F.floor(F.col("node") / fan)).repartition("doc_id", "digest", "part", "up").drop("up")
        tree = beside.sortWithinPartitions("doc_id", "digest", "copies", "part", "node").mapInArrow(lambda b: _join(path, fan, b), f"{_PART}, ids array<int>")
        nodes = -(-nodes // fan)
    every = whole.unionByName(tree).repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "part")
    return short.unionByName(every.mapInArrow(_assemble, "doc_id long, ids array<int>"))


def _spell(column: pa.Array, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of rows: the spellings of their ids with a space between any two, and the rows' ends in them."""
    column = column.cast(pa.large_list(pa.int32()))
    ids, at = column.values.to_numpy(), column.offsets.to_numpy()
    size = np.diff(off)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + AT_ONCE, "right")) - 1)
        out, ends = [], []
        for a in range(int(at[i]), int(at[j]), AT_ONCE) if at[j] > at[i] else ():
            own = ids[a : min(a + AT_ONCE, int(at[j]))]
            n = size[own]
            end = np.cumsum(n)
            out.append(data[np.repeat(off[own] - (end - n), n) + np.arange(end[-1])])
            ends.append(end + (ends[-1][-1] if ends else 0))
        flat = np.concatenate(out) if out else np.zeros(0, np.uint8)
        end = np.concatenate(([0], *ends))[at[i : j + 1] - at[i]]
        some = np.flatnonzero(np.diff(end)) + 1  # rows with ids end with a space too many
        yield np.delete(flat, end[some] - 1), end - np.concatenate(([0], np.cumsum(np.diff(end) > 0)))
        i = j


def _table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    spelt = [w.encode() + b" " for w in words]
    return np.frombuffer(b"".join(spelt), np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in spelt])))


@lru_cache(maxsize=2)
def _names(path: str) -> tuple[np.ndarray, np.ndarray]:
    return _table(token_names(path))


@lru_cache(maxsize=1)
def _decimals() -> tuple[np.ndarray, np.ndarray]:
    return _table([str(k) for k in range(1 << 16)])


def decoded(ids: str = "ids", path: str | None = None):
    """Column: the text that the tokenizer library gives for ids, special tokens included. Its vocabulary file names no
    decoder, so that is the tokens' names with a space between. Null gives null."""
    path = path or default_tokenizer()

    def run(column: pa.Array) -> pa.Array:
        out = [pa.Array.from_buffers(pa.large_string(), len(end) - 1, [None, pa.py_buffer(end.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.string()) for flat, end in _spell(column, *_names(path))]
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return F.when(F.col(ids).isNotNull(), F.arrow_udf(run, "string")(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def ids_sha256(ids: str = "ids"):
    """Column: lowercase SHA-256 of decimal ids with a space between. For ids under 65,536."""

    def run(column: pa.Array) -> pa.Array:
        found = []
        for flat, end in _spell(column, *_decimals()):
            raw = memoryview(np.ascontiguousarray(flat))
            found += [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(end[:-1].tolist(), end[1:].tolist())]
        return pa.array(found, pa.string())

    return F.arrow_udf(run, "string")(F.coalesce(F.col(ids), F.array().cast("array<int>")))
