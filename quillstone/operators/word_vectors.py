"""Skip-gram vectors of words from their parts, with negative sampling, trained over partitions.

A word's vector is the mean of those of its hashed parts: itself and its character n-grams. So words never seen have
vectors too, and the model's size is that of its tables, whatever the vocabulary. In each round every partition trains
a copy of the tables on its texts, and the copies' changes are averaged, block by block, over the partitions that
changed a row. Texts are dealt by key and sorted within a partition, and random numbers are seeded by round and
partition, so reruns agree.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.lineage import cut, prepare

#: Rows of a table that travel as one block; words that are trained on at once; words of a partition, of which there are
#: as many as it takes, ``parts`` at least.
BLOCK, WORDS, PART_WORDS = 2048, 20_000, 1_000_000


@dataclass(frozen=True)
class Settings:
    """Sizes of the tables, the n-grams of a word, and how it is trained. The tables are sent to each task: (buckets + contexts) * size * 4 bytes."""

    size: int = 32
    buckets: int = 1 << 15
    contexts: int = 1 << 14
    grams: tuple[int, int] = (3, 5)
    window: int = 4
    negatives: int = 5
    rounds: int = 4
    rate: float = 0.1
    batch: int = 256
    parts: int = 8
    seed: int = 42


def parts_of(word: str, settings: Settings) -> list[int]:
    """Buckets of a word and its n-grams, with marks at both ends."""
    marked = f"<{word}>"
    low, high = settings.grams
    found = {marked, *(marked[i : i + n] for n in range(low, high + 1) for i in range(len(marked) - n + 1))}
    return sorted(zlib.crc32(x.encode()) % settings.buckets for x in found)


class Tables:
    """A task's copy: vectors of parts and of contexts, and what its rows' steps have been."""

    def __init__(self, parts: np.ndarray, contexts: np.ndarray, settings: Settings, words: Sequence[str] = ()) -> None:
        """With ``words``, each of these has one part and one context, its row of the tables."""
        self.parts, self.contexts, self.settings = parts.copy(), contexts.copy(), settings
        self.steps = (np.zeros(len(parts)), np.zeros(len(contexts)))
        self._places = (np.zeros(len(parts), np.int64), np.zeros(len(contexts), np.int64))
        self._known = {w: k for k, w in enumerate(words)}
        self._of_context = np.arange(len(words))
        self._rows = self._of_context[:, None]

    def number(self, words: list[str]) -> np.ndarray:
        """Numbers of words, for this task; their parts are looked up once."""
        fresh = [w for w in dict.fromkeys(words) if w not in self._known]
        if fresh:
            found = [parts_of(w, self.settings) for w in fresh]
            wide = max(self._rows.shape[1], *(len(f) for f in found))
            rows = np.full((len(self._known) + len(fresh), wide), -1, np.int64)
            rows[: len(self._known), : self._rows.shape[1]] = self._rows
            for k, f in enumerate(found):
                rows[len(self._known) + k, : len(f)] = f
            self._rows = rows
            self._of_context = np.append(self._of_context, [zlib.crc32(w.encode()) % self.settings.contexts for w in fresh])
            for w in fresh:
                self._known[w] = len(self._known)
        return np.array([self._known[w] for w in words], np.int64)

    def _met(self, which: int, rows: np.ndarray, of: np.ndarray, share: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
        """A table's rows, each once, and how often (or with what share) it stands beside each of n numbers in ``of``. No sort:
        what is written to a row's place last stands for it."""
        own, k = self._places[which], np.arange(len(rows))
        own[rows] = k
        last = own.take(rows)
        first = np.flatnonzero(last == k)
        own[rows.take(first)] = np.arange(len(first))
        at = of * len(first)
        at += own.take(rows)
        return rows.take(first), np.bincount(at, share, n * len(first)).astype(self.parts.dtype).reshape(n, len(first))

    def _parts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' parts, one word's after another's, the word that each is of, and its share of that."""
        rows = self._rows[words]
        there = rows >= 0
        sizes = there.sum(1)
        return rows[there], np.arange(len(words)).repeat(sizes), (1 / sizes).repeat(sizes)

    def _slopes(self, mean: np.ndarray, out: np.ndarray, true: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of words with contexts, and slopes by word and by context: each word's with each context, as often as ``weight`` says."""
        score = mean @ out.T
        g = np.tanh(score * 0.5)
        g *= 0.5
        g += 0.5
        g -= true
        g *= weight
        return score, g @ out, g.T @ mean

    def loss_and_gradients(self, words: np.ndarray, targets: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Of words and, for each, one true context and then false ones: the loss, and its slopes by word and by target."""
        n, k = targets.shape
        true, weight = (np.kron(np.eye(n), np.arange(k) < most) for most in (1, k))
        parts, shares = self._met(0, *self._parts(words), n)
        score, by_word, by_target = self._slopes(shares @ self.parts[parts], self.contexts[targets.ravel()], true, weight)
        loss = (np.logaddexp(0, np.where(true > 0, -score, score)) * weight).sum()
        return float(loss), by_word, by_target.reshape(n, k, -1)

    def _step(self, which: int, rows: np.ndarray, was: np.ndarray, slopes: np.ndarray) -> None:
        """One step of a table's rows, each there once, from what they are."""
        steps = self.steps[which]
        own = steps.take(rows)
        own += np.einsum("nd,nd->n", slopes, slopes) / slopes.shape[1]
        steps[rows] = own
        slopes *= (self.settings.rate / np.sqrt(own + 1e-8)).astype(slopes.dtype)[:, None]
        (self.parts, self.contexts)[which][rows] = was - slopes

    def _move(self, which: int, rows: np.ndarray, of: np.ndarray, slopes: np.ndarray) -> None:
        """One step of a table's rows, each with the slopes numbered in ``of``; those of one row are added."""
        unique, times = self._met(which, rows, of, None, len(slopes))
        self._step(which, unique, (self.parts, self.contexts)[which].take(unique, 0), times.T @ slopes)

    def train(self, texts: list[list[str]], rng: np.random.Generator) -> None:
        """One pass over the pairs of words in each other's window, in steps of up to ``batch`` pairs of words that follow each
        other; the steps come in random order. Of a word with a whole window each pair has ``negatives`` false contexts, drawn
        once a step: the words of a step share them, so that scores and slopes are products of small matrices."""
        s = self.settings
        flat = self.number([w for t in texts for w in t])
        n, run, n_false = len(flat), max(1, s.batch // (2 * s.window)), 2 * s.window * s.negatives
        n_runs, wide = -(-n // run), run + 2 * s.window
        # Words of a run, and the places around it; beyond the ends is no text.
        text = np.full(n_runs * run + 2 * s.window, -1)
        text[s.window : s.window + n] = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        around = np.arange(n_runs)[:, None] * run + np.arange(wide)
        apart = np.abs(np.arange(run)[:, None] + s.window - np.arange(wide))
        own = text[around]
        pairs = (own[:, s.window : s.window + run, None] == own[:, None]) & (own[:, None] >= 0) & (apart > 0) & (apart <= s.window)
        n_pairs = pairs.sum(2)
        near = self._of_context[flat[np.clip(around - s.window, 0, n - 1)]]
        targets = np.concatenate((near, self._of_context[flat[rng.integers(0, n, (n_runs, n_false))]]), 1)
        false = (n_pairs * (s.negatives / max(n_false, 1))).astype(self.parts.dtype)
        rows, of, share = self._parts(flat)
        starts = np.searchsorted(of, np.arange(n_runs + 1) * run)
        every = np.arange(wide + n_false)
        true, weight = np.zeros((2, run, wide + n_false), self.parts.dtype)
        for k in rng.permutation(np.flatnonzero(n_pairs.any(1))):
            a, m = k * run, min(run, n - k * run)
            true[:, :wide] = weight[:, :wide] = pairs[k]
            weight[:, wide:] = false[k][:, None]
            here = slice(starts[k], starts[k + 1])
            parts, shares = self._met(0, rows[here], of[here] - a, share[here], m)
            was, out = self.parts.take(parts, 0), self.contexts.take(targets[k], 0)
            _, by_word, by_target = self._slopes(shares @ was, out, true[:m], weight[:m])
            # Places beyond a text's end stand for no context of its words.
            self._move(1, targets[k], every, by_target)
            self._step(0, parts, was, shares.T @ by_word)


def passed(tables: Tables, texts: Iterable[list[str]], rng: np.random.Generator) -> None:
    """Trains on texts, about WORDS words at a time."""
    held: list[list[str]] = []
    n = 0
    for words in texts:
        for a in range(0, len(words), WORDS):
            held.append(words[a : a + WORDS])
            n += len(held[-1])
            if n >= WORDS:
                tables.train(held, rng)
                held, n = [], 0
    if held:
        tables.train(held, rng)


def _round(parts, contexts, settings: Settings, turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trains on a partition's texts; gives the change of each block that has any, and which of its rows changed."""
    old = (parts.value, contexts.value)
    tables = Tables(*old, settings)
    texts = ([w for w in text.as_py() or () if w is not None] for batch in batches for text in batch.column(1))
    passed(tables, texts, np.random.default_rng([settings.seed, turn, TaskContext.get().partitionId()]))
    for which, table in enumerate((tables.parts, tables.contexts)):
        moved = tables.steps[which] > 0
        for a in range(0, len(table), BLOCK):
            if moved[a : a + BLOCK].any():
                change = (table[a : a + BLOCK] - old[which][a : a + BLOCK]).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([a], pa.int32()), pa.array([change.tobytes()], pa.binary()), pa.array([moved[a : a + BLOCK].tobytes()], pa.binary())], names=["side", "at", "change", "moved"])


def _averaged(table: pa.Table) -> pa.Table:
    """The mean change of a block's rows over the partitions that changed them."""
    moved = np.stack([np.frombuffer(x.as_py(), bool) for x in table["moved"]])
    change = np.stack([np.frombuffer(x.as_py(), "<f4").reshape(moved.shape[1], -1) for x in table["change"]])
    mean = (change.astype(np.float64).sum(0) / np.maximum(moved.sum(0), 1)[:, None]).astype("<f4")
    return pa.table([table["side"].slice(0, 1), table["at"].slice(0, 1), pa.array([mean.tobytes()], pa.binary())], names=["side", "at", "change"])


@dataclass(frozen=True)
class Model:
    parts: np.ndarray
    contexts: np.ndarray
    settings: Settings

    def vectors(self, words: DataFrame, word: str = "word") -> DataFrame:
        """The rows with ``vector``, of unit length; null for a null word, and there for any other, seen or not."""
        prepare(words.sparkSession)
        parts, settings = words.sparkSession.sparkContext.broadcast(self.parts), self.settings
        at = words.columns.index(word)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = parts.value
            for batch in batches:
                out = []
                for w in batch.column(at).to_pylist():
                    v = None if w is None else table[parts_of(w, settings)].astype(np.float64).mean(0)
                    out.append(None if v is None else (v / max(np.linalg.norm(v), 1e-12)).tolist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields) + ", vector array<double>"
        return words.mapInArrow(run, schema)


def train(docs: DataFrame, key: str, words: Column, settings: Settings | None = None) -> Model:
    """A model of the texts' words, an array of strings a row. Null rows and words are passed over; no rows leave the tables as they begin."""
    settings = settings or Settings()
    prepare(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rng = np.random.default_rng(settings.seed)
    tables = [((rng.random((settings.buckets, settings.size)) - 0.5) / settings.size).astype(np.float32), np.zeros((settings.contexts, settings.size), np.float32)]
    rows = docs.select(F.col(key).alias("key"), words.alias("words"))
    n_words = rows.agg(F.sum(F.greatest(F.size("words"), F.lit(0)).cast("long"))).first()[0] or 0
    parts = max(settings.parts, math.ceil(n_words / PART_WORDS))
    rows = cut(rows.repartition(parts, F.xxhash64("key")).sortWithinPartitions("key", "words"))
    for turn in range(settings.rounds):
        sent = [sc.broadcast(t) for t in tables]
        changes = rows.mapInArrow(lambda b, turn=turn, sent=sent: _round(*sent, settings, turn, b), "side int, at int, change binary, moved binary")
        # As many rows come back as the tables have blocks.
        for r in changes.groupBy("side", "at").applyInArrow(_averaged, "side int, at int, change binary").collect():
            change = np.frombuffer(bytes(r["change"]), "<f4").reshape(-1, settings.size)
            tables[r["side"]][r["at"] : r["at"] + len(change)] += change
        for s in sent:
            s.unpersist()
    return Model(tables[0], tables[1], settings)
