"""Toxicity by non-negative positive-unlabelled learning.

Known toxic documents and a sample of unlabelled ones train a logistic model over words and word beginnings, each
present at all or twice. The risk of the negative class is estimated as the unlabelled risk less the share of it that
the class prior puts down to positives; where that estimate falls below zero its gradient is turned round, so that the
model can't win by fitting the positives it was shown. The estimator itself chooses among the features: a weight leaves
zero only where the risk's slope exceeds its sampling error; the chosen ones are then fitted without that penalty.

Features are counted on the executors. The driver sees the hashes of bounded samples, never a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import LOWER, cut, mix, pieces, prepare, running_sums, shingles, span_hashes, text_or_empty, word_spans

FOLDS = 5
#: About how many documents, and bytes of text, of either training sample there are at most.
POSITIVES, POSITIVE_BYTES, UNLABELLED, UNLABELLED_BYTES = 4000, 12 << 20, 8000, 24 << 20
#: The fewest positives that show a feature, and their least share: rarer words stand out by chance; features whose share of positives stands out by so many deviations; most of them.
SUPPORT, SHARE, STRENGTH, FEATURES = 3, 0.01, 3.0, 1 << 15
#: Lengths in bytes of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6, 7, 8)
#: Sampling errors that a slope must exceed for its weight to leave zero; steps of the choice and of the fit; their size as a share of the curvature.
ERRORS, USED, CHOICE_STEPS, FIT_STEPS, CAUTION = 1.0, 0.05, 200, 400, 20.0
#: Pairs of least hashes over runs of five words; texts of a sample that share one are copies of each other.
KINSHIP, RUN = 8, 5
#: The bias stays above this, so that one strong feature of a short text can outweigh it, and under the prior's log-odds.
FLOOR = -2.3

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_TWICE = np.uint64(1)


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8."""
    low = LOWER[data]
    if len(low) > 1:
        second = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[np.flatnonzero(second) + 1] += 0x20
    return low


def occurrences(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, rows) of each kind of feature, a hash's last bit being 0: whole words, then beginnings of longer words."""
    low = lowered(data)
    starts, ends, row = word_spans(low, off, _LETTER)
    if not len(starts):
        return
    sums = running_sums(low)
    yield span_hashes(low, starts, ends, sums) & ~_TWICE, row
    for n in STEMS:
        long = ends - starts > n
        yield (span_hashes(low, starts[long], starts[long] + n, sums) ^ np.uint64(2 * n)) & ~_TWICE, row[long]


def codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, row), in order of rows: each feature that a row has, and its code with the last bit set if it has it twice."""
    found = list(occurrences(data, off))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, row = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
    often = np.diff(np.append(first, len(h))) > 1
    h, row = np.concatenate((h[first], h[first][often] | _TWICE)), np.concatenate((row[first], row[first][often]))
    order = np.argsort(row, kind="stable")
    return h[order], row[order]


@dataclass(frozen=True)
class Model:
    """Of features by rising hash, the weights of having one and of having it twice; at most FEATURES of them, so it may travel with every task."""

    hashes: np.ndarray
    weights: np.ndarray
    again: np.ndarray
    bias: float

    @staticmethod
    def of(names: np.ndarray, weights: np.ndarray, bias: float) -> Model:
        """The model of weights of codes."""
        hashes, at = np.unique(names & ~_TWICE, return_inverse=True)
        out = np.zeros((2, len(hashes)))
        np.add.at(out, ((names & _TWICE).astype(np.int64), at), weights)
        return Model(hashes, out[0], out[1], bias)

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.full(len(off) - 1, self.bias)
        if len(self.hashes):
            hits = []
            door = np.zeros(1 << 20, bool)
            door[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
            for h, row in occurrences(data, off):
                may = np.flatnonzero(door[(h >> np.uint64(44)).astype(np.int64)])
                at = places(self.hashes, h[may])
                hits.append(row[may][at >= 0] * len(self.hashes) + at[at >= 0])
            if hits:
                found, times = np.unique(np.concatenate(hits), return_counts=True)
                at = found % len(self.hashes)
                np.add.at(out, found // len(self.hashes), self.weights[at] + np.where(times > 1, self.again[at], 0.0))
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def places(names: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where each of ``found`` stands in the sorted names, or -1."""
    if not len(names):
        return np.full(len(found), -1)
    at = np.searchsorted(names, found)
    at[at == len(names)] = 0
    return np.where(names[at] == found, at, -1)


@dataclass(frozen=True)
class Shown:
    """Which rows of a sample show which features, as pairs (feature, row)."""

    feature: np.ndarray
    row: np.ndarray
    n: int

    def share(self, size: int) -> np.ndarray:
        return np.bincount(self.feature, minlength=size) / self.n

    def odds(self, w: np.ndarray, b: float) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.bincount(self.row, w[self.feature], self.n) + b, -50, 50)))

    def only(self, keep: np.ndarray) -> Shown:
        new = np.cumsum(keep) - 1
        took = keep[self.feature]
        return Shown(new[self.feature[took]], self.row[took], self.n)


def descend(positive: Shown, unlabelled: Shown, size: int, prior: float, penalty: float, steps: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights and bias of least non-negative risk on the way of an accelerated proximal descent; how often a weight was over zero.

    A step is scaled by the curvature of its feature; the penalty on a weight is in sampling errors of its slope.
    """
    p, u = positive.share(size), unlabelled.share(size)
    curve = prior * p + u + 1e-12
    error = penalty * np.sqrt(prior**2 * p * (1 - p) / positive.n + u * (1 - u) / unlabelled.n)
    step, b_step = 4 / (CAUTION * curve), 4 / (CAUTION * (1 + prior))
    base = float(np.log(prior / (1 - prior)))
    w, b, speed = np.zeros(size), base, 1.0
    ahead, b_ahead, best, used = w, b, (np.inf, w, b), np.zeros(size, int)
    for _ in range(steps):
        fp, fu = positive.odds(ahead, b_ahead), unlabelled.odds(ahead, b_ahead)
        negative = -np.log(1 - fu + 1e-9).mean() + prior * np.log(1 - fp + 1e-9).mean()
        risk = -prior * np.log(fp + 1e-9).mean() + max(0.0, negative) + (error * np.abs(ahead)).sum()
        if risk < best[0]:
            best = (risk, ahead, b_ahead)
        dp, du = -prior * fp / positive.n, fu / unlabelled.n
        dp, du = (dp - prior * (1 - fp) / positive.n, du) if negative >= 0 else (-dp, -du)
        slope = np.bincount(positive.feature, dp[positive.row], size) + np.bincount(unlabelled.feature, du[unlabelled.row], size)
        new = ahead - step * slope
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * error)
        b_new = min(base, max(FLOOR, b_ahead - b_step * (dp.sum() + du.sum())))
        faster = 1.0 if (slope * (new - w)).sum() > 0 else (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        ahead, b_ahead = new + (speed - 1) / faster * (new - w), min(base, b_new + (speed - 1) / faster * (b_new - b))
        w, b, speed = new, b_new, faster
        used += w > 0
    return best[1], best[2], used


def stands_out(p: np.ndarray, u: np.ndarray, n_positive: int) -> np.ndarray:
    """Which features positives show more often, by STRENGTH deviations or more; the FEATURES strongest at most."""
    strength = (p - u) / np.sqrt(u * (1 - u) / n_positive + 1e-12)
    keep = np.zeros(len(p), bool)
    keep[np.argsort(-strength, kind="stable")[:FEATURES]] = True
    return keep & (strength > STRENGTH)


def train(names: np.ndarray, positive: Shown, unlabelled: Shown, prior: float) -> Model:
    """The model over the codes ``names``; without features, one that scores everything by the prior."""
    prior = min(0.95, max(0.001, prior))
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), min(float(np.log(prior / (1 - prior))), -0.1))
    if not len(names):
        return none
    keep = descend(positive, unlabelled, len(names), prior, ERRORS, CHOICE_STEPS)[2] > CHOICE_STEPS * USED
    if not keep.any():
        return none
    w, b, _ = descend(positive.only(keep), unlabelled.only(keep), int(keep.sum()), prior, 0.0, FIT_STEPS)
    return Model.of(names[keep], w, b)


def fold(col: str = "doc_id", folds: int = FOLDS) -> Column:
    return F.crc32(F.col(col).cast("long").cast("string")) % folds


def _listed(names: np.ndarray | None, chosen: np.ndarray | None = None):
    """Maps rows (h, text), or those of the ``chosen`` h, to (h, found, kin): the text's codes, or with names the places of
    those that it has, and the keys that it shares with its copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if chosen is not None:
                batch = batch.filter(pa.array(places(chosen, batch.column(0).to_numpy()) >= 0))
            for part, data, off in pieces(iter((batch,))):
                code, row = codes(data, off)
                if names is not None:
                    at = places(names, code)
                    code, row = at[at >= 0], row[at >= 0]
                lists = pa.ListArray.from_arrays(pa.array(_edges(row, len(off) - 1)), pa.array(code.view(np.int64)))
                kin = pa.ListArray.from_arrays(pa.array(np.arange(len(off), dtype=np.int32) * KINSHIP), pa.array(_kinship(data, off).ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, kin], names=["h", "found", "kin"])

    return run


def _edges(row: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)


def _kinship(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """KINSHIP keys of each row, each of two least hashes of its runs of words; a row without words has its number in all."""
    h, row, _ = shingles(lowered(data), off, RUN)
    order = np.argsort(row, kind="stable")
    h, edge = h[order], _edges(row, len(off) - 1)
    filled = np.flatnonzero(np.diff(edge))
    out = np.repeat(np.arange(len(off) - 1, dtype=np.uint64)[:, None], KINSHIP, 1)
    for k in range(KINSHIP if len(filled) else 0):
        a, b = (np.minimum.reduceat(mix(h + np.uint64(2 * k + j + 1)), edge[filled]) for j in (0, 1))
        out[filled, k] = mix(a * np.uint64(3) + b)
    return out


def one_of_each(keys: np.ndarray) -> np.ndarray:
    """Whether each row is the first of those that its keys, column by column, link with it directly or through others."""
    label = np.arange(len(keys))
    columns = [np.unique(keys[:, k], return_inverse=True)[1] for k in range(keys.shape[1])]
    while len(keys):
        before = label
        for group in columns:
            least = np.full(group.max() + 1, len(keys))
            np.minimum.at(least, group, label)
            label = least[group]
        if (label == before).all():
            break
    return label == np.arange(len(keys))


def _bounded(rows: DataFrame, size: int, n: int, most: int, n_bytes: int, salt: int) -> DataFrame:
    """About ``size`` of the n rows, with about ``most`` of their bytes at most, chosen by a hash of the id; equal texts once."""
    rate = min(1.0, size / max(1, n), most / max(1, n_bytes))
    rows = rows if rate >= 1 else rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * rate))
    return rows.select(F.xxhash64("text").alias("h"), "text").dropDuplicates(["h"])


_SCHEMA = "h long, found array<long>, kin array<long>"


def _flat(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Elements of a list column and the row of each."""
    lists = table[column].combine_chunks()
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _collected(rows: DataFrame) -> pa.Table:
    """A bounded sample on the driver, in order of its hashes."""
    return rows.toArrow().combine_chunks().sort_by("h").combine_chunks()


def _first_of_kin(rows: DataFrame) -> np.ndarray:
    """Hashes, in order, of a sample's rows without near copies of an earlier one."""
    table = _collected(rows.mapInArrow(_listed(np.zeros(0, np.uint64)), _SCHEMA))
    return table["h"].to_numpy()[one_of_each(_flat(table, "kin")[0].reshape(-1, KINSHIP))]


def _shown(rows: DataFrame, names: np.ndarray, chosen: np.ndarray) -> Shown:
    """Which of the chosen rows of a sample show which of the names."""
    table = _collected(rows.mapInArrow(_listed(names, chosen), _SCHEMA).select("h", "found"))
    return Shown(*_flat(table, "found"), table.num_rows)


def _counted(rows: DataFrame, names: np.ndarray | None, chosen: np.ndarray, least: float) -> pa.Table:
    """(at, n) of what at least so many of the chosen rows show."""
    found = rows.mapInArrow(_listed(names, chosen), _SCHEMA).select(F.explode("found").alias("at"))
    return found.groupBy("at").agg(F.count("*").alias("n")).filter(F.col("n") >= least).toArrow()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on samples of documents labelled toxic and of others, none of them of fold 0, bounded in rows and in bytes.

    The class prior is the share of toxic ones among the labelled rows outside fold 0; where rows of labels repeat an id,
    it is toxic if one says so. Copies and near copies of a text count once in a sample, so that words of a
    large family of copies don't pass for signs of toxicity.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(fold() != 0).filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, k = known.agg(F.count("*"), F.sum("toxic")).first()
    prior = (k or 0) / n if n else 0.0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter(fold() != 0)
    toxic = known.filter("toxic = 1").select("doc_id")
    if (k or 0) > POSITIVES:
        toxic = toxic.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * POSITIVES / k))
    positive = texts.join(F.broadcast(toxic), "doc_id")  # about POSITIVES ids at most
    size = F.sum(F.octet_length("text").cast("long"))
    n_positive, positive_bytes = positive.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    n_texts, text_bytes = texts.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    positive = cut(_bounded(positive, POSITIVES, n_positive, POSITIVE_BYTES, positive_bytes, 2))
    others = cut(_bounded(texts, UNLABELLED, n_texts, UNLABELLED_BYTES, text_bytes, 3))
    toxic_ones, chosen = _first_of_kin(positive), _first_of_kin(others)
    nothing = Shown(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
    if not len(toxic_ones) or not len(chosen):
        return train(np.zeros(0, np.uint64), nothing, nothing, prior)
    least = min(max(SUPPORT, SHARE * len(toxic_ones)), len(toxic_ones))
    names = np.sort(_counted(positive, None, toxic_ones, least)["at"].to_numpy().view(np.uint64))
    shown = _shown(positive, names, toxic_ones)
    among = _counted(others, names, chosen, 1)
    u = np.ones(len(names))
    u[among["at"].to_numpy()] += among["n"].to_numpy()
    keep = stands_out(shown.share(len(names)), u / (len(chosen) + 2), shown.n)
    return train(names[keep], shown.only(keep), _shown(others, names[keep], chosen), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row, from its whole text.

    Null and empty texts get the score of a text without a feature. Without training rows that is the class prior,
    under one half. Repeated rows are scored one by one, alike. A null id is never held out. An empty table gives no
    rows; only doc_id and text are looked at.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in pieces(batches):
            s = model.scores(data, off)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows predicted not toxic, with their columns, whatever these are called; nothing is shuffled.

    Every row is judged by its own text, so null texts, repeated ids and repeated rows need no rule; null and empty
    texts stay. An empty table gives no rows.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in pieces(batches, "text"):
            yield part.filter(pa.array(model.scores(data, off) < 0.5))

    return docs.mapInArrow(run, docs.schema)
