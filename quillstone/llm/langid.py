"""Language of a text by a convolutional network over its bytes, trained in numpy.

Bytes are embedded, filters of several widths run over windows of a fixed length, each filter's greatest response in a
window goes through a softmax layer, and a text's languages are scored by the mean log-probability of its windows, which cover all of
it. For scoring, embedding and filters are multiplied out into tables of the responses to byte pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import pieces, prepare, sample, text_or_empty

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 8, 8
#: Labelled documents sampled at most, about; windows taken of each; training epochs.
DOCUMENTS, PER_DOCUMENT, EPOCHS, BATCH, RATE = 1500, 4, 12, 64, 0.01
UNKNOWN = "und"


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all rows, the last of a row filled up with spaces, and the row of each. Empty rows have one."""
    size = np.diff(off)
    count = np.maximum(1, -(-size // WINDOW))
    out = np.full(int(count.sum()) * WINDOW, 32, np.uint8)
    first = (np.cumsum(count) - count) * WINDOW
    out[np.arange(len(data)) + np.repeat(first - off[:-1], size)] = data
    return out.reshape(-1, WINDOW), np.repeat(np.arange(len(size)), count)


@dataclass
class Model:
    names: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """For each width, (offset, table): what a byte pair, or the last single byte, at that offset adds to a response."""
        found = []
        for width, w in zip(WIDTHS, self.filters):
            one = [(self.embed @ w[k * EMBED : (k + 1) * EMBED]).astype(np.float32) for k in range(width)]
            parts = [(k, (one[k + 1][None] + one[k][:, None]).reshape(65536, -1)) for k in range(0, width - 1, 2)]
            if width % 2:
                parts.append((width - 1, one[-1]))
            found.append(parts)
        return found

    def log_probs(self, batch: np.ndarray, tables: list[list[tuple[int, np.ndarray]]]) -> np.ndarray:
        pairs = batch[:, :-1].astype(np.int32) << 8 | batch[:, 1:]
        pooled = []
        for width, parts, shift in zip(WIDTHS, tables, self.shifts):
            length = WINDOW - width + 1
            total = None
            for at, table in parts:
                index = (pairs if len(table) == 65536 else batch)[:, at : at + length]
                add = table.take(index, axis=0)
                total = add if total is None else np.add(total, add, out=total)
            pooled.append(np.maximum(total.max(1) + shift, 0))
        z = np.concatenate(pooled, 1) @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def spread(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Of each row, up to PER_DOCUMENT windows that lie evenly over it."""
    x, row = windows(data, off)
    edge = np.searchsorted(row, np.arange(len(off)))
    return [x[a:b][np.linspace(0, b - a - 1, min(b - a, PER_DOCUMENT)).astype(int)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


def train(shown: list[tuple[np.ndarray, str]], seed: int = 5) -> Model | None:
    """Adam on the cross-entropy of windows, given as (windows, language) of each text; None without texts."""
    if not shown:
        return None
    names = sorted({lang for _, lang in shown})
    x, y = np.concatenate([w for w, _ in shown]), np.array([names.index(lang) for w, lang in shown for _ in w])
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, (2 / shape[0]) ** 0.5, shape).astype(np.float32)
    params = [rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), *(normal(w * EMBED, FILTERS) for w in WIDTHS), *(np.zeros(FILTERS, np.float32) for _ in WIDTHS), normal(FILTERS * len(WIDTHS), len(names)), np.zeros(len(names), np.float32)]
    k = len(WIDTHS)
    weight = (len(y) / (len(names) * np.bincount(y, minlength=len(names))))[y]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            at = order[i : i + BATCH]
            xb, yb = x[at], y[at]
            n, rows = len(at), np.arange(len(at))
            e = params[0][xb]
            pooled, spots, patches = [], [], []
            for j, width in enumerate(WIDTHS):
                p = sliding_window_view(e, width, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - width + 1, width * EMBED)
                r = p @ params[1 + j] + params[1 + k + j]
                spot = r.argmax(1)
                pooled.append(np.take_along_axis(r, spot[:, None], 1)[:, 0])
                spots.append(spot)
                patches.append(p)
            h = np.concatenate(pooled, 1)
            a = np.maximum(h, 0)
            z = a @ params[-2] + params[-1]
            z = np.exp(z - z.max(1, keepdims=True))
            d = z / z.sum(1, keepdims=True)
            d[rows, yb] -= 1
            d = (d * weight[at][:, None] / n).astype(np.float32)
            grads = [np.zeros_like(p) for p in params]
            grads[-2], grads[-1] = a.T @ d, d.sum(0)
            dh = (d @ params[-2].T) * (h > 0)
            for j, width in enumerate(WIDTHS):
                dj = dh[:, j * FILTERS : (j + 1) * FILTERS]
                taken = patches[j][rows[:, None], spots[j]]  # (n, filters, width * embed)
                grads[1 + j] = np.einsum("nfc,nf->cf", taken, dj)
                grads[1 + k + j] = dj.sum(0)
                back = (dj[:, :, None] * params[1 + j].T[None]).reshape(n, FILTERS, width, EMBED)
                for o in range(width):
                    np.add.at(grads[0], xb[rows[:, None], spots[j] + o], back[:, :, o])
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(names, params[0], params[1 : 1 + k], params[1 + k : 1 + 2 * k], params[-2], params[-1])


def in_training(folds: int = 3, held_out: int = 1):
    return F.crc32(F.col("doc_id").cast("long").cast("string")) % folds != held_out


def fit(docs: DataFrame) -> Model | None:
    """Trains on a sample of about DOCUMENTS rows with a language, outside the held-out third."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL").filter(in_training())
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([w.tobytes() for w in spread(data, off)], pa.binary())], names=["lang", "windows"])

    # A kilobyte a text comes back, however long it is.
    cut_out = sample(rows, DOCUMENTS, 3).select("lang", "text").mapInArrow(run, "lang string, windows binary")
    found = sorted({(bytes(r["windows"]), r["lang"]) for r in cut_out.collect()})
    return train([(np.frombuffer(w, np.uint8).reshape(-1, WINDOW), lang) for w, lang in found])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, from its whole text.

    Texts that are null or hold no letter, and all texts where there was nothing to learn from, are ``und`` with
    score 0. Repeated rows are judged alike; a null id is never held out. An empty table gives no rows.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for part, data, off in pieces(batches):
            n = len(off) - 1
            names, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if model:
                x, row = windows(data, off)
                logs = np.concatenate([model.log_probs(x[i : i + 64], tables) for i in range(0, len(x), 64)])
                count = np.bincount(row, minlength=n)
                mean = np.stack([np.bincount(row, logs[:, k], n) for k in range(logs.shape[1])], 1) / count[:, None]
                chance = np.exp(mean - mean.max(1, keepdims=True))
                chance /= chance.sum(1, keepdims=True)
                letters = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                names[letters] = np.array(model.names, object)[chance.argmax(1)][letters]
                score[letters] = chance.max(1)[letters]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names.tolist(), pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~in_training(), F.lit(False)).alias("held_out"), text_or_empty().rlike(r"\p{L}").alias("letters"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
