"""A network with one hidden layer on numeric columns, trained by mini-batches over all tasks.

Each step sums the slopes of one batch's rows, task by task in numpy, and takes one step of Adam with the sum: the same
as on one machine, whatever the partitions, but for the order of additions. Hidden units are dropped by a hash of row
and step, so that reruns agree and a row's mask doesn't depend on its task. The weights of the epoch with the least
loss on held-out rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.lineage import cut, prepare


@dataclass(frozen=True)
class Settings:
    hidden: int = 16
    epochs: int = 12
    batches: int = 4
    rate: float = 0.05
    dropout: float = 0.1
    seed: int = 42


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def kept_units(row: np.ndarray, step: int, settings: Settings) -> np.ndarray:
    """(rows, hidden): 0 for a dropped unit, else what makes up for the dropped ones. step -1 drops none."""
    if settings.dropout <= 0 or step < 0:
        return np.ones((len(row), settings.hidden))
    unit = np.arange(settings.hidden, dtype=np.uint64)
    code = _mixed(row.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + unit * np.uint64(0xD1342543DE82EF95) + np.uint64(step * 1_000_003 + settings.seed))
    return (code.astype(np.float64) / 2.0**64 >= settings.dropout) / (1 - settings.dropout)


class Weights:
    """Two layers: (columns + 1, hidden) and (hidden + 1, classes); the last row of each is what is added."""

    def __init__(self, one: np.ndarray, two: np.ndarray) -> None:
        self.one, self.two = one, two

    @classmethod
    def begun(cls, columns: int, classes: int, settings: Settings) -> Weights:
        rng = np.random.default_rng(settings.seed)
        one, two = rng.normal(0, (2 / columns) ** 0.5, (columns + 1, settings.hidden)), rng.normal(0, (2 / settings.hidden) ** 0.5, (settings.hidden + 1, classes))
        one[-1], two[-1] = 0, 0
        return cls(one, two)

    def scores(self, x: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-chances of the classes, the hidden values, and what went into them."""
        inside = np.column_stack((x, np.ones(len(x))))
        hidden = np.maximum(inside @ self.one, 0) * kept
        z = np.column_stack((hidden, np.ones(len(x)))) @ self.two
        z = z - z.max(1, keepdims=True) if len(z) else z
        return z - np.log(np.exp(z).sum(1, keepdims=True)), hidden, inside

    def loss_and_slopes(self, x: np.ndarray, y: np.ndarray, kept: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Sums over the rows of the cross-entropy and its slopes."""
        logs, hidden, inside = self.scores(x, kept)
        d = np.exp(logs)
        d[np.arange(len(y)), y] -= 1
        back = (d @ self.two[:-1].T) * kept * (inside @ self.one > 0)
        return float(-logs[np.arange(len(y)), y].sum()), inside.T @ back, np.column_stack((hidden, np.ones(len(x)))).T @ d


@dataclass(frozen=True)
class Model:
    columns: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: Weights
    losses: list[float]
    settings: Settings

    @property
    def best_epoch(self) -> int:
        """The first epoch, from 0, of the least held-out loss."""
        return int(np.argmin(self.losses)) if self.losses else -1

    def predict(self, rows: DataFrame) -> DataFrame:
        """The rows with ``prediction`` and ``chance``, that of the predicted class. A null column counts as its mean."""
        prepare(rows.sparkSession)
        columns, mean, scale, weights, settings = self.columns, self.mean, self.scale, self.weights, self.settings
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float(m))) for c, m in zip(columns, mean)])
        named = rows.withColumn("__x", x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(columns))
                logs, _, _ = weights.scores((values - mean) / scale, kept_units(np.zeros(batch.num_rows), -1, settings))
                best = logs.argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best.astype(np.int32)), pa.array(np.exp(logs.max(1)))], names=[*batch.schema.names[:-1], "prediction", "chance"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", prediction int, chance double"
        return named.mapInArrow(run, schema)


def train(rows: DataFrame, columns: Sequence[str], label: Column, held_out: Column, key: Column, classes: int = 2, settings: Settings | None = None) -> Model:
    """A model of label (0, 1, ...) by columns, from rows that aren't held out; the held-out rows choose the epoch.

    Rows whose label is null are passed over, and null columns count as their mean. ``key`` names a row for batches and
    dropout. Each step sends the weights out, and one row of sums a task comes back.
    """
    settings = settings or Settings()
    prepare(rows.sparkSession)
    columns = list(columns)
    known = rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], label.cast("int").alias("y"), F.coalesce(held_out, F.lit(False)).alias("out"), F.xxhash64(key).alias("row")).filter("y IS NOT NULL")
    inside = known.filter(~F.col("out"))
    stats = inside.agg(*[f(f"x{i}") for i in range(len(columns)) for f in (F.avg, F.stddev_pop)]).first()
    mean, scale = (np.array([v if v else d for v in stats[k::2]], float) for k, d in ((0, 0.0), (1, 1.0)))
    x = F.array(*[(F.coalesce(f"x{i}", F.lit(float(m))) - float(m)) / float(s) for i, (m, s) in enumerate(zip(mean, scale))])
    # Held-out rows are a batch of their own, numbered -1.
    batch = F.when(F.col("out"), -1).otherwise(F.pmod(F.col("row"), F.lit(settings.batches))).cast("int")
    ready = cut(known.select(x.alias("x"), "y", "row", batch.alias("batch")))
    # A step reads its own batch only, not all rows.
    dealt = {number: cut(ready.filter(F.col("batch") == number).drop("batch")) for number in range(-1, settings.batches)}

    def sums(weights: Weights, number: int, step: int) -> tuple[float, int, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                values = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(columns))
                found = weights.loss_and_slopes(values, b.column(1).to_numpy(), kept_units(b.column(2).to_numpy(), step, settings))
                found = (found[0], b.num_rows, found[1], found[2])
                total = found if total is None else tuple(p + q for p, q in zip(total, found))
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([total[0]]), pa.array([total[1]]), pa.array([total[2].tobytes()], pa.binary()), pa.array([total[3].tobytes()], pa.binary())], names=["loss", "n", "one", "two"])

        got = dealt[number].mapInArrow(run, "loss double, n long, one binary, two binary").collect()
        shape = lambda name, like: sum((np.frombuffer(bytes(r[name])).reshape(like.shape) for r in got), np.zeros_like(like))
        return sum(r["loss"] for r in got), sum(r["n"] for r in got), shape("one", weights.one), shape("two", weights.two)

    weights = best = Weights.begun(len(columns), classes, settings)
    first, second = ([np.zeros_like(weights.one), np.zeros_like(weights.two)] for _ in range(2))
    losses: list[float] = []
    step = 0
    for _ in range(settings.epochs):
        for number in range(settings.batches):
            _, n, *slopes = sums(weights, number, step)
            if not n:
                continue
            step += 1
            moved = []
            for p, g, m, v in zip((weights.one, weights.two), slopes, first, second):
                g = g / n
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                moved.append(p - settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
            weights = Weights(*moved)
        loss, n, *_ = sums(weights, -1, -1)
        if not n:
            best = weights
            continue
        losses.append(loss / n)
        if losses[-1] == min(losses):
            best = weights
    return Model(columns, mean, scale, best, losses, settings)
