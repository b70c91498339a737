"""The network: slopes against finite differences, steps whatever the partitions, held-out rows, early best epoch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import network as N

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    """A ring, which no line divides, with a null here and there."""
    r = np.random.default_rng(0)
    x = r.normal(size=(1200, 2)) * [3, 0.5] + [10, -2]
    y = (((x - [10, -2]) / [3, 0.5]) ** 2).sum(1) > 1.4
    data = [(k, None if k % 200 == 3 else float(a), float(b), None if k == 7 else int(t)) for k, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, y int")


def test_slopes_are_finite_differences():
    r = np.random.default_rng(1)
    s = N.Settings(hidden=5, dropout=0.4)
    w = N.Weights.begun(3, 3, s)
    w.one[-1], w.two[-1] = r.normal(size=5), r.normal(size=3)
    x, y, kept = r.normal(size=(7, 3)), r.integers(0, 3, 7), N.kept_units(np.arange(7), 4, s)
    assert 0 < (kept == 0).mean() < 1
    _, one, two = w.loss_and_slopes(x, y, kept)
    for table, slope in ((w.one, one), (w.two, two)):
        for i, j in np.ndindex(table.shape):
            was = table[i, j]
            table[i, j] = was + 1e-6
            up = w.loss_and_slopes(x, y, kept)[0]
            table[i, j] = was - 1e-6
            down = w.loss_and_slopes(x, y, kept)[0]
            table[i, j] = was
            assert abs((up - down) / 2e-6 - slope[i, j]) < 1e-4


def test_dropout_keeps_its_share_and_doesnt_depend_on_the_batch():
    s = N.Settings(hidden=50, dropout=0.3)
    kept = N.kept_units(np.arange(2000), 9, s)
    assert abs((kept == 0).mean() - 0.3) < 0.01 and abs(kept.mean() - 1) < 0.02
    assert np.array_equal(kept[100:110], N.kept_units(np.arange(100, 110), 9, s)) and (N.kept_units(np.arange(9), -1, s) == 1).all()


def test_it_beats_the_majority_and_reruns_agree(rows):
    s = N.Settings(epochs=15)
    model = N.train(rows, COLUMNS, F.col("y"), F.col("id") % 4 == 0, F.col("id"), settings=s)
    again = N.train(rows.repartition(7), COLUMNS, F.col("y"), F.col("id") % 4 == 0, F.col("id"), settings=s)
    assert np.allclose(model.weights.one, again.weights.one, atol=1e-7) and len(model.losses) == 15
    found = model.predict(rows.filter("id % 4 = 0 AND y IS NOT NULL"))
    right, ones = found.agg(F.avg((F.col("y") == F.col("prediction")).cast("double")), F.avg("y")).first()
    assert right > max(ones, 1 - ones) + 0.15
    assert model.best_epoch == int(np.argmin(model.losses))


def test_the_best_epoch_is_kept(rows):
    wild = N.train(rows, COLUMNS, F.col("y"), F.col("id") % 4 == 0, F.col("id"), settings=N.Settings(epochs=6, rate=2.0))
    held = wild.predict(rows.filter("id % 4 = 0 AND y IS NOT NULL")).select("y", "prediction", "chance").collect()
    loss = -np.mean([np.log(c if p == y else max(1 - c, 1e-300)) for y, p, c in held])
    assert abs(loss - min(wild.losses)) < 1e-6 and wild.losses[wild.best_epoch] == min(wild.losses)


def test_no_rows_and_odd_columns(spark, rows):
    nothing = N.train(rows.limit(0), COLUMNS, F.col("y"), F.col("id") % 4 == 0, F.col("id"), settings=N.Settings(epochs=1))
    assert nothing.best_epoch == -1 and nothing.predict(rows).count() == rows.count()
    constant = rows.withColumn("c", F.lit(1.0))
    model = N.train(constant, ["a", "c"], F.col("y"), F.lit(False), F.col("id"), settings=N.Settings(epochs=1))
    assert model.losses == [] and model.predict(constant).filter("prediction IS NULL").count() == 0


def test_steps_read_their_own_batch(rows, monkeypatch):
    """All rows are written once, and once more by batch; together the batches hold each row once."""
    found = []
    monkeypatch.setattr(N, "cut", lambda df, cut=N.cut: found.append(cut(df)) or found[-1])
    N.train(rows, COLUMNS, F.col("y"), F.col("id") % 4 == 0, F.col("id"), settings=N.Settings(epochs=1, batches=3))
    whole, *batches = (f.count() for f in found)
    assert len(batches) == 4 and sum(batches) == whole == 1199 and batches[0] == 300 and max(batches[1:]) < 400
