"""Skip-gram vectors from parts: slopes against finite differences, planted synonyms, unseen words, reruns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import word_vectors as W

SMALL = W.Settings(size=16, buckets=1 << 12, contexts=1 << 11, rounds=4, parts=3)


def planted(n=900):
    """Texts of eight themes; in each, two words of unlike spelling stand in the same places."""
    r = random.Random(1)
    make = lambda k: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(k))
    themes = [[make(3) for _ in range(6)] for _ in range(8)]
    twins = [(make(3), make(4)) for _ in range(8)]
    rows = []
    for k in range(n):
        t = k % 8
        words = [r.choice(themes[t]) for _ in range(8)]
        words[r.randrange(8)] = twins[t][r.randrange(2)]
        rows.append((k, words))
    return rows, twins


@pytest.fixture(scope="module")
def model(spark):
    rows, twins = planted()
    docs = spark.createDataFrame(rows, "id long, words array<string>")
    return W.train(docs, "id", F.col("words"), SMALL), docs, twins


def vectors(spark, model, words):
    found = model.vectors(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    return {r["word"]: np.array(r["vector"]) for r in found}


def test_slopes_are_finite_differences():
    r = np.random.default_rng(0)
    s = W.Settings(size=5, buckets=64, contexts=32)
    tables = W.Tables(r.normal(size=(64, 5)), r.normal(size=(32, 5)), s)
    words, targets = tables.number(["ab", "abc", "ab"]), r.integers(0, 32, (3, 4))
    _, by_word, by_target = tables.loss_and_gradients(words, targets)
    rows = tables._rows[words]
    slope_parts, slope_contexts = np.zeros((64, 5)), np.zeros((32, 5))
    for k in range(3):
        own = rows[k][rows[k] >= 0]
        np.add.at(slope_parts, own, by_word[k] / len(own))
    np.add.at(slope_contexts, targets.ravel(), by_target.reshape(-1, 5))
    for table, slope in ((tables.parts, slope_parts), (tables.contexts, slope_contexts)):
        for i, j in [(int(rows[0][0]), 1), (int(targets[0][0]), 2), (int(targets[2][3]), 4)]:
            if i >= len(table):
                continue
            was, step = table[i, j], 1e-5
            table[i, j] = was + step
            up = tables.loss_and_gradients(words, targets)[0]
            table[i, j] = was - step
            down = tables.loss_and_gradients(words, targets)[0]
            table[i, j] = was
            assert abs((up - down) / (2 * step) - slope[i, j]) < 1e-4


def test_planted_synonyms_are_near(spark, model):
    model, _, twins = model
    words = [w for pair in twins for w in pair]
    v = vectors(spark, model, words)
    right = 0
    for a, b in twins + [(b, a) for a, b in twins]:
        right += max((w for w in words if w != a), key=lambda w: v[a] @ v[w]) == b
    assert right >= 12  # of 16; chance is one in fifteen each


def test_words_never_seen_have_vectors(spark, model):
    model, _, twins = model
    word = twins[0][1]
    v = vectors(spark, model, [word, word + "s", "xyzzy", "é漢"])
    assert all(abs(np.linalg.norm(x) - 1) < 1e-9 for x in v.values())
    assert v[word] @ v[word + "s"] > 0.7 and v[word] @ v[word + "s"] > v[word] @ v["xyzzy"]
    nulls = model.vectors(spark.createDataFrame([(1, None), (2, "a")], "id int, word string"))
    assert [r["vector"] is None for r in nulls.orderBy("id").collect()] == [True, False]


def test_reruns_agree_and_tasks_share_the_work(spark, model):
    first, docs, _ = model
    again = W.train(docs.repartition(5), "id", F.col("words"), SMALL)
    assert np.array_equal(first.parts, again.parts) and np.array_equal(first.contexts, again.contexts)
    other = W.train(docs, "id", F.col("words"), W.Settings(size=16, buckets=1 << 12, contexts=1 << 11, rounds=1, parts=1))
    assert not np.array_equal(first.parts, other.parts)


def test_null_and_no_texts(spark):
    odd = spark.createDataFrame([(1, None), (2, []), (None, ["a", None, "b"]), (3, ["alone"])], "id long, words array<string>")
    assert W.train(odd, "id", F.col("words"), SMALL).parts.shape == (1 << 12, 16)
    nothing = W.train(odd.limit(0), "id", F.col("words"), SMALL)
    assert not nothing.contexts.any()


def test_partitions_grow_with_the_words(spark, model, monkeypatch):
    """2,400 words in partitions of 300 or less on average, where there were three; the work of one doesn't grow."""
    _, docs, _ = model
    found = []
    monkeypatch.setattr(W, "PART_WORDS", 300)
    monkeypatch.setattr(W, "cut", lambda df, cut=W.cut: found.append(cut(df)) or found[-1])
    W.train(docs.limit(300), "id", F.col("words"), W.Settings(size=4, buckets=256, contexts=128, rounds=1, parts=3))
    assert found[0].rdd.getNumPartitions() == 8


def test_steps_add_slopes_of_a_row_once():
    """Rows that come once and often, against a plain sum."""
    r = np.random.default_rng(4)
    s = W.Settings(size=3, buckets=9, contexts=5, rate=0.5)
    parts = r.normal(size=(9, 3))
    tables = W.Tables(parts, r.normal(size=(5, 3)), s)
    rows, of, slopes = np.array([4, 1, 4, 7, 4, 1]), np.array([0, 1, 2, 0, 1, 2]), r.normal(size=(3, 3))
    tables._move(0, rows, of, slopes)
    for row in range(9):
        total = slopes[of[rows == row]].sum(0)
        step = (total**2).mean()
        assert np.allclose(tables.parts[row], parts[row] - 0.5 * total / np.sqrt(step + 1e-8)) and np.isclose(tables.steps[0][row], step)


def test_parts_are_read_once_a_word():
    """Not once for each of the eight pairs that a word is in."""

    class Counted(np.ndarray):
        n = 0

        def take(self, rows, axis):
            Counted.n += len(rows)
            return np.asarray(self).take(rows, axis)

    s = W.Settings(size=4, buckets=512, contexts=64)
    tables = W.Tables(np.full((512, 4), 0.1, np.float32), np.zeros((64, 4), np.float32), s)
    text = [f"word{k % 50}" for k in range(640)]
    tables.parts = tables.parts.view(Counted)
    tables.train([text[:400], text[400:], ["alone"]], np.random.default_rng(0))
    assert 0 < Counted.n <= sum(len(W.parts_of(w, s)) for w in text)


def test_windows_end_with_their_text():
    """Pairs of a text in runs that begin and end within texts; contexts beyond a text's ends don't move."""
    s = W.Settings(size=4, buckets=4096, contexts=4096, window=2, negatives=0, batch=12)
    tables = W.Tables(np.full((4096, 4), 0.1, np.float32), np.zeros((4096, 4), np.float32), s)
    texts = [["a", "b"], ["alone"], [f"w{k}" for k in range(7)], ["other"], ["x", "x"]]
    got = []
    slopes = tables._slopes
    tables._slopes = lambda *x: got.append((x[2] * x[3]).sum()) or slopes(*x)
    tables.train(texts, np.random.default_rng(0))
    assert sum(got) == 2 + (7 - 1) * 2 + (7 - 2) * 2 + 2
    at = dict(zip((w for t in texts for w in t), tables.number([w for t in texts for w in t])))
    moved = tables.steps[1][tables._of_context] > 0
    assert not moved[at["alone"]] and not moved[at["other"]] and moved[at["b"]] and moved[at["w6"]]
