"""Tagging in chunks against a plain dynamic programme, and what counts are."""

import math
import random

import pytest
from oracle import check, connect

from quillstone.operators import tagging as G
from quillstone.plans import registry


def sentences(seed, n, longest):
    r = random.Random(seed)
    tags = ["DET", "NOUN", "VERB"]
    words = {"DET": ["the", "a", "run"], "NOUN": ["dog", "cat", "run", "walk"], "VERB": ["run", "walk", "is"]}
    out = []
    for k in range(n):
        tag = r.choice(tags)
        for p in range(r.randint(1, longest)):
            out.append((k, p, r.choice(words[tag]) if r.random() < 0.9 else f"w{r.randrange(30)}", tag))
            tag = r.choices(tags, [1, 5, 2] if tag == "DET" else [2, 2, 4])[0]
    return out


def plain(model, words):
    """The best path, as a textbook has it."""
    shown = {r["word"]: r["counts"] for r in model.shown.collect()}
    n = range(len(model.tags))
    out, back, score = [], [], None
    for w in words:
        c = shown.get(w, [0] * len(model.tags))
        e = [math.log((c[t] + 1) / model.whole[t]) for t in n]
        if score is None:
            score = [model.start[t] + e[t] for t in n]
            continue
        best = [max(n, key=lambda k: (score[k] + model.step[k][t], -k)) for t in n]
        back.append(best)
        score = [score[best[t]] + model.step[best[t]][t] + e[t] for t in n]
    k = max(n, key=lambda t: (score[t], -t))
    out = [k]
    for b in reversed(back):
        out.append(k := b[k])
    return [model.tags[k] for k in reversed(out)]


@pytest.mark.parametrize("chunk", [3, G.CHUNK])
def test_chunks_of_any_size_tag_alike(spark, chunk):
    train = spark.createDataFrame(sentences(1, 60, 20), "s long, p int, word string, tag string")
    model = G.count(train, ["s"], "p", "tag", "word")
    rows = sentences(2, 12, 40)
    test = spark.createDataFrame(rows, "s long, p int, word string, tag string")
    got = {}
    for r in G.tag(test, ["s"], "p", "word", model, chunk).orderBy("s", "p").collect():
        got.setdefault(r["s"], []).append(r["tagged"])
    want = {s: plain(model, [w for t, _, w, _ in rows if t == s]) for s, *_ in rows}
    assert got == want


def test_tagging_runs_in_the_engine_and_takes_odd_rows(spark):
    train = spark.createDataFrame(sentences(1, 20, 9), "s long, p int, word string, tag string")
    model = G.count(train, ["s"], "p", "tag", "word")
    odd = spark.createDataFrame([(1, 0, None), (1, 1, "dog"), (2, 0, "never seen")], "s long, p int, word string")
    tagged = G.tag(odd, ["s"], "p", "word", model)
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert tagged.columns == ["s", "p", "word", "tagged"] and tagged.filter("tagged IS NULL").count() == 0 and tagged.count() == 3
    assert G.tag(odd.limit(0), ["s"], "p", "word", model).count() == 0
    nothing = G.count(train.limit(0), ["s"], "p", "tag", "word")
    assert nothing.tags == [] and G.tag(odd, ["s"], "p", "word", nothing).filter("tagged IS NULL").count() == 3
    with pytest.raises(ValueError):
        G.tag(odd, ["s"], "p", "word", model, G.CHUNK + 1)


@pytest.mark.parametrize("name", ["hmm_words", "emissions_all"])
def test_word_queries(spark, name):
    found = registry.all_queries()[name]
    got, want = check(found.run(spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), found.sql)
    assert got == want and got
