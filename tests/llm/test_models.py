"""Short licences under every edit, and the language model on texts that it hasn't seen."""

import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import langid, license_scan

WORDS = re.compile(r"[0-9A-Za-z]+")
SHORT = [n for n, t in license_scan.TEMPLATES.items() if len(WORDS.findall(t)) < license_scan.SHORT]


@pytest.mark.parametrize("name", SHORT)
def test_edits_that_leave_enough_of_a_short_licence(spark, name):
    """All ways to put wrong words in place of up to a fifth of its own, to drop one and to add one."""
    words = WORDS.findall(license_scan.TEMPLATES[name])
    n = len(words)
    least = license_scan.COVERAGE * n
    edited = []
    for k in range(int(n - least + 1e-9) + 1):
        edited += [[f"zq{i}" if i in wrong else w for i, w in enumerate(words)] for wrong in itertools.combinations(range(n), k)]
    if n - 1 >= least:
        edited += [words[:i] + words[i + 1 :] for i in range(n)]
    edited += [words[:i] + ["zzz"] + words[i:] for i in range(1, n)]
    around = ["Some words before it", "and others behind, under the sun"]
    rows = [(k, f"{around[0]} {' '.join(e)} {around[1]}") for k, e in enumerate(edited)]
    rows += [(1000, f"{around[0]}. {' '.join(edited[1 % len(edited)])} {around[1]} {' '.join(words)} end")]  # two in one text
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), {name: license_scan.TEMPLATES[name]})
    got = [r["doc_id"] for r in found.select("doc_id").collect()]
    assert set(got) == {k for k, _ in rows} and got.count(1000) == 2


def test_pairs_alone_are_no_licence(spark):
    rows = [(1, "released under the moon, and the MIT was there"), (2, "the the the the under License the"), (3, "")]
    assert license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs)


def test_language_of_texts_held_out(docs, model):
    found = langid.predict(docs, model).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 2000 and right / n >= 0.98


def test_scores_are_those_of_a_plain_convolution(model):
    rng = np.random.default_rng(2)
    batch = rng.integers(32, 127, (5, langid.WINDOW)).astype(np.uint8)
    got = model.log_probs(batch, model.tables())
    for row, line in zip(batch, got):
        pooled = []
        for width, w, shift in zip(langid.WIDTHS, model.filters, model.shifts):
            e = model.embed[row]
            responses = [np.concatenate(e[i : i + width]) @ w + shift for i in range(langid.WINDOW - width + 1)]
            pooled.append(np.maximum(np.max(responses, 0), 0))
        z = np.concatenate(pooled) @ model.out + model.bias
        z -= z.max()
        assert np.allclose(line, z - np.log(np.exp(z).sum()), atol=1e-3)


def test_fitting_brings_windows_only(spark, monkeypatch):
    """Whatever the length of the texts, a few windows of each are all that is trained on."""
    seen = []
    monkeypatch.setattr(langid, "train", lambda shown: seen.extend(shown))
    text = "some long text " * 200_000
    langid.fit(spark.createDataFrame([(0, text, "en"), (3, "short", "de"), (6, None, "fr"), (2, text, None)], "doc_id long, text string, lang string"))
    assert all(w.shape == (min(len(w), langid.PER_DOCUMENT), langid.WINDOW) for w, _ in seen)
    assert sorted(lang for _, lang in seen) == sorted(x for i, x in ((0, "en"), (3, "de"), (6, "fr")) if zlib.crc32(str(i).encode()) % 3 != 1)
