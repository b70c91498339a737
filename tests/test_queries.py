"""Every query with SQL gives DuckDB's rows; the others give rows."""

import pytest
from oracle import check, connect

from quillstone.plans import registry, texts

SMALL = "/root/testdata/sf0.001"
ALL = registry.all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(n for n, q in ALL.items() if q.sql))
def test_same_rows_as_sql(spark, con, name):
    got, want = check(ALL[name].run(spark, SMALL), con, ALL[name].sql)
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n, q in ALL.items() if not q.sql))
def test_gives_rows(spark, name):
    assert ALL[name].run(spark, SMALL).count() > 0


def test_no_quadratic_plans(spark):
    for name in ("dup_pairs", "dedup_plan", "full_details", "gaps_sql_any", "lang_id"):
        plan = ALL[name].run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan, name


def test_labelled_lines_of_whole_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    want = {i: (text.replace("\n", " "), lang) for i, text, lang in docs.collect()}
    assert any("," in text[40:] for text, _ in want.values())
    assert {r["doc_id"]: (r["sentence"], r["lang"]) for r in texts._parted(docs).collect()} == want


def test_hmm_counts_every_word(spark, tmp_path):
    """7,000 pairs of role and word in training; the rarer role's words tell it only if none is left out."""
    word = lambda role, i: role + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    train = [("a", i) for i in range(4000)] * 2 + [("b", i) for i in range(3000)]
    test = [("a", i) for i in range(4000)] + [("b", i) for i in range(3000)]
    rows = [(4 * k + 1, 0, role, word(role, i)) for k, (role, i) in enumerate(train)] + [(4 * k, 0, role, word(role, i)) for k, (role, i) in enumerate(test)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {tuple(r) for r in ALL["hmm_accuracy"].run(spark, str(tmp_path)).collect()}
    assert got == {("a", 4000, 1.0), ("b", 3000, 1.0)}
