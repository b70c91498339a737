"""Every operator and pipeline stage on odd tables: nulls everywhere, repeats, ties, clashing columns, nothing, one very long text."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import common, exact_dedup, langid, license_scan, mixing, near_dedup, packing, quality, suffix_dedup, token_hist, toxicity

#: Names that operators might give to columns of their own.
CLASHING = "row id sha sha2 points ties n copy copies key keep keep_id rate size source_size bucket band component rep h found __id __sha __sha2 __keep __points __ties __n __source __rate __copy __copies __row __shard".split()


def sentence(k, n=60):
    r = np.random.default_rng(k)
    return " ".join("".join(r.choice(list("abcdefgh"), r.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls in every column, repeats, ties and clashing names."""
    rows = [(1, sentence(1), "en", "a"), (1, sentence(1), "en", "a"), (1, sentence(2), "en", "b"), (2, sentence(1), None, None), (None, sentence(3), "en", "a"), (None, sentence(3), "en", "a"), (3, None, "en", "a"), (4, "", "en", None), (5, " \t\n", None, "b"), (6, None, None, None), (7, "a" * 5000, "en", "b"), (8, sentence(5), "en", "a"), (9, sentence(5) + " ", "en", "a"), (None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, None, *[f"{k}"] * len(CLASHING)) for k, r in enumerate(rows)], schema)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, 1, 1), (2, 1, 0), (2, 1, 0), (None, None, None), (8, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plain(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, odd, folder, stage):
    got = stage(spark, odd, folder)
    last = stage is corpus_pipeline.STAGES[-1][1]
    if not last:
        assert got.columns == odd.columns and set(plain(got)) <= set(plain(odd))
    assert got.count() > 0
    nothing = stage(spark, odd.limit(0), folder)
    assert nothing.columns == got.columns and nothing.count() == 0


def test_which_rows_stages_keep(spark, odd, folder):
    ids = lambda df: sorted(map(str, [r["key"] for r in df.collect()]))  # noqa: E731  the number of the row
    assert len(ids(corpus_pipeline.drop_exact_copies(spark, odd, folder))) == 6  # three sentences, one of them with a space, the empty ones, the long word
    near = corpus_pipeline.drop_near_copies(spark, odd, folder)
    assert near.filter("doc_id IS NULL").count() == 3 and near.filter("doc_id = 1").count() == 1
    assert sorted(r[0] for r in near.filter("doc_id IS NOT NULL").select("doc_id").collect())[:3] in ([1, 3, 4], [1, 2, 3])
    assert corpus_pipeline.reject_toxic(spark, odd, folder).filter("text IS NULL").count() == 3


def test_operators_on_odd_tables(spark, odd):
    n = odd.count()
    assert quality.judge(odd).count() == n and quality.keep_good(odd).columns == odd.columns
    assert exact_dedup.exact_groups(odd).count() == n and near_dedup.near_groups(odd).count() == n
    assert suffix_dedup.removals(odd).count() == n and mixing.mixture(odd).count() == n
    assert langid.predict(odd, langid.fit(odd)).count() == n
    assert packing.pack_documents(odd).filter("piece = 0").count() == n
    assert token_hist.length_table(odd).agg(F.sum("n_docs")).first()[0] == n
    assert license_scan.scan(odd).count() == 0
    empty = odd.limit(0)
    for df in (quality.keep_good(empty), license_scan.scan(empty), langid.predict(empty, langid.fit(empty)), suffix_dedup.removals(empty), exact_dedup.drop_copies(empty), near_dedup.drop_near(empty)):
        assert df.count() == 0


def test_one_text_of_twenty_megabytes(spark):
    r = np.random.default_rng(4)
    vocabulary = np.array(["".join(r.choice(list("abcdefghij"), r.integers(2, 9))) for _ in range(20_000)])
    text = " ".join(vocabulary[r.integers(0, len(vocabulary), 3_400_000)])
    assert len(text) > 20_000_000
    short = sentence(9)
    docs = spark.createDataFrame([(1, text, "en", "a"), (2, short, "en", "b"), (3, text + " z", "en", "a")], "doc_id long, text string, lang string, source string")
    judged = {x["doc_id"]: x["n_words"] for x in quality.judge(docs).collect()}
    assert judged == {1: 3_400_000, 2: 60, 3: 3_400_001}
    assert {x["doc_id"]: x["component_id"] for x in near_dedup.near_groups(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert {x["doc_id"]: x["n_removed"] for x in suffix_dedup.removals(docs).collect()} == {1: 0, 2: 0, 3: len(text)}
    assert exact_dedup.drop_copies(docs).count() == 3
    assert sorted(x["taken"] % x["size"] for x in mixing.mixture(docs).collect()) == [0, 0, 0]
    pieces = packing.pack_documents(docs.filter("doc_id < 3"))
    assert pieces.filter("doc_id = 1").agg(F.sum("length")).first()[0] > 3_400_000
    assert license_scan.scan(docs).count() == 0
    model = langid.fit(spark.createDataFrame([(k, sentence(k), "en") for k in range(20)], "doc_id long, text string, lang string"))
    assert {x["lang_pred"] for x in langid.predict(docs, model).collect()} == {"en"}
    assert toxicity.score(docs, toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), -1.0)).count() == 3


def test_shards_of_the_exact_index():
    """Merged shard by shard, or a bounded number of keys at a time, rows add up to the same groups."""
    schema = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("group_size", pa.int64()), ("points", pa.int64()), ("keep_id", pa.int64()), ("ties", pa.int64())])
    rows = [(bytes([k % 7] * 16), b"c", 1, k, k, 1) for k in range(50)]
    batch = lambda x, s: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*x), s)], schema=s)
    some = [tuple(r.values()) for b in exact_dedup._index(iter([batch(rows, schema)]), most=3) for r in b.to_pylist()]
    assert len(some) > 7 and sum(r[2] for r in some) == 50
    sharded = schema.append(pa.field("shard", pa.int64()))
    ordered = sorted([(*r, r[0][0] % 3) for r in some], key=lambda r: r[6])
    got = sorted(tuple(r.values()) for b in exact_dedup._index(iter([batch(ordered[:9], sharded), batch(ordered[9:], sharded)])) for r in b.to_pylist())
    assert got == sorted((bytes([k] * 16), b"c", len(range(k, 50, 7)), max(range(k, 50, 7)), max(range(k, 50, 7)), 1) for k in range(7))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        environment, master = {}, "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        common.prepare(Session)
