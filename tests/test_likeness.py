"""The similarity join against all pairs, and connected components against union by hand."""

import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from oracle import check, connect
from pyspark.sql import functions as F
from test_growth import n_exchanged

from quillstone.operators import components as components_of
from quillstone.operators import likeness
from quillstone.operators.components import components, tallied
from quillstone.plans import registry

SMALL = "/root/testdata/sf0.001"
QUERIES = ("title_links", "title_links_wide", "title_groups")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, above[j] + 1, above[j - 1] + (x != y)))
    return row[-1]


def titles(seed, n, alphabet="abcde "):
    """Strings of 1 to 60 characters, most of them changed copies of others."""
    r = random.Random(seed)
    out = ["a", "ab", "abc", "aaaaaaaaaa", "aaaaaaaaaaaa", "ababababab"]
    while len(out) < n:
        if r.random() < 0.35:
            out.append("".join(r.choice(alphabet) for _ in range(r.randint(1, 60))))
            continue
        t = list(r.choice(out))
        for _ in range(r.randint(1, 1 + len(t) // 5)):
            k, kind = r.randrange(len(t) + 1), r.random()
            if kind < 0.4:
                t.insert(k, r.choice(alphabet))
            elif kind < 0.7 and t:
                del t[min(k, len(t) - 1)]
            elif t:
                t[min(k, len(t) - 1)] = r.choice(alphabet)
        out.append("".join(t))
    return sorted(set(out) - {""})


@pytest.mark.parametrize("least", [0.5, 0.7, 0.85, 1.0])
def test_levenshtein_join_is_all_pairs(spark, least):
    rows = list(enumerate(titles(int(least * 100), 220)))
    got = {(x["a"], x["b"]): x["ratio"] for x in likeness.similar_strings(spark.createDataFrame(rows, "id long, t string"), least).collect()}
    want = {}
    for i, x in rows:
        for j, y in rows[i + 1 :]:
            ratio = round(1 - edits(x, y) / max(len(x), len(y)), 6)
            if ratio >= least:
                want[(i, j)] = ratio
    assert got == want
    assert least > 0.9 or len(want) > 20


@pytest.mark.parametrize("least", [0.6, 0.85])
def test_sequence_join_is_all_pairs(spark, least):
    rows = list(enumerate(titles(7, 200)))
    got = {(x["a"], x["b"]) for x in likeness.similar_strings(spark.createDataFrame(rows, "id long, t string"), least, "sequence").collect()}
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    want = {(i, j) for i, x in rows for j, y in rows[i + 1 :] if ratio(x, y) >= least or ratio(y, x) >= least}
    assert got == want and len(want) > 20


def test_candidates_are_few(spark):
    """4 times the titles give about 4 times the candidates, far from all pairs."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(4000)]
    make = lambda n: [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(4, 9)))) for k in range(n)]
    few, many = (likeness.candidates(spark.createDataFrame(make(n), "id long, t string"), 0.85).count() for n in (500, 2000))
    assert many < 8 * max(few, 100) and many < 2000 * 1999 / 2 / 50


def test_blocks_empty_strings_and_nothing(spark):
    rows = [(1, "same title here", "x"), (2, "same title hers", "x"), (3, "same title here", "y"), (4, "", "x"), (5, "same title herd", None)]
    frame = spark.createDataFrame(rows, "id long, t string, by string")
    assert [tuple(x)[:2] for x in likeness.similar_strings(frame, 0.8, block=["by"]).collect()] == [(1, 2)]
    assert likeness.similar_strings(frame.limit(0), 0.8).count() == 0
    strings, members = likeness.classes(frame, frame["t"])
    assert sorted(x[0] for x in strings.select("id").collect()) == [1, 2, 5]
    assert sorted(map(tuple, members.collect())) == [(1, 1), (2, 2), (3, 1), (5, 5)]


def test_components_equal_union_by_hand(spark):
    r = random.Random(2)
    links = [(k, k + 1) for k in range(100, 180)] + [(k, 0) for k in range(1, 60)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)] + [(7, 7), (100, 101), (101, 100)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x["id"]: x["component"] for x in components(spark.range(400), spark.createDataFrame(links, "a long, b long")).collect()}
    least = {}
    for k in range(400):
        least.setdefault(root(k), k)
    assert got == {k: least[root(k)] for k in range(400)}
    assert components(spark.range(3), spark.createDataFrame([], "a long, b long")).count() == 3


@pytest.mark.parametrize("name", QUERIES)
def test_title_queries_over_more_rows(spark, name):
    folder = "/root/testdata/sf0.01"
    found = registry.all_queries()[name]
    got, want = check(found.run(spark, folder), connect(folder), found.sql)
    assert got == want and got


@pytest.mark.parametrize("chunk, tasks, least", [(16, 5, 0.7), (1 << 14, 3, 0.55)])
def test_cells_are_all_pairs(spark, monkeypatch, chunk, tasks, least):
    """Several groups and slices, strings beyond a word of 64 bits on either side or both, any characters, ids as strings."""
    for name, value in (("CHUNK", chunk), ("TASKS", tasks)):
        monkeypatch.setattr(likeness, name, value)
    r = random.Random(5)
    long = ["".join(r.choice("ab漢😀 ") for _ in range(n)) for n in (60, 63, 64, 65, 70, 90, 130, 300)]
    texts = sorted({*titles(3, 60), *long, *(t[:k] + "x" + t[k + 2 :] for t in long for k in (0, 5, len(t) // 2)), *(t[: len(t) - 6] for t in long)})
    rows = [(f"n{k}", t) for k, t in enumerate(texts)]
    got = {(x["a"], x["b"]): x["ratio"] for x in likeness.similar_strings(spark.createDataFrame(rows, "id string, t string"), least).collect()}
    want = {}
    for k, (i, x) in enumerate(rows):
        for j, y in rows[k + 1 :]:
            ratio = round(1 - edits(x, y) / max(len(x), len(y)), 6)
            if ratio >= least:
                want[min(i, j), max(i, j)] = ratio
    assert got == want
    assert {len(x) > 64 for x in long} == {True, False} and len(want) > 50


def test_pairs_that_share_common_grams_are_not_shuffled(spark):
    """Titles of 20 syllables, all of one length: nearly every pair has as many grams in common as it must."""
    r = random.Random(6)
    parts = [a + b for a in "thrnd" for b in "aeio"]
    rows = [(k, "".join(r.choice(parts) for _ in range(20))) for k in range(600)]
    frame = spark.createDataFrame(rows, "id long, t string")

    def alike():
        return likeness.similar_strings(frame, 0.7).count()

    _, moved = n_exchanged(spark, alike)
    assert moved < 600 * likeness.TASKS * 2 + 1000
    assert moved < 600 * 599 // 2


def test_segments_are_looked_for_at_lengths_that_are_there(spark):
    """Titles cut at 60 characters have no partner of 61 to 70, for which most segments were looked up."""
    r = random.Random(8)
    rows = [(k, "".join(r.choice("abcdefghijklmnop ") for _ in range(60))) for k in range(200)]
    rows += [(k + 200, "zz" + t[2:]) for k, t in rows[:20]]

    def alike():
        return likeness.candidates(spark.createDataFrame(rows, "id long, t string"), 0.85).count()

    got, moved = n_exchanged(spark, alike)
    assert got >= 20 and moved < 220 * 100


@pytest.mark.parametrize("kind", ["long", "string"])
def test_tallies_of_links_in_parts(spark, kind):
    """Batches of few links, pairs that come twice, links of an id to itself, long chains, and tallies begun anew."""
    r = random.Random(9)
    links = [(k + 1, k) for k in range(100, 160)] + [(k, 0) for k in range(1, 40)] + [(r.randrange(200, 320), r.randrange(200, 320)) for _ in range(90)] + [(7, 7), (100, 101), (101, 100)]
    r.shuffle(links)
    frame = spark.createDataFrame(links, "a long, b long").select(*(F.col(x).cast(kind) for x in "ab")).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = tallied(frame).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    of = int if kind == "long" else str
    n = {}
    for x in (x for pair in links for x in pair):
        n[of(x)] = n.get(of(x), 0) + 1
    sums = {}
    for x in got:
        sums[x["id"]] = sums.get(x["id"], 0) + x["n"]
    assert sums == n and len(got) <= 3 * len(n)
    ids = spark.createDataFrame([(x,) for x in n], f"id {kind}")
    same = lambda df: sorted(map(tuple, components(ids, df).collect()))
    leads = spark.createDataFrame([(x["id"], x["leads"]) for x in got], f"a {kind}, b {kind}")
    assert same(leads) == same(frame)
    assert tallied(frame.limit(0)).count() == 0


def test_tallies_are_handed_on(monkeypatch):
    monkeypatch.setattr(components_of, "MOST_IDS", 10)
    batches = [pa.RecordBatch.from_pydict({"a": [k, k], "b": [k + 1, k + 2]}) for k in range(0, 60, 2)]
    got = list(components_of._tally(iter(batches)))
    assert len(got) > 4 and max(map(len, got)) <= 13 and sum(sum(x["n"].to_pylist()) for x in got) == 120


def test_a_cell_hands_its_pairs_on(monkeypatch):
    """Titles that are all alike have as many links as pairs: they are not held until the cell is done."""
    monkeypatch.setattr(likeness, "HELD", 100)
    texts = [f"{'same title but for its end ' * times} {k:03d}" for times in (2, 4) for k in range(60)]
    n = len(texts)
    table = pa.table({"id": [*range(n)] * 2, "t": texts * 2, "i": [0] * 2 * n, "j": [0] * 2 * n, "left": [True] * n + [False] * n})
    got = list(likeness._cell(likeness.Bounds(0.7, "levenshtein"), table))
    assert max(map(len, got)) <= 100 + n
    pairs = [p for x in got for p in zip(x["a"].to_pylist(), x["b"].to_pylist())]
    assert sorted(pairs) == [(i, j) for i in range(n) for j in range(i + 1, n) if (i < 60) == (j < 60)]


def test_links_of_titles_that_are_all_alike_are_not_written(spark, tmp_path, monkeypatch):
    """500 titles, each like all others: 124,750 links, of which none is shuffled or cut."""
    monkeypatch.setattr(likeness, "TASKS", 4)
    rows = [(k, f"<title>one title in many forms of which this is {k}</title>") for k in range(500)]
    spark.createDataFrame([*rows, (500, rows[3][1]), (501, "<title>another</title>"), (502, "<p>none</p>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))

    def groups():
        return sorted(map(tuple, registry.all_queries()["title_groups"].run(spark, str(tmp_path)).select("page_id", "class_id", "group_id", "n_links").collect()))

    got, moved = n_exchanged(spark, groups)
    assert got == [*((k, k, 0, 499) for k in range(500)), (500, 3, 0, 499), (501, 501, 501, 0)]
    assert moved < 20_000


def test_characters_are_counted_by_place(monkeypatch):
    """Titles of the same letters in any order: as whole strings all have enough in common, but few have before and behind a place."""
    r = random.Random(11)
    letters = list("abcdefghijklmnopqrst" * 3)
    texts = ["".join(r.sample(letters, 60)) for _ in range(150)]
    texts += [t[k:] + t[:k] for k, t in enumerate(texts[:12], 1)] + [t[: 60 - 2 * k] for k, t in enumerate(texts[12:20], 1)]
    measured = []
    distances = likeness._distances
    monkeypatch.setattr(likeness, "_distances", lambda masks, m, chars, length: measured.append(len(length)) or distances(masks, m, chars, length))
    n = len(texts)
    table = pa.table({"id": [*range(n)] * 2, "t": texts * 2, "i": [0] * 2 * n, "j": [0] * 2 * n, "left": [True] * n + [False] * n})
    got = [p for x in likeness._cell(likeness.Bounds(0.7, "levenshtein"), table) for p in zip(x["a"].to_pylist(), x["b"].to_pylist())]
    assert sorted(got) == [(i, j) for i in range(n) for j in range(i + 1, n) if edits(texts[i], texts[j]) <= 0.3 * max(len(texts[i]), len(texts[j]))]
    assert len(got) > 15 and sum(measured) < n * (n - 1) // 2 // 2
