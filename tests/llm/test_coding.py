"""Token alignment, conversation trie and byte-pair coding against brute force and the libraries themselves."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm import bpe_coding, prefix_trie, queries, token_align
from quillstone.llm.common import cut
from quillstone.llm.packing import default_tokenizer

SMALL = "/root/testdata/sf0.001"
EXTRA = ", digest string, at string, side string, ids string, node string, n string, id string, kind string, b_conv string"


def wide(spark, rows, schema):
    """The rows with further columns of names that the operators use themselves."""
    return spark.createDataFrame([(*r, *"abcdefghi") for r in rows], schema + EXTRA)


def letters(r, n, alphabet="abcdefgh"):
    return "".join(r.choice(alphabet) for _ in range(n))


# Byte-pair coding


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    odd = [None, "", "a", "  ", "Hello WORLD it's 12 o'clock", letters(r, 3000), letters(r, 300) + " " + letters(r, 700) + "\n" + "x " * 300]
    odd += ["é" * 900 + "漢字かな" * 200 + "<|endoftext|>" + letters(r, 600) + "<|startoftext|>", "漢" * 1000, " ".join(letters(r, 9) for _ in range(500)), "ΑΣ " * 200 + "İ" * 300, letters(r, 2000) + " "]
    rows = list(enumerate(odd))
    return [*rows, (5, odd[5]), (5, odd[6]), (None, odd[7]), (None, odd[7])]


def test_joined_halves_are_the_whole():
    r = random.Random(1)
    coder, library = bpe_coding.piece_coder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    for _ in range(150):
        word, leaf = letters(r, r.randint(10, 900), r.choice(["ab", "a", "aeinrst", "thenofi", "abcdefgh"])), r.choice([1, 3, 7, 50])
        nodes = [coder.encode(word[k : k + leaf], k + leaf >= len(word)) for k in range(0, len(word), leaf)]
        while len(nodes) > 1:
            nodes = [coder.join(nodes[k], nodes[k + 1], k + 2 >= len(nodes), window=r.choice([1, 8])) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
        assert nodes[0].tolist() == library.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf, fan", [(64, 3), (bpe_coding.LEAF, bpe_coding.FAN)])
def test_coding_equals_the_library(spark, texts, leaf, fan):
    library = Tokenizer.from_file(default_tokenizer())

    def whole(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return ids, library.decode(ids, skip_special_tokens=False), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()

    coded = bpe_coding.encode(wide(spark, texts, "doc_id long, text string"), leaf=leaf, fan=fan)
    got = coded.select("doc_id", "ids", bpe_coding.decoded().alias("text"), bpe_coding.ids_sha256().alias("sha")).collect()
    assert sorted(str(tuple(x)) for x in got) == sorted(str((i, *whole(t))) for i, t in texts)
    assert bpe_coding.encode(wide(spark, [], "doc_id long, text string")).count() == 0


def test_coding_of_one_text_of_twenty_megabytes(spark):
    r = np.random.default_rng(3)
    many = " ".join(np.array([letters(random.Random(k), 7) for k in range(5000)])[r.integers(0, 5000, 1_800_000)])
    unsplit = letters(random.Random(9), 6_000_000, "aeinrstlo")
    docs = spark.createDataFrame([(1, many + " " + unsplit), (2, "x")], "doc_id long, text string")
    got = {x[0]: x[1] for x in bpe_coding.encode(docs).collect()}
    library = Tokenizer.from_file(default_tokenizer())
    assert got[2] == library.encode("x", add_special_tokens=False).ids
    assert got[1] == library.encode(many, add_special_tokens=False).ids + library.encode(unsplit, add_special_tokens=False).ids


# Token alignment


def aligned_by_hand(rows):
    a_side, b_side = token_align.ByteLevel(token_align.byte_level_path()), token_align.Pieces(token_align.piece_path())
    docs = []
    for i, text in rows:
        a, b = (a_side.encode([" " + text])[0], b_side._library.encode(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_side.spelt[k] for k in a) != whole or b"".join(b_side.spelt[k] for k in b) != whole:
            docs.append((i, []))
            continue
        groups, own, at, k = [], ([], []), [0, 0], [0, 0]
        while k[0] < len(a) or k[1] < len(b):
            side = 0 if at[0] <= at[1] and k[0] < len(a) else 1
            token = (a, b)[side][k[side]]
            at[side] += len((a_side, b_side)[side].spelt[token])
            own[side].append(token)
            k[side] += 1
            if at[0] == at[1] and own[0] and own[1]:
                groups.append(own)
                own = ([], [])
        docs.append((i, groups))
    counts = Counter()
    for _, groups in docs:
        counts.update({(x, y) for p, q in groups for x in p for y in q})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups in docs:
        links = [(x, y) for p, q in groups for x in p for y in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), text))
    return sorted(out, key=lambda x: (str(x[0]), x[-1]))


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(2)
    vocabulary = ["the", "thing", "Straße", "漢字かな", "naïve", "it's", "12345", "🙂🙂", "a b", "x" * 50, "foo.bar()", "　", " ", " ", "<s>", "<|endoftext|>", "<0x0A>"]
    texts = [None, "", "a", " ", "  a  b ", "a ", "\n", "a\n b\n\n  c\t d", "▁x", "a\x00b", "é café", " ".join(r.choice(vocabulary) for _ in range(300)), "漢" * 900, "x" * 3000, "\r\n \r\n", "ab" * 2000 + " " + "🙂" * 800]
    texts += ["".join(r.choice([" ", "  ", "\n", "\t", " ", "."]) if r.random() < 0.4 else r.choice(vocabulary) for _ in range(r.randint(1, 120))) for _ in range(30)]
    return [*enumerate(texts), (11, texts[11]), (11, texts[11]), (None, texts[12]), (3, texts[7])]


@pytest.mark.parametrize("run, most", [(token_align.RUN, token_align.MOST_PAIRS), (40, 10)])
def test_alignment_equals_brute_force(spark, odd_texts, run, most):
    docs = wide(spark, odd_texts, "doc_id long, text string")
    found = token_align.scored(cut(token_align.align(docs, run=run)), most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert sorted((tuple(x) for x in found.collect()), key=lambda x: (str(x[0]), x[-1])) == aligned_by_hand(odd_texts)
    assert token_align.scored(cut(token_align.align(docs.limit(0)))).count() == 0


def test_alignment_query_equals_brute_force(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((*x[:7], hashlib.sha256(x[7].encode()).hexdigest() if x[7] else "") for x in aligned_by_hand(rows))
    got = queries.op11_token_alignment(spark, SMALL).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(tuple(x) for x in got.collect()) == want


def test_sweep_holds_little_and_groups_of_any_size(monkeypatch):
    """Swept after every run, with no group listed one by one, the machine gives the same, and forgets what is closed."""
    r = np.random.default_rng(1)
    sizes = (np.array([1, 2, 3]), np.array([1, 2, 4]))

    def tokens(sizes, total):
        out, at = [], 0
        while at < total:
            k = int(r.integers(0, 3))
            if at + sizes[k] <= total:
                out.append(k)
                at += sizes[k]
        return np.array(out)

    docs = [(tokens(sizes[0], n), tokens(sizes[1], n)) for n in (1, 7, 400, 5000, 30)]

    def swept(step, every):
        machine, out, most = token_align.Sweep(sizes), [], 0
        for k, doc in enumerate(docs):
            at = max(len(doc[0]), len(doc[1]))
            for a in range(0, at, step):
                for side in (0, 1):
                    if every:
                        out += machine.flush(False)
                        most = max(most, machine.held)
                    if len(doc[side][a : a + step]) or a == 0:
                        machine.read((k, ""), a, side, 1, False, doc[side][a : a + step])
        return [(*x[:7], *(y.tolist() for y in x[7])) for x in [*out, *machine.flush(True)]], most

    whole, _ = swept(10_000, False)
    monkeypatch.setattr(token_align, "LISTED", 0)
    assert swept(10_000, False)[0] == whole
    found, most = swept(50, True)
    assert found == whole and most < 2500
    assert [x[2] for x in whole] == [len(a) for a, _ in docs] and sum(len(x[6].split(b";")) for x in whole) == sum(x[4] for x in whole)


# Conversation trie


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in children[p])
    return sorted((min(m), len(p), str(min(members[p[:-1]]) if p else None), len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def trie_rows(nodes, ends):
    none = F.lit(hashlib.sha256(b"").hexdigest())
    rows = nodes.join(prefix_trie.end_digests(ends), ["conv_id", "depth"], "left").select(*prefix_trie._NODE, F.coalesce("ends_sha256", none))
    return sorted((x[0], x[1], str(x[2]), *x[3:]) for x in rows.collect())


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talks():
    r = random.Random(3)
    rows = []
    for c in [*range(60), *range(200, 230), 305, -7, -100]:
        for t in range(r.choice([1, 2, 3, 5, 8, 12])):
            rows.append((c, r.choice([0, 0, None]) if t == 0 else t, r.choice(["user", None]) if r.random() < 0.3 else "assistant", r.choice(["a", "b", "hello", None, "é漢"])))
    rows += [(7, 1, "user", "dup")] * 3 + [(None, 1, "user", "x")]
    rows += [(c, t, "user", "same") for c in (900, 901, 902) for t in range(40)] + [(903, t, "user", str(t)) for t in range(50)]
    return rows


@pytest.mark.parametrize("local", [prefix_trie.LOCAL, 3])
def test_trie_equals_brute_force(spark, talks, local):
    assert trie_rows(*prefix_trie.build(wide(spark, talks, SCHEMA), local)) == trie_by_hand(talks)


def test_trie_of_little(spark):
    one = [(5, 0, None, None)]
    assert trie_rows(*prefix_trie.build(wide(spark, one, SCHEMA))) == trie_by_hand(one)
    assert trie_rows(*prefix_trie.build(wide(spark, [], SCHEMA))) == []


def test_trie_query_equals_brute_force(spark):
    rows = [tuple(x) for x in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_conversation_trie(spark, SMALL).select(*prefix_trie._NODE, "ends_sha256")
    assert sorted((x[0], x[1], str(x[2]), *x[3:]) for x in got.collect()) == trie_by_hand(rows)


def test_turns_of_a_long_conversation_are_numbered_across_tasks(spark):
    rows = [(1, t, "user", f"{t}") for t in range(2000)] + [(2, 0, "user", "z")]
    got = prefix_trie.turns(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert sorted(x[0] for x in got.filter("conv_id = 1").select("pos").collect()) == list(range(1, 2001))
    assert got.filter("conv_id = 1").select("pos", F.col("points")).filter("points != length(cast(pos - 1 as string))").count() == 0
