"""Similarity join of short strings over an inverted index, then the measure itself.

Equal strings are one class, and classes are joined, so copies aren't compared with each other. Of two strings alike enough, the
longer of length L, at most k * L edits lead from one to the other.

Where k is small, segments serve: the longer string is cut into one segment more than there are edits, so one of them
stands in the other string unchanged, and nearly in its place; segment, its number and L are the key.

Else rare q-grams do: each edit spoils q grams at most. So at least c = L - q + 1 - q * k * L grams stand in both, near the
same place and in the same order. All but the c - m most frequent grams of each string therefore hold m that meet, and only
those are indexed; a pair must meet m times. Long strings use longer grams.

With many edits strings of one language share most grams, and an index would write out a good part of all pairs. Without
blocks to join within, such strings are dealt to the cells of a triangle instead, and a task compares those of its cell
where they are: a pair must have enough characters in common, and is then measured by bit vectors. Only pairs that are
alike leave the task.

Characters are counted before and behind a place p, the same in both strings, and so are those in common, C1 and C2. Of a best
alignment the first p characters of one string meet p + s of the other, s >= 0 for one of the two ways round. That takes
p + s - (C1 + s) edits at least, and the rest takes its own length less C2. So there are at least as many edits as the shorter
string is long, less C1 and C2, wherever p lies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillstone.operators.lineage import cut, prepare

#: Different q-grams whose frequencies are broadcast.
MOST_GRAMS = 1 << 18
#: Grams of length q serve if at least this share of a string's grams must meet; of those that must, the share counted.
LEAST_SHARE, COUNTED = 0.35, 0.5
#: Segments serve up to this many edits a character: they are then of five characters or more, but in short strings.
MOST_EDITS = 0.2
#: Strings are dealt to groups of CHUNK, or to SIDES groups of up to MOST_SIDE. A cell of two groups is cut along one of them
#: until there are TASKS; strings are compared with CHUNK at a time. Strings of up to WORD characters are measured by bit vectors.
CHUNK, SIDES, MOST_SIDE, TASKS, WORD = 1 << 14, 14, 1 << 16, 96, 64
#: A cell hands its pairs on once it holds so many, or so many characters of texts beside them.
HELD = 1 << 16
#: Places at which strings are cut to count their characters, in twelfths of a usual length: the first looks at all pairs, each
#: further one at those left.
PLACES = (6, 3, 9, 4, 8, 2, 10)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    return F.round(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)), 6)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of the two strings; the order of the two matters."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def shared_characters(a: Column, b: Column) -> Column:
    """How many characters two maps of character to times have in common; no alignment matches more."""
    times = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    return F.aggregate(F.map_keys(a), F.lit(0), lambda n, k: n + F.least(times(a, k), times(b, k)))


def character_counts(c: Column) -> Column:
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda x: F.struct(x, F.size(F.filter(chars, lambda y: y == x)))))


class Bounds:
    """What a least ratio says of edits, lengths and grams in common."""

    def __init__(self, least: float, ratio: str) -> None:
        if not 0 < least <= 1:
            raise ValueError("the least ratio lies above 0 and is at most 1")
        self.least, self.sequence = least, ratio != "levenshtein"
        # A ratio as rounded to six places may be a little less than it says.
        exact = max(least - 1e-6, 1e-9)
        self.narrow = exact / (2 - exact) if self.sequence else exact  # least share of the longer length that the shorter has
        self.edits = 2 * (1 - exact) if self.sequence else 1 - exact  # of the longer length, at most
        self.from_length = {1: 1}
        for q in range(2, 7):
            share = 1 - q * self.edits
            if share >= LEAST_SHARE:
                self.from_length[q] = math.ceil((q + 1) / share)

    def gram(self, length: Column) -> Column:
        """The q of a pair whose longer string has this length."""
        q = F.lit(1)
        for k in sorted(self.from_length)[1:]:
            q = F.when(length >= self.from_length[k], k).otherwise(q)
        return q

    def meets(self, q: int | None, longer: Column) -> Column:
        """How many indexed grams of a pair must meet, the longer string being so long."""
        if q is None:
            m = self.meets(1, longer)
            for k in sorted(self.from_length)[1:]:
                m = F.when(longer >= self.from_length[k], self.meets(k, longer)).otherwise(m)
            return m
        return F.greatest(F.floor(COUNTED * self._common(q, longer) + 1e-9), F.lit(1))

    def _common(self, q: int, longer: Column) -> Column:
        """How many grams must meet in all; what is left out, this less the counted ones, grows with the length."""
        return F.greatest(F.ceil((longer * self.narrow if q == 1 else longer - q + 1 - q * self.edits * longer) - 1e-9), F.lit(1))

    def prefix(self, q: int, length: Column) -> Column:
        """How many of a string's q-grams, rarest first, are indexed; null where no partner uses q."""
        first = self.from_length[q]
        longer = F.greatest(length, F.lit(first)).cast("double")
        later = [self.from_length[k] for k in self.from_length if k > q]
        reach = F.floor(length / self.narrow + 1e-9)
        use = (reach >= first) if not later else (reach >= first) & (length < min(later))
        return F.when(use & (length >= q), length - q + 1 - self._common(q, longer) + self.meets(q, longer))


def _positions(strings: DataFrame, block: Sequence[str], bounds: Bounds) -> DataFrame:
    """(id, block, t, length, q, gram, pos) of the indexed grams."""
    rows = strings.withColumn("length", F.length("t"))
    every = None
    for q in bounds.from_length:
        own = rows.withColumn("keep", bounds.prefix(q, F.col("length"))).filter("keep > 0")
        grams = F.transform(F.sequence(F.lit(1), F.col("length") - (q - 1)), lambda i: F.struct(i.cast("int").alias("pos"), F.substring(F.col("t"), i, F.lit(q)).alias("gram")))
        own = own.select("id", *block, "length", "keep", F.lit(q).alias("q"), F.inline(grams))
        every = own if every is None else every.unionByName(own)
    counts = cut(every.groupBy("q", "gram").agg(F.count("*").alias("n")))
    found = every.join(F.broadcast(counts) if counts.count() <= MOST_GRAMS else counts, ["q", "gram"])
    sort = F.array_sort(F.collect_list(F.struct("n", "gram", "pos")))
    kept = found.groupBy("id", *block, "length", "keep", "q").agg(F.slice(sort, F.lit(1), F.first("keep").cast("int")).alias("g"))
    return kept.select("id", *block, "length", "q", F.explode("g").alias("g")).select("id", *block, "length", "q", "g.gram", "g.pos")


def _by_segments(strings: DataFrame, block: Sequence[str], bounds: Bounds) -> DataFrame:
    """Pairs (a, b) of which one holds a segment of the other, as long or longer, near its place."""
    rows = strings.withColumn("length", F.length("t"))
    edits = lambda longer: F.floor(longer * bounds.edits + 1e-9)

    def cuts(longer: Column, make) -> Column:
        """An array of make(number, start, size) over the segments of strings so long."""
        n = edits(longer) + 1
        size, short = F.floor(longer / n), n - longer % n
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: make(i, i * size + F.greatest(i - short, F.lit(0)), size + F.when(i >= short, 1).otherwise(0)))

    key = lambda longer, i, part: F.struct(longer.cast("int").alias("longer"), i.cast("int").alias("i"), part.alias("part"))
    part = lambda start, size: F.substring(F.col("t"), (start + 1).cast("int"), size.cast("int"))
    whole = F.col("length").cast("long")

    def probes(longer: Column) -> Column:
        """Where a segment may stand: no further off than edits before it and behind it allow."""

        def places(i: Column, start: Column, size: Column) -> Column:
            shift, rest = whole - longer, edits(longer) - i
            low = F.greatest(F.lit(0).cast("long"), start - i, start + shift - rest)
            high = F.least(whole - size, start + i, start + shift + rest)
            found = F.transform(F.when(low <= high, F.sequence(low, high)), lambda p: key(longer, i, part(p, size)))
            return F.coalesce(found, F.array().cast("array<struct<longer:int,i:int,part:string>>"))

        return F.array_distinct(F.flatten(cuts(longer, places)))

    index = rows.select(F.col("id").alias("a"), *block, F.inline(cuts(whole, lambda i, start, size: key(whole, i, part(start, size)))))
    # Only lengths that some string has: titles cut at one length meet few others.
    lengths = F.array(*[F.lit(r[0]).cast("long") for r in rows.select("length").distinct().collect()]).cast("array<bigint>")
    reach = F.array_intersect(F.sequence(whole, F.floor(whole / bounds.narrow + 1e-9)), lengths)
    probe = rows.select(F.col("id").alias("b"), *block, F.explode(reach).alias("reach"), "t", "length")
    probe = probe.select("b", *block, F.inline(probes(F.col("reach"))))
    met = index.join(probe, ["longer", "i", "part", *block]).filter("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _by_grams(strings: DataFrame, block: Sequence[str], bounds: Bounds) -> DataFrame:
    """Pairs (a, b) that meet in as many rare grams, near their places, as they must."""
    index = cut(_positions(strings, block, bounds))
    index = index.withColumn("class", F.floor(F.log(F.col("length").cast("double")) / (-math.log(min(bounds.narrow, 0.95)))))
    x = index.withColumnsRenamed({"id": "a", "length": "la", "pos": "pa"})
    y = index.withColumnsRenamed({"id": "b", "length": "lb", "pos": "pb"}).withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    longer, shorter = F.greatest("la", "lb"), F.least("la", "lb")
    near = (F.col("a") < F.col("b")) & (F.abs(F.col("pa") - F.col("pb")) <= F.floor(longer * bounds.edits + 1e-9)) & (shorter >= F.floor(longer * bounds.narrow - 1e-9))
    met = x.join(y, ["q", "gram", "class", *block]).filter(near & (F.col("q") == bounds.gram(longer)))
    return met.groupBy("a", "b", longer.alias("longer")).agg(F.count("*").alias("n")).filter(F.col("n") >= bounds.meets(None, F.col("longer"))).select("a", "b")


class _Chunk:
    """Strings in order of length, longest first, as a character number a row, with how often each holds a character, as a whole
    and before each of some places."""

    def __init__(self, texts: list[str], codes: dict[str, int], at: np.ndarray) -> None:
        length = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-length, kind="stable")
        self.length, self.at = length[order], at[order]
        self.texts = [texts[k] for k in order]
        self.chars = np.zeros((self.length[0], len(texts)), np.intp)
        small = np.uint8 if self.length[0] < 256 else np.uint32  # holds a string's length
        usual = int(np.median(self.length))
        self.places = [max(1, usual * k // 12) for k in PLACES]
        for k, t in enumerate(self.texts):
            self.chars[: len(t), k] = [codes[x] for x in t]
        there = np.arange(self.length[0])[:, None] < self.length
        flat = self.chars * len(texts) + np.arange(len(texts))
        counted = lambda p: np.bincount(flat[:p][there[:p]], minlength=len(codes) * len(texts)).reshape(len(codes), -1).astype(small)
        self.counts = counted(self.length[0])
        self.heads = [counted(p) for p in self.places]
        self.tails = [self.counts - head for head in self.heads]

    def alike(self, own: np.ndarray, first: int, last: int, longer: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which of strings first to last may be ``most`` edits off from one of these characters, as numbers from first on."""
        whole = np.bincount(own, minlength=len(self.counts)).astype(self.counts.dtype)
        need = np.minimum(self.length[first:last], len(own)) - most
        rows = None
        for p, head, tail in zip(self.places, self.heads, self.tails):
            before = np.bincount(own[:p], minlength=len(self.counts)).astype(self.counts.dtype)
            n = _shared(before, head, first, last, rows) + _shared(whole - before, tail, first, last, rows)
            rows = np.flatnonzero(n >= need) if rows is None else rows[n >= need[rows]]
        return rows[_shared(whole, self.counts, first, last, rows) >= (longer - most)[rows]]


def _shared(own: np.ndarray, counts: np.ndarray, first: int, last: int, rows: np.ndarray | None) -> np.ndarray:
    """Characters that a string with these counts has in common with strings first to last, or those of them at ``rows``."""
    has = np.flatnonzero(own)
    theirs = counts[has, first:last] if rows is None else counts[has[:, None], rows + first]
    return np.minimum(theirs, own[has, None]).sum(0, dtype=counts.dtype)


def _distances(masks: np.ndarray, m: int, chars: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Edits from one string of m <= WORD characters to others, longest first: of each character ``masks`` has the places
    where the one string holds it. Columns of the table of edits are bit vectors of its differences (Myers, 1999)."""
    n = len(length)
    one = np.uint64(1)
    up, down = np.full(n, (1 << m) - 1, np.uint64), np.zeros(n, np.uint64)
    x, d, eq = (np.empty(n, np.uint64) for _ in range(3))
    ends = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")  # strings that reach each place
    for j, k in enumerate(ends):
        vp, vn, h, d0, e = up[:k], down[:k], x[:k], d[:k], eq[:k]
        np.take(masks, chars[j, :k], out=e, mode="clip")
        np.bitwise_and(e, vp, out=d0)
        d0 += vp
        d0 ^= vp
        d0 |= e
        d0 |= vn
        np.bitwise_or(d0, vp, out=h)
        np.invert(h, out=h)
        h |= vn
        np.bitwise_and(vp, d0, out=e)
        h <<= one
        h |= one
        e <<= one
        np.bitwise_or(d0, h, out=vp)
        np.invert(vp, out=vp)
        vp |= e
        np.bitwise_and(h, d0, out=vn)
    low = np.uint64((1 << m) - 1)
    return length + np.bitwise_count(up & low).astype(np.int64) - np.bitwise_count(down & low)


def _cell(bounds: Bounds, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """(a, b, edits, longer, ta, tb) of a cell's pairs that may be alike; of pairs that bit vectors can't measure, texts and no edits."""
    same = table["i"][0].as_py() == table["j"][0].as_py()
    texts = table["t"].to_pylist()
    ids = table["id"].combine_chunks()
    on_left = table["left"].to_numpy()
    codes = {x: k for k, x in enumerate(sorted(set().union(*texts)))}
    left, right = np.flatnonzero(on_left), np.flatnonzero(~on_left)
    # Within a group each pair is looked at from one of its sides: ids that come twice have one rank.
    rank = np.unique(table["id"].to_numpy(), return_inverse=True)[1] if same else None
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def batch() -> pa.RecordBatch:
        a, b, edits, longer = (np.concatenate(x) for x in zip(*found))
        open_ = edits < 0
        named = lambda at: pa.array([texts[k] if o else None for k, o in zip(at, open_)], pa.string())
        columns = [ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(edits, mask=open_), pa.array(longer), named(a), named(b)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "edits", "longer", "ta", "tb"])

    for a in range(0, len(right), CHUNK):
        chunk = _Chunk([texts[k] for k in right[a : a + CHUNK]], codes, right[a : a + CHUNK])
        for k in left:
            t = texts[k]
            m = len(t)
            own = np.array([codes[x] for x in t], np.intp)
            # No shorter than ``narrow`` of the longer one, whichever that is.
            first = np.searchsorted(-chunk.length, -math.floor(m / bounds.narrow + 1e-9), "left")
            last = np.searchsorted(-chunk.length, -math.floor(m * bounds.narrow - 1e-9), "right")
            if first == last:
                continue
            longer = np.maximum(chunk.length[first:last], m)
            most = np.floor(longer * bounds.edits + 1e-9)
            rows = chunk.alike(own, first, last, longer, most)
            if same:
                rows = rows[rank[chunk.at[rows + first]] > rank[k]]
            if not len(rows):
                continue
            edits = np.full(len(rows), -1, np.int64)
            at, size = rows + first, chunk.length[rows + first]
            if m <= WORD:
                masks = np.zeros(len(codes), np.uint64)
                np.bitwise_or.at(masks, own, np.uint64(1) << np.arange(m, dtype=np.uint64))
                edits = _distances(masks, m, chunk.chars[: size[0], at], size)
            else:
                for r in np.flatnonzero(size <= WORD):
                    masks = np.zeros(len(codes), np.uint64)
                    np.bitwise_or.at(masks, chunk.chars[: size[r], at[r]], np.uint64(1) << np.arange(size[r], dtype=np.uint64))
                    edits[r] = _distances(masks, int(size[r]), own[:, None], np.array([m]))[0]
            near = edits <= most[rows]
            if near.any():
                found.append((np.full(near.sum(), k), chunk.at[at[near]], edits[near], longer[rows[near]]))
                held += int(np.where(edits[near] < 0, m + size[near], 1).sum())
            if held >= HELD:
                yield batch()
                found, held = [], 0
    if found:
        yield batch()


def _by_cells(strings: DataFrame, least: float, bounds: Bounds) -> DataFrame:
    """(a, b, ratio) of the pairs alike enough. Each string is sent to as many cells as there are groups."""
    prepare(strings.sparkSession)
    rows = strings.filter("t <> '' AND id IS NOT NULL").select("id", "t")
    n = rows.count()
    sides = max(1, min(math.ceil(n / CHUNK), max(SIDES, math.ceil(n / MOST_SIDE))))
    n_cells = sides * (sides + 1) // 2
    slices = math.ceil(TASKS / n_cells)
    code = F.xxhash64("id")
    dealt = rows.withColumns({"side": F.pmod(code, F.lit(sides)).cast("int"), "slice": F.pmod(F.shiftright(code, 32), F.lit(slices)).cast("int")})
    cell = lambda i, j, slice, left: F.struct(i.alias("i"), j.alias("j"), slice.cast("int").alias("slice"), F.lit(left).alias("left"))
    lefts = F.transform(F.sequence("side", F.lit(sides - 1)), lambda j: cell(F.col("side"), j, F.col("slice"), True))
    rights = F.flatten(F.transform(F.sequence(F.lit(0), "side"), lambda i: F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda k: cell(i, F.col("side"), k, False))))
    dealt = dealt.select("id", "t", F.inline(F.concat(lefts, rights)))
    schema = f"a {rows.schema['id'].dataType.simpleString()}, b {rows.schema['id'].dataType.simpleString()}, edits long, longer long, ta string, tb string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cell(bounds, pa.Table.from_batches(batches))

    met = dealt.repartition(n_cells * slices, "i", "j", "slice").groupBy("i", "j", "slice").applyInArrow(run, schema).filter("a <> b")
    ratio = F.coalesce(F.round(1 - F.col("edits") / F.col("longer"), 6), levenshtein_ratio(F.col("ta"), F.col("tb")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), ratio.alias("ratio")).filter(F.col("ratio") >= least)


def candidates(strings: DataFrame, least: float, ratio: str = "levenshtein", block: Sequence[str] = ()) -> DataFrame:
    """(a, b), a < b, of strings (id, t, block) that may be alike: none that are is missing."""
    bounds = Bounds(least, ratio)
    by = _by_segments if bounds.edits <= MOST_EDITS else _by_grams
    return by(strings.filter("t <> ''"), block, bounds)


def similar_strings(strings: DataFrame, least: float, ratio: str = "levenshtein", block: Sequence[str] = ()) -> DataFrame:
    """(a, b, ratio, back) of different strings (id, t, block) of one block whose ratio is at least ``least``, a < b.

    ``back`` is the ratio of b to a, the same but for the ratio of matching blocks, of which either may reach the bound.
    Empty strings and null blocks meet nothing.
    """
    if ratio == "levenshtein" and not block and (bounds := Bounds(least, ratio)).edits > MOST_EDITS:
        return _by_cells(strings, least, bounds).withColumn("back", F.col("ratio"))
    found = candidates(strings, least, ratio, block)
    texts = strings.select("id", "t")
    met = found.join(texts.withColumnsRenamed({"id": "a", "t": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "t": "tb"}), "b")
    if ratio == "levenshtein":
        one = met.withColumn("ratio", levenshtein_ratio(F.col("ta"), F.col("tb"))).withColumn("back", F.col("ratio"))
    else:
        met = met.filter(2 * shared_characters(character_counts(F.col("ta")), character_counts(F.col("tb"))) / (F.length("ta") + F.length("tb")) >= least)
        one = met.withColumns({"ratio": sequence_ratio("ta", "tb"), "back": sequence_ratio("tb", "ta")})
    return one.filter((F.col("ratio") >= least) | (F.col("back") >= least)).select("a", "b", "ratio", "back")


def classes(records: DataFrame, text: Column, block: Sequence[str] = (), id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Strings (id, t, block), named by the least id that has them, and members (id, class_id)."""
    rows = records.select(F.col(id_col).alias("id"), *block, text.alias("t")).filter("t <> ''")
    for c in block:
        rows = rows.filter(F.col(c).isNotNull())
    strings = rows.groupBy(*block, "t").agg(F.min("id").alias("class_id"))
    members = rows.join(strings, [*block, "t"]).select("id", "class_id")
    return strings.select(F.col("class_id").alias("id"), "t", *block), members
