"""Hidden Markov tagging of word sequences of any length, as expressions over arrays.

Words are dealt into chunks, so no sequence has to fit in a row. A chunk's best scores from each tag before it to each tag
at its end are a matrix; such matrices multiply associatively with sums for products and maxima for sums. Their product
along a sequence gives the best tag at each chunk's end, and between these ends each chunk is tagged by itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a chunk.
CHUNK = 128
_LOW = -1e300


@dataclass(frozen=True)
class Counts:
    """What tags and words were seen: sizes follow the tag set, but for ``shown``, a table (word, counts by tag)."""

    tags: list[str]
    start: list[float]
    step: list[list[float]]
    whole: list[float]
    shown: DataFrame


def count(words: DataFrame, seq: Sequence[str], pos: str, tag: str, word: str) -> Counts:
    """Add-one smoothed counts of tagged words: of starts, of tags that follow each other, and of words by tag."""
    before = F.lag(tag).over(Window.partitionBy(*seq).orderBy(pos))
    moves = words.select(before.alias("a"), F.col(tag).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).collect()  # tags squared
    tags = sorted({r["b"] for r in moves})
    row = lambda a: [next((r["n"] for r in moves if r["a"] == a and r["b"] == b), 0) for b in tags]
    logs = lambda n: [math.log((1 + x) / (len(tags) + sum(n))) for x in n]
    shown = words.groupBy(F.col(word).alias("word")).agg(F.array(*[F.count(F.when(F.col(tag) == t, 1)) for t in tags]).alias("counts"))
    n_words = shown.count()
    sizes = {r[0]: r[1] for r in words.groupBy(tag).count().collect()}
    return Counts(tags, logs(row(None)), [logs(row(a)) for a in tags], [float(sizes[t] + n_words + 1) for t in tags], shown)


def _doubles(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


class _Steps:
    """Expressions over the tags of one model."""

    def __init__(self, counts: Counts) -> None:
        self.n = len(counts.tags)
        self.start = _doubles(counts.start)
        self.step = F.array(*[_doubles(r) for r in counts.step])
        self.all = F.sequence(F.lit(0), F.lit(self.n - 1))

    def through(self, scores: Column, matrix: Column) -> Column:
        """For each tag the best of score + matrix, and minus the place that it came from, the first of equal ones."""
        return F.transform(self.all, lambda t: F.array_max(F.transform(scores, lambda s, k: F.struct((s + F.get(F.get(matrix, k), t)).alias("s"), (-k).alias("k")))))

    def add(self, best: Column, emitted: Column) -> Column:
        return F.zip_with(F.transform(best, lambda x: x["s"]), emitted, lambda a, b: a + b)

    def matrix(self, emitted: Column, first: Column) -> Column:
        """A chunk's scores from each tag before to each at its end; a sequence's first chunk has one row, from its start."""
        identity = F.array(*[_doubles([0.0 if k == t else _LOW for t in range(self.n)]) for k in range(self.n)])
        begun = F.array(F.zip_with(self.start, F.get(emitted, 0), lambda a, b: a + b))
        words = F.when(first, F.slice(emitted, 2, CHUNK)).otherwise(emitted)
        return F.aggregate(words, F.when(first, begun).otherwise(identity), lambda m, e: F.transform(m, lambda r: self.add(self.through(r, self.step), e)))

    def best_path(self, init: Column, items: Column, move) -> tuple[Column, Column]:
        """Scores at the end, and for each item the place each tag came from. move(scores, item) gives through's structs and the new scores."""
        zero = F.struct(init.alias("v"), F.array().cast("array<array<int>>").alias("backs"))

        def one(acc: Column, item: Column) -> Column:
            best, scores = move(acc["v"], item)
            return F.struct(scores.alias("v"), F.array_append(acc["backs"], F.transform(best, lambda x: (-x["k"]).cast("int"))).alias("backs"))

        folded = F.aggregate(items, zero, one)
        return folded["v"], folded["backs"]

    def walk(self, last: Column, backs: Column) -> Column:
        """Tags in order, of which the last is known."""
        path = F.aggregate(F.reverse(backs), F.array(last), lambda p, b: F.array_append(p, F.get(b, F.element_at(p, -1))))
        return F.reverse(path)


def tag(words: DataFrame, seq: Sequence[str], pos: str, word: str, counts: Counts, chunk: int = CHUNK) -> DataFrame:
    """The rows with ``tagged``, the likeliest tag of each word in its sequence.

    Positions of a sequence are 0, 1, 2 and so on; a null word, like one never seen, tells nothing of its tag. Of ways
    equally likely the one through the first tags is taken, chunk by chunk.
    """
    if not 0 < chunk <= CHUNK:
        raise ValueError(f"a chunk has at most {CHUNK} words")
    if not counts.tags:
        return words.withColumn("tagged", F.lit(None).cast("string"))
    steps, whole = _Steps(counts), _doubles(counts.whole)
    none = F.array(*[F.lit(0).cast("long") for _ in counts.tags])
    known = words.join(counts.shown.withColumnsRenamed({"word": word, "counts": "__n"}), word, "left")
    emitted = F.zip_with(F.coalesce("__n", none), whole, lambda n, w: F.log((n + 1) / w))
    rows = known.select(*[F.col(c) for c in words.columns], F.floor(F.col(pos) / chunk).cast("int").alias("__c"), emitted.alias("__e"))
    others = [c for c in words.columns if c not in seq]
    packed = rows.groupBy(*seq, "__c").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("__p"), "__e", F.struct(*others).alias("__row")))).alias("__w"))
    e = F.transform("__w", lambda x: x["__e"])
    chunks = packed.withColumn("__e", e).withColumn("__m", steps.matrix(F.col("__e"), F.col("__c") == 0))

    # The ends of all chunks of a sequence: one small matrix a chunk.
    joined = chunks.groupBy(*seq).agg(F.transform(F.array_sort(F.collect_list(F.struct("__c", "__m"))), lambda x: x["__m"]).alias("__ms"))

    def over(scores: Column, m: Column) -> tuple[Column, Column]:
        best = steps.through(scores, m)
        return best, F.transform(best, lambda x: x["s"])

    at_end, backs = steps.best_path(F.get(F.get("__ms", 0), 0), F.slice("__ms", F.lit(2), F.greatest(F.size("__ms") - 1, F.lit(0))), over)
    ends = joined.select(*seq, at_end.alias("__v"), backs.alias("__b"))
    ends = ends.select(*seq, steps.walk((F.array_position("__v", F.array_max("__v")) - 1).cast("int"), F.col("__b")).alias("__t"))
    ends = ends.select(*seq, F.posexplode(F.arrays_zip(F.concat(F.array(F.lit(None).cast("int")), F.slice("__t", F.lit(1), F.size("__t") - 1)).alias("enter"), F.col("__t").alias("leave"))).alias("__c", "__x"))

    def within(scores: Column, emitted: Column) -> tuple[Column, Column]:
        best = steps.through(scores, steps.step)
        return best, steps.add(best, emitted)

    both = chunks.drop("__m").join(ends, [*seq, "__c"])
    entered = F.when(F.col("__x.enter").isNull(), steps.start).otherwise(F.get(steps.step, F.col("__x.enter")))
    _, backs = steps.best_path(F.zip_with(entered, F.get("__e", 0), lambda a, b: a + b), F.slice("__e", 2, CHUNK), within)
    tagged = both.select(*seq, "__w", steps.walk(F.col("__x.leave"), backs).alias("__t"))
    names = F.array(*[F.lit(t) for t in counts.tags])
    found = tagged.select(*seq, F.explode(F.arrays_zip(F.transform("__w", lambda x: x["__row"]).alias("row"), F.col("__t").alias("t"))).alias("x"))
    return found.select(*seq, *[F.col("x.row")[c].alias(c) for c in others], F.get(names, F.col("x.t")).alias("tagged"))
