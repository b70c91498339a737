"""Operators over text corpora: profiles, counts, weights, indexes, sequences, tagging."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import char_ngrams
from quillstone.operators.lineage import cut, prepare

#: Rows of profiles, and words of a vocabulary, up to which they are sent to every task; the size is checked.
FEW_PROFILES, FEW_WORDS = 1 << 16, 1 << 20
#: Characters that are looked at in one go, and of a gram that is a number of 63 bits.
SLICE, LONGEST = 1 << 20, 3


def _grams(docs: DataFrame, text: Column, key: str, sizes: Sequence[int]) -> DataFrame:
    return docs.select(key, F.explode(F.concat(*[char_ngrams(text, n) for n in sizes])).alias("gram"))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a batch's texts, in column 1: rows and characters, each row once for each of its characters, SLICE at a time."""
    rows: list[int] = []
    texts: list[str] = []
    n = 0

    def piece() -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(rows, [len(t) for t in texts]), np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)

    for k, text in enumerate(batch.column(1)):
        if t := text.as_py():
            rows.append(k)
            texts.append(t)
            n += len(t)
            if n >= SLICE:
                yield piece()
                rows, texts, n = [], [], 0
    if n:
        yield piece()


def _codes(rows: np.ndarray, chars: np.ndarray, n: int, bits: int = 21) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each run of n characters that lies within a row."""
    last = len(chars) - n + 1
    if last < 1:
        return rows[:0], chars[:0]
    code = chars[:last].copy()
    for k in range(1, n):
        code <<= bits
        code |= chars[k : k + last]
    own = rows[:last] == rows[n - 1 :]
    return rows[:last][own], code[own]


def _spelled(codes: np.ndarray, n: int, bits: int) -> list[str]:
    mask = (1 << bits) - 1
    return ["".join(chr(c >> bits * k & mask) for k in reversed(range(n))) for c in codes.tolist()]


def _counted_grams(docs: DataFrame, text: Column, label: str, sizes: Sequence[int]) -> DataFrame:
    """(label, gram, n): counts of the n-grams of each label, for each piece of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).dictionary_encode(null_encoding="encode")
            of_row = labels.indices.to_numpy(zero_copy_only=False)
            for rows, chars in _pieces(batch):
                bits = 7 if chars.max() < 128 else 21
                for n in sizes:
                    at, code = _codes(rows, chars, n, bits)
                    at = of_row[at]
                    for k in np.unique(at):
                        if bits == 7:
                            counts = np.bincount(code[at == k])
                            found = np.flatnonzero(counts)
                            counts = counts[found]
                        else:
                            found, counts = np.unique(code[at == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays([labels.dictionary.take(pa.array(np.full(len(found), k))), pa.array(_spelled(found, n, bits), pa.string()), pa.array(counts.astype(np.int64))], names=[label, "gram", "n"])

    prepare(docs.sparkSession)
    return docs.select(label, text.alias("__text")).mapInArrow(run, f"`{label}` {docs.schema[label].dataType.simpleString()}, gram string, n long")


def ngram_profile(docs: DataFrame, text: Column, label: str, sizes: Sequence[int], top: int) -> DataFrame:
    """(label, gram, n): the most frequent character n-grams of each label and size, ties by gram.

    All sizes come from one scan; what is shuffled are counts of the different grams of a label. Grams of up to LONGEST
    characters are counted as numbers, longer ones as rows.
    """
    if max(sizes) <= LONGEST:
        counts = _counted_grams(docs, text, label, sizes).groupBy(label, "gram").agg(F.sum("n").alias("n"))
    else:
        counts = _grams(docs, text, label, sizes).groupBy(label, "gram").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(label, F.length("gram")).orderBy(F.col("n").desc(), "gram"))
    return counts.withColumn("place", place).filter(F.col("place") <= top).drop("place")


def _scored(docs: DataFrame, text: Column, key: str, profiles: pa.Table, sizes: Sequence[int], label_type: str) -> DataFrame:
    """(key, __label, n): the n-grams of each row that are in each label's profile, of which there are few."""
    labels = profiles["__label"].combine_chunks().dictionary_encode(null_encoding="encode")
    of_label = labels.indices.to_numpy(zero_copy_only=False)
    grams, names, n_labels = profiles["gram"].to_pylist(), labels.dictionary, len(labels.dictionary)
    known = {}  # per size: the different grams' numbers, and where each one's labels begin and end
    for n in sizes:
        own = [(sum(ord(c) << 21 * (n - 1 - k) for k, c in enumerate(g)), j) for g, j in zip(grams, of_label.tolist()) if len(g) == n]
        code, who = np.array(sorted(own), np.int64).reshape(-1, 2).T
        found, first, size = np.unique(code, return_index=True, return_counts=True)
        known[n] = (found, first, size, who)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, chars in _pieces(batch):
                base, met = rows[0], []
                for n in sizes:
                    found, first, size, who = known[n]
                    at, code = _codes(rows, chars, n)
                    if not len(found) or not len(code):
                        continue
                    place = np.minimum(np.searchsorted(found, code), len(found) - 1)
                    hit = found[place] == code
                    at, place = at[hit] - base, place[hit]
                    times = size[place]
                    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    met.append(np.repeat(at, times) * n_labels + who[np.repeat(first[place], times) + within])
                counts = np.bincount(np.concatenate(met)) if met else np.zeros(0, np.int64)
                pairs = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs // n_labels + base)), names.take(pa.array(pairs % n_labels)), pa.array(counts[pairs])], names=[key, "__label", "n"])

    prepare(docs.sparkSession)
    return docs.select(key, text.alias("__text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, __label {label_type}, n long")


def profile_scores(docs: DataFrame, text: Column, key: str, profiles: DataFrame, label: str, sizes: Sequence[int]) -> DataFrame:
    """(key, label, score): how many of a text's n-grams, repeats counted, are in each label's profile.

    A profile has at most ``top`` rows a label and size, so the profiles of FEW_PROFILES rows or fewer go to every task,
    where grams of up to LONGEST characters are looked up as numbers; with more labels than that the join is left to the engine.
    """
    named = profiles.select(F.col(label).alias("__label"), "gram")
    few = named.limit(FEW_PROFILES + 1).toArrow()
    if few.num_rows <= FEW_PROFILES and max(sizes) <= LONGEST:
        found = _scored(docs, text, key, few, sizes, named.schema["__label"].dataType.simpleString())
        return found.groupBy(key, F.col("__label").alias(label)).agg(F.sum("n").alias("score"))
    if few.num_rows <= FEW_PROFILES:
        named = F.broadcast(docs.sparkSession.createDataFrame(few, named.schema))
    return _grams(docs, text, key, sizes).join(named, "gram").groupBy(key, F.col("__label").alias(label)).agg(F.count("*").alias("score"))


def best_label(scores: DataFrame, key: str, label: str, order: Sequence[str]) -> DataFrame:
    """(key, label): the best score; ties go to the label declared first, then by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(label)), F.lit(0)), F.lit(len(order) + 1))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), rank, label))
    return scores.withColumn("place", place).filter("place = 1").select(key, label)


def tokens(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, position, token), positions from 0."""
    return docs.select(key, F.posexplode(words).alias("position", "token"))


def bigrams(docs: DataFrame, words: Column) -> DataFrame:
    """(a, b, n): adjacent words and how often; formed within the row, so nothing is sorted."""
    pairs = F.when(F.size(words) >= 2, F.arrays_zip(F.slice(words, F.lit(1), F.size(words) - 1).alias("a"), F.slice(words, F.lit(2), F.size(words) - 1).alias("b")))
    return docs.select(F.inline(pairs).alias("a", "b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def frequencies(docs: DataFrame, words: Column, top: int) -> DataFrame:
    return docs.select(F.explode(words).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(top)


def tfidf(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, token, tf, df, weight): term count times ln((documents + 1) / (documents with the term + 1)).

    Texts are dealt by key once, before they are taken apart, so counts of a document's terms, and windows over them, need
    no further shuffle. A vocabulary of at most FEW_WORDS goes to every task; a larger one is joined by term.
    """
    df = docs.select(F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    total, n_words = docs.agg(F.count("*")).first()[0], df.count()
    tf = docs.select(key, words.alias("__w")).repartition(key).select(key, F.explode("__w").alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    weight = F.col("tf") * F.log((F.lit(total) + 1) / (F.col("df") + 1))
    return tf.join(F.broadcast(df) if n_words <= FEW_WORDS else df, "token").select(key, "token", "tf", "df", weight.alias("weight"))


def tfidf_best(docs: DataFrame, key: str, words: Column, top: int, digits: int) -> DataFrame:
    """(key, token, tf, df, weight): each text's ``top`` weights, rounded, ties by token.

    Of a larger vocabulary the most frequent words, FEW_WORDS at most, go to every task, where a text's best of them are
    found beside the text. Only these and the rare words' rows are then dealt out, by word and by text again.
    """
    df = cut(docs.select(F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count("*").alias("df")))
    total, left, least = docs.agg(F.count("*")).first()[0], FEW_WORDS, 1
    if df.count() > FEW_WORDS:
        # From which frequency on words are few enough: a row of counts for each power of two.
        size = F.length(F.bin("df"))
        for bits, n in df.groupBy(size.alias("bits")).agg(F.count("*")).orderBy(F.col("bits").desc()).collect():
            left -= n
            if left < 0:
                least = 1 << bits
                break
    weight = F.round(F.col("tf") * F.log((F.lit(total) + 1) / (F.col("df") + 1)), digits)
    tf = docs.select(key, words.alias("__w")).repartition(key).select(key, F.explode("__w").alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    near = tf.join(F.broadcast(df.filter(F.col("df") >= least)), "token", "left" if least > 1 else "inner").withColumn("weight", weight)
    best = lambda *by: F.row_number().over(Window.partitionBy(key, *by).orderBy(F.col("weight").desc(), "token"))
    if least > 1:
        rare = F.col("df").isNull()
        kept = near.withColumn("__place", best(rare)).filter((F.col("__place") <= top) | rare).drop("__place", "weight")
        known = df.filter(F.col("df") < least).withColumnRenamed("df", "__df")
        near = kept.join(known, "token", "left").withColumn("df", F.coalesce("df", "__df")).drop("__df").withColumn("weight", weight)
    return near.withColumn("__place", best()).filter(F.col("__place") <= top).select(key, "token", "tf", "df", "weight")


def tfidf_fit(train: DataFrame, words: Column, stop: Sequence[str], most: int) -> DataFrame:
    """(token, index, idf) of the ``most`` frequent words of the training texts that aren't stop words, ties by word; indexes from 0."""
    kept = F.filter(words, lambda x: ~x.isin(*stop)) if stop else words
    total = train.agg(F.count("*")).first()[0]
    best = train.select(F.explode(kept).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(most)
    df = train.select(F.explode(F.array_distinct(kept)).alias("token")).join(F.broadcast(best), "token").groupBy("token").agg(F.count("*").alias("df"))  # ``most`` rows
    return df.select("token", (F.row_number().over(Window.orderBy("token")) - 1).alias("index"), F.log((F.lit(total) + 1) / (F.col("df") + 1)).alias("idf"))


def tfidf_transform(docs: DataFrame, key: str, words: Column, model: DataFrame) -> DataFrame:
    """(key, index, weight) of the model's words in each text, scaled to unit length. The model has as many rows as it was fitted with."""
    tf = docs.select(key, words.alias("__w")).repartition(key).select(key, F.explode("__w").alias("token")).join(F.broadcast(model), "token").groupBy(key, "index").agg((F.count("*") * F.max("idf")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return tf.select(key, "index", (F.col("x") / norm).alias("weight"))


def vocabulary(docs: DataFrame, words: Column, size: int) -> DataFrame:
    """(token, index): the most frequent words, numbered from 1; 0 is left for padding, size + 1 for unknown words."""
    best = frequencies(docs, words, size)
    return best.withColumn("index", F.row_number().over(Window.orderBy(F.col("n").desc(), "token"))).select("token", "index")


def indexed(docs: DataFrame, key: str, words: Column, vocab: DataFrame, unknown: int) -> DataFrame:
    """(key, ids): each text as word numbers."""
    found = tokens(docs, key, words).join(vocab, "token", "left").select(key, F.struct("position", F.coalesce("index", F.lit(unknown)).alias("i")).alias("x"))
    return found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["i"]).alias("ids"))


def transitions(rows: DataFrame, seq: str, pos: str, tag: str) -> DataFrame:
    """(previous, tag, n): how often a tag follows another; the first of a sequence follows ''."""
    before = F.coalesce(F.lag(tag).over(Window.partitionBy(seq).orderBy(pos)), F.lit(""))
    return rows.select(before.alias("previous"), F.col(tag).alias("tag")).groupBy("previous", "tag").agg(F.count("*").alias("n"))


def emissions(rows: DataFrame, tag: str, word: str) -> DataFrame:
    return rows.groupBy(F.col(tag).alias("tag"), F.col(word).alias("word")).agg(F.count("*").alias("n"))


def with_counts(rows: DataFrame, word: str, shown: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Rows with ``counts``: how often each of ``tags`` showed the row's word; zeros for a word never shown."""
    per = shown.groupBy(F.col("word").alias(word)).agg(F.array(*[F.sum(F.when(F.col("tag") == t, F.col("n")).otherwise(0)) for t in tags]).alias("counts"))
    return rows.join(per, word, "left").withColumn("counts", F.coalesce("counts", F.array(*[F.lit(0).cast("long") for _ in tags])))


def viterbi(rows: DataFrame, counts: str, moves: pd.DataFrame, sizes: pd.DataFrame, n_words: int) -> DataFrame:
    """Rows with ``tags``: the likeliest tag of each word under add-one smoothed counts.

    ``counts`` is an array with, for each word, how often each tag, in order, showed it; ``sizes`` (tag, n) are the
    words each tag showed in all, of ``n_words`` different ones. What the driver holds is as large as the tag set.
    """
    tags = sorted(set(moves["tag"]))
    at = {t: i for i, t in enumerate(tags)}
    step = np.ones((len(tags) + 1, len(tags)))
    for p, t, n in moves[["previous", "tag", "n"]].itertuples(index=False):
        step[at[p] if p in at else len(tags), at[t]] += n
    step = np.log(step / step.sum(1, keepdims=True))
    whole = np.full(len(tags), n_words + 1.0)
    for t, n in sizes[["tag", "n"]].itertuples(index=False):
        whole[at[t]] += n

    def one(sentence: Sequence[np.ndarray]) -> list[str]:
        back: list[np.ndarray] = []
        score = None
        for w in sentence:
            e = np.log((np.asarray(w) + 1.0) / whole)
            if score is None:
                score = step[-1] + e
            else:
                total = score[:, None] + step[:-1]
                back.append(total.argmax(0))
                score = total.max(0) + e
        if score is None:
            return []
        k = int(score.argmax())
        path = [k]
        for b in reversed(back):
            path.append(k := int(b[k]))
        return [tags[k] for k in reversed(path)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(tags=[one(s) for s in batch[counts]])

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", tags array<string>")


def aligned_labels(word_ids: Column, labels: Column, ignore: int = -100) -> Column:
    """Labels of sub-tokens: the word's label at its first sub-token, ``ignore`` elsewhere and where there is no word."""
    previous = lambda i: F.get(word_ids, i - 1)
    return F.transform(word_ids, lambda w, i: F.when(w.isNull() | ((i > 0) & previous(i).eqNullSafe(w)), F.lit(ignore)).otherwise(F.get(labels, w)))
