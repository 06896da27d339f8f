"""Language identification, word first: known words by their log frequency in each language, unknown words
by their longest known character n-grams.

The model is counts of words and of n-grams of one to five characters per language, taken from a bounded
sample of labelled rows. A word that the model knows scores by its own frequency; for another the n-grams
of five characters are tried, then four, and so on: the first length of which any is known decides.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Remembered, bounded_batches, coded_words, dealt_out, doc_id, keyed, process_wide, text_sums

#: About so many labelled rows of each language are learned from, picked by hash.
ROWS_PER_LANGUAGE = 1500
#: The most frequent words and n-grams of each language that a model keeps.
FEATURES = 50_000
#: A table of up to so many languages is broadcast.
BROADCAST_LANGUAGES = 20_000
#: Words whose scores a Python worker remembers in either of two generations.
REMEMBERED = 60_000
LONGEST = 5
#: Words that a learning task counts before it passes them on.
HELD_WORDS = 15_000
#: The evidence of so many words at most counts in the score.
FULL_EVIDENCE = 20
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    word = f"^{word}$"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


class Model:
    """Log frequencies of words (kind 0) and n-grams (kind n) in each language."""

    def __init__(self, counts: list[tuple[int, str, str, int]]) -> None:
        self.languages = sorted({lang for _, _, lang, _ in counts})
        column = {lang: i for i, lang in enumerate(self.languages)}
        #: The row of each word or n-gram in the table, by kind.
        self.known: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for kind, key, _, _ in counts:
            self.known[kind][key] = 0
        n = 0
        for part in self.known:
            for key in part:
                part[key] = n
                n += 1
        table = np.zeros((n, len(column)))
        for kind, key, lang, times in counts:
            table[self.known[kind][key], column[lang]] += times
        for part in self.known:
            at = list(part.values())
            table[at] = np.log((table[at] + 0.5) / (table[at].sum(axis=0) + 0.5 * len(at)))
        self.table = table.astype(np.float32)

    def rows_of(self, word: str) -> list[int]:
        """The table's rows whose mean scores a word: its own, or those of its longest known n-grams."""
        if (found := self.known[0].get(word)) is not None:
            return [found]
        whole = f"^{word}$"
        for n in range(LONGEST, 0, -1):
            part = self.known[n]
            if rows := [part[g] for i in range(len(whole) - n + 1) if (g := whole[i : i + n]) in part]:
                return rows
        return []

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each word; zeros where nothing is known."""
        rows = list(map(self.rows_of, words))
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        total = text_sums(self.table[np.fromiter(chain.from_iterable(rows), np.int64, size.sum())], np.r_[0, np.cumsum(size)])
        return (total / np.maximum(size, 1)[:, None]).astype(np.float32)


class Scorer:
    """Languages and scores of texts; a word's row of log frequencies is remembered."""

    def __init__(self, model: Model, remembered: int = REMEMBERED) -> None:
        self.model = model
        self.rows = Remembered(lambda words: map(np.ndarray.tobytes, model.scores(words)), remembered)

    def predict(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """lang_pred and score of each text."""
        names, at, begin = coded_words(only_letters(pc.fill_null(texts, "")))
        languages = self.model.languages
        letters = np.array([bool(x) for x in names], np.int64)
        n = text_sums(letters[at], begin)
        if not languages:
            return pa.array([UNKNOWN] * len(texts), pa.string()), np.zeros(len(texts))
        blank = np.zeros(len(languages), np.float32).tobytes()
        table = np.frombuffer(b"".join(self.rows([x for x in names if x])), np.float32).reshape(-1, len(languages))
        if not letters.all():  # the blank word has no say
            table = np.insert(table, np.flatnonzero(letters == 0), np.frombuffer(blank, np.float32), axis=0)
        mean = text_sums(table[at], begin) / np.maximum(n, 1)[:, None] * np.minimum(n, FULL_EVIDENCE)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        best, known = p.argmax(axis=1), n > 0
        score = np.where(known, p[np.arange(len(p)), best] / p.sum(axis=1), 0.0)
        return pa.array(np.array([*languages, UNKNOWN], object)[np.where(known, best, len(languages))], pa.string()), score


def only_letters(texts: pa.Array) -> pa.Array:
    """texts in lower case, blanks for all that is no letter."""
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"\PL+", " ")


def learn(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, features: int = FEATURES) -> Model:
    """A model from rows with text and lang that aren't held out.

    Of each language about `rows` rows are read whole, those with the smallest hash of doc_id; the counts
    of words and n-grams are summed in Spark, and the `features` largest of each language reach the driver.
    """
    usable = dealt_out(docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang"))
    sizes = usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(rows) / F.count("*")).alias("share"))
    sizes = F.broadcast(sizes) if sizes.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES else sizes
    sample = usable.join(sizes, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2**31)) < F.col("share") * 2**31).select("text", "lang")

    def counted(words: Counter) -> pa.RecordBatch:
        """Words with their counts, and the n-grams of each word as often."""
        found: Counter = Counter()
        for (word, lang), n in words.items():
            found[0, word, lang] += n
            for size in range(1, LONGEST + 1):
                for g in grams(word, size):
                    found[size, g, lang] += n
        kind, key, lang = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.string()), pa.array(lang, pa.string()), pa.array(found.values(), pa.int64())], names=["kind", "key", "lang", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for b in batches:
            for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
                words.update((w, lang) for w in LETTERS.findall(text.lower()))
                if len(words) > HELD_WORDS:
                    yield counted(words)
                    words.clear()
        yield counted(words)

    bounded_batches(docs.sparkSession)
    counts = sample.mapInArrow(count, "kind int, key string, lang string, n long").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "kind", "key"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= features).select("kind", "key", "lang", "n")
    return Model([tuple(r) for r in top.collect()])


def scorer_of(spark: SparkSession, model: Model) -> Callable[[], Scorer]:
    """A function that gives a Python worker its scorer; the model travels to it once."""
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(model)
    return lambda: process_wide(name, lambda: Scorer(sent.value))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """_id, _h, lang_pred and score of every row."""
    ready = scorer_of(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ready()
        for b in batches:
            lang, score = scorer.predict(b["_t"])
            yield pa.RecordBatch.from_arrays([b["_id"], b["_h"], lang, pa.array(score)], names=["_id", "_h", "lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    return keyed(docs).mapInArrow(run, "_id long, _h long, lang_pred string, score double")


def query(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (columns doc_id, text, lang).

    Null text, and text without a letter, is `und` with score 0; so is all text if nothing can be learned.
    Rows with null doc_id are predicted, not held out and not learned from. Ties go to the first language
    by name. Repeated rows give equal results; very long texts are read whole; no rows, no result.
    """
    out = predicted(docs, learn(docs, **options))
    return out.select(doc_id(), "lang_pred", "score").withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.5, **options: int) -> DataFrame:
    """docs without the rows whose language is unknown or scores below least.

    Null and empty texts go, as they have no language; repeated rows are judged alike and all stay or go;
    very long texts are read whole; rows, null doc_ids and other columns stay as they are; no rows, no result.
    """
    ready = scorer_of(docs.sparkSession, learn(docs, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ready()
        for b in batches:
            lang, score = scorer.predict(b["text"])
            yield b.filter(pc.and_(pc.not_equal(lang, UNKNOWN), pa.array(score >= least)))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
