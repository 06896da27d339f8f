"""Quality from weak labels: heuristics vote, expectation-maximisation weighs them, a linear scorer learns.

Each labeller calls a text good (1) or poor (0), or abstains. Its accuracy on either class is estimated
from all rows' votes without any label (Dawid and Skene, 1979): votes are counted by pattern, of which
there are at most 3 to the number of labellers, so the counts of the whole corpus are a small table. The
posterior of a pattern is the label that a hashed linear scorer is trained on.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Remembered, bounded_batches, coded_words, doc_id, keyed, process_wide, text_sums

#: About so many rows, picked by hash, train the scorer.
TRAINING_ROWS = 4000
#: Features of one training row that reach the driver: those of its words, evenly spaced, if it has more.
TRAINING_WORDS = 5000
#: Words whose weights a Python worker remembers in either of two generations.
REMEMBERED = 150_000
BITS = 18
SIGNS = re.compile(rb"[#$%&*|<>{}=_^~\\@]")
REPEATED = re.compile(rb"([#$%&*|<>{}=_^~\\@!?])\1\1")
LONE = re.compile(rb"(?<=[ \n])[|/\\*~=+:;#<>-]+(?=[ \n])")
RUNS = re.compile(rb"(.)\1+")
DIGITS = b"0123456789"
NOT_LETTERS = bytes(set(range(128)) - set(range(65, 91)) - set(range(97, 123)))
UPPER = bytes(range(65, 91))


def vote(x: float, good: tuple[float, float], poor: tuple[float, float]) -> int:
    """1 if x is in good, 0 if it is outside poor, else -1 (abstains)."""
    return 1 if good[0] <= x <= good[1] else 0 if not poor[0] <= x <= poor[1] else -1


def votes(text: bytes) -> tuple[int, ...]:
    """Of the labellers: signs, repeated signs, lone signs, letters, word length, sentence length, repeated lines, variety, capitals, length."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * 10
    solid = sum(map(len, words))
    signs = len(SIGNS.findall(text)) / n
    letters = len(text.translate(None, NOT_LETTERS)) / solid
    digits = (len(text) - len(text.translate(None, DIGITS))) / solid
    stops = text.count(b".") + text.count(b"!") + text.count(b"?")
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines)
    variety = len(set(words)) / n
    capitals = (len(text) - len(text.translate(None, UPPER))) / solid
    return (
        vote(signs, (0, 0.05), (0, 0.3)),
        vote(len(REPEATED.findall(text)) / n, (0, 0.02), (0, 0.15)),
        vote(len(LONE.findall(text)) / n, (0, 0.02), (0, 0.15)),
        vote(letters - digits, (0.8, 1), (0.6, 1)),
        vote(solid / n, (3, 9), (2.2, 14)),
        vote(n / (stops + 1), (3, 40), (1.5, 90)),
        vote(again, (0, 0.1), (0, 0.4)) if len(lines) > 2 else -1,
        vote(variety, (0.3, 1), (0.12, 1)) if n >= 50 else -1,
        vote(capitals, (0, 0.1), (0, 0.3)),
        vote(n, (20, 10**9), (5, 10**9)),
    )


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """The posterior of good for each pattern, and each labeller's accuracy on poor and on good rows.

    Abstaining says nothing. The start: no vote against is good, one is open, two are poor.
    """
    if not patterns:
        return {}, np.zeros((0, 2))
    v, n = np.array(list(patterns)), np.array(list(patterns.values()), float)
    share = np.array([0.95, 0.4, 0.05])[np.minimum((v == 0).sum(axis=1), 2)]
    for _ in range(rounds):
        prior = np.clip((n * share).sum() / n.sum(), 0.01, 0.99)
        right = np.empty((v.shape[1], 2))
        for c, weight in ((0, n * (1 - share)), (1, n * share)):
            right[:, c] = (((v == c) * weight[:, None]).sum(axis=0) + 1) / (((v >= 0) * weight[:, None]).sum(axis=0) + 2)
        # a vote against never speaks for a row, so the classes keep their meaning
        right[:, 0] = np.maximum(right[:, 0], 1 - right[:, 1])
        for_good = np.where(v == 1, np.log(right[:, 1] / (1 - right[:, 0])), np.where(v == 0, np.log((1 - right[:, 1]) / right[:, 0]), 0))
        share = 1 / (1 + np.exp(-np.clip(for_good.sum(axis=1) + np.log(prior / (1 - prior)), -50, 50)))
    return dict(zip(patterns, share.tolist(), strict=True)), right


def features(word: bytes) -> tuple[int, int, int]:
    """Hashed places of a word, of its shape and of its last three bytes."""
    from xxhash import xxh32_intdigest

    shape = RUNS.sub(rb"\1", word.translate(SHAPE))
    last = 2**BITS - 1
    return xxh32_intdigest(b"w" + word.lower(), 3) & last, xxh32_intdigest(b"s" + shape, 3) & last, xxh32_intdigest(b"e" + word[-3:].lower(), 3) & last


def again() -> tuple[int, int, int]:
    """The places of a word that repeats the one before it."""
    from xxhash import xxh32_intdigest

    return (xxh32_intdigest(b"again", 3) & (2**BITS - 1),) * 3


SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def train(rows: list[tuple[bytes, float]], passes: int = 8, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of mean word features; rows are packed features and labels."""
    w, g, bias = np.zeros(2**BITS), np.full(2**BITS, 1e-6), 0.0
    order = np.random.default_rng(1)
    data = [(np.unique(np.frombuffer(f, np.int32), return_counts=True), p) for f, p in rows if f]
    for _ in range(passes):
        for i in order.permutation(len(data)):
            (at, c), p = data[i]
            x = 3 * c / c.sum()
            z = float(w[at] @ x) + bias
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - p
            step = error * x + 1e-5 * w[at]
            g[at] += step * step
            w[at] -= rate * step / np.sqrt(g[at])
            bias -= 0.02 * error
    return w, bias


class Scorer:
    """Scores of texts by the mean weight of their words, which are remembered; a word said again has its own."""

    def __init__(self, weights: np.ndarray, bias: float, remembered: int = REMEMBERED) -> None:
        self.bias, self.again = bias, float(weights[list(again())].sum())
        self.weight = Remembered(lambda words: weights[np.array([features(w.encode()) for w in words], np.int64).reshape(-1, 3)].sum(axis=1).tolist(), remembered)

    def score(self, texts: pa.Array) -> np.ndarray:
        names, at, begin = coded_words(texts)
        n = text_sums(np.array([bool(x) for x in names], np.int64)[at], begin)
        weight = (np.array(self.weight(names)) * np.array([bool(x) for x in names]))[at]
        said = np.r_[False, at[1:] == at[:-1]][: len(at)]
        said[begin[:-1][begin[:-1] < len(at)]] = False
        weight[said] = self.again
        z = text_sums(weight, begin) / np.maximum(n, 1) + self.bias
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def query(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, posterior, score and keep of every row of docs (columns doc_id, text).

    posterior is the weak label's; score the linear scorer's, 0 to 1, from all words of the text; keep is
    score >= 0.5. Null text and text without words score 0 and aren't kept. Vote patterns are counted over
    all rows; about training_rows rows, those with the smallest hash, train the scorer by TRAINING_WORDS
    words at most each, so what reaches the driver is bounded. Repeated rows give equal results; votes and
    scores read very long texts whole; an empty table gives an empty result.
    """
    rows = keyed(docs)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for b in batches:
            found.update(map(votes, b["_t"].cast(pa.binary()).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, p)) for p in found], pa.string()), pa.array(found.values(), pa.int64())], names=["pattern", "n"])

    bounded_batches(docs.sparkSession)
    counts = rows.select("_t").mapInArrow(tally, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    total = sum(r.n for r in counts)
    posterior, _ = estimate({tuple(map(int, r.pattern.split())): r.n for r in counts})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, once_more = Remembered(lambda words: map(features, words), REMEMBERED), again()
        for b in batches:
            out = []
            for text in b["_t"].cast(pa.binary()).to_pylist():
                words = text.split()
                different = [*dict.fromkeys(words)]
                found = dict(zip(different, places(different), strict=True))
                each = [once_more if x == y else found[x] for x, y in zip(words, [None, *words], strict=False)]
                out.append((np.array(each[:: -(-len(words) // TRAINING_WORDS) or 1], np.int32).tobytes(), posterior.get(votes(text), 0.5)))
            f, p = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), pa.array(p, pa.float64())], names=["f", "p"])

    share = min(1.0, training_rows / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64("_id", "_h", F.lit(3)), F.lit(2**31)) < share * 2**31)
    weights, bias = train(sorted((bytes(r.f), r.p) for r in sample.mapInArrow(pack, "f binary, p double").collect()))
    weights, name = weights.astype(np.float32), uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = process_wide(name, lambda: Scorer(weights, bias))
        for b in batches:
            p = [posterior.get(votes(t), 0.5) for t in b["_t"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array(p, pa.float64()), pa.array(scorer.score(b["_t"]))], names=["_id", "posterior", "score"])

    out = rows.mapInArrow(score, "_id long, posterior double, score double")
    return out.select(doc_id(), "posterior", "score", (F.col("score") >= 0.5).alias("keep"))
