import math
import random

import numpy as np

from pagewright.llm import weaklabel

SCHEMA = "doc_id long, text string"


def corpus(n=400):
    r = random.Random(6)
    words = [f"{a}{b}{c}" for a in ("the", "ing", "ran", "on") for b in ("er", "st", "al") for c in ("e", "y", "ed")]
    out = []
    for i in range(n):
        w = r.choices(words, k=r.randint(25, 90))
        if i % 4:
            text = ". ".join(" ".join(w[j : j + 9]).capitalize() for j in range(0, len(w), 9)) + "."
        else:
            text = " ".join(x + r.choice(["%%%", "$$$", "***", "###"]) for x in w)
        out.append((i, text))
    return out


def test_accuracies_are_recovered():
    r = np.random.default_rng(2)
    true, counts = r.random(20_000) < 0.7, {}
    right = [0.9, 0.75, 0.6, 0.8]
    v = np.stack([np.where(r.random(len(true)) < a, true, ~true) for a in right], 1).astype(int)
    v[r.random(v.shape) < 0.2] = -1
    for row in map(tuple, v.tolist()):
        counts[row] = counts.get(row, 0) + 1
    posterior, found = weaklabel.estimate(counts)
    assert np.abs(found.mean(axis=1) - right).max() < 0.06
    guess = np.array([posterior[t] > 0.5 for t in map(tuple, v.tolist())])
    assert (guess == true).mean() > 0.88


def test_held_out_quality(spark):
    rows = corpus()
    out = {r.doc_id: r for r in weaklabel.query(spark.createDataFrame(rows, SCHEMA), training_rows=150).collect()}
    assert np.mean([out[i].keep == bool(i % 4) for i, _ in rows]) > 0.98
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in out.values())


def test_edge_cases(spark):
    rows = [*corpus(40), (100, None), (101, ""), (None, "word " * 30_000), (102, "x"), (102, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", score int")
    out = weaklabel.query(docs).collect()
    assert len(out) == len(rows) and [(r.score, r.keep) for r in out if r.doc_id in (100, 101)] == [(0.0, False)] * 2
    assert weaklabel.query(docs.limit(0)).collect() == []


def slow_posterior(rows):
    """Expectation-maximisation row by row, in plain numbers."""
    v = [weaklabel.votes(t) for t in rows]
    q = [(0.95, 0.4, 0.05)[min(sum(x == 0 for x in r), 2)] for r in v]
    for _ in range(60):
        prior = min(max(sum(q) / len(q), 0.01), 0.99)
        right = []
        for j in range(10):
            on = [(sum(w for r, w in zip(v, side, strict=True) if r[j] == c) + 1) / (sum(w for r, w in zip(v, side, strict=True) if r[j] >= 0) + 2) for c, side in ((0, [1 - x for x in q]), (1, q))]
            right.append((max(on[0], 1 - on[1]), on[1]))
        q = []
        for r in v:
            z = math.log(prior / (1 - prior))
            for x, (poor, good) in zip(r, right, strict=True):
                z += math.log(good / (1 - poor)) if x == 1 else math.log((1 - good) / poor) if x == 0 else 0
            q.append(1 / (1 + math.exp(-min(max(z, -50), 50))))
    return q


def slow_scores(texts, labels):
    """A logistic scorer of the words' hashed features, trained and applied one feature at a time."""
    places = lambda t: [i for w, before in zip(t.split(), [None, *t.split()]) for i in (weaklabel.again() if w == before else weaklabel.features(w))]
    w, g, bias, order = {}, {}, 0.0, np.random.default_rng(1)
    data = sorted((np.array(places(t), np.int32).tobytes(), p, t) for t, p in zip(texts, labels, strict=True))
    data = [(places(t), p) for f, p, t in data if f]
    for _ in range(8):
        for k in order.permutation(len(data)):
            f, p = data[k]
            x = {i: 3 * f.count(i) / len(f) for i in set(f)}
            error = 1 / (1 + math.exp(-(sum(w.get(i, 0.0) * y for i, y in x.items()) + bias))) - p
            for i, y in x.items():
                step = error * y + 1e-5 * w.get(i, 0.0)
                g[i] = g.get(i, 1e-6) + step * step
                w[i] = w.get(i, 0.0) - 0.5 * step / math.sqrt(g[i])
            bias -= 0.02 * error
    return [1 / (1 + math.exp(-(sum(w.get(i, 0.0) for i in places(t)) / len(t.split()) + bias))) if t.split() else 0.0 for t in texts]


def test_equals_brute_force(spark):
    rows = [*corpus(90), (200, None), (201, "x"), (202, "Ünï %%% cödé " * 40)]
    texts = [(t or "").encode() for _, t in rows]
    got = {r.doc_id: r for r in weaklabel.query(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    posterior = slow_posterior(texts)
    for (d, _), p, s in zip(rows, posterior, slow_scores(texts, posterior), strict=True):
        assert abs(got[d].posterior - p) < 1e-6 and abs(got[d].score - s) < 1e-3


def test_scores_are_means_of_all_words():
    import pyarrow as pa

    w = np.zeros(2**weaklabel.BITS, np.float32)
    w[list(weaklabel.features(b"good"))] = 1
    s = weaklabel.Scorer(w, 0.0, remembered=1)
    first = s.score(pa.array(["good good, " * 25_000 + "bad", " good", "", "other words"]))  # the shape is that of good
    assert abs(first[3] - 1 / (1 + math.exp(-1))) < 1e-6
    assert 0.8 < first[0] < first[1] and first[2] == 0
    w[weaklabel.again()[0]] = -1
    z = lambda x: 1 / (1 + math.exp(-x))
    s = weaklabel.Scorer(w, 0.0)
    assert np.allclose(s.score(pa.array(["good good good", "good", "x good good"])), [z((3 - 3 - 3) / 3), z(3), z((1 + 3 - 3) / 3)])
