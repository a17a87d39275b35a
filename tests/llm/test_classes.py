"""The class model against plain Python: exchange, gains, normalisation, scores."""

import collections
import math
import random

import numpy as np
import pytest

from spritespark.llm import lm_scoring as lm


def likelihood(bigrams, own):
    c = np.zeros((own.max() + 1,) * 2)
    np.add.at(c, (own[:, None], own[None, :]), bigrams)
    f = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return f(c) - f(c.sum(0)) - f(c.sum(1))


def test_exchange_never_loses_and_ends_where_no_move_gains():
    rng = np.random.default_rng(3)
    bigrams = rng.poisson(np.outer(rng.gamma(0.5, 3, 14), rng.gamma(0.5, 3, 14)))
    words, classes = 12, 4
    values = [likelihood(bigrams, lm.exchange(bigrams, words, classes, rounds)) for rounds in range(8)]
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:], strict=False)) and values[-1] > values[0]
    own = lm.exchange(bigrams, words, classes, 50)
    for w in range(words):
        for k in range(classes):
            moved = own.copy()
            moved[w] = k
            assert likelihood(bigrams, moved) <= likelihood(bigrams, own) + 1e-6


def test_gains_are_those_of_a_small_move():
    rng = np.random.default_rng(4)
    c = rng.integers(500, 5000, (5, 5)).astype(float)
    f = lambda x: float((x * np.log(x)).sum())
    value = lambda c: f(c) - f(c.sum(0)) - f(c.sum(1))
    table = lm.gains(c, 4)
    for before, after in ((0, 4), (2, 1), (4, 4)):
        got, want = [], []
        for k in range(4):
            more = c.copy()
            more[before, k] += 1
            more[k, after] += 1
            got.append(table[before, k] + table[5 + after, k])
            want.append(value(more) - value(c))
        assert np.allclose(np.array(got) - got[0], np.array(want) - want[0], atol=0.02)


def corpus():
    rng = random.Random(2)
    kinds = [[f"{c}{i}" for i in range(n)] for c, n in (("a", 12), ("b", 30), ("c", 80))]
    texts = [" ".join(rng.choice(kinds[k % 3][: rng.randint(1, len(kinds[k % 3]))]) for k in range(rng.randint(1, 60))) for _ in range(120)]
    return texts, [*texts[:20], "", "unseen words only", "a0 unseen b1 b2", "c79 c78 c77"]


@pytest.fixture(scope="module", params=[(12, 3, 25), (4, 2, 4), (1000, 60, 200_000)])
def trained(request, spark):
    seeds, classes, head = request.param
    texts, asked = corpus()
    rows = [(1000 + i, bytearray(t.encode()), False, True) for i, t in enumerate(texts)] + [(i, bytearray(t.encode()), i % 2 == 0, False) for i, t in enumerate(asked)]
    documents = spark.createDataFrame(rows, "doc_id long, text binary, held_out boolean, learn boolean").repartition(3)
    counts = lm.stored(lm.word_counts(documents.filter("learn").select("text")), "words")
    top = lm._top(counts, head)
    model = lm.train_classes(lm.encoded(documents, top[:, 0]).filter("learn"), top, counts, seeds, classes)
    return texts, asked, model, [r for r in lm.score_texts(documents, seeds, classes, head).collect() if r.doc_id < 1000]


def plain(texts, model):
    """class and count of every word, and the class bigrams, counted anew."""
    counts = collections.Counter(w for t in texts for w in t.encode().split())
    kind = dict(zip(model.head.tolist(), model.kinds.tolist(), strict=True)) | {r.key: r["class"] for r in model.rare.collect()}
    kind = {w: kind[lm._hash(w)] for w in counts}
    end = len(model.share)
    c = np.zeros((end + 1, end + 1))
    for t in texts:
        s = [end, *(kind[w] for w in t.encode().split()), end]
        for a, b in zip(s, s[1:], strict=False):
            c[a, b] += 1
    return counts, kind, c


def test_every_word_has_a_class_and_probabilities_sum_to_one(trained):
    texts, _, model, _ = trained
    counts, kind, c = plain(texts, model)
    assert kind.keys() == counts.keys()
    tokens, words = np.zeros(len(model.share)), np.zeros(len(model.share))
    for w, n in counts.items():
        tokens[kind[w]] += n
        words[kind[w]] += 1
    for before in range(len(model.share) + 1):
        total = 10.0 ** model.step[before, -1]
        for w, n in counts.items():
            total += 10.0 ** (model.step[before, kind[w]] + math.log10(n + 1) - model.share[kind[w]])
        total += 10.0 ** (model.step[before, model.unknown] - model.share[model.unknown])
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_scores_equal_plain_ones(trained):
    texts, asked, model, got = trained
    counts, kind, c = plain(texts, model)
    prior = np.array([c.sum(0)[k] + 1 if k == len(model.share) or k == model.unknown or k in kind.values() else 0 for k in range(len(c))])
    step = lambda a, b: math.log10((c[a, b] + 20 * prior[b] / prior.sum()) / (c[a].sum() + 20))
    sizes = collections.Counter(kind.values())
    tokens = collections.Counter()
    for w, n in counts.items():
        tokens[kind[w]] += n
    assert len(got) == len(asked)
    for r in got:
        at, score = len(model.share), 0.0
        for w in asked[r.doc_id].encode().split():
            k = kind.get(w, model.unknown)
            score += step(at, k) + math.log10((counts[w] + 1) / (tokens[k] + sizes[k] + (k == model.unknown)))
            at = k
        assert math.isclose(r.score, score + step(at, len(model.share)), rel_tol=1e-9)
