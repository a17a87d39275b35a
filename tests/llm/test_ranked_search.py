"""Ranked search against scoring every document."""

import collections
import math
import random
import re

import numpy as np
import pytest

from spritespark.llm import ranked_search as r


def random_part(rng, n, terms, levels):
    ids = np.array(rng.sample(range(10 * n), n), np.int64)
    postings, score = {}, collections.defaultdict(dict)
    for t in range(terms):
        places = sorted(rng.sample(range(n), rng.randint(1, n)))
        impacts = [rng.randint(0, levels) for _ in places]
        postings[t] = np.array(places, np.int32), np.array(impacts, np.int64)
        for p, x in zip(places, impacts, strict=True):
            score[t][p] = x
    return r.Part(ids, postings), ids, score


@pytest.mark.parametrize("levels", [1, 3, 1000])
def test_search_of_a_part(levels, monkeypatch):
    rng = random.Random(levels)
    for n in [1, 2, 3, 7, 64, 300]:
        for split in (1, 4, 128):
            monkeypatch.setattr(r, "SPLIT", split)
            part, ids, score = random_part(rng, n, 6, levels)
            for most, floor in ((1, 1), (5, 1), (400, 1), (5, 2 * levels)):
                terms = rng.sample(range(8), 4)
                want = sorted((-sum(score[t].get(p, 0) for t in terms), int(ids[p])) for p in range(n))
                want = [(-s, d) for s, d in want if -s >= floor][:most]
                got, scored = part.search(terms, most, floor)
                assert got == want and scored <= n


def test_few_documents_are_scored_and_equal_copies_end_early():
    rng = np.random.default_rng(1)
    n = 20_000
    impacts = [rng.integers(1, 1000, n) for _ in range(3)]
    everywhere = np.arange(n, dtype=np.int32)
    part = r.Part(np.arange(n), {t: (everywhere, np.sort(x)) for t, x in enumerate(impacts)})
    assert part.search([0, 1, 2], 10)[1] < 2_000
    part = r.Part(np.arange(n), {0: (everywhere, np.full(n, 7))})
    found, scored = part.search([0], 10)
    assert found == [(7, i) for i in range(10)] and scored < 1_000


def plain(docs, items, best):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(own), sum(c.total() for _, c in own)
    df = collections.Counter(w for _, c in own for w in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in own:
            m = 50 + 50 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:best], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("most, postings, first", [(10_000, 1_000_000, 20_000), (3, 40, 20), (1, 1, 0)])
def test_all_queries(spark, monkeypatch, most, postings, first):
    monkeypatch.setattr(r, "POSTINGS", postings)
    rng = random.Random(most)
    words = ["the", "The", "of", "é", "naïve", "x1", "日本", "y\x85z", "rare"] + [f"w{i}" for i in range(30)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "_"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(100)] + [(200, None), (201, ""), (None, text(9)), (None, "the rare w1"), (300, "the " * 5000)]
    docs += [(400 + i, "same w3 w4 text") for i in range(30)] + [docs[0], docs[0]]
    items = [(1, "same w3"), (1, "same w3"), (1, "other rare"), (2, None), (3, ""), (None, "é w5"), (4, "nowhere"), (5, text(20)), (6, "W1 w1 rare")]
    got = r.ranked(
        spark.createDataFrame([(*d, "own", 1) for d in docs], "doc_id long, text string, term string, size int"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int"),
        20, most, 10**6, first,
    )
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, 20)


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = ("Some words, ünd më " * 50 + "x" * 300 + "!y ").encode()
    whole = collections.Counter(r.words_of(text))
    monkeypatch.setattr(r, "BYTES", 10)
    assert r.term_counts(text) == whole
