"""The sparse product against all pairs, on crafted groups: hot columns, chains, near copies of each other, small blocks."""

import random

import numpy as np
import pytest

from spritespark.llm import jaccard


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts):
    """texts: list of (doc_id, text); links between the rows of different words, by all pairs."""
    sets = {}
    for i, t in texts:
        if i is not None:
            sets.setdefault((frozenset(shingles(t)), " ".join((t or "").lower().split())), []).append(i)
    keys = [k for k in sets if k[0]]
    low = {k: min(sets[k]) for k in sets}
    links = [(a, b) for n, a in enumerate(keys) for b in keys[:n] if 100 * len(a[0] & b[0]) >= 80 * len(a[0] | b[0])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return [(i, len(shingles(t)), None if i is None else i if not shingles(t) else low[frozenset(shingles(t)), " ".join((t or "").lower().split())]) for i, t in texts]


def groups():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    common = "one line that every single text of this corpus holds at its end"
    out, at = [], 0

    def add(words):
        nonlocal at
        out.append((at, " ".join([*words, common])))
        at += 1

    for _ in range(25):  # clean texts
        add([word() for _ in range(rng.randint(5, 120))])
    base = [word() for _ in range(150)]
    for _ in range(70):  # one group of near copies, some of them too far from each other
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = word()
        add(w)
    chain = [word() for _ in range(200)]
    for k in range(30):  # each links to the next only
        add([*chain[4 * k :], *(f"c{k}-{j}" for j in range(8))])
    out += [(i, t) for i, t in out[30:40]] + [(200 + i, t) for i, t in out[20:60]]
    return out + [(3, "another text of a document that has one"), (None, out[30][1]), (None, "a text of no document at all"), (90, ""), (91, None), (92, "\t \n")]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_components_equal_those_of_all_pairs(spark, monkeypatch, small_blocks):
    if small_blocks:
        for name, n in (("BLOCK", 700), ("SIDE", 7), ("FEW", 3)):
            monkeypatch.setattr(jaccard, name, n)
    rows = groups()
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(components(rows), key=order)


def test_one_of_each_stays(spark):
    rows = groups()
    low = {(i, t): c for (i, t), (_, _, c) in zip(rows, components(rows), strict=True)}
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one_of_each(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, sig int")).collect()]
    want = {(i, t) for i, t in rows if i is None or low[i, t] == i}
    assert set(kept) == want and len(kept) == len(want)


def test_overlaps_are_those_of_the_sets():
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint64) for _ in range(40)] for _ in range(2))
    assert jaccard.overlaps(left, right).tolist() == [len(np.intersect1d(a, b)) for a, b in zip(left, right, strict=True)]
    assert jaccard.overlaps([], []).tolist() == []


def test_without_hot_groups_few_tables_are_broadcast(spark, monkeypatch):
    """Each broadcast costs the driver threads and memory: where no group is hot, only sets of ids are."""
    rows = [(i, t) for i, t in groups() if i is not None]
    calls, plain = [], jaccard.F.broadcast
    monkeypatch.setattr(jaccard.F, "broadcast", lambda df: calls.append(df.columns) or plain(df))
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(components(rows))
    assert len(calls) <= 12


def test_hot_groups_are_still_broadcast_and_equal(spark, monkeypatch):
    rows = [(i, t) for i, t in groups() if i is not None] + [(1000 + i, "the same six words each time") for i in range(40)]
    calls, plain = [], jaccard.F.broadcast
    monkeypatch.setattr(jaccard.F, "broadcast", lambda df: calls.append(df.columns) or plain(df))
    monkeypatch.setattr(jaccard, "SMALL", 1)
    monkeypatch.setattr(jaccard, "SIDE", 4)
    monkeypatch.setattr(jaccard, "PARTS", 3)
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(components(rows))
    assert any("hot" in c for c in calls)


def test_texts_without_links_between_components(spark):
    """No cross links: the labels of the first products stand."""
    rows = [(0, "a b c d e f g"), (1, "A b c d e f g"), (2, "h i j k l m n"), (3, ""), (4, None)]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 4)]
