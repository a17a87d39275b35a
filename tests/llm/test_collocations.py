"""Phrase mining and its scores against plain counting."""

import itertools
import random
import re
from collections import Counter

import pytest

from spritespark.llm import collocations as c


def plain(rows, least, longest):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, " ".join(w[i : i + k])] = counts.get((lang, " ".join(w[i : i + k])), 0) + 1
    return {x: n for x, n in counts.items() if n >= least}, {k: n for k, n in sizes.items() if n}


def scored(frequent, sizes, most):
    out = []
    for lang in sizes:
        own = {p: n for (g, p), n in frequent.items() if g == lang}
        kept = []
        for p, a in own.items():
            w = p.split(" ")
            if len(w) < 2 or any(f" {p} " in f" {q} " and len(q.split(" ")) > len(w) and 100 * b >= 50 * a for q, b in own.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (own[" ".join(w[:k])] * own[" ".join(w[k:])]), k, own[" ".join(w[:k])], own[" ".join(w[k:])]) for k in range(1, len(w)))
            kept.append((-score, -a, p.encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, sizes[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(kept)[:most], 1)]
    return out


def some_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["of", "The", "the", "é", "x\x1cy", "a-b", "'s", "zz", "\x85", "日本"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", " , "]) for _ in range(rng.randint(0, 40)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, " .\n"), ("en", "to be or not " * 300), ("de", "q" * 5000), *[("fr", "same text here")] * 12]


@pytest.mark.parametrize("share, lowered, longest", [(0.25, None, 3), (0.0, 1, 3), (0.5, 40, 3), (1.0, 1, 4)])
def test_frequent_phrases_and_scores(spark, share, lowered, longest):
    rows = some_rows(longest + int(share * 4))
    docs = spark.createDataFrame([(i if i % 7 else None, lang, text, "own", 1) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, key string, n int")
    got = c.stored(c.frequent_phrases(docs, 10, longest, share, lowered), "phrases")
    frequent, sizes = plain(rows, 10, longest)
    found = {(r.lang, r.phrase): r.n for r in got.collect() if r.words}
    assert found == frequent and {r.lang: r.n for r in got.collect() if not r.words} == sizes
    assert sorted(tuple(r) for r in c.collocations(got, most=15).collect()) == sorted(scored(frequent, sizes, 15))


def test_failures_of_the_border_are_made_up_for(spark):
    docs = spark.createDataFrame([(i, "en", "new york city and the rest") for i in range(30)], "doc_id long, lang string, text string")
    got = c.frequent_phrases(docs, share=0.0, longest=4)  # nothing is proposed: the first pass counts words alone
    assert {r.words: r["count"] for r in got.groupBy("words").count().collect()} == {0: 1, 1: 6, 2: 5, 3: 4, 4: 3}


def counted(rows, longest, count):
    stream, got = c.Stream(longest), Counter()
    blocks = lambda: itertools.chain(*(stream.read(lang, t.encode()) for lang, t in rows), stream.block())
    for ids, begins in blocks():
        for b in count(stream, ids, begins):
            for key, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got[key] += n
    return got


def test_blocks_of_a_long_text_overlap_by_a_phrase(monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 50)
    monkeypatch.setattr(c, "BYTES", 20)
    monkeypatch.setattr(c, "REMEMBERED", 5)
    full = c.Filter(~c.Filter().bits)
    rows = [(lang or "und", t or "") for lang, t in some_rows(9)]
    frequent, sizes = plain(rows, 1, 3)
    assert counted(rows, 3, lambda *x: c.phrase_counts(*x, full, full)) == Counter({f"{p}\n{lang}": n for (lang, p), n in frequent.items()} | {f"\n{lang}": n for lang, n in sizes.items()})
    assert sorted(counted(rows, 3, lambda *x: c.hash_counts(*x, full)).values()) == sorted(frequent.values())


def test_scores_beyond_64_bits(spark):
    big = 10**13
    rows = [("en", "a b", 2, big - 1), ("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "", 0, 10**15)]
    phrases = c.stored(spark.createDataFrame(rows, "lang string, phrase string, words int, n long"), "phrases")
    r = c.collocations(phrases).first()
    assert (r.score, r.l, r.r, r.n, r.rank) == (10**6 * (big - 1) ** 2 // (big * (big + 7)), big, big + 7, 10**15, 1)
