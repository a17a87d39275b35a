"""Token counts against the tokenizers library on whole texts."""

import random

import pytest
from tokenizers import Tokenizer

from spritespark.llm import registry
from spritespark.llm.common import most_frequent, vocabulary_path
from spritespark.llm.token_counts import FAMILIAR, _pattern, blocks, count_tokens, parts_of
from spritespark.llm.tokens import SPECIAL


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


def tokens(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_the_written_out_classes_are_the_librarys(library):
    for cp in range(FAMILIAR):
        c = chr(cp)
        s = f"a{c}1{c}{c}b {c} {c}{c}  {c}'s{c}"
        assert [s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)] == _pattern().findall(s), hex(cp)


def test_blocks_cut_only_between_pre_tokens(library):
    rng = random.Random(5)
    for _ in range(500):
        s = "".join(rng.choice("ab 1\n\t 's'ré.,²漢ж") for _ in range(60)).replace("|", "")
        assert "".join(blocks(s, 7)) == s
        assert sum(tokens(library, p) for b in blocks(s, 7) for part in parts_of(b) for p in part) == tokens(library, s)


@pytest.mark.parametrize("hot", [0, 3, 200_000])
def test_counts_are_those_of_whole_texts(spark, library, hot):
    rng = random.Random(hot)
    texts = ["", None, "word", f"a{SPECIAL}{SPECIAL} b", f"{SPECIAL[:-1]} x", "y" * 30_000, "漢字 kana かな ١٢", "a  b \n\n c\x1c\x85d", " lead", "trail  ", "x " * 40_000, "the same", "the same"]
    texts += ["".join(rng.choice("ab cdé 1,\n'st—") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    texts += [" ".join(f"rare{i}" for i in range(9_000))]
    rows = [(i if i != 5 else None, t, "own", "own") for i, t in enumerate(texts)]
    rows.append(rows[2])
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, n_tokens string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, hot=hot).collect())
    want = [(i if i is not None else -1, len((t or "").encode()), tokens(library, t or "")) for i, t, _, _ in rows]
    assert got == sorted((*w, w[2] > 1024) for w in want)


def test_whole_table(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = registry.queries()["op13_token_counts"](spark, small).collect()
    assert len(got) == len(texts) and all(r.n_tokens == tokens(library, texts[r.doc_id]) for r in got)


def test_no_more_than_the_bound_is_broadcast(spark):
    counts = spark.createDataFrame([(f"p{i}", 9 if i < 1 else 5 if i < 4 else 3 if i < 54 else 1) for i in range(60)], "piece string, n long")
    assert [most_frequent(counts, m).count() for m in (0, 1, 3, 4, 10, 54, 60)] == [0, 1, 1, 4, 4, 54, 60]
