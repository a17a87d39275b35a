"""The operators against plain Python on the smallest given tables and on small fixtures."""

import collections
import hashlib
import math
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spritespark.llm import registry
from spritespark.llm.decontamination import BlockMaxIndex, contaminated
from spritespark.llm.packing import Packer, best_fill, pack_pieces
from spritespark.llm.pii import PLANTS, Selector, _written, planted, redact, train_selector, with_spans
from spritespark.llm.simhash import within_radius
from spritespark.llm.token_output import best_fit_decreasing, packed_matrix
from spritespark.llm.tokens import SPECIAL, encode
from tests.oracle import connection, same


@pytest.fixture(scope="module")
def documents(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, small, name):
    same(registry.queries()[name](spark, small), connection(small), registry.oracle_sql()[name])


def words(text):
    return text.encode().lower().split()


def test_jaccard_components(spark, small, documents):
    sets = {}
    for i, t in documents.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    near = collections.defaultdict(set)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                near[a].add(b)
                near[b].add(a)
    group = {}
    for i in ids:
        if i not in group:
            todo = [i]
            while todo:
                j = todo.pop()
                if group.setdefault(j, i) == i:
                    todo += [k for k in near[j] if k not in group]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.queries()["op10_jaccard"](spark, small).collect()}
    assert got == {i: (len(sets[i]), group[i]) for i in ids}


def test_base_language_model(spark, small, documents):
    tokens = lambda t: [*words(t), None]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in documents}
    c = collections.Counter(w for i, t in documents.items() if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = registry.queries()["op7_lm_scoring"](spark, small).collect()
    assert len(got) == len(documents)
    for r in got:
        w = tokens(documents[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, held[r.doc_id])
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def base_spans(s):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", s)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", s) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", s):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", s) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_on_random_texts(spark):
    rng = random.Random(3)
    texts = ["a@b.c_d@e.f x@y@z.com a.b@c", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111111111111111 4111111111111111", "1" * 5000, "a." * 4000 + "@", "a@" + "b." * 4000, "+1" + "(" * 900]
    texts += ["".join(rng.choice("a@.+1 4-(é") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in with_spans(df, Selector(None, {})).select("text", _written("base").alias("b")).collect():
        assert r.b == ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(r.text)), r.text


def test_personal_data(spark, small, documents):
    for r in registry.queries()["op6_pii"](spark, small).collect():
        base = [f"{k}:{s}:{e}" for k, s, e in base_spans(documents[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(","))
        assert r.n_phone == sum(x.startswith("phone") for x in base)


def test_obfuscated_addresses_and_phones_without_a_plus_are_redacted(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    number = lambda n: "".join(rng.choice("23456789") for _ in range(n))
    loose = [lambda: f"{word()} [at] {word()} [dot] com", lambda: f"{word()}(at){word()}(dot)org", lambda: f"{word()} @ {word()} . net", lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}"]
    base = [lambda: f"{word()}@{word()}.com", lambda: f"+1 ({number(3)}) {number(3)}-{number(4)}"]
    wrong = [lambda: f"{number(1)} @ {number(1)}.{number(2)}", lambda: f"{word()} @ {word()}. Then", lambda: f"(1{number(2)}) 0{number(2)}-{number(4)}", lambda: f"00{number(1)}-1{number(2)}-{number(4)}", lambda: f"{number(3)}.{number(3)}.{number(3)}.{number(3)}"]
    rows = [(i, kind, f"we saw {made} there {word()}", made) for i in range(200) for kind, makers in (("loose", loose), ("base", base), ("wrong", wrong)) for made in [m() for m in makers]]
    docs = spark.createDataFrame(rows, "doc_id long, kind string, text string, made string")
    selector = train_selector(docs)
    left = collections.Counter((r.kind, r.made in r.text) for r in redact(docs, selector).collect())
    assert left["loose", True] <= 0.03 * left["loose", False] and not left["base", True] and left["wrong", False] <= 0.03 * left["wrong", True], (left, selector.thresholds)


def test_loose_spans_are_redacted_in_a_table_of_few_rows(spark):
    docs = spark.createDataFrame([(i, f"ask ann{i} [at] mail [dot] com or ({200 + i}) 345-6789 not 3 @ 4.99") for i in range(60)], "doc_id long, text string").limit(15)
    for r in redact(docs, train_selector(docs)).collect():
        assert r.text == "ask [EMAIL] or [PHONE] not 3 @ 4.99"


def test_held_out_plants_are_told_apart(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    selector = train_selector(docs)
    texts = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("u", F.xxhash64("text", F.lit(99))).withColumn("v", F.lit(7))
    pass_at = "CASE " + " ".join(f"WHEN k = {k} THEN {x!r}D" for k, x in selector.thresholds.items()) + " ELSE 2D END"
    got = planted(texts, f"sequence(0, {len(PLANTS) - 1})").select("k", "label", F.expr(f"{selector.score} >= {pass_at}").alias("chosen")).groupBy("k").agg(
        F.avg(F.expr("CASE WHEN label = 1 THEN int(chosen) END")).alias("recall"), F.avg(F.expr("CASE WHEN chosen THEN label END")).alias("precision")).collect()
    assert len(got) == 4 and all(r.recall > 0.9 and r.precision > 0.9 for r in got), got


def test_very_many_matches_in_one_text(spark):
    n = 100_000
    docs = spark.createDataFrame([(0, "joe" + " ab@cd.ef," * n)], "doc_id long, text string")
    began = time.time()
    text = redact(docs, Selector("f[0]", {1: 0.5})).first().text
    assert text == "joe" + " [EMAIL]," * n and time.time() - began < 60


def test_fingerprints(spark, small, documents):
    got = {r.doc_id: r for r in registry.queries()["op8_simhash"](spark, small).collect()}
    ids = sorted(documents, reverse=True)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t, q = documents[i], len(documents[i]) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - q] + documents[j][:q]).encode()).hexdigest()
        assert got[i].n_chars == len(t)
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.97 * len(got)


def test_fingerprints_within_radius(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(128) for _ in range(30)]
    prints = base + [b ^ (1 << rng.randrange(128)) ^ (1 << rng.randrange(128)) for b in base for _ in range(4)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(p >> 64), signed(p & ((1 << 64) - 1))) for p in prints]
    got = {frozenset(((r.hi1, r.lo1), (r.hi2, r.lo2))) for r in within_radius(spark.createDataFrame(rows, "hi long, lo long").selectExpr("*", "1L AS rows")).collect()}
    both = dict(zip(rows, prints, strict=True))
    want = {frozenset((a, b)) for a in both for b in both if a < b and (both[a] ^ both[b]).bit_count() <= 3}
    assert got == want


def test_near_documents_are_counted(spark, tmp_path):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, base[i % 4] + " a" * (i // 4 % 3)) for i in range(24)] + [(0, base[0]), (None, base[1]), (None, base[1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["op8_simhash"](spark, str(tmp_path)).collect()
    assert sum(r.n_rows for r in got) == len(rows)
    for r in got:
        near = sum(s.n_rows for s in got if (int(r.fingerprint, 16) ^ int(s.fingerprint, 16)).bit_count() <= 3)
        assert r.n_near == near - 1, r
    assert any(r.n_near == 0 for r in got) and max(len({s.fingerprint for s in got if (int(r.fingerprint, 16) ^ int(s.fingerprint, 16)).bit_count() <= 3}) for r in got) > 1


@pytest.mark.parametrize("radius", [2, 3])
def test_hot_blocks_are_split_without_a_loss(spark, radius):
    rng = random.Random(9)
    one = rng.getrandbits(128)
    prints = sorted({one ^ (rng.getrandbits(40) << 50 if k % 2 else 0) ^ (1 << rng.randrange(128)) ^ (1 << rng.randrange(128)) for k in range(400)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(p >> 64), signed(p & ((1 << 64) - 1))) for p in prints]
    got = [frozenset(((r.hi1, r.lo1), (r.hi2, r.lo2))) for r in within_radius(spark.createDataFrame(rows, "hi long, lo long").selectExpr("*", "1L AS rows"), radius, hot=20).collect()]
    want = {frozenset((rows[a], rows[b])) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= radius}
    assert len(got) == len(set(got)) and set(got) == want


def test_block_max_wand_finds_all_above_the_threshold():
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary[: 10 + i % 50]) for _ in range(rng.randint(3, 30)))) for i in range(300)]
    for threshold in (0.2, 0.5, 0.8):
        index = BlockMaxIndex(items, threshold)
        for _ in range(60):
            terms = sorted({index.terms[w] for w in rng.sample(vocabulary, rng.randint(1, 30)) if w in index.terms})
            score = collections.Counter()
            for k in terms:
                for d, x in zip(index.docs[k], index.impacts[k], strict=True):
                    score[d] += x
            want = {d: x for d, x in score.items() if x >= threshold - 1e-9}
            got = dict(index.search(terms))
            assert got.keys() == want.keys() and all(math.isclose(got[d], want[d]) for d in got)


def test_planted_items_are_found(spark, small, documents):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in registry.queries()["op5_decontamination"](spark, small).collect()}
    want = {(d, i) for d, t in documents.items() for i, x in items.items() if x in t}
    assert want <= got and len(got) <= len(want) + 2


def test_ids_equal_those_of_the_tokenizers_library(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*list(documents.values())[:40], "", "  \n\t x", "é ü 你好 👍", f"a{SPECIAL}b", "a" * 300, "1234 56's don't\r\n\r\n"]
    for x in texts:
        assert encode(x).tolist() == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" " * 1_000_000, "\n" * 1_000_000, "x" * 100_000])
def test_long_runs_are_encoded(run):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert encode(f"a{run}b").tolist() == t.encode(f"a{run}b", add_special_tokens=False).ids


def test_long_runs_are_packed(spark):
    docs = spark.createDataFrame([(1, "a" + "\n" * 1_000_000 + "b"), (2, "c")], "doc_id long, text string")
    assert pack_pieces(docs).groupBy("doc_id").sum("length").count() == 2
    assert packed_matrix(docs).count() > 0


def test_blocks_of_items_change_no_score(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (sorted(map(tuple, contaminated(docs, items, 0.3, most).collect())) for most in (20_000, 7))
    assert len(one) > 0 and [r[:2] for r in one] == [r[:2] for r in many]
    assert all(math.isclose(a, b, abs_tol=1e-9) for x, y in zip(one, many, strict=True) for a, b in zip(x[2:5], y[2:5], strict=True))


def test_pieces_cover_every_document(spark, small, documents):
    got = registry.queries()["op9_packing"](spark, small).collect()
    of, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert of.keys() == documents.keys()
    for i, pieces in of.items():
        ids, at = encode(documents[i], 1), 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = ids[r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part.astype("<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and not at & (at - 1)


def test_best_fill_against_all_subsets():
    rng = random.Random(2)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        capacity = rng.randint(1, 60)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        counts = collections.Counter(items)
        chosen = best_fill(counts, capacity)
        assert sum(n * k for n, k in chosen) == max(s for s in sums if s <= capacity)
        assert all(k <= counts[n] for n, k in chosen)


def test_packer_wastes_nothing():
    rng = random.Random(4)
    p = Packer(0, 64, 50)
    sizes = [rng.randint(1, 200) for _ in range(500)]
    for i, n in enumerate(sizes):
        p.add(i, np.arange(n, dtype=np.uint32))
    p.end()
    fill = collections.Counter()
    for r in p.rows:
        fill[r[5]] += r[2]
    assert sum(fill.values()) == sum(sizes) and all(not n & (n - 1) and n <= 64 for n in fill.values())


def test_matrix_round_trip(spark, small, documents):
    back = collections.defaultdict(dict)
    for r in registry.queries()["op4_token_output"](spark, small).collect():
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(positions) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 2048
        for k, (d, s) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            a, b = r.cu_seqlens[k : k + 2]
            back[d][s] = ids[a:b]
            assert positions[a:b].tolist() == list(range(b - a))
    for i, t in documents.items():
        assert np.concatenate([back[i][s] for s in sorted(back[i])]).tolist() == encode(t, 50_256).tolist()


def test_best_fit_decreasing_takes_the_tightest_bin():
    rng = random.Random(6)
    for _ in range(100):
        lengths, capacity = [rng.randint(1, 50) for _ in range(rng.randint(0, 60))], 50
        free: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, f in enumerate(free) if f >= n]
            if fits:
                free[min(fits, key=lambda i: free[i])] -= n
            else:
                free.append(capacity - n)
        bins = best_fit_decreasing(lengths, capacity)
        assert sorted(capacity - sum(lengths[i] for i in b) for b in bins) == sorted(free)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))


@pytest.mark.parametrize(("name", "label", "fold", "least"), [("op1_quality", "quality", (5, 0), 0.9), ("op2_toxicity", "toxic", (3, 1), 0.85)])
def test_held_out_ranking(spark, small, name, label, fold, least):
    large = Path(small).parent / "sf0.1"  # the smallest table has five toxic texts held out
    if not large.exists():
        pytest.skip("no larger tables")
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    got = registry.queries()[name](spark, str(large)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1]) and 0 <= r.score <= 1 for r in got)
    pairs = [(r.score, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > least


def test_an_unrelated_long_item_changes_no_other_match(spark):
    rng = random.Random(21)
    words = [f"v{i}" for i in range(4000)]
    item = " ".join(rng.choice(words) for _ in range(30)) + ". " + " ".join(rng.choice(words) for _ in range(10)) + "."
    own = item.replace(".", "").split()
    scattered = [rng.choice(words) for _ in range(7000)]
    for k in range(3):
        at = 1000 + 2500 * k
        scattered[at : at + len(own[k * 14 : k * 14 + 14])] = own[k * 14 : k * 14 + 14]
    long = " ".join(f"u{rng.randrange(3000)}" for _ in range(5000))
    docs = spark.createDataFrame([(1, " ".join(scattered)), (2, f"{' '.join(scattered[:500])} {item} end"), (3, f"x {long} y")], "doc_id long, text string")
    for items, want in (([(7, item)], {(2, 7)}), ([(7, item), (8, long)], {(2, 7), (3, 8)})):
        got = contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want


@pytest.mark.parametrize("shape", [lambda i: "example.com" if i % 2 else f"h{i}.org", lambda i: f"s{i}.example.com" if i % 2 else f"h{i}.org"])
def test_captures_of_a_hot_domain_are_dealt_out(spark, shape):
    import datetime

    from spritespark.llm.url_filters import active_entries

    at = datetime.datetime(2024, 1, 1)
    rows = [(i, f"https://{shape(i)}/p", at + datetime.timedelta(days=i % 60)) for i in range(8000)]
    entries = [("spam", "example.com", "add", at + datetime.timedelta(days=3), 1), ("spam", "example.com", "remove", at + datetime.timedelta(days=40), 2), ("bad", "h4.org", "add", at, 3)]
    df = active_entries(spark.createDataFrame(rows, "page_id long, url string, fetched timestamp"), spark.createDataFrame(entries, "category string, pattern string, action string, at timestamp, seq long"))
    got = {r.page_id: (r.n_active, r.categories, r.pattern) for r in df.collect()}
    for i, url, t in rows:
        want = (1, "spam", "example.com") if i % 2 and 3 <= i % 60 < 40 else (1, "bad", "h4.org") if i == 4 else (0, "", "")
        assert got[i] == want, (i, url, t)


def test_rows_of_a_hot_key_are_dealt_to_parts(spark):
    from spritespark.llm import common

    rows = common.stored(spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("row")), "rows")
    others = common.stored(spark.createDataFrame([(-1, "a"), (-1, "b"), (3, "c"), (4, "d")], "k long, v string"), "others")
    out = common.joined_in_parts(rows, others, ["k"], ["row"])
    got = out.collect()
    assert len(got) == 20_001 and len(set(got)) == 20_001 and {r.v for r in got if r.k == -1} == {"a", "b"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = common.joined_in_parts(rows, others, ["k"], ["row"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = sorted(r["count"] for r in spread)
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_the_most_frequent_words_stop_at_the_first_class_that_does_not_fit(spark):
    from spritespark.llm.lm_scoring import _top

    counts = lambda *sizes: spark.createDataFrame([(100 * k + j, n) for k, (n, words) in enumerate(sizes) for j in range(words)], "key long, n long")
    assert [_top(c, 10)[:, 1].tolist() for c in (counts((5, 50), (3, 3), (9, 1)), counts((2, 50), (1, 1)), counts((9, 2), (4, 8), (1, 1)), counts((7, 0)))] == [[9], [], [9, 9] + [4] * 8, []]
