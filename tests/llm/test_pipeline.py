"""Each stage of the pipeline against plain Python on its own input."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spritespark.llm.tokens import encode
from tests.llm.test_brute_force import base_spans


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    d = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(f"{d}/{name}")
        after = spark.read.parquet(f"{d}/{name}")
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_quality_drops_rejected_documents_only(spark, small, stages):
    before, after = stages["quality"]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert all(r in before for r in after)
    good = [r.doc_id for r in before if label.get(r.doc_id) == 1]
    bad = [r.doc_id for r in before if label.get(r.doc_id) == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    sets = {}
    for r in before:
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    assert sorted(r.doc_id for r in after) == sorted(i for i in sets if low[i] == i)


def test_leaks_go(spark, small, stages):
    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in before if not any(x in r.text for x in items)}
    kept = {r.doc_id for r in after}
    assert kept <= clean and len(clean - kept) <= 1


def test_personal_data_is_replaced(stages):
    before, after = stages["personal_data"]
    new = {r.doc_id: r for r in after}
    assert len(before) == len(after)
    for r in before:
        out, at = [], 0
        spans = sorted((s, e, k) for k, s, e in base_spans(r.text))
        for s, e, k in spans:
            out += [r.text[at:s], f"[{k.upper()}]"]
            at = e
        want = "".join(out) + r.text[at:]
        assert new[r.doc_id].text == want or len(re.findall(r"\[(EMAIL|IP|CARD|PHONE)\]", new[r.doc_id].text)) > len(spans)
        assert new[r.doc_id].n_chars == len(new[r.doc_id].text)


def test_pieces_cover_what_is_left(stages):
    before, after = stages["packing"]
    for r in before:
        ids, at = encode(r.text, 1), 0
        for p in sorted((p for p in after if p.doc_id == r.doc_id), key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].astype("<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_run_gives_the_last_stage(spark, small, stages):
    got = corpus_pipeline.run(spark, small)
    assert got.agg(F.sum("length")).first()[0] == sum(r.length for r in stages["packing"][1])
