"""Each stage of the pipeline against brute force on what it was given."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline
from lakelens.llm import toxicity
from tests.conftest import SF01
from tests.llm.test_near_and_spans import brute_components


def test_stages_are_the_dealt_ones_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "decontamination", "packing"]


def test_every_stage_equals_brute_force(spark):
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("labels", "benchmark"))

    kept = stage["toxicity"](spark, docs, SF01).cache()
    assert kept.columns == docs.columns
    toxic = {r.doc_id for r in toxicity.severities(docs, labels).collect() if r.toxic}
    assert toxic and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - toxic

    once = stage["exact_dedup"](spark, kept, SF01).cache()
    assert once.columns == docs.columns
    groups = defaultdict(list)
    for r in kept.collect():
        groups[r.text.encode().lower()].append(r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(map(max, groups.values()))

    apart = stage["ngram_jaccard"](spark, once, SF01).cache()
    assert apart.columns == docs.columns
    components = brute_components([(r.doc_id, r.text) for r in once.collect()], 5, 80)
    assert sorted(r.doc_id for r in apart.collect()) == sorted({c for _, _, c in components})

    clean = stage["decontamination"](spark, apart, SF01).cache()
    assert clean.columns == docs.columns
    passages = [" " + " ".join(r.text.lower().split()) + " " for r in items.collect()]
    holds = {r.doc_id for r in apart.collect() if any(p in " " + " ".join(r.text.lower().split()) + " " for p in passages)}
    gone = {r.doc_id for r in apart.collect()} - {r.doc_id for r in clean.collect()}
    assert holds and holds <= gone and len(gone) <= 1.2 * len(holds) + 2

    pieces = stage["packing"](spark, clean, SF01).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in clean.collect()}
    whole = defaultdict(int)
    for p in pieces:
        whole[p.doc_id, p.doc_tokens] += p.length
    assert all(n == tokens for (_, tokens), n in whole.items())

    final = corpus_pipeline.run(spark, SF01)
    assert sorted({r.doc_id for r in final.collect()}) == sorted({r.doc_id for r in clean.collect()})


def test_copies_with_one_id_and_null_ids(spark, odd, empty):
    once = corpus_pipeline.drop_copies(spark, odd, SF01)
    assert once.columns == odd.columns
    groups = defaultdict(list)
    for r in odd.collect():
        groups[(r.text or "").encode().lower()].append(r.doc_id)
    top = [max((d for d in g if d is not None), default=None) for g in groups.values()]
    assert sorted((r.doc_id for r in once.collect()), key=str) == sorted(top, key=str)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF01).count() == 0
        assert stage(spark, odd, SF01).count() > 0
