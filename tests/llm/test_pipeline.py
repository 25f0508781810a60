from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
from helpers import DATA

sys.path.insert(0, str(Path(__file__).parent))
from test_decontamination import plain_matches
from test_minhash import plain_components, plain_sets
from test_packing import hf, plain_bfd
from test_substring_dedup import plain

import corpus_pipeline
from quire.llm import language_id


def test_stages_match_plain_versions_one_after_another(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]

    told = {r["doc_id"] for r in language_id.identify(docs, language_id.train(docs)).collect() if r["lang_pred"] != "und" and r["score"] >= language_id.LEAST_SCORE}
    one = stages["language_id"](spark, docs, DATA)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == told and len(told) > 0.98 * docs.count()

    rows = sorted((r["doc_id"], r["text"]) for r in one.collect())
    of = plain_components(plain_sets([t for _, t in rows]))
    rows = [r for i, r in enumerate(rows) if of[i] == i]
    two = stages["simhash_near_dedup"](spark, one, DATA)
    assert two.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in two.collect()) == rows

    kept = plain(rows, 50)
    rows = [(d, t if not kept[d][1] else kept[d][3]) for d, t in rows if kept[d][3] or not kept[d][1]]
    three = stages["substring_dedup"](spark, two, DATA)
    assert three.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in three.collect()) == rows
    assert all(r["n_chars"] == len(r["text"]) for r in three.collect())

    leaks = {d for d, *_ in plain_matches(rows, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])}
    rows = [r for r in rows if r[0] not in leaks]
    four = stages["benchmark_decontamination"](spark, three, DATA)
    assert leaks and four.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in four.collect()) == rows

    lengths = [len(hf(t)) + 1 for _, t in rows]
    packed = stages["best_fit_packing"](spark, four, DATA).collect()
    assert sum(r["length"] for r in packed) == sum(lengths)
    assert len({r["sequence_id"] for r in packed}) == len(plain_bfd([n for x in lengths for n in ([x % 2048] if x % 2048 else []) + [2048] * (x // 2048)], 2048))
    ran = corpus_pipeline.run(spark, DATA).collect()
    key = lambda rs: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rs)
    assert key(ran) == key(packed)
    assert np.isfinite(len(ran))


def test_empty_and_messy_documents_pass_through(spark, messy, no_docs):
    for docs in (no_docs, messy):
        out = docs
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, DATA)
        assert (out.count() == 0) == (docs is no_docs)
