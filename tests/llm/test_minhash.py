from __future__ import annotations

import random
import sys
from pathlib import Path

from helpers import DATA
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_simhash import plain_components as plain_fingerprint_components

import corpus_pipeline
from quire.llm import minhash, simhash


def plain_sets(texts):
    words = [(t or "").lower().split() for t in texts]
    return [{" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words]


def plain_components(sets):
    """Index -> smallest index reachable over all pairs of Jaccard 0.8 or more."""
    of = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if of[i] != of[j] and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    return of


def test_stage_matches_brute_force_jaccard(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    of = plain_components(plain_sets([t for _, t in rows]))
    assert any(c != i and rows[c][1] != rows[i][1] for i, c in enumerate(of))  # edited copies, not only exact ones
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = stage(spark, docs, DATA)
    assert got.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in got.collect()) == [r for i, r in enumerate(rows) if of[i] == i]


def test_chains_and_large_groups_match_brute_force(spark):
    r = random.Random(3)
    texts = []
    for n in (6, 30, 120):
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        for _ in range(60):  # each an edit of an earlier one: neighbours are alike, the ends of a chain aren't
            base = list(base)
            base[r.randrange(n)] = f"w{r.randrange(10**6)}"
            texts.append(" ".join(base))
        texts += [" ".join([*base[:-1], f"end{i}"]) for i in range(60)]  # a star of near copies
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[i] for i in order]
    of = plain_components(plain_sets(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"] for x in minhash.one_of_each_group(docs).collect()} == set(of)


def test_sketches_exclude_no_pair_of_the_similarity(spark):
    r = random.Random(5)
    least, far = [], []
    for _ in range(300):
        words = [f"w{r.randrange(10**6)}" for _ in range(300)]
        other = [*words[:-33], *(f"x{r.randrange(10**6)}" for _ in range(33))]  # 263 of 296 shingles: Jaccard 0.8
        least.append(sum(a == b for a, b in zip(*(minhash.sketch(minhash.minima(minhash.shingles(" ".join(w).encode()))) for w in (words, other)), strict=True)))
        other = [*words[:-120], *(f"x{r.randrange(10**6)}" for _ in range(120))]  # Jaccard 0.42
        far.append(sum(a == b for a, b in zip(*(minhash.sketch(minhash.minima(minhash.shingles(" ".join(w).encode()))) for w in (words, other)), strict=True)))
    assert min(least) >= minhash.AGREE and sum(x >= minhash.AGREE for x in far) <= 3


def test_parts_of_a_large_bucket_give_the_same_groups(spark, monkeypatch):
    r = random.Random(7)
    base = [f"w{r.randrange(10**6)}" for _ in range(40)]
    texts = [" ".join([*base[:at], f"e{i}", *base[at + 1 :]]) for i, at in ((i, r.randrange(40)) for i in range(150))]
    of = plain_components(plain_sets(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(minhash, "MOST", 20)
    assert {x["doc_id"] for x in minhash.one_of_each_group(docs).collect()} == set(of)


def test_messy_rows(messy, no_docs):
    kept = minhash.one_of_each_group(messy)
    assert kept.columns == messy.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None) == sorted({(r["doc_id"], r["text"]) for r in messy.collect() if r["doc_id"] in (1, 2, 5, 7, 8, -9)}, key=lambda x: (x[0], x[1] or ""))
    assert minhash.one_of_each_group(no_docs).count() == 0


def test_simhash_links_are_candidates_without_minhash(spark, monkeypatch):
    r = random.Random(11)
    texts = []
    for _ in range(8):
        base = [f"w{r.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(base), *(" ".join([*base[:at], f"e{i}", *base[at + 1 :]]) for i, at in enumerate(r.sample(range(400), 6)))]
    fps = [simhash.majority(minhash.shingles(t.encode())) for t in texts]
    of = plain_fingerprint_components(fps)
    assert sum(c != i for i, c in enumerate(of)) > 10  # edits within three bits
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = minhash.distinct_sets(minhash.signatures(docs))
    ids = {r["fp"]: r["first"]["doc_id"] for r in nodes.collect()}
    linked = spark.createDataFrame([(ids[r["fp"]], ids[r["to"]]) for r in minhash.simhash_pairs(minhash.materialize(nodes, "nodes")).collect()], "fp long, to long")
    assert dict(simhash.components(linked).collect()) == {i: c for i, c in enumerate(of) if of.count(c) > 1}
    none = lambda rows, *_: rows.select("fp", F.col("fp").alias("to")).where("false")
    monkeypatch.setattr(minhash, "star_pairs", none)
    monkeypatch.setattr(minhash, "links_within", none)
    kept = {x["doc_id"] for x in minhash.one_of_each_group(docs).collect()}
    assert set(range(0, 56, 7)) <= kept and len(kept) < len(texts) - 10
