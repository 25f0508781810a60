from __future__ import annotations

import random

import pytest
from helpers import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import decontamination as d


def least_edits(pattern, text, anchored=False):
    """(distance, first end) by the full table."""
    row = list(range(len(pattern) + 1))
    best = (len(pattern), 0)
    for at, symbol in enumerate(text, 1):
        last, row[0] = row[:], at if anchored else 0
        for i, p in enumerate(pattern, 1):
            row[i] = min(last[i - 1] + (p != symbol), last[i] + 1, row[i - 1] + 1)
        if row[-1] < best[0]:
            best = (row[-1], at)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=70), st.lists(st.integers(0, 3), max_size=90), st.booleans())
def test_bit_vectors_match_the_table(pattern, text, anchored):
    masks = {}
    for i, p in enumerate(pattern):
        masks[p] = masks.get(p, 0) | 1 << i
    assert d.myers(masks, len(pattern), text, anchored) == least_edits(pattern, text, anchored)


@pytest.mark.parametrize(("m", "k"), [(5, 1), (50, 10), (7, 0), (10, 9)])
def test_pieces_cover_and_none_is_empty(m, k):
    bounds = d.piece_bounds(m, k)
    assert len(bounds) == k + 1 and bounds[0][0] == 0 and bounds[-1][1] == m
    assert all(a < b for a, b in bounds) and all(x[1] == y[0] for x, y in zip(bounds, bounds[1:], strict=False))


def plain_matches(docs, items):
    out = set()
    for doc_id, text in docs:
        words = (text or "").encode().lower().split()
        for item_id, item in items:
            own = (item or "").encode().lower().split()
            if not own:
                continue
            distance, _ = least_edits(own, words)
            if distance <= int(d.ERROR_RATE * len(own)):
                out.add((doc_id, item_id, distance))
    return out


def test_matches_a_scan_of_all_pairs(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 40)))) for i in range(25)] + [(98, "w1 w2"), (99, None), (97, " ")]
    docs = [(1000, "W1   w2")]
    for n in range(150):
        words = r.choices(vocabulary, k=r.randint(0, 80))
        if n % 2:
            planted = r.choice(items[:25])[1].split()
            for _ in range(r.randint(0, 8)):
                at = r.randrange(len(planted) + 1)
                planted[at : at + r.randint(0, 1)] = r.choices(vocabulary, k=r.randint(0, 1))
            words[len(words) // 2 : len(words) // 2] = planted
        docs.append((n, " ".join(words)))
    found = d.find_items(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x["doc_id"], x["item_id"], x["distance"]) for x in found.collect()} == plain_matches(docs, items)
    blocks = d.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=100)
    assert sorted(blocks.collect()) == sorted(found.collect())


def test_found_stretch_has_the_distance(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts, items = {x["doc_id"]: x["text"] for x in docs.collect()}, {x["item_id"]: x["text"] for x in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    rows = d.op7_benchmark_decontamination(spark, DATA).collect()
    assert {(x["doc_id"], x["item_id"], x["distance"]) for x in rows} == plain_matches(texts.items(), items.items())
    for x in rows:
        stretch = texts[x["doc_id"]].encode().lower().split()[x["first_word"] : x["end_word"]]
        item = items[x["item_id"]].encode().lower().split()
        table = list(range(len(item) + 1))
        for at, symbol in enumerate(stretch, 1):
            last, table[0] = table[:], at
            for i, p in enumerate(item, 1):
                table[i] = min(last[i - 1] + (p != symbol), last[i] + 1, table[i - 1] + 1)
        assert table[-1] == x["distance"] and len(item) == x["item_words"]


def test_messy_rows(spark, messy, no_docs):
    items = spark.createDataFrame([(1, "cat sat on the mat and looked"), (1, "cat sat on the mat and looked"), (None, "another text under the same id"), (2, None), (3, ""), (4, "x")], "item_id long, text string")
    found = sorted((x["doc_id"] or 0, x["item_id"] or 0) for x in d.find_items(messy, items).collect())
    assert found == [(-9, 4), (1, 0), (1, 1), (1, 1), (1, 1), (1, 1)]
    kept = d.without_items(messy, items)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 4
    assert d.find_items(no_docs, items).count() == d.find_items(messy, items.where("false")).count() == 0
    assert d.without_items(messy, items.where("false")).count() == messy.count() and d.without_items(no_docs, items).count() == 0
