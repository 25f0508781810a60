from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest
from helpers import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import packing


def plain_bfd(lengths, capacity):
    """Remaining capacities of best-fit decreasing, one piece at a time."""
    left = []
    for n in sorted(lengths, reverse=True):
        i = bisect_left(left, n)
        r = left.pop(i) if i < len(left) else capacity
        insort(left, r - n)
    return left


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_is_best_fit_decreasing(lengths):
    plan = packing.best_fit_decreasing(dict(Counter(lengths)), 64)
    bins = {}
    for length, count in Counter(lengths).items():
        own = [r for r in plan.tolist() if r[0] == length]
        for rank in range(count):
            _, first_rank, per, first, offset = [r for r in own if r[1] <= rank][-1]
            n, o = divmod(rank - first_rank, per)
            bins.setdefault(first + n, []).append((offset + o * length, length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(64 - sum(n for _, n in p) for p in bins.values()) == plain_bfd(lengths, 64)


def test_tree_finds_the_tightest_bin():
    random.seed(1)
    tree, open_ = packing.RemainingCapacities(100), Counter()
    for _ in range(2000):
        r = random.randint(1, 100)
        if random.random() < 0.5:
            tree.put(r, 0, 1)
            open_[r] += 1
        else:
            found = tree.tightest(r)
            assert found == min((k for k, n in open_.items() if n and k >= r), default=None)
            if found:
                tree.take(found)
                open_[found] -= 1


@pytest.mark.parametrize(("n", "want"), [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)]), (17, [(0, 1), (1, 8), (9, 8)])])
def test_only_the_first_piece_is_shorter(n, want):
    assert packing.cut(n, 8) == want


def hf(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_fast_encoder_gives_the_files_ids():
    encode = packing.encoder(packing.Vocabulary.public())
    samples = ["", " ", "a  b\n\n c\t", "don't WE'LL 12 345", "é ñ ß Ÿ ɏ", "日本 mixed", "x" * 500, "<|endoftext|>", "#$%&!! | 24be64", "\x00\x7f\x85\xa0z", "a\r\nb   \n"]
    for text in samples:
        assert encode(text).tolist() == hf(text), text


def test_query_packs_every_document_whole(spark):
    rows = packing.op4_best_fit_packing(spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == texts.keys()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, pieces in by_doc.items():
        ids = np.array([*hf(texts[doc_id]), 0], "<u4")
        assert [(p["start"], p["length"]) for p in sorted(pieces, key=lambda p: p["piece"])] == packing.cut(len(ids), 2048)
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    assert len(by_sequence) == len(plain_bfd([r["length"] for r in rows], 2048))


def test_messy_rows(spark, messy, no_docs):
    rows = packing.pack(messy).collect()
    starts = Counter(r["doc_id"] for r in rows if r["piece"] == 0)
    assert starts == Counter({1: 3, None: 2} | dict.fromkeys((2, 3, 4, 5, 6, 7, 8, -9), 1))
    assert {(r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] in (2, 3)} == {(1, zlib.crc32(b"\0\0\0\0"))}
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) > 60_000
    assert packing.pack(no_docs).count() == 0


def test_added_tokens_get_their_own_ids():
    assert packing.encoder(packing.Vocabulary.public())("a<|endoftext|>b").tolist() == hf("a<|endoftext|>b") == [64, 50256, 65]
