from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from helpers import DATA

from quire.llm import simhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(len(words) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Index -> smallest index reachable over all pairs within three bits."""
    of = list(range(len(fps)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                of[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_query_matches_all_pairs(spark):
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    fps = [plain_fingerprint(t) for _, t in texts]
    want = {texts[i][0]: (f"{fps[i]:016x}", texts[c][0]) for i, c in enumerate(plain_components(fps))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op8_simhash_near_dedup(spark, DATA).collect()} == want


def near(random_, base, flips):
    for _ in range(flips):
        base ^= 1 << random_.randrange(64)
    return base


def test_trie_join_matches_all_pairs_in_dense_and_sparse_groups(monkeypatch):
    r = random.Random(7)
    for wide in (simhash.WIDE, 50):
        monkeypatch.setattr(simhash, "WIDE", wide)
        for spread in (2, 4, 8, 30):
            base = r.getrandbits(64)
            keys = sorted({near(r, base, r.randint(0, spread)) for _ in range(300)})
            of = simhash.trie_self_join(np.array(keys, np.uint64), np.array([0]), 64, 3)
            want = plain_components(keys)
            assert of.tolist() == want


def test_links_keep_all_components(spark):
    r = random.Random(9)
    fps = [near(r, base, r.randint(0, 5)) for base in (r.getrandbits(64) for _ in range(30)) for _ in range(20)]
    signed = sorted(set(np.array(fps, np.uint64).view(np.int64).tolist()))
    want = plain_components([x & 0xFFFFFFFFFFFFFFFF for x in signed])
    groups = lambda x: sorted(tuple(i for i, v in enumerate(x) if v == w) for w in set(x))
    for most_leaves in (simhash.MOST_LEAVES, 7):  # whole subtrees, and pairs of their parts
        links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), most_leaves=most_leaves)
        assert all((a ^ b) & 0xFFFFFFFFFFFFFFFF for a, b in links.collect())
        got = dict(simhash.components(links).collect())
        assert groups([got.get(x, x) for x in signed]) == groups(want)


def test_components_of_long_paths(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "fp long, to long")
    assert set(simhash.components(path).collect()) == {(i, 0) for i in range(201)} | {(900, 900), (901, 900)}
    assert simhash.components(path.where("false")).count() == 0


def test_messy_rows(spark, messy, no_docs):
    rows = simhash.near_duplicates(messy).collect()
    assert len(rows) == messy.count()
    empty = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in empty} == {2, 3, 4, None} and {r["component_id"] for r in empty} == {2}
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    french = [r for r in rows if r["doc_id"] is None and r["fingerprint"] != "0" * 16]
    assert [r["component_id"] for r in french] == [None]
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.one_of_each_group(messy)
    assert kept.columns == messy.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None) == sorted({(r["doc_id"], r["text"]) for r in messy.collect() if r["doc_id"] in (1, 2, 5, 7, 8, -9)}, key=lambda x: (x[0], x[1] or ""))
    assert simhash.one_of_each_group(no_docs).count() == 0
