from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from helpers import DATA, assert_same
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import substring_dedup as dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(docs, width):
    """doc_id -> (words, removed, digest of what stays), by every window's text."""
    first, cut = {}, {}
    for doc_id, text in docs:
        cut[doc_id] = WORD.findall(text or "")
        for i in range(len(cut[doc_id]) - width + 1):
            window = tuple(cut[doc_id][i : i + width])
            first[window] = min(first.get(window, doc_id), doc_id)
    out = {}
    for doc_id, words in cut.items():
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < doc_id:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def rows(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_query_matches_sql(spark, duck):
    assert_same(dedup.op2_substring_dedup(spark, DATA), duck, dedup.OP2_SQL)


def test_matches_every_window_on_small_vocabularies(spark):
    random.seed(5)
    docs = [(d, " ".join(random.choice("ab") for _ in range(random.randint(0, 40)))) for d in random.sample(range(-50, 200), 120)]
    docs += [(1000 + d, text) for d, text in docs[:20]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(dedup.remove_repeats(df, width=6)) == {d: x[:3] for d, x in plain(docs, 6).items()}


def test_chunks_of_a_task_do_not_matter(spark, monkeypatch):
    docs = [(d, " ".join(f"w{(d % 7) * 3 + i}" for i in range(60))) for d in range(60)]
    chunk = dedup._Chunk(10, [0, 1, 2], 1)
    assert not chunk.add(1, 2, b"too short") and list(chunk.flush()) == []
    assert rows(dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), width=10)) == {d: x[:3] for d, x in plain(docs, 10).items()}


def test_parts_of_a_bucket_do_not_matter(spark, monkeypatch):
    random.seed(6)
    docs = [(d, " ".join(random.choice("abc") for _ in range(random.randint(0, 60)))) for d in range(150)]
    docs += [(1000 + d, text) for d, text in docs[:30]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(dedup, "shape_of", lambda size, least: (4, 7, 1))
    monkeypatch.setattr(dedup, "CHUNK_WORDS", 500)
    assert rows(dedup.remove_repeats(df, width=6)) == {d: x[:3] for d, x in plain(docs, 6).items()}


def test_bytes_of_a_window_do_not_grow_with_the_buckets(monkeypatch):
    r = np.random.default_rng(4)
    texts = [(i * 3, b" ".join(b"%d" % w for w in r.integers(0, 10**7, 480))) for i in range(3200)]
    took = {}
    for buckets in (64, 2500):
        chunk = dedup._Chunk(50, list(range(buckets)), 1, False)
        for d, text in texts:
            if chunk.add(d, 0, text):
                break
        (batch,) = chunk.flush()
        sizes = [sum(len(x) for x in c.to_pylist()) for c in batch.columns[2:]]
        took[buckets] = (sum(sizes) + 72 * batch.num_rows) / (sizes[2] or 1)  # with what a row takes in a shuffle
    assert took[64] < 11 and took[2500] < 1.2 * took[64], took  # 9.4 and 10.9


def test_check_is_as_wide_as_the_input_asks_for():
    assert dedup.shape_of(10**8, 12) == (12, 1, 1) and dedup.shape_of(30 * 10**9, 12) == (2500, 1, 1)
    buckets, parts, check = dedup.shape_of(10**14, 200)
    assert buckets == dedup.MOST_BUCKETS and parts * buckets * dedup.BUCKET_BYTES >= 10**14 and check == 4


@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(0, 2), st.integers(0, 2**31 - 1)), max_size=40, unique=True), st.integers(1, 3))
def test_places_pack_and_unpack(values, runs):
    cuts = np.linspace(0, len(values), runs + 1).astype(int)
    values = [v for a, b in zip(cuts, cuts[1:], strict=False) for v in sorted(values[a:b])]
    ids, versions, places = (np.array([v[i] for v in values], np.int64) for i in range(3))
    got = dedup.unpack_places(dedup.pack_places(ids, versions, places, cuts))
    assert [x.tolist() for x in got[:3]] == [ids.tolist(), versions.tolist(), places.tolist()] and got[3].tolist() == np.diff(cuts).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 8))
def test_rolling_hash_tells_windows_apart(values, width):
    salted = np.array([hash(("v", v)) & 0xFFFFFFFFFFFFFFFF for v in values], np.uint64)
    hashes = dedup.window_hashes(salted, width)
    windows = [tuple(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert len(hashes) == len(windows)
    assert all((hashes[i] == hashes[j]) == (windows[i] == windows[j]) for i in range(len(windows)) for j in range(i))


@given(st.lists(st.integers(0, 5000), max_size=50, unique=True))
def test_ascending_numbers_pack_and_unpack(values):
    values = np.array(sorted(values), np.int64)
    assert dedup.unpack_ascending(dedup.pack_ascending(values)).tolist() == values.tolist()


def test_intervals_are_maximal():
    assert dedup.removal_intervals(np.array([0, 1, 5, 20]), 5) == [(0, 10), (20, 25)]
    assert dedup.removal_intervals(np.zeros(0, int), 5) == []


def test_messy_rows(spark, messy, no_docs):
    got = sorted(map(tuple, dedup.remove_repeats(messy).collect()), key=repr)
    assert len(got) == messy.count()
    by_id = {r[0]: r for r in got if r[0] not in (1, None)}
    assert by_id[2][1:3] == by_id[3][1:3] == by_id[4][1:3] == (0, 0) and by_id[2][3] == hashlib.sha256(b"").hexdigest()
    assert by_id[5][2] == 0 and by_id[6][1] == by_id[6][2] == 60_000
    assert dedup.remove_repeats(no_docs).count() == 0
    kept = dedup.keep_first_windows(messy)
    assert kept.columns == messy.columns
    assert 6 not in {r["doc_id"] for r in kept.collect()} and kept.count() == messy.count() - 1
    assert dedup.keep_first_windows(no_docs).count() == 0


def test_stage_form_keeps_untouched_texts_as_they_are(spark):
    docs = [(1, "a  b\n" + " ".join(map(str, range(8))), 30), (2, "x " + " ".join(map(str, range(8))) + "  y", 20)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in dedup.keep_first_windows(spark.createDataFrame(docs, "doc_id long, text string, n_chars long"), width=5).collect()}
    assert got == {1: (docs[0][1], 30), 2: ("x y", 3)}
