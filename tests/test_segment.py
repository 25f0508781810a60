from __future__ import annotations

import random

import pytest

from quire.operators import segment

BLOCKS = "doc_id string, ord int, id string, type string, text string, level int, page_idx int, doc_title string"


def blocks(spark, rows, doc="doc", title="Book"):
    return spark.createDataFrame([(doc, i, f"b{i}", t, x, level, page, title) for i, (t, x, level, page) in enumerate(rows)], BLOCKS)


def ordered(df):
    return [r.asDict() for r in df.orderBy("doc_id", "ord").collect()]


def test_headings_make_sections_with_paths_and_pages(spark):
    got = ordered(segment.by_heading(blocks(spark, [("title", "Part", 1, 10), ("text", "a", None, 10), ("title", "One", 2, 12), ("text", "b", None, 12), ("title", "Two", 2, 15), ("text", "c", None, 15)])))
    assert [(s["section_id"], s["page_start"], s["page_end"], s["heading_path"], s["text"], s["block_ids"]) for s in got] == [
        ("doc.part", 10, 11, ["Part"], "a", ["b0", "b1"]), ("doc.one", 12, 14, ["Part", "One"], "b", ["b2", "b3"]), ("doc.two", 15, 15, ["Part", "Two"], "c", ["b4", "b5"]),
    ]
    assert [(s["prev_id"], s["next_id"]) for s in got] == [(None, "doc.one"), ("doc.part", "doc.two"), ("doc.one", None)]


def test_front_matter_deeper_titles_and_unclamped_pages(spark):
    got = ordered(segment.by_heading(blocks(spark, [("text", "intro", None, 3), ("title", "A", 1, 5), ("title", "deep", 3, 5), ("text", "x", None, 5), ("title", "B", 1, 5)])))
    assert [(s["title"], s["level"], s["page_start"], s["page_end"], s["text"]) for s in got] == [("Book — Front Matter", 1, 3, 4, "intro"), ("A", 1, 5, 4, "x"), ("B", 1, 5, 5, "")]
    assert got[1]["block_ids"] == ["b1", "b2", "b3"]


def test_slugs_avoid_made_up_names(spark):
    got = ordered(segment.by_heading(blocks(spark, [("title", t, 1, None) for t in ("A", "A", "A-2", "A")])))
    assert [s["section_id"] for s in got] == ["doc.a", "doc.a-2", "doc.a-2-2", "doc.a-3"]


def test_slugs_match_a_plain_fold_on_random_titles(spark):
    random.seed(8)
    docs = {f"d{d}": [random.choice(["A", "A", "A 2", "a-2-2", "A 3", "B", "b 10", "12", "--", "A 02"]) for _ in range(random.randint(1, 25))] for d in range(30)}
    rows = spark.createDataFrame([(d, i, t) for d, ts in docs.items() for i, t in enumerate(ts)], "doc_id string, nr int, title string")
    want = {}
    for d, titles in docs.items():
        used = []
        for i, t in enumerate(titles):
            slug = "-".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) or "untitled"
            used.append(slug if slug not in used else next(f"{slug}-{k}" for k in range(2, 99) if f"{slug}-{k}" not in used))
            want[d, i] = used[-1]
    assert {(r["doc_id"], r["nr"]): r["slug"] for r in segment.unique_slugs(rows).collect()} == want


def test_levels_beyond_six_make_paths(spark):
    got = ordered(segment.by_heading(blocks(spark, [("title", "A", 7, 1), ("title", "B", 8, 1), ("title", "C", 8, 1), ("title", "D", 11, 1)]), 20))
    assert [(s["level"], s["heading_path"]) for s in got] == [(7, ["A"]), (8, ["A", "B"]), (8, ["A", "C"]), (11, ["A", "C", "D"])]
    assert ordered(segment.by_heading(blocks(spark, [("text", "x", None, 1)])))[0]["heading_path"] == ["Book — Front Matter"]


def test_bookmarks_cut_page_ranges(spark):
    rows = blocks(spark, [("text", f"p{p}", None, p) for p in (0, 1, 2, 3, 5)] + [("text", "unpaged", None, None)])
    marks = spark.createDataFrame([("doc", 0, "First", 1, 1), ("doc", 1, "Second", 3, 1), ("doc", 2, "deep", 2, 2), ("doc", 3, "lost", None, 1)], "doc_id string, pos int, title string, page_index int, level int")
    got = ordered(segment.by_bookmark(rows, marks))
    assert [(s["section_id"], s["page_start"], s["page_end"], s["text"]) for s in got] == [("doc.first", 1, 2, "p1\n\np2"), ("doc.second", 3, 5, "p3\n\np5")]


def test_bookmarks_on_one_page_clamp_and_none_fall_back(spark):
    marks = spark.createDataFrame([("doc", 0, "A", 1, 1), ("doc", 1, "B", 1, 1)], "doc_id string, pos int, title string, page_index int, level int")
    got = ordered(segment.by_bookmark(blocks(spark, [("text", "x", None, 1)]), marks))
    assert [(s["title"], s["page_end"], s["text"]) for s in got] == [("A", 1, ""), ("B", 1, "x")]
    got = ordered(segment.by_bookmark(blocks(spark, [("title", "T", 1, 1)]), marks.where("false")))
    assert [s["section_id"] for s in got] == ["doc.t"]


def test_token_budget_keeps_pages_whole(spark):
    got = ordered(segment.by_token_budget(blocks(spark, [("text", "a b c", None, 1), ("text", "d e", None, 1), ("text", "f g h", None, 2)]), 5))
    assert [(s["section_id"], s["token_count"], s["page_start"]) for s in got] == [("doc.part-1", 5, 1), ("doc.part-2", 3, 2)]
    got = ordered(segment.by_token_budget(blocks(spark, [("text", "a b", None, 1)] * 3), 5))
    assert [s["token_count"] for s in got] == [6]
    got = ordered(segment.by_token_budget(blocks(spark, [("text", "a b c", None, None)] * 6), 4))
    assert [(s["token_count"], s["page_start"]) for s in got] == [(3, None)] * 6


def test_token_budget_counts_images_as_empty_blocks(spark):
    got = ordered(segment.by_token_budget(blocks(spark, [("image", "", None, 1), ("text", " ", None, 1), ("text", "a b c d e f", None, 2), ("title", "T", 1, 3)]), 5))
    assert [(s["token_count"], s["block_ids"], s["text"]) for s in got] == [(0, ["b0"], ""), (6, ["b2"], "a b c d e f"), (1, ["b3"], "T")]
    with pytest.raises(ValueError, match="at least 1"):
        segment.by_token_budget(blocks(spark, []), 0)


def naive_heading(rows, target):
    """A fold over one document's blocks: (title, level, path, page_start, page_end)."""
    drafts, stack = [], []
    for kind, text, level, page in rows:
        if kind == "title":
            level = level or 1
            stack = [s for s in stack if s[0] < level] + [(level, text)]
            if not drafts or level <= target:
                drafts.append([text, level, [t for _, t in stack], page, []])
        elif not drafts:
            drafts.append(["Book — Front Matter", 1, ["Book — Front Matter"], page, []])
        drafts[-1][4].append(page)
    out = []
    for i, (title, level, path, start, pages) in enumerate(drafts):
        known = [p for p in pages if p is not None]
        following = drafts[i + 1][3] if i + 1 < len(drafts) else None
        out.append((title, level, path, min(known) if known else start, following - 1 if following is not None else max(known, default=None)))
    return out


def test_heading_matches_a_plain_fold_on_random_documents(spark):
    random.seed(3)
    docs = {}
    for d in range(40):
        docs[f"d{d}"] = [(random.choice(["title", "text"]), random.choice("abc"), random.choice([None, 0, 1, 2, 3, 4]), random.choice([None, *range(6)])) for _ in range(random.randint(1, 14))]
    rows = spark.createDataFrame([(d, i, f"b{i}", t, x, level, page, "Book") for d, r in docs.items() for i, (t, x, level, page) in enumerate(r)], BLOCKS)
    got = {}
    for s in ordered(segment.by_heading(rows)):
        got.setdefault(s["doc_id"], []).append((s["title"], s["level"], s["heading_path"], s["page_start"], s["page_end"]))
    assert got == {d: naive_heading(r, 2) for d, r in docs.items()}
