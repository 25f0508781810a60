from __future__ import annotations

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import text


def run(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in rows.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("function", "given", "want"),
    [
        (text.slugify, ["Deep Work", "  --A..b ", "é", "", "Ünder 9"], ["deep-work", "a-b", "untitled", "untitled", "nder-9"]),
        (text.strip, ["  a b\n", " x ", "", "\t"], ["a b", "x", "", ""]),
        (text.squeeze, ["a \n  b", " "], ["a b", ""]),
        (text.display_title, ["", "one", "a  b c d e"], ["Untitled", "one", "a b c d"]),
        (text.doc_id_from_name, ["/x/Deep Work.md", "Book_MIDDLE.json", "a.b.pdf", ".md"], ["deep-work", "book", "a-b", "md"]),
        (text.title_from_name, ["o'brien_3d book", "ABC"], ["O'Brien 3D Book", "Abc"]),
        (text.token_count, ["a b\tc", "", " x y "], [3, 0, 2]),
        (text.is_slug_id, ["a-b", "../x", "A", "a b", "a\n", "a--b"], [True, False, False, False, False, False]),
        (text.is_section_id, ["a.b-c", "a..b", "a/b", ".."], [True, False, False, False]),
        (text.is_url, ["http://x", "data:z", "img/x.png"], [True, True, False]),
    ],
)
def test_scalar(spark, function, given, want):
    assert run(spark, function, given) == want


def test_terms_fold_like_decomposition(spark):
    samples = ["Đường CÔNG nghệ", "Éà ç-ü_x", "naïve café² ", "áb", "ǅungla"]

    def naive(value):
        plain = "".join(c for c in unicodedata.normalize("NFKD", value.lower()) if not unicodedata.combining(c))
        return "".join(c if c.isalnum() else " " for c in plain).split()

    samples += ["각 힣 가나다", "ﬃ ㍿ ㈠ Ⅷ ½ ﷺ x", "ｶﾞ ガ", "".join(map(chr, range(0x3131, 0x3164))), "日本語 漢字 \uf900", "\U0001d4d0\U0001f110 z"]
    assert run(spark, text.terms, samples[:4] + samples[5:]) == [naive(s) for s in samples[:4] + samples[5:]]
    assert [text.query_terms(s) for s in samples] == [naive(s) for s in samples]


def test_snippet(spark):
    words = "x" * 100 + " needle " + "y" * 200
    got = run(spark, lambda c: text.snippet(c, ["needle"]), [words, "needle first", "no hit " + "z" * 200, "short"])
    assert got == ["…" + words[48:208] + "…", "needle first", ("no hit " + "z" * 200)[:160] + "…", "short"]


@pytest.mark.parametrize("value", ['a "q" \\ é', "tab\tline\n", "𝒳 astral", "", "plain", "\x01"])
def test_json_string_is_ascii_json(spark, value):
    assert run(spark, text.json_string, [value]) == [json.dumps(value)]


def test_remove_once(spark):
    rows = spark.createDataFrame([("aXbXc", "X"), ("abc", ""), ("abc", "q")], "t string, p string")
    assert [r[0] for r in rows.select(text.remove_once(F.col("t"), F.col("p"))).collect()] == ["abXc", "abc", "abc"]
