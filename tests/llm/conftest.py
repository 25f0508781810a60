from __future__ import annotations

import pytest

#: Columns that the operators use inside; an input may have its own.
CLASHING = "fp long, version long, at binary, score double, lang_pred string, sequence_id long, offset long, component_id long, fingerprint string, low array<long>, held_out boolean, __at binary, rank long, copies long, part int, bucket int"
MESSY = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
_REST = (1, 2, b"x", 0.5, "zz", 7, 8, 9, "ab", [1], True, b"y", 3, 4, 5, 6)
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def messy(spark):
    """Null ids and texts, empty, blank and very long texts, repeated rows, one id twice, clashing columns."""
    rows = [
        (1, "the cat sat on the mat and looked at the dog for a while", "en", "a", 56),
        (1, "the cat sat on the mat and looked at the dog for a while", "en", "a", 56),
        (1, "another text under the same id", "en", "a", None),
        (2, None, "en", None, None), (3, "", None, "b", 0), (4, " \t\n\x0b ", "en", "b", 5), (None, "le chat est sur la table avec le chien", "fr", "b", 38), (None, None, None, None, None),
        (5, LONG, "en", "c", len(LONG)), (6, LONG, "fr", "c", len(LONG)), (7, "12345 !!! ???", "en", "c", 13), (8, "naïve\xa0café 𝒳 日本語 <|endoftext|>", "fr", "d", -5), (-9, "x", "de", "d", 1),
    ]
    return spark.createDataFrame([(*r, *_REST) for r in rows], MESSY).repartition(3).cache()


@pytest.fixture
def no_docs(messy):
    return messy.where("false")
