"""Scalar text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space besides the ASCII ones.
_SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]"
SLUG_ID = r"^[a-z0-9]+(?:-[a-z0-9]+)*\z"
SECTION_ID = r"^[a-z0-9]+(?:-[a-z0-9]+)*(?:\.[a-z0-9]+(?:-[a-z0-9]+)*)*\z"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return strip(F.regexp_replace(text, f"{_SPACE}+", " "))


def slugify(text: Column) -> Column:
    """Lower case, runs of anything but ASCII letters and digits become '-', none at the ends; 'untitled' if empty."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-zA-Z0-9]+", "-"), "^-|-$", "")
    return F.when(slug == "", "untitled").otherwise(slug)


def doc_id_from_name(name: Column) -> Column:
    """Slug of a file's name without folders and ending; ``_middle.json`` counts as an ending in any case."""
    base = F.regexp_replace(name, r"^.*/", "")
    stem = F.when(base.rlike(r"(?i)_middle\.json\z"), F.regexp_replace(base, r"(?i)_middle\.json\z", "")).otherwise(F.regexp_replace(base, r"(?<=.)\.[^.]*\z", ""))
    return slugify(stem)


def is_slug_id(text: Column) -> Column:
    return F.coalesce(text.rlike(SLUG_ID), F.lit(False))


def is_section_id(text: Column) -> Column:
    return F.coalesce(text.rlike(SECTION_ID), F.lit(False))


def _plain(text: str) -> str:
    """Compatibility decomposition without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _char_class(chars: str) -> str:
    """A pattern of one of ``chars`` (ascending), by ranges."""
    ranges: list[list[int]] = []
    for point in map(ord, chars):
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


# Hangul syllables by the rule of Unicode: first, last, and how many of them share a first and a middle letter.
_HANGUL, _HANGUL_END, _TAILS, _PER_LEAD = 0xAC00, 0xD7A3, 28, 588
_LEADS, _VOWELS, _ENDS = ("".join(map(chr, range(first, first + n))) for first, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


@cache
def _folding() -> tuple[str, str, str, list[str]]:
    """(from, to) of ``translate`` for characters that fold to one other and marks, which vanish; others and their images."""
    single, marks, several = [], [], []
    for point in [*range(0x80, _HANGUL), *range(0xE000, sys.maxunicode + 1)]:
        char = chr(point)
        if unicodedata.combining(char):
            marks.append(char)
        elif unicodedata.decomposition(char):
            plain = _plain(char)
            if len(plain) != 1:
                several.append((char, plain))
            elif plain != char:
                single.append((char, plain))
    return "".join(a for a, _ in single) + "".join(marks), "".join(b for _, b in single), "".join(a for a, _ in several), [b for _, b in several]


def _unfolded(char: Column) -> Column:
    """The image of a character that may have several letters: Hangul by its rule, others by their place in the table."""
    _, _, several, images = _folding()
    nth = F.ascii(char) - _HANGUL
    letter = lambda letters, at: F.substring(F.lit(letters), at.cast("int") + 1, F.lit(1))
    tail = nth % _TAILS
    hangul = F.concat(letter(_LEADS, F.floor(nth / _PER_LEAD)), letter(_VOWELS, F.floor(nth % _PER_LEAD / _TAILS)), F.when(tail > 0, letter(_ENDS, tail - 1)).otherwise(""))
    place = F.instr(F.lit(several), char)
    listed = F.element_at(F.split(F.lit("\x00".join(images)), "\x00"), F.greatest(place, F.lit(1)))
    return F.when(F.ascii(char) < 0x80, char).when((nth >= 0) & (nth <= _HANGUL_END - _HANGUL), hangul).when(place > 0, listed).otherwise(char)


def fold(text: Column) -> Column:
    """Lower case, then the compatibility decomposition without marks, as ``query_terms`` has it.

    ASCII texts need only the first; only texts with a character that folds to several are taken apart.
    """
    low, (source, target, several, _) = F.lower(text), _folding()
    spread = F.array_join(F.transform(F.split(low, ""), _unfolded), "")
    # The first pattern is quick and lets through more than the second.
    wide = low.rlike(r"[^\x00-\x9f\xc0-\u0131\u014a-\u01c3\u01f4-\u0586]") & low.rlike(f"[\\x{{{_HANGUL:x}}}-\\x{{{_HANGUL_END:x}}}{_char_class(several)}]")
    return F.when(~low.rlike(r"[^\x00-\x7f]"), low).when(wide, F.translate(spread, source, target)).otherwise(F.translate(low, source, target))


def terms(text: Column) -> Column:
    """Search terms: runs of letters and digits of the folded text, in order, repeats kept."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: str) -> list[str]:
    """Search terms of a query given to the driver."""
    plain = _plain(query.lower())
    out, run = [], ""
    for c in plain + " ":
        if c.isalnum():
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def token_count(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(text, F.lit(rf"[^\s\x1c-\x1f\x85\xa0  -     　]+"))


def display_title(candidate: Column) -> Column:
    """The first four words; 'Untitled' if there is none."""
    words = F.split(squeeze(candidate), " ")
    return F.when(squeeze(candidate) == "", "Untitled").otherwise(F.array_join(F.slice(words, 1, 4), " "))


def title_from_name(name: Column) -> Column:
    """A file's name as a title: '_' is a space, and every letter that follows no letter is upper case."""
    text = F.lower(strip(F.translate(name, "_", " ")))
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, sys.maxsize >> 33))), "")


def snippet(text: Column, found: list[str], width: int = 160) -> Column:
    """``width`` characters from a third of that before the first place of a term, else the head; '…' where cut."""
    low = F.lower(text)
    places = F.filter(F.array(*(F.locate(t, low) for t in found)), lambda p: p > 0) if found else F.array().cast("array<int>")
    start = F.greatest(F.lit(0), F.array_min(places) - 1 - width // 3)
    around = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, F.lit(width)), F.when(start + width < F.length(text), "…").otherwise(""))
    head = F.concat(F.substring(text, 1, width), F.when(F.length(text) > width, "…").otherwise(""))
    return F.when(F.size(places) > 0, around).otherwise(head)


def heading_mark(level: Column) -> Column:
    return F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6)))


def remove_once(text: Column, part: Column) -> Column:
    """``text`` without the first place of ``part``; an empty part removes nothing."""
    at = F.instr(text, part)
    return F.when((part == "") | (at == 0), text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(part), F.length(text))))


def json_string(text: Column) -> Column:
    """A JSON string in ASCII: quotes, backslashes and control characters escaped, others beyond ASCII as \\uXXXX."""
    body = F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    units = F.transform(F.split(body, ""), lambda c: F.when(F.ascii(c) < 128, c).when(F.ascii(c) < 65536, F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(_surrogates(F.ascii(c))))
    return F.when(text.isNull(), "null").when(body.rlike("[^\\x00-\\x7f]"), F.array_join(units, "")).otherwise(body)


def _surrogates(point: Column) -> Column:
    rest = point - 0x10000
    return F.concat(F.lit("\\u"), F.lower(F.hex(F.shiftright(rest, 10) + 0xD800)), F.lit("\\u"), F.lower(F.hex(rest.bitwiseAND(0x3FF) + 0xDC00)))


def json_strings(values: Column) -> Column:
    """A JSON array of strings, parted by comma and space."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, json_string), ", "), F.lit("]"))


def json_number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def is_url(text: Column) -> Column:
    return F.contains(text, F.lit("://")) | F.startswith(text, F.lit("data:"))
