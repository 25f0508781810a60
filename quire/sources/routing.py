"""Which parser reads a file."""

from __future__ import annotations

from quire.sources.layout import UnsupportedSourceError

# Endings of the formats.
_ENDINGS = {
    "layout-json": ("_middle.json",),
    "markdown": (".md", ".markdown", ".mdx"),
    "converted": (".csv", ".doc", ".docx", ".epub", ".htm", ".html", ".ppt", ".pptx", ".txt", ".xls", ".xlsx"),
}
#: What is asked for instead of a format that no parser takes by itself.
_INSTEAD = {".json": "layout JSON, whose name ends in _middle.json", ".pdf": "its layout JSON, or a parser named for it"}
#: Longest first, so that an ending within another doesn't hide it.
_PARSERS = sorted(((ending, parser) for parser, endings in _ENDINGS.items() for ending in endings), key=lambda x: -len(x[0]))


def parser_for(name: str) -> str:
    """``layout-json``, ``markdown`` or ``converted``; raises for files that no parser takes by itself."""
    base = name.lower().rsplit("/", 1)[-1]
    for ending, parser in _PARSERS:
        if base.endswith(ending) and (base != ending or parser == "layout-json"):
            return parser
    wanted = next((what for ending, what in _INSTEAD.items() if base.endswith(ending)), f"one of {', '.join(e for e, _ in reversed(_PARSERS))}")
    raise UnsupportedSourceError(f"{name}: no parser reads this; needed is {wanted}")
