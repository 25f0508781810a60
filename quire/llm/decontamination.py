"""Benchmark decontamination: pigeonhole edit matching of test items in documents.

Items and documents are compared by words (runs other than \\x20 and \\x09-\\x0D, A-Z lower-cased).  An item of m words
may be matched with k = floor(``error_rate`` * m) word edits.  It is split into k + 1 pieces: whatever the k edits are,
one piece stands unchanged in the document.  Exact hits of pieces are found for all words of many documents at once by
Rabin-Karp hashes of their windows, and each hit's surroundings are verified with Myers' bit-parallel edit distance
over words, so a window's hash never decides; words are compared by 64-bit values of theirs.  An item of few words has
k = 0 and is one exact piece, found anywhere.

Documents are read once per block of ``block_words`` words of items and don't move; a block is what each task holds of
the benchmark, however large the benchmark is.

Defined results: items without words, null items and null texts match nothing; repeated items and repeated rows are each reported; a null
doc_id or item_id is carried through; columns other than doc_id, text, item_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.substring_dedup import WordValues, window_hashes

ERROR_RATE = 0.2
#: Words of items that a task holds at once.
BLOCK_WORDS = 2_000_000
#: Words of documents that are searched at once.
CHUNK_WORDS = 500_000
MATCH = "doc_id long, item_id long, distance int, item_words int, first_word long, end_word long"


def piece_bounds(m: int, errors: int) -> list[tuple[int, int]]:
    """``errors`` + 1 pieces of m words, none empty and as equal as can be."""
    cuts = [i * m // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def myers(masks: dict[int, int], m: int, text: list[int], anchored: bool = False) -> tuple[int, int]:
    """(least distance, first end in ``text``) of a pattern of m symbols, by one bit vector step a symbol.

    ``masks`` has the pattern's positions of each symbol.  The match may begin anywhere; at the start if ``anchored``.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = (m, 0)
    for at, symbol in enumerate(text, 1):
        equal = masks.get(symbol, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        more, less = down | (full & ~(horizontal | up)), up & horizontal
        score += 1 if more & top else -1 if less & top else 0
        more, less = (more << 1 | anchored) & full, less << 1 & full
        up, down = less | (full & ~(vertical | more)), more & vertical
        if score < best[0]:
            best = (score, at)
    return best


@dataclass
class Item:
    item_id: int | None
    words: list[int]
    errors: int
    masks: dict[int, int] = field(default_factory=dict)
    back: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for i, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
            self.back[w] = self.back.get(w, 0) | 1 << (len(self.words) - 1 - i)

    def best(self, text: list[int]) -> tuple[int, int, int] | None:
        """(distance, begin, end) of the closest stretch of ``text`` within the errors allowed."""
        m = len(self.words)
        distance, end = myers(self.masks, m, text)
        if distance > self.errors:
            return None
        _, length = myers(self.back, m, text[max(0, end - m - self.errors) : end][::-1], anchored=True)
        return distance, end - length, end


class PieceIndex:
    """The pieces of a block of items: per length, their hashes in order and the items and places they come from."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, item in enumerate(items):
            for begin, end in piece_bounds(len(item.words), item.errors):
                found.setdefault(end - begin, []).append((int(window_hashes(np.array(item.words[begin:end], np.uint64), end - begin)[0]), i, begin))
        self.by_length = {}
        for length, rows in found.items():
            rows.sort()
            hashes = np.array([h for h, _, _ in rows], np.uint64)
            low = np.zeros(1 << 20, bool)
            low[hashes >> np.uint64(44)] = True
            self.by_length[length] = (hashes, np.array([i for _, i, _ in rows]), np.array([b for _, _, b in rows]), low)

    def hits(self, values: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
        """(owner, item, where in ``values`` the item would begin) of every exact hit of a piece within one owner."""
        out = []
        for length, (hashes, item, begin, low) in self.by_length.items():
            windows = window_hashes(values, length)
            at = np.flatnonzero(low[windows >> np.uint64(44)])
            at = at[owner[at] == owner[at + length - 1]]
            first, last = (np.searchsorted(hashes, windows[at], side) for side in ("left", "right"))
            n = last - first
            at, first = np.repeat(at, n), np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out += zip(owner[at].tolist(), item[first].tolist(), (at - begin[first]).tolist(), strict=True)
        return out


def matches(texts: list[bytes | None], index: PieceIndex, value: WordValues) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, first word, end word): the closest place of every item in every text."""
    cut = [[value[w] for w in t.lower().split()] if t else [] for t in texts]
    lengths = [len(c) for c in cut]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    if not index.by_length or not starts[-1]:
        return []
    values = np.fromiter((v for c in cut for v in c), np.uint64, starts[-1])
    around: dict[tuple[int, int], list[int]] = {}
    for text, item, begin in set(index.hits(values, np.repeat(np.arange(len(cut)), lengths))):
        around.setdefault((text, item), []).append(begin - int(starts[text]))
    out = []
    for (text, i), begins in around.items():
        item, best = index.items[i], None
        m, k = len(item.words), item.errors
        begins.sort()
        stretch = [max(0, begins[0] - k), begins[0] + m + k]
        for begin in [*begins[1:], None]:
            if begin is not None and begin - k <= stretch[1]:
                stretch[1] = begin + m + k
                continue
            found = item.best(cut[text][stretch[0] : stretch[1]])
            if found:
                found = (found[0], found[1] + stretch[0], found[2] + stretch[0])
                best = min(best or found, found)
            stretch = [max(0, (begin or 0) - k), (begin or 0) + m + k]
        if best:
            out.append((text, i, *best))
    return sorted(out)


def item_blocks(benchmark: DataFrame, error_rate: float = ERROR_RATE, block_words: int = BLOCK_WORDS) -> Iterator[list[Item]]:
    """The benchmark's items (item_id, text), a bounded number of words at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = size // (2 * block_words) + 1  # a word and its space take two bytes at least
    value = WordValues()
    for b in range(blocks):
        out = []
        for item_id, text in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect():
            found = [value[w] for w in bytes(text).lower().split()]
            if found:
                out.append(Item(item_id, found, int(error_rate * len(found))))
        yield sorted(out, key=lambda x: (x.item_id is None, x.item_id, x.words))


def _per_chunk(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold a bounded number of bytes, or one row."""
    sizes = np.array([len(x) if x else 0 for x in batch.column(text).to_pylist()])
    part = np.cumsum(sizes) // (6 * CHUNK_WORDS)
    heads = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(heads, [*heads[1:], len(sizes)], strict=True):
        yield batch.slice(int(a), int(b - a))


def find_items(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) that it holds: the closest place."""

    def search(index) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, held = WordValues(), index.value
            for batch in batches:
                for part in _per_chunk(batch, 1):
                    ids, found = part.column(0).to_pylist(), matches(part.column(1).to_pylist(), held, value)
                    columns = [[ids[t] for t, *_ in found], [held.items[i].item_id for _, i, *_ in found], [d for _, _, d, *_ in found], [len(held.items[i].words) for _, i, *_ in found], [a for *_, a, _ in found], [b for *_, b in found]]
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "item_words", "first_word", "end_word"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(each, MATCH)

    share = docs.sparkSession.sparkContext.broadcast  # `block_words` bounds what is sent
    return reduce(DataFrame.unionByName, (search(share(PieceIndex(items))) for items in item_blocks(benchmark, error_rate, block_words)))


def without_items(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` (any columns, text among them) that hold no item.  No row moves."""

    def keep(rows: DataFrame, index) -> DataFrame:
        text = rows.columns.index("text")

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value = WordValues()
            for batch in batches:
                for part in _per_chunk(batch, text):
                    mask = np.ones(part.num_rows, bool)
                    mask[[t for t, *_ in matches(part.column(text).cast(pa.binary()).to_pylist(), index.value, value)]] = False
                    yield part.filter(pa.array(mask))

        return rows.mapInArrow(each, rows.schema)

    share = docs.sparkSession.sparkContext.broadcast  # `block_words` bounds what is sent
    return reduce(keep, (share(PieceIndex(items)) for items in item_blocks(benchmark, error_rate, block_words)), docs)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
