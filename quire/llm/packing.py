"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Only lengths decide where best-fit decreasing puts a piece, and there are at most ``capacity`` of them.  So the
placement is worked out once on the histogram of lengths: a segment tree over the remaining capacities
``0..capacity`` holds runs of open bins, finds the tightest one that still takes a length in logarithmic time, and
fills whole runs of equal bins at once.  That gives the very bins that handling the pieces one by one would give,
while the driver's work, the plan and what is broadcast depend on ``capacity`` alone, not on the corpus.  The
pieces then look up their place by (length, rank among the pieces of that length).

Ranks need no sort and no hot group: each scan task counts the pieces of each length it has made, and only those
counts per (task, length) are summed up across tasks.

Defined results: null text packs as the empty text (its one token is the end marker); an empty table gives no rows;
repeated rows are packed once per row; a null doc_id is carried through; columns other than the two named are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass(frozen=True)
class Vocabulary:
    """Where a byte-level BPE lies: the tokenizers file, the same merges as ranks, and the ranks' split pattern."""

    json: str
    ranks: str
    pattern: str

    @staticmethod
    def public() -> Vocabulary:
        import public_tokenizers

        return Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Beyond these letters the two libraries may class a character differently; such texts take the slower library.
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
_encoders: dict[Vocabulary, object] = {}


def encoder(vocabulary: Vocabulary):
    """text -> uint32 ids.  Same ids as the tokenizers file gives; Latin texts go through the rank file's faster library.

    A text that has one of the file's added tokens literally goes through the file, which gives the token's own id.
    """
    if vocabulary not in _encoders:
        import os

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        full = Tokenizer.from_file(vocabulary.json)
        added = [token.content for token in full.get_added_tokens_decoder().values()]
        with open(vocabulary.ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if _BEYOND_LATIN.search(text) or any(token in text for token in added):
                return np.array(full.encode(text, add_special_tokens=False).ids, "<u4")
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only the first may be shorter than ``capacity``."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * bool(first) + [(at, capacity) for at in range(first, n, capacity)]


def tokenised_pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """A row per piece; ``task`` and ``task_rank`` number the pieces of equal length within a scan task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task, seen = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # a text at a time leaves Arrow
                ids = np.concatenate([encode(text.as_py() or ""), end])
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    for column, value in zip(out, (doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), int(seen[length])), strict=True):
                        column.append(value)
                    seen[length] += 1
            ids_, piece_, start_, length_, crc_, rank_ = out
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids_, pa.int64()), pa.array(piece_, pa.int32()), pa.array(start_, pa.int64()), pa.array(length_, pa.int64()), pa.array(crc_, pa.int64()), pa.array([task] * len(ids_), pa.int32()), pa.array(rank_, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES)


class RemainingCapacities:
    """Segment tree over remaining capacities; leaf r keeps the runs (first bin, how many) of open bins with r left."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.width)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.width)]

    def _mark(self, leaf: int) -> None:
        node = leaf + self.width
        self.open[node] = bool(self.runs[leaf])
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] | self.open[2 * node + 1]

    def put(self, left: int, first: int, bins: int) -> None:
        if bins and left:
            self.runs[left].append((first, bins))
            self._mark(left)

    def take(self, left: int) -> tuple[int, int]:
        run = self.runs[left].pop()
        self._mark(left)
        return run

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of an open bin that is at least ``need``."""
        node = need + self.width
        if self.open[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.width:
            node = 2 * node + (not self.open[2 * node])
        return node - self.width


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces per bin, first bin, first offset), sorted by length and rank."""
    tree, plan, bins = RemainingCapacities(capacity), [], 0
    for length in sorted(counts, reverse=True):
        placed, count = 0, counts[length]
        while placed < count:
            left = tree.tightest(length)
            if left is None:  # open as many bins as the rest of this length fills
                left, per = capacity, capacity // length
                first, n = bins, -(-(count - placed) // per)
                bins += n
            else:
                (first, n), per = tree.take(left), left // length
            full = min(n, (count - placed) // per)
            if full:
                plan.append((length, placed, per, first, capacity - left))
                tree.put(left - per * length, first, full)
                placed += full * per
            if full < n:
                part = count - placed if count - placed < per else 0
                if part:
                    plan.append((length, placed, per, first + full, capacity - left))
                    tree.put(left - part * length, first + full, 1)
                    placed += part
                tree.put(left, first + full + bool(part), n - full - bool(part))
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of ``tokenised_pieces`` that have been written to a table."""
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    lengths = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit_decreasing(lengths, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("task_rank")).alias("rank"))
    shared = pieces.sparkSession.sparkContext.broadcast(plan)  # its size depends on `capacity` alone

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_, rank_, per_, bin_, offset_ = shared.value.T if len(shared.value) else np.zeros((5, 1), np.int64)
        keys = (length_ << 48) + rank_
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            nth = rank - rank_[row]
            sequence = bin_[row] + nth // per_[row] if len(row) else row
            offset = offset_[row] + nth % per_[row] * length if len(row) else row
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(located, PLACED)


def pack(docs: DataFrame, vocabulary: Vocabulary | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, text) into as few sequences of ``capacity`` ids as best-fit decreasing needs."""
    pieces = materialize(tokenised_pieces(docs, vocabulary or Vocabulary.public(), capacity, end_id), "pieces")
    return place(pieces, capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
