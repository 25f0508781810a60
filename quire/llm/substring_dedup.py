"""Substring dedup: words covered by a window of words that also starts in a document with a smaller doc_id go.

Every window of ``width`` consecutive words of every document gets a Rabin-Karp hash: a polynomial over the words'
64-bit values, taken from prefix sums for all starts at once, with a second polynomial's top bits as a check.
Windows are dealt out by their hash and counted there: of equal windows, those in the smallest doc_id stay and all
others are hits.  Hits of a document are merged into maximal removal intervals.

What moves: before the shuffle, a scan task settles equal windows among the documents it holds, so of a window that
stands in thousands of documents it sends one.  The rest leaves as blobs, one per chunk of words and bucket of
hashes: 8 bytes of hash, a bit that tells whether the document changes, and steps of doc_id and place of a byte or two.
So a window takes about as many bytes whether a blob holds thousands or a few.  There are as many buckets as the
input's size asks for, ``MOST_BUCKETS`` at most; beyond that a task gathers its bucket's blobs and cuts them into
parts by other bits of the hash, which Spark sorts on the task's own disk, and settles a part at a time.  Hits leave as
blobs too, one per group of documents.  Texts move once, to meet their hits.

Windows are equal if 64 bits of hash and ``check_bytes`` of another are: for two different ones among all windows the odds are
under 1 in 64, as the check takes as many bytes as the input's size asks for (one up to 30 GB).

Defined results: null text has no words and a kept text of ''; a document of fewer words than ``width`` is kept whole;
a row with a null doc_id is kept whole and removes nothing, as no order holds for it; rows that share a doc_id never
remove each other; white space other than \\x20 and \\x09-\\x0D belongs to words; columns other than the two named
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import estimated_bytes, partition_keys, table, unused

WIDTH = 50
#: Words that a scan task hashes at once.
CHUNK_WORDS = 1_500_000
#: Bytes of the input's files whose windows a task settles at once, some three million windows.
BUCKET_BYTES = 12_000_000
#: Buckets that the shuffle deals out at most, whatever the input's size.
MOST_BUCKETS = 4096
_BLOB = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("places", pa.binary()), ("hashes", pa.binary()), ("checks", pa.binary())])
_HITS = pa.schema([("part", pa.int32()), ("places", pa.binary())])
_BASE, _CHECK_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs of bytes other than the ASCII white space \\x20 and \\x09-\\x0D."""
    return text.split() if text else []


class WordValues(dict):
    """word -> 64-bit value; forgotten when it has grown large, as values can be made again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, 7)
        return value


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64; base is odd."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up, down = np.full(n, base), np.full(n, inverse)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def window_hashes(values: np.ndarray, width: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` values, modulo 2^64."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return (sums[width:] - sums[:-width]) * down[: len(values) - width + 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack_ascending(x: np.ndarray) -> bytes:
    """Ascending numbers from 0 up as bytes: steps of 255 go on, a smaller byte ends a number."""
    steps = np.diff(x, prepend=0)
    ends = np.cumsum(steps // 255 + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(x) else 0, 255, np.uint8)
    out[ends] = steps % 255
    return out.tobytes()


def unpack_ascending(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps < 255]


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 64 bits as bytes, seven bits each and low ones first; and where each number begins, and the end."""
    x = x.astype(np.uint64, copy=False)
    size, rest = np.ones(len(x), np.int64), x >> np.uint64(7)
    while rest.any():
        size += rest > 0
        rest >>= np.uint64(7)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k) if k else slice(None)
        out[at[:-1][has] + k] = (x[has] >> np.uint64(7 * k)).astype(np.uint8) & 127 | (size[has] > k + 1).astype(np.uint8) << 7
    return out, at


def from_varints(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], last[:-1] + 1])
    nth = (np.arange(len(data)) - np.repeat(starts, last - starts + 1)).astype(np.uint64)
    return np.add.reduceat((data & np.uint8(127)).astype(np.uint64) << nth * np.uint64(7), starts)


def pack_places(doc_ids: np.ndarray, versions: np.ndarray | None, places: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The rows (doc_id, version, place) of each of the runs between ``bounds``, each run in that order, as bytes.

    A bit a row tells whether its document is another than the row before; if so the step from that doc_id and the place
    follow, else the step from that place.
    """
    new = np.ones(len(places), bool)
    new[1:] = doc_ids[1:] != doc_ids[:-1]
    if versions is not None:
        new[1:] |= versions[1:] != versions[:-1]
    new[bounds[:-1][bounds[:-1] < len(places)]] = True
    steps = places.astype(np.int64)
    steps[1:] -= np.where(new[1:], 0, places[:-1].astype(np.int64))
    heads = np.flatnonzero(new)
    of_doc = np.searchsorted(heads, bounds)
    ids = doc_ids[heads].astype(np.int64, copy=False)
    gaps = ids.copy()
    gaps[1:] -= ids[:-1]  # modulo 2^64
    first = of_doc[:-1][of_doc[:-1] < len(heads)]
    gaps[first] = ids[first]
    gap_bytes, gap_at = varints(gaps.view(np.uint64))
    step_bytes, step_at = varints(steps)
    out = []
    for a, b, c, d in zip(bounds[:-1].tolist(), bounds[1:].tolist(), of_doc[:-1].tolist(), of_doc[1:].tolist(), strict=True):
        own_gaps = gap_bytes[gap_at[c] : gap_at[d]].tobytes()
        own_versions = b"" if versions is None else versions[heads[c:d]].astype("<i8").tobytes()
        out.append(b"".join((np.array([b - a, len(own_gaps), len(own_versions)], "<u4").tobytes(), np.packbits(new[a:b]).tobytes(), own_gaps, own_versions, step_bytes[step_at[a] : step_at[b]].tobytes())))
    return out


def unpack_places(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, version, place, rows of each blob); versions are 0 where there are none."""
    ids, versions, places, sizes = [], [], [], []
    for blob in blobs:
        n, n_gaps, n_versions = np.frombuffer(blob, "<u4", 3).tolist()
        data = np.frombuffer(blob, np.uint8)
        at = 12 + -(-n // 8)
        new = np.unpackbits(data[12:at], count=n).astype(bool)
        doc = np.cumsum(new) - 1
        ids.append(np.cumsum(from_varints(data[at : at + n_gaps]).view(np.int64))[doc])
        own = data[at + n_gaps : at + n_gaps + n_versions]
        versions.append(own.copy().view("<i8")[doc] if n_versions else np.zeros(n, np.int8))
        steps = from_varints(data[at + n_gaps + n_versions :]).astype(np.int64)
        sums = np.cumsum(steps)
        heads = np.flatnonzero(new)
        places.append((sums - (sums[heads] - steps[heads])[doc]).astype(np.int32))
        sizes.append(n)
    empty = np.zeros(0, np.int64)
    return *(np.concatenate(x) if x else empty for x in (ids, versions, places)), np.array(sizes, np.int64)


def _blobs(bucket: np.ndarray, keys: list[tuple[int, int]], doc_ids: np.ndarray, versions: np.ndarray | None, places: np.ndarray, hashes: np.ndarray, checks: np.ndarray, settled: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per bucket: ``keys`` has each one's bucket and part.  Settled rows leave beside the others, without hashes."""
    whole = np.where(settled, bucket + len(keys), bucket).astype(np.int32)
    order = np.lexsort((places, *(() if versions is None else (versions,)), doc_ids, whole))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(whole, minlength=2 * len(keys)))])
    used = np.flatnonzero(np.diff(bounds))
    packed = pack_places(doc_ids[order], None if versions is None else versions[order], places[order], bounds[np.append(used, 2 * len(keys))])
    low, check = _low_bytes(hashes[order]), checks[order]
    rows = [(*keys[b % len(keys)], places_, b"" if b >= len(keys) else low[bounds[b] : bounds[b + 1]].tobytes(), b"" if b >= len(keys) else check[bounds[b] : bounds[b + 1]].tobytes()) for b, places_ in zip(used.tolist(), packed, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BLOB)], schema=_BLOB)


class _Chunk:
    """Documents of a scan task until they hold enough words."""

    def __init__(self, width: int, keys: list[int], check_bytes: int, versions: bool = True) -> None:
        self.width, self.keys, self.check_bytes, self.versions = width, keys, check_bytes, versions
        self.value, self.rows, self.n = WordValues(), [], 0

    def add(self, doc_id: int, version: int, text: bytes) -> bool:
        found = words(text)
        if len(found) >= self.width:
            self.rows.append((doc_id, version, np.fromiter(map(self.value.__getitem__, found), np.uint64, len(found))))
            self.n += len(found)
        return self.n >= CHUNK_WORDS

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        rows = sorted(self.rows, key=lambda r: r[0])
        self.rows, self.n = [], 0
        lengths = np.array([len(v) for _, _, v in rows])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        values = np.concatenate([v for _, _, v in rows])
        doc_ids, versions = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        del rows
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        at = np.flatnonzero(owner[: len(values) - self.width + 1] == owner[self.width - 1 :])
        hashes = _mixed(window_hashes(values, self.width)[at])
        checks = _mixed(window_hashes(values, self.width, _CHECK_BASE)[at]).astype(f"<u{self.check_bytes}")
        del values
        owner = owner[at]
        # Equal windows within the chunk: the first is of the smallest doc_id, as documents are in its order.
        order = np.argsort(hashes, kind="stable")
        sorted_ = hashes[order]
        head = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        first = np.repeat(order[head], np.diff(np.append(head, len(order))))
        later = np.zeros(len(order), bool)
        later[order] = (doc_ids[owner[order]] > doc_ids[owner[first]]) & (checks[order] == checks[first])
        del order, sorted_, head, first
        bucket = ((hashes >> np.uint64(32)) * np.uint64(len(self.keys)) >> np.uint64(32)).astype(np.int32)
        # Hits settled here pass through the shuffle beside the blobs: all of a document's in one of the buckets.
        bucket = np.where(later, (doc_ids[owner] % len(self.keys)).astype(np.int32), bucket)
        yield from _blobs(bucket, [(k, 0) for k in self.keys], doc_ids[owner], versions[owner] if self.versions else None, (at - starts[owner]).astype(np.int32), hashes, checks, later)


_HASH_BYTES = 7


def _low_bytes(hashes: np.ndarray) -> np.ndarray:
    """All but the top byte, which the bucket stands for, a row a hash."""
    return hashes.view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES]


def _from_low_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _HASH_BYTES, 8), np.uint8)
    out[:, :_HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _HASH_BYTES)
    return out.reshape(-1).view(np.uint64)


def _hits(doc_ids: np.ndarray, versions: np.ndarray, places: np.ndarray, keys: list[int], with_versions: bool) -> pa.RecordBatch:
    """A row per group of documents: the places of their hits."""
    part = (doc_ids.astype(np.uint64) * _BASE >> np.uint64(33)).astype(np.int64) % len(keys)
    order = np.lexsort((places, versions, doc_ids, part))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=len(keys)))])
    used = np.flatnonzero(np.diff(bounds))
    packed = pack_places(doc_ids[order], versions[order] if with_versions else None, places[order], bounds[np.append(used, len(keys))])
    return pa.RecordBatch.from_arrays([pa.array([keys[p] for p in used], pa.int32()), pa.array(packed, pa.binary())], schema=_HITS)


def _decoded(blobs: list[tuple[bytes, bytes, bytes]], check_bytes: int) -> tuple[np.ndarray, ...]:
    """(doc_id, version, place, hash, check, settled) of blobs (places, hashes, checks); settled ones have hash and check 0."""
    ids, versions, places, sizes = unpack_places([b[0] for b in blobs])
    settled = np.repeat(np.array([not b[1] for b in blobs], bool), sizes)
    hashes, checks = np.zeros(len(ids), np.uint64), np.zeros(len(ids), f"<u{check_bytes}")
    hashes[~settled] = _from_low_bytes(b"".join(b[1] for b in blobs))
    checks[~settled] = np.frombuffer(b"".join(b[2] for b in blobs), f"<u{check_bytes}")
    return ids, versions, places, hashes, checks, settled


def _settle(blobs: list[tuple[bytes, bytes, bytes]], check_bytes: int, keys: list[int], with_versions: bool) -> pa.RecordBatch:
    """The hits among the windows of a bucket's part: all but those of the smallest doc_id of each hash.

    Blobs without hashes are hits that a scan task has settled already.
    """
    ids, versions, places, hashes, checks, settled = _decoded(blobs, check_bytes)
    open_ = np.flatnonzero(~settled)
    order = open_[np.lexsort((ids[open_], checks[open_], hashes[open_]))]
    h, c, d = hashes[order], checks[order], ids[order]
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(h) else order
    hit = order[d > np.repeat(d[head], np.diff(np.append(head, len(order))))] if len(h) else order
    hit = np.concatenate([np.flatnonzero(settled), hit])
    return _hits(ids[hit], versions[hit], places[hit], keys, with_versions)


def _by_document(blobs: list[bytes]) -> pa.RecordBatch:
    """(doc_id, version, at): the ascending places of each document's hits."""
    ids, versions, places, _ = unpack_places(blobs)
    order = np.lexsort((places, versions, ids))
    ids, versions, places = ids[order], versions[order], places[order]
    other = np.concatenate([[True], (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1])]) if len(ids) else np.zeros(0, bool)
    heads = np.flatnonzero(other)
    at = [pack_ascending(np.unique(places[a:b])) for a, b in zip(heads, np.append(heads[1:], len(ids)), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids[heads], pa.int64()), pa.array(versions[heads].astype(np.int64), pa.int64()), pa.array(at, pa.binary())], ["doc_id", "version", "at"])


def removal_intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal [first, end) of words that windows at the ascending ``starts`` cover."""
    if not len(starts):
        return []
    heads = np.flatnonzero(np.concatenate([[True], np.diff(starts) > width]))
    return list(zip(starts[heads].tolist(), (starts[np.append(heads[1:], len(starts)) - 1] + width).tolist(), strict=True))


def shape_of(size: int, least: int) -> tuple[int, int, int]:
    """(buckets, parts of a bucket, bytes of check) for input files of ``size`` bytes, ``least`` buckets at least."""
    asked = max(least, -(-size // BUCKET_BYTES))
    buckets = min(asked, max(MOST_BUCKETS, least))
    windows = max(size // 4, 2)  # a window begins at each word, and words take four bytes of a file or more
    known = 8 * _HASH_BYTES + min(8, buckets.bit_length() - 1)
    bits = 2 * math.log2(windows) - 1 + 6 - known  # odds of 1 in 2^6 among all pairs
    return buckets, -(-asked // buckets), next(n for n in (1, 2, 4, 8) if 8 * n >= bits or n == 8)


def repeated_windows(docs: DataFrame, size: int, width: int = WIDTH, check_bytes: int | None = None) -> DataFrame:
    """(doc_id, version, at): per document, the starts of its windows that also start in a smaller doc_id.

    ``version`` is the text's hash: it tells apart rows that share a doc_id, and is 0 where no doc_id has two texts; rows
    of the same text too are treated alike.  ``size`` is that of the input's files.
    """
    spark = docs.sparkSession
    buckets, parts, check = shape_of(size, int(spark.conf.get("spark.sql.shuffle.partitions")))
    check = check_bytes or check
    keys = partition_keys(spark, buckets)
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("version"), F.col("text").cast("binary"))
    versions = not known.groupBy("doc_id").agg(F.min("version").alias("a"), F.max("version").alias("b")).where("a <> b").isEmpty()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(width, keys, check, versions)
        for batch in batches:
            for doc_id, version, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk.add(doc_id, version, text):
                    yield from chunk.flush()
        yield from chunk.flush()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blobs of many chunks as blobs of the bucket's parts."""

        def again(key: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            ids, own, places, hashes, checks, settled = _decoded(held, check)
            part = (hashes >> np.uint64(24) & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)
            yield from _blobs(part.astype(np.int32), [(key, p) for p in range(parts)], ids, own if versions else None, places, hashes, checks, settled)

        held, n, key = [], 0, None
        for batch in batches:
            for bucket, _, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (n >= CHUNK_WORDS or bucket != key):
                    yield from again(key, held)
                    held, n = [], 0
                key = bucket
                held.append(tuple(row))
                n += int.from_bytes(row[0][:4], "little")
        if held:
            yield from again(key, held)

    def grouped(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[tuple]]:
        """The rows of one key, the first ``n`` columns, at a time, without it."""
        key, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != key and rows:
                    yield rows
                    rows = []
                key = row[:n]
                rows.append(row[n:])
        if rows:
            yield rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in grouped(batches, 2):
            yield _settle(blobs, check, keys, versions)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in grouped(batches, 1):
            yield _by_document([places for (places,) in blobs])

    narrow = known if versions else known.withColumn("version", F.lit(0).cast("long"))
    blob = "bucket int, part int, places binary, hashes binary, checks binary"
    dealt = narrow.mapInArrow(cut, blob).repartition(buckets, "bucket")
    if parts > 1:
        dealt = dealt.mapInArrow(gathered, blob)
    hits = dealt.sortWithinPartitions("bucket", "part").mapInArrow(count, "part int, places binary")
    found = hits.repartition(buckets, "part").sortWithinPartitions("part").mapInArrow(gather, "doc_id long, version long, at binary")
    return found.withColumn("version", F.when(F.lit(versions), F.col("version")))


def _kept(text: bytes | None, at: bytes | None, width: int) -> tuple[list[bytes], int]:
    """(words that stay, how many go) of a text with repeated windows at ``at``."""
    own = words(text)
    if not at:
        return own, 0
    kept, end = [], 0
    for a, b in removal_intervals(unpack_ascending(at), width):
        kept += own[end:a]
        end = b
    kept += own[end:]
    return kept, len(own) - len(kept)


def _with_starts(rows: DataFrame, size: int, width: int, check_bytes: int | None) -> DataFrame:
    """``rows`` (any columns, doc_id and text among them) and last the starts of their repeated windows."""
    narrow = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    id_, version, at = (unused(rows.columns, name) for name in ("_id", "_version", "_at"))
    starts = repeated_windows(narrow, size, width, check_bytes)
    text = F.xxhash64(F.col("text").cast("string"))
    keyed = rows.withColumns({id_: F.col("doc_id").cast("long"), version: text})
    met = keyed.join(starts, (keyed[id_] == starts["doc_id"]) & (keyed[version] == F.coalesce(starts["version"], keyed[version])), "left")
    return met.select(*(keyed[c] for c in rows.columns), starts["at"].alias(at))


def remove_repeats(docs: DataFrame, width: int = WIDTH, check_bytes: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 of the kept words joined by spaces."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests = [], [], []
            for text, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, removed = _kept(text, at, width)
                n_words.append(len(kept) + removed)
                n_removed.append(removed)
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    met = _with_starts(docs.select("doc_id", "text"), estimated_bytes(docs), width, check_bytes).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), "_at")
    return met.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def keep_first_windows(docs: DataFrame, width: int = WIDTH, check_bytes: int | None = None) -> DataFrame:
    """``docs`` (any columns, doc_id and text among them) with repeated windows taken out of ``text``.

    A text that loses words becomes its kept words joined by one space, ``n_chars`` (if there is one) their length; a
    document that loses all its words goes.  Other texts stay as they are.
    """
    met = _with_starts(docs, estimated_bytes(docs), width, check_bytes)
    schema, text = docs.schema, docs.columns.index("text")
    n_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, at = list(batch.columns[:-1]), batch.column(batch.num_columns - 1).to_pylist()
            texts, sizes = columns[text].to_pylist(), columns[n_chars].to_pylist() if n_chars is not None else []
            stays = np.ones(len(at), bool)
            for i in (i for i, x in enumerate(at) if x):
                kept, _ = _kept(texts[i].encode(), at[i], width)
                texts[i], stays[i] = b" ".join(kept).decode(), bool(kept)
                if sizes:
                    sizes[i] = len(texts[i])
            columns[text] = pa.array(texts, columns[text].type)
            if sizes:
                columns[n_chars] = pa.array(sizes, columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1]).filter(pa.array(stays))

    return met.mapInArrow(cut, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP2_SQL = f"""
WITH cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM cut)
), hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS i FROM hits
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM cut) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM cut LEFT JOIN kept USING (doc_id)
"""
