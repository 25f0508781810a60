"""Near duplicates by the Jaccard similarity of word shingles: SimHash and MinHash candidates, each verified on the whole sets.

Each distinct set has a SimHash fingerprint.  The first sets of fingerprints that the trie join of ``simhash`` links within
its Hamming budget are candidates, and so is each other set of a fingerprint with its first.  Of the pairs of similarity 0.8
most differ in more bits than a trie can be walked with; MinHash finds those, and all that a star leaves out.

Documents are reduced to distinct sets of shingle hashes.  Sets that agree on all ``ROWS`` minima of one of ``BANDS``
bands share a bucket: a pair of similarity 0.8 shares none with odds of (1 - 0.8^4)^24, 3 in a million, and more
alike pairs with less.  Texts that are far less alike share buckets too, and where thousands are edits of one another
their pairs are many, so a task that holds a bucket compares its members' sketches, a byte of each of the 96 minima,
and passes on only pairs that agree in ``AGREE`` of them: a pair of similarity 0.8 falls short with odds of 1 in
100,000.  A link is a passed pair whose similarity, counted on both whole sets, is ``similarity`` or more.

The first round passes on a star for each bucket: the member that agrees with most others, as the text that others are
edits of does, and those.  After its links are verified, in the second round the members of a bucket that agree with one of
another component meet there with their whole sets, a row a member, and the task that holds them counts what their
pairs share, in the first of the buckets that a pair has in common; as soon as two components are linked the rest of their
pairs is left out.  Links within a component add nothing, so the components are those of all pairs, and no bucket is
expanded into its pairs.  A bucket of more than ``MOST`` members or ``MOST_SHINGLES`` is cut into parts and each pair of parts is
compared by a task of its own.

Defined results: words are split at ASCII blanks and A-Z lower-cased; a document of fewer than five words is one
shingle; documents without words (null or empty text) are copies of each other; repeated rows count once; columns other
than doc_id and text are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, partition_count
from quire.llm.simhash import BUDGET, components, first_of_components, keep_first, majority, near_links

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 24, 4
#: Minima that the sketches of a pair must agree in; it is set for a similarity of 0.8 and more.
AGREE = 60
#: Members of a bucket that a task compares with each other, or with as many of another part.
MOST = 4000
#: Shingles of those members' sets.
MOST_SHINGLES = 2_000_000
#: Bytes of the table of members that a task's buckets come from.
PART_BYTES = 4_000_000
#: Bytes that a block of comparisons takes.
BLOCK_BYTES = 32 << 20
#: Shingles whose minima are taken at once.
WIDE = 2048
_random = np.random.default_rng(SEED)
_FACTORS = (_random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_TERMS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 of the text's word shingles, ascending."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    last = max(len(found) - shingle, 0)
    begins = [0, *(ends[:last] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[len(found) - last - 1 :].tolist(), strict=True)], np.uint64))


def minima(found: np.ndarray) -> np.ndarray:
    """The least of each of the hashes of a set that isn't empty."""
    return np.min([(found[at : at + WIDE] * _FACTORS + _TERMS).min(axis=1) for at in range(0, len(found), WIDE)], axis=0)


def band_hashes(least: np.ndarray) -> list[int]:
    """A hash of each band's minima."""
    return [xxhash.xxh64_intdigest(least[at : at + ROWS].tobytes(), at) - (1 << 63) for at in range(0, BANDS * ROWS, ROWS)]


def sketch(least: np.ndarray) -> bytes:
    """A byte of each of the minima, from their middle: the top ones are small for every large set."""
    return (least >> np.uint64(24)).astype(np.uint8).tobytes()


def short(bands: list[int]) -> bytes:
    """Four bytes of each band's hash, which tell what buckets two sets share."""
    return np.array(bands, np.int64).astype("<u4").tobytes()


def _set_id(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.cast("binary").alias("text"))


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, version, fp, simhash, size, bands, sketch): ``version`` tells apart rows that share a doc_id, ``fp`` names the set of ``size`` shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, simhashes, sizes, bands, sketches = [], [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), shingle)
                least = minima(found) if len(found) else None
                ids.append(_set_id(found))
                simhashes.append(majority(found))
                sizes.append(len(found))
                bands.append([] if least is None else band_hashes(least))
                sketches.append(b"" if least is None else sketch(least) + short(bands[-1]))
            columns = [pa.array(ids, pa.int64()), pa.array(np.array(simhashes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "version", "fp", "simhash", "size", "bands", "sketch"])

    return _rows(docs).mapInArrow(each, "doc_id long, version long, fp long, simhash long, size int, bands array<long>, sketch binary")


def distinct_sets(signed: DataFrame) -> DataFrame:
    """(fp, first, copies, simhash, size, bands, sketch): the distinct sets, the first row and the number of rows of each."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")
    return signed.groupBy("fp").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in ("simhash", "size", "bands", "sketch")))


def simhash_pairs(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, to): pairs of sets whose SimHash fingerprints are linked, each to the first set of its own or the linked one.

    Every set that isn't empty and differs from another one in ``budget`` bits or fewer is in a pair; they keep all components.
    """
    own = nodes.where("size > 0").select("fp", "simhash")
    first = materialize(own.groupBy("simhash").agg(F.min("fp").alias("to"), F.count(F.lit(1)).alias("n")), "simhashes")
    same = own.join(first.where("n > 1"), "simhash").where("fp <> to").select("fp", "to")
    links = near_links(first.select(F.col("simhash").alias("fp")), budget).distinct().select(F.col("fp").alias("_fp"), F.col("to").alias("_to"))
    near = links.join(first.select(F.col("simhash").alias("_fp"), F.col("to").alias("a")), "_fp").join(first.select(F.col("simhash").alias("_to"), F.col("to").alias("b")), "_to")
    return same.unionByName(near.select(F.greatest("a", "b").alias("fp"), F.least("a", "b").alias("to")))


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(fp, found): the shingles of the sets in ``nodes`` (fp, first), made again from their first rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(2):
                found = shingles(text.as_py(), shingle)
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(found)], pa.int64()), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], ["fp", "found"])

    chosen = nodes.select(F.col("first.doc_id").alias("_id"), F.col("first.version").alias("_version"))
    rows = _rows(docs)
    there = rows.join(chosen, rows["doc_id"].eqNullSafe(chosen["_id"]) & (rows["version"] == chosen["_version"]), "left_semi").dropDuplicates(["doc_id", "version"])
    return there.mapInArrow(each, "fp long, found array<long>").dropDuplicates(["fp"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of ``pairs`` (fp, to) those whose sets' Jaccard similarity is ``similarity`` or more."""
    a, b = sets.select("fp", F.col("found").alias("a")), sets.select(F.col("fp").alias("to"), F.col("found").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    # The small term keeps pairs of exactly ``similarity`` in spite of rounding.
    return pairs.join(b, "to").join(a, "fp").where(both + 1e-9 >= similarity * (F.size("a") + F.size("b") - both)).select("fp", "to")


def agreeing(sketches: np.ndarray, sizes: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, which of all the rows may be alike): blocks of the members' comparisons with all of them."""
    step = max(BLOCK_BYTES // max(sketches.size, 1), 1)
    for at in range(0, len(sizes), step):
        same = (sketches[at : at + step, None, :] == sketches[None]).sum(axis=2, dtype=np.uint8) >= AGREE
        own = sizes[at : at + step, None]
        yield at, same & (np.minimum(own, sizes) + 1e-9 >= similarity * np.maximum(own, sizes))


_KEY = ["nth", "band", "lo", "hi"]
_MEMBER = "fp long, label long, size int, sketch binary, part int, nth int, band long, lo int, hi int"


class _Bucket:
    """The members of a bucket, or of a pair of its parts."""

    def __init__(self, rows: pa.Table, similarity: float) -> None:
        self.rows, self.similarity = rows, similarity
        self.fps, self.labels, self.sizes, self.part = (rows.column(i).to_numpy() for i in (0, 1, 2, 4))
        both = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint8).reshape(len(self.fps), -1)
        self.sketches, self.short = np.ascontiguousarray(both[:, : BANDS * ROWS]), np.ascontiguousarray(both[:, BANDS * ROWS :]).view("<u4")
        self.nth = rows.column(5)[0].as_py()
        self.across = rows.column(7)[0].as_py() != rows.column(8)[0].as_py()  # pairs within a part are another task's

    def alike(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, which of all the rows may be alike and have another label), block by block."""
        for at, same in agreeing(self.sketches, self.sizes, self.similarity):
            end = at + len(same)
            same &= self.labels[at:end, None] != self.labels
            if self.across:
                same &= self.part[at:end, None] != self.part
            yield at, same

    def first_here(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs share no bucket of a band before this one."""
        return ~(self.short[i, : self.nth] == self.short[j, : self.nth]).any(axis=1)


def _dealt(members: DataFrame) -> DataFrame:
    """Members (fp, label, size, sketch, nth, band, cut) of each pair of their buckets' parts."""
    own = F.pmod(F.xxhash64("fp"), "cut").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda other: F.struct(F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi")))
    dealt = members.withColumn("part", own).withColumn("pair", F.explode(pairs))
    return dealt.select("fp", "label", "size", "sketch", "part", "nth", "band", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"))


def _together(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, *_KEY).sortWithinPartitions(*_KEY)


def star_pairs(members: DataFrame, similarity: float, parts: int) -> DataFrame:
    """(fp, to): per bucket the pairs of the member that may be alike to most, and each one that has any as a pair with itself."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            bucket = _Bucket(rows, similarity)
            has, most = [], (0, 0, np.empty(0, np.int64))
            for at, alike in bucket.alike():
                counts = alike.sum(axis=1)
                has.append(np.flatnonzero(counts) + at)
                i = int(counts.argmax())
                if counts[i] > most[0]:
                    most = (int(counts[i]), at + i, np.flatnonzero(alike[i]))
            x, y = bucket.fps[np.concatenate([*has, np.full(len(most[2]), most[1])])], bucket.fps[np.concatenate([*has, most[2]])]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["fp", "to"])

    return _together(_dealt(members), parts).mapInArrow(compare, "fp long, to long").distinct()


def crossing(members: DataFrame, similarity: float, parts: int) -> DataFrame:
    """The members that may be alike to one of another label, in the first bucket that the two share."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            bucket = _Bucket(rows, similarity)
            if (bucket.labels == bucket.labels[0]).all():
                continue
            has = np.zeros(len(bucket.fps), bool)
            for at, alike in bucket.alike():
                i, j = np.nonzero(alike)
                first = bucket.first_here(i + at, j)
                has[j[first]] = True
            yield from rows.filter(pa.array(has)).combine_chunks().to_batches()

    return _together(_dealt(members), parts).mapInArrow(compare, _MEMBER)


def links_within(met: DataFrame, similarity: float, parts: int) -> DataFrame:
    """(fp, to): of the rows of ``crossing`` with their sets (found), links that join all components that any link joins."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            bucket = _Bucket(rows, similarity)
            found = [np.asarray(x.values) for x in rows.column(9)]
            starts = np.cumsum([0, *map(len, found)])[:-1]
            words, ids = np.unique(np.concatenate(found), return_inverse=True)
            _, component = np.unique(bucket.labels, return_inverse=True)
            mark, a, b = np.zeros(len(words), np.int32), [], []
            for at, alike in bucket.alike():
                for i in np.flatnonzero(alike.any(axis=1)).tolist():
                    j = np.flatnonzero(alike[i])
                    i += at
                    j = j[(j > i) & (component[j] != component[i])]
                    j = j[bucket.first_here(np.full(len(j), i), j)]
                    if not len(j):
                        continue
                    own = ids[starts[i] : starts[i] + len(found[i])]
                    mark[own] = 1
                    both = np.add.reduceat(mark[ids], starts)[j]
                    mark[own] = 0
                    # The small term keeps pairs of exactly ``similarity`` in spite of rounding.
                    for other in j[both + 1e-9 >= similarity * (bucket.sizes[i] + bucket.sizes[j] - both)].tolist():
                        if component[other] != component[i]:
                            component[component == component[other]] = component[i]
                            a.append(i)
                            b.append(other)
            x, y = bucket.fps[np.array(a, np.int64)], bucket.fps[np.array(b, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["fp", "to"])

    return _together(met, parts).mapInArrow(compare, "fp long, to long").distinct()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one bucket, or pair of its parts, at a time: what the limits of a part allow."""
    held: list[pa.Table] = []
    key = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in (5, 6, 7, 8)], axis=1)
        heads = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else []
        for a, b in zip(heads, [*heads[1:], len(keys)], strict=True):
            if held and tuple(keys[a]) != key:
                yield pa.concat_tables(held)
                held = []
            key = tuple(keys[a])
            held.append(pa.Table.from_batches([batch.slice(int(a), int(b - a))]))
    if held:
        yield pa.concat_tables(held)


def similar_links(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(fp, label) of all linked sets: label is the smallest set its links reach.  ``nodes`` as of ``distinct_sets``, written."""
    bands = nodes.select("fp", "size", F.posexplode("bands").alias("nth", "band"))
    shared = bands.groupBy("nth", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).where("n > 1")
    shared = shared.select("nth", "band", F.greatest(F.ceil(F.col("n") / MOST), F.ceil(F.col("shingles") / MOST_SHINGLES)).cast("int").alias("cut"))
    members = bands.drop("size").join(shared, ["nth", "band"])
    members = materialize(members.join(nodes.select("fp", "size", "sketch"), "fp"), "members")
    parts = partition_count(members, PART_BYTES)
    near = materialize(simhash_pairs(nodes), "near")
    near = near.unionByName(near.select("fp", F.col("fp").alias("to"))).unionByName(near.select(F.col("to").alias("fp"), "to"))
    pairs = materialize(star_pairs(members.withColumn("label", F.col("fp")), similarity, parts).unionByName(near).distinct(), "pairs")
    sets = materialize(sets_of(docs, nodes.join(pairs.where("fp = to").select("fp"), "fp", "left_semi"), shingle), "sets")
    links = materialize(verified(pairs.where("fp <> to"), sets, similarity), "links")
    labels = materialize(components(links), "labels")
    labelled = members.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    open_ = materialize(crossing(labelled, similarity, parts), "crossing")
    met = open_.join(sets, "fp").select(*open_.columns, "found")
    more = materialize(links_within(met, similarity, max(parts, partition_count(sets, PART_BYTES))), "links")
    return materialize(components(links.unionByName(more)), "labels")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The row of the smallest doc_id of each component of ``docs`` (any columns, doc_id and text among them)."""
    nodes = materialize(distinct_sets(signatures(docs, shingle)), "nodes")
    labels = similar_links(docs, nodes, shingle, similarity)
    return keep_first(docs, first_of_components(nodes.select("fp", "first", "copies"), labels))
