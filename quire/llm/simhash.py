"""SimHash near-duplicates: fingerprints, a binary trie self-join within a Hamming budget, and its components.

Fingerprints of all documents are reduced to the distinct ones in Spark.  Two 64-bit fingerprints within ``budget``
differing bits agree on at least one of ``budget + 1`` equal blocks of bits, so for each block the trie is rotated to
begin with it: a subtree under one value of the block is joined with itself alone, and the subtrees are dealt out
over the tasks.  Within a subtree node pairs are walked down together, differing bits add up, and a pair is dropped
when they exceed the budget.  The walk is made with budgets 0..``budget`` in turn; a pair of nodes whose leaves all
are in one component by then is dropped too, as it can add no link between components.  That keeps dense groups of
near copies from being expanded into all their pairs.  Nodes are ranges of a sorted array, and the pairs of one depth
are handled at once by array operations; a walk that grows wide is finished piece by piece.

A task returns a link from each fingerprint to the first one of its component there: as many links as fingerprints
at most, and the same components as all pairs would give.  Components across tasks come from large-star and
small-star rounds over those links, written to the shared folder each round.

Defined results: a document without words (null or empty text) has fingerprint zero, which links like any other;
repeated rows share fingerprint and component; a null doc_id never names a component unless all its members are
null; an empty table gives no rows; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import join_skewed, materialize, partition_count, table, unused

BITS, BUDGET, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of a subtree that a task holds, at most twice as many.
MOST_LEAVES = 500_000
#: Bytes of the table of distinct fingerprints that a task's subtrees come from, under a million fingerprints.
PART_BYTES = 16_000_000
#: Node pairs that are walked down at once.
WIDE = 1_000_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash over the XXH64 of the text's word shingles; a bit is set if over half of them have it."""
    found = text.lower().split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    last = max(len(found) - shingle, 0)
    begins = [0, *(ends[:last] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(begins, ends[len(found) - last - 1 :].tolist(), strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero for none."""
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, version, fp): ``version`` tells apart rows that share a doc_id, ``fp`` has the bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(text, shingle) for text in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "version", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("version"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(each, "doc_id long, version long, fp long")


class Components:
    """Which component each of n leaves is in, named by its first leaf."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)
        self._count_changes()

    def _count_changes(self) -> None:
        self.changes = np.concatenate([[0], np.cumsum(self.of[1:] != self.of[:-1])])

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.of[self.of], self.of):
                self.of = up
        self._count_changes()

    def same(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
        """Whether all leaves of [a, a_end) and [b, b_end) are in one component."""
        return (self.changes[a_end - 1] == self.changes[a]) & (self.changes[b_end - 1] == self.changes[b]) & (self.of[a] == self.of[b])


def trie_self_join(keys: np.ndarray, roots: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """The component of each leaf.  ``keys``: leaves, ascending within each subtree; ``roots``: where subtrees begin.

    A subtree's leaves share all bits above the low ``depth`` ones; leaves of different subtrees are never linked.
    """
    found = Components(len(keys))
    ends = np.append(roots[1:], len(keys))
    several = ends - roots > 1
    subtree = np.repeat(np.arange(len(roots)), ends - roots)
    inside = keys & np.uint64((1 << depth) - 1) if depth < 64 else keys
    for allowed in range(budget + 1):
        a, a_end = roots[several], ends[several]
        waiting = [(depth, a, a_end, a, a_end, np.zeros(len(a), np.int8))]
        while waiting:
            bit, a, a_end, b, b_end, differ = waiting.pop()
            open_ = ~found.same(a, a_end, b, b_end)
            a, a_end, b, b_end, differ = (x[open_] for x in (a, a_end, b, b_end, differ))
            if len(a) > WIDE:  # nearest first: their links close later ones
                order = np.argsort(differ, kind="stable")[::-1]
                waiting += [(bit, *(x[part] for x in (a, a_end, b, b_end, differ))) for part in np.array_split(order, len(a) // WIDE + 1)]
                continue
            single = (a_end - a == 1) & (b_end - b == 1)  # the rest of both paths at once
            x, y = a[single], b[single]
            if bit:
                rest = (inside[x] ^ inside[y]) & np.uint64((1 << bit) - 1 if bit < 64 else 0xFFFFFFFFFFFFFFFF)
                close = differ[single] + np.bitwise_count(rest) <= allowed
                x, y = x[close], y[close]
            found.unite(x, y)
            a, a_end, b, b_end, differ = (v[~single] for v in (a, a_end, b, b_end, differ))
            if not len(a) or not bit:
                continue
            bit -= 1
            a_mid, b_mid = _split(inside, a, a_end, bit), _split(inside, b, b_end, bit)
            self_pair = a == b
            pairs = [(a, a_mid, b, b_mid, 0, True), (a_mid, a_end, b_mid, b_end, 0, True), (a, a_mid, b_mid, b_end, 1, True), (a_mid, a_end, b, b_mid, 1, ~self_pair)]
            kept = [(p, p_end, q, q_end, differ + more, (p_end > p) & (q_end > q) & (differ + more <= allowed) & also) for p, p_end, q, q_end, more, also in pairs]
            waiting.append((bit, *(np.concatenate([k[i][k[5]] for k in kept]) for i in range(5))))
    assert np.array_equal(subtree[found.of], subtree)
    return found.of


def _split(inside: np.ndarray, begin: np.ndarray, end: np.ndarray, bit: int) -> np.ndarray:
    """Where in each ascending [begin, end), whose leaves share all higher bits, the leaves with ``bit`` set begin."""
    begin, end = begin.copy(), end.copy()
    mask = np.uint64(1 << bit)
    while (open_ := np.flatnonzero(begin < end)).size:
        mid = (begin[open_] + end[open_]) // 2
        high = (inside[mid] & mask) != 0
        end[open_[high]] = mid[high]
        begin[open_[~high]] = mid[~high] + 1
    return begin


def near_links(nodes: DataFrame, budget: int = BUDGET, most_leaves: int = MOST_LEAVES) -> DataFrame:
    """(fp, to): links between distinct fingerprints ``fp`` of ``nodes`` that keep the components of all links.

    A subtree of more than ``most_leaves`` is cut into parts by hash, and each pair of parts is joined by a task of
    its own, so that no task holds more than twice that, however many fingerprints share a block.
    """
    width = -(-BITS // (budget + 1))
    blocks = [(at, min(at + width, BITS)) for at in range(0, BITS, width)]
    rows = nodes.select("fp", F.posexplode(F.array(*(F.shiftrightunsigned("fp", BITS - end).bitwiseAND((1 << (end - at)) - 1) for at, end in blocks))).alias("block", "value"))
    # At most one large subtree per `most_leaves` leaves.
    large = rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_leaves).select("block", "value", F.ceil(F.col("n") / most_leaves).cast("int").alias("cut"))
    cut = rows.join(large, ["block", "value"], "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), "cut").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda other: F.struct(F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi")))
    dealt = cut.select("fp", "block", "value", F.explode(pairs).alias("pair")).select("fp", "block", "value", "pair.lo", "pair.hi")
    parts = partition_count(nodes, PART_BYTES)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [tuple(c.to_numpy() for c in b.columns) for b in batches]
        if not read:
            return
        fps, block, lo, hi = (np.concatenate(x) for x in zip(*read, strict=True))
        fps = fps.view(np.uint64)
        for k, low, high in np.unique(np.stack([block, lo, hi]), axis=1).T.tolist():
            at, end = blocks[k]
            own = fps[(block == k) & (lo == low) & (hi == high)]
            turned = (own << np.uint64(at)) | (own >> np.uint64(BITS - at)) if at else own
            turned = np.sort(turned)
            top = turned >> np.uint64(BITS - (end - at))
            roots = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
            of = trie_self_join(turned, roots, BITS - (end - at), budget)
            linked = np.flatnonzero(of != np.arange(len(of)))
            back = (turned >> np.uint64(at)) | (turned << np.uint64(BITS - at)) if at else turned
            yield pa.RecordBatch.from_arrays([pa.array(back[linked].view(np.int64)), pa.array(back[of[linked]].view(np.int64))], ["fp", "to"])

    return dealt.repartition(parts, "block", "value", "lo", "hi").select("fp", "block", "lo", "hi").mapInArrow(join, "fp long, to long")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(fp, label) for every fingerprint in ``links``: label is the smallest one it can reach.

    Large-star and small-star rounds: every node hands its larger neighbours, then its smaller ones, to the smallest.
    """
    links = materialize(links.select(F.greatest("fp", "to").alias("hi"), F.least("fp", "to").alias("lo")).where("hi <> lo").distinct(), "links")
    seen = None
    for _ in range(rounds):
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = materialize(large, "links")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo")))
        links = materialize(small.distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.groupBy(F.col("hi").alias("fp")).agg(F.min("lo").alias("label")).unionByName(links.select(F.col("lo").alias("fp"), F.col("lo").alias("label")).distinct())


def nodes_of(fps: DataFrame) -> DataFrame:
    """(fp, first, copies): the distinct ``fp`` of (doc_id, version, fp), the first row and the number of rows of each."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")
    return materialize(fps.groupBy("fp").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("copies")), "nodes")


def first_of_components(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(fp, copies, first): per node its rows, and the first row of its component; ``labels`` (fp, label) has the linked ones."""
    joined = nodes.join(labels, "fp")
    named = joined.groupBy("label").agg(F.min("first").alias("of_all"))
    linked = joined.select("fp", "label").join(named, "label").select("fp", "of_all")
    return nodes.join(linked, "fp", "left").select("fp", "copies", F.coalesce("of_all", "first").alias("first"))


def _component_of_nodes(fps: DataFrame, budget: int) -> DataFrame:
    nodes = nodes_of(fps)
    return first_of_components(nodes, components(near_links(nodes, budget)))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    of = materialize(_component_of_nodes(fps, budget).select("fp", "copies", F.col("first.doc_id").alias("component_id")), "components")
    named = join_skewed(fps, of.drop("copies"), "fp", counts=of.select("fp", F.col("copies").alias("n")))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """The row of the smallest doc_id of each component of ``docs`` (any columns, doc_id and text among them)."""
    return keep_first(docs, _component_of_nodes(materialize(fingerprints(docs, shingle), "fingerprints"), budget))


def keep_first(docs: DataFrame, first: DataFrame) -> DataFrame:
    """One row of ``docs`` for each distinct row that ``first`` (first: doc_id, version) names."""
    unnamed, id_, version = F.lit(-(2**63)), unused(docs.columns, "_id"), unused(docs.columns, "_version")
    chosen = first.select(F.coalesce("first.doc_id", unnamed).alias(id_), F.col("first.version").alias(version)).distinct()
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), unnamed), version: F.xxhash64(F.col("text").cast("string"))})
    return keyed.join(chosen, [id_, version], "left_semi").dropDuplicates([id_, version]).select(*docs.columns)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
