"""Near copies by word shingles: SimHash and min-hash bands for candidates, exact Jaccard for every link.

Texts with equal sets of shingles are one node. SimHash fingerprints of these sets that differ
in few bits are found by pigeonhole tables, checked, and give the first links. They reach the
closest copies only (a similarity of 0.8 means some 10 of 64 bits), so min-hash bands complete
them: two nodes at similarity 0.8 agree on all rows of one of the ``BANDS`` bands but for three
such pairs in a million. Members of small buckets are all compared; those of large buckets are
joined by the rarest shingles of their sets, which loses no similar pair. Candidates are
compared by their whole sets of 64-bit shingle hashes, so no link is estimated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylink.llm import hashing, simhash
from quarrylink.llm.common import stored, utf8
from quarrylink.llm.components import connected_components
from quarrylink.llm.simhash import _LOWER

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
#: Members of a bucket that each member is compared with first, in order of node.
CHAIN = 3
#: Members of buckets up to this size are compared pair by pair; those of larger ones meet by rare shingles.
SMALL = 16
_RNG = np.random.Generator(np.random.PCG64(20240301))
_TIMES = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_BLOCK = 1 << 10
_MOST = 1 << 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE):
    """The sorted distinct shingle hashes of each row; fewer words than a shingle are one shingle."""
    for a, b in hashing.groups_of_rows(offsets):
        h, row_at = hashing.words(_LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])
        run = h[: max(0, len(h) - shingle + 1)]
        for k in range(1, shingle):
            run = hashing.joined(run, h[k : k + len(run)])
        for i, j in zip(row_at[:-1], row_at[1:], strict=True):
            if j - i >= shingle:
                yield np.unique(run[i : j - shingle + 1])
            elif j > i:
                one = h[i : i + 1]
                for k in range(i + 1, j):
                    one = hashing.joined(one, h[k : k + 1])
                yield one
            else:
                yield h[:0]


def bands_of(s: np.ndarray) -> np.ndarray:
    """A key for each band of the min-hashes of a set (an empty set has none)."""
    if not len(s):
        return s
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), _BLOCK):
            np.minimum(least, (s[at : at + _BLOCK, None] * _TIMES + _PLUS).min(0), out=least)
        keys = np.arange(BANDS, dtype=np.uint64)
        for row in least.reshape(BANDS, ROWS).T:
            keys = hashing.joined(keys, row)
    return keys


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) for p in parts)])
    values = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 42) - (1 << 63)


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, text_hash, node, n, fp, bands``: node is the hash of the set of n shingles, fp its SimHash fingerprint."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            nodes, sizes, fps, bands = [], [], [], []
            for s in shingle_sets(*utf8(batch.column(2))):
                nodes.append(_node(s))
                sizes.append(len(s))
                fps.append(simhash.majority(s))
                bands.append(bands_of(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), _lists(bands)], ["doc_id", "text_hash", "node", "n", "fp", "bands"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, node bigint, n int, fp bigint, bands array<bigint>")


def sets_of(docs: DataFrame, text: str) -> DataFrame:
    """``node, shingles`` of each row, a megabyte of text at a time."""

    def run(batches):
        for batch in batches:
            nodes, sets, held = [], [], 0
            for s in shingle_sets(*utf8(batch.column(0))):
                nodes.append(_node(s))
                sets.append(s)
                held += len(s)
                if held >= _MOST * 4:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(sets)], ["node", "shingles"])
                    nodes, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(sets)], ["node", "shingles"])

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "node bigint, shingles array<bigint>")


def _pairs_of(members: np.ndarray, sizes: np.ndarray, groups: np.ndarray | None, similarity: float):
    """Pairs of a bucket whose sizes allow the similarity: neighbours only, or (with groups) all of different groups."""
    left, right, held = [], [], 0
    fits = lambda i, j: np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j])
    for i in range(len(members) - 1):
        j = np.arange(i + 1, len(members) if groups is not None else min(len(members), i + 1 + CHAIN))
        j = j[fits(i, j)]
        if groups is not None:
            j = j[groups[j] != groups[i]]
        left.append(np.full(len(j), members[i]))
        right.append(members[j])
        held += len(j)
        if held >= _MOST:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _by_key(rows: DataFrame, pairs) -> DataFrame:
    """``a, b``: what ``pairs`` makes of the rows (``key, node, ..``) of whole keys, as a stream of sorted keys."""
    width = len(rows.columns)

    def run(batches):
        held = [np.zeros(0, np.int64)] * width

        def out(some):
            for x, y in pairs(some):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for batch in batches:
            some = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            whole = int(np.searchsorted(some[0], some[0][-1])) if len(some[0]) else 0
            if whole:
                yield from out([x[:whole] for x in some])
            held = [x[whole:] for x in some]
        if len(held[0]):
            yield from out(held)

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a bigint, b bigint")


def candidates(buckets: DataFrame, similarity: float) -> DataFrame:
    """``a, b``, a < b: pairs to compare, from ``key, node, n`` and perhaps ``component``."""
    grouped = "component" in buckets.columns

    def pairs(rows):
        cuts = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(rows[0])], strict=True):
            if b - a > 1:
                yield from _pairs_of(rows[1][a:b], rows[2][a:b], rows[3][a:b] if grouped else None, similarity)

    return _by_key(buckets.select("key", "node", "n", *["component"] * grouped), pairs).distinct()


def simhash_pairs(nodes: DataFrame, distance: int = simhash.DISTANCE) -> DataFrame:
    """``a, b``, a < b: nodes of fingerprints at ``distance`` bits or fewer, as edges that join all of these.

    Nodes of one fingerprint are tied to the smallest of them, and these to each other as
    pigeonhole tables and Hamming checks find them.
    """
    first = stored(nodes.filter("n > 0").groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("m")), "fingerprints")
    same = nodes.join(first.filter("m > 1"), "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = simhash.links(first.select("fp"), distance=distance).distinct()
    ends = (first.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_node")) for x in ("a", "b"))
    for end in ends:
        found = found.join(end, end.columns[0])
    every = same.unionAll(found.select("a_node", "b_node")).filter("a <> b")
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def prefix_rows(sets: DataFrame, similarity: float) -> DataFrame:
    """``key, node, n, place``: of each set the rarest shingles, one of which any similar set must share.

    ``sets`` has ``node, n, shingles``. Shingles are put in one order for all sets, by the
    number of sets and hash; of a set the first n - ceil(similarity n) + 1 are taken, each
    with its place. Shingles of one set only can't be shared and get no row.
    """
    each = sets.select("node", "n", F.explode("shingles").alias("key"))
    counted = each.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    shared = stored(each.join(counted, "key"), "shared-shingles")
    # shingles of one set only come first
    rows = shared.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("order")).withColumn("alone", F.col("n") - F.size("order"))
    rows = rows.select("node", "n", "alone", F.posexplode("order").alias("at", "s")).select(F.col("s.key").alias("key"), "node", "n", (F.col("at") + F.col("alone")).alias("place"))
    # a set that shares all but its first p shingles reaches the similarity only if n - p >= similarity n
    return rows.filter(F.col("n") - F.col("place") >= F.lit(similarity) * F.col("n") - 1e-6)


def _prefix_pairs(node: np.ndarray, n: np.ndarray, place: np.ndarray, group: np.ndarray, similarity: float):
    """Pairs of different groups that share a shingle and may be similar if it is the first that they share."""
    left, right, held = [], [], 0
    rest = n - place
    for i in range(len(node) - 1):
        j = np.arange(i + 1, len(node))
        most = np.minimum(rest[i], rest[j])
        j = j[(group[j] != group[i]) & (most * (1 + similarity) >= similarity * (n[i] + n[j].astype(np.int64)) - 1e-6)]
        left.append(np.minimum(node[i], node[j]))
        right.append(np.maximum(node[i], node[j]))
        held += len(j)
        if held >= _MOST:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b``, a < b: pairs of different components that may have the similarity, from ``node, n, component, shingles``.

    Two sets share their first common shingle at places from which the rest of either is
    large enough; so every similar pair is found by it, and what shares frequent shingles
    only, after many of its own, is not compared.
    """
    of = sets.select("node", "component")
    rows = prefix_rows(sets.drop("component"), similarity).join(of, "node").select("key", "node", "n", "place", "component")

    def pairs(rows):
        cuts = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(rows[0])], strict=True):
            if b - a > 1:
                yield from _prefix_pairs(*(x[a:b] for x in rows[1:]), similarity)

    return _by_key(rows, pairs).distinct()


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have the Jaccard similarity or more."""
    x, y = sets.select("node", "shingles").toDF("a", "x"), sets.select("node", "shingles").toDF("b", "y")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").filter(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, with_text_hash: bool = False) -> DataFrame:
    """``doc_id, component_id``: one row per input row; with ``text_hash`` (``xxhash64`` of the text) on request.

    Texts whose sets of five-word shingles have the Jaccard similarity or more are linked;
    texts without words are equal. ``component_id`` is the smallest doc_id of all that can be
    reached (null only if all ids there are null). Nodes of near fingerprints, and each member of a bucket and its
    next neighbours, are compared first, so that a group of close copies is one component after about as many
    comparisons as it has members. Then members of different components are: in buckets of few such components
    all pairs, in others those that share a rare shingle.
    """
    known = stored(sketches(docs, doc_id, text), "sketches")
    nodes = stored(known.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    rows = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    buckets = stored(rows.join(shared, "key", "left_semi"), "buckets")
    near = stored(simhash_pairs(nodes), "near-fingerprints")
    wanted = stored(buckets.select("node").unionAll(near.select("a")).unionAll(near.select("b")).distinct(), "bucket-nodes")
    sets = sets_of(docs, text).join(wanted, "node", "left_semi").dropDuplicates(["node"])
    sets = stored(sets, "shingle-sets")
    first = stored(near.unionAll(candidates(buckets, similarity)).distinct(), "first-pairs")
    links = stored(similar(first, sets, similarity), "links")
    groups = stored(connected_components(links), "link-groups")
    placed = stored(buckets.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    # what is of one component in a bucket needs no further comparison
    mixed = stored(placed.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key", "m"), "mixed-buckets")
    few = placed.join(mixed.filter(F.col("m") <= SMALL), "key", "left_semi")
    many = placed.join(mixed.filter(F.col("m") > SMALL), "key", "left_semi").select("node", "n", "component").distinct()
    rest = candidates(few, similarity).unionAll(prefix_pairs(many.join(sets, "node"), similarity)).distinct()
    links = links.unionAll(stored(similar(stored(rest, "more-pairs"), sets, similarity), "more-links"))
    groups = connected_components(links)
    named = stored(nodes.select("node", "least").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "node-groups")
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = stored(named.join(roots, "component").select("node", "component_id"), "node-components")
    return known.select("doc_id", "text_hash", "node").join(of, "node").select(F.col("doc_id").alias(doc_id), *["text_hash"] * with_text_hash, "component_id")
