"""SimHash near-duplicates: pigeonhole blocks, Hamming checks and connected components.

Fingerprints of 64 bits are split into blocks. Two that differ in at most d bits agree on at
least blocks - d of them, so each choice of that many blocks is a table, and close pairs
share a key in one table or more. Equal fingerprints are one node throughout, so copies
never meet in a bucket.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylink.llm import hashing
from quarrylink.llm.common import read, stored, utf8
from quarrylink.llm.components import connected_components

SHINGLE = 4
DISTANCE = 4
SEED = 42
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Runs of equal keys up to this length are compared pair by pair; longer ones by growing groups.
_SHORT = 8


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each row of a batch of UTF-8 texts (see ``fingerprints``), a megabyte at a time."""
    parts = [_fingerprints_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle, seed) for a, b in hashing.groups_of_rows(offsets)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    low = _LOWER[data]
    starts, ends = hashing.word_bounds(low, offsets)
    row_at = np.searchsorted(starts, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    sizes = ends - starts
    # the words of a row joined by single spaces, so that a shingle is one slice
    places = np.cumsum(sizes + 1) - (sizes + 1)
    flat = np.full(int((sizes + 1).sum()), 32, np.uint8)
    if len(starts):
        source = np.repeat(starts - places, sizes)
        target = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)
        flat[target] = low[source + target]
    text, digest = flat.tobytes(), xxhash.xxh64_intdigest
    begins, finish = places.tolist(), (places + sizes).tolist()
    for i in range(len(out)):
        a, b = int(row_at[i]), int(row_at[i + 1])
        if a == b:
            continue
        last = b if b - a < shingle else a + (b - a - shingle + 1)
        if b - a < shingle:
            h = [digest(text[begins[a] : finish[b - 1]], seed)]
        else:
            h = [digest(text[s:e], seed) for s, e in zip(begins[a:last], finish[a + shingle - 1 : b], strict=True)]
        out[i] = majority(np.array(h, np.uint64))
    return out


def majority(h: np.ndarray) -> np.uint64:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h)).view(">u8")[0]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fp``: 64-bit SimHash of each text as a signed long.

    A-Z are lower-cased; words are runs of anything but ASCII white space; each shingle of
    words, repeats included, is hashed by XXH64. Fewer words than a shingle are one shingle;
    no words (null, empty or blank text) give 0.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fp = fingerprints_of(*utf8(batch.column(1)), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def masks(n: int, distance: int = DISTANCE) -> list[int]:
    """A mask of bits for each table.

    The number of blocks grows with the number of fingerprints, so that a key has about as
    many bits as are needed to tell n fingerprints apart. Any number of blocks finds every
    close pair; it only sets how many strangers share a bucket.
    """
    for blocks in range(distance + 1, 64):
        agree = blocks - distance
        if 64 * agree / blocks >= log2(max(n, 2)) - 1 or blocks == distance + 6:
            break
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), agree)]


def _near(one: np.uint64, many: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(many ^ one) <= distance


def linked(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is close within each run of equal keys (keys are sorted).

    In long runs a group grows from its first member, each member being compared with those
    that are not in a group yet, and every member gets one edge to the first. So a run of m
    gives fewer than m edges, and a dense run takes about m comparisons for each round.
    """
    left, right = [], []
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    size = np.diff(np.append(first, len(keys)))
    long = np.repeat(size > _SHORT, size)
    for step in range(1, _SHORT):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & ~long[step:])
        at = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= distance]
        left.append(fps[at])
        right.append(fps[at + step])
    for a, n in zip(first[size > _SHORT], size[size > _SHORT], strict=True):
        rest = fps[a : a + n]
        while len(rest) > 1:
            root, queue, rest = rest[0], [rest[:1]], rest[1:]
            while queue and len(rest):
                for one in queue.pop():
                    close = _near(one, rest, distance)
                    if close.any():
                        found, rest = rest[close], rest[~close]
                        queue.append(found)
                        left.append(found)
                        right.append(np.full(len(found), root))
                        if not len(rest):
                            break
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def links(distinct: DataFrame, fp: str = "fp", distance: int = DISTANCE) -> DataFrame:
    """``a, b``: edges between distinct fingerprints that join all that differ in ``distance`` bits or fewer.

    ``distinct`` has each fingerprint once. Buckets hold 8 bytes for a distinct fingerprint
    and nothing else, and are read as a stream of sorted keys.
    """
    tables = masks(distinct.count(), distance)
    keyed = distinct.select(F.col(fp).alias("fp"), F.posexplode(F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in tables))).alias("t", "mask"))
    keyed = keyed.select(F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")

    def run(batches):
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k, f):
            a, b = linked(k, f, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = np.searchsorted(k, k[-1]) if len(k) else 0
            if whole:
                yield out(k[:whole], f[:whole])
            held_k, held_f = k[whole:], f[whole:]
        if len(held_k):
            yield out(held_k, held_f)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per input row.

    Fingerprints at ``distance`` bits or fewer are linked, equal ones too, those of texts
    without words like any other. ``component_id`` is the smallest doc_id of all that can be
    reached (null only if all ids there are null). Rows with equal ids and different texts
    link the components of both texts only if these are close themselves. Extra columns are
    ignored; an empty table gives no rows.
    """
    fps = stored(fingerprints(docs, doc_id, text), "fingerprints")
    smallest = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    groups = connected_components(links(smallest.select("fp"), distance=distance))
    named = smallest.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = stored(named, "fingerprint-groups")
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = stored(named.join(roots, "component").select("fp", "component_id"), "fingerprint-components")
    out = fps.join(of, "fp")
    return out.select(F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(read(spark, sf_dir, "documents"))
