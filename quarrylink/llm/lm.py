"""Stupid-backoff scores with n-gram counts of the whole corpus.

The corpus is dealt into chunks of documents. A chunk explodes its n-grams and sends each
distinct one once, with its count there, to the shard that the n-gram's hash names; a shard
holds the count table of its n-grams, made from all chunks, and joins it back to every
chunk's n-grams. A chunk then has the counts of all its n-grams and sums the scores of each
of its documents. So the shuffle carries distinct n-grams of chunks, in packed blocks, and a
very frequent n-gram is one entry per chunk.

Chunks and shards grow with the root of the corpus beyond ``BASE_BYTES``, so the number of
blocks (chunks times shards) grows as the corpus does, and a block keeps its mean size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylink.llm import hashing
from quarrylink.llm.common import fresh, read, utf8

ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 2
CHUNK_BYTES = 12 << 20
SHARD_BYTES = 24 << 20
#: Size of text up to which chunks and shards have the sizes above; at 100 times as much they have 10 times these.
BASE_BYTES = 16 << 30
#: Chunks at least, so that a small corpus is dealt evenly, too.
MIN_CHUNKS = 48
KEY_BITS = np.uint64(56)


def _keys(hashes: np.ndarray, row_at: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the 56-bit key of the n-gram that ends at each word, 0 where a document is too short."""
    place = np.arange(len(hashes)) - np.repeat(row_at[:-1], np.diff(row_at))
    out, run = [], hashes
    for n in range(1, order + 1):
        if n > 1:
            longer = np.zeros_like(hashes)
            # an n-gram is its first n-1 words, one place back, and the last word
            longer[1:] = hashing.joined(run[:-1], hashes[1:])
            run = longer
        key = (hashing.mix(run + np.uint64(n)) >> (np.uint64(64) - KEY_BITS)) | np.uint64(1)
        out.append(np.where(place >= n - 1, key, np.uint64(0)))
    return out


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys and their counts. The low four bytes of the steps between keys do not compress and stay as they are."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    wide = counts.astype("<u4").view(np.uint8).reshape(-1, 4).T
    high = zstandard.ZstdCompressor(1).compress(np.concatenate([planes[4:7], wide]).tobytes())
    return len(keys).to_bytes(8, "little") + np.ascontiguousarray(planes[:4]).tobytes() + high


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    high = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 + 4 * n :]), np.uint8).reshape(7, n)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :4], steps[:, 4:7] = np.frombuffer(blob, np.uint8, 4 * n, 8).reshape(4, n).T, high[:3].T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64), np.ascontiguousarray(high[3:].T).reshape(-1).view("<u4")


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = np.sort(keys[keys > 0])
    first = np.flatnonzero(np.diff(found, prepend=np.uint64(0)))
    return found[first], np.diff(np.append(first, len(found)))


def dealt(size: int) -> tuple[int, int]:
    """How many chunks and shards a corpus of so many bytes has."""
    times = max(1.0, math.sqrt(size / BASE_BYTES))
    chunks = math.ceil(size / (CHUNK_BYTES * times))
    return max(1, chunks, min(MIN_CHUNKS, size >> 16)), max(1, math.ceil(size / (SHARD_BYTES * times)))


def _cut(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's range of keys begins among sorted keys."""
    edges = [(s << int(KEY_BITS)) // shards for s in range(shards + 1)]
    return np.searchsorted(keys, np.array(edges, np.uint64))


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """``key, n_words, n_order_1..n, score_micro``: the sum of log scores of each document.

    Words are runs of anything but ASCII white space, as they are. The score of a word after
    its last order-1 words of the same document is c(n-gram) / c(its first words) if the
    n-gram occurs at least ``min_count`` times in all documents; if not, ``backoff`` times
    the score after one word less; a single word has c(word) / N. The first words of a
    document start at the order that their place allows, at no discount. Natural logs are
    rounded to millionths and added as integers, so the order of adding does not matter.

    Null and empty texts have no words and a score of 0; very long texts are scored whole, in
    one chunk. Rows with equal keys are rows of their own; null keys are kept; extra columns
    are ignored. An empty table gives no rows. N-grams are told apart by 56 bits of hash.
    """
    (chunk,) = fresh(docs, "chunk")
    size, corpus_words = docs.agg(F.sum(F.octet_length(F.col(text))), F.sum(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")))).first()
    size, corpus_words = size or 0, max(1, corpus_words or 0)
    chunks, shards = dealt(size)
    kind = docs.schema[key].dataType.simpleString()
    # equal rows land in one chunk; a hot key with different texts is spread
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.pmod(F.xxhash64(F.col(key), F.xxhash64(F.col(text))), F.lit(chunks)).cast("int").alias(chunk))
    spread = rows.repartition(max(chunks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), chunk)

    def ask(keys, table):
        if not table.num_rows:
            return None
        out = []
        for n, k in enumerate(_keys(*_words(table.column("t")), order), 1):
            distinct, counts = _distinct(k)
            cuts = _cut(distinct, shards)
            out += [(n, int(s), _pack(distinct[cuts[s] : cuts[s + 1]], counts[cuts[s] : cuts[s + 1]])) for s in np.flatnonzero(np.diff(cuts))]
        return keys, out

    def asked(key_scalars, table):
        found = ask(key_scalars[0].as_py(), table)
        rows = found[1] if found else []
        return pa.table({"chunk": pa.array([key_scalars[0].as_py()] * len(rows), pa.int32()), "n": pa.array([r[0] for r in rows], pa.int32()), "shard": pa.array([r[1] for r in rows], pa.int32()), "block": pa.array([r[2] for r in rows], pa.binary())})

    def answer(key_scalars, table):
        n, shard = key_scalars[0].as_py(), key_scalars[1].as_py()
        blocks = [_unpack(b.as_py()) for b in table.column("block")]
        every = np.concatenate([k for k, _ in blocks])
        at = np.argsort(every, kind="stable")
        ordered = every[at]
        first = np.flatnonzero(np.diff(ordered, prepend=np.uint64(0)))
        totals = np.add.reduceat(np.concatenate([c for _, c in blocks]).astype(np.int64)[at], first)
        every[at] = np.repeat(totals, np.diff(np.append(first, len(at)))).astype(np.uint64)
        ends = np.cumsum([len(k) for k, _ in blocks])
        out = [zstandard.ZstdCompressor(1).compress(every[b - len(k) : b].astype("<u8").tobytes()) for b, (k, _) in zip(ends, blocks, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "n": pa.array([n] * len(out), pa.int32()), "shard": pa.array([shard] * len(out), pa.int32()), "total": pa.array(out, pa.binary())})

    def sums(key_scalars, left, right):
        hashes, row_at = _words(left.column("t"))
        keys = _keys(hashes, row_at, order)
        parts: dict[int, list] = {n: [] for n in range(1, order + 1)}
        for n, s, t in zip(right.column("n").to_pylist(), right.column("shard").to_pylist(), right.column("total"), strict=True):
            parts[n].append((s, np.frombuffer(zstandard.ZstdDecompressor().decompress(t.as_py()), "<u8")))
        counts = []
        for n, k in enumerate(keys, 1):
            total = np.concatenate([x for _, x in sorted(parts[n], key=lambda p: p[0])]) if parts[n] else np.zeros(0, "<u8")
            distinct, inverse = np.unique(k, return_inverse=True)
            had = np.zeros(len(distinct), np.int64)
            had[np.flatnonzero(distinct > 0)] = total
            counts.append(had[inverse])
        words_n = len(hashes)
        logs = np.log(np.maximum(counts[0], 1) / corpus_words)
        level = np.ones(words_n, np.int8)
        place = np.arange(words_n) - np.repeat(row_at[:-1], np.diff(row_at))
        for n in range(2, order + 1):
            can = place >= n - 1
            seen = can & (counts[n - 1] >= min_count)
            before = np.ones(words_n, np.int64)
            before[1:] = np.maximum(counts[n - 2][:-1], 1)
            logs = np.where(seen, np.log(np.maximum(counts[n - 1], 1) / before), np.where(can, logs + math.log(backoff), logs))
            level = np.where(seen, n, level)
        micro = np.rint(logs * 1e6).astype(np.int64)
        run = np.concatenate([[0], np.cumsum(micro)])
        cols = {"k": left.column("k"), "n_words": pa.array(np.diff(row_at), pa.int64())}
        for n in range(1, order + 1):
            hit = np.concatenate([[0], np.cumsum(level == n)])
            cols[f"n_order_{n}"] = pa.array(hit[row_at[1:]] - hit[row_at[:-1]], pa.int64())
        cols["score_micro"] = pa.array(run[row_at[1:]] - run[row_at[:-1]], pa.int64())
        return pa.table(cols)

    requests = spread.groupBy(chunk).applyInArrow(asked, "chunk int, n int, shard int, block binary")
    answers = requests.groupBy("n", "shard").applyInArrow(answer, "chunk int, n int, shard int, total binary")
    levels = ", ".join(f"n_order_{n} bigint" for n in range(1, order + 1))
    out = spread.groupBy(chunk).cogroup(answers.groupBy("chunk")).applyInArrow(sums, f"k {kind}, n_words bigint, {levels}, score_micro bigint")
    return out.withColumnRenamed("k", key)


def _words(column) -> tuple[np.ndarray, np.ndarray]:
    return hashing.words(*utf8(column))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff scores of all documents."""
    return score(read(spark, sf_dir, "documents"))


ORACLE = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, i, ws[i] AS w3, CASE WHEN i > 1 THEN ws[i-1] END AS w2, CASE WHEN i > 2 THEN ws[i-2] END AS w1
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
n AS (SELECT count(*) AS n FROM t),
c1 AS (SELECT w3 AS x, count(*) AS c FROM t GROUP BY 1),
c2 AS (SELECT w2 AS x, w3 AS y, count(*) AS c FROM t WHERE i > 1 GROUP BY 1, 2),
c3 AS (SELECT w1 AS x, w2 AS y, w3 AS z, count(*) AS c FROM t WHERE i > 2 GROUP BY 1, 2, 3),
s AS (SELECT doc_id, i, CASE WHEN i > 2 AND c3.c >= {MIN_COUNT} THEN 3 WHEN i > 1 AND b.c >= {MIN_COUNT} THEN 2 ELSE 1 END AS level,
    CASE WHEN i > 2 AND c3.c >= {MIN_COUNT} THEN ln(c3.c / p.c)
      WHEN i > 1 AND b.c >= {MIN_COUNT} THEN ln(b.c / q.c) + CASE WHEN i > 2 THEN ln({BACKOFF}) ELSE 0 END
      ELSE ln(u.c / n.n) + ln({BACKOFF}) * least(i - 1, 2) END AS logs
  FROM t CROSS JOIN n JOIN c1 u ON u.x = w3 LEFT JOIN c2 b ON b.x = w2 AND b.y = w3 LEFT JOIN c1 q ON q.x = w2
  LEFT JOIN c2 p ON p.x = w1 AND p.y = w2 LEFT JOIN c3 ON c3.x = w1 AND c3.y = w2 AND c3.z = w3)
SELECT doc_id, count(i) AS n_words, count(*) FILTER (level = 1 AND i IS NOT NULL) AS n_order_1, count(*) FILTER (level = 2) AS n_order_2,
  count(*) FILTER (level = 3) AS n_order_3, CAST(coalesce(sum(CAST(round(logs * 1000000) AS BIGINT)), 0) AS BIGINT) AS score_micro
FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id
"""
