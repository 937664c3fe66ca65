"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and quantiles.

Trigrams of trusted documents are counted in tables sharded by their middle word. All that a
trigram or bigram needs (its count, its context's total and weight, the bigram below it) lies
in its own shard, so the counts are shuffled once and are the model as they are. Each
document's n-grams then meet the model: where the documents lie if it is small enough to
broadcast, or else shard by shard, packed, in rounds. A document's perplexity is
compared with a quantile of the perplexities of trusted documents of its language which the
model has not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from quarrylink.llm import hashing
from quarrylink.llm.common import discard, fresh, read, stored, utf8

ORDER = 3
#: At most so many trusted documents of each language are fitted, those with the smallest hashes of their ids; None: all.
MAX_TRAIN: int | None = None
#: Trusted documents whose id hash falls in this share are kept from fitting, to set thresholds.
HELD_OUT = 0.5
QUANTILE = 0.995
#: Factor of perplexity above the quantile that is still accepted.
MARGIN = 1.25
#: Words of the typical log probability that each document is given, so that a few odd words prove nothing.
PRIOR_WORDS = 20
#: Parts of the count tables, by the id of the middle word.
SHARDS = 64
#: Steps of log perplexity in which quantiles are told.
STEP = 0.001
#: Trigrams of a model that is broadcast (some 50 bytes each in a Python worker); a larger one meets the n-grams shard by shard.
BROADCAST_ROWS = 1_000_000
#: Ids of trusted documents that are broadcast; more are joined by a shuffle of the texts.
BROADCAST_IDS = 1_000_000
#: Rounds in which texts meet a larger model, each with its share of the texts; a round's shuffle files go before the next.
ROUNDS = 2
#: Bytes of text whose trigrams are sorted and sent together.
CHUNK = 4 << 20
#: Log probabilities are summed in whole numbers of this part, so that no order of sums matters.
_PART = 2.0**-32


def _back(x: np.ndarray, row_at: np.ndarray, n: int, pad: int) -> np.ndarray:
    """The word n places before each word, or what stands before a document."""
    place = np.arange(len(x)) - np.repeat(row_at[:-1], np.diff(row_at))
    w = np.zeros_like(x)
    w[n:] = x[: max(0, len(x) - n)]
    return np.where(place >= n, w, pad)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns change."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Vocabulary:
    """Ids of words by their hashes: a place in ``words``, then one for what stands before a document, one for all others."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words)
        self.sorted, self.pad, self.other = words[self.order], len(words), len(words) + 1

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(h), self.other)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], self.other)

    def trigrams(self, h: np.ndarray, row_at: np.ndarray, shards: int):
        """``order, first, middle, last``: the trigram that ends at each word, sorted by shard, middle, first and last word."""
        distinct, at = np.unique(h, return_inverse=True)
        # numbers among the chunk's own words are short enough for one sort key
        own, place = np.unique(np.append(self.ids(distinct), self.pad), return_inverse=True)
        at = place[at]
        first, middle = _back(at, row_at, 2, place[-1]), _back(at, row_at, 1, place[-1])
        by_shard = np.empty(len(own), np.int64)
        by_shard[np.lexsort((own, own % shards))] = np.arange(len(own))
        bits = len(own).bit_length()
        if 3 * bits < 64:
            order = np.argsort((by_shard[middle] << (2 * bits)) | (first << bits) | at)
        else:
            order = np.lexsort((at, first, by_shard[middle]))
        return order, own[first[order]], own[middle[order]], own[at[order]]


def _pack(first: np.ndarray, middle: np.ndarray, last: np.ndarray, x: np.ndarray) -> bytes:
    """Sorted trigrams and a number for each, by byte planes: a word is a step from the one above where all before it are equal."""
    new_first = np.diff(middle, prepend=-1) != 0
    new_last = new_first | (np.diff(first, prepend=-1) != 0)
    columns = np.diff(middle, prepend=0), np.where(new_first, first, np.diff(first, prepend=0)), np.where(new_last, last, np.diff(last, prepend=0)), x
    planes = [c.astype("<u4").view(np.uint8).reshape(-1, 4).T for c in columns]
    return zstandard.ZstdCompressor(3).compress(np.concatenate(planes).tobytes())


def _unpack(blob: bytes) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(16, -1)
    middle, first, last, x = (np.ascontiguousarray(planes[i : i + 4].T).reshape(-1).view("<u4").astype(np.int64) for i in range(0, 16, 4))
    new_first = middle != 0
    new_first[:1] = True
    new_last = new_first | (first != 0)

    def summed(steps: np.ndarray, new: np.ndarray) -> np.ndarray:
        total, at = np.cumsum(steps), np.flatnonzero(new)
        return total - np.repeat((total - steps)[at], np.diff(np.append(at, len(steps))))

    return [summed(first, new_first), np.cumsum(middle), summed(last, new_last), x]


def vocabulary(texts: DataFrame, text: str = "text") -> np.ndarray:
    """The hashes of all words of ``texts``, the most frequent first."""

    def found(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in hashing.groups_of_rows(offsets, CHUNK):
                h, n = np.unique(hashing.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    rows = texts.select(F.col(text).cast("string").alias("t")).mapInArrow(found, "h bigint, n bigint")
    got = stored(rows.groupBy("h").agg(F.sum("n").alias("n")), "words", clean=True)
    table = got.toArrow()
    discard(got)
    h, n = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    return h[np.lexsort((h, -n))]


def count_tables(texts: DataFrame, words: np.ndarray, text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``shard, n, packed``: the number of distinct trigrams of a shard, and these with their counts.

    Null and empty texts add nothing. Words are places in ``words``. Each task sends a distinct
    trigram of a few megabytes of text once, all of a shard as one packed row.
    """
    shared = texts.sparkSession.sparkContext.broadcast(Vocabulary(words))

    def triples(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in hashing.groups_of_rows(offsets, CHUNK):
                h, row_at = hashing.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(h):
                    continue
                _, first, middle, last = shared.value.trigrams(h, row_at, shards)
                at = _runs(middle, first, last)
                yield _by_shard(0, 0, shards, first[at], middle[at], last[at], np.diff(np.append(at, len(h))))

    def merged(key, table):
        parts = zip(*(_unpack(blob.as_py()) for blob in table.column("packed")), strict=True)
        first, middle, last, c = (np.concatenate(x) for x in parts)
        order = np.lexsort((last, first, middle))
        first, middle, last = first[order], middle[order], last[order]
        at = _runs(middle, first, last)
        packed = _pack(first[at], middle[at], last[at], np.add.reduceat(c[order], at))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([len(at)], pa.int64()), pa.array([packed], pa.binary())], ["shard", "n", "packed"])

    rows = texts.select(F.col(text).cast("string").alias("t")).mapInArrow(triples, _BLOCKS)
    return rows.select("shard", "packed").groupBy("shard").applyInArrow(merged, "shard int, n bigint, packed binary")


#: Rows of trigrams: a chunk of texts, the number of its texts, the shard, the trigrams and what is said of each.
_BLOCKS = "chunk bigint, rows int, shard int, packed binary"


def _by_shard(chunk: int, rows: int, shards: int, first, middle, last, x, *more: tuple[int, bytes]) -> pa.RecordBatch:
    """Trigrams that are sorted by shard as one row a shard, and ``more`` rows."""
    shard = middle % shards
    at = np.append(_runs(shard), len(shard))
    made = [(int(shard[a]), _pack(first[a:b], middle[a:b], last[a:b], x[a:b])) for a, b in zip(at, at[1:], strict=False)]
    made += more
    n = len(made)
    return pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.array([rows] * n, pa.int32()), pa.array([s for s, _ in made], pa.int32()), pa.array([p for _, p in made], pa.binary())], ["chunk", "rows", "shard", "packed"])


def _bigrams(middle: np.ndarray, last: np.ndarray):
    """Distinct (middle, last), how many trigrams each ends, and each trigram's place among them."""
    order = np.lexsort((last, middle))
    at = _runs(middle[order], last[order])
    counts = np.diff(np.append(at, len(order)))
    of = np.empty(len(order), np.int64)
    of[order] = np.repeat(np.arange(len(at)), counts)
    return middle[order][at], last[order][at], counts, of


def _discounts(n: dict[int, int]) -> np.ndarray:
    """Discounts of counts 1, 2 and more, from how many n-grams occur once to four times (Chen and Goodman).

    Where these are too few to tell, 0.5 is used.
    """
    y = n.get(1, 0) / (n.get(1, 0) + 2 * n.get(2, 0)) if n.get(1) and n.get(2) else 0
    return np.array([min(max(k - (k + 1) * y * n.get(k + 1, 0) / n[k], 0.05), k - 0.05) if n.get(k) and y else 0.5 for k in (1, 2, 3)])


def _discounted(c: np.ndarray, context_at: np.ndarray, d: np.ndarray):
    """For n-grams sorted by context: (c - d) / total of each, and the context's weight, also of each."""
    off = d[np.minimum(c, 3) - 1]
    size = np.diff(np.append(context_at, len(c)))
    total = np.add.reduceat(c, context_at).astype(float)
    gamma = np.add.reduceat(off, context_at) / total
    return (c - off) / np.repeat(total, size), gamma, np.repeat(gamma, size)


class Shard:
    """The model's n-grams with one shard's middle words, ready to be looked up."""

    def __init__(self, blob: bytes, cut: list[float], p1: np.ndarray, words: int):
        first, middle, last, c = _unpack(blob)
        self.base = words + 2
        two_middle, two_last, two_c, place = _bigrams(middle, last)
        context_at = _runs(two_middle)
        a, g, each = _discounted(two_c, context_at, np.array(cut[:3]))
        p2 = a + each * p1[two_last]
        three_at = _runs(middle, first)
        a, g3, each = _discounted(c, three_at, np.array(cut[3:]))
        contexts = np.repeat(np.arange(len(three_at)), np.diff(np.append(three_at, len(c))))
        self.p2 = two_middle * self.base + two_last, np.log(p2).astype(np.float32)
        self.gamma2 = two_middle[context_at], np.log(g).astype(np.float32)
        self.p3 = contexts * self.base + last, np.log(a + each * p2[place]).astype(np.float32)
        self.gamma3 = middle[three_at] * self.base + first[three_at], np.log(g3).astype(np.float32)

    def log_p(self, first: np.ndarray, middle: np.ndarray, last: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """The log probability of each last word after two others (``logs``: by its id alone)."""
        hit, at = _found(self.p2[0], middle * self.base + last)
        known, to = _found(self.gamma2[0], middle)
        out = np.where(hit, self.p2[1][at], logs[last] + np.where(known, self.gamma2[1][to], 0))
        known, to = _found(self.gamma3[0], middle * self.base + first)
        hit, at = _found(self.p3[0], to * self.base + last)
        return np.where(known & hit, self.p3[1][at], out + np.where(known, self.gamma3[1][to], 0))


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the numbers asked for are among sorted keys, and where."""
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return keys[at] == asked, at


class Tables:
    """The model as each worker holds it: words, and packed shards or none."""

    def __init__(self, words: np.ndarray, logs: np.ndarray, unseen: float, shards: int, cut: list[float] = (), blobs: dict[int, bytes] | None = None):
        self.words, self.shards, self.blobs, self.cut = Vocabulary(words), shards, blobs or {}, cut
        self.p1 = np.exp(logs)
        self.logs = np.concatenate([logs, [unseen, unseen]])
        self._open: dict[int, Shard] = {}

    def of(self, shard: int) -> Shard | None:
        if shard not in self._open and shard in self.blobs:
            # each packed table goes as it is opened
            self._open[shard] = Shard(self.blobs.pop(shard), self.cut, self.p1, len(self.p1))
        return self._open.get(shard)


class Model:
    """Packed counts ``shard, n, packed, cut`` (cut: discounts of bigrams and trigrams), the words with their own log probabilities, and that of a word never seen."""

    def __init__(self, packed: DataFrame, words: np.ndarray, logs: np.ndarray, unseen: float, shards: int = SHARDS):
        self.packed, self.words, self.logs, self.unseen, self.shards = packed, words, logs, unseen, shards
        self._shared = None

    def shared(self, most: int = BROADCAST_ROWS):
        """The tables as one broadcast, made once, or None if they have more than ``most`` trigrams."""
        if self._shared is None and (self.packed.agg(F.sum("n").alias("n")).first()["n"] or 0) <= most:
            got = self.packed.select("shard", "packed", "cut").collect()
            blobs = {r["shard"]: bytes(r["packed"]) for r in got}
            self._shared = self.packed.sparkSession.sparkContext.broadcast(Tables(self.words, self.logs, self.unseen, self.shards, list(got[0]["cut"]) if got else [], blobs))
        return self._shared


def fit(texts: DataFrame, text: str = "text") -> Model:
    """The model of ``texts``: log probabilities of n-grams and log weights of their contexts, kept as counts.

    The highest order has counts, lower orders the numbers of different words before, and the
    lowest is mixed with an even share for words never seen. The distinct words of ``texts``
    must be few enough for the driver, which holds a count of each.
    """
    words = vocabulary(texts, text)
    tables = stored(count_tables(texts, words, text), "trigram-counts", clean=True)

    def summaries(batches):
        for batch in batches:
            for blob in batch.column(0):
                first, middle, last, c = _unpack(blob.as_py())
                _, bi_last, bi_c, _ = _bigrams(middle, last)
                ids, before = np.unique(bi_last, return_counts=True)
                by_count = [np.unique(np.minimum(x, 5), return_counts=True) for x in (c, bi_c)]
                kind = np.repeat([3, 2, 1], [len(by_count[0][0]), len(by_count[1][0]), len(ids)])
                keys = np.concatenate([by_count[0][0], by_count[1][0], ids])
                yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(keys.astype(np.int64)), pa.array(np.concatenate([by_count[0][1], by_count[1][1], before]).astype(np.int64))], ["kind", "key", "c"])

    got = stored(tables.select("packed").mapInArrow(summaries, "kind int, key bigint, c bigint").groupBy("kind", "key").agg(F.sum("c").alias("c")), "continuations", clean=True)
    table = got.toArrow()
    discard(got)
    kind, keys, c = (table.column(i).to_numpy() for i in range(3))
    of = {n: dict(zip(keys[kind == n].tolist(), c[kind == n].tolist(), strict=True)) for n in (2, 3)}
    before = np.zeros(len(words), np.int64)
    before[keys[kind == 1]] = c[kind == 1]
    d1 = _discounts(dict(zip(*(x.tolist() for x in np.unique(before, return_counts=True)), strict=True)))
    alpha, gamma, _ = _discounted(before, np.zeros(1, np.int64), d1) if len(words) else (np.zeros(0), [1.0], None)
    even = float(gamma[0]) / (len(words) + 1)
    cut = F.array(*(F.lit(float(d)) for n in (2, 3) for d in _discounts(of[n])))
    packed = tables.withColumn("cut", cut)
    packed._stored_at = tables._stored_at
    return Model(packed, words, np.log(alpha + even), float(np.log(even)))


def log_probabilities(tables: Tables, h: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """The log probability of each word after its context."""
    out = np.empty(len(h))
    if not len(h):
        return out
    order, first, middle, last = tables.words.trigrams(h, row_at, tables.shards)
    shard = middle % tables.shards
    at = np.append(_runs(shard), len(shard))
    for a, b in zip(at, at[1:], strict=False):
        table = tables.of(int(shard[a]))
        out[order[a:b]] = tables.logs[last[a:b]] if table is None else table.log_p(first[a:b], middle[a:b], last[a:b], tables.logs)
    return out


def perplexities(docs: DataFrame, model: Model, text: str = "text", n_words: str = "n_words", log_p: str = "log_p", most: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` plus the number of words and the sum of their log probabilities (no words: 0 and 0.0).

    A model of at most ``most`` trigrams is joined where the documents lie; a larger one shard by shard.
    """
    shared = model.shared(most)
    if shared is None:
        return with_sums(docs, text_sums(docs, model, text), text, n_words, log_p)
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(n_words, LongType()), StructField(log_p, DoubleType())])

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            # half a megabyte at a time, so that working arrays and what goes back stay small
            for a, b in hashing.groups_of_rows(offsets, 1 << 19):
                h, row_at = hashing.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                whole = np.rint(log_probabilities(shared.value, h, row_at) / _PART).astype(np.int64)
                sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(whole)])
                columns = [*batch.slice(a, b - a).columns, pa.array(np.diff(row_at)), pa.array((sums[row_at[1:]] - sums[row_at[:-1]]) * _PART)]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, n_words, log_p])

    return docs.mapInArrow(run, schema)


def _identity(text: str) -> list[Column]:
    t = F.col(text).cast("string")
    return [F.xxhash64(t), F.xxhash64(F.lit(5), t)]


def text_sums(docs: DataFrame, model: Model, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``a, b, n, s``: of each text, by two 64-bit hashes, the number of words and the sum of their log probabilities.

    A chunk of texts sends each shard its trigrams, with the place of their texts, as one packed
    row. A task reads a shard's counts, then the rows that ask for it one after another, and
    sends sums by text; a chunk's sums are added up. Texts themselves are not shuffled.
    """
    spark = docs.sparkSession
    shards = model.shards
    shared = spark.sparkContext.broadcast(Tables(model.words, model.logs, model.unseen, shards))
    texts = docs.select(*_identity(text), F.col(text).cast("string")).toDF("a", "b", "t").filter("t is not null")
    counts = model.packed.select(F.lit(-1).cast("bigint").alias("chunk"), F.lit(0).alias("rows"), "shard", "packed", "cut")

    def sent(batches):
        task, chunk = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            same = np.stack([batch.column(i).to_numpy() for i in (0, 1)], 1)
            batch = batch.take(pa.array(np.sort(np.unique(same, axis=0, return_index=True)[1])))
            data, offsets = utf8(batch.column(2))
            for x, y in hashing.groups_of_rows(offsets, CHUNK):
                h, row_at = hashing.words(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                if not len(h):
                    continue
                order, first, middle, last = shared.value.words.trigrams(h, row_at, shards)
                row = np.repeat(np.arange(y - x), np.diff(row_at))[order]
                texts = np.concatenate([*(batch.column(i).to_numpy()[x:y] for i in (0, 1)), np.diff(row_at)]).astype("<i8")
                yield _by_shard(task + chunk, y - x, shards, first, middle, last, row, (-1, texts.tobytes()))
                chunk += 1

    def asked(batches):
        table, of = None, None
        for batch in batches:
            for chunk, rows, shard, packed, cut in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), batch.column(4), strict=True):
                if chunk < 0:
                    table, of = Shard(packed.as_py(), cut.as_py(), shared.value.p1, len(shared.value.p1)), shard
                    continue
                sums = packed.as_py()
                if shard >= 0:
                    first, middle, last, row = _unpack(sums)
                    logs = shared.value.logs
                    p = table.log_p(first, middle, last, logs) if of == shard else logs[last]
                    # halves, since numpy adds weights as floats: each stays exact
                    whole = np.rint(p / _PART).astype(np.int64)
                    high, low = (np.bincount(row, x, rows).astype(np.int64) for x in (whole >> 20, whole & 0xFFFFF))
                    sums = ((high << 20) + low).astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([shard], pa.int32()), pa.array([sums], pa.binary())], ["chunk", "shard", "sums"])

    def added(key, table):
        told, total = None, 0
        for shard, sums in zip(table.column("shard").to_pylist(), table.column("sums"), strict=True):
            x = np.frombuffer(sums.as_py(), "<i8")
            if shard < 0:
                told = x.reshape(3, -1)
            else:
                total = total + x
        return pa.table([*(pa.array(x) for x in told), pa.array(total * _PART)], ["a", "b", "n", "s"])

    parts = []
    for k in range(rounds):
        blocks = texts.filter(F.pmod(F.xxhash64(F.lit(11), "a"), F.lit(rounds)) == k).mapInArrow(sent, _BLOCKS)
        dealt = counts.unionByName(blocks.withColumn("cut", F.lit(None).cast("array<double>"))).repartition(shards, "shard").sortWithinPartitions("shard", "chunk")
        sums = dealt.mapInArrow(asked, "chunk bigint, shard int, sums binary").groupBy("chunk").applyInArrow(added, "a bigint, b bigint, n bigint, s double")
        parts.append(stored(sums, "text-sums", clean=True))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    # equal texts have equal sums
    return stored(out.groupBy("a", "b").agg(F.min("n").alias("n"), F.min("s").alias("s")), "sums", clean=True)


def with_sums(docs: DataFrame, sums: DataFrame, text: str = "text", n_words: str = "n_words", log_p: str = "log_p") -> DataFrame:
    """``docs`` plus what ``text_sums`` says of their texts (null texts: 0 and 0.0)."""
    own = fresh(docs, "text_hash", "text_hash_2")
    a, b, n, s = fresh(docs.withColumns(dict.fromkeys(own, F.lit(0))), "sums_a", "sums_b", "sums_n", "sums_s")
    out = docs.withColumns(dict(zip(own, _identity(text), strict=True))).join(sums.toDF(a, b, n, s), (F.col(own[0]) == F.col(a)) & (F.col(own[1]) == F.col(b)), "left")
    return out.select(*docs.columns, F.coalesce(n, F.lit(0)).alias(n_words), F.coalesce(s, F.lit(0.0)).alias(log_p))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality", max_train: int | None = MAX_TRAIN, held_out: float = HELD_OUT, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """``docs`` plus ``n_words, perplexity, threshold, keep``.

    Trusted text is that of documents labelled with quality 1. Half of it, by id hash,
    fits the model (all of it, or ``max_train`` documents a language); the other half sets the
    threshold of its language: ``margin`` times the ``quantile`` of its perplexities, the
    smallest step of ``STEP`` in log perplexity that so large a share does not exceed (equal
    perplexities fall on one side together). Languages without such documents, and null,
    take the threshold of all languages together. With no trusted text at all everything is
    kept. A document labelled both 1 and 0 is trusted; null labels and ids name nothing.

    Perplexity is taken over the document's words and ``PRIOR_WORDS`` more at the mean log
    probability of trusted text, so a short text is judged with care; null, empty and blank
    texts have no words, stand at that mean and are kept. Very long texts are scored whole.
    Repeated rows get equal results. An empty table gives no rows. Extra columns pass
    through; on a clash of names the new columns get a suffix (they are the last four).
    """
    out_n, out_p, out_t, out_k, lp, key = fresh(docs, "n_words", "perplexity", "threshold", "keep", "log_p", "threshold_lang")
    model, sums, by_lang, every, mean = thresholds(docs, labels, doc_id, text, lang, quality, max_train, held_out, quantile, margin)
    done = perplexities(docs, model, text, out_n, lp) if sums is None else with_sums(docs, sums, text, out_n, lp)
    done = done.withColumn(out_p, F.exp(_shrunk(F.col(out_n), F.col(lp), mean))).drop(lp)
    done = done.join(by_lang.withColumnsRenamed({"lang": key, "threshold": out_t}), F.col(lang) == F.col(key), "left").drop(key)
    done = done.withColumn(out_t, F.coalesce(F.col(out_t), F.lit(every).cast("double")))
    return done.withColumn(out_k, F.coalesce(F.col(out_p) <= F.col(out_t), F.lit(True)) | (F.col(out_n) == 0))


def _shrunk(n, s, mean: float):
    """Log perplexity over a document's words and ``PRIOR_WORDS`` more at the mean."""
    return -(s + F.lit(PRIOR_WORDS * mean)) / (n + F.lit(PRIOR_WORDS))


def quantiles(values: DataFrame, q: float, by: list[str]) -> DataFrame:
    """``by.., q``: the smallest step that a share q of the ``value`` of each group does not exceed.

    Values are counted by step before the shuffle, so a group has as many rows as steps.
    """
    steps = values.groupBy(*by, F.ceil(F.col("value") / STEP).alias("step")).agg(F.count("*").alias("n"))
    up_to, all_of = F.sum("n").over(W.partitionBy(*by).orderBy("step")), F.sum("n").over(W.partitionBy(*by))
    reached = steps.withColumn("up_to", up_to).withColumn("of", all_of).filter(F.col("up_to") >= F.lit(q) * F.col("of"))
    return reached.groupBy(*by).agg((F.min("step") * STEP).alias("q"))


def thresholds(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str, quality: str, max_train: int | None, held_out: float, quantile: float, margin: float):
    """The model; the sums of all texts, or None if the model is broadcast; ``lang, threshold``; the threshold of all languages; the mean log probability of a trusted word.

    Documents of the held-out half are scored where they lie, or by the sums, and only then
    joined to the labels, so that no text is shuffled.
    """
    trusted = labels.filter(F.col(quality) == 1).select(F.col(doc_id).alias("id")).distinct()
    part = F.pmod(F.xxhash64(F.lit(3), F.col("id")), F.lit(1000)) < int(held_out * 1000)
    sample = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("l")).join(trusted.filter(~part), "id", "left_semi") if max_train is not None else None
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    if max_train is None:
        ids = stored(trusted.filter(~part), "trusted-ids", clean=True)
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    # a join with very many ids shuffles texts: those of the other half stay out of it
    texts = texts.filter(~part).join(ids, "id", "left_semi") if max_train is None else texts.join(F.broadcast(_smallest(sample, max_train)), "id", "left_semi")
    texts = stored(texts, "trusted-text", clean=True)
    model = fit(texts)
    discard(texts)
    held = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("l"), F.col(text).alias("text")).filter(part)
    sums = text_sums(docs, model, text) if model.shared() is None else None
    if sums is not None:
        discard(model.packed)
    scored = (perplexities(held, model) if sums is None else with_sums(held, sums)).select("id", "l", "n_words", "log_p").filter("n_words > 0")
    scored = stored(scored.join(trusted, "id", "left_semi"), "held-out", clean=True)
    mean = (scored.agg((F.sum("log_p") / F.sum("n_words")).alias("m")).first() or {"m": None})["m"] or 0.0
    values = scored.select("l", _shrunk(F.col("n_words"), F.col("log_p"), mean).alias("value"))
    limit = F.exp("q") * margin
    every = quantiles(values.withColumn("l", F.lit(0)), quantile, ["l"]).select(limit.alias("q")).first()
    by_lang = quantiles(values.filter("l is not null"), quantile, ["l"]).select(F.col("l").alias("lang"), limit.alias("threshold"))
    return model, sums, stored(by_lang, "thresholds"), every and every["q"], mean


def _smallest(sample: DataFrame, n: int, salts: int = 64) -> DataFrame:
    """The ids with the n smallest hashes of each language.

    Each of ``salts`` parts of a language is cut to n first, so the last step has at most
    ``salts`` times n short rows of a language, even one with a third of all rows.
    """
    rows = sample.distinct().withColumn("h", F.xxhash64(F.lit(7), F.col("id"))).withColumn("salt", F.pmod("h", F.lit(salts)))
    parts = rows.withColumn("r", F.row_number().over(W.partitionBy("l", "salt").orderBy("h", "id"))).filter(F.col("r") <= n)
    best = parts.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("h", "id"))).filter(F.col("r") <= n)
    return best.select("id").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by perplexity."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = classify(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_words", F.round("perplexity", 4).alias("perplexity"), F.round("threshold", 4).alias("threshold"), "keep")
