"""Packing tokenised documents into sequences by shortest-pack-first over the length histogram.

Documents longer than a sequence are cut into full pieces and a rest. The histogram of the
pieces' lengths (at most ``max_tokens`` bins, whatever the corpus) is packed on the driver:
lengths go longest first, each into the kind of pack with the most room left, and one step
moves a whole bin by changing the counts of packing patterns. The patterns are then joined
back to the pieces by their rank among pieces of the same length.
"""

from __future__ import annotations

import base64
import zlib
from bisect import insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylink.llm.common import read, stored

MAX_TOKENS = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    """The path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def encoder(path: str):
    """A function from a list of texts to arrays of ids, as ``tokenizers`` gives them for a byte-level BPE file.

    A ``.json`` file that has a rank file ``.tiktoken`` of the same vocabulary beside it is run by
    the faster library; both are compared on a probe text first.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def by_tokenizers(texts):
        return [np.array(e.ids, np.uint32) for e in slow.encode_batch(texts, add_special_tokens=False)]

    ranks_file = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_file):
        return by_tokenizers
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items() if t.special}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def by_ranks(texts):
        return [fast.encode_to_numpy(x, allowed_special="all") for x in texts]

    probe = ["It's  a\n\n test: 12,345 cafés 你好 \U0001f600\t<|endoftext|>!! x", "", "   "]
    same = all(np.array_equal(a, b) for a, b in zip(by_ranks(probe), by_tokenizers(probe), strict=True))
    return by_ranks if same else by_tokenizers


def pieces(docs: DataFrame, doc_id: str, text: str, max_tokens: int, path: str, end_id: int) -> DataFrame:
    """Each document's pieces with the CRC of their ids, the task, and the rank among equal lengths of that task."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        encode, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(max_tokens + 1, np.int64)
        for batch in batches:
            rows = []
            texts = ["" if x is None else x for x in batch.column(1).to_pylist()]
            for i, ids in enumerate(encode(texts)):
                ids = np.append(ids, end_id).astype("<u4")
                for start in range(0, len(ids), max_tokens):
                    piece = ids[start : start + max_tokens]
                    rows.append((i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), seen[len(piece)]))
                    seen[len(piece)] += 1
            cols = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), *map(pa.array, cols[1:]), pa.array(np.full(len(rows), part))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "local", "part"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, local bigint, part bigint")


def patterns(histogram: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)``: how many packs hold which lengths.

    A bin of n equal lengths goes to the open packs with the most room: k of them fit into
    each, so up to n packs of a pattern turn into a longer pattern at once. What finds no
    room opens new packs, filled with as many as fit.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []

    def put(room: int, count: int, lengths: tuple[int, ...]) -> None:
        if room not in open_packs:
            open_packs[room] = []
            insort(rooms, room)
        open_packs[room].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left, done = histogram[length], []
        while left:
            room = rooms[-1] if rooms else -1
            if room < length:
                fit = max_tokens // length
                whole, rest = divmod(left, fit)
                done += [(max_tokens - fit * length, whole, (length,) * fit)] * (whole > 0) + [(max_tokens - rest * length, 1, (length,) * rest)] * (rest > 0)
                break
            count, lengths = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
                rooms.pop()
            used = min(count, left)
            if count > used:
                put(room, count - used, lengths)
            # the pack goes back at once, so that a bin fills each pack evenly
            put(room - length, used, (*lengths, length))
            left -= used
        for room, count, lengths in done:
            put(room, count, lengths)
    return [x for room in rooms for x in open_packs[room]]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row per piece.

    A document's ids are those of its text, whole, and ``end_id``; a null text is empty, so it
    has one id. Each id lies in one piece, each piece in one sequence of at most
    ``max_tokens`` ids, without gaps. Rows with equal or null ids are documents of their
    own. Extra columns are ignored; an empty table gives no rows.
    """
    cut = stored(pieces(docs, doc_id, text, max_tokens, path or vocabulary(), end_id), "pieces")
    per_task = stored(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-lengths")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # ranks: a piece's rank in its task plus the pieces of that length in the tasks before
    before = per_task.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).select("length", "part", "before")
    ranked = cut.join(before, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("local") + F.col("before")).alias("rank"))
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used, first_sequence = dict.fromkeys(histogram, 0), 0
    for count, lengths in patterns(histogram, max_tokens):
        offset = 0
        for length in lengths:
            slots.setdefault(length, []).append((used[length], first_sequence, offset, count))
            used[length] += count
            offset += length
        first_sequence += count
    # at most a few slots for each pair of lengths, whatever the corpus
    by_length = {length: np.array(s, np.int64).T for length, s in slots.items()}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(by_length)

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length):
                first, at, off, _ = shared.value[int(n)]
                rows = np.flatnonzero(length == n)
                slot = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = at[slot] + rank[rows] - first[slot], off[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = ranked.mapInArrow(place, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("doc_id", doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return pack(read(spark, sf_dir, "documents"))
