"""Best inner products of blocks of vectors, in numpy: what a ranked cut needs, with all that rounding might tie.

A kernel takes the rows of a block of anchors (``rep`` and vectors) and of targets (``head``
and vectors) of one key, and gives places of both with scores. It keeps, for each anchor, all
targets whose score is at least that of the best ``top``-th less a margin, so that the exact
ranks by rounded score and position can be made of them afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scores that are in memory at once.
_SCORES = 1 << 23
#: Rows for which a part of their own pays.
_FEW = 1 << 12


def blocks(left: DataFrame, right: DataFrame, kernel: Callable, left_parts: int, right_parts: int, *keys: str, rows: int = 0) -> DataFrame:
    """``rep, head, score``: rows of equal ``country`` (and ``keys``) meet, dealt into so many parts each side.

    Targets of which there are many ``rows`` in all are dealt into a part for each core, since
    Spark goes by bytes and would put small blocks with much work into one task.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    m, n = max(1, left_parts), max(1, right_parts, min(cores, rows // _FEW))
    part = lambda x, k: F.pmod(F.xxhash64(x), F.lit(k)).cast("int")
    key = ["country", *keys, "lp", "rp"]
    x = left.withColumn("lp", part("rep", m)).withColumn("rp", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    y = right.withColumn("rp", part("head", n)).withColumn("lp", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    made = T.StructType([T.StructField("rep", left.schema["rep"].dataType), T.StructField("head", right.schema["head"].dataType), T.StructField("score", T.DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j, score = kernel(a, b) if len(a) and len(b) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        empty = np.isnan(score)
        return pa.table({"rep": a["rep"].take(pa.array(i)), "head": b["head"].take(pa.array(j)), "score": pa.array(score, pa.float64(), mask=empty)})

    tasks = max(4 * cores, m * n)
    return x.repartition(tasks, *key).groupBy(*key).cogroup(y.repartition(tasks, *key).groupBy(*key)).applyInArrow(run, made)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists end to end, and how many each has."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def sparse(top: int, least: float, margin: float) -> Callable:
    """A kernel for ``terms`` and ``weights``: postings of terms are added up for an anchor at a time."""

    def run(a: pa.Table, b: pa.Table):
        terms, sizes = _flat(b["terms"])
        order = np.argsort(terms, kind="stable")
        at, weight = np.repeat(np.arange(len(b)), sizes)[order], _flat(b["weights"])[0][order]
        known, start = np.unique(terms[order], return_index=True)
        start = np.append(start, len(terms))
        (own, sizes), own_weight = _flat(a["terms"]), _flat(a["weights"])[0]
        ends, places = np.cumsum(sizes), np.searchsorted(known, own)
        there = (places < len(known)) & (known[np.minimum(places, len(known) - 1)] == own)
        left, right, scores = [], [], []
        for i, (lo, hi) in enumerate(zip(ends - sizes, ends, strict=True)):
            score = np.zeros(len(b))
            for k in range(lo, hi):
                if there[k]:
                    p = slice(start[places[k]], start[places[k] + 1])
                    score[at[p]] += own_weight[k] * weight[p]
            j = np.flatnonzero(score >= least)
            if len(j) > top:
                kth = np.partition(score[j], len(j) - top)[len(j) - top]
                j = j[score[j] >= kth - margin]
            left.append(np.full(len(j), i))
            right.append(j)
            scores.append(score[j])
        return np.concatenate(left), np.concatenate(right), np.concatenate(scores)

    return run


def dense(top: int, margin: float) -> Callable:
    """A kernel for ``vec``: products by matrix, then those that matter summed in order in double precision.

    A pair of which a side is null, holds a null or has another length has no score, and comes
    after all that have one.
    """

    def parts(column: pa.ChunkedArray):
        rows: dict[int, tuple[list, list]] = {}
        odd = []
        for i, v in enumerate(column.to_numpy()):
            x = None if v is None else np.asarray(v, np.float64)
            if x is None or np.isnan(x).any():
                odd.append(i)
            else:
                at, vs = rows.setdefault(len(x), ([], []))
                at.append(i)
                vs.append(x)
        return {n: (np.array(at), np.stack(vs)) for n, (at, vs) in rows.items()}, odd

    def run(a: pa.Table, b: pa.Table):
        (xs, odd), (ys, _) = parts(a["vec"]), parts(b["vec"])
        out = []
        for n, (xat, x) in xs.items():
            yat, y = ys.get(n, (np.zeros(0, np.int64), np.zeros((0, n))))
            rest = np.setdiff1d(np.arange(len(b)), yat)
            step = max(1, _SCORES // max(1, len(yat)))
            for lo in range(0, len(xat), step):
                q = x[lo : lo + step]
                about = q @ y.T
                if len(yat) > top:
                    kth = np.partition(about, len(yat) - top, axis=1)[:, len(yat) - top]
                    i, j = np.nonzero(about >= kth[:, None] - margin)
                else:
                    i, j = (k.ravel() for k in np.indices(about.shape))
                score = np.zeros(len(i))
                for d in range(n):
                    score += q[i, d] * y[j, d]
                out.append((xat[lo + i], yat[j], score))
            if len(yat) < top and len(rest):
                out.append((np.repeat(xat, len(rest)), np.tile(rest, len(xat)), np.full(len(xat) * len(rest), np.nan)))
        if odd:
            out.append((np.repeat(odd, len(b)), np.tile(np.arange(len(b)), len(odd)), np.full(len(odd) * len(b), np.nan)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return run
