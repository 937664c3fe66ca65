"""Nearest neighbours of vectors within a country: exact, or by coarse cells.

The encoder is pluggable: any function from a text column to an array of floats. Without a
trained encoder the default hashes character 3-grams into a fixed number of dimensions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylink.functions import text as tx
from quarrylink.operators import nearest
from quarrylink.operators.blocking import EMBEDDING_TOP, alike, first_alike, heads, spread, word_grams

DIMENSIONS = 64
#: Coarse cells for so many targets each, and the cells that a query looks into.
CELL_TARGETS = 500
PROBES = 32
TRAIN = 100_000
#: Targets of a block that exact search compares in one task.
BLOCK_TARGETS = 50_000


def unit(v: Column) -> Column:
    """A vector scaled to length 1 (a zero vector stays)."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    pair = lambda v: F.struct(v.alias("v"), F.sqrt(square(v)).alias("n"))
    scaled = lambda p: F.when(p["n"] > 0, F.transform(p["v"], lambda x: (x.cast("double") / p["n"]).cast("float"))).otherwise(p["v"].cast("array<float>"))
    return tx.let(tx.let(v, pair), scaled)


def inner(a: Column, b: Column) -> Column:
    """Inner product, summed in order in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hashed_grams(x: Column, dimensions: int = DIMENSIONS) -> Column:
    """Counts of character 3-grams, hashed into bins, as a unit vector."""
    bins = F.transform(word_grams(x), lambda g: F.pmod(F.xxhash64(g), F.lit(dimensions)))
    counts = lambda bs: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(bs, lambda b: b == i)).cast("float"))
    return tx.let(bins, lambda bs: unit(counts(bs)))


def encoded(df: DataFrame, text: str = "clean_name", role: str | None = None, encoder: Callable[[Column], Column] = hashed_grams) -> DataFrame:
    """``df`` with ``vec``, its text encoded; ``role`` puts ``passage: `` or ``query: `` before it."""
    x = F.col(text) if role is None else tx.encoder_text(F.col(text), role)
    return df.withColumn("vec", unit(encoder(x)))


def encoded_in_batches(df: DataFrame, encoder: Callable[[list[str]], np.ndarray], text: str = "clean_name", role: str | None = None, batch: int = 256) -> DataFrame:
    """As ``encoded``, by a model that takes a list of texts to a matrix; it is called with ``batch`` texts at most."""
    x = tx.safe(F.col(text)) if role is None else tx.encoder_text(F.col(text), role)

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        vecs = [v for at in range(0, len(texts), batch) for v in np.asarray(encoder(texts.iloc[at : at + batch].to_list()), np.float32)]
        return pd.Series(vecs, dtype=object)

    return df.withColumn("vec", unit(run(x)))


def _classes(queries: DataFrame, targets: DataFrame, top: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members of the classes of equal vectors, and a row ``country, vec`` for each class, of queries and of targets."""
    members, first = alike(queries, "country", "vec"), first_alike(targets, top, "country", "vec")
    rows = lambda df, key: df.select(key, F.explode("own").alias("r")).select(key, "r.country", "r.vec").distinct()
    return members, first, rows(members.filter("rep = entity_id"), "rep"), rows(heads(first), "head")


def _rounded(scored: DataFrame) -> DataFrame:
    return scored.groupBy("rep", "head").agg(F.max(F.round("score", 6)).alias("score"))


#: More than twice what rounding to 6 digits and another order of summation move a score.
_MARGIN = 2e-6


def exact_neighbours(queries: DataFrame, targets: DataFrame, top: int = EMBEDDING_TOP, block: int = BLOCK_TARGETS) -> DataFrame:
    """``s1_id, target_id, score, rank``: the ``top`` largest inner products in the same country.

    For a stated set of queries, which meets all targets of its country in blocks: queries and
    targets are dealt into parts of about ``block`` rows, and each pair of parts is cut to
    what the ranks need before they meet. So one country is no single task. Equal vectors are
    compared once.
    """
    members, first, q, t = _classes(queries, targets, top)
    scored = nearest.blocks(q, t, nearest.dense(top, _MARGIN), queries.count() // block, (n := targets.count()) // block, rows=n)
    return spread(_rounded(scored), members, first, top)


def coarse_cells(targets: DataFrame, cells: int, train: int = TRAIN, seed: int = 42) -> list[list[float]]:
    """Centroids from at most ``train`` targets, those with the smallest hashes of their ids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = targets.orderBy(F.xxhash64("entity_id")).limit(train).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(sample)
    return [c.tolist() for c in model.clusterCenters()]


def nearest_cells(vec: Column, centroids: list[list[float]], n: int) -> Column:
    """The numbers of the n centroids with the largest inner products, best first.

    Centroids go to the executors as one broadcast, not into the plan. A null vector has none.
    """
    shared = SparkSession.active().sparkContext.broadcast(np.asarray(centroids, np.float64))

    @F.pandas_udf("array<int>")
    def nearest(vecs: pd.Series) -> pd.Series:
        out: list = [None] * len(vecs)
        there = np.flatnonzero(vecs.notna().to_numpy())
        for at in range(0, len(there), 4096):
            rows = there[at : at + 4096]
            scores = np.stack(vecs.iloc[rows].to_list()).astype(np.float64) @ shared.value.T
            best = np.argsort(-scores, axis=1, kind="stable")[:, :n]
            for i, cells in zip(rows, best.astype(np.int32), strict=True):
                out[i] = cells
        return pd.Series(out, dtype=object)

    # not to be moved into conditions that the planner infers, where Python can't run
    return nearest.asNondeterministic()(vec)


def cell_neighbours(queries: DataFrame, targets: DataFrame, top: int = EMBEDDING_TOP, cells: int | None = None, probes: int = PROBES, block: int = BLOCK_TARGETS) -> DataFrame:
    """As ``exact_neighbours``, but each query meets only targets of its nearest cells."""
    n = targets.count()
    cells = cells or max(1, n // CELL_TARGETS)
    centroids = coarse_cells(targets, cells)
    members, first, q, t = _classes(queries, targets, top)
    q = q.withColumn("cells", nearest_cells(F.col("vec"), centroids, min(probes, cells))).withColumn("cell", F.explode("cells")).drop("cells")
    t = t.withColumn("cell", nearest_cells(F.col("vec"), centroids, 1)[0]).filter("cell is not null")
    scored = nearest.blocks(q, t, nearest.dense(top, _MARGIN), queries.count() // block, n // cells // block, "cell", rows=n // cells)
    return spread(_rounded(scored), members, first, top)


def embedding_candidates(anchors: DataFrame, placed: DataFrame, top: int = EMBEDDING_TOP, text: str = "clean_name", encoder: Callable[[Column], Column] = hashed_grams, approximate: bool = False) -> DataFrame:
    """Signal A: neighbours of the encoded names. Equal names are encoded and searched for once."""
    members, first = alike(anchors, "country", text), first_alike(placed, top, "country", text)
    record = lambda df: df.select("entity_id", F.explode("own").alias("r")).select("entity_id", "r.*")
    q = encoded(record(members.filter("rep = entity_id")), text, encoder=encoder)
    t = encoded(record(heads(first).withColumnRenamed("head", "entity_id")).withColumn("pos", F.col("entity_id")), text, encoder=encoder)
    found = (cell_neighbours if approximate else exact_neighbours)(q, t, top)
    return spread(found.select(F.col("s1_id").alias("rep"), F.col("target_id").alias("head"), "score"), members, first, top)
