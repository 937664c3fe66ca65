"""A stored index of coarse cells: built once, checked by its settings, extended by new targets, searched by cell.

The index is a folder with ``centroids`` and ``cells`` (Parquet) and ``settings`` (JSON
lines). Everything goes through Spark, so the folder may be in any store.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylink.operators import embedding
from quarrylink.operators.blocking import EMBEDDING_TOP, ranked
from quarrylink.sources.tables import exists


def settings_of(targets: DataFrame, cells: int, encoder: str, seed: int = 42) -> dict:
    """What must agree for an index to be used again."""
    size = targets.select(F.size("vec").alias("n")).first()
    return {"format": 1, "encoder": encoder, "dimensions": size["n"] if size else 0, "cells": cells, "seed": seed, "metric": "inner_product"}


def read_settings(spark: SparkSession, path: str) -> dict | None:
    """The settings of a stored index; None if there is none or they can't be read."""
    if not exists(spark, f"{path}/settings"):
        return None
    row = spark.read.text(f"{path}/settings").first()
    try:
        return json.loads(row["value"]) if row else None
    except ValueError:
        return None


def build(targets: DataFrame, path: str, cells: int, encoder: str = "hashed_grams") -> DataFrame:
    """Assign each target (``country, entity_id, pos, vec``) to its nearest cell and store it; returns the cells.

    An index with equal settings is kept, and only targets that it lacks are added, so an
    interrupted or grown build goes on where it was. Other settings build it anew.
    """
    spark, settings = targets.sparkSession, settings_of(targets, cells, encoder)
    row = targets.select("country", "entity_id", "pos", "vec")
    if read_settings(spark, path) == settings:
        centroids = [r["c"] for r in spark.read.parquet(f"{path}/centroids").orderBy("i").collect()]
        row = row.join(spark.read.parquet(f"{path}/cells").select("country", "entity_id"), ["country", "entity_id"], "left_anti")
        mode = "append"
    else:
        centroids, mode = embedding.coarse_cells(targets, cells), "overwrite"
        # an interrupted rebuild leaves an index without settings, which is not used
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/settings")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        spark.createDataFrame(list(enumerate(centroids)), "i int, c array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    row.withColumn("cell", embedding.nearest_cells(F.col("vec"), centroids, 1)[0]).write.mode(mode).parquet(f"{path}/cells")
    # settings come last: an index without them is not used
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")
    return spark.read.parquet(f"{path}/cells")


def search(queries: DataFrame, path: str, top: int = EMBEDDING_TOP, probes: int = embedding.PROBES) -> DataFrame:
    """``s1_id, target_id, score, rank``: neighbours among the targets of each query's nearest cells."""
    spark = queries.sparkSession
    centroids = [r["c"] for r in spark.read.parquet(f"{path}/centroids").orderBy("i").collect()]
    q = queries.withColumn("cells", embedding.nearest_cells(F.col("vec"), centroids, min(probes, len(centroids)))).withColumn("cell", F.explode("cells"))
    pairs = q.select("country", "cell", F.col("entity_id").alias("s1_id"), F.col("vec").alias("q")).join(spark.read.parquet(f"{path}/cells").select("country", "cell", F.col("entity_id").alias("target_id"), "pos", F.col("vec").alias("t")), ["country", "cell"])
    scored = pairs.select("s1_id", "target_id", "pos", F.round(embedding.inner(F.col("q"), F.col("t")), 6).alias("score"))
    return ranked(scored, [F.desc("score"), F.asc("pos")], top).drop("pos")
