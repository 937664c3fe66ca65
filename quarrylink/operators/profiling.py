"""Profiles of record and truth tables; each is one aggregation or two."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylink.functions import text as tx


def profile(df: DataFrame, texts: tuple[str, ...] = ("business_name", "business_address")) -> DataFrame:
    """One row: rows, empty values of each column, and length and script statistics of text columns."""
    aggs = [F.count("*").alias("rows")]
    aggs += [F.count(F.when(tx.safe(F.col(c)) == "", 1)).alias(f"missing_{c}") for c in df.columns]
    for c in texts:
        x = tx.safe(F.col(c))
        aggs += [F.round(F.coalesce(F.avg(F.length(x)), F.lit(0.0)), 6).alias(f"avg_len_{c}"), F.coalesce(F.max(F.length(x)), F.lit(0)).alias(f"max_len_{c}"), F.round(F.coalesce(F.avg(F.when(tx.non_ascii(x), 100.0).otherwise(0.0)), F.lit(0.0)), 6).alias(f"non_ascii_pct_{c}")]
    return df.agg(*aggs)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``value, n, pct`` of the values that are not null; pct is of these alone."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(column).alias("total"))
    return counted.join(F.broadcast(total)).select("value", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("pct"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row: the nulls of each column."""
    return df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns))


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, sample deviation, minimum, interpolated quartiles, maximum."""
    x = F.col(column).cast("double")
    q = [F.round(F.percentile(x, p), 6).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)]
    return df.agg(F.count(x).alias("count"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.min(x).alias("min"), *q, F.max(x).alias("max"))


def match_counts(truth: DataFrame) -> DataFrame:
    """``s1_id, n, n_s2, n_s3``: how many matches each truth row lists, in all and by source."""
    ids = tx.id_list(F.col("matched_entity_ids"))
    of = lambda p: F.size(F.filter(ids, lambda x: x.startswith(p)))
    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.size(ids).alias("n"), of("S2-").alias("n_s2"), of("S3-").alias("n_s3"))


def match_histogram(counts: DataFrame) -> DataFrame:
    """``n, anchors, pct``: how many anchors have n matches."""
    return value_counts(counts, "n").select(F.col("value").alias("n"), F.col("n").alias("anchors"), "pct")


def match_summary(counts: DataFrame) -> DataFrame:
    """One row: anchors, those without matches, totals by source, the most and the mean."""
    return counts.agg(
        F.count("*").alias("anchors"), F.count(F.when(F.col("n") == 0, 1)).alias("singletons"), F.coalesce(F.sum("n"), F.lit(0)).alias("matches"),
        F.coalesce(F.sum("n_s2"), F.lit(0)).alias("matches_s2"), F.coalesce(F.sum("n_s3"), F.lit(0)).alias("matches_s3"),
        F.max("n").alias("max_matches"), F.round(F.avg("n"), 6).alias("mean_matches"), F.max("n_s2").alias("max_s2"), F.max("n_s3").alias("max_s3"),
    )


def cross_country(pairs: DataFrame, anchors: DataFrame, targets: DataFrame) -> DataFrame:
    """One row ``checked, mismatched``: truth pairs by whether the countries differ.

    Pairs whose anchor is unknown are skipped; an unknown target is checked and no mismatch.
    A null country of a known record differs from every country.
    """
    left = anchors.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("c1"))
    right = targets.select(F.col("entity_id").alias("target_id"), F.col("country").alias("c2"), F.lit(True).alias("known"))
    both = pairs.join(left, "s1_id").join(right, "target_id", "left")
    differs = F.col("known") & ~F.coalesce(F.col("c1") == F.col("c2"), F.lit(False))
    return both.agg(F.count("*").alias("checked"), F.count(F.when(differs, 1)).alias("mismatched"))


def match_examples(pairs: DataFrame, anchors: DataFrame, targets: DataFrame, n: int = 10) -> DataFrame:
    """The first n pairs, by ids, with both records' fields."""
    side = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("entity_id", "business_name", "business_address", "country")))
    both = pairs.join(side(anchors, "a"), F.col("s1_id") == F.col("a_entity_id")).join(side(targets, "t"), F.col("target_id") == F.col("t_entity_id"))
    return both.drop("a_entity_id", "t_entity_id").orderBy("s1_id", "target_id").limit(n)


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """``value, n``: values on more than one row."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).filter("n > 1")


def all_profiles(tables: dict[str, DataFrame]) -> DataFrame:
    """``profile`` of several record tables, named in ``table``."""
    return reduce(DataFrame.unionByName, (profile(df).withColumn("table", F.lit(k)) for k, df in sorted(tables.items())))
