"""Recall, reduction, sweeps and F scores of candidates and matches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylink.operators.blocking import union_and_rank

SWEEP = (5, 10, 15, 20, 30, 50)


def _share(hits, total):
    return F.when(total > 0, hits / total).otherwise(F.lit(0.0))


class Pairs:
    """True pairs as a table ``s1_id, target_id``."""

    def __init__(self, truth: DataFrame):
        self.truth = truth
        self.sparkSession = truth.sparkSession

    def total(self) -> DataFrame:
        """One row ``total_true_matches``."""
        return self.truth.agg(F.count("*").alias("total_true_matches"))

    def per_anchor(self) -> DataFrame:
        """``s1_id, t``: how many true pairs an anchor has."""
        return self.truth.groupBy("s1_id").agg(F.count("*").alias("t"))

    def true_ones(self, pairs: DataFrame) -> DataFrame:
        """The rows of ``pairs`` that are true."""
        return pairs.join(self.truth, ["s1_id", "target_id"], "left_semi")

    def found(self, pairs: DataFrame) -> DataFrame:
        """One row ``found_true_matches`` of distinct pairs."""
        return self.truth.join(pairs, ["s1_id", "target_id"], "left_semi").agg(F.count("*").alias("found_true_matches"))


@dataclass
class Keyed:
    """True pairs by rule: all anchors (``s1_id, key``) and targets (``target_id, key``) of equal keys, null ones aside.

    What a group of copies holds in pairs grows with its square, so they are counted by key and
    pairs are judged by both their keys; the pairs themselves are never made. Tables of a row
    for each record or key are not broadcast (``merge``): they look small, compressed, and fill the driver.
    """

    anchors: DataFrame
    targets: DataFrame

    def __post_init__(self):
        self.sparkSession = self.anchors.sparkSession
        self.anchors, self.targets = (df.filter("key is not null") for df in (self.anchors, self.targets))

    def _counts(self) -> DataFrame:
        return self.targets.groupBy("key").agg(F.count("*").alias("n2")).hint("merge")

    def total(self) -> DataFrame:
        n1 = self.anchors.groupBy("key").agg(F.count("*").alias("n1"))
        return n1.join(self._counts(), "key").agg(F.coalesce(F.sum(F.col("n1") * F.col("n2")), F.lit(0)).alias("total_true_matches"))

    def per_anchor(self) -> DataFrame:
        n1 = self.anchors.groupBy("s1_id", "key").agg(F.count("*").alias("n1"))
        return n1.join(self._counts(), "key").groupBy("s1_id").agg(F.sum(F.col("n1") * F.col("n2")).alias("t"))

    def true_ones(self, pairs: DataFrame) -> DataFrame:
        keys = lambda df, x, to: df.groupBy(x).agg(F.collect_set("key").alias(to)).hint("merge")
        both = pairs.join(keys(self.anchors, "s1_id", "k1"), "s1_id").join(keys(self.targets, "target_id", "k2"), "target_id")
        return both.filter(F.arrays_overlap("k1", "k2")).select(*pairs.columns)

    def found(self, pairs: DataFrame) -> DataFrame:
        times = lambda df, x, to: df.groupBy(x, "key").agg(F.count("*").alias(to))
        n2 = times(self.targets, "target_id", "n2").withColumnRenamed("key", "key2").hint("merge")
        both = pairs.join(times(self.anchors, "s1_id", "n1").hint("merge"), "s1_id").join(n2, "target_id").filter("key = key2")
        return both.agg(F.coalesce(F.sum(F.col("n1") * F.col("n2")), F.lit(0)).alias("found_true_matches"))


def _known(truth: DataFrame | Pairs | Keyed) -> Pairs | Keyed:
    return truth if isinstance(truth, (Pairs, Keyed)) else Pairs(truth)


def candidate_recall(candidates: DataFrame, truth: DataFrame | Keyed) -> DataFrame:
    """One row ``total_true_matches, found_true_matches, candidate_recall`` over pairs."""
    known = _known(truth)
    out = known.total().join(F.broadcast(known.found(candidates.select("s1_id", "target_id").distinct())))
    return out.withColumn("candidate_recall", _share(F.col("found_true_matches"), F.col("total_true_matches")))


def totals(pairs: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row: anchors, pairs, pairs per anchor (0 without anchors), and anchors without a pair."""
    per = anchors.select(F.col("entity_id").alias("s1_id")).distinct().join(pairs.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").na.fill(0)
    n = F.count("*")
    return per.agg(n.alias("anchors"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.round(_share(F.coalesce(F.sum("n"), F.lit(0)), n), 6).alias("pairs_per_anchor"), F.count(F.when(F.col("n") == 0, 1)).alias("without"))


def sweep(ranked: DataFrame, truth: DataFrame | Keyed, n_anchors: int, n_targets: int, ks: tuple[int, ...] = SWEEP) -> DataFrame:
    """Recall, pairs per anchor and reduction ratio for each k, from one ranked table in one pass."""
    truth = _known(truth)
    pairs = ranked.groupBy("rank").agg(F.count("*").alias("n"))
    hits = truth.true_ones(ranked.select("s1_id", "target_id", "rank")).groupBy("rank").agg(F.count("*").alias("h"))
    by_rank = pairs.join(hits, "rank", "left").na.fill(0)
    grid = truth.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    total = truth.total()
    out = grid.join(F.broadcast(by_rank), F.col("rank") <= F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("h"), F.lit(0)).alias("found_true_matches"))
    return out.join(F.broadcast(total)).select("k", "pairs", "found_true_matches", "total_true_matches", _share(F.col("found_true_matches"), F.col("total_true_matches")).alias("candidate_recall"), F.round(F.col("pairs") / F.lit(max(1, n_anchors)), 6).alias("candidates_per_anchor"), F.round(1 - F.col("pairs") / (F.lit(float(max(1, n_anchors))) * F.lit(float(max(1, n_targets)))), 9).alias("reduction_ratio"))


def ablation(anchors: DataFrame, signals: dict[str, DataFrame], truth: DataFrame | Keyed, top: int = 20) -> DataFrame:
    """``signal`` and its recall when it ranks alone, for each signal."""
    from functools import reduce

    rows = [candidate_recall(union_and_rank(anchors, {k: df}, top), truth).withColumn("signal", F.lit(k)) for k, df in sorted(signals.items())]
    return reduce(DataFrame.unionByName, rows)


def macro_f(predicted: DataFrame, truth: DataFrame | Keyed, anchors: DataFrame, beta: float = 0.5) -> DataFrame:
    """One row ``n_anchors, macro_f``: the mean over all anchors of the F score of their pairs.

    Without truth an anchor scores 1 if nothing is predicted and else 0; with truth and no
    prediction 0.
    """
    truth = _known(truth)
    every = anchors.select(F.col("entity_id").alias("s1_id")).distinct()
    p = predicted.select("s1_id", "target_id").distinct()
    n_p, n_t = p.groupBy("s1_id").agg(F.count("*").alias("p")), truth.per_anchor()
    n_h = truth.true_ones(p).groupBy("s1_id").agg(F.count("*").alias("h"))
    rows = every.join(n_p, "s1_id", "left").join(n_t, "s1_id", "left").join(n_h, "s1_id", "left").na.fill(0)
    precision, recall, b2 = F.col("h") / F.col("p"), F.col("h") / F.col("t"), beta * beta
    score = F.when(F.col("t") == 0, F.when(F.col("p") == 0, 1.0).otherwise(0.0)).when(F.col("h") == 0, 0.0).otherwise((1 + b2) * precision * recall / (b2 * precision + recall))
    return rows.agg(F.count("*").alias("n_anchors"), F.round(F.avg(score), 9).alias("macro_f"))
