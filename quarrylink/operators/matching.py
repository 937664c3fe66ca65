"""Scoring candidate pairs and keeping the best matches of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylink.functions import similarity as sim

THRESHOLD = 80.0
MAX_PER_SOURCE = 1


def source_of(target_id: str = "target_id"):
    """The source that an id names by its first two characters."""
    return F.substring(target_id, 1, 2)


def scored_pairs(pairs: DataFrame, records: DataFrame, threshold: float | None = None) -> DataFrame:
    """``pairs`` with ``score``: pairs of which a side has no record are left out.

    ``pairs`` has ``s1_id, target_id`` and may have more columns; ``records`` has ``entity_id,
    name, address`` in the matcher's text. With a ``threshold`` only pairs that reach it stay,
    and addresses are compared only where the name leaves a chance: an address can add at
    most 35 points and a number 15, or 20 without addresses.
    """
    left = records.select(F.col("entity_id").alias("s1_id"), F.col("name").alias("n1"), F.col("address").alias("a1"))
    right = records.select(F.col("entity_id").alias("target_id"), F.col("name").alias("n2"), F.col("address").alias("a2"))
    p = pairs.join(left, "s1_id").join(right, "target_id")
    n1, n2, a1, a2 = map(F.col, ("n1", "n2", "a1", "a2"))
    if threshold is not None and threshold > 0:
        p = p.filter((n1 != "") & (n2 != ""))
    # names repeat far more than pairs do: each pair of names is compared once, dealt over all cores
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    names = p.select("n1", "n2").distinct().repartition(4 * cores, "n1", "n2").withColumn("np", sim.token_set_parts(n1, n2)).withColumn("nd", sim.ratio(F.col("np.left"), F.col("np.right")))
    names = names.withColumn("ns", sim.token_sort_ratio(n1, n2)).withColumn("nset", sim.token_set_from_parts(F.col("np"), F.col("nd")))
    names = names.select(n1.alias("x1"), n2.alias("x2"), "nset", sim.name_score(n1, n2, F.col("nset"), F.col("ns")).alias("name_score"))
    p = p.join(names, n1.eqNullSafe(F.col("x1")) & n2.eqNullSafe(F.col("x2"))).drop("x1", "x2")
    both = (a1 != "") & (a2 != "")
    if threshold is not None and threshold > 30:
        best = F.when(both, 0.50 * F.col("name_score") + 50).otherwise(0.80 * F.col("name_score") + 20)
        p = p.filter((best >= threshold) & (F.col("nset") >= 45))
    # a null side costs the Python step nothing
    x, y = F.when(both, a1), F.when(both, a2)
    p = p.withColumn("ap", F.when(both, sim.token_set_parts(a1, a2)))
    p = p.withColumn("ad", sim.ratio(F.col("ap.left"), F.col("ap.right"))).withColumn("asort", sim.ratio(F.when(both, sim.sorted_tokens(a1)), F.when(both, sim.sorted_tokens(a2)))).withColumn("aratio", sim.ratio(x, y))
    address = 0.40 * sim.token_set_from_parts(F.col("ap"), F.col("ad")) + 0.30 * F.col("asort") + 0.30 * F.col("aratio")
    number = sim.number_score(n1, a1, n2, a2)
    score = sim.composite(n1, n2, a1, a2, F.col("name_score"), F.col("nset"), address, number)
    out = p.withColumn("score", score)
    if threshold is not None:
        out = out.filter(F.col("score") >= threshold)
    return out.select(*[c for c in pairs.columns if c != "score"], "score")


def best_matches(scored: DataFrame, max_per_source: int = MAX_PER_SOURCE, order: str = "rank") -> DataFrame:
    """``s1_id, target_id, score, rank``: per anchor and source the best scores; ties keep the candidates' order.

    The second source's matches come before the third's.
    """
    own = scored.withColumn("source", source_of()).filter(F.col("source").isin("S2", "S3") & F.substring("target_id", 3, 1).eqNullSafe("-"))
    best = own.withColumn("rn", F.row_number().over(W.partitionBy("s1_id", "source").orderBy(F.desc("score"), order))).filter(F.col("rn") <= max_per_source)
    place = F.row_number().over(W.partitionBy("s1_id").orderBy("source", "rn"))
    return best.withColumn("rank", place).select("s1_id", "target_id", "score", "rank")


def matches(pairs: DataFrame, records: DataFrame, threshold: float = THRESHOLD, max_per_source: int = MAX_PER_SOURCE, order: str = "rank") -> DataFrame:
    """Candidates scored, cut at the threshold, and the best of each source kept."""
    return best_matches(scored_pairs(pairs, records, threshold), max_per_source, order)


def with_all_anchors(pairs: DataFrame, anchors: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """Id lists with a row for every anchor, those without matches empty."""
    from quarrylink.sources.tables import id_lists

    return id_lists(pairs, anchors, column)


def coverage(results: DataFrame, anchors: DataFrame) -> DataFrame:
    """``entity_id, finding``: anchors that the results miss, and ids there that are no anchors."""
    seen = results.select(F.col("source1_entity_id").alias("entity_id")).distinct()
    need = anchors.select("entity_id").distinct()
    return need.join(seen, "entity_id", "left_anti").withColumn("finding", F.lit("missing")).unionAll(seen.join(need, "entity_id", "left_anti").withColumn("finding", F.lit("unexpected")))
