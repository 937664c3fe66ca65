"""Candidate pairs from several signals, within a country.

Each signal is an equi-join of exploded features and a ranked cut; the country is part of
every key, so countries need no loop and no split. Frequent features are cut before the join,
which bounds both the pairs and the skew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylink.functions import text as tx
from quarrylink.operators import nearest
from quarrylink.sources.scratch import stored

TOKEN_POSTINGS = 5000
NUMBER_POSTINGS = 2000
TOKEN_TOP = 20
NUMBER_TOP = 15
EMBEDDING_TOP = 20
FINAL_TOP = 20
MIN_SIMILARITY = 0.25
WEIGHTS = {"a": 1.0, "b": 0.35, "c": 0.25}


def require_country(df: DataFrame) -> DataFrame:
    """``df`` itself, if it has a country column."""
    if "country" not in df.columns:
        raise ValueError("a record table needs a country column")
    return df


def positions(targets: DataFrame, order: tuple[str, ...] = ("source", "entity_id")) -> DataFrame:
    """``targets`` with ``pos``, what orders a country's targets where scores are equal.

    ``pos`` holds the ordering columns themselves. Numbering the rows would sort a whole
    country, perhaps a third of all rows, in one task, and ties need only the order.
    """
    return require_country(targets).withColumn("pos", F.struct(*order))


def countries(df: DataFrame) -> DataFrame:
    """The distinct countries in order."""
    return require_country(df).select("country").distinct().orderBy("country")


def features(df: DataFrame, feature: Column, *keep: str) -> DataFrame:
    """A row for each distinct feature of a record."""
    return df.select("country", "entity_id", *keep, F.explode(F.array_distinct(feature)).alias("feature"))


def token_features(name: str = "clean_name") -> Column:
    return tx.name_tokens(F.col(name))


def number_features(address: str = "clean_address") -> Column:
    return tx.digit_runs(F.col(address))


def token_postings(placed: DataFrame, name: str = "clean_name", max_postings: int = TOKEN_POSTINGS) -> DataFrame:
    """Postings of name tokens; tokens on more than ``max_postings`` targets of a country are left out whole.

    Frequent tokens are found by an aggregation that combines before its shuffle and left
    out by an anti join, so no task ever gathers the postings of a frequent token.
    """
    rows = features(placed, token_features(name), "pos")
    frequent = rows.groupBy("country", "feature").agg(F.count("*").alias("n")).filter(F.col("n") > max_postings).select("country", "feature")
    return rows.join(frequent, ["country", "feature"], "left_anti")


def number_postings(placed: DataFrame, address: str = "clean_address", max_postings: int = NUMBER_POSTINGS) -> DataFrame:
    """Postings of address numbers; of each number in a country the first ``max_postings`` targets by position."""
    rows = features(placed, number_features(address), "pos")
    place = F.row_number().over(W.partitionBy("country", "feature").orderBy("pos"))
    return rows.withColumn("rn", place).filter(F.col("rn") <= max_postings).drop("rn")


def alike(records: DataFrame, *columns: str) -> DataFrame:
    """``entity_id, rep, own``: of all ids whose records agree in ``columns``, the smallest; ``own`` holds these records.

    An id of several records agrees only with ids of the same ones.
    """
    own = records.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("own"))
    return own.join(own.groupBy("own").agg(F.min("entity_id").alias("rep")), "own")


def first_alike(targets: DataFrame, top: int, *columns: str) -> DataFrame:
    """``own, head, target_id, pos``: of targets whose records agree in ``columns`` the first ``top``; ``head`` is the first.

    Such targets have equal scores, so no other of them is among an anchor's best ``top``.
    Spark cuts before the shuffle (``WindowGroupLimit``).
    """
    own = targets.groupBy(F.col("entity_id").alias("target_id"), "pos").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("own"))
    place = F.row_number().over(W.partitionBy("own").orderBy("pos", "target_id"))
    first = own.withColumn("place", place).filter(F.col("place") <= top)
    return first.select("own", F.min(F.struct("pos", "target_id")).over(W.partitionBy("own")).alias("head"), "target_id", "pos")


def heads(first: DataFrame) -> DataFrame:
    """``own, head``: a row for each class of ``first_alike``."""
    return first.filter((F.col("head.pos") == F.col("pos")) & (F.col("head.target_id") == F.col("target_id"))).select("own", "head")


def spread(found: DataFrame, anchors: DataFrame, first: DataFrame, top: int) -> DataFrame:
    """``s1_id, target_id, score, rank``: scored classes (``rep, head, score``) brought back to ids.

    A class that ``top`` others precede, by score and first target, has no target among the
    best ``top``, since the first of each comes before all of its own.
    """
    place = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("score"), "head"))
    best = found.withColumn("place", place).filter(F.col("place") <= top)
    full = best.join(first.select("head", "target_id", "pos"), "head").select(F.col("rep").alias("s1_id"), "target_id", "pos", "score")
    full = ranked(full, [F.desc("score"), F.asc("pos"), F.asc("target_id")], top).drop("pos").withColumnRenamed("s1_id", "rep")
    return full.join(anchors.select("rep", F.col("entity_id").alias("s1_id")).hint("merge"), "rep").select("s1_id", "target_id", "score", "rank")


def shared_features(anchors: DataFrame, postings: DataFrame, feature: Column, top: int) -> DataFrame:
    """``s1_id, target_id, score, rank``: targets by the number of distinct shared features, ties by position.

    Anchors of equal features, and targets of equal postings, are one class each, and classes
    are joined. An anchor's most frequent feature is joined to its first ``top`` classes only.
    A class that shares nothing else comes after all of these, so it is among the best
    ``top`` only if it is one of them; a class that shares a rarer feature is found by that
    one, and how often it has the frequent one, too, is read off its own features. Classes
    and their features are stored once, since every branch reads them.
    """
    key = ["country", "feature"]
    members = stored(alike(features(anchors, feature), *key), "members")
    first = stored(first_alike(postings, top, *key), "first")
    rows = stored(heads(first).select("head", "own", F.explode("own").alias("f")).groupBy("head", "own", "f").agg(F.count("*").alias("n2")), "rows")
    left = members.filter("rep = entity_id").select("rep", F.explode("own").alias("f")).groupBy("rep", "f").agg(F.count("*").alias("n1"))
    left = left.join(rows.groupBy("f").agg(F.count("*").alias("n")), "f")
    left = stored(left.withColumn("common", F.max(F.struct("n", "f")).over(W.partitionBy("rep"))["f"]), "left")
    rare = _met(left.filter("f <> common"), rows)
    before = rows.withColumn("place", F.row_number().over(W.partitionBy("f").orderBy(F.desc("n2"), "head"))).filter(F.col("place") <= top)
    often = left.filter("f = common").join(before, "f")
    more = F.size(F.filter("own", lambda x: x == F.col("common")))
    pairs = rare.select("rep", "head", (F.col("n1") * F.col("n2")).alias("hit"), more.alias("more"))
    pairs = pairs.unionAll(often.select("rep", "head", F.lit(0).cast("bigint"), F.col("n2").cast("int")))
    times = left.filter("f = common").select("rep", "n1")
    # dealt by anchor once, for both the counts and the ranks
    counted = pairs.repartition("rep").groupBy("rep", "head").agg(F.sum("hit").alias("hit"), F.max("more").alias("more"))
    scored = counted.join(times, "rep").select("rep", "head", (F.col("hit") + F.col("more") * F.col("n1")).cast("double").alias("score"))
    return spread(scored, members, first, top)


def _met(left: DataFrame, rows: DataFrame, salts: int = 8) -> DataFrame:
    """``left`` and ``rows`` of equal ``f`` joined in tasks for all cores: pairs are work that the bytes of both sides don't show.

    The anchors of a feature are dealt into ``salts`` parts, so a frequent one is no hot spot.
    """
    tasks, key = 4 * left.sparkSession.sparkContext.defaultParallelism, ["f", "salt"]
    x = left.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int"))
    y = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return x.repartition(tasks, *key).join(y.repartition(tasks, *key), key)


def ranked(scored: DataFrame, order: list, top: int) -> DataFrame:
    """The best ``top`` targets of each anchor with their ``rank`` from 1."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("s1_id").orderBy(*order))).filter(F.col("rank") <= top)


def token_candidates(anchors: DataFrame, placed: DataFrame, top: int = TOKEN_TOP, max_postings: int = TOKEN_POSTINGS, name: str = "clean_name") -> DataFrame:
    """Targets that share the most name tokens with an anchor."""
    return shared_features(anchors, token_postings(placed, name, max_postings), token_features(name), top)


def number_candidates(anchors: DataFrame, placed: DataFrame, top: int = NUMBER_TOP, max_postings: int = NUMBER_POSTINGS, address: str = "clean_address") -> DataFrame:
    """Targets that share the most address numbers with an anchor."""
    return shared_features(anchors, number_postings(placed, address, max_postings), number_features(address), top)


def word_grams(name: Column, n: int = 3) -> Column:
    """Character n-grams of each word with a space before and after it; a word shorter than that gives itself once."""
    words = F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n))))
    return F.flatten(grams)


def tfidf_candidates(anchors: DataFrame, placed: DataFrame, top: int = 20, min_similarity: float = MIN_SIMILARITY, min_df: int = 2, max_features: int = 150_000, name: str = "clean_name", block: int = 50_000) -> DataFrame:
    """Targets by cosine of character 3-gram TF-IDF, fitted on the targets of a country.

    Grams on fewer than ``min_df`` targets are left out; of the rest, the ``max_features``
    most frequent in a country stay (ties by gram). Weights are (1 + ln tf) (1 + ln((1 + n) /
    (1 + df))), scaled to unit length. Records of equal names are weighted and compared once;
    counts of targets count them all. Blocks of about ``block`` anchors and targets meet.
    """
    columns = ("country", name)
    members, first = stored(alike(anchors, *columns), "members"), stored(first_alike(placed, top, *columns), "first")
    every = placed.groupBy(F.col("entity_id").alias("target_id"), "pos").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("own"))
    classes = heads(first).join(every.groupBy("own").agg(F.count("*").alias("n")), "own")

    def counted(df: DataFrame, *keep: str) -> DataFrame:
        rows = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, keep[0]).select(*keep, F.explode("own").alias("r")).select(*keep, "r.country", F.explode(word_grams(F.col(f"r.{name}"))).alias("gram"))
        return rows.groupBy(*keep, "country", "gram").agg(F.count("*").alias("tf"))

    t_counts = stored(counted(classes, "head", "n"), "grams")
    stats = t_counts.groupBy("country", "gram").agg(F.sum("n").alias("df"), F.sum(F.col("tf") * F.col("n")).alias("total")).filter(F.col("df") >= min_df)
    stats = stats.withColumn("r", F.row_number().over(W.partitionBy("country").orderBy(F.desc("total"), "gram"))).filter(F.col("r") <= max_features)
    sizes = placed.groupBy("country").agg(F.count("*").alias("size"))
    idf = stored(stats.join(sizes, "country").select("country", "gram", "r", (F.log((1 + F.col("size")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")

    def weighted(counts: DataFrame, key: str) -> DataFrame:
        w = counts.join(idf, ["country", "gram"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
        rows = w.groupBy("country", key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.array_sort(F.collect_list(F.struct("r", "w"))).alias("v"))
        return rows.select("country", key, F.transform("v", lambda x: x["r"]).alias("terms"), F.transform("v", lambda x: x["w"] / F.col("norm")).alias("weights"))

    left = weighted(counted(members.filter("rep = entity_id"), "rep"), "rep")
    right = weighted(t_counts.drop("n"), "head")
    scored = nearest.blocks(left, right, nearest.sparse(top, min_similarity - 2e-9, 2e-9), anchors.count() // block, (size := placed.count()) // block, rows=size)
    scored = scored.select("rep", "head", F.round("score", 9).alias("score")).filter(F.col("score") >= min_similarity)
    return spread(scored, members, first, top)


def union_and_rank(anchors: DataFrame, signals: dict[str, DataFrame], top: int = FINAL_TOP, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``s1_id, target_id, score_a, score_b, score_c, score, rank``: the signals' pairs joined and weighted.

    A pair that a signal lacks counts 0 there. Ties rank by the target's id as text. Anchors
    without pairs have no rows here; ``id_lists`` brings them back.
    """
    rows = reduce(DataFrame.unionByName, (df.select("s1_id", "target_id", F.lit(k).alias("signal"), F.col("score").cast("double").alias("score")) for k, df in sorted(signals.items())))
    wide = rows.groupBy("s1_id", "target_id").agg(*(F.coalesce(F.max(F.when(F.col("signal") == k, F.col("score"))), F.lit(0.0)).alias(f"score_{k}") for k in ("a", "b", "c")))
    # a row for each anchor looks small, compressed, and would fill the driver as a broadcast
    wide = wide.join(anchors.select(F.col("entity_id").alias("s1_id")).distinct().hint("merge"), "s1_id", "left_semi")
    scored = wide.withColumn("score", weights["a"] * F.col("score_a") + weights["b"] * F.col("score_b") + weights["c"] * F.col("score_c"))
    return ranked(scored, [F.desc("score"), F.asc("target_id")], top)
