"""The three batch plans: normalize, generate candidates, match. Steps that are read several times are stored once."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylink.operators import blocking, embedding, matching
from quarrylink.operators.normalize import normalized, stored_form
from quarrylink.sources import scratch, tables


def normalize_file(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Read records, normalize them and write Parquet (or, for a .tsv target, text) in one job."""
    out = stored_form(normalized(tables.read_any(spark, source)))
    (tables.write_tsv if target.endswith(".tsv") else tables.write_parquet)(out, target)
    return out


def normalize_folder(spark: SparkSession, folder: str, out: str, names: tuple[str, ...]) -> list[str]:
    """Normalize the named inputs that are there; returns their names."""
    done = []
    for name in names:
        if found := tables.find_source(spark, folder, name):
            normalize_file(spark, found, f"{out}/{name}_normalized.parquet")
            done.append(name)
    return done


def configuration() -> list[tuple[str, str]]:
    """The settings of all plans by name, in order."""
    own = {"blocking": blocking, "embedding": embedding, "matching": matching}
    return sorted((f"{k}.{name.lower()}", str(value)) for k, module in own.items() for name, value in vars(module).items() if name.isupper() and isinstance(value, (int, float, dict)))


def signals(anchors: DataFrame, placed: DataFrame, top: int = blocking.FINAL_TOP, semantic: str = "tfidf", min_similarity: float = blocking.MIN_SIMILARITY, number_top: int = blocking.NUMBER_TOP) -> dict[str, DataFrame]:
    """The three signals: names by meaning (``tfidf``, ``embedding``, ``cells`` or ``none``), name tokens, address numbers.

    Each is stored. They are made side by side, since most of their jobs are too small for all cores.
    """
    make = {"b": lambda: blocking.token_candidates(anchors, placed, top), "c": lambda: blocking.number_candidates(anchors, placed, number_top)}
    if semantic == "tfidf":
        make["a"] = lambda: blocking.tfidf_candidates(anchors, placed, top, min_similarity)
    elif semantic in ("embedding", "cells"):
        make["a"] = lambda: embedding.embedding_candidates(anchors, placed, top, approximate=semantic == "cells")
    elif semantic != "none":
        raise ValueError(f"no such signal: {semantic}")
    with ThreadPoolExecutor(len(make)) as pool:
        made = {k: pool.submit(inheritable_thread_target(anchors.sparkSession)(lambda f=f, k=k: scratch.stored(f(), f"signal-{k}"))) for k, f in sorted(make.items())}
    return {k: x.result() for k, x in made.items()}


def _ranked_alike(anchors: DataFrame, targets: DataFrame, top: int, semantic: str, min_similarity: float, number_top: int) -> tuple[DataFrame, DataFrame]:
    """Members of the classes of equal anchors, and the ranked pairs of each class's first anchor."""
    members = scratch.stored(blocking.alike(blocking.require_country(anchors), "country", "clean_name", "clean_name_full", "clean_address"), "alike")
    alone = members.filter("rep = entity_id").select("entity_id", F.explode("own").alias("r")).select("entity_id", "r.*")
    placed = blocking.positions(targets)
    return members.select("entity_id", "rep"), blocking.union_and_rank(alone, signals(alone, placed, top, semantic, min_similarity, number_top), top)


def _to_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """A row of ``pairs`` for each anchor that its ``s1_id`` stands for."""
    return pairs.withColumnRenamed("s1_id", "rep").join(members, "rep").select(*(F.col("entity_id").alias("s1_id") if c == "s1_id" else c for c in pairs.columns))


def candidates(anchors: DataFrame, targets: DataFrame, top: int = blocking.FINAL_TOP, semantic: str = "tfidf", min_similarity: float = blocking.MIN_SIMILARITY, number_top: int = blocking.NUMBER_TOP) -> DataFrame:
    """Ranked candidate pairs of normalized anchors and targets over all countries at once.

    Anchors that agree in country, names and address are ranked once.
    """
    members, pairs = _ranked_alike(anchors, targets, top, semantic, min_similarity, number_top)
    return _to_members(pairs, members)


def scored(anchors: DataFrame, targets: DataFrame, top: int = blocking.FINAL_TOP, semantic: str = "tfidf") -> DataFrame:
    """``s1_id, target_id, rank, score``: all ranked candidates with the matcher's scores."""
    members, pairs = _ranked_alike(anchors, targets, top, semantic, blocking.MIN_SIMILARITY, blocking.NUMBER_TOP)
    return _to_members(matching.scored_pairs(_dealt(pairs), _records(anchors, targets)), members)


def _dealt(pairs: DataFrame) -> DataFrame:
    """The pairs, stored, in tasks for all cores: their comparison is work, not bytes."""
    return scratch.stored(pairs.select("s1_id", "target_id", "rank"), "pairs").repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism)


def _records(anchors: DataFrame, targets: DataFrame) -> DataFrame:
    return tables.flat_records(anchors.drop("source").unionByName(targets.drop("source")))


def matched(anchors: DataFrame, targets: DataFrame, top: int = blocking.FINAL_TOP, threshold: float = matching.THRESHOLD, max_per_source: int = matching.MAX_PER_SOURCE, semantic: str = "tfidf") -> DataFrame:
    """Matches of normalized records; anchors that agree are scored once."""
    members, pairs = _ranked_alike(anchors, targets, top, semantic, blocking.MIN_SIMILARITY, blocking.NUMBER_TOP)
    found = matching.matches(_dealt(pairs), _records(anchors, targets), threshold, max_per_source)
    return _to_members(found, members)


def link(anchors: DataFrame, targets: DataFrame, top: int = blocking.FINAL_TOP, threshold: float = matching.THRESHOLD, max_per_source: int = matching.MAX_PER_SOURCE, semantic: str = "tfidf") -> DataFrame:
    """Matches of raw records: normalize, block, score, keep the best."""
    a, t = (scratch.stored(normalized(df), "records") for df in (anchors, targets))
    return matched(a, t, top, threshold, max_per_source, semantic)
