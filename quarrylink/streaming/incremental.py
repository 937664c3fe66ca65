"""Matching of targets as they arrive: each micro-batch runs the batch plan against all anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylink.plans import linkage


def match_stream(targets: DataFrame, anchors: DataFrame, path: str, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Append the matches of new targets to a Parquet table, a folder for each batch.

    A batch that is repeated after a failure overwrites its own folder, so every target is
    matched once. Ranks and per-source limits hold within a batch; ``best_of`` settles them
    over all batches.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        linkage.link(anchors, batch, **options).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = targets.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def best_of(matches: DataFrame, max_per_source: int = 1) -> DataFrame:
    """The best matches of each anchor and source over all batches; ties by target id."""
    from quarrylink.operators.matching import best_matches

    return best_matches(matches.withColumn("order", F.col("target_id")), max_per_source, "order")
