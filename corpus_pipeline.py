"""A corpus pipeline: documents through quality, line dedup, near-dedup, decontamination and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylink.llm import decontam, linededup, nearcopies, packing, quality
from quarrylink.llm.common import read, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Null, empty and blank texts have no words and stay; very long ones are scored whole;
    repeated rows share a decision; rows with a null id or language are judged by the limit of
    all languages.
    """
    return quality.classify(docs.select(COLUMNS), read(spark, sf_dir, "labels")).filter("keep").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text.

    All rows stay, those with null, empty or emptied texts too. A null source is a source.
    """
    out = linededup.drop_boilerplate(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8 or more), the document with the smallest id.

    A row is judged by its own text, so of rows that repeat an id only those go whose text
    has a copy under a smaller id; equal rows share a decision. Rows with a null id, which no
    decision can name, stay. Texts without words, null ones too, are copies of each other.
    """
    docs = docs.select(COLUMNS)
    found = nearcopies.near_copies(docs, with_text_hash=True)
    gone = stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("copy_id"), F.col("text_hash").alias("copy_hash")).distinct(), "copies")
    return docs.join(gone, (F.col("doc_id") == F.col("copy_id")) & (F.xxhash64("text") == F.col("copy_hash")), "left_anti").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Rows are judged by id and text together; null and empty texts stay.
    """
    return decontam.drop_contaminated(docs.select(COLUMNS), read(spark, sf_dir, "benchmark")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences; a null or empty text is one piece of one id."""
    return packing.pack(docs.select(COLUMNS))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written and read again.

    Extra columns are ignored, whatever their names; an empty table gives no rows.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Perplexity, fingerprints and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
