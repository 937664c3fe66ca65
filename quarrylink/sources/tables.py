"""Readers and writers of record, truth, candidate and match tables.

Missing text is the empty string everywhere inside. Files are tab-separated at the edges and
Parquet within.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylink.functions import text as tx

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
NORMALIZED = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "clean_name", "clean_name_full", "clean_address", "address_numbers")] + [T.StructField("has_address", T.IntegerType()), T.StructField("country", T.StringType())])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
CANDIDATES = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "candidate_entity_ids")])
# Texts that a lenient scan reads as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """A tab-separated table with a header, all columns text and none missing.

    Without a schema the header names the columns. ``"`` quotes, doubled within. A row is a
    line, so that a large file is read by many tasks; only with ``multi_line``, one task a
    file, may quoted fields hold line feeds.
    """
    reader = spark.read.options(sep="\t", header=True, quote='"', escape='"', multiLine=multi_line, encoding="UTF-8")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=False)
    return df.na.fill("")


def missing_as_null(df: DataFrame) -> DataFrame:
    """The lenient reading: all usual marks of a missing value become null."""
    return df.select(*(F.when(F.col(c).isin(*MISSING), None).otherwise(F.col(c)).alias(c) for c in df.columns))


def first_rows(df: DataFrame, order: str | Column, n: int) -> DataFrame:
    """The first n rows in a given order (a table itself has none)."""
    return df.orderBy(order).limit(n)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def find_source(spark: SparkSession, folder: str, prefix: str) -> str | None:
    """The first there is of prefix.tsv, prefix.parquet and both again with _normalized."""
    names = (f"{prefix}{part}.{kind}" for part in ("", "_normalized") for kind in ("tsv", "parquet"))
    return next((p for p in (f"{folder}/{n}" for n in names) if exists(spark, p)), None)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet or a tab-separated table, by its ending."""
    return spark.read.parquet(path) if path.endswith(".parquet") else read_tsv(spark, path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, at, value``: the lines of a file or of a folder of parts; ``at`` grows within a file's block."""
    lines = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    return lines.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def without_headers(lines: DataFrame, header: str | None = None) -> DataFrame:
    """Numbered lines without the first line of each file; with a ``header`` only where it is that line."""
    first = lines.filter("block = 0").groupBy("file").agg(F.min("at").alias("at"))
    rest = lines.join(first.withColumn("is_first", F.lit(True)), ["file", "at"], "left")
    head = F.coalesce("is_first", F.lit(False))
    return rest.filter(~(head if header is None else head & (F.col("value") == header))).select("file", "block", "at", "value")


def read_lists(spark: SparkSession, path: str, id_col: str = "source1_entity_id") -> DataFrame:
    """``id_col, ids``: an id-list file, or a folder of parts, read line by line, without quoting; blank lines are skipped."""
    header = spark.read.text(path).first()
    lines = without_headers(numbered_lines(spark, path), header["value"] if header else "")
    parts = F.split(F.trim("value"), "\t")
    return lines.filter(F.trim("value") != "").select(F.trim(parts[0]).alias(id_col), tx.id_list(F.get(parts, F.lit(1))).alias("ids"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``id``: the distinct first columns of a file, or of a folder of parts, after each header."""
    lines = without_headers(numbered_lines(spark, path))
    return lines.filter(F.trim("value") != "").select(F.trim(F.split("value", "\t")[0]).alias("id")).distinct()


def flat_records(df: DataFrame, ordinal: str | None = None) -> DataFrame:
    """``entity_id, name, address`` in the matcher's plain text, one row per id.

    The name is the first of clean_name_full, clean_name and business_name that is not empty,
    the address that of clean_address and business_address. Blank ids go. Of rows with one id
    the last by ``ordinal`` stays (any, without an ordinal).
    """

    def first_of(*names: str) -> Column:
        there = [F.nullif(tx.safe(F.col(n)), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*there, F.lit(""))

    key = F.trim(tx.safe(F.col("entity_id")))
    out = df.select(key.alias("entity_id"), tx.plain(first_of("clean_name_full", "clean_name", "business_name")).alias("name"), tx.plain(first_of("clean_address", "business_address")).alias("address"), (F.col(ordinal) if ordinal else F.lit(0)).alias("ord"))
    out = out.filter("entity_id <> ''").groupBy("entity_id").agg(F.max(F.struct("ord", "name", "address")).alias("r"))
    return out.select("entity_id", "r.name", "r.address")


def truth_pairs(truth: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """``s1_id, target_id``: a truth table as pairs, for all or for given anchors (``entity_id``)."""
    t = truth.select(F.trim("source1_entity_id").alias("s1_id"), F.explode(tx.id_list(F.col("matched_entity_ids"))).alias("target_id"))
    if anchors is not None:
        t = t.join(anchors.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    return t.distinct()


def targets(s2: DataFrame, s3: DataFrame) -> DataFrame:
    """The target catalog: the rows of the second and the third source, with ``source``."""
    return s2.withColumn("source", F.lit("S2")).unionByName(s3.withColumn("source", F.lit("S3")))


def write_tsv(df: DataFrame, path: str) -> None:
    """Write a tab-separated table with a header; missing values are empty, not quoted."""
    df.write.mode("overwrite").options(sep="\t", header=True, emptyValue="", nullValue="", quote="").csv(path)


def write_tsv_file(df: DataFrame, path: str) -> None:
    """The same as one file that appears whole: written beside its place by one task, then renamed."""
    spark = df.sparkSession
    made = f"{path}.parts"
    write_tsv(df.coalesce(1), made)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    store = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in store.listStatus(fs_path(made)) if f.getPath().getName().startswith("part-"))
    store.delete(fs_path(path), True)
    store.rename(part, fs_path(path))
    store.delete(fs_path(made), True)


def write_parquet(df: DataFrame, path: str) -> None:
    """Write a table in one job."""
    df.write.mode("overwrite").parquet(path)


def id_lists(pairs: DataFrame, anchors: DataFrame, column: str = "candidate_entity_ids", rank: str = "rank") -> DataFrame:
    """``source1_entity_id, <column>``: ranked comma lists, one row for every anchor, empty where there is no pair."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, "target_id"))), lambda x: x["target_id"]), ",").alias("ids"))
    every = anchors.select(F.col("entity_id").alias("s1_id")).distinct()
    return every.join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias(column))
