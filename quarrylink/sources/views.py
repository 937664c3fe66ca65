"""Record views of tables that hold no business records, for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records of three sources by key; country is the type, the address holds the size and a bin of the price.

    The table is one small file with much work to a row, so its rows are dealt over all cores.
    """
    p = table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism)
    source = F.concat(F.lit("S"), (F.col("p_partkey") % 3 + 1).cast("string"))
    return p.select(
        F.concat(source, F.lit("-"), F.col("p_partkey").cast("string")).alias("entity_id"),
        F.concat_ws(" ", "p_name", "p_brand").alias("business_name"),
        F.concat_ws(" ", F.lit("unit"), F.col("p_size").cast("string"), F.lit("road"), F.floor(F.col("p_retailprice") / 100).cast("string")).alias("business_address"),
        F.col("p_type").alias("country"),
        source.alias("source"),
    )


PART_RECORDS = """
SELECT 'S' || (p_partkey % 3 + 1) || '-' || p_partkey AS entity_id, p_name || ' ' || p_brand AS business_name,
  'unit ' || p_size || ' road ' || CAST(floor(p_retailprice / 100) AS BIGINT) AS business_address, p_type AS country, 'S' || (p_partkey % 3 + 1) AS source
FROM part"""


def customer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the first source: the name is an address with the key as its number."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("c_name").alias("business_name"), F.col("c_name").alias("business_address"), F.col("n_name").alias("country"))


def supplier_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the second source."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.concat(F.lit("S2-"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_name").alias("business_name"), F.col("s_name").alias("business_address"), F.col("n_name").alias("country"))
