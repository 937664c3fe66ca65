"""The record normalizer: a projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylink.functions import text as tx


def normalized(df: DataFrame, name: str = "business_name", address: str = "business_address", country: str = "country") -> DataFrame:
    """``df`` with ``clean_name, clean_name_full, clean_address, address_numbers, has_address, country``.

    Numbers are an array of text; ``stored_form`` makes the comma list of files from it.
    """
    made = df.withColumn("clean_name_full", tx.full_name(F.col(name))).withColumn("clean_address", F.when(tx.present(F.col(address)) == 1, tx.address_text(F.col(address))).otherwise(""))
    return made.select(
        "entity_id",
        tx.core_name(F.col("clean_name_full")).alias("clean_name"),
        "clean_name_full",
        "clean_address",
        tx.numbers(F.col("clean_address")).alias("address_numbers"),
        tx.present(F.col(address)).alias("has_address"),
        tx.country(F.col(country)).alias("country"),
        *([c for c in ("source",) if c in df.columns]),
    )


def stored_form(df: DataFrame) -> DataFrame:
    """The normalized table as files hold it, numbers as a comma list."""
    return df.withColumn("address_numbers", F.array_join("address_numbers", ","))


def normalize_record(name: Column, address: Column, country: Column) -> Column:
    """All normalized fields of a record as one struct."""
    n, a = tx.business_name(name), tx.address(address)
    return F.struct(n["core"].alias("clean_name"), n["full"].alias("clean_name_full"), a["clean"].alias("clean_address"), a["numbers"].alias("address_numbers"), a["has"].alias("has_address"), tx.country(country).alias("country"))
