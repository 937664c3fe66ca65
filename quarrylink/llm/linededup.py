"""Line dedup by site-relative frequency.

A line of a host is boilerplate if more than ``ratio`` of the host's pages contain it and at
least ``min_pages`` of them do: a share of fewer pages says nothing (each line of a host of
one page is on all its pages, and the whole text would go). Both hold at every size.
Boilerplate lines go from every page of that host; nothing else changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylink.llm.common import fresh, read, stored

RATIO = 0.05
MIN_PAGES = 5


def _identity(line: Column) -> Column:
    """128 bits that stand for a line, so that no shuffle carries the line itself."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(17), line).alias("b"))


def boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, line, n_pages``: the boilerplate lines of each host, ``line`` as 128 bits.

    Each page counts a line once, whatever the number of its repeats. Counts are combined
    before the shuffle, so a host with a third of all pages is no hot spot: the key holds
    the line. A host keeps at most 1/ratio times the mean number of its pages' lines, since
    each such line takes up more than ``ratio`` of its pages; so a host's lines fit in one row,
    however many pages it has.
    """
    lines = F.filter(F.array_distinct(F.split(F.col(text), "\n")), lambda x: F.trim(F.translate(x, "\t\r", "  ")) != "")
    counted = docs.select(F.col(host).alias("host"), F.explode(lines).alias("line")).select("host", _identity(F.col("line")).alias("line"))
    counted = counted.groupBy("host", "line").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    totals = docs.groupBy(F.col(host).alias("of")).agg(F.count("*").alias("total"))
    return counted.join(totals, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n_pages") > F.lit(ratio) * F.col("total")).select("host", "line", "n_pages")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, plus ``n_lines`` and ``n_dropped``.

    Lines end at line feeds and are compared exactly. Blank lines are never boilerplate. A null
    text stays null, with no lines, though its page counts for the host; an empty text has
    one blank line; very long texts are cut whole; an empty table gives no rows. Null hosts form one host. Repeated rows are pages of their own. Extra
    columns pass through; where they have the new columns' names, the new ones get a suffix.
    """
    lost, key, n_lines, n_dropped, kept = fresh(docs, "lost", "lost_host", "n_lines", "n_dropped", "kept")
    found = stored(boilerplate_lines(docs, host, text, ratio, min_pages), "boilerplate")
    by_host = found.groupBy(F.col("host").alias(key)).agg(F.collect_list("line").alias(lost))
    by_host = stored(by_host, "boilerplate-hosts")
    out = docs.join(by_host, F.col(host).eqNullSafe(F.col(key)), "left")
    lines = F.split(F.col(text), "\n")
    none = F.array().cast(by_host.schema[lost].dataType)
    # the host's lines that this page has, found by hashing; most pages have few
    own = F.array_intersect(F.coalesce(F.col(lost), none), F.transform(F.array_distinct(lines), _identity))
    out = out.withColumn(lost, F.when(F.col(lost).isNotNull(), own))
    out = out.withColumn(kept, F.when(F.col(lost).isNull() | (F.size(lost) == 0), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.coalesce(F.col(lost), none), _identity(x)))))
    out = out.withColumn(n_lines, F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    out = out.withColumn(n_lines, F.greatest(F.col(n_lines), F.lit(0).cast("long")))
    out = out.withColumn(n_dropped, F.when(F.col(kept).isNull(), F.lit(0)).otherwise(F.col(n_lines) - F.size(kept)).cast("long"))
    return out.withColumn(text, F.array_join(F.col(kept), "\n")).drop(lost, key, kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents, each source taken as a site."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs)


ORACLE = f"""
WITH lines AS (SELECT source, line, count(*) AS n FROM (
    SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents)
  WHERE trim(translate(line, chr(9) || chr(13), '  ')) <> '' GROUP BY 1, 2),
totals AS (SELECT source AS host, count(*) AS total FROM documents GROUP BY 1),
lost AS (SELECT source AS host, list(line) AS gone FROM lines JOIN totals ON source IS NOT DISTINCT FROM host
  WHERE n >= {MIN_PAGES} AND n > {RATIO} * total GROUP BY 1),
cut AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines,
    list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(gone, CAST([] AS VARCHAR[])), x)) AS kept
  FROM documents LEFT JOIN lost ON source IS NOT DISTINCT FROM host)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, coalesce(len(lines), 0) AS n_lines,
  coalesce(len(lines) - len(kept), 0) AS n_dropped FROM cut
"""
