"""Benchmark decontamination: occurrences of item windows in documents, by a prefix-filtered join.

A window (``WINDOW`` words in a row of an item, or the whole of a shorter item) is the set of its
word shingles. A document that holds the window holds all of them, so for exact containment
one prefix token is enough: the rarest shingle in all documents. Document shingles are joined
to these prefix tokens; the token's place in the window bounds where the window must begin
and end; what is left is compared word by word. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylink.llm.common import fresh, read, stored

WINDOW = 10
SHINGLE = 3
#: Windows of one broadcast block; at 10 words each a block stays under some 20 MB.
BLOCK_WINDOWS = 50_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, then runs of a-z, 0-9 and all beyond ASCII. Null has none."""
    low = F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))
    return F.coalesce(F.array_remove(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``window, n, items``: the distinct windows, their lengths and the ids of the items that have them."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = w.filter(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("window"))
    return each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("n", F.size("window"))


def _shingle(ws: Column, at: Column, k: int) -> Column:
    """The hash of the k words from a place (counted from 0) on; null where they run past the end."""
    found = F.xxhash64(*(F.get(ws, at + i) for i in range(k)))
    return F.when(at + k <= F.size(ws), found)


def _placed(docs: DataFrame, text: str, keys: list[Column], k: int) -> DataFrame:
    """A row for each word of each document with its shingle. The word array is only copied for rows that a join keeps."""
    placed = docs.select(*keys, words(F.col(text)).alias("w")).select("*", F.posexplode_outer("w").alias("at", "word"))
    return placed.select(*[c for c in placed.columns if c != "word"], _shingle(F.col("w"), F.col("at"), k).alias("shingle"))


def occurrences(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK_WINDOWS) -> DataFrame:
    """``doc_id, text_hash, start, n, items``: each occurrence of a window (start counted from 0)."""
    spark = docs.sparkSession
    every = stored(windows(items, item_id, item_text, size), "windows")
    keys = [F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash")]
    found = []
    # short items have short shingles: one pass for each length of shingle in use, three at most
    for (k,) in every.select(F.least(F.lit(shingle), F.col("n")).alias("k")).distinct().orderBy("k").collect():
        of = every.filter(F.least(F.lit(shingle), F.col("n")) == k)
        tokens = of.select("window", "n", "items", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - k), lambda i: F.xxhash64(*(F.get("window", i + j) for j in range(k))))).alias("offset", "shingle"))
        blocks = max(1, math.ceil(of.count() / block))
        part = F.pmod(F.xxhash64("shingle"), F.lit(blocks))
        # how often each token of a window occurs in all documents
        counted = []
        for b in range(blocks):
            some = F.broadcast(tokens.filter(part == b).select("shingle").distinct())
            counted.append(_placed(docs, text, [], k).select("shingle").join(some, "shingle").groupBy("shingle").agg(F.count("*").alias("df")))
        df = stored(reduce(DataFrame.unionAll, counted), "shingle-counts")
        # tokens that occur nowhere have no row: their windows cannot occur
        ranked = tokens.join(df, "shingle", "left").groupBy("window", "n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("offset"), F.col("shingle"))).alias("rarest"), F.first("items").alias("items"))
        prefix = stored(ranked.filter("rarest.df > 0").select("window", "n", "items", "rarest.offset", "rarest.shingle"), "prefix-tokens")
        for b in range(blocks):
            some = F.broadcast(prefix.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b))
            placed = _placed(docs, text, keys, k).alias("d")
            start = F.col("at") - F.col("offset")
            fits = (F.col("d.shingle") == F.col("p.shingle")) & (start >= 0) & (start + F.col("n") <= F.size("w")) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("window"))
            found.append(placed.join(some.alias("p"), fits).select("doc_id", "text_hash", start.alias("start"), "n", "items"))
    if not found:
        kind = docs.schema[doc_id].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, text_hash bigint, start int, n int, items array<string>")
    return reduce(DataFrame.unionAll, found)


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items``: one row per input row.

    A word inside any occurrence of a window is hit. Rows with equal ids and different texts
    are judged each on its own; repeated rows get equal results. Null and empty texts have
    no words. Items without words have no windows; an item with a null id hits words but
    adds no id. Empty tables of documents give no rows, empty benchmarks no hits. Extra
    columns are ignored.
    """
    hits = occurrences(docs, items, doc_id, text, **options)
    by_doc = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.collect_set("items").alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))))
    by_doc = by_doc.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("with"), covered.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    out = base.join(by_doc, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("with")), "left")
    got = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(F.col("doc_id").alias(doc_id), "n_words", n_hit.alias("n_hit"), F.size(got).cast("long").alias("n_items"), F.sha2(F.array_join(got, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), got.alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold any window of an item; all columns pass through.

    Rows are told apart by id and text together, so null and repeated ids are judged right.
    """
    of, with_hash = fresh(docs, "hit_id", "hit_hash")
    hits = occurrences(docs, items, doc_id, text, **options).select(F.col("doc_id").alias(of), F.col("text_hash").alias(with_hash)).distinct()
    bad = stored(hits, "contaminated")
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col(of)) & (F.xxhash64(F.col(text)) == F.col(with_hash)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


_WORDS = "list_filter(regexp_split_to_array(translate(text, '%s', '%s'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')" % (_UPPER, _UPPER.lower())
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, CAST([] AS VARCHAR[])) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(w) AS n, CASE WHEN len(w) < {WINDOW} THEN w ELSE w[i:i + {WINDOW} - 1] END AS win FROM (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT doc_id, i, sizes.n, w[i:i + sizes.n - 1] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) CROSS JOIN sizes
  WHERE i + sizes.n - 1 <= len(w)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN g USING (doc_id)
"""
