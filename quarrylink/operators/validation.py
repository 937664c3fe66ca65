"""Checks of result files, as a table of findings.

Every rule is a filter over one scan of the lines, so files of any size are checked by all
executors; a finding keeps the number of offenders and five of them in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylink.sources.tables import exists, numbered_lines, without_headers

FINDINGS = "file string, severity string, rule string, n long, examples array<string>"
MATCHING_HEADER = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_HEADER = ("source1_entity_id", "candidate_entity_ids")


def _found(offenders: DataFrame, file: str, rule: str, severity: str = "error") -> DataFrame:
    """One finding if ``offenders`` (a column ``x``) has rows. Only five distinct ones are ever gathered."""
    distinct = offenders.select("x").distinct()
    first = distinct.orderBy("x").limit(5).agg(F.array_sort(F.collect_list("x")).alias("examples"))
    return distinct.agg(F.count("*").alias("n")).join(F.broadcast(first)).filter("n > 0").select(F.lit(file).alias("file"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), "n", "examples")


def _stop(spark: SparkSession, file: str, rule: str, severity: str = "error", examples: tuple[str, ...] = ()) -> DataFrame:
    return spark.createDataFrame([(file, severity, rule, 1, list(examples))], FINDINGS)


def rows_of(body: DataFrame) -> DataFrame:
    """``s1, ids``: the rows of lines with a tab. Ids are taken as they stand, untrimmed."""
    at = F.instr("value", "\t")
    rest = F.expr("substring(value, instr(value, '\t') + 1)")
    ids = F.when(F.regexp_replace(rest, r"\s", "") == "", F.array().cast("array<string>")).otherwise(F.split(rest, ","))
    return body.filter(at > 0).select(F.expr("substring(value, 1, instr(value, '\t') - 1)").alias("s1"), ids.alias("ids"))


def row_findings(rows: DataFrame, file: str, required: DataFrame, valid_ids: DataFrame | None = None) -> DataFrame:
    """Findings on parsed rows (``s1, ids``): repeats, wrong ids, missing and unexpected anchors.

    All rules are told in one pass over the anchors and one over the distinct ids; both serve
    the counts and the examples, so ``rows`` is planned four times, however many rules there are.
    """
    when = lambda rule, found: F.when(found, F.lit(rule))
    need = required.select(F.col("entity_id").alias("x")).distinct().withColumn("needed", F.lit(True))
    seen = rows.groupBy(F.col("s1").alias("x")).agg(F.count("*").alias("c"), F.max(F.size("ids") != F.size(F.array_distinct("ids"))).alias("repeats"))
    own = [when("duplicate_row", F.col("c") > 1), when("duplicate_id_in_list", F.col("repeats")), when("missing_anchor", F.col("c").isNull()), when("unexpected_anchor", F.col("needed").isNull())]
    each = rows.select(F.explode("ids").alias("x")).distinct()
    ids = [when("self_match", F.col("x").startswith("S1-")), when("wrong_prefix", ~F.col("x").rlike("^S[123]-"))]
    if valid_ids is not None:
        each = each.join(valid_ids.select(F.col("id").alias("x")).distinct().withColumn("valid", F.lit(True)), "x", "left")
        ids.append(when("unknown_id", F.col("x").rlike("^S[23]-") & F.col("valid").isNull()))
    told = lambda df, rules: df.select("x", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    found = told(seen.join(need, "x", "full"), own).unionAll(told(each, ids))
    # a file may lack most ids: of each rule only the five first are gathered, cut before the shuffle
    place = F.row_number().over(W.partitionBy("rule").orderBy("x"))
    first = found.withColumn("place", place).filter(F.col("place") <= 5).groupBy("rule").agg(F.array_sort(F.collect_list("x")).alias("examples"))
    counts = found.groupBy("rule").agg(F.count("*").alias("n"))
    return counts.join(first, "rule").select(F.lit(file).alias("file"), F.lit("error").alias("severity"), "rule", "n", "examples")


def validate_file(spark: SparkSession, path: str, header: tuple[str, ...], required: DataFrame, valid_ids: DataFrame | None = None, label: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Findings of one file or of a folder of parts, and its rows (None where it can't be parsed)."""
    file = label or path.rstrip("/").rsplit("/", 1)[-1]
    if not exists(spark, path):
        return _stop(spark, file, "file_not_found"), None
    first = spark.read.text(path).first()
    if first is None:
        return _stop(spark, file, "empty_file"), None
    head = first["value"]
    if "\t" not in head and "," in head:
        return _stop(spark, file, "comma_separated"), None
    if tuple(c.strip().lower() for c in head.rstrip("\r\n").split("\t")) != tuple(header):
        return _stop(spark, file, "unexpected_header", examples=(head,)), None
    body = without_headers(numbered_lines(spark, path), head)
    broken = body.filter(~F.is_valid_utf8(F.col("value")))
    malformed = body.filter((F.instr("value", "\t") == 0) & (F.regexp_replace("value", r"\s", "") != ""))
    rows = rows_of(body)
    found = row_findings(rows, file, required, valid_ids)
    return found.unionAll(_found(malformed.select(F.col("value").alias("x")), file, "malformed_row")).unionAll(_found(broken.select(F.hex("value").alias("x")), file, "invalid_utf8")), rows


def validate(spark: SparkSession, matching: str, candidate: str, anchors: DataFrame | None, target_ids: DataFrame | None = None, check_ids: bool = False) -> DataFrame:
    """All findings on a matching file and its candidate file.

    Errors make a submission invalid; warnings never do: an absent candidate file, matches
    that are no candidates, and that ids were not checked.
    """
    if anchors is None:
        return _stop(spark, "anchors", "source_missing")
    out = []
    if not check_ids:
        out.append(_stop(spark, "ids", "not_checked", "warning"))
    elif target_ids is None:
        out.append(_stop(spark, "ids", "targets_missing", "warning"))
    ids = target_ids if check_ids else None
    found, m_rows = validate_file(spark, matching, MATCHING_HEADER, anchors, ids, "matching")
    out.append(found)
    if not exists(spark, candidate):
        return reduce(DataFrame.unionAll, [*out, _stop(spark, "candidate", "file_not_found", "warning")])
    found, c_rows = validate_file(spark, candidate, CANDIDATE_HEADER, anchors, ids, "candidate")
    out.append(found)
    if m_rows is not None and c_rows is not None:
        out.append(not_candidates(m_rows, c_rows))
    return reduce(DataFrame.unionAll, out)


def not_candidates(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """A warning on matched pairs that are not among the candidates."""
    pair = lambda rows: rows.select("s1", F.explode("ids").alias("id")).distinct()
    return _found(pair(matched).join(pair(candidates), ["s1", "id"], "left_anti").select(F.col("s1").alias("x")), "matching", "match_not_candidate", "warning")


def passed(findings: DataFrame) -> bool:
    """Whether there is no error among the findings."""
    return findings.filter("severity = 'error'").isEmpty()
