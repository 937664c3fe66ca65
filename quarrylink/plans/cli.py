"""Command line: ``python -m quarrylink.plans.cli normalize|candidates|match|validate ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrylink.operators import blocking, matching, validation
from quarrylink.plans import linkage
from quarrylink.sources import tables


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrylink")
    sub = p.add_subparsers(dest="command", required=True)
    n = sub.add_parser("normalize")
    n.add_argument("--input-dir", required=True)
    n.add_argument("--output-dir", required=True)
    n.add_argument("--names", nargs="+", default=[f"{part}_source{i}" for part in ("train", "test") for i in (1, 2, 3)])
    c = sub.add_parser("candidates")
    c.add_argument("--test-dir", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--k", type=int, default=20)
    c.add_argument("--semantic", default="tfidf")
    c.add_argument("--min-sim", type=float, default=blocking.MIN_SIMILARITY)
    c.add_argument("--parts", action="store_true", help="write a folder of parts instead of one file")
    m = sub.add_parser("match")
    m.add_argument("--test-dir", required=True)
    m.add_argument("--candidates", required=True)
    m.add_argument("--output", required=True)
    m.add_argument("--threshold", type=float, default=matching.THRESHOLD)
    m.add_argument("--max-per-source", type=int, default=matching.MAX_PER_SOURCE)
    m.add_argument("--parts", action="store_true", help="write a folder of parts instead of one file")
    sub.add_parser("config")
    v = sub.add_parser("validate")
    v.add_argument("--matching", required=True)
    v.add_argument("--candidate", required=True)
    v.add_argument("--test-dir", required=True)
    v.add_argument("--check-ids", action="store_true")
    return p


def _sources(spark, folder, prefix="test_source"):
    found = [tables.find_source(spark, folder, f"{prefix}{i}") for i in (1, 2, 3)]
    return [f and tables.read_any(spark, f) for f in found]


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "config":
        print(*(f"{name} = {value}" for name, value in linkage.configuration()), sep="\n")
        return 0
    spark = SparkSession.builder.appName("quarrylink").getOrCreate()
    if args.command == "normalize":
        print(*linkage.normalize_folder(spark, args.input_dir, args.output_dir, tuple(args.names)))
        return 0
    s1, s2, s3 = _sources(spark, args.test_dir)
    if s1 is None:
        print("test_source1 is missing", file=sys.stderr)
        return 1
    if args.command == "candidates":
        from quarrylink.operators.normalize import normalized

        raw = "business_name" in s1.columns
        a, b, c = (normalized(x) if raw else x for x in (s1, s2, s3))
        pairs = linkage.candidates(a, tables.targets(b, c), args.k, args.semantic, args.min_sim)
        out = tables.id_lists(pairs, a)
        (tables.write_tsv if args.parts else tables.write_tsv_file)(out, args.output)
    elif args.command == "match":
        lists = tables.read_lists(spark, args.candidates)
        pairs = lists.select(F.col("source1_entity_id").alias("s1_id"), F.posexplode("ids").alias("rank", "target_id"))
        records = tables.flat_records(s1)
        for other in (s2, s3):
            records = records if other is None else records.unionByName(tables.flat_records(other))
        anchors = s1.select("entity_id").unionAll(lists.select("source1_entity_id"))
        best = matching.matches(pairs, records, args.threshold, args.max_per_source)
        out = tables.id_lists(best, anchors, "matched_entity_ids")
        if args.parts:
            tables.write_tsv(out, args.output)
        else:
            # the candidates' order, then the anchors that these miss, by id
            place = lists.select("source1_entity_id").withColumn("at", F.monotonically_increasing_id()).groupBy("source1_entity_id").agg(F.min("at").alias("at"))
            tables.write_tsv_file(out.join(place, "source1_entity_id", "left").orderBy(F.asc_nulls_last("at"), "source1_entity_id").drop("at"), args.output)
    else:
        ids = None if s2 is None or s3 is None else s2.select(F.col("entity_id").alias("id")).unionAll(s3.select("entity_id")).distinct()
        found = validation.validate(spark, args.matching, args.candidate, s1, ids, args.check_ids)
        found.orderBy("severity", "file", "rule").show(100, False)
        return 0 if validation.passed(found) else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
