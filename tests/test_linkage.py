import os

import pytest
from pyspark.sql import functions as F

from quarrylink import queries
from quarrylink.functions import similarity as sim
from quarrylink.operators import blocking, embedding, evaluation, matching, profiling, validation
from quarrylink.plans import cli, linkage
from quarrylink.sources import tables, views

RECORD = "entity_id string, business_name string, business_address string, country string, source string"


def _score(n1, a1, n2, a2):
    """The pair score, word for word from its definition."""

    def ratio(x, y):
        return 100.0 if not x and not y else 200.0 * sim.common_subsequence(x, y) / (len(x) + len(y))

    def sort(x, y):
        return ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split())))

    def tset(x, y):
        s, t = set(x.split()), set(y.split())
        if not s or not t:
            return 0.0
        i, d, e = (" ".join(sorted(v)) for v in (s & t, s - t, t - s))
        if i and (not d or not e):
            return 100.0
        u, v = f"{i} {d}".strip(), f"{i} {e}".strip()
        return max([ratio(u, v)] + ([ratio(i, u), ratio(i, v)] if i else []))

    def nums(x):
        import re

        return {n.lstrip("0") for n in re.findall(r"\b[0-9]+\b", x)} - {""}

    if not n1 or not n2:
        return 0.0
    name = 100.0 if n1 == n2 else 0.65 * tset(n1, n2) + 0.35 * sort(n1, n2)
    x, y = nums(f"{n1} {a1}"), nums(f"{n2} {a2}")
    num = 100.0 if x & y else 10.0 if x and y else 60.0
    if a1 and a2:
        out = 0.5 * name + 0.35 * (0.4 * tset(a1, a2) + 0.3 * sort(a1, a2) + 0.3 * ratio(a1, a2)) + 0.15 * num
    else:
        out = 0.8 * name + 0.2 * num
    return min(out, 30.0) if tset(n1, n2) < 45 else out


NAMES = ["acme", "acme ltd", "blue sky foods", "sky blue food", "zenith 12", "", "apollo pharmacy"]
ADDRESSES = ["", "12 main st", "012 main street", "9 elm rd", "main st"]


def test_pair_scores_and_threshold(spark):
    recs = [(f"S{1 + i % 3}-{i}", n, a) for i, (n, a) in enumerate((n, a) for n in NAMES for a in ADDRESSES)]
    records = spark.createDataFrame(recs, "entity_id string, name string, address string")
    ids = [r[0] for r in recs]
    pairs = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate((a, b) for a in ids for b in ids if a < b)] + [("S1-0", "S2-999", -1)], "s1_id string, target_id string, rank int")
    of = {r[0]: r[1:] for r in recs}
    got = {(r["s1_id"], r["target_id"]): r["score"] for r in matching.scored_pairs(pairs, records).collect()}
    assert len(got) == pairs.count() - 1
    for (a, b), s in got.items():
        assert s == pytest.approx(_score(*of[a], *of[b]), abs=1e-9)
    for threshold in (35.0, 80.0):
        cut = {(r["s1_id"], r["target_id"]) for r in matching.scored_pairs(pairs, records, threshold).collect()}
        assert cut == {k for k, s in got.items() if s >= threshold}


def test_composite_goldens():
    assert _score("a", "", "a", "") == 92 and _score("a 1", "", "a 1", "2") == 100 and _score("a", "x", "a", "x") == 94


def test_best_matches_keep_candidate_order(spark):
    scored = spark.createDataFrame([("S1-1", "S2-9", 90.0, 1), ("S1-1", "S2-1", 90.0, 2), ("S1-1", "S3-1", 85.0, 3), ("S1-1", "S3-2", 95.0, 4), ("S1-1", "S2x", 99.0, 5)], "s1_id string, target_id string, score double, rank int")
    rows = matching.best_matches(scored).orderBy("rank").collect()
    assert [(r["target_id"], r["rank"]) for r in rows] == [("S2-9", 1), ("S3-2", 2)]
    lists = matching.with_all_anchors(matching.best_matches(scored, 2), spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")).collect()
    assert {r[0]: r[1] for r in lists} == {"S1-1": "S2-9,S2-1,S3-2,S3-1", "S1-2": ""}


def test_posting_limits(spark):
    rows = [(f"S2-{i:02d}", "alpha beta" if i < 3 else "alpha gamma", "no 5", "X", "S2") for i in range(6)]
    t = blocking.positions(linkage.normalized(spark.createDataFrame(rows, RECORD)))
    kept = {r["feature"] for r in blocking.token_postings(t, max_postings=5).collect()}
    assert kept == {"beta", "gamma"}
    assert {r["entity_id"] for r in blocking.number_postings(t, max_postings=2).collect()} == {"S2-00", "S2-01"}
    a = linkage.normalized(spark.createDataFrame([("S1-1", "Alpha Gamma", "5", "x ", "S1"), ("S1-2", "Alpha", "5", "Y", "S1")], RECORD))
    top = blocking.token_candidates(a, t, 2).orderBy("rank").collect()
    assert [(r["s1_id"], r["target_id"], r["score"]) for r in top] == [("S1-1", "S2-03", 2.0), ("S1-1", "S2-04", 2.0)]
    fin = blocking.union_and_rank(a, {"b": blocking.token_candidates(a, t), "c": blocking.number_candidates(a, t)}, 3)
    assert {r["s1_id"] for r in fin.collect()} == {"S1-1"}
    more = blocking.union_and_rank(a, {"b": blocking.token_candidates(a, t), "c": blocking.number_candidates(a, t)}, 5)
    assert fin.exceptAll(more).count() == 0
    lists = tables.id_lists(fin, a).collect()
    assert {r[0]: r[1].count("S2") for r in lists} == {"S1-1": 3, "S1-2": 0}


def _copies(times):
    """Records of three sources, each ``times`` times under other ids: few texts, many ties."""
    names = ["alpha beta", "alpha gamma", "beta gamma delta", "alpha", "delta"]
    rows = [(i, names[i % 5], f"unit {i % 4} road {i % 3}", "XY"[i % 2]) for i in range(30)]
    return [(f"S{1 + i % 3}-{k * 30 + i:05d}", n, a, c, f"S{1 + i % 3}") for k in range(times) for i, n, a, c in rows]


def test_copies_are_compared_once(spark):
    """Candidates of repeated records as by all pairs, from a plan that makes no pairs of copies."""
    rows = _copies(12)
    n = linkage.normalized(spark.createDataFrame(rows, RECORD))
    a, t = n.filter("source = 'S1'"), blocking.positions(n.filter("source <> 'S1'"))
    got = {}
    for r in blocking.token_candidates(a, t, 7, 10**6).collect():
        got.setdefault(r["s1_id"], []).append((r["rank"], r["target_id"], r["score"]))
    for s1, name, _, country, source in rows:
        if source == "S1":
            scored = [(-len(set(name.split()) & set(m.split())), src, i) for i, m, _, c, src in rows if src != "S1" and c == country]
            best = sorted(x for x in scored if x[0])[:7]
            assert sorted(got[s1]) == [(k + 1, i, float(-s)) for k, (s, _, i) in enumerate(best)]
    # no more pairs of names than there are different names, however many copies
    made = [p.select("rep", "head").count() for p in _kernel_rows(a, t)]
    assert made and max(made) <= 10 * 10


def _kernel_rows(a, t):
    """The pairs that the search of names hands on."""
    from quarrylink.operators import nearest

    made, blocks = [], nearest.blocks
    with pytest.MonkeyPatch.context() as m:
        m.setattr(nearest, "blocks", lambda *args, **more: made.append(blocks(*args, **more)) or made[-1])
        blocking.tfidf_candidates(a, t, 7)
    return made


def test_findings_in_one_plan_for_all_rules(spark):
    rows = spark.createDataFrame([("S1-1", ["S2-1", "S2-1", "S1-4"]), ("S1-1", ["X"]), (None, ["S3-9"])], "s1 string, ids array<string>")
    found = validation.row_findings(rows, "f", spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string"), spark.createDataFrame([("S2-1",)], "id string"))
    assert {r["rule"]: (r["n"], r["examples"]) for r in found.collect()} == {
        "duplicate_row": (1, ["S1-1"]), "duplicate_id_in_list": (1, ["S1-1"]), "missing_anchor": (1, ["S1-2"]), "unexpected_anchor": (1, []),
        "self_match": (1, ["S1-4"]), "wrong_prefix": (1, ["X"]), "unknown_id": (1, ["S3-9"]),
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 8


def test_country_is_needed(spark):
    with pytest.raises(ValueError, match="country"):
        blocking.require_country(spark.range(1))


def test_neighbours(spark):
    e = spark.createDataFrame([(i, "x", [float((i * 7 + j) % 11) for j in range(8)]) for i in range(40)], "entity_id int, country string, v array<double>").withColumn("vec", embedding.unit(F.col("v")))
    q, t = e.filter("entity_id < 8"), e.filter("entity_id >= 8").withColumn("pos", F.col("entity_id"))
    exact = {(r["s1_id"], r["target_id"]) for r in embedding.exact_neighbours(q, t, 3).collect()}
    cells = {(r["s1_id"], r["target_id"]) for r in embedding.cell_neighbours(q, t, 3, cells=4, probes=4).collect()}
    assert len(exact) == 24 and cells == exact


def test_stored_index(spark, tmp_path):
    from quarrylink.operators import index

    e = spark.createDataFrame([(i, "x", [float((i * 7 + j) % 11) for j in range(8)]) for i in range(40)], "entity_id int, country string, v array<double>").withColumn("vec", embedding.unit(F.col("v")))
    q, t = e.filter("entity_id < 8"), e.filter("entity_id >= 8").withColumn("pos", F.col("entity_id"))
    path = f"{tmp_path}/index"
    assert index.read_settings(spark, path) is None
    assert index.build(t.filter("entity_id < 30"), path, 4).count() == 22
    before = spark.read.parquet(f"{path}/centroids").collect()
    assert index.build(t, path, 4).count() == 32 and spark.read.parquet(f"{path}/centroids").collect() == before
    found = {(r["s1_id"], r["target_id"]) for r in index.search(q, path, 3, probes=4).collect()}
    assert found == {(r["s1_id"], r["target_id"]) for r in embedding.exact_neighbours(q, t, 3).collect()}
    assert index.build(t, path, 2).count() == 32 and index.read_settings(spark, path)["cells"] == 2
    # a rebuild that stops half way leaves no index that is taken for whole
    with pytest.MonkeyPatch.context() as m:
        m.setattr(embedding, "nearest_cells", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.build(t, path, 4)
    assert index.read_settings(spark, path) is None


def test_normalize_folder(spark, tmp_path):
    d = str(tmp_path)
    with open(f"{d}/train_source1.tsv", "w") as f:
        f.write("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tAcme Private Limited\t012 Main Street\tUS\nS1-2\t\t\t\n")
    assert cli.main(["normalize", "--input-dir", d, "--output-dir", f"{d}/out"]) == 0
    rows = {r["entity_id"]: r for r in spark.read.parquet(f"{d}/out/train_source1_normalized.parquet").collect()}
    assert rows["S1-1"]["clean_name_full"] == "acme pvt ltd" and rows["S1-1"]["address_numbers"] == "12" and rows["S1-2"]["has_address"] == 0
    assert cli.main(["config"]) == 0


def test_batch_encoder(spark):
    import numpy as np

    seen = embedding.encoded_in_batches(spark.createDataFrame([("ab",), (None,), ("abcd",)], "clean_name string"), lambda xs: np.array([[len(x), 3.0] for x in xs]), role="query", batch=2)
    got = [r["vec"] for r in seen.orderBy("clean_name").collect()]
    assert [round(v[0] / v[1] * 3) for v in got] == [7, 9, 11]


def test_f_score(spark):
    anchors = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    truth = spark.createDataFrame([("S1-1", "S2-47"), ("S1-1", "S3-812")], "s1_id string, target_id string")
    got = spark.createDataFrame([("S1-1", "S2-47"), ("S1-1", "S2-193"), ("S1-1", "S3-812"), ("S1-3", "S2-1")], "s1_id string, target_id string")
    r = evaluation.macro_f(got, truth, anchors).first()
    assert r["n_anchors"] == 3 and r["macro_f"] == pytest.approx((0.714285714 + 1 + 0) / 3, abs=1e-6)
    none = evaluation.candidate_recall(got, truth.limit(0)).first()
    assert tuple(none) == (0, 0, 0.0)


def test_files_and_validator(spark, tmp_path):
    d = str(tmp_path)
    rows = {"1": [("S1-1", 'Ram "R" Foods', "1 Main", "IN"), ("S1-2", "Zed", "", "IN"), ("S1-3", "NA", "2 Elm", "FR")], "2": [("S2-1", "Ram R Foods", "1 Main St", "IN"), ("S2-2", "Zed", "", "IN")], "3": [("S3-1", "Ram Foods", "1 Main", "IN")]}
    for k, rs in rows.items():
        with open(f"{d}/test_source{k}.tsv", "w") as f:
            f.write("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join('"' + x.replace('"', '""') + '"' if '"' in x else x for x in r) + "\n" for r in rs))
    got = tables.read_tsv(spark, tables.find_source(spark, d, "test_source1"), tables.RECORD).collect()
    assert got[0]["business_name"] == 'Ram "R" Foods' and got[1]["business_address"] == "" and got[2]["business_name"] == "NA"
    assert tables.missing_as_null(tables.read_tsv(spark, f"{d}/test_source1.tsv")).filter("business_name is null").count() == 1
    assert tables.find_source(spark, d, "nothing") is None
    # as one file each, and as folders of parts
    for parts, end in (([], ".tsv"), (["--parts"], "")):
        assert cli.main(["candidates", "--test-dir", d, "--output", f"{d}/c{end}", "--k", "5", "--min-sim", "0.25", *parts]) == 0
        assert cli.main(["match", "--test-dir", d, "--candidates", f"{d}/c{end}", "--output", f"{d}/m{end}", *parts]) == 0
    assert os.path.isfile(f"{d}/m.tsv") and os.path.isdir(f"{d}/m") and not os.path.exists(f"{d}/m.tsv.parts")
    order = lambda name: [x.split("\t")[0] for x in open(f"{d}/{name}.tsv").read().splitlines()]
    assert order("m") == order("c")
    lists = {r[0]: r[1] for r in tables.read_lists(spark, f"{d}/m.tsv").collect()}
    assert lists == {"S1-1": ["S2-1", "S3-1"], "S1-2": ["S2-2"], "S1-3": []}
    assert cli.main(["validate", "--matching", f"{d}/m.tsv", "--candidate", f"{d}/c.tsv", "--test-dir", d, "--check-ids"]) == 0
    anchors = tables.read_tsv(spark, f"{d}/test_source1.tsv")
    # the header of each part is no row
    for k, col in (("c", "candidate_entity_ids"), ("m", "matched_entity_ids")):
        os.makedirs(f"{d}/{k}3")
        rows = open(f"{d}/{k}.tsv").read().splitlines()
        for i, row in enumerate(rows[1:]):
            with open(f"{d}/{k}3/part-{i}.csv", "w") as f:
                f.write(f"source1_entity_id\t{col}\n{row}\n")
    assert sorted(r[0] for r in tables.read_lists(spark, f"{d}/c3").collect()) == ["S1-1", "S1-2", "S1-3"] == sorted(r["id"] for r in tables.read_ids(spark, f"{d}/m3").collect())
    assert cli.main(["match", "--test-dir", d, "--candidates", f"{d}/c3", "--output", f"{d}/m4.tsv"]) == 0 and order("m4")[0] == "source1_entity_id" and sorted(order("m4")[1:]) == ["S1-1", "S1-2", "S1-3"]
    assert validation.validate(spark, f"{d}/m3", f"{d}/c3", anchors, check_ids=False).filter("severity = 'error'").count() == 0
    # a header anywhere else is a row
    with open(f"{d}/twice.tsv", "w") as f:
        f.write("source1_entity_id\tmatched_entity_ids\nS1-1\t\nsource1_entity_id\tmatched_entity_ids\nS1-2\t\nS1-3\t\n")
    assert {r["rule"] for r in validation.validate_file(spark, f"{d}/twice.tsv", validation.MATCHING_HEADER, anchors)[0].collect()} == {"unexpected_anchor", "wrong_prefix"}

    def rules(body, header="source1_entity_id\tmatched_entity_ids\n", ids=None):
        with open(f"{d}/bad.tsv", "wb") as f:
            f.write((header + body).encode() if isinstance(body, str) else header.encode() + body)
        found, _ = validation.validate_file(spark, f"{d}/bad.tsv", validation.MATCHING_HEADER, anchors, ids)
        return {r["rule"] for r in found.collect()}

    whole = "S1-1\tS2-1\nS1-2\t\nS1-3\t\n"
    assert rules(whole) == set()
    assert rules(whole, "a,b\n") == {"comma_separated"} and rules(whole, "a\tb\n") == {"unexpected_header"} and rules("", "") == {"empty_file"}
    assert rules(whole + "oops\n\n") == {"malformed_row"} and rules(whole + "S1-1\t\n") == {"duplicate_row"}
    assert rules("S1-1\tS2-1,S2-1\nS1-2\t\nS1-3\t\n") == {"duplicate_id_in_list"}
    assert rules("S1-1\tS1-2\nS1-2\t S2-1\nS1-3\tX9-1\n") == {"self_match", "wrong_prefix"}
    assert rules("S1-1\tS2-1\nS1-9\t\nS1-3\t\n") == {"missing_anchor", "unexpected_anchor"}
    assert rules(whole, ids=spark.createDataFrame([("S3-1",)], "id string")) == {"unknown_id"}
    assert "invalid_utf8" in rules(b"S1-1\tS2-1\nS1-2\t\nS1-3\t\nS1-3\xff\t\n")
    found = validation.validate(spark, f"{d}/m.tsv", f"{d}/none.tsv", anchors)
    assert {(r["rule"], r["severity"]) for r in found.collect()} == {("not_checked", "warning"), ("file_not_found", "warning")} and validation.passed(found)
    assert not validation.passed(validation.validate(spark, f"{d}/none.tsv", f"{d}/none.tsv", None))


def test_flat_records(spark):
    df = spark.createDataFrame([("S1-1", "", "A-B", 1), ("S1-1 ", "", "Last!", 2), (" ", "", "x", 3), ("S1-2", "clean", "raw", 4)], "entity_id string, clean_name string, business_name string, ord int")
    assert {r[0]: r[1] for r in tables.flat_records(df, "ord").collect()} == {"S1-1": "last", "S1-2": "clean"}


def test_profiles_of_empty_tables(spark):
    empty = spark.createDataFrame([], RECORD)
    assert profiling.profile(empty).first()["rows"] == 0
    t = spark.createDataFrame([("S1-1", "S2-1,S3-1"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    s = profiling.match_summary(profiling.match_counts(t)).first()
    assert (s["anchors"], s["singletons"], s["matches_s2"], s["mean_matches"]) == (2, 1, 1, 1.0)
    assert linkage.link(empty, empty, semantic="none").count() == 0


def test_streaming(spark, tmp_path):
    from quarrylink.streaming.incremental import best_of, match_stream

    d = str(tmp_path)
    anchors = spark.createDataFrame([("S1-1", "Acme Foods", "1 Main", "US", "S1")], RECORD)
    for i, n in enumerate(["Acme Food", "Acme Foods"]):
        spark.createDataFrame([(f"S2-{i}", n, "1 Main", "US", "S2")], RECORD).coalesce(1).write.mode("append").parquet(f"{d}/in")
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    match_stream(stream, anchors, f"{d}/out", f"{d}/ck", semantic="none").awaitTermination(120)
    got = best_of(spark.read.parquet(f"{d}/out")).collect()
    assert [r["target_id"] for r in got] == ["S2-1"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(same_rows, name):
    same_rows(queries.QUERIES[name], queries.ORACLES[name])


def test_part_records_are_dealt_over_all_cores(spark):
    records = views.part_records(spark, "/root/testdata/sf0.001")
    n = records.rdd.getNumPartitions()
    assert n >= spark.sparkContext.defaultParallelism > 1
    assert records.count() == views.table(spark, "/root/testdata/sf0.001", "part").count()


def test_signals_are_stored(spark):
    """Each signal is computed once, so that nothing is left to do in plans over it."""
    n = linkage.normalized(spark.createDataFrame(_copies(2), RECORD))
    a, t = n.filter("source = 'S1'"), blocking.positions(n.filter("source <> 'S1'"))
    made = linkage.signals(a, t, 7)
    assert sorted(made) == ["a", "b", "c"]
    for k, alone in (("a", blocking.tfidf_candidates(a, t, 7)), ("b", blocking.token_candidates(a, t, 7)), ("c", blocking.number_candidates(a, t, blocking.NUMBER_TOP))):
        assert "Exchange" not in made[k]._jdf.queryExecution().executedPlan().toString()
        assert sorted(made[k].collect()) == sorted(alone.collect())
    with pytest.raises(ValueError, match="no such signal"):
        linkage.signals(a, t, semantic="other")


def test_truth_by_key_makes_no_pairs(spark):
    """Copies have pairs by the square of their number; figures by key equal those of all pairs, also for null keys and repeated ids."""
    left = [(f"S1-{i}", ["x", "y", None, "z"][i % 4]) for i in range(40)] + [("S1-0", "y"), ("S1-1", "y")]
    right = [(f"S2-{i}", ["x", "y", None][i % 3]) for i in range(60)] + [("S2-0", "y"), ("S2-1", "y")]
    a, t = spark.createDataFrame(left, "s1_id string, key string"), spark.createDataFrame(right, "target_id string, key string")
    pairs, keyed = a.join(t, "key").select("s1_id", "target_id"), evaluation.Keyed(a, t)
    ranked = spark.createDataFrame([(f"S1-{i}", f"S2-{(i * 7 + k) % 60}", k) for i in range(42) for k in range(1, 30)], "s1_id string, target_id string, rank int")
    anchors = a.select(F.col("s1_id").alias("entity_id"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(evaluation.candidate_recall(ranked, keyed)) == rows(evaluation.candidate_recall(ranked, pairs)) and pairs.count() > 300
    assert rows(evaluation.sweep(ranked, keyed, 42, 62)) == rows(evaluation.sweep(ranked, pairs, 42, 62))
    assert rows(evaluation.macro_f(ranked.filter("rank < 4"), keyed, anchors)) == rows(evaluation.macro_f(ranked.filter("rank < 4"), pairs, anchors))
    none = evaluation.Keyed(a.limit(0), t)
    assert tuple(evaluation.candidate_recall(ranked, none).first()) == (0, 0, 0.0)
    for f in (queries.ev1_recall, queries.ev4_sweep, queries.ev5_ablation, queries.ev6_macro_f):
        assert "_truth" not in f.__code__.co_names


def test_match_lists_normalize_records_once(spark, monkeypatch):
    made, parts = [], queries._parts
    monkeypatch.setattr(queries, "_parts", lambda *a: made.append(a) or parts(*a))
    assert queries.sk4_match_lists(spark, "/root/testdata/sf0.001").columns == ["source1_entity_id", "matched_entity_ids"]
    assert len(made) == 1


def test_ablation_broadcasts_no_table_of_records(spark):
    record = "entity_id string, country string, clean_name_full string"
    a, t = spark.createDataFrame([("S1-1", "US", "x"), ("S1-2", "US", "y")], record), spark.createDataFrame([("S2-1", "US", "x"), ("S2-2", "US", "x")], record)
    pairs = spark.createDataFrame([("S1-1", "S2-1", 1.0, 1), ("S1-2", "S2-2", 1.0, 1)], "s1_id string, target_id string, score double, rank int")
    out = evaluation.ablation(a, {"a": pairs, "b": pairs.limit(0)}, queries._true_by_name(a, t))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        out = out.select("signal", "total_true_matches", "found_true_matches")
        assert sorted(tuple(r) for r in out.collect()) == [("a", 2, 1), ("b", 2, 0)]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
