"""Each stage of the pipeline against a plain version of its decision, on its own input."""

import corpus_pipeline as cp
from quarrylink.llm import decontam, linededup, packing, quality
from quarrylink.llm.common import read, stored
from tests.llm.test_nearcopies import _components

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    after = {}
    for name, stage in cp.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), "test-stage")
        assert out.columns == docs.columns
        after[name] = docs, out
        docs = out
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, out = after["quality"]
    assert ids(out) == {r["doc_id"] for r in quality.classify(before, labels).filter("keep").collect()}
    before, out = after["line_dedup"]
    texts = {r["doc_id"]: r["text"] for r in linededup.drop_boilerplate(before).collect()}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == texts
    before, out = after["near_dedup"]
    # the contract's five words and similarity 0.8, not op7's own contract
    rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
    assert ids(out) == {c for _, c in _components(rows)}
    before, out = after["decontamination"]
    assert ids(out) == {r["doc_id"] for r in decontam.contamination(before, read(spark, SF, "benchmark")).filter("not contaminated").collect()}
    packed = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == ids(docs) and all(r["offset"] + r["length"] <= packing.MAX_TOKENS for r in packed)
    again = cp.run(spark, SF)
    assert again.count() == len(packed)
    # null ids: a contaminated row goes, a clean one and copies without an id stay
    item = read(spark, SF, "benchmark").first()["text"]
    odd = spark.createDataFrame([(None, item, None, None, None), (None, "clean text", "en", "a", 1), (None, "clean text", "en", "a", 1), (3, "clean text", "en", "a", 1), (4, "clean text", "en", "a", 1), (5, None, None, None, None)], docs.schema)
    assert sorted(str(r["doc_id"]) for r in cp.drop_contaminated(spark, odd, SF).collect()) == ["3", "4", "5", "None", "None"]
    assert sorted(str(r["doc_id"]) for r in cp.keep_one_of_near_copies(spark, odd, SF).collect()) == ["3", "5", "None", "None", "None"]
    for _, stage in cp.STAGES:
        assert stage(spark, odd, SF).count() >= 1
    # empty tables
    empty = read(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_ignore_columns_with_clashing_names(spark):
    docs = read(spark, SF, "documents")
    clash = docs
    for name, value in (("keep", "false"), ("n_dropped", "0"), ("n_words", "7"), ("component_id", "-1"), ("copy_id", "doc_id"), ("copy_hash", "1"), ("text_hash", "1"), ("hit_id", "doc_id"), ("length", "1"), ("rank", "1"), ("THRESHOLD", "0")):
        clash = clash.selectExpr("*", f"{value} AS {name}")
    for _, stage in cp.STAGES:
        plain, odd = stage(spark, docs, SF), stage(spark, clash, SF)
        assert odd.columns == plain.columns
        rows = lambda df: sorted(map(str, df.drop("sequence_id", "offset").collect()))
        assert rows(odd) == rows(plain)


def test_near_dedup_judges_rows_of_one_id_by_their_texts(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (2, "a text of its own, of no other document", "en", "a", 1), (3, text + " more", "en", "a", 1)]
    docs = spark.createDataFrame(rows, read(spark, SF, "documents").schema)
    assert sorted((r["doc_id"], r["text"][:6]) for r in cp.keep_one_of_near_copies(spark, docs, SF).collect()) == [(1, "word0 "), (2, "a text")]
