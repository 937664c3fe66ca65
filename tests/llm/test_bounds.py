"""The default bounds of model fitting."""

from quarrylink.llm import quality, toxicity


def test_quality_fits_1500_documents_a_language(spark, monkeypatch):
    docs = spark.range(2600).selectExpr("id as doc_id", "concat('text number ', id) as text", "'en' as lang")
    labels = docs.selectExpr("doc_id", "1 as quality")
    seen, fit = [], quality.fit

    def counted(texts, *a, **k):
        seen.append(texts.count())
        return fit(texts, *a, **k)

    monkeypatch.setattr(quality, "fit", counted)
    quality.classify(docs, labels)
    # the half that is not held out: about 1300, all below the bound
    assert 1200 < seen[0] < 1400


def test_quality_fits_all_trusted_documents_of_its_half(spark, monkeypatch):
    docs = spark.range(4400).selectExpr("id as doc_id", "concat('text number ', id) as text", "'en' as lang")
    labels = docs.selectExpr("doc_id", "int(doc_id >= 400) as quality")
    seen, fit = [], quality.fit

    def kept(texts, *a, **k):
        seen.append({r["id"] for r in texts.collect()})
        return fit(texts, *a, **k)

    monkeypatch.setattr(quality, "fit", kept)
    quality.classify(docs, labels)
    half = {r["id"] for r in docs.filter("doc_id >= 400 and pmod(xxhash64(3, doc_id), 1000) >= 500").selectExpr("doc_id as id").collect()}
    assert seen[0] == half and len(half) > 1900


def test_toxicity_bound_is_of_a_language_and_class(spark):
    docs = spark.range(8000).selectExpr("id as doc_id", "concat(if(id % 8 = 0, 'der die und ', 'the of and '), id) as text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 4 = 0) as toxic")
    rows, weights = toxicity.training_rows(docs, labels)
    got = {(t.startswith("der"), y): 0 for t, y in rows}
    for t, y in rows:
        got[t.startswith("der"), y] += 1
    # 6,000 clean English rows, a fifth of them held out, are above the bound; German ones are below it
    assert sum(got.values()) == len(rows) and got[False, 0] == 4000 and weights["de"][1] == 1
    rows, weights = toxicity.training_rows(docs, labels, most=300)
    got = {k: sum((t.startswith("der"), y) == k for t, y in rows) for k in ((True, 1), (False, 1), (False, 0))}
    # a bound over all languages together would leave about 150 German toxic rows
    assert got == {(True, 1): 300, (False, 1): 300, (False, 0): 300}
    assert abs(weights["en"][0] * 300 - 4800) < 150 and toxicity.MAX_LABELLED == 4000
