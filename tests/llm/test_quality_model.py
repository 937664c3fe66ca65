"""The quality model on disk, and texts that meet it shard by shard."""

import numpy as np
import pytest

from quarrylink.llm import quality
from quarrylink.llm.common import stored


def _texts(spark, n):
    rng = np.random.default_rng(4)
    words = (rng.pareto(0.6, (n, 100)) * 20 % 30_000).astype(int)
    return spark.createDataFrame([(i, " ".join(f"w{w}" for w in row)) for i, row in enumerate(words)], "i int, text string").repartition(3)


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_packed_trigrams_are_the_same():
    rng = np.random.default_rng(2)
    first, middle, last, x = (rng.integers(0, m, 5000) for m in (30, 9, 2**32, 2**32))
    last[:2500] %= 3
    order = np.lexsort((last, first, middle))
    want = [c[order] for c in (first, middle, last, x)]
    assert all((a == b).all() for a, b in zip(quality._unpack(quality._pack(*want)), want, strict=True))
    assert [len(c) for c in quality._unpack(quality._pack(*(c[:0] for c in want)))] == [0] * 4


def test_model_takes_few_bytes_and_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    model = quality.fit(_texts(spark, 2000))
    assert _shuffle_files(spark) <= before
    size = model.packed.selectExpr("sum(length(packed)) as bytes", "sum(n) as n").first()
    # keys and values of n-grams took 9 bytes each, some 20 a trigram
    assert size["n"] > 100_000 and size["bytes"] < 8 * size["n"]


def test_stored_deletes_shuffle_files_if_asked(spark):
    before = _shuffle_files(spark)
    out = stored(spark.range(1000).repartition(7).groupBy("id").count(), "t", clean=True)
    assert _shuffle_files(spark) <= before and out.count() == 1000


@pytest.mark.parametrize("rounds", [1, 3])
def test_sums_by_shards_are_those_of_a_broadcast_model(spark, monkeypatch, rounds):
    monkeypatch.setattr(quality, "CHUNK", 20_000)
    docs = _texts(spark, 300)
    docs = docs.union(docs.limit(40)).union(spark.createDataFrame([(-1, "never seen w1 w2 here"), (-2, ""), (-3, None), (-4, " ")], docs.schema))
    model = quality.fit(docs.filter("i % 3 = 0"))
    want = {r["i"]: r for r in quality.perplexities(docs, model).collect()}
    got = quality.with_sums(docs, quality.text_sums(docs, model, rounds=rounds)).collect()
    assert len(got) == 344
    for r in got:
        assert r["n_words"] == want[r["i"]]["n_words"] and r["log_p"] == pytest.approx(want[r["i"]]["log_p"], rel=1e-9)


def test_documents_are_judged_alike_by_shards(spark, monkeypatch):
    docs = _texts(spark, 200).selectExpr("cast(i as bigint) as doc_id", "text", "if(i % 3 = 0, 'fr', if(i % 3 = 1, 'en', null)) as lang", "i as log_p", "i as sums_a")
    odd = spark.createDataFrame([(900, None, "en", 0, 0), (None, "w1 w2", "fr", 0, 0), (7, "odd " * 300, "en", 0, 0), (7, "odd " * 300, "en", 0, 0), (901, " ", None, 0, 0)], docs.schema)
    docs = docs.union(odd)
    labels = docs.selectExpr("doc_id", "int(doc_id % 7 > 0) as quality")
    rows = lambda: sorted(((*r[:5], r["n_words"], round(r["perplexity"], 4), round(r["threshold"], 4), r["keep"]) for r in quality.classify(docs, labels).collect()), key=str)
    want = rows()
    asked = []
    monkeypatch.setattr(quality.Model, "shared", lambda self, most=0: asked.append(most))
    assert rows() == want and asked and {r[-1] for r in want} == {True, False}
