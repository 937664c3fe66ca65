"""The fit of toxicity, made by aggregations, against the fit of all rows at hand."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarrylink.llm import toxicity

BAD = ["you stup1d {} and the idiot", "m0ron {} of the trash", "what i d i o t is {}", "der {} ist ein idiot und moron", "les {} et que sont idiot!!"]
FINE = ["the {} is on that table", "hello people of {}", "der {} ist auf dem weg", "le chat est dans la {}", "los {} que no que es", ""]


def _tables():
    """More labelled texts of a class and language than a sample of 4000 holds; a few ids have two texts, both labels, odd ones or none."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefg1!"), rng.integers(1, 9)))
    rows, marks = [], []
    for i in range(7000):
        bad = i % 9 == 0
        text = (FINE[i % 2] if i % 7 else FINE[2 + i % 4]) if not bad or i % 45 == 0 else BAD[i % 5]
        rows.append((i, text.format(f"{word()} {word()}")))
        if i % 50 != 3:
            marks.append((i, 0, int(bad)))
    rows += [(8, "the idiot"), (9, "aaa"), (9, None), (None, "of the idiot"), (7001, None)]
    marks += [(11, 0, 1), (12, 0, 7), (7001, 0, 0), (8000, 0, 1), (None, 0, 1)]
    return rows, marks


def _plainly(rows, marks):
    label = {}
    for i, _, y in marks:
        if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            label[i] = max(y, label.get(i, 0))
    texts = {}
    for i, t in rows:
        if i in label:
            texts[i] = min(t or "", texts.get(i, t or ""))
    return sorted((t, label[i]) for i, t in texts.items())


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_all_labelled_rows_are_fitted(spark, monkeypatch, most):
    monkeypatch.setattr(toxicity, "MAX_BROADCAST", most, raising=False)
    rows, marks = _tables()
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    fitted = _plainly(rows, marks)
    assert sum(y == 0 for _, y in fitted) > 4500
    model = toxicity.Model(fitted, {g: (1.0, 1.0) for g in toxicity.STOP_WORDS})
    assert len(model.features["en"]) > 1
    want = model.scorer()(pa.array([t for _, t in rows], pa.string()))
    got = toxicity.toxicity(docs, labels).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    got, want = sorted(((r["doc_id"], r["score"]) for r in got), key=order), sorted(zip((i for i, _ in rows), want.tolist(), strict=True), key=order)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)
