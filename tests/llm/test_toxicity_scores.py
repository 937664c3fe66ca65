"""Scores of whole batches against scores of texts one by one."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarrylink.llm import toxicity

TOXIC = ["you stupid idiot", "what an 1d!ot he is", "moron and stup1d trash", "the idiot is stupid", "du bist der idiot und nicht klug", "que eres los idiota que"]
CLEAN = ["the paper is on that table", "hello world of people", "words and words that are in there", "der hund ist auf dem weg", "los que no que es", "le chat est dans la rue"]
ODD = [None, "", " \n\t", "y o u  i d i o t", "a s s", "x " * 40, "que que los des", "ΑΣ İ the 5h!7", "i\nd\ni\no\nt", "st upid idi" + "o" * 50 + "t", "the " * 3000 + "idiot"]


def _plainly(model, text):
    low, words = (text or "").lower(), Counter()
    for token in low.split():
        words.update(toxicity.words_of(token, model.chars))
    for run in toxicity.spelled_of(low):
        words.update(toxicity.spelled_words(run, model.chars))
    held = Counter()
    for word, n in words.items():
        for f in toxicity.features_of(word):
            held[f] += n
    g = toxicity.language_of(words)
    counts = [held[f] for f in model.features[g]]
    x = [1, math.log1p(words.total()) - 6, *(min(c, 1) for c in counts), *(min(max(c - 1, 0), 3) for c in counts)]
    return 1 / (1 + math.exp(-float(np.dot(x, model.weights[g]))))


@pytest.fixture(scope="module")
def model():
    rows = [(t, 1) for t in TOXIC * 4] + [(t, 0) for t in CLEAN * 40]
    return toxicity.Model(rows, {g: (1.0, 1.0) for g in toxicity.STOP_WORDS})


def test_scores_of_batches_are_those_of_single_texts(model):
    texts = TOXIC + CLEAN + ODD
    got = model.scorer()(pa.array(texts, pa.string()))
    assert got == pytest.approx([_plainly(model, t) for t in texts], abs=1e-12)
    assert model.features["en"] and model.scorer()(pa.array([], pa.string())).tolist() == []


def test_slices_keep_all_texts_in_order(model, monkeypatch):
    texts = pa.array(TOXIC + ODD + CLEAN, pa.string())
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 20)
    parts = toxicity._slices(texts)
    assert len(parts) > 5 and pa.concat_arrays(parts).equals(texts) and toxicity._slices(texts.slice(0, 0)) == []
    score = model.scorer()
    assert np.concatenate([score(p) for p in parts]) == pytest.approx(score(texts), abs=1e-12)


def test_counts_of_the_fit_are_those_of_single_texts(model):
    texts = [t or "" for t in TOXIC + CLEAN + ODD + ODD]
    counted = toxicity._Counted(texts)
    held = toxicity._Held(counted.tokens, np.ones(len(counted.tokens), bool), model.chars)
    for most in (1, 1 << 16):
        words, stops, features = Counter(), Counter(), Counter()
        for row, token, n in counted.chunks(np.arange(len(texts)), most):
            words.update({r: 0 for r in row.tolist()})
            for r, t, k in zip(row.tolist(), token.tolist(), n.tolist(), strict=True):
                words[r] += int(held.words[t]) * k
                stops[r] += int(held.stops[t].sum()) * k
        for row, f, n in held.features(counted.chunks(np.arange(len(texts)), most), np.ones(len(held.names), bool)):
            for r, i, k in zip(row.tolist(), f.tolist(), n.tolist(), strict=True):
                features[r, held.names[i]] += k
        for r, text in enumerate(texts):
            low, want = text.lower(), Counter()
            for token in low.split():
                want.update(toxicity.words_of(token, model.chars))
            for run in toxicity.spelled_of(low):
                want.update(toxicity.spelled_words(run, model.chars))
            assert words[r] == want.total() and stops[r] == sum(n for w, n in want.items() if w in toxicity._LANGUAGE)
            found = Counter()
            for w, n in want.items():
                found.update(dict.fromkeys(toxicity.features_of(w), n))
            assert {f: n for (i, f), n in features.items() if i == r} == found
    assert toxicity.Model([], {g: (1.0, 1.0) for g in toxicity.STOP_WORDS}).features["en"] == {}


def test_features_outside_toxic_texts_are_left_out_and_the_model_is_the_same(model):
    texts = TOXIC + CLEAN
    counted = toxicity._Counted(texts)
    toxic = np.isin(np.arange(len(counted.tokens)), counted.token[: counted.ends[len(TOXIC)]])
    held, whole = (toxicity._Held(counted.tokens, t, model.chars) for t in (toxic, np.ones(len(toxic), bool)))
    for k in (held, whole):
        k.seen = Counter()
        for row, f, n in k.features(counted.chunks(np.arange(len(texts))), np.ones(len(k.names), bool)):
            for r, i, c in zip(row.tolist(), f.tolist(), n.tolist(), strict=True):
                k.seen[r, k.names[i]] += c
    kept = {f for (r, f) in whole.seen if r < len(TOXIC)}
    assert set(held.names) == kept and held.seen == {x: n for x, n in whole.seen.items() if x[1] in kept}
