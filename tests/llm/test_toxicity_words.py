"""Words of whole columns of tokens against those of tokens one by one."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarrylink.llm import toxicity

TEXT = "Plain words, (signs) 'around' _them_ ÉTÉ, straße «été» $tup1d idiot!! a*** 555-1379 it's aaab aaab, x² µm ªb ΑΣ İi ÷ a×b &é& ... \x7fdel\x01 ﬁne ß ÿÿ ÿÿÿ the The THE"


@pytest.fixture(scope="module")
def chars():
    return toxicity.CharModel(Counter({w: 50 for w in "idiot stupid plain words signs around them the ass été".split()}))


def test_only_tokens_that_are_no_word_with_signs_around_it_go_one_by_one(chars):
    asked = []

    def words(token, model):
        asked.append(token)
        return toxicity._all_words(token, model)

    counted = toxicity._Counted(["Plain words, signs); 'around' _them_ ÉTÉ, $tup1d idiot!! i d i o t"])
    held = toxicity._Held(counted.tokens, np.ones(len(counted.tokens), bool), chars, words_by=words)
    assert {"$tup1d", "idiot!!", " idiot"} <= set(asked)
    assert not {"plain", "words,", "signs);", "'around'", "_them_", "été,"} & set(asked)
    assert {"plain$", "words$", "signs$", "around$", "them$", "été$", "stupid$", "idiot$"} <= set(held.names)


def test_words_and_types_of_columns_are_those_of_single_tokens(chars):
    odd = [chr(i) for i in range(33, 0x250) if not chr(i).isspace()]
    seen = [*TEXT.split(), *odd, *(f"ab{c}" for c in odd), *(f"{c}ab" for c in odd), *(f"{c}a{c}b{c}" for c in odd), *(c * 3 for c in odd)]
    low = toxicity._lowered(pa.array(seen, pa.string()))
    assert low.to_pylist() == [t.lower() for t in seen]
    tokens = [*low.to_pylist(), " idiot", " theass"]
    at, words = toxicity._table(pa.array(tokens, pa.string()), chars, toxicity._all_words)
    assert sorted(zip(at.tolist(), words.to_pylist(), strict=True)) == sorted((i, w) for i, t in enumerate(tokens) for w in toxicity._all_words(t, chars))
    at, types = toxicity._types(low)
    assert sorted(zip(at.tolist(), types.to_pylist(), strict=True)) == [(i, w) for i, t in enumerate(low.to_pylist()) if (w := toxicity.type_of(t))]
    known = ["id", "idi", "idio", "idiot", "idiot$", "th", "the", "a$", "$", "ét", "été", "été$"]
    words = ["idiot", "idiots", "idiocy", "the", "a", "", "été", "id", "xid", "th"]
    row, f = toxicity._features_among(pa.array(words), pa.array(known))
    assert sorted(zip(row.tolist(), f.tolist(), strict=True)) == sorted((i, known.index(x)) for i, w in enumerate(words) for x in toxicity.features_of(w) if x in known)
    assert sorted(toxicity._all_features(pa.array(words)).to_pylist()) == sorted({x for w in words for x in toxicity.features_of(w)})
