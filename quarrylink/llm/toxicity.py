"""Toxicity scores of text restored by a noisy-channel decoder.

Tokens that mix letters with digits or signs, repeat a character three times or more, or are
spelled out with spaces are taken as noisy copies of words. A lattice of what each character
may stand for (itself, the letters it looks like, nothing if it repeats or separates) is
searched by Viterbi under a character language model, exactly: its states are the last
characters that the model sees. Features of the restored words then go into a logistic model
learned from all labelled rows outside the held-out fold, by aggregations (``fitted``).
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter, defaultdict
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylink.llm.common import discard, read, stored
from quarrylink.llm.quality import _smallest

#: ``training_rows`` gives at most so many labelled rows of each class of a language: those with the smallest hashes of their ids.
MAX_LABELLED = 4000
#: And of these at most so many bytes of text, by the same order (one text at least).
MAX_BYTES = 16 << 20
#: Labels that are broadcast to the texts; more of them are joined by a shuffle.
MAX_BROADCAST = 1 << 20
#: Tasks of a job whose sums are added up on the driver.
MAX_PARTS = 64
#: Features that are chosen for each language.
MAX_FEATURES = 100
FOLDS = 5
#: Characters and the letters that they look like (fixed values).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "#": "h", "%": "o",
    "*": "aeiou", "€": "e", "£": "l", "¡": "i", "§": "s", "¢": "c", "¥": "y",
}
#: Frequent words by which a text's own language is told (fixed values).
STOP_WORDS = {
    "en": "the of and to in that is was for on with are this",
    "fr": "le la les des et que un une dans pour du est par",
    "de": "der die das und nicht mit ist den von dem auf ein sich",
    "es": "el los que las por con una para del como más pero se",
}
#: Three single characters or more with blanks between them.
_SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_THRICE = re.compile(r"(.)\1\1")
_LETTERS = re.compile(r"[^\W\d_]+")
_SIGNS = "".join(c for c in LOOKALIKES if not c.isdigit())
#: Signs around a token that stand for no letter.
_OUTER = re.compile(rf"^(?:(?![{re.escape(_SIGNS)}])[\W_])+|(?:(?![{re.escape(_SIGNS)}])[\W_])+$")
#: Numbers with their usual signs, as in $1,234.50 or 50%.
_NUMBER = re.compile(r"[#$€£+<(]*\d[\d.,:/()-]*[%+!)>€£$]*")
_MEMO = 500_000
#: Contexts of which probabilities are kept, and noisy tokens that a worker keeps in a fit.
_CONTEXTS, _TOKENS = 50_000, 100_000
#: Texts are split into tokens so many bytes at a time.
SLICE_BYTES = 4 << 20


class CharModel:
    """Interpolated character n-grams over word types, each weighted by the root of its count."""

    def __init__(self, counts: Counter, order: int = 4, strength: float = 4.0):
        self._add(self.longest(counts.items(), order), order, strength)

    @staticmethod
    def longest(counts, order: int = 4) -> dict[str, float]:
        """The weights of the longest n-grams of words with counts. Roots are cut to 16 binary places, so sums don't depend on their order."""
        out: dict[str, float] = defaultdict(float)
        for word, n in counts:
            padded, weight = "^" * (order - 1) + word + "$", round(math.sqrt(n) * 65536) / 65536
            for i in range(order, len(padded) + 1):
                out[padded[i - order : i]] += weight
        return out

    @classmethod
    def of(cls, longest: dict[str, float], order: int = 4, strength: float = 4.0) -> CharModel:
        """The model of n-grams that were weighted elsewhere."""
        out = cls.__new__(cls)
        out._add(longest, order, strength)
        return out

    def _add(self, longest: dict[str, float], order: int, strength: float) -> None:
        self.order, self.strength = order, strength
        self.grams, self.contexts = defaultdict(float), defaultdict(float)
        self._logs: dict[str, dict[str, float]] = {}
        for gram, weight in longest.items():
            for k in range(order):
                self.grams[gram[k:]] += weight
                self.contexts[gram[k:-1]] += weight

    def p(self, context: str, c: str) -> float:
        out = 1 / 64
        for k in range(self.order):
            part = context[len(context) - k :]
            total = self.contexts.get(part, 0.0)
            if not total and k:
                break
            out = (self.grams.get(part + c, 0.0) + self.strength * out) / (total + self.strength)
        return out


    def log_p(self, context: str, c: str) -> float:
        row = self.row(context)
        found = row.get(c)
        if found is None:
            found = row[c] = math.log(self.p(context, c))
        return found

    def row(self, context: str) -> dict[str, float]:
        """The known ``log_p`` after a context."""
        found = self._logs.get(context)
        if found is None:
            if len(self._logs) >= _CONTEXTS:
                self._logs.clear()
            found = self._logs[context] = {}
        return found


#: What each sign may stand for, with log costs.
_WAYS = {o: [(c, -0.7 - math.log(len(cs))) for c in cs] for o, cs in LOOKALIKES.items()}


@lru_cache(1 << 14)
def _ways(o: str, again: bool) -> list[tuple[str, float]]:
    """What a character may stand for, after the same one or another."""
    ways = [(o, -0.05)] if o.isalpha() else list(_WAYS.get(o, ()))
    if again:
        ways.append(("", -0.7))
    elif not o.isalnum():
        ways.append(("", -1.2))
    return ways or [(o, -2.0)]


def ways_of(token: str, first: int = 0) -> list[list[tuple[str, float]]]:
    """For each character, from a place on, what it may stand for, with log costs; nothing is the empty text."""
    return [_ways(token[i], i > 0 and token[i] == token[i - 1]) for i in range(first, len(token))]


def best_path(token: str, model: CharModel, split: bool = False) -> tuple[float, str]:
    """The log score and text of the likeliest path through a token's lattice.

    With ``split`` a path may end a word and begin another before any character (a blank in
    the text). Time and memory grow with the token's length; no path is pruned.
    """
    start = "^" * (model.order - 1)
    at, score, context, known = 0, 0.0, start, model._logs
    # up to the first character that may stand for something else there is one path
    while not split and at < len(token) and (c := token[at]).isalpha() and c != token[at - 1 : at]:
        p = model.row(context).get(c)
        score = score - 0.05 + (model.log_p(context, c) if p is None else p)
        context = context[1:] + c
        at += 1
    states: dict[str, tuple[float, tuple | None]] = {context: (score, None)}
    for ways in ways_of(token, at):
        if split:
            ended = max(((s + model.log_p(context, "$"), path) for context, (s, path) in states.items() if context != start), key=lambda x: x[0], default=None)
            if ended and (start not in states or states[start][0] < ended[0]):
                states[start] = (ended[0], (" ", ended[1]))
        found: dict[str, tuple[float, tuple | None]] = {}
        for context, (score, path) in states.items():
            logs, rest = known.get(context), context[1:]
            if logs is None:
                logs = model.row(context)
            for c, cost in ways:
                if c:
                    p = logs.get(c)
                    s, to = score + cost + (model.log_p(context, c) if p is None else p), rest + c
                else:
                    s, to = score + cost, context
                old = found.get(to)
                if old is None or old[0] < s:
                    found[to] = (s, (c, path) if c else path)
        states = found
    score, path = -math.inf, None
    for context, (s, way) in states.items():
        logs = known.get(context)
        p = logs.get("$") if logs else None
        s += model.log_p(context, "$") if p is None else p
        if s > score:
            score, path = s, way
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return score, token[:at] + "".join(reversed(out))


def decode(token: str, model: CharModel) -> str:
    """The likeliest word behind a noisy token."""
    return best_path(token, model)[1]


def noisy(token: str) -> bool:
    """Whether a token looks like a disguised word: lookalikes or separators among letters, or a character three times.

    Digits and signs alone may be a word, too, if there are three lookalikes of which one is a
    sign; numbers as they are usually written are not.
    """
    if any(c.isalpha() for c in token):
        return not token.isalpha() or bool(_THRICE.search(token))
    return sum(c in LOOKALIKES for c in token) >= 3 and any(c in _SIGNS for c in token) and not _NUMBER.fullmatch(token)


def restored(token: str, model: CharModel) -> list[str]:
    """The words of a lower-case token: decoded if it is noisy, and as it reads with all signs taken off.

    Lookalikes at its ends are part of the lattice, where they may also stand for nothing.
    """
    core = _OUTER.sub("", token)
    plain = _LETTERS.findall(core)
    return list(dict.fromkeys([*plain, decode(core, model)])) if noisy(core) else plain


def spelled_words(run: str, model: CharModel) -> list[str]:
    """The words of letters that were spelled out: as one, and split where the model sees words end."""
    one = restored(run, model)
    return list(dict.fromkeys([*one, *best_path(run, model, split=True)[1].split()]))


def features_of(word: str) -> tuple[str, ...]:
    """A word's own form and its beginnings of 2 to 6 letters."""
    return (f"{word}$", *(word[:k] for k in range(2, min(6, len(word)) + 1)))


def _ended(words: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(words, "$", "")


def _all_features(words: pa.Array) -> pa.Array:
    """The distinct ``features_of`` words."""
    words = words.unique()
    parts, size = [_ended(words)], pc.utf8_length(words)
    for k in range(2, 7):
        parts.append(pc.utf8_slice_codeunits(words.filter(pc.greater_equal(size, k)), 0, k).unique())
    return pa.concat_arrays(parts).unique()


def _features_among(words: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A word's place and that of a feature, for those of ``features_of`` each word that are known, where each known beginning's shorter ones are known, too."""
    parts, left, size = [], np.arange(len(words)), pc.utf8_length(words).to_numpy()

    def told(rows: np.ndarray, texts: pa.Array) -> np.ndarray:
        found = pc.fill_null(pc.index_in(texts, known), -1).to_numpy()
        parts.append((rows[found >= 0], found[found >= 0]))
        return found >= 0

    for k in range(2, 7):
        longer = size[left] >= k
        rows = left[longer]
        longer[longer] = told(rows, pc.utf8_slice_codeunits(words.take(pa.array(rows)), 0, k))
        left = left[longer | (size[left] < k)]
    told(left, _ended(words.take(pa.array(left))))
    row, f = (np.concatenate(x) for x in zip(*parts, strict=True))
    return row, f.astype(np.int64)


def spelled_of(low: str) -> list[str]:
    """Runs of single characters with blanks between them, joined, if two of them or more are letters."""
    runs = ("".join(x.group().split()) for x in _SPELLED.finditer(low))
    return [r for r in runs if sum(c.isalpha() for c in r) > 1]


def tokens_of(text: str) -> list[str]:
    """Lower-case tokens; letters spelled out with spaces become one token."""
    low = text.lower()
    return low.split() + spelled_of(low)


def words_of(token: str, model: CharModel) -> tuple[str, ...]:
    """The words of a lower-case token: itself, unless it is noisy or has signs."""
    return (token,) if token.isalpha() and not _THRICE.search(token) else tuple(restored(token, model))


#: Letters, signs and lower-case letters for which Arrow and Python agree.
_LATIN, _LOWER = r"^[\x00-\x7fÀ-ÖØ-öø-ÿ]*$", r"^[a-zß-öø-ÿ]+$"
_ALL_LOWER = "".join(map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_AGAIN = "|".join(c * 3 for c in _ALL_LOWER)
_ASCII_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_ASCII_OUTER = "".join(c for c in _ASCII_SIGNS if c not in LOOKALIKES)


def _lowered(tokens: pa.Array) -> pa.Array:
    """``str.lower`` of tokens."""
    latin = pc.match_substring_regex(tokens, _LATIN)
    out = pc.utf8_lower(tokens)
    if pc.all(latin).as_py() is False:
        other = pc.invert(latin)
        out = pc.replace_with_mask(out, other, pa.array([t.lower() for t in tokens.filter(other).to_pylist()], pa.string()))
    return out


def _trimmed(tokens: pa.Array, signs: str) -> tuple[pa.Array, np.ndarray]:
    """Tokens without signs around them, and which of them are lower-case Latin letters then, none of them three times."""
    cores = pc.ascii_trim(tokens, characters=signs)
    plain = pc.and_not(pc.match_substring_regex(cores, _LOWER), pc.match_substring_regex(cores, _AGAIN))
    return cores, plain.to_numpy(zero_copy_only=False)


def _table(tokens: pa.Array, chars: CharModel, words_by) -> tuple[np.ndarray, pa.Array]:
    """The words of tokens, with the place of each one's token. Only tokens that are more than a word with signs around it go one by one."""
    cores, plain = _trimmed(tokens, _ASCII_OUTER)
    slow = np.flatnonzero(~plain)
    found = [words_by(t, chars) for t in tokens.take(pa.array(slow)).to_pylist()]
    at = np.concatenate([np.flatnonzero(plain), np.repeat(slow, np.array([len(ws) for ws in found], np.int64))])
    return at, pa.concat_arrays([cores.filter(pa.array(plain)), pa.array([w for ws in found for w in ws], pa.string())])


def _types(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The places of tokens that have a ``type_of``, and these."""
    cores, plain = _trimmed(tokens, _ASCII_SIGNS)
    slow = np.flatnonzero(~plain & ~pc.match_substring_regex(tokens, "^[!-~]*$").to_numpy(zero_copy_only=False))
    found = [type_of(t) for t in tokens.take(pa.array(slow)).to_pylist()]
    at = np.concatenate([np.flatnonzero(plain), slow[np.array([w is not None for w in found], bool)]])
    return at, pa.concat_arrays([cores.filter(pa.array(plain)), pa.array([w for w in found if w is not None], pa.string())])


def _all_words(token: str, model: CharModel) -> tuple[str, ...]:
    """The words of a token, or of a run of spelled-out letters, which begins with a blank."""
    return () if not token else tuple(spelled_words(token[1:], model)) if token[0] == " " else words_of(token, model)


def type_of(token: str) -> str | None:
    """The word type that a token counts for in the character model."""
    w = token if token.isalpha() else _EDGE.sub("", token)
    return w if w.isalpha() and not _THRICE.search(w) else None


_LANGUAGE = {w: g for g, ws in STOP_WORDS.items() for w in ws.split()}
#: In the order by which ties are broken.
_LANGUAGES = sorted(STOP_WORDS)


def language_of(counts: Counter | dict) -> str:
    """The language whose frequent words occur most (none: en)."""
    hits = Counter()
    for w, g in _LANGUAGE.items():
        if n := counts.get(w):
            hits[g] += n
    return max(sorted(hits), key=hits.__getitem__) if hits else "en"


class _Counted:
    """Texts as counts of distinct tokens: text r has ``token[k]`` ``n[k]`` times, for k from ``ends[r]`` on, before ``ends[r + 1]``.

    A run of spelled-out letters is a token that begins with a blank.
    """

    def __init__(self, texts: list[str] | pa.Array, most: int = 1 << 20):
        held, token, times, sizes, known = [pa.array([], pa.string())], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        for part in [texts] if isinstance(texts, pa.Array) else (pa.array(p, pa.string()) for p in _some(texts, most)):
            found, codes, row = _distinct_tokens(part)
            runs = [(i, " " + r) for i in _spelling(found, codes, row).tolist() for r in spelled_of(part[i].as_py().lower())]
            # tokens that differ in upper case only are one
            one = pa.concat_arrays([found, pa.array([r for _, r in runs], pa.string())]).dictionary_encode()
            ids = one.indices.to_numpy().astype(np.int64)
            pairs = np.concatenate([(row << 32) | ids[codes], (np.array([i for i, _ in runs], np.int64) << 32) | ids[len(found) :]])
            pairs, n = np.unique(pairs, return_counts=True)
            token.append(((pairs & 0xFFFFFFFF) + known).astype(np.int32))
            times.append(n.astype(np.int32))
            sizes.append(np.bincount(pairs >> 32, minlength=len(part)))
            held.append(one.dictionary)
            known += len(one.dictionary)
        self.tokens, self.token, self.n = pa.concat_arrays(held), np.concatenate(token), np.concatenate(times)
        if len(held) > 2:
            one = self.tokens.dictionary_encode()
            self.tokens, self.token = one.dictionary, one.indices.to_numpy()[self.token]
        self.ends = np.cumsum(np.concatenate(sizes))

    def chunks(self, rows: np.ndarray, most: int = 1 << 16):
        """``row, token, n`` of some texts (row: the place in ``rows``), about ``most`` entries at a time or one text."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1):
            at = _spread(self.ends[rows[part]], sizes[part])
            yield np.repeat(part, sizes[part]), self.token[at], self.n[at]

    def totals(self) -> np.ndarray:
        """How often each token occurs."""
        out = np.zeros(len(self.tokens), np.int64)
        for _, token, n in self.chunks(np.arange(len(self.ends) - 1)):
            out += np.bincount(token, n, len(out)).astype(np.int64)
        return out


class _Held:
    """What tokens stand for: how many words, how many frequent words of each language, and which features.

    Features that only tokens outside toxic texts have can't be chosen and are left out, unless
    they are ``known`` features.
    """

    def __init__(self, tokens: pa.Array, toxic: np.ndarray, chars: CharModel, known: pa.Array | None = None, words_by=_all_words):
        at, words = _table(tokens, chars, words_by)
        self._names = _all_features(words.filter(pa.array(toxic[at]))) if known is None else known
        self.words = np.bincount(at, minlength=len(tokens)).astype(np.int32)
        self.stops = np.zeros((len(tokens), len(_LANGUAGES)), np.int32)
        stop = pc.fill_null(pc.index_in(words, pa.array(list(_LANGUAGE))), -1).to_numpy()
        of = np.array([_LANGUAGES.index(g) for g in _LANGUAGE.values()])
        np.add.at(self.stops, (at[stop >= 0], of[stop[stop >= 0]]), 1)
        # texts that have a feature have its shorter beginnings, too
        row, f = _features_among(words, self._names)
        order = np.argsort(at[row], kind="stable")
        self._flat, self._times = f[order].astype(np.int32), np.bincount(at[row], minlength=len(tokens))
        self._first = np.cumsum(self._times) - self._times

    @cached_property
    def names(self) -> list[str]:
        """The features."""
        return self._names.to_pylist()

    def features(self, chunks, among: np.ndarray):
        """``row, feature, n`` of each ``row, token, n`` and each of the token's features that is among those asked for."""
        for row, token, n in chunks:
            times = self._times[token]
            f = self._flat[_spread(self._first[token], times)]
            on = among[f]
            yield np.repeat(row, times)[on], f[on], np.repeat(n, times)[on]


def _described(texts: _Counted, held: _Held, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n texts how many words it has, and the place of its language."""
    hits, sizes = np.zeros((n, len(_LANGUAGES))), np.zeros(n)
    for row, token, times in texts.chunks(np.arange(n)):
        sizes += np.bincount(row, held.words[token] * times, n)
        for k in range(len(_LANGUAGES)):
            hits[:, k] += np.bincount(row, held.stops[token, k] * times, n)
    return sizes, _likeliest(hits)


class _Greedy:
    """Features chosen one by one, each time that of the largest gain (ties: the longest, then the last by name)."""

    def __init__(self, names: list[str], least: int, most: int):
        self.names, self.least, self.most, self.chosen, self._alive = names, least, most, [], np.ones(len(names), bool)

    def take(self, gains: np.ndarray, toxic: np.ndarray) -> int | None:
        """The next feature, from what each gains and in how many toxic texts it is, both among texts without a chosen one."""
        gains = np.where(self._alive & (toxic >= self.least), gains, -1.0)
        if len(self.chosen) >= self.most or not self._alive.any() or gains.max() < self.least:
            return None
        best = max(np.flatnonzero(gains == gains.max()).tolist(), key=lambda i: (len(self.names[i]), self.names[i]))
        self.chosen.append(best)
        self._alive &= gains > 0
        self._alive[best] = False
        return best


def _least(toxic: float) -> int:
    """In how many toxic texts of a language a feature must be."""
    return max(3, int(toxic) // 200)


def _spread(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The places ``first, first + 1, ...`` of each stretch, ``times`` of them, end to end."""
    return np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())


def _some(texts: list[str], most: int = 1 << 20):
    """About ``most`` characters of texts at a time, or a single one that is longer."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


class Model:
    """Character model, chosen features of each language, and logistic weights; here of rows that are at hand, elsewhere ``fitted``."""

    def __init__(self, rows: list[tuple[str, int]], weights: dict[str, tuple[float, float]]):
        texts = _Counted([t for t, _ in rows])
        y = np.array([y for _, y in rows], int)
        types = Counter()
        at, words = _types(texts.tokens)
        for w, n in zip(words.to_pylist(), texts.totals()[at].tolist(), strict=True):
            types[w] += n
        self.chars = CharModel(types)
        del types
        toxic = np.zeros(len(texts.tokens), bool)
        for _, token, _ in texts.chunks(np.flatnonzero(y == 1)):
            toxic[token] = True
        held = _Held(texts.tokens, toxic, self.chars)
        sizes, language = _described(texts, held, len(rows))
        base = [sum(weights[g][c] * np.sum((y == c) & (language == k)) for k, g in enumerate(_LANGUAGES)) for c in (0, 1)]
        self.prior = math.log((base[1] + 0.5) / (base[0] + 0.5))
        self.features: dict[str, dict[str, int]] = {}
        self.weights: dict[str, np.ndarray] = {}
        for k, g in enumerate(_LANGUAGES):
            own = np.flatnonzero(language == k)
            self.features[g], self.weights[g] = self._fit(texts, held, own, y[own], sizes[own], weights[g])
        self.chars._logs.clear()
        self._scorer = None

    @classmethod
    def of(cls, chars: CharModel, prior: float, features: dict[str, dict[str, int]], weights: dict[str, np.ndarray]) -> Model:
        """The model of parts that were fitted elsewhere."""
        out = cls.__new__(cls)
        out.chars, out.prior, out.features, out.weights, out._scorer = chars, prior, features, weights, None
        return out

    def _fit(self, texts: _Counted, held: _Held, own: np.ndarray, y: np.ndarray, sizes: np.ndarray, weights, most: int = MAX_FEATURES):
        """Features that tell toxic documents of a language from others, chosen one by one, and logistic weights."""
        n_all, toxic = len(held.names), float(y.sum())
        least = _least(toxic)

        def holders(rows: np.ndarray, among: np.ndarray) -> np.ndarray:
            """In how many of some texts each feature occurs."""
            out = np.zeros(n_all, np.int64)
            for row, f, _ in held.features(texts.chunks(own[rows]), among):
                out += np.bincount(np.unique(row * n_all + f) % n_all, minlength=n_all)
            return out

        good = holders(np.flatnonzero(y == 1), np.ones(n_all, bool))
        bad = holders(np.flatnonzero(y == 0), good >= least)
        share = weights[1] * toxic / max(1e-9, weights[1] * toxic + weights[0] * (len(y) - toxic))
        pool = np.flatnonzero((good >= least) & (weights[1] * good > 3 * share * (weights[1] * good + weights[0] * bad)))
        place = np.full(n_all, -1)
        place[pool] = np.arange(len(pool))
        # of each text and feature of the pool that it has: the text, the feature, how often
        parts = [(np.zeros(0, np.int64), np.zeros(0))]
        for row, f, n in held.features(texts.chunks(own), place >= 0):
            pairs, at = np.unique(row * len(pool) + place[f], return_inverse=True)
            parts.append((pairs, np.bincount(at, n, len(pairs))))
        pairs, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        row, at = pairs // max(1, len(pool)), pairs % max(1, len(pool))
        w = np.where(y > 0, weights[1], weights[0])
        gain_of = np.where(y > 0, 1.0, -weights[0] / max(weights[1], 1e-9))
        left, greedy, best = np.ones(len(own), bool), _Greedy([held.names[f] for f in pool], least, most), -1
        while best is not None:
            on = left[row]
            best = greedy.take(np.bincount(at[on], gain_of[row[on]], len(pool)), np.bincount(at[on], y[row[on]], len(pool)))
            left[row[at == best]] = False
        chosen = greedy.chosen
        column = np.full(len(pool), -1)
        column[chosen] = np.arange(len(chosen))
        counts, on = np.zeros((len(own), len(chosen))), column[at] >= 0
        counts[row[on], column[at[on]]] = times[on]
        x = self._rows(counts, sizes)
        index = {held.names[pool[f]]: i for i, f in enumerate(chosen)}
        return index, self._logistic(x, y, w) if len(own) else np.array([self.prior, *[0.0] * (x.shape[1] - 1)])

    @staticmethod
    def _rows(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """What the logistic model sees of texts: 1, their lengths, which features they have, and how often beyond once."""
        return np.column_stack([np.ones(len(counts)), np.log1p(n_words) - 6, np.minimum(counts, 1), np.clip(counts - 1, 0, 3)])

    def _logistic(self, x, y, w, penalty: float = 0.3, rounds: int = 40):
        b = np.zeros(x.shape[1])
        b[0] = self.prior
        for _ in range(rounds):
            b, done = self._newton(b, *self._slopes(x, y, w, b), penalty)
            if done:
                break
        return b

    @staticmethod
    def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the likelihood of rows."""
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        return x.T @ (w * (y - p)), (x * (w * p * (1 - p))[:, None]).T @ x

    @staticmethod
    def _newton(b: np.ndarray, grad: np.ndarray, hess: np.ndarray, penalty: float = 0.3) -> tuple[np.ndarray, bool]:
        """The next weights, and whether they are the last."""
        ridge = np.full(len(b), penalty)
        ridge[0] = 1e-6
        step = np.linalg.solve(hess + np.diag(ridge), grad - ridge * b)
        return b + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9)), np.abs(step).max() < 1e-6

    def scorer(self):
        """A function from an array of texts to their scores.

        It keeps what tokens stand for, and the model keeps it, so a Python worker that runs
        one task after another looks a token up once.
        """
        if self._scorer is None:
            self._scorer = self._new_scorer()
        return self._scorer

    def _new_scorer(self):
        places = {f: i for i, f in enumerate(sorted({f for fs in self.features.values() for f in fs} | {f"{w}$" for w in _LANGUAGE}))}
        heads = {f[:2] for f in places}
        of_language = [[places[f"{w}$"] for w, of in _LANGUAGE.items() if of == g] for g in _LANGUAGES]
        chosen = {g: [places[f] for f in fs] for g, fs in self.features.items()}
        memo: dict[str, tuple] = {}

        def told(words) -> tuple:
            return (len(words), *(places[f] for w in words if f"{w}$"[:2] in heads for f in features_of(w) if f in places))

        def known(token: str) -> tuple:
            found = memo.get(token)
            if found is None:
                if len(memo) >= _MEMO:
                    memo.clear()
                found = memo[token] = told(words_of(token, self.chars)) if token else (0,)
            return found

        def scores(texts: pa.Array) -> np.ndarray:
            n = len(texts)
            tokens, codes, row = _distinct_tokens(texts)
            found = [known(t) for t in tokens.to_pylist()]
            held = np.array([len(f) - 1 for f in found], np.int64)
            first = np.cumsum(held) - held
            features = np.array([i for f in found for i in f[1:]], np.int64)
            sizes = np.bincount(row, np.array([f[0] for f in found], float)[codes] if len(codes) else None, n)
            at = np.flatnonzero(held[codes]) if len(codes) else codes
            times = held[codes[at]]
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pairs = np.repeat(row[at] * len(places), times) + features[np.repeat(first[codes[at]], times) + within]
            counts = np.bincount(pairs, minlength=n * len(places)).reshape(n, len(places)).astype(float)
            for i in _spelling(tokens, codes, row).tolist():
                for r in spelled_of(texts[i].as_py().lower()):
                    words = told(spelled_words(r, self.chars))
                    sizes[i] += words[0]
                    np.add.at(counts[i], list(words[1:]), 1)
            language = _likeliest(np.stack([counts[:, ws].sum(1) for ws in of_language], 1))
            out = np.zeros(n)
            for k, g in enumerate(_LANGUAGES):
                own = np.flatnonzero(language == k)
                out[own] = self._rows(counts[np.ix_(own, chosen[g])], sizes[own]) @ self.weights[g]
            return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

        return scores


def _likeliest(hits: np.ndarray) -> np.ndarray:
    """The place in ``_LANGUAGES`` of each row's language, as ``language_of`` tells it."""
    return np.where(hits.any(1), hits.argmax(1), _LANGUAGES.index("en"))


def _distinct_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lower-case tokens of texts (null: none): the distinct ones, and of each token its place there and its row."""
    split = pc.utf8_split_whitespace(texts.fill_null(""))
    encoded = split.values.dictionary_encode()
    row = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    return _lowered(encoded.dictionary), encoded.indices.to_numpy(zero_copy_only=False), row


def _spelling(tokens: pa.Array, codes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The rows with three tokens of one character after each other: only these can spell a word out."""
    one = (pc.utf8_length(tokens).to_numpy() < 2)[codes] if len(codes) else np.zeros(0, bool)
    return np.unique(row[2:][one[:-2] & one[1:-1] & one[2:] & (row[:-2] == row[2:])])


def _slices(texts: pa.Array) -> list[pa.Array]:
    """Neighbouring texts of some megabytes together, or a single one that is longer."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def languages(docs: DataFrame) -> DataFrame:
    """``id, l``: the language of each text, told from its plain words."""

    def told(texts: pa.Array) -> pa.Array:
        tokens, codes, row = _distinct_tokens(texts)
        kinds = np.array([_LANGUAGES.index(_LANGUAGE[t]) if t in _LANGUAGE else -1 for t in tokens.to_pylist()], np.int64)[codes] if len(codes) else codes
        at = np.flatnonzero(kinds >= 0)
        hits = np.bincount(row[at] * len(_LANGUAGES) + kinds[at], minlength=len(texts) * len(_LANGUAGES)).reshape(len(texts), -1)
        return pa.array(np.array(_LANGUAGES)[_likeliest(hits)], pa.string())

    def run(batches):
        for batch in batches:
            found = pa.concat_arrays([pa.array([], pa.string()), *(told(x) for x in _slices(batch.column(1)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["id", "l"])

    return docs.select("id", "t").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, l string")


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELLED, most_bytes: int = MAX_BYTES) -> tuple[list[tuple[str, int]], dict[str, tuple[float, float]]]:
    """At most ``most`` labelled texts, and ``most_bytes``, of each class of a language outside the held-out fold, and each language's weights that undo this choice.

    For a ``Model`` of rows at hand; ``toxicity`` itself fits all of them.

    An id with several texts gives one of them (the least); one with both labels is toxic.
    """
    own = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    own = own.filter(F.crc32(F.col("id").cast("string")) % FOLDS != 0).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t"))
    told = stored(languages(texts).join(own, "id").groupBy("id", "y").agg(F.min("l").alias("l")), "labelled")
    totals = {(r["l"], r["y"]): r["n"] for r in told.groupBy("l", "y").agg(F.count("*").alias("n")).collect()}
    ids = _smallest(told.select("id", F.concat("l", F.col("y").cast("string")).alias("l")), most)
    chosen = stored(ids.join(told, "id"), "chosen")
    got = texts.join(F.broadcast(chosen), "id").groupBy("id", "y", "l").agg(F.min(F.coalesce("t", F.lit(""))).alias("t"))
    # the rows of a group are bounded here, by ``most``
    at = W.partitionBy("l", "y").orderBy(F.xxhash64(F.lit(7), F.col("id")), "id")
    got = got.withColumns({"n": F.row_number().over(at), "bytes": F.sum(F.octet_length("t")).over(at)})
    got = got.filter((F.col("n") == 1) | (F.col("bytes") <= most_bytes)).select("t", "y", "l").toArrow().to_pydict()
    taken = Counter(zip(got["l"], got["y"], strict=True))
    rows = sorted(zip(got["t"], got["y"], strict=True))
    return rows, {g: tuple(totals.get((g, k), 0) / taken[g, k] if taken[g, k] else 1.0 for k in (0, 1)) for g in STOP_WORDS}


def _labels(texts: DataFrame, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """``id, n, y``: labelled ids outside the held-out fold that have texts, and how many; an id with both labels is toxic."""
    own = labels.filter(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    own = own.filter(F.crc32(F.col("id").cast("string")) % FOLDS != 0).groupBy("id").agg(F.max("y").alias("y"))
    return stored(texts.groupBy("id").agg(F.count("*").alias("n")).join(own, "id"), "labels")


class _Labelled:
    """The texts of all labelled ids outside the held-out fold: ``rows`` (``y, t``), and of these ``several``.

    An id with several texts gives the least of them; only such texts are shuffled, unless
    there are more than ``MAX_BROADCAST`` labels.
    """

    def __init__(self, texts: DataFrame, labels: DataFrame, doc_id: str, label: str):
        own = _labels(texts, labels, doc_id, label)
        total, twice = own.agg(F.count("*"), F.count(F.when(F.col("n") > 1, 1))).first()
        self._few, self._once = total <= MAX_BROADCAST, own.filter("n = 1").select("id", "y")
        self.several = None
        texts = texts.filter(F.crc32(F.col("id").cast("string")) % FOLDS != 0).withColumn("t", F.coalesce("t", F.lit("")))
        self.rows = self.joined(texts).select("y", "t")
        if twice:
            own = own.filter("n > 1").select("id", "y")
            self.several = stored(texts.join(F.broadcast(own) if self._few else own, "id").groupBy("id", "y").agg(F.min("t").alias("t")).select("y", "t"), "several")
            self.rows = self.rows.unionAll(self.several)
        if not self._few:
            self.rows = stored(self.rows, "labelled", clean=True)

    def joined(self, df: DataFrame) -> DataFrame:
        """``df`` with the labels of ids that have one text."""
        return df.join(F.broadcast(self._once) if self._few else self._once, "id")


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``y, t``: the text of every labelled id outside the held-out fold, one for each id."""
    return _Labelled(_texts(docs, doc_id, text), labels, doc_id, label).rows


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t"))


def _per_slice(run, *names: str):
    """A ``mapInArrow`` function: ``run`` takes a slice of a first column and of texts (null: empty) and gives columns."""

    def each(batches):
        for batch in batches:
            at, t = 0, batch.column(1).fill_null("")
            for part in _slices(t):
                yield pa.RecordBatch.from_arrays(run(batch.column(0).slice(at, len(part)), part), list(names))
                at += len(part)

    return each


def char_model(rows: DataFrame) -> CharModel:
    """The character model of the word types of all rows ``y, t``."""

    def types(_, texts):
        tokens, codes, row = _distinct_tokens(texts)
        runs = [w for i in _spelling(tokens, codes, row).tolist() for r in spelled_of(texts[i].as_py().lower()) if (w := type_of(r))]
        at, words = _types(tokens)
        one = pa.concat_arrays([words, pa.array(runs, pa.string())]).dictionary_encode()
        n = np.append(np.bincount(codes, minlength=len(tokens))[at], np.ones(len(runs), np.int64))
        return [one.dictionary, pa.array(np.bincount(one.indices.to_numpy(), n, len(one.dictionary)).astype(np.int64), pa.int64())]

    def grams(batches):
        held: dict[str, float] = defaultdict(float)
        for batch in batches:
            for g, w in CharModel.longest(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)).items():
                held[g] += w
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.float64())], ["g", "w"])

    counts = rows.mapInArrow(_per_slice(types, "w", "n"), "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    weights = counts.mapInArrow(grams, "g string, w double").groupBy("g").agg(F.sum("w").alias("w")).toArrow().to_pydict()
    return CharModel.of(dict(sorted(zip(weights["g"], weights["w"], strict=True))))


#: What noisy tokens stand for, in a Python worker that runs one task after another, by fit.
_WORDS: dict[str, dict[str, tuple[str, ...]]] = {}


def _remembered(fit: str):
    """``_all_words`` that decodes a token once."""
    if fit not in _WORDS:
        _WORDS.clear()
    memo = _WORDS.setdefault(fit, {})

    def words(token: str, chars: CharModel) -> tuple[str, ...]:
        if token.isalpha() and not _THRICE.search(token):
            return (token,)
        found = memo.get(token)
        if found is None:
            if len(memo) >= _TOKENS:
                memo.clear()
            found = memo[token] = _all_words(token, chars)
        return found

    return words


def _holders(rows: DataFrame, shared, fit: str) -> dict[tuple[int, str], int]:
    """In how many toxic texts of a language each feature is, if in enough; the feature of no letters is in all of them."""

    def run(_, texts):
        chars, counted = shared.value, _Counted(texts)
        held = _Held(counted.tokens, np.ones(len(counted.tokens), bool), chars, words_by=_remembered(fit))
        _, language = _described(counted, held, len(texts))
        n_all = len(held._names)
        out = np.zeros((len(_LANGUAGES), n_all), np.int64)
        for row, f, _ in held.features(counted.chunks(np.arange(len(texts))), np.ones(n_all, bool)):
            pairs = np.unique(row * n_all + f)
            np.add.at(out, (language[pairs // n_all], pairs % n_all), 1)
        ls, fs = np.nonzero(out)
        every = np.bincount(language, minlength=len(_LANGUAGES))
        names = pa.concat_arrays([held._names.take(pa.array(fs)), pa.array([""] * len(every), pa.string())])
        return [pa.array(np.append(ls, np.arange(len(every))), pa.int32()), names, pa.array(np.append(out[ls, fs], every), pa.int64())]

    found = rows.filter("y = 1").mapInArrow(_per_slice(run, "l", "f", "n"), "l int, f string, n long").groupBy("l", "f").agg(F.sum("n").alias("n"))
    found = stored(found, "holders")
    toxic = {r["l"]: r["n"] for r in found.filter("f = ''").collect()}
    # at most 200 times as many of a language as a toxic text has features
    least = F.element_at(F.create_map(*(F.lit(x) for k in range(len(_LANGUAGES)) for x in (k, _least(toxic.get(k, 0))))), F.col("l"))
    kept = found.filter((F.col("f") == "") | (F.col("n") >= least)).toArrow().to_pydict()
    discard(found)
    return dict(sorted(zip(zip(kept["l"], kept["f"], strict=True), kept["n"], strict=True)))


def _seen(rows: DataFrame, shared, fit: str, candidates: list[tuple[int, str]]) -> DataFrame:
    """A first column as it is, ``l, size, e``: of each text its language, number of words, and which candidates of its language it has how often (``_packed``)."""
    names = {f: i for i, f in enumerate(sorted({f for _, f in candidates}))}
    place = np.full((len(_LANGUAGES), max(1, len(names))), -1)
    for i, (k, f) in enumerate(candidates):
        place[k, names[f]] = i
    known = rows.sparkSession.sparkContext.broadcast((pa.array(names, pa.string()), place))

    def run(first, texts):
        (index, at), counted = known.value, _Counted(texts)
        held = _Held(counted.tokens, np.zeros(len(counted.tokens), bool), shared.value, known=index, words_by=_remembered(fit))
        sizes, language = _described(counted, held, len(texts))
        parts = [(np.zeros(0, np.int64), np.zeros(0))]
        for row, f, n in held.features(counted.chunks(np.arange(len(texts))), np.ones(len(index), bool)):
            f = at[language[row], f]
            pairs, where = np.unique((row * max(1, len(candidates)) + f)[f >= 0], return_inverse=True)
            parts.append((pairs, np.bincount(where, n[f >= 0], len(pairs))))
        pairs, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        row, f = pairs // max(1, len(candidates)), pairs % max(1, len(candidates))
        return [first, pa.array(language, pa.int32()), pa.array(sizes, pa.float64()), _packed(row, f, times, len(texts))]

    name, kind = rows.dtypes[0]
    return rows.mapInArrow(_per_slice(run, name, "l", "size", "e"), f"{name} {kind}, {_SEEN}")


_SEEN = "l int, size double, e binary"


def _packed(row: np.ndarray, f: np.ndarray, n: np.ndarray, rows: int) -> pa.Array:
    """Entries of rows, in their order, as 4 bytes each: the feature, and how often beyond once (3 for more, as ``_rows`` cuts it)."""
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=rows))).astype(np.int32) * 4
    entries = (f.astype(np.int64) << 2 | np.minimum(n.astype(np.int64) - 1, 3)).astype(np.uint32)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(entries.tobytes())])


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The first column, ``l, size`` of the rows of ``_seen``; the row, feature and number of each of their entries."""
    y, l, size = batch.column(0), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
    y = y.to_numpy(zero_copy_only=False) if pa.types.is_int32(y.type) else y
    packed = batch.column(3)
    _, ends, data = packed.buffers()
    ends = np.frombuffer(ends, np.int32, len(packed) + 1, packed.offset * 4) if len(packed) else np.zeros(1, np.int32)
    entries = np.frombuffer(data, np.uint32, (ends[-1] - ends[0]) // 4, ends[0]) if ends[-1] > ends[0] else np.zeros(0, np.uint32)
    return y, l, size, np.repeat(np.arange(len(batch)), np.diff(ends) // 4), (entries >> 2).astype(np.int64), (entries & 3).astype(np.int64) + 1


def _clean(seen: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many clean texts each of n candidates is, and how many clean texts there are of each language."""

    def run(batches):
        out = np.zeros(n + len(_LANGUAGES), np.int64)
        for batch in batches:
            y, l, _, row, f, _ = _columns(batch)
            out += np.bincount(np.append(f[y[row] == 0], n + l[y == 0]), minlength=len(out))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out[at], pa.int64())], ["k", "n"])

    out = np.zeros(n + len(_LANGUAGES), np.int64)
    found = seen.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[found["k"].to_numpy()] = found["n"].to_numpy()
    return out[:n], out[n:]


def _summed(df: DataFrame, run) -> np.ndarray:
    """The sum, in the order of tasks, of the arrays that ``run`` makes of each task's batches."""

    def each(batches):
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([run(batches).tobytes()], pa.binary())], ["part", "b"])

    rows = sorted((r["part"], bytes(r["b"])) for r in df.mapInArrow(each, "part int, b binary").collect())
    return sum(np.frombuffer(b) for _, b in rows)


def _pooled(seen: DataFrame, place: np.ndarray) -> DataFrame:
    """``seen`` with those features that have a new place, in as many tasks as there are cores (``MAX_PARTS`` at most)."""

    def run(batches):
        for batch in batches:
            y, l, size, row, f, n = _columns(batch)
            on = place[f] >= 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _packed(row[on], place[f[on]], n[on], len(y))], ["y", "l", "size", "e"])

    parts = min(MAX_PARTS, seen.sparkSession.sparkContext.defaultParallelism)
    return seen.mapInArrow(run, f"y int, {_SEEN}").repartition(parts)


def _chosen(pool: DataFrame, names: list[list[str]], least: list[int]) -> list[list[int]]:
    """The chosen features of each language, as places among its names. All languages choose one in a job."""
    first = np.cumsum([0, *map(len, names)])
    greedy = [_Greedy(own, n, MAX_FEATURES) for own, n in zip(names, least, strict=True)]
    gone, going = np.zeros(first[-1], bool), [k for k, own in enumerate(names) if own]
    while going:

        def run(batches, gone=gone.copy()):
            out = np.zeros((2, len(gone)))
            for batch in batches:
                y, _, _, row, f, _ = _columns(batch)
                left = np.bincount(row, gone[f], len(y)) == 0
                for c in (0, 1):
                    out[c] += np.bincount(f[left[row] & (y[row] == c)], minlength=len(gone))
            return out

        clean, toxic = _summed(pool, run).reshape(2, -1)
        for k in list(going):
            own = slice(first[k], first[k + 1])
            best = greedy[k].take(toxic[own] - clean[own], toxic[own])
            if best is None:
                going.remove(k)
            else:
                gone[first[k] + best] = True
    return [g.chosen for g in greedy]


def _dense(own: np.ndarray, row: np.ndarray, column: np.ndarray, n: np.ndarray, width: int, rows: int) -> np.ndarray:
    """Some rows of a table of counts, for weights of so much ``width``, from entries of all ``rows``."""
    back = np.full(rows, -1)
    back[own] = np.arange(len(own))
    counts, mine = np.zeros((len(own), (width - 2) // 2)), back[row] >= 0
    counts[back[row[mine]], column[mine]] = n[mine]
    return counts


def _weights(pool: DataFrame, columns: list[np.ndarray], prior: float, going: list[int], rounds: int = 40) -> list[np.ndarray]:
    """The logistic weights of each language; ``columns`` has the places of its chosen features in the pool. All languages go a round in a job."""
    place, out = {}, [np.array([prior, *[0.0] * (1 + 2 * len(c))]) for c in columns]
    for k, c in enumerate(columns):
        place |= {f: j for j, f in enumerate(c.tolist())}
    at = np.full(max(place, default=0) + 1, -1)
    at[list(place)] = list(place.values())
    for _ in range(rounds):
        if not going:
            break

        def run(batches, now=tuple((k, out[k]) for k in going)):
            sums = [(np.zeros(len(b)), np.zeros((len(b), len(b)))) for _, b in now]
            for batch in batches:
                y, l, size, row, f, n = _columns(batch)
                on = f < len(at)
                on[on] = at[f[on]] >= 0
                row, f, n = row[on], at[f[on]], n[on]
                for (k, b), (grad, hess) in zip(now, sums, strict=True):
                    own = np.flatnonzero(l == k)
                    counts = _dense(own, row, f, n, len(b), len(y))
                    g, h = Model._slopes(Model._rows(counts, size[own]), y[own], np.ones(len(own)), b)
                    grad += g
                    hess += h
            return np.concatenate([x.ravel() for s in sums for x in s])

        found, start = _summed(pool, run), 0
        for k in list(going):
            d = len(out[k])
            grad, hess = found[start : start + d], found[start + d : start + d + d * d].reshape(d, d)
            start += d + d * d
            out[k], done = Model._newton(out[k], grad, hess)
            if done:
                going.remove(k)
    return out


class _Fit:
    """A fit on all of some rows ``y, t``, as ``Model`` fits them with weights of 1, without bringing texts to the driver.

    First ``chars`` and ``candidates``, the features that are in enough toxic texts of a
    language; then, from rows of ``_seen`` with their labels, the model. The driver gets
    n-grams, candidates and sums of tasks.
    """

    def __init__(self, rows: DataFrame):
        self.chars = char_model(rows)
        self._shared, self._id = rows.sparkSession.sparkContext.broadcast(self.chars), uuid.uuid4().hex
        good = _holders(rows, self._shared, self._id)
        self._toxic = [good.pop((k, ""), 0) for k in range(len(_LANGUAGES))]
        self.candidates, self._good = list(good), np.array(list(good.values()), float)

    def seen(self, rows: DataFrame) -> DataFrame:
        """``_seen`` of rows of any first column and a text."""
        return _seen(rows, self._shared, self._id, self.candidates)

    def model(self, seen: DataFrame) -> tuple[Model, list[np.ndarray]]:
        """The model, and the chosen features of each language as places among the candidates."""
        bad, clean = _clean(seen, len(self.candidates))
        share = np.array([a / max(1e-9, a + b) for a, b in zip(self._toxic, clean.tolist(), strict=True)])
        language = np.array([k for k, _ in self.candidates], np.int64)
        pool = np.flatnonzero(self._good > 3 * share[language] * (self._good + bad))
        place = np.full(len(self.candidates), -1)
        place[pool] = np.arange(len(pool))
        prior = math.log((sum(self._toxic) + 0.5) / (int(clean.sum()) + 0.5))
        table = stored(_pooled(seen, place), "pool")
        pooled = table.coalesce(MAX_PARTS)
        names = [[self.candidates[i][1] for i in pool[language[pool] == k].tolist()] for k in range(len(_LANGUAGES))]
        first = np.cumsum([0, *map(len, names)])
        chosen = _chosen(pooled, names, [_least(n) for n in self._toxic])
        columns = [first[k] + np.array(c, np.int64) for k, c in enumerate(chosen)]
        weights = _weights(pooled, columns, prior, [k for k, n in enumerate(clean.tolist()) if n + self._toxic[k]])
        discard(table)
        features = {g: {names[k][i]: j for j, i in enumerate(chosen[k])} for k, g in enumerate(_LANGUAGES)}
        return Model.of(self.chars, prior, features, dict(zip(_LANGUAGES, weights, strict=True))), [pool[c] for c in columns]


def fitted(rows: DataFrame) -> Model:
    """The model of all rows ``y, t``."""
    fit = _Fit(rows)
    seen = stored(fit.seen(rows), "seen")
    model, _ = fit.model(seen)
    discard(seen)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per input row.

    Labels are learned only from rows whose crc32 of the id as text is no multiple of 5, and
    from all of these. Only the text goes into a score. Null and empty texts are scored as texts without
    words; very long ones are read whole. Repeated rows get equal scores; a null id is held
    out. Of an id with several texts one is learned; an id labelled both ways is toxic, other
    labels than 0 and 1 are none. Without labelled rows, all scores are 0.5. Extra columns
    are ignored; an empty table gives no rows.

    Words are restored once: what texts have of the candidates is stored, and both the fit and
    the scores are made of that.
    """
    texts = _texts(docs, doc_id, text)
    known = _Labelled(texts, labels, doc_id, label)
    fit = _Fit(known.rows)
    seen = stored(fit.seen(texts), "seen")
    marked = known.joined(seen).select("y", "l", "size", "e")
    if known.several is not None:
        marked = marked.unionAll(fit.seen(known.several))
    model, columns = fit.model(marked)
    weights = [model.weights[g] for g in _LANGUAGES]
    at = np.full(len(fit.candidates), -1)
    for c in columns:
        at[c] = np.arange(len(c))

    def run(batches):
        for batch in batches:
            (_, l, size, row, f, n), ids = _columns(batch), batch.column(0)
            scores = np.zeros(len(batch))
            row, f, n = (x[at[f] >= 0] for x in (row, f, n))
            for k, b in enumerate(weights):
                own = np.flatnonzero(l == k)
                scores[own] = Model._rows(_dense(own, row, at[f], n, len(b), len(batch)), size[own]) @ b
            scores = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
            held = [i is None or zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = seen.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("doc_id", doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
