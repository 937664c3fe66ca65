"""Brute-force versions, round trips, planted cases and edge cases of the operators."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylink.llm import components, decontam, hashing, linededup, lm, media, packing, quality, registry, simhash, toxicity, urls, warc
from quarrylink.llm.common import fresh, read, utf8

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunk string, lost string, n_words int"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "one two three four five six", "en", "a", 1, "x", "y", 7),
        (1, "one two three four five six", "en", "a", 1, "x", "y", 7),
        (2, "ONE two\tthree four five six", None, None, None, None, None, None),
        (3, None, "en", None, None, "x", "y", 7),
        (4, "", "en", "a", 0, "x", "y", 7),
        (5, " \n\t ", "fr", "a", 4, "x", "y", 7),
        (6, long, "en", "a", len(long), "x", "y", 7),
        (None, "Grüße an 你好 \U0001f600", "de", "b", 12, "x", "y", 7),
        (7, "x", "en", "b", 1, "x", "y", 7),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (6, 1, 0), (7, 0, None), (None, None, 1), (8, 1, 0)], LABELS)


def _words(text):
    return [w for w in re.split("[\x20\x09-\x0D]+", text or "") if w]


def test_every_query_is_named():
    assert {int(k[2:].split("_")[0]) for k in registry.QUERIES if k.startswith("op")} == set(range(1, 11)) and "pipeline" in registry.QUERIES


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(same_rows, name):
    same_rows(registry.QUERIES[name], registry.ORACLES[name])


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "Lost int, lost_1 int")
    assert fresh(df, "lost", "lost", "other") == ["lost_2", "lost_3", "other"]


def test_word_hashes():
    import pyarrow as pa

    texts = ["a b\x0bab", "", None, "ba ab", "c" * 200_000 + " a", "é b"]
    h, at = hashing.words(*utf8(pa.array(texts)))
    flat = [w for t in texts for w in _words(t)]
    assert np.diff(at).tolist() == [len(_words(t)) for t in texts]
    seen = {}
    for w, v in zip(flat, h.tolist(), strict=True):
        assert seen.setdefault(w, v) == v
    assert len(set(seen.values())) == len(seen)


# 1 LM scores


def _backoff(rows, min_count=lm.MIN_COUNT):
    docs = [_words(t) for t in rows]
    c = Counter(tuple(d[i : i + n]) for d in docs for n in (1, 2, 3) for i in range(len(d) - n + 1))
    total = sum(map(len, docs))
    out = []
    for d in docs:
        score, levels = 0, Counter()
        for i in range(len(d)):
            n, off = min(i + 1, 3), 0.0
            while n > 1 and c[tuple(d[i - n + 1 : i + 1])] < min_count:
                n, off = n - 1, off + math.log(lm.BACKOFF)
            g = tuple(d[i - n + 1 : i + 1])
            score += round((math.log(c[g] / (c[g[:-1]] if n > 1 else total)) + off) * 1e6)
            levels[n] += 1
        out.append((len(d), levels[1], levels[2], levels[3], score))
    return out


def test_lm_brute_force(spark, odd, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 100_000)
    monkeypatch.setattr(lm, "SHARD_BYTES", 50_000)
    rows = odd.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, _backoff([r["text"] for r in rows]), strict=True))
    got = Counter(tuple(r) for r in lm.score(odd).collect())
    assert {k[:5] for k in got} == {k[:5] for k in want} and sum(got.values()) == len(rows)
    for k, n in want.items():
        assert any(g[:5] == k[:5] and abs(g[5] - k[5]) <= 2 and m == n for g, m in got.items())
    assert lm.score(odd.limit(0)).count() == 0


def test_lm_blocks_grow_with_the_corpus():
    blocks = {size: math.prod(lm.dealt(size)) for size in (10**10, 10**11, 10**12, 10**13, 10**14)}
    assert all(8 < blocks[10 * s] / blocks[s] < 12 for s in (10**11, 10**12, 10**13)) and lm.dealt(0) == (1, 1)


# 2 line dedup


def test_line_dedup(spark, odd):
    rows = [(i, f"top\nbody {i}\n\n top", "h") for i in range(10)] + [(20, "top\nonly", "k"), (21, None, "h"), (22, "", None), (23, "top", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string").withColumn("n_lines", F.lit("kept"))
    got = {r["doc_id"]: r for r in linededup.drop_boilerplate(df, ratio=0.5, min_pages=3).collect()}
    assert got[3]["text"] == "body 3\n" and (got[3]["n_lines_1"], got[3]["n_dropped"], got[3]["n_lines"]) == (4, 2, "kept")
    assert got[20]["text"] == "top\nonly" and got[21]["text"] is None and got[22]["text"] == "" and got[23]["text"] == "top"
    # 10 of 11 pages hold the line, so a ratio that equals their share keeps it
    assert linededup.boilerplate_lines(df, ratio=10 / 11, min_pages=3).filter("host = 'h'").count() == 0
    out = linededup.drop_boilerplate(odd)
    assert out.count() == 9 and set(odd.columns) <= set(out.columns)
    assert linededup.drop_boilerplate(odd.limit(0)).count() == 0


# 3 decontamination


def _clean(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _contaminated(text, items, size=10):
    w, hit, found = _clean(text), set(), set()
    for k, t in items:
        iw = _clean(t)
        for s in range(max(1, len(iw) - size + 1)) if iw else ():
            win = iw[s : s + size]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    if k is not None:
                        found.add(str(k))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [50_000, 3])
def test_decontamination_brute_force(spark, odd, block):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcde") for _ in range(n))) for i, n in enumerate([12, 10, 9, 3, 2, 1, 25])] + [(100, "x!y?z"), (101, None), (102, "..."), (None, "q r s t"), (10, "one, TWO-three four five six")]
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 200))) for _ in range(30)] + [items[0][1] + " f " + items[6][1], "x y z", "Q r s t", "É é one two"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").unionByName(odd, allowMissingColumns=True)
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontam.contamination(docs, bench, block=block)
    want = Counter((r["doc_id"], *_contaminated(r["text"], items)) for r in docs.collect())
    assert Counter(tuple(r)[:6] for r in got.collect()) == want
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).filter("contaminated").count() == 0


# 4 media


def test_media(spark, odd):
    for h, w in ((1, 1), (7, 5), (64, 64), (9000, 3)):
        rgb = np.random.default_rng(h).integers(0, 256, (h, w, 3), dtype=np.uint8)
        assert (media.decode(media.write_ppm(rgb)) == rgb).all() and (media.decode(media.write_bmp(rgb)) == rgb).all()
        assert (media.decode(media.write_pgm(rgb[..., 0])) == rgb[..., 0]).all()
        g = media.gray(rgb).astype(float)
        # area means by brute force: every pixel as a 12 x 12 block (or as many as the target has cells)
        fine = np.kron(g, np.ones((4, 4)))
        assert media.area_resize(fine, h, w) == pytest.approx(g)
    assert media.area_resize(np.arange(6.0).reshape(1, 6), 1, 4) == pytest.approx(np.array([[(0 + 0.5 * 1) / 1.5, (0.5 * 1 + 2) / 1.5, (3 + 0.5 * 4) / 1.5, (0.5 * 4 + 5) / 1.5]]))
    assert (media.decode(b"P2 # c\n2 1 10\n0 10") == [[0, 255]]).all() and (media.decode(b"P1 3 1 010") == [[255, 0, 255]]).all() and (media.decode(b"P4 3 1\n\x40") == [[255, 0, 255]]).all()
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")
    got = media.describe_texts(odd).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    for (k, t), n in texts.items():
        raw = t.encode()
        pay = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        for r in by_id[k][:n]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
            stored = media.store_payload(pay)
            assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
            assert np.load(__import__("io").BytesIO(r["tile"])).shape == (16, 16) and len(r["feature"]) == 16
    assert len(got) == 9 and media.describe_texts(odd.limit(0)).count() == 0
    assert {r["media_format"] for r in registry.QUERIES["op4_media_columns"](spark, SF).select("media_format").distinct().collect()} == {"bmp", "netpbm"}


# 5 packing


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    for df, room in ((odd, 64), (read(spark, SF, "documents"), 2048)):
        texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        ids = {x: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for x in {x for _, x in texts}}
        rows = packing.pack(df, max_tokens=room).collect()
        want = Counter((k, s, len(ids[x][s : s + room]), zlib.crc32(ids[x][s : s + room].tobytes()), len(ids[x])) for k, x in texts for s in range(0, len(ids[x]), room))
        assert Counter(tuple(r)[:5] for r in rows) == want
        seqs = defaultdict(list)
        for r in rows:
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in seqs.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= room
    used = sum(r["length"] for r in rows)
    assert used / (len(seqs) * 2048) > 0.97
    assert packing.pack(odd.limit(0)).count() == 0


def test_patterns_place_every_length():
    rng = random.Random(1)
    for room in (8, 100, 2048):
        h = {rng.randint(1, room): rng.randint(1, 10**6) for _ in range(min(room, 300))}
        seen = Counter()
        found = packing.patterns(h, room)
        for n, lengths in found:
            assert n > 0 and sum(lengths) <= room
            for x in lengths:
                seen[x] += n
        assert seen == Counter(h) and len(found) < 20 * len(h)


# 6 urls


def test_url_parts(spark):
    given = ["HTTP://WWW.Example.COM/en/1?x#y", "a://h?q", "a://h#f/x", "no scheme", None, "x://A/b://c"]
    df = spark.createDataFrame([(u,) for u in given], "u string").select(urls.host(F.col("u")), urls.path(F.col("u")))
    assert [tuple(r) for r in df.collect()] == [("www.example.com", "/en/1"), ("h", ""), ("h", ""), ("", ""), ("", ""), ("a", "/b://c")]


def _rule(host, path):
    fit = [(len(h + p), -i, v, h + p) for i, (v, h, p) in enumerate(urls.RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


def test_redirects_propagate(spark):
    link = '<html><head><LINK href="{}" rel="canonical"></head></html>'
    pages = [
        (1, "http://a.org/x", link.format("http://b.org/y#frag")),
        (2, "http://B.org/y", '<meta http-equiv="refresh" content="0; url=https://c.net/fr/1">'),
        (3, "https://c.net/fr/1#z", None),
        (4, "http://shop.com/a", link.format("https://c.net/fr/1")),
        (5, "http://d.org/1", link.format("/2")),
        (6, "http://d.org/2", link.format("3?a=1&amp;b=2")),
        (7, "http://d.org/3?a=1&b=2", ""),
        (8, "http://e.org/p", link.format("http://f.net/es/only-a-target")),
        (9, None, link.format("http://a.org/x")),
        (10, "nonsense", None),
        (None, "http://a.org/x", None),
        (None, "http://a.org/x", None),
    ]
    df = spark.createDataFrame(pages, "page_id int, url string, html string").withColumn("host", F.lit("clash"))
    got = Counter((r["page_id"], r["verdict"], r["rule"]) for r in urls.judge(df).collect())
    want = {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow", 10: "allow"}
    assert {k: v for k, v, _ in got if k} == want and got[(None, "block", None)] == 2
    assert {r for k, _, r in got if k in (3, 4)} == {"net/fr/", "com/"}
    more = spark.createDataFrame([("http://d.org/2", "http://x.net/es/1")], "source string, target string")
    assert {r["page_id"] for r in urls.judge(df, redirects=more).filter("verdict = 'block'").collect()} == {1, 2, 3, 5, 6, 7, 8, None}
    assert urls.judge(df.limit(0)).count() == 0


def test_url_query(spark):
    pages = {r["page_id"]: r["url"] for r in read(spark, SF, "pages").select("page_id", "url").collect()}
    for r in registry.QUERIES["op6_url_filters"](spark, SF).collect():
        rest = pages[r["page_id"]].split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        verdict, rule = _rule(host.lower(), path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host.lower(), path, rule, verdict or "allow")


# components


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {"random": [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)], "chain": [(i, i + 1) for i in range(70)], "star": [(500, i) for i in range(200)] + [(7, 7), (900, 900)], "none": []}[shape]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")
    assert {r[0]: r[1] for r in components.connected_components(df).collect()} == {x: find(x) for x in root}


# 7 SimHash


def _fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = _words(low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[i : i + 4] for i in range(len(w) - 3)] or [w])]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _groups(ids, fps, d=4):
    group = list(range(len(fps)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                a, b = sorted((find(i), find(j)))
                group[b] = a
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_brute_force(spark, odd):
    base = " ".join(f"word{i}" for i in range(200))
    copies = [(100 + i, base + f" tail{i}") for i in range(25)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id bigint, text string")).unionByName(read(spark, SF, "documents").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    rows = docs.collect()
    fps = [_fingerprint(r["text"]) for r in rows]
    want = Counter((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, _groups([r["doc_id"] for r in rows], fps), strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs.withColumn("fp", F.lit(1))).collect())) == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 10**4, 10**7, 10**9])
def test_every_close_pair_shares_a_bucket(n):
    rng, tables = random.Random(n), simhash.masks(n)
    for _ in range(300):
        flipped = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & flipped for m in tables)


def test_links_of_a_dense_bucket():
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)})
    a, b = simhash.linked(np.zeros(len(fps), np.int64), np.array(fps, np.uint64), 4)
    assert len(a) < len(fps)
    group = {f: f for f in fps}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        group[find(x)] = find(y)
    parts = defaultdict(set)
    for f in fps:
        parts[find(f)].add(f)
    want = defaultdict(set)
    for f, g in zip(fps, _groups(fps, fps), strict=True):
        want[g].add(f)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


# 8 toxicity


def test_deobfuscation():
    model = toxicity.CharModel(Counter({w: 50 for w in "idiot stupid moron trash loser clown hello world people these words there paper".split()}))
    for seen, word in {"1d10t": "idiot", "stup!d": "stupid", "m0r0n": "moron", "tr@sh": "trash", "l.o.s.e.r": "loser", "clooooown": "clown", "h3ll0": "hello"}.items():
        assert toxicity.decode(seen, model) == word
    assert "idiot" in toxicity.tokens_of("you i d i o t ok") and toxicity.restored("$tupid", model)[-1] == "stupid"
    assert toxicity.restored("words,", model) == ["words"] and toxicity.restored("2024", model) == []


def _every_path(token, model, split):
    """The best score and text of all paths, each scored whole."""
    from itertools import product

    best = (-math.inf, "")
    breaks = list(product([False, True], repeat=len(token) - 1)) if split else [(False,) * (len(token) - 1)]
    for chosen in product(*toxicity.ways_of(token)):
        for cut in breaks:
            score, words = sum(cost for _, cost in chosen), [""]
            for i, (c, _) in enumerate(chosen):
                if i and cut[i - 1]:
                    words.append("")
                words[-1] += c
            if len(words) > 1 and not all(words):
                continue
            for w in words:
                padded = "^" * (model.order - 1) + w + "$"
                score += sum(math.log(model.p(padded[i - model.order + 1 : i], padded[i])) for i in range(model.order - 1, len(padded)))
            best = max(best, (score, " ".join(words)))
    return best


def test_viterbi_is_exact():
    model = toxicity.CharModel(Counter({w: n for n, w in enumerate("idiot stupid ass shit you die lass sass the trash i a".split(), 1)}))
    for token in ("1d!07", "5h!7", "@$$", "a$$", "$tup1d", "y*u", "i..d", "(l4ss", "diieee", "é*1"):
        score, text = toxicity.best_path(token, model)
        want = _every_path(token, model, False)
        assert score == pytest.approx(want[0]) and (text == want[1] or score == pytest.approx(want[0]))
    for token in ("youdie", "1d1", "a$$a", "ia"):
        assert toxicity.best_path(token, model, split=True)[0] == pytest.approx(_every_path(token, model, True)[0])


def test_disguises_without_gates():
    words = "idiot stupid moron asshole ass shit die you are a so hello world people these words trash thing this that with house time".split()
    model = toxicity.CharModel(Counter({w: 50 for w in words}))
    for seen, word in {"$tup1d": "stupid", "!d!ot": "idiot", "@$$h0l3": "asshole", "a$$": "ass", "5h!7": "shit", "1d!07": "idiot", "idi" + "o" * 40 + "t": "idiot", "i.d.i.o.t" + "!" * 40: "idiot", "stup!d.": "stupid"}.items():
        assert word in toxicity.restored(seen, model)
    assert toxicity.restored("hello!", model) == ["hello"] and toxicity.restored("(words)", model) == ["words"]
    for number in ("2024", "$1,234.50", "50%", "12:30", "#1", "1/2", "--"):
        assert toxicity.restored(number, model) == []
    said = lambda text: {w for t in text.split() for w in toxicity.words_of(t, model)} | {w for r in toxicity.spelled_of(text) for w in toxicity.spelled_words(r, model)}
    assert "die" in said("so d i e now") and "moron" in said("m  o  r  o  n  s") | said("m  o  r  o  n") and "idiot" in said("i d i 0 t")
    assert {"you", "idiot"} <= said("hey y o u i d i o t") and "ass" in said("an a s s")


def test_bounds_of_fitting_hold_for_repeated_ids(spark):
    rows = [(i % 4, f"the of and text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(4)], LABELS)
    got, _ = toxicity.training_rows(docs, marks, most=2)
    assert len(got) == 2
    long = spark.createDataFrame([(i, "the of " * 1000) for i in range(40)], "doc_id bigint, text string")
    got, weights = toxicity.training_rows(long, spark.createDataFrame([(i, 1, 0) for i in range(40)], LABELS), most_bytes=30_000)
    assert len(got) == 4 and weights["en"][0] > 4


def test_toxicity_learns_and_holds_out(spark, odd, labels):
    rng = random.Random(4)
    plain = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    bad = ["idiot", "moron", "scumbag"]
    noisy = {"idiot": ["1d10t", "i d i o t", "idiooot", "IDIOT"], "moron": ["m0r0n", "Moron!!"], "scumbag": ["$cumbag", "s.c.u.m.b.a.g"]}
    rows, marks = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(40)] + ["the", "of", "and"]
        y = int(i % 4 == 0)
        for _ in range(3 * y):
            w = rng.choice(bad)
            words.insert(rng.randrange(len(words)), rng.choice(noisy[w]) if i % 3 == 0 else w)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, y))
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, LABELS)).collect()
    held = [(r["predicted"], marks[r["doc_id"]][2]) for r in got if r["held_out"]]
    assert {r["held_out"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0} == {True} and len(got) == 900
    assert sum(p == y for p, y in held) / len(held) > 0.97
    few = toxicity.toxicity(odd, labels).collect()
    assert len(few) == 9 and all(0 <= r["score"] <= 1 for r in few)
    assert len({r["score"] for r in few if r["doc_id"] in (3, 4, 5)}) == 1
    assert toxicity.toxicity(odd, labels.limit(0)).count() == 9 and toxicity.toxicity(odd.limit(0), labels).count() == 0


# 9 quality


def _kneser_ney(train):
    """Interpolated modified Kneser-Ney by its definition, over word tuples."""
    pad = ("<s>", "<s>")
    tri = Counter((*pad, *d)[i : i + 3] for d in map(tuple, train) for i in range(len(d)))
    bi, uni = defaultdict(set), defaultdict(set)
    for a, b, c in tri:
        bi[(b, c)].add(a)
    for b, c in bi:
        uni[c].add(b)
    orders = {3: dict(tri), 2: {k: len(v) for k, v in bi.items()}, 1: {(k,): len(v) for k, v in uni.items()}}
    ctx = {n: defaultdict(list) for n in orders}
    cut = {}
    for n, counts in orders.items():
        h = Counter(counts.values())
        y = h[1] / (h[1] + 2 * h[2]) if h[1] and h[2] else 0
        cut[n] = [min(max(k - (k + 1) * y * h[k + 1] / h[k], 0.05), k - 0.05) if h[k] and y else 0.5 for k in (1, 2, 3)]
        for g, c in counts.items():
            ctx[n][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / (len(orders[1]) + 1)
        n, own = len(g), ctx[len(g)].get(g[:-1])
        if not own:
            return p(g[1:])
        d = lambda c: cut[n][min(c, 3) - 1]
        c = orders[n].get(g, 0)
        return (c - d(c) if c else 0) / sum(own) + sum(map(d, own)) / sum(own) * p(g[1:])

    return lambda d: sum(math.log(p((*pad, *d)[i : i + 3])) for i in range(len(d)))


def test_kneser_ney_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(12)]
    train = [[rng.choice(vocab[: rng.randint(2, 12)]) for _ in range(rng.randint(1, 60))] for _ in range(40)]
    test = [*train[:5], ["v1", "new", "v2", "v3"], ["other"], [], train[0]]
    texts = spark.createDataFrame([(" ".join(d),) for d in train] + [(None,), ("",)], "text string")
    fitted = quality.fit(texts)
    docs = spark.createDataFrame([(i, " ".join(d), 0) for i, d in enumerate(test)] + [(len(test), None, 0)], "i int, text string, a int")
    log_p = _kneser_ney(train)
    # a broadcast model and a shuffled one give the same
    for most in (quality.BROADCAST_ROWS, 0):
        model = quality.Model(fitted.packed, fitted.words, fitted.logs, fitted.unseen)
        assert (model.shared(most) is None) == (most == 0)
        got = quality.perplexities(docs, model, most=most).orderBy("i").collect()
        assert got[0].asDict().keys() == {"i", "text", "a", "n_words", "log_p"}
        for r, d in zip(got, [*test, []], strict=True):
            assert r["n_words"] == len(d) and r["log_p"] == pytest.approx(log_p(tuple(d)), rel=1e-4, abs=1e-4)


def test_quality_by_its_definition(spark):
    """Perplexity, threshold and decision of every document, by brute force."""
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(40)]
    rows = []
    for i in range(260):
        words = [rng.choice(vocab[: 25 if i % 2 else 40]) for _ in range(rng.randint(0, 50))]
        rows.append((i, " ".join(words) if i % 11 else " ".join(words[:3] + ["odd"] * 30), "en" if i % 3 else None if i % 2 else "fr"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 11 > 0), 0) for i in range(200)], LABELS)
    hashes = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(1000)).alias("p")).collect()}
    trusted = [(i, t.split(), g) for i, t, g in rows if i < 200 and i % 11]
    log_p = _kneser_ney([w for i, w, _ in trusted if hashes[i] >= 500])
    held = [(w, g) for i, w, g in trusted if hashes[i] < 500 and w]
    mean = sum(log_p(tuple(w)) for w, _ in held) / sum(len(w) for w, _ in held)
    value = lambda w: -(log_p(tuple(w)) + quality.PRIOR_WORDS * mean) / (len(w) + quality.PRIOR_WORDS)

    def limit(values):
        steps = sorted(math.ceil(v / quality.STEP) for v in values)
        return quality.MARGIN * math.exp(quality.STEP * steps[math.ceil(quality.QUANTILE * len(steps)) - 1])

    every = limit([value(w) for w, _ in held])
    of = {g: limit([value(w) for w, l in held if l == g]) for g in ("en", "fr")}
    got = quality.classify(docs, labels).collect()
    assert len(got) == 260
    for r in got:
        w = (r["text"] or "").split()
        threshold = of.get(r["lang"], every)
        assert r["perplexity"] == pytest.approx(math.exp(value(w)), rel=1e-4) and r["threshold"] == pytest.approx(threshold, rel=2e-3)
        if abs(math.exp(value(w)) / threshold - 1) > 3e-3:
            assert r["keep"] == (not w or math.exp(value(w)) <= threshold)
    assert {r["keep"] for r in got} == {True, False}


def test_quality_keeps_clean_documents(spark, odd, labels):
    sf = "/root/testdata/sf0.01"
    got = registry.QUERIES["op9_quality"](spark, sf).join(read(spark, sf, "labels"), "doc_id").collect()
    good = [r["keep"] for r in got if r["quality"] == 1]
    junk = [r["keep"] for r in got if r["quality"] == 0 and r["n_words"] > 30]
    assert sum(good) / len(good) > 0.99 and sum(junk) / len(junk) < 0.4
    out = quality.classify(odd, labels)
    assert out.count() == 9 and {"n_words_1", "perplexity", "threshold", "keep"} <= set(out.columns)
    assert out.filter("n_words_1 = 0 and not keep").count() == 0
    assert quality.classify(odd, labels.limit(0)).filter("keep").count() == 9 and quality.classify(odd.limit(0), labels).count() == 0


# 10 WARC


def _digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/\r\nX: y", "same"), (3, None, "same"), (9, "u", "same"), (3, "dup row", "same"), (4, "é", None), (2, "e", ""), (None, "n", "same"), (None, "n2", "alone"), (7, "long", "z" * 3_000_000 + "é\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha", F.lit(1))
    marked = warc.with_revisits(df)
    archives = warc.write_archives(marked.coalesce(1), archive_bytes=500)
    assert archives.count() > 2
    one = zlib.decompressobj(31)
    one.decompress(archives.first()["blob"])
    assert one.eof and not one.unused_data  # a whole archive is one gzip stream
    norm = warc.normalise(archives)
    recs = warc.read_records(norm, True).collect()
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in recs)
    want = Counter()
    for k, _, h in rows:
        b = (h or "").encode()
        first = {"same": 3, None: 2, "": 2}.get(h)
        refers = None if first is None or k == first else first
        want[(k, len(b), _digest(b), "revisit" if refers is not None else "response", refers)] += 1
    assert got == want
    assert {r["url"] for r in recs if r["page_id"] == 5} == {"http://a/%0D%0AX: y"} and {r["payload"] for r in recs if r["page_id"] == 7} == {rows[-1][2].encode()}
    warc.export_files(norm, f"file://{tmp_path}/w")
    files = sorted((tmp_path / "w").glob("*.warc.gz"))
    assert sum(len(list(warc.records_of(warc.inflate(f.read_bytes())))) for f in files) == len(rows)
    assert warc.archive(df, min_bytes=1).filter("page_id = 4").first()["record_type"] == "response"
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_query(spark):
    pages = read(spark, SF, "pages").collect()
    got = {r["page_id"]: r for r in registry.QUERIES["op10_warc"](spark, SF).collect()}
    first = {}
    for r in sorted(pages, key=lambda r: r["page_id"]):
        first.setdefault(r["html"], r["page_id"])
    for r in pages:
        b, g = r["html"].encode(), got[r["page_id"]]
        refers = first[r["html"]] if first[r["html"]] != r["page_id"] else None
        assert (g["payload_bytes"], g["payload_digest"], g["refers_to"], g["record_type"]) == (len(b), _digest(b), refers, "revisit" if refers is not None else "response")
