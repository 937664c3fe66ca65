"""Near copies against brute-force Jaccard over five-word shingles."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from quarrylink.llm import nearcopies
from quarrylink.llm.common import read
from tests.llm.test_operators import _words

SF = "/root/testdata/sf0.01"


def _components(rows, similarity=0.8):
    sets = []
    for _, text in rows:
        w = _words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y):
                a, b = sorted((find(i), find(j)))
                group[b] = a
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, least.get(find(i))) for i, (k, _) in enumerate(rows)]


def _key(row):
    return tuple(-1 if x is None else x for x in row)


def test_near_copies_brute_force(spark):
    docs = read(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    base = [f"word{i}" for i in range(200)]
    # one word changed costs 5 of 196 shingles; 4 changes stay above 0.8, 5 do not reach it
    changed = lambda n, k: " ".join(f"x{k}" if i % 40 == 7 and i // 40 < n else w for i, w in enumerate(base))
    made = [(10**6, changed(0, 0)), (10**6 + 1, changed(4, 1)), (10**6 + 2, changed(5, 2)), (None, changed(1, 3)), (10**6 + 4, None), (10**6 + 5, " \n"), (10**6 + 6, "few words"), (10**6 + 7, "FEW\twords")]
    made += [(10**6 + 10 + k, changed(1, 10 + k)) for k in range(60)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in made], docs.schema))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = sorted(_components(rows), key=_key)
    assert sorted(map(tuple, nearcopies.near_copies(docs).collect()), key=_key) == want
    kept = sorted(r["doc_id"] for r in cp.keep_one_of_near_copies(spark, docs, SF).filter("doc_id is not null").collect())
    assert kept == sorted(k for k, c in want if k is not None and k == c)
    assert nearcopies.near_copies(docs.limit(0)).count() == 0


def test_simhash_links_come_first(spark, monkeypatch):
    """Near fingerprints are found by pigeonhole tables and Hamming checks, and only similar sets are linked."""
    base = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join(w if j != 7 * i else f"x{i}" for j, w in enumerate(base))) for i in range(12)] + [(20, "other words than these " * 9), (21, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    nodes = nearcopies.sketches(docs, "doc_id", "text").select("node", "n", "fp").distinct()
    fps = {r["node"]: r["fp"] % 2**64 for r in nodes.filter("n > 0").collect()}
    pairs = {(r["a"], r["b"]) for r in nearcopies.simhash_pairs(nodes).collect()}
    group, close = {x: x for x in fps}, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4
    root = lambda x: x if group[x] == x else root(group[x])
    for a, b in pairs:
        group[root(a)] = root(b)
    # what tables and checks join is what brute force over all fingerprints joins
    want = {x: x for x in fps}
    for a in fps:
        for b in fps:
            if close(a, b):
                old = want[a]
                want = {x: want[b] if g == old else g for x, g in want.items()}
    assert pairs and all((root(a) == root(b)) == (want[a] == want[b]) for a in fps for b in fps)
    seen, links = [], nearcopies.simhash.links
    monkeypatch.setattr(nearcopies.simhash, "links", lambda *a, **k: seen.append(k) or links(*a, **k))
    got = sorted(map(tuple, nearcopies.near_copies(docs).collect()))
    assert seen and got == sorted(_components(rows))


def test_edits_of_one_text_are_not_compared_pair_by_pair(spark):
    """A large group of which each member has many edits of its own: few pairs, and no link lost."""
    rng = random.Random(5)
    base = [f"word{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for j in rng.sample(range(120), rng.choice((1, 2, 4, 8, 12))):
            w[j] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sketch = nearcopies.sketches(docs, "doc_id", "text")
    sets = nearcopies.sets_of(docs, "text").join(sketch.select("node", "n"), "node").withColumn("component", F.col("node"))
    found = {(r["a"], r["b"]) for r in nearcopies.prefix_pairs(sets, 0.8).collect()}
    of = {r["node"]: set(r["shingles"]) for r in sets.collect()}
    nodes = sorted(of)
    close = {(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b])}
    assert close and close <= found and len(found) < 0.3 * len(nodes) * (len(nodes) - 1) / 2
    assert sorted(map(tuple, nearcopies.near_copies(docs).collect())) == sorted(_components(rows))
