"""Named queries over the given tables, one for each operator, with DuckDB SQL where it exists.

Parts stand for business records of three sources (``views.part_records``): few names, many
ties. Customers and suppliers share numbers by key. Documents bring other scripts' letters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylink import goldens
from quarrylink.functions import similarity as sim
from quarrylink.functions import text as tx
from quarrylink.operators import blocking, embedding, evaluation, matching, profiling, validation
from quarrylink.operators.normalize import normalized, stored_form
from quarrylink.plans import linkage
from quarrylink.sources import scratch, tables, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with SQL for its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# SQL forms of the text rules, for ASCII texts


def _replaced(x: str, rules) -> str:
    for pattern, to in rules:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _name_sql(x: str) -> str:
    x = f"replace(lower(coalesce({x}, '')), '&', ' and ')"
    x = _replaced(x, [
        (r"\b(?:https?://|www\.)", ""), (r"\.(?:com|org|net|co\.in|in|fr|io|biz|info|edu|gov)\b", " "), (r"-\s*[0-9]{6,}\b|#[0-9]{4,}\b", " "),
        (r"^[#\-<>*/@+|]+|[#\-<>*/@+|]+$", " "), (r"^(?:mirapyra\s+)?(?:formerly|dba|d/b/a|ex|trading\s+as|t/a)\s+", ""), (r"[^a-z0-9\s]", " "),
    ])
    return _squeezed(_replaced(_squeezed(x), tx.LEGAL_FORMS))


def _core_sql(full: str) -> str:
    core = _squeezed(f"regexp_replace({full}, '{tx.LEGAL_TOKENS}', ' ', 'g')")
    return f"CASE WHEN {core} = '' THEN {full} ELSE {core} END"


def _address_sql(x: str) -> str:
    x = _replaced(f"replace(lower(coalesce({x}, '')), '&', ' and ')", [*tx.ADDRESS_WORDS, *((rf"\b{k}\b", v) for k, v in tx.US_STATES.items()), (r"\b0+([0-9]+)\b", r"\1"), (r"[^a-z0-9\s]", " ")])
    return _squeezed(x)


_IN = lambda words: ", ".join(f"'{w}'" for w in words)
_TOKENS = f"list_filter(regexp_extract_all(lower({{x}}), '[a-z0-9]+'), lambda w: length(w) >= 2 AND w NOT IN ({_IN(tx.STOP_TOKENS)}))"
_NORMALIZED = f"""
raw AS ({views.PART_RECORDS}),
half AS (SELECT entity_id, source, upper(trim(country)) AS country, {_name_sql("business_name")} AS clean_name_full, {_address_sql("business_address")} AS clean_address FROM raw),
nz AS (SELECT entity_id, source, country, clean_name_full, clean_address, {_core_sql("clean_name_full")} AS clean_name FROM half)"""
_SIGNALS = f"""{_NORMALIZED},
s1 AS (SELECT * FROM nz WHERE source = 'S1'), tg AS (SELECT * FROM nz WHERE source <> 'S1'),
b1 AS (SELECT country, entity_id, unnest(list_distinct({_TOKENS.format(x="clean_name")})) AS f FROM s1),
b2 AS (SELECT country, source, entity_id, unnest(list_distinct({_TOKENS.format(x="clean_name")})) AS f FROM tg),
c1 AS (SELECT country, entity_id, unnest(list_distinct(regexp_extract_all(clean_address, '[0-9]+'))) AS f FROM s1),
c2 AS (SELECT country, source, entity_id, unnest(list_distinct(regexp_extract_all(clean_address, '[0-9]+'))) AS f FROM tg),
b2k AS (SELECT * FROM b2 QUALIFY count(*) OVER (PARTITION BY country, f) <= {{tokens}}),
c2k AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY country, f ORDER BY source, entity_id) <= {{numbers}}),
bc AS (SELECT s1_id, target_id, CAST(n AS DOUBLE) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY n DESC, source, target_id) AS r FROM (
  SELECT b1.entity_id AS s1_id, b2k.entity_id AS target_id, source, count(*) AS n FROM b1 JOIN b2k USING (country, f) GROUP BY ALL)) WHERE r <= {{top_b}}),
cc AS (SELECT s1_id, target_id, CAST(n AS DOUBLE) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY n DESC, source, target_id) AS r FROM (
  SELECT c1.entity_id AS s1_id, c2k.entity_id AS target_id, source, count(*) AS n FROM c1 JOIN c2k USING (country, f) GROUP BY ALL)) WHERE r <= {{top_c}}),
g AS (SELECT source, country, entity_id, unnest(list_transform(range(1, greatest(length(w) - 2, 1) + 1), lambda i: substring(w, i, 3))) AS gram FROM (
  SELECT source, country, entity_id, ' ' || unnest(string_split(clean_name, ' ')) || ' ' AS w FROM nz)),
tf AS (SELECT source = 'S1' AS anchor, source, country, entity_id, gram, count(*) AS tf FROM g GROUP BY ALL),
cn AS (SELECT country, count(*) AS n FROM nz WHERE source <> 'S1' GROUP BY 1),
st AS (SELECT country, gram, count(*) AS df FROM tf WHERE NOT anchor GROUP BY 1, 2 HAVING count(*) >= 2),
w AS (SELECT tf.*, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN st USING (country, gram) JOIN cn USING (country)),
nw AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY country, entity_id)) AS x FROM w),
sc AS (SELECT l.entity_id AS s1_id, r.entity_id AS target_id, r.source, round(sum(l.x * r.x), 9) AS score FROM nw l JOIN nw r USING (country, gram) WHERE l.anchor AND NOT r.anchor GROUP BY ALL HAVING round(sum(l.x * r.x), 9) >= 0.25),
ac AS (SELECT s1_id, target_id, score, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, source, target_id) AS rank FROM sc QUALIFY rank <= {{top_b}})"""


def _signals_sql(tokens=5000, numbers=2000, top_b=20, top_c=15) -> str:
    return _SIGNALS.replace("{tokens}", str(tokens)).replace("{numbers}", str(numbers)).replace("{top_b}", str(top_b)).replace("{top_c}", str(top_c))


_UNION = """
u AS (SELECT s1_id, target_id, sum(a) AS a, sum(b) AS b, sum(c) AS c FROM (SELECT s1_id, target_id, score AS a, 0.0 AS b, 0.0 AS c FROM ac UNION ALL SELECT s1_id, target_id, 0.0, score, 0.0 FROM bc UNION ALL SELECT s1_id, target_id, 0.0, 0.0, score FROM cc) GROUP BY 1, 2),
ur AS (SELECT s1_id, target_id, CAST(a AS DOUBLE) AS score_a, CAST(b AS DOUBLE) AS score_b, CAST(c AS DOUBLE) AS score_c, 1.0::DOUBLE * a + 0.35::DOUBLE * b + 0.25::DOUBLE * c AS score FROM u),
fin AS (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) AS rank FROM ur QUALIFY rank <= {final})"""
_UNION, _UNION_50 = _UNION.replace("{final}", "20"), _UNION.replace("{final}", "50")
#: Scores as both engines print them.
_FIN = "SELECT s1_id, target_id, round(score_a, 6) AS score_a, score_b, score_c, round(score, 6) AS score, rank FROM fin"
_TRUTH = """
tp AS (SELECT s1.entity_id AS s1_id, tg.entity_id AS target_id FROM s1 JOIN tg USING (country, clean_name_full))"""


def _parts(spark, sf_dir):
    n = scratch.stored(normalized(views.part_records(spark, sf_dir)), "records")
    return n.filter("source = 'S1'"), n.filter("source <> 'S1'")


def _truth(anchors, targets):
    """True pairs by rule: equal full names in one country."""
    left = anchors.select(F.col("entity_id").alias("s1_id"), "country", "clean_name_full")
    return left.join(targets.select(F.col("entity_id").alias("target_id"), "country", "clean_name_full"), ["country", "clean_name_full"]).select("s1_id", "target_id")


def _true_by_name(anchors, targets):
    """The pairs of ``_truth``, by country and full name; a null in either is no key."""
    key = F.when(F.col("country").isNotNull() & F.col("clean_name_full").isNotNull(), F.struct("country", "clean_name_full")).alias("key")
    return evaluation.Keyed(anchors.select(F.col("entity_id").alias("s1_id"), key), targets.select(F.col("entity_id").alias("target_id"), key))


def _signals(spark, sf_dir, top=blocking.FINAL_TOP, number_top=blocking.NUMBER_TOP):
    a, t = _parts(spark, sf_dir)
    return a, t, linkage.signals(a, blocking.positions(t), top, number_top=number_top)


def _ranked(spark, sf_dir, top=blocking.FINAL_TOP, number_top=blocking.NUMBER_TOP):
    a, t = _parts(spark, sf_dir)
    return a, t, linkage.candidates(a, t, top, number_top=number_top)


# the pair score by its definition: longest common subsequences as running maxima over rows of a table
_LCS = """coalesce(list_reduce(list_concat([list_transform(range(length({x})), lambda i: 0::BIGINT)], list_transform(string_split({y}, ''), lambda c: list_transform(string_split({x}, ''), lambda d: CASE WHEN c = d THEN 1::BIGINT ELSE 0::BIGINT END))),
  lambda r, m: list_transform(range(1, len(r) + 1), lambda k: list_max(list_transform(range(1, k + 1), lambda i: greatest(r[i], coalesce(r[i - 1], 0) + m[i])))))[-1], 0)"""


def _ratio_sql(x: str, y: str) -> str:
    return f"(CASE WHEN {x} = {y} THEN 100.0::DOUBLE WHEN {x} = '' OR {y} = '' THEN 0.0::DOUBLE ELSE 200.0::DOUBLE * {_LCS.format(x=x, y=y)} / (length({x}) + length({y})) END)"


def _compared_sql(name: str, source: str) -> str:
    """A table of the distinct texts x, y of a source with ratio r, token sort srt and token set tst."""
    joined = lambda e: f"array_to_string(list_sort({e}), ' ')"
    toks = lambda v: f"list_filter(string_split({v}, ' '), lambda w: w <> '')"
    return f"""{name}0 AS (SELECT DISTINCT x, y FROM {source}),
{name}1 AS (SELECT x, y, {joined(toks("x"))} AS sx, {joined(toks("y"))} AS sy, list_distinct({toks("x")}) AS tx, list_distinct({toks("y")}) AS ty FROM {name}0),
{name}2 AS (SELECT *, {joined("list_filter(tx, lambda w: list_contains(ty, w))")} AS i, {joined("list_filter(tx, lambda w: NOT list_contains(ty, w))")} AS d, {joined("list_filter(ty, lambda w: NOT list_contains(tx, w))")} AS e FROM {name}1),
{name}3 AS (SELECT *, trim(i || ' ' || d) AS u, trim(i || ' ' || e) AS v FROM {name}2),
{name} AS (SELECT x, y, {_ratio_sql("x", "y")} AS r, {_ratio_sql("sx", "sy")} AS srt, CASE WHEN len(tx) = 0 OR len(ty) = 0 THEN 0.0::DOUBLE WHEN i <> '' AND (d = '' OR e = '') THEN 100.0::DOUBLE
  WHEN i = '' THEN {_ratio_sql("u", "v")} ELSE greatest({_ratio_sql("u", "v")}, {_ratio_sql("i", "u")}, {_ratio_sql("i", "v")}) END AS tst FROM {name}3)"""


_NUMBERS = "list_distinct(list_filter(list_transform(regexp_extract_all({x}, '\\b[0-9]+\\b'), lambda n: ltrim(n, '0')), lambda n: n <> ''))"
_SCORED = f"""
rec AS (SELECT entity_id, clean_name_full AS name, clean_address AS address, {_NUMBERS.format(x="clean_name_full || ' ' || clean_address")} AS nums FROM nz),
pr AS (SELECT s1_id, target_id, rank, l.name AS n1, r.name AS n2, l.address AS a1, r.address AS a2, l.nums AS m1, r.nums AS m2 FROM fin JOIN rec l ON l.entity_id = s1_id JOIN rec r ON r.entity_id = target_id),
{_compared_sql("nc", "(SELECT n1 AS x, n2 AS y FROM pr)")}, {_compared_sql("adc", "(SELECT a1 AS x, a2 AS y FROM pr)")},
pp AS (SELECT s1_id, target_id, rank, n1, n2, a1, a2, nc.tst AS nset, CASE WHEN n1 = n2 THEN 100.0::DOUBLE ELSE 0.65::DOUBLE * nc.tst + 0.35::DOUBLE * nc.srt END AS nm, 0.4::DOUBLE * adc.tst + 0.3::DOUBLE * adc.srt + 0.3::DOUBLE * adc.r AS am,
  CASE WHEN list_has_any(m1, m2) THEN 100.0::DOUBLE WHEN len(m1) > 0 AND len(m2) > 0 THEN 10.0::DOUBLE ELSE 60.0::DOUBLE END AS nu
  FROM pr JOIN nc ON nc.x = n1 AND nc.y = n2 JOIN adc ON adc.x = a1 AND adc.y = a2),
scd AS (SELECT s1_id, target_id, rank, CASE WHEN n1 = '' OR n2 = '' THEN 0.0::DOUBLE ELSE least(CASE WHEN nset < 45 THEN 30.0::DOUBLE ELSE 100.0::DOUBLE END, CASE WHEN a1 <> '' AND a2 <> '' THEN 0.5::DOUBLE * nm + 0.35::DOUBLE * am + 0.15::DOUBLE * nu ELSE 0.8::DOUBLE * nm + 0.2::DOUBLE * nu END) END AS score FROM pp),
mt AS (SELECT s1_id, target_id, score, row_number() OVER (PARTITION BY s1_id ORDER BY source, score DESC, rank) AS rank FROM (
  SELECT *, substring(target_id, 1, 2) AS source FROM scd WHERE score >= 80 QUALIFY row_number() OVER (PARTITION BY s1_id, substring(target_id, 1, 2) ORDER BY score DESC, rank) <= 1))"""


# text


@query(f"SELECT c_custkey, {_name_sql('c_name')} AS clean_name_full, {_core_sql(_name_sql('c_name'))} AS clean_name FROM customer")
def tx14_names(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select("c_custkey", tx.business_name(F.col("c_name")).alias("n"))
    return c.select("c_custkey", F.col("n.full").alias("clean_name_full"), F.col("n.core").alias("clean_name"))


@query(f"SELECT page_id, {_name_sql('url')} AS clean FROM pages")
def tx6_urls_as_names(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", tx.full_name(F.col("url")).alias("clean"))


@query(f"SELECT c_custkey, clean_address, array_to_string(regexp_extract_all(clean_address, '\\b[0-9]+\\b'), ',') AS address_numbers, 1 AS has_address FROM (SELECT c_custkey, {_address_sql('c_name')} AS clean_address FROM customer)")
def tx19_addresses(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select("c_custkey", tx.address(F.col("c_name")).alias("a"))
    return c.select("c_custkey", F.col("a.clean").alias("clean_address"), F.array_join("a.numbers", ",").alias("address_numbers"), F.col("a.has").alias("has_address"))


@query(f"WITH {_NORMALIZED} SELECT entity_id, source, country, clean_name, clean_name_full, clean_address, array_to_string(regexp_extract_all(clean_address, '\\b[0-9]+\\b'), ',') AS address_numbers, 1 AS has_address FROM nz")
def tx22_normalized(spark, sf_dir):
    return stored_form(normalized(views.part_records(spark, sf_dir)))


_PLAIN = "trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_PLAIN.format(x='text')} AS plain FROM documents")
def tx23_plain(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", tx.plain(F.col("text")).alias("plain"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(string_split(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}_]', ' ', 'g'), ' '), lambda w: regexp_full_match(w, '[0-9]+')), lambda n: ltrim(n, '0')), lambda n: n <> ''))), ',') AS numbers FROM documents")
def tx24_number_sets(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(tx.number_set(F.col("text"))), ",").alias("numbers"))


@query(f"SELECT doc_id, array_to_string({_TOKENS.format(x='text')}, ' ') AS tokens FROM documents")
def tx26_name_tokens(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.name_tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+'), ',') AS digits FROM documents")
def tx27_digit_runs(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.digit_runs(F.col("text")), ",").alias("digits"))


@query()
def tx4_folded(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", tx.fold(F.col("text")).alias("folded"))


@query("SELECT upper(trim(n_name)) AS country, count(*) AS n FROM nation GROUP BY 1")
def tx20_countries(spark, sf_dir):
    return views.table(spark, sf_dir, "nation").groupBy(tx.country(F.concat(F.lit(" "), F.lower("n_name"), F.lit("\t"))).alias("country")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, regexp_matches(text, '[^\\x00-\\x7F]') AS non_ascii FROM documents")
def fi11_non_ascii(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", tx.non_ascii(F.col("text")).alias("non_ascii"))


# blocking


@query(f"WITH {_signals_sql()} SELECT country, f AS feature, entity_id FROM b2k")
def fi3_token_postings(spark, sf_dir):
    _, t = _parts(spark, sf_dir)
    return blocking.token_postings(blocking.positions(t)).select("country", "feature", "entity_id")


@query(f"WITH {_signals_sql()} SELECT country, f AS feature, entity_id FROM c2k")
def fi4_number_postings(spark, sf_dir):
    _, t = _parts(spark, sf_dir)
    return blocking.number_postings(blocking.positions(t)).select("country", "feature", "entity_id")


@query(f"WITH {_signals_sql()} SELECT * FROM bc")
def bl10_token_candidates(spark, sf_dir):
    a, t = _parts(spark, sf_dir)
    return blocking.token_candidates(a, blocking.positions(t))


@query(f"WITH {_signals_sql()} SELECT * FROM cc")
def bl12_number_candidates(spark, sf_dir):
    a, t = _parts(spark, sf_dir)
    return blocking.number_candidates(a, blocking.positions(t))


@query(f"WITH {_signals_sql()} SELECT s1_id, target_id, round(score, 6) AS score, rank FROM ac")
def bl8_tfidf_candidates(spark, sf_dir):
    a, t = _parts(spark, sf_dir)
    return blocking.tfidf_candidates(a, blocking.positions(t)).withColumn("score", F.round("score", 6))


@query(f"WITH {_signals_sql()}, {_UNION} {_FIN}")
def bl13_union_ranked(spark, sf_dir):
    _, _, pairs = _ranked(spark, sf_dir)
    return pairs.withColumns({c: F.round(c, 6) for c in ("score_a", "score")})


@query(f"WITH {_signals_sql()}, {_UNION} SELECT entity_id AS source1_entity_id, coalesce(string_agg(target_id, ',' ORDER BY rank), '') AS candidate_entity_ids FROM s1 LEFT JOIN fin ON s1_id = entity_id GROUP BY 1")
def sk3_candidate_lists(spark, sf_dir):
    a, _, pairs = _ranked(spark, sf_dir)
    return tables.id_lists(pairs, a)


_VECTORS = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS FLOAT)) AS v FROM embeddings)"


def _vectors(spark, sf_dir):
    """Every 50th vector as a query, all vectors as targets, whatever their labels."""
    e = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity_id"), F.lit("any").alias("country"), embedding.unit(F.col("embedding")).alias("vec"))
    return e.filter("entity_id % 50 = 0"), e.withColumn("pos", F.col("entity_id"))


_NEAREST = f"""WITH e AS {_VECTORS}, s AS (SELECT q.vec_id AS s1_id, t.vec_id AS target_id, round(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(t.v AS DOUBLE[])), 6) AS score FROM e q CROSS JOIN e t WHERE q.vec_id % 50 = 0),
nn AS (SELECT s1_id, target_id, round(score, 4) AS score, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) AS rank FROM s QUALIFY rank <= 20)"""


@query(f"{_NEAREST} SELECT * FROM nn")
def tk1_exact_neighbours(spark, sf_dir):
    q, t = _vectors(spark, sf_dir)
    return embedding.exact_neighbours(q, t).withColumn("score", F.round("score", 4))


@query()
def bl5_cell_neighbours(spark, sf_dir):
    q, t = _vectors(spark, sf_dir)
    return embedding.cell_neighbours(q, t, cells=RECALL_CELLS, probes=RECALL_PROBES)


#: Cells and cells looked into where recall is measured.
RECALL_CELLS, RECALL_PROBES = 16, 12


@query(f"{_NEAREST} SELECT count(DISTINCT s1_id) AS queries, count(*) AS wanted, true AS recall_of_90_percent FROM nn")
def jn4_cell_recall(spark, sf_dir):
    q, t = _vectors(spark, sf_dir)
    exact = embedding.exact_neighbours(q, t).select("s1_id", "target_id")
    found = embedding.cell_neighbours(q, t, cells=RECALL_CELLS, probes=RECALL_PROBES).select("s1_id", "target_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["s1_id", "target_id"], "left")
    return both.agg(F.countDistinct("s1_id").alias("queries"), F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_of_90_percent"))


@query()
def bl7_embedding_candidates(spark, sf_dir):
    a, t = _parts(spark, sf_dir)
    return embedding.embedding_candidates(a, blocking.positions(t))


@query(f"""WITH s1 AS (SELECT 'S1-' || c_custkey AS entity_id, n_name AS country, {_address_sql('c_name')} AS ad FROM customer JOIN nation ON c_nationkey = n_nationkey),
s2 AS (SELECT 'S2-' || s_suppkey AS entity_id, n_name AS country, {_address_sql('s_name')} AS ad FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s1.entity_id AS s1_id, s2.entity_id AS target_id, CAST(1 AS DOUBLE) AS score, row_number() OVER (PARTITION BY s1.entity_id ORDER BY s2.entity_id) AS rank
FROM s1 JOIN s2 ON s1.country = s2.country AND regexp_extract(s1.ad, '[0-9]+') = regexp_extract(s2.ad, '[0-9]+') AND regexp_extract(s1.ad, '[0-9]+') <> '' QUALIFY rank <= 15""")
def jn3_number_join(spark, sf_dir):
    a, t = (normalized(f(spark, sf_dir)) for f in (views.customer_records, views.supplier_records))
    return blocking.number_candidates(a, blocking.positions(t, ("entity_id",)))


@query("SELECT DISTINCT p_type AS country FROM part")
def ag17_countries(spark, sf_dir):
    return blocking.countries(views.part_records(spark, sf_dir))


# matching


@query(f"WITH {_signals_sql()}, {_UNION}, {_SCORED} SELECT s1_id, target_id, rank, round(score, 6) AS score FROM scd")
def m2_pair_scores(spark, sf_dir):
    return linkage.scored(*_parts(spark, sf_dir)).withColumn("score", F.round("score", 6))


_MATCHES = f"WITH {_signals_sql()}, {_UNION}, {_SCORED} SELECT s1_id, target_id, round(score, 6) AS score, rank FROM mt"


@query(_MATCHES)
def m3_matches(spark, sf_dir):
    return linkage.matched(*_parts(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {_signals_sql()}, {_UNION}, {_SCORED} SELECT entity_id AS source1_entity_id, coalesce(string_agg(target_id, ',' ORDER BY rank), '') AS matched_entity_ids FROM s1 LEFT JOIN mt ON s1_id = entity_id GROUP BY 1")
def sk4_match_lists(spark, sf_dir):
    a, t = _parts(spark, sf_dir)
    return tables.id_lists(linkage.matched(a, t), a, "matched_entity_ids")


@query(_MATCHES)
def e2_link(spark, sf_dir):
    r = views.part_records(spark, sf_dir)
    return linkage.link(r.filter("source = 'S1'"), r.filter("source <> 'S1'")).withColumn("score", F.round("score", 6))


@query(f"WITH {_signals_sql()}, {_UNION} SELECT entity_id, 'missing' AS finding FROM s1 WHERE entity_id NOT IN (SELECT s1_id FROM fin WHERE score_b >= 4)")
def ck1_coverage(spark, sf_dir):
    a, _, pairs = _ranked(spark, sf_dir)
    results = pairs.filter("score_b >= 4").select(F.col("s1_id").alias("source1_entity_id"))
    return matching.coverage(results.distinct(), a)


# evaluation


@query(f"WITH {_signals_sql()}, {_UNION}, {_TRUTH} SELECT count(*) AS total_true_matches, count(f.s1_id) AS found_true_matches, CASE WHEN count(*) > 0 THEN count(f.s1_id) / count(*) ELSE 0 END AS candidate_recall FROM tp LEFT JOIN fin f USING (s1_id, target_id)")
def ev1_recall(spark, sf_dir):
    a, t, pairs = _ranked(spark, sf_dir)
    return evaluation.candidate_recall(pairs, _true_by_name(a, t))


@query(f"""WITH {_signals_sql(top_b=50, top_c=20)}, {_UNION_50}, {_TRUTH}, ks AS (SELECT unnest([5, 10, 15, 20, 30, 50]) AS k), n AS (SELECT (SELECT count(*) FROM s1) AS n1, (SELECT count(*) FROM tg) AS n2, (SELECT count(*) FROM tp) AS tt)
SELECT CAST(k AS INTEGER) AS k, pairs, found AS found_true_matches, tt AS total_true_matches, CASE WHEN tt > 0 THEN found / tt ELSE 0 END AS candidate_recall, round(pairs / n1, 6) AS candidates_per_anchor, round(1 - pairs / (CAST(n1 AS DOUBLE) * n2), 9) AS reduction_ratio
FROM (SELECT k, (SELECT count(*) FROM fin WHERE rank <= k) AS pairs, (SELECT count(*) FROM fin JOIN tp USING (s1_id, target_id) WHERE rank <= k) AS found FROM ks) CROSS JOIN n""")
def ev4_sweep(spark, sf_dir):
    most = max(evaluation.SWEEP)
    a, t, pairs = _ranked(spark, sf_dir, most, 20)
    return evaluation.sweep(pairs, _true_by_name(a, t), a.count(), t.count())


def _alone(k, src, weight):
    return f"SELECT '{k}' AS signal, count(*) AS total_true_matches, count(f.s1_id) AS found_true_matches, CASE WHEN count(*) > 0 THEN count(f.s1_id) / count(*) ELSE 0 END AS candidate_recall FROM tp LEFT JOIN (SELECT s1_id, target_id FROM {src} QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, target_id) <= 20) f USING (s1_id, target_id)"


@query(f"WITH {_signals_sql()}, {_TRUTH} {_alone('a', 'ac', 1.0)} UNION ALL {_alone('b', 'bc', 0.35)} UNION ALL {_alone('c', 'cc', 0.25)}")
def ev5_ablation(spark, sf_dir):
    a, t, s = _signals(spark, sf_dir)
    return evaluation.ablation(a, s, _true_by_name(a, t))


@query(f"""WITH {_signals_sql()}, {_UNION}, {_TRUTH}, pr AS (SELECT DISTINCT s1_id, target_id FROM fin WHERE rank <= 2),
x AS (SELECT entity_id, (SELECT count(*) FROM pr WHERE s1_id = entity_id) AS p, (SELECT count(*) FROM tp WHERE s1_id = entity_id) AS t, (SELECT count(*) FROM pr JOIN tp USING (s1_id, target_id) WHERE s1_id = entity_id) AS h FROM s1)
SELECT count(*) AS n_anchors, round(avg(CASE WHEN t = 0 THEN CASE WHEN p = 0 THEN 1 ELSE 0 END WHEN h = 0 THEN 0 ELSE 1.25 * (h / p) * (h / t) / (0.25 * (h / p) + h / t) END), 9) AS macro_f FROM x""")
def ev6_macro_f(spark, sf_dir):
    a, t, pairs = _ranked(spark, sf_dir)
    return evaluation.macro_f(pairs.filter("rank <= 2"), _true_by_name(a, t), a)


@query(f"WITH {_signals_sql()}, {_UNION}, n AS (SELECT entity_id, (SELECT count(*) FROM fin WHERE s1_id = entity_id AND score_c > 0) AS n FROM s1) SELECT count(*) AS anchors, sum(n)::BIGINT AS pairs, round(sum(n) / count(*), 6) AS pairs_per_anchor, count(*) FILTER (n = 0) AS without FROM n")
def ag8_totals(spark, sf_dir):
    a, _, pairs = _ranked(spark, sf_dir)
    return evaluation.totals(pairs.filter("score_c > 0"), a)


# validation


@query(f"""WITH {_signals_sql()}, {_UNION}, rows AS (SELECT s1_id AS s1, target_id AS id, rank FROM fin WHERE rank <= 3), ids AS (SELECT CASE WHEN rank = 3 THEN replace(id, 'S3-', 'S1-') ELSE id END AS id FROM rows),
f AS (SELECT 'self_match' AS rule, id AS x FROM ids WHERE id LIKE 'S1-%' UNION SELECT 'missing_anchor', entity_id FROM s1 WHERE entity_id NOT IN (SELECT s1 FROM rows)
  UNION SELECT 'unknown_id', id FROM ids WHERE id LIKE 'S3-%')
SELECT 'rows' AS file, 'error' AS severity, rule, count(*) AS n, array_to_string(list_sort(list(x))[1:5], ',') AS examples FROM f GROUP BY rule""")
def va1_row_findings(spark, sf_dir):
    a, t, pairs = _ranked(spark, sf_dir)
    fin = scratch.stored(pairs.filter("rank <= 3"), "fin")
    rows = fin.withColumn("target_id", F.when(F.col("rank") == 3, F.replace("target_id", F.lit("S3-"), F.lit("S1-"))).otherwise(F.col("target_id"))).groupBy(F.col("s1_id").alias("s1")).agg(F.collect_list("target_id").alias("ids"))
    valid = t.filter("source = 'S2'").select(F.col("entity_id").alias("id"))
    found = validation.row_findings(rows, "rows", a, valid)
    return found.withColumn("examples", F.array_join("examples", ","))


@query(f"WITH {_signals_sql()}, x AS (SELECT DISTINCT s1_id FROM (SELECT s1_id, target_id FROM cc ANTI JOIN bc USING (s1_id, target_id))) SELECT 'matching' AS file, 'warning' AS severity, 'match_not_candidate' AS rule, count(*) AS n, array_to_string(list_sort(list(s1_id))[1:5], ',') AS examples FROM x HAVING count(*) > 0")
def jn12_not_candidates(spark, sf_dir):
    a, t, s = _signals(spark, sf_dir)
    rows = lambda df: df.groupBy(F.col("s1_id").alias("s1")).agg(F.collect_list("target_id").alias("ids"))
    return validation.not_candidates(rows(s["c"]), rows(s["b"])).withColumn("examples", F.array_join("examples", ","))


# profiles


@query("""SELECT count(*) AS rows, 0 AS missing_entity_id, count(*) FILTER (coalesce(business_name, '') = '') AS missing_business_name, count(*) FILTER (business_address = '') AS missing_business_address, 0 AS missing_country, 0 AS missing_source,
 round(avg(length(business_name)), 6) AS avg_len_business_name, max(length(business_name)) AS max_len_business_name, 0 AS non_ascii_pct_business_name,
 round(avg(length(business_address)), 6) AS avg_len_business_address, max(length(business_address)) AS max_len_business_address, 0 AS non_ascii_pct_business_address FROM (""" + views.PART_RECORDS + ")")
def pr1_profile(spark, sf_dir):
    return profiling.profile(views.part_records(spark, sf_dir))


@query("SELECT count(*) AS rows, count(*) FILTER (text = '') AS missing_text, round(avg(length(text)), 6) AS avg_len_text, max(length(text)) AS max_len_text, round(avg(CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 100.0 ELSE 0 END), 6) AS non_ascii_pct_text FROM documents")
def ag13_text_lengths(spark, sf_dir):
    return profiling.profile(views.table(spark, sf_dir, "documents").select("text"), ("text",))


@query("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def ag10_value_counts(spark, sf_dir):
    return profiling.value_counts(views.table(spark, sf_dir, "orders"), "o_orderpriority")


@query("SELECT count(*) FILTER (event_id IS NULL) AS event_id, count(*) FILTER (ts IS NULL) AS ts, count(*) FILTER (user_id IS NULL) AS user_id, count(*) FILTER (event_type IS NULL) AS event_type, count(*) FILTER (value IS NULL) AS value, count(*) FILTER (props IS NULL) AS props FROM events")
def ag12_null_counts(spark, sf_dir):
    return profiling.null_counts(views.table(spark, sf_dir, "events"))


@query("SELECT count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.75), 6) AS p75, max(l_quantity) AS max FROM lineitem")
def ag16_describe(spark, sf_dir):
    return profiling.describe(views.table(spark, sf_dir, "lineitem"), "l_quantity")


_COUNTS = "(SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) AS n_s2, count(*) FILTER (o_orderkey % 2 = 1) AS n_s3 FROM orders GROUP BY 1)"


def _order_truth(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("S2-")).otherwise(F.lit("S3-")), F.col("o_orderkey").cast("string")).alias("id"))
    return o.groupBy(F.concat(F.lit("S1-"), F.col("o_custkey").cast("string")).alias("source1_entity_id")).agg(F.array_join(F.collect_list("id"), ", ").alias("matched_entity_ids"))


@query(f"SELECT n, count(*) AS anchors, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM {_COUNTS} GROUP BY 1")
def ag14_match_histogram(spark, sf_dir):
    return profiling.match_histogram(profiling.match_counts(_order_truth(spark, sf_dir)))


@query(f"SELECT count(*) AS anchors, 0 AS singletons, sum(n)::BIGINT AS matches, sum(n_s2)::BIGINT AS matches_s2, sum(n_s3)::BIGINT AS matches_s3, max(n) AS max_matches, round(avg(n), 6) AS mean_matches, max(n_s2) AS max_s2, max(n_s3) AS max_s3 FROM {_COUNTS}")
def ag15_match_summary(spark, sf_dir):
    return profiling.match_summary(profiling.match_counts(_order_truth(spark, sf_dir)))


@query("""SELECT count(*) AS checked, count(*) FILTER (s.s_nationkey IS NOT NULL AND c_nationkey <> s.s_nationkey) AS mismatched FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier s ON o_orderkey = s_suppkey""")
def pr3_cross_country(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("s1_id"), F.col("o_orderkey").cast("string").alias("target_id"))
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"), F.col("c_nationkey").alias("country"))
    s = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("entity_id"), F.col("s_nationkey").alias("country"))
    return profiling.cross_country(o, c, s)


@query(f"WITH {_signals_sql()}, {_TRUTH} SELECT s1_id, target_id, a.business_name AS a_business_name, a.business_address AS a_business_address, a.country AS a_country, t.business_name AS t_business_name, t.business_address AS t_business_address, t.country AS t_country FROM tp JOIN raw a ON a.entity_id = s1_id JOIN raw t ON t.entity_id = target_id ORDER BY 1, 2 LIMIT 10")
def jn11_examples(spark, sf_dir):
    r = views.part_records(spark, sf_dir)
    a, t = _parts(spark, sf_dir)
    return profiling.match_examples(_truth(a, t), r.filter("source = 'S1'"), r.filter("source <> 'S1'"))


@query("SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def ag18_duplicates(spark, sf_dir):
    return profiling.duplicates(views.table(spark, sf_dir, "part"), "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def sc3_first_rows(spark, sf_dir):
    return tables.first_rows(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@query("SELECT CASE WHEN o_orderstatus IN ('NA', 'NaN', 'null', '') THEN NULL ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def sc5_lenient_scan(spark, sf_dir):
    return tables.missing_as_null(views.table(spark, sf_dir, "orders").select("o_orderstatus")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(f"WITH {_NORMALIZED} SELECT entity_id, {_PLAIN.format(x='clean_name_full')} AS name, {_PLAIN.format(x='clean_address')} AS address FROM nz")
def sc10_flat_records(spark, sf_dir):
    return tables.flat_records(normalized(views.part_records(spark, sf_dir)))


@query("SELECT 'S1-' || o_custkey AS s1_id, (CASE WHEN o_orderkey % 2 = 0 THEN 'S2-' ELSE 'S3-' END) || o_orderkey AS target_id FROM orders")
def sc11_truth_pairs(spark, sf_dir):
    return tables.truth_pairs(_order_truth(spark, sf_dir))


# cases written out


def _cases(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@query(goldens.values([(i, *r[3:]) for i, r in enumerate(goldens.RECORDS)], "n, clean_name, clean_name_full, clean_address, address_numbers, has_address, country"))
def tx21_written_records(spark, sf_dir):
    df = _cases(spark, [(str(i), *r[:3]) for i, r in enumerate(goldens.RECORDS)], "entity_id string, business_name string, business_address string, country string")
    return stored_form(normalized(df)).select(F.col("entity_id").cast("int").alias("n"), "clean_name", "clean_name_full", "clean_address", "address_numbers", "has_address", "country")


@query(goldens.values([(i, r[1]) for i, r in enumerate(goldens.CORE)], "n, core"))
def tx25_core_tokens(spark, sf_dir):
    return _cases(spark, [(i, r[0]) for i, r in enumerate(goldens.CORE)], "n int, name string").select("n", tx.core_tokens(F.col("name")).alias("core"))


@query(goldens.values([(i, *r[1:]) for i, r in enumerate(goldens.TEXTS)], "n, path, passage, ids"))
def tx29_tx31_written_texts(spark, sf_dir):
    x = F.col("x")
    return _cases(spark, [(i, r[0]) for i, r in enumerate(goldens.TEXTS)], "n int, x string").select("n", tx.path_safe(x).alias("path"), tx.encoder_text(x, "passage").alias("passage"), F.array_join(tx.id_list(x), "|").alias("ids"))


@query(goldens.values([(i, *r[2:]) for i, r in enumerate(goldens.SIMILARITIES)], "n, ratio, token_sort, token_set"))
def sim_written_pairs(spark, sf_dir):
    df = _cases(spark, [(i, *r[:2]) for i, r in enumerate(goldens.SIMILARITIES)], "n int, a string, b string")
    a, b = F.col("a"), F.col("b")
    return df.select("n", F.round(sim.ratio(a, b), 6).alias("ratio"), F.round(sim.token_sort_ratio(a, b), 6).alias("token_sort"), F.round(sim.token_set_ratio(a, b), 6).alias("token_set"))


@query(goldens.values([(i, r[4]) for i, r in enumerate(goldens.PAIRS)], "n, score"))
def m2_written_pairs(spark, sf_dir):
    rows = [(f"S{s}-{i}", r[2 * s - 2], r[2 * s - 1]) for i, r in enumerate(goldens.PAIRS) for s in (1, 2)]
    pairs = _cases(spark, [(f"S1-{i}", f"S2-{i}", i) for i in range(len(goldens.PAIRS))] + [("S1-0", "S2-999", -1)], "s1_id string, target_id string, n int")
    return matching.scored_pairs(pairs, _cases(spark, rows, "entity_id string, name string, address string")).select("n", F.round("score", 6).alias("score"))


@query(goldens.values(goldens.RESULT_FINDINGS, "rule, n, examples"))
def vr_written_rows(spark, sf_dir):
    rows = _cases(spark, goldens.RESULT_ROWS, "s1 string, ids array<string>")
    anchors = _cases(spark, [(f"S1-{i}",) for i in range(1, 5)], "entity_id string")
    found = validation.row_findings(rows, "rows", anchors, _cases(spark, [("S2-1",), ("S2-2",), ("S3-1",)], "id string"))
    return found.select("rule", "n", F.array_join("examples", ",").alias("examples"))


@query(goldens.values([("S1-1", 1, "S2-9"), ("S1-1", 2, "S3-2"), ("S1-2", 1, "")], "s1, place, target"))
def tk5_written_matches(spark, sf_dir):
    scored = _cases(spark, [("S1-1", "S2-9", 90.0, 1), ("S1-1", "S2-1", 90.0, 2), ("S1-1", "S3-1", 85.0, 3), ("S1-1", "S3-2", 95.0, 4), ("S1-1", "S2x", 99.0, 5)], "s1_id string, target_id string, score double, rank int")
    lists = matching.with_all_anchors(matching.best_matches(scored), _cases(spark, [("S1-1",), ("S1-2",)], "entity_id string"))
    return lists.select(F.col("source1_entity_id").alias("s1"), F.posexplode(F.split("matched_entity_ids", ",")).alias("place", "target")).withColumn("place", F.col("place") + 1)


@query("SELECT * FROM (VALUES ('blocking.final_top', '20'), ('blocking.min_similarity', '0.25'), ('blocking.number_postings', '2000'), ('blocking.number_top', '15'), ('blocking.token_postings', '5000'), ('blocking.token_top', '20'), ('matching.max_per_source', '1'), ('matching.threshold', '80.0')) t(name, value)")
def cf1_configuration(spark, sf_dir):
    return _cases(spark, linkage.configuration(), "name string, value string").filter("name like 'matching.%' or name like 'blocking.%' and name not in ('blocking.weights', 'blocking.embedding_top')")


@query("SELECT o_custkey, o_orderkey FROM orders")
def sc4_two_columns(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")


@query(f"WITH {_signals_sql()}, {_UNION} SELECT entity_id FROM s1 WHERE entity_id NOT IN (SELECT s1_id FROM fin WHERE score_a > 0.999)")
def tk7_missing_anchors(spark, sf_dir):
    a, _, pairs = _ranked(spark, sf_dir)
    results = pairs.filter("score_a > 0.999").select(F.col("s1_id").alias("source1_entity_id"))
    return matching.coverage(results.distinct(), a).filter("finding = 'missing'").select("entity_id").orderBy("entity_id")
