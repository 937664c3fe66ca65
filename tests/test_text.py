import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylink.functions import scripts
from quarrylink.functions import similarity as sim
from quarrylink.functions import text as tx
from quarrylink.operators.normalize import normalize_record, normalized, stored_form

PAIRS = [
    ("Ram Marketing Private Limited", "KH No. 570/13, New Delhi, Delhi", "ram marketing", "ram marketing pvt ltd", "kh no 570 13 new delhi delhi", "570,13"),
    ("राम मार्केटिंग प्राइवेट लिमिटेड", "KH NO. -570/13, NEW DELHI, WEST DELHI, Delhi", "ram marketing", "ram marketing pvt ltd", "kh no 570 13 new delhi west delhi delhi", "570,13"),
    ("आदित्य प्रॉपर्टीज एलएलपी", "G-3/571, GULMOHAR COLONY, BHOPAL, Madhya Pradesh", "aditya properties", "aditya properties llp", "g 3 571 gulmohar colony bhopal madhya pradesh", "3,571"),
    ("Global Business Private Limited", "#C-21 - S, Ambattur, Chennai, Tamil Nadu", "global business", "global business pvt ltd", "c 21 s ambattur chennai tamil nadu", "21"),
    ("குளோபல் பிசினஸ் பிரைவேட் லிமிடெட்", "#C-21 - S, AMBATTUR, CHENNAI, Tamil Nadu", "global business", "global business pvt ltd", "c 21 s ambattur chennai tamil nadu", "21"),
    ("Thermal & Fils SASU", "20 Rue Parmentier, Dunkerque, Hauts-de-France", "thermal et fils", "thermal et fils sas", "20 rue parmentier dunkerque hauts de france", "20"),
    ("<< Team Ecole SARL", "175 BD DU PRESIDENT FRANKLIN ROOSEVELT, BORDEAUX", "team ecole", "team ecole sarl", "175 blvd du president franklin roosevelt bordeaux", "175"),
    ("siiainvestments.com", "8411 GABRIELINO COURT, PMB 9239, RANCHO CUCAMONGA, CA", "siiainvestments", "siiainvestments", "8411 gabrielino ct pmb 9239 rancho cucamonga ca", "8411,9239"),
    ("Mirapyra formerly Painters Local Union 634", "AL, Madison, 25807 Iron Gate Drive", "painters local union 634", "painters local union 634", "al madison 25807 iron gate dr", "25807"),
    ("Gautam Nagar Recording Prívate Limited", "दिल्ली, K-00303, New Delhi, Gautam Nagar", "gautam nagar recording", "gautam nagar recording pvt ltd", "delhi k 303 new delhi gautam nagar", "303"),
]


def test_record_pairs(spark):
    df = spark.createDataFrame([(f"S1-{i}", p[0], p[1], " india ") for i, p in enumerate(PAIRS)], "entity_id string, business_name string, business_address string, country string")
    rows = {r["entity_id"]: r for r in stored_form(normalized(df)).collect()}
    for i, p in enumerate(PAIRS):
        r = rows[f"S1-{i}"]
        assert (r["clean_name"], r["clean_name_full"], r["clean_address"], r["address_numbers"], r["has_address"], r["country"]) == (*p[2:], 1, "INDIA")


@pytest.mark.parametrize(
    ("raw", "core", "full"),
    [
        ("X Limited Liability Company", "x liability", "x ltd liability co"),
        ("Golden One Private Ltd", "golden one private", "golden one private ltd"),
        ("Acme L.L.C.", "acme l l c", "acme l l c"),
        ("## formerly Acme", "formerly acme", "formerly acme"),
        ("Pvt Ltd", "pvt ltd", "pvt ltd"),
        ("Acme - 2067865001", "acme", "acme"),
        ("https://www.Œuvre-Straße.co.in", "oeuvre strasse", "oeuvre strasse"),
        ("ﬁlm ½ ①", "film 1 2 1", "film 1 2 1"),
        ("", "", ""),
        (None, "", ""),
    ],
)
def test_names(spark, raw, core, full):
    r = spark.createDataFrame([(raw,)], "x string").select(tx.business_name(F.col("x")).alias("n")).first()["n"]
    assert (r["core"], r["full"]) == (core, full)


@pytest.mark.parametrize(
    ("raw", "clean", "numbers", "has"),
    [
        ("Charleston, West Virginia", "charleston west va", [], 1),
        ("220a Sector 11", "220a sector 11", ["11"], 1),
        ("1st Floor", "fl", [], 1),
        ("4th Floor", "4th fl", [], 1),
        ("Plot 000", "plot 0", ["0"], 1),
        ("12 St. B/H Mall, H.No 7", "12 st behind mall no 7", ["12", "7"], 1),
        ("--", "", [], 1),
        ("   ", "", [], 0),
        (None, "", [], 0),
    ],
)
def test_addresses(spark, raw, clean, numbers, has):
    r = spark.createDataFrame([(raw,)], "x string").select(tx.address(F.col("x")).alias("a")).first()["a"]
    assert (r["clean"], r["numbers"], r["has"]) == (clean, numbers, has)


def test_tokens_and_numbers(spark):
    r = spark.createDataFrame([("The ACME of a 7 co-op Acme", "220a 11 000 007", "S2-1, ,S3-2,")], "n string, a string, l string").select(
        tx.name_tokens(F.col("n")).alias("t"), tx.digit_runs(F.col("a")).alias("d"), tx.number_set(F.col("a")).alias("s"), tx.id_list(F.col("l")).alias("l"), tx.id_list(F.col("l"), True).alias("le"),
        tx.core_tokens(F.lit("acme tech group")).alias("c"), tx.core_tokens(F.lit("tech group")).alias("c2"), tx.plain(F.lit("Été_9 दिल्ली x!")).alias("p"),
        tx.encoder_text(F.lit("a"), "query").alias("q"), tx.path_safe(F.lit("Côte d'Ivoire")).alias("ps"),
    ).first()
    assert r["t"] == ["acme", "op", "acme"]
    assert (r["d"], r["s"]) == (["220", "11", "000", "007"], ["11", "7"])
    assert (r["l"], r["le"]) == (["S2-1", "S3-2"], ["S2-1", "", "S3-2", ""])
    assert (r["c"], r["c2"], r["p"], r["q"], r["ps"]) == ("acme", "tech group", "été_9 द ल ल x", "query: a", "C_te_d_Ivoire")


def test_letters_follow_the_blocks():
    letters = scripts.indic_letters()
    assert letters["क"] == "k" and letters["ক"] == "k" and letters["ક"] == "k" and letters["ಕ"] == "k" and letters["క"] == "k" and letters["க"] == "k"
    assert letters["ব"] == "v" and letters["த"] == "th" and letters["ழ"] == "zh" and letters["ऋ"] == "ri"
    assert "ಋ" not in letters and "ॉ" not in letters and letters["्"] == ""


def test_record_struct(spark):
    r = spark.range(1).select(normalize_record(F.lit("Acme Ltd"), F.lit("1 Main Street"), F.lit("us")).alias("r")).first()["r"]
    assert r.asDict() == {"clean_name": "acme", "clean_name_full": "acme ltd", "clean_address": "1 main st", "address_numbers": ["1"], "has_address": 1, "country": "US"}


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc é", max_size=30), st.text("abc é", max_size=30))
def test_common_subsequence(a, b):
    assert sim.common_subsequence(a, b) == _lcs(a, b)


def test_similarity(spark):
    df = spark.createDataFrame([("abc", "abd"), ("lowe galata", "galata lowe"), ("apollo pharmacy", "apollo pharmacy pvt ltd"), ("a b", "a c"), ("", "x"), ("", "")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(sim.ratio(a, b).alias("r"), sim.token_sort_ratio(a, b).alias("s"), sim.token_set_ratio(a, b).alias("t")).collect()
    assert [round(r["r"], 4) for r in rows][0] == 66.6667 and rows[5]["r"] == 100
    assert rows[1]["s"] == 100 and rows[2]["t"] == 100 and round(rows[3]["t"], 4) == 66.6667 and rows[4]["t"] == 0
