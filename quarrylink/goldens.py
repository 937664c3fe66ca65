"""Small tables of cases with their expected results written out, for queries and tests."""

from __future__ import annotations

#: raw name, raw address, country, then clean_name, clean_name_full, clean_address, address_numbers, has_address, country
RECORDS = [
    ("Ram Marketing Private Limited", "KH No. 570/13, New Delhi, Delhi", "India", "ram marketing", "ram marketing pvt ltd", "kh no 570 13 new delhi delhi", "570,13", 1, "INDIA"),
    ("राम मार्केटिंग प्राइवेट लिमिटेड", "KH NO. -570/13, NEW DELHI, WEST DELHI, Delhi", "India", "ram marketing", "ram marketing pvt ltd", "kh no 570 13 new delhi west delhi delhi", "570,13", 1, "INDIA"),
    ("Aditya Properties LLP", "G-3/571, Gulmohar Colony, Bhopal, Madhya Pradesh", "India", "aditya properties", "aditya properties llp", "g 3 571 gulmohar colony bhopal madhya pradesh", "3,571", 1, "INDIA"),
    ("आदित्य प्रॉपर्टीज एलएलपी", "G-3/571, GULMOHAR COLONY, BHOPAL, Madhya Pradesh", "India", "aditya properties", "aditya properties llp", "g 3 571 gulmohar colony bhopal madhya pradesh", "3,571", 1, "INDIA"),
    ("குளோபல் பிசினஸ் பிரைவேட் லிமிடெட்", "#C-21 - S, AMBATTUR, CHENNAI, Tamil Nadu", "India", "global business", "global business pvt ltd", "c 21 s ambattur chennai tamil nadu", "21", 1, "INDIA"),
    ("Thermal & Fils SASU", "20 Rue Parmentier, Dunkerque, Hauts-de-France", "France", "thermal et fils", "thermal et fils sas", "20 rue parmentier dunkerque hauts de france", "20", 1, "FRANCE"),
    ("<< Team Ecole SARL", "175 BD DU PRESIDENT FRANKLIN ROOSEVELT, BORDEAUX", "France", "team ecole", "team ecole sarl", "175 blvd du president franklin roosevelt bordeaux", "175", 1, "FRANCE"),
    ("Siia Investments Inc", "8411 Gabrielino Court, Rancho Cucamonga, CA", " us ", "siia investments", "siia investments inc", "8411 gabrielino ct rancho cucamonga ca", "8411", 1, "US"),
    ("siiainvestments.com", "8411 GABRIELINO COURT, PMB 9239, RANCHO CUCAMONGA, CA", "US", "siiainvestments", "siiainvestments", "8411 gabrielino ct pmb 9239 rancho cucamonga ca", "8411,9239", 1, "US"),
    ("Mirapyra formerly Painters Local Union 634", "AL, Madison, 25807 Iron Gate Drive", "US", "painters local union 634", "painters local union 634", "al madison 25807 iron gate dr", "25807", 1, "US"),
    ("Gautam Nagar Recording Prívate Limited", "दिल्ली, K-00303, New Delhi, Gautam Nagar", "India", "gautam nagar recording", "gautam nagar recording pvt ltd", "delhi k 303 new delhi gautam nagar", "303", 1, "INDIA"),
    ("X Limited Liability Company", "Charleston, West Virginia", "US", "x liability", "x ltd liability co", "charleston west va", "", 1, "US"),
    ("Golden One Private Ltd", "Springfield, Ohio", "US", "golden one private", "golden one private ltd", "springfield oh", "", 1, "US"),
    ("Acme L.L.C.", "220a Sector 11", "US", "acme l l c", "acme l l c", "220a sector 11", "11", 1, "US"),
    ("## formerly Acme", "4th Floor", "US", "formerly acme", "formerly acme", "4th fl", "", 1, "US"),
    ("Pvt Ltd", "Plot 000", "US", "pvt ltd", "pvt ltd", "plot 0", "0", 1, "US"),
    ("Acme - 2067865001", "--", "US", "acme", "acme", "", "", 1, "US"),
    (None, "   ", None, "", "", "", "", 0, ""),
]
#: plain name, its core tokens
CORE = [("acme group", "acme"), ("acme holdings international ltd", "acme"), ("tech services", "tech services"), ("blue sky", "blue sky"), ("", "")]
#: value, form fit for a path, encoder's text of a passage, ids of the comma list
TEXTS = [("United States/FR", "United_States_FR", "passage: United States/FR", "United States/FR"), (" a, ,b ,", "_a_b_", "passage:  a, ,b ,", "a|b"), (None, "", "passage: ", "")]
#: two names with addresses; the score of the pair
PAIRS = [
    ("acme", "", "acme", "", 92.0),
    ("acme 1", "", "acme 1", "2", 100.0),
    ("acme", "main st", "acme", "main st", 94.0),
    ("acme", "12 main st", "acme", "12 main st", 100.0),
    ("", "main st", "acme", "main st", 0.0),
    ("lowe galata", "", "galata lowe", "", 92.0),
    ("abc", "", "xyz", "", 12.0),
]
#: two texts, then ratio, token sort and token set
SIMILARITIES = [
    ("abc", "abd", 66.666667, 66.666667, 66.666667),
    ("lowe galata", "galata lowe", 54.545455, 100.0, 100.0),
    ("apollo pharmacy", "apollo pharmacy pvt ltd", 78.947368, 78.947368, 100.0),
    ("a b", "a c", 66.666667, 66.666667, 66.666667),
    ("", "", 100.0, 100.0, 0.0),
    ("abc", "", 0.0, 0.0, 0.0),
]
#: anchor rows of a result file with their ids; anchors are S1-1 to S1-4, known targets S2-1, S2-2, S3-1
RESULT_ROWS = [("S1-1", ["S2-1", "S2-2"]), ("S1-1", ["S3-1"]), ("S1-2", ["S2-1", "S2-1"]), ("S1-3", ["S1-4", "X9-1", " S2-1", "S2-9"]), ("S1-9", [])]
#: rule, number of offenders, the first of them
RESULT_FINDINGS = [
    ("duplicate_id_in_list", 1, "S1-2"), ("duplicate_row", 1, "S1-1"), ("missing_anchor", 1, "S1-4"), ("self_match", 1, "S1-4"), ("unexpected_anchor", 1, "S1-9"),
    ("unknown_id", 1, "S2-9"), ("wrong_prefix", 2, " S2-1,X9-1"),
]


def values(rows: list[tuple], columns: str) -> str:
    """SQL for rows that are written out."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({columns})"
