"""Normalization of business names, addresses and countries as Column expressions.

Everything runs inside the JVM. Texts in ASCII, the bulk, skip the folding of other scripts.
The order of steps within each function is part of its meaning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylink.functions.scripts import LIGATURES, fold_tables

# Business and place terms of Indic scripts.
INDIC_TERMS = {
    "प्राइवेट लिमिटेड": "pvt ltd", "प्रा. लि.": "pvt ltd", "प्रा० लि०": "pvt ltd", "प्रा लि": "pvt ltd", "लिमिटेड": "ltd", "लि.": "ltd", "एलएलपी": "llp",
    "मार्केटिंग": "marketing", "कंस्ट्रक्शंस": "constructions", "कंस्ट्रक्शन": "construction", "प्रॉपर्टीज": "properties", "प्रॉपर्टी": "property",
    "एंटरप्राइजेज": "enterprises", "एंटरप्राइज": "enterprise", "ट्रेडर्स": "traders", "ट्रेडिंग": "trading", "सर्विसेज": "services", "सर्विस": "service",
    "सॉल्यूशंस": "solutions", "टेक्नोलॉजीज": "technologies", "टेक्नोलॉजी": "technology", "कंसल्टेंट्स": "consultants", "कंसल्टिंग": "consulting",
    "फूड्स": "foods", "फूड": "food", "हेल्थकेयर": "healthcare", "फार्मा": "pharma", "फाउंडेशन": "foundation", "इंफ्राकॉन": "infracon",
    "इंफ्रास्ट्रक्चर": "infrastructure", "एजेंसी": "agency", "हॉस्पिटल": "hospital", "विद्यालय": "vidyalaya", "इंटरनेशनल": "international",
    "ग्लोबल": "global", "उद्योग": "udyog", "व्यापार": "vyapar",
    "दिल्ली": "delhi", "नई दिल्ली": "new delhi", "हरियाणा": "haryana", "महाराष्ट्र": "maharashtra", "पंजाब": "punjab", "उत्तर प्रदेश": "uttar pradesh",
    "मध्य प्रदेश": "madhya pradesh", "गुजरात": "gujarat", "राजस्थान": "rajasthan", "कर्नाटक": "karnataka", "कोलकाता": "kolkata", "मुंबई": "mumbai",
    "पुणे": "pune", "अहमदाबाद": "ahmedabad", "हैदराबाद": "hyderabad", "चेन्नई": "chennai", "बेंगलुरु": "bengaluru",
    "பிரைவேட் லிமிடெட்": "pvt ltd", "லிமிடெட்": "ltd", "குளோபல்": "global", "பிசினஸ்": "business", "தமிழ்நாடு": "tamil nadu", "சென்னை": "chennai",
    "ಕರ್ನಾಟಕ": "karnataka", "ಬೆಂಗಳೂರು": "bangalore",
}

# Legal forms, applied in this order.
LEGAL_FORMS = [
    (r"\bprivate\s+limited\b|\bpvt\s+ltd\b|\bp\s+ltd\b|\bp\.\s*ltd\b|\bp\s+limited\b", "pvt ltd"),
    (r"\bpublic\s+limited\b|\bpub\s+ltd\b", "pub ltd"),
    (r"\blimited\b|\bltd\b|\bltd\.", "ltd"),
    (r"\blimited\s+liability\s+partnership\b|\bllp\b", "llp"),
    (r"\blimited\s+liability\s+company\b|\bllc\b", "llc"),
    (r"\bincorporated\b|\binc\b", "inc"),
    (r"\bcorporation\b|\bcorp\b", "corp"),
    (r"\bcompany\b|\bco\b", "co"),
    (r"\bprofessional\s+corporation\b|\bpc\b", "pc"),
    (r"\blimited\s+partnership\b|\blp\b", "lp"),
    (r"\bsociete\s+a\s+responsabilite\s+limitee\b|\bsarl\b", "sarl"),
    (r"\bsociete\s+par\s+actions\s+simplifiee\b|\bsasu\b|\bsas\b", "sas"),
    (r"\bentreprise\s+unipersonnelle\s+a\s+responsabilite\s+limitee\b|\beurl\b", "eurl"),
    (r"\bet\s+fils\b|\band\s+fils\b", "et fils"),
]
# Fixed value: legal tokens that a core name does without.
LEGAL_TOKENS = r"\b(?:pvt ltd|pub ltd|ltd|llp|llc|inc|corp|co|pc|lp|sarl|sas|sasu|eurl)\b"

# Address words, applied in this order before punctuation goes.
ADDRESS_WORDS = [
    (r"\bstreet\b|\bst\b|\bst\.", "st"),
    (r"\broad\b|\brd\b|\brd\.", "rd"),
    (r"\bavenue\b|\bave\b|\bave\.", "ave"),
    (r"\bboulevard\b|\bblvd\b|\bbld\b|\bbd\b|\bbd\.", "blvd"),
    (r"\bdrive\b|\bdr\b|\bdr\.", "dr"),
    (r"\blane\b|\bln\b|\bln\.", "ln"),
    (r"\bcourt\b|\bct\b|\bct\.", "ct"),
    (r"\bhighway\b|\bhwy\b", "hwy"),
    (r"\bcircle\b|\bcir\b", "cir"),
    (r"\bparkway\b|\bpkwy\b", "pkwy"),
    (r"\btrail\b|\btrl\b", "trail"),
    (r"\bapartment\b|\bapt\b|\bflat\s+no\b|\bflat\b", "apt"),
    (r"\bsuite\b|\bste\b|\bunit\b|\broom\b|\brm\b", "unit"),
    (r"\bfloor\b|\bfl\b|\b1st\s+floor\b|\b2nd\s+floor\b|\b3rd\s+floor\b", "fl"),
    (r"\bbuilding\b|\bbldg\b", "bldg"),
    (r"\bopposite\b|\bopp\b|\bopp\.", "opp"),
    (r"\bbehind\b|\bb/h\b|\bb-h\b", "behind"),
    (r"\bnear\b|\bnr\b|\bnr\.", "near"),
    (r"\bhouse\s+no\b|\bh\.no\b|\bhn\b|\bplot\s+no\b|\bpt\s+no\b", "no"),
]
# States of the US in the order of replacement (virginia comes before west virginia).
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky",
    "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
    "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny",
    "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri",
    "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}

# Tokens of names that say nothing.
STOP_TOKENS = (
    "the", "and", "or", "of", "for", "in", "on", "at", "to", "a", "an", "co", "company", "corp", "corporation", "inc", "incorporated", "llc", "ltd",
    "limited", "pvt", "private", "plc", "llp", "india", "ind", "usa", "us", "france", "fr",
)
# Suffixes that core_tokens drops.
SUFFIX_TOKENS = (
    "inc", "incorporated", "corp", "corporation", "ltd", "limited", "pvt", "private", "llc", "llp", "co", "company", "enterprises", "services",
    "solutions", "holdings", "gmbh", "sa", "sarl", "bv", "technologies", "tech", "group", "international",
)
_SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
_DIGITS = r"\b[0-9]+\b"


def let(x: Column, f) -> Column:
    """``f(x)`` with x computed once, however often f names it; keeps long expressions linear in size."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def safe(x: Column) -> Column:
    """Text of a value, empty where it is null."""
    return F.coalesce(x.cast("string"), F.lit(""))


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, rf"{_SPACE}+", " "))


def _chain(x: Column, rules) -> Column:
    return reduce(lambda y, rule: F.regexp_replace(y, rule[0], rule[1]), rules, x)


def expand_ligatures(x: Column) -> Column:
    """Ligatures as two letters, quotation marks as spaces or apostrophes."""
    one = {k: v for k, v in LIGATURES.items() if len(v) == 1}
    x = F.translate(x, "".join(one), "".join(one.values()))
    for k, v in LIGATURES.items():
        if len(v) > 1:
            x = F.replace(x, F.lit(k), F.lit(v))
    return x


def replace_terms(x: Column) -> Column:
    """Known terms of Indic scripts in Latin, longer terms first."""

    def replaced(y: Column) -> Column:
        for k in sorted(INDIC_TERMS, key=len, reverse=True):
            y = F.replace(y, F.lit(k), F.lit(INDIC_TERMS[k]))
        return y

    return let(x, lambda y: F.when(y.rlike("[\\u0900-\\u0CFF]"), replaced(y)).otherwise(y))


def _spelled_out(x: Column) -> Column:
    """Characters that fold to several ones, replaced one by one; only texts that have any take this way."""
    _, several = fold_tables()
    table = F.str_to_map(F.lit("\ue001".join(f"{c}\ue000{to}" for c, to in several.items())), F.lit("\ue001"), F.lit("\ue000"))
    wide = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in several) + "]"
    one_by_one = lambda y: F.array_join(F.transform(F.split(y, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return let(x, lambda y: F.when(y.rlike(wide), one_by_one(y)).otherwise(y))


def fold(x: Column) -> Column:
    """Text with ligatures expanded, Indic scripts in Latin, accents dropped, in lower case."""
    single, _ = fold_tables()
    order = sorted(single, key=lambda c: not single[c])  # those that vanish come last

    def folded(y: Column) -> Column:
        return F.translate(_spelled_out(replace_terms(expand_ligatures(y))), "".join(order), "".join(single[c] for c in order))

    return let(x, lambda y: F.lower(F.when(y.rlike("[^\\x00-\\x7F]"), folded(y)).otherwise(F.translate(y, "`", "'"))))


def country(x: Column) -> Column:
    """Country in upper case without outer white space."""
    return F.upper(F.regexp_replace(safe(x), rf"^{_SPACE}+|{_SPACE}+$", ""))


def name_text(raw: Column) -> Column:
    """A name folded and without web addresses, registration numbers, decoration and punctuation."""
    x = F.replace(fold(safe(raw)), F.lit("&"), F.lit(" and "))
    x = F.regexp_replace(x, r"(?i)\b(?:https?://|www\.)", "")
    x = F.regexp_replace(x, r"(?i)\.(?:com|org|net|co\.in|in|fr|io|biz|info|edu|gov)\b", " ")
    x = F.regexp_replace(x, r"-\s*[0-9]{6,}\b|#[0-9]{4,}\b", " ")
    x = F.regexp_replace(x, r"^[#\-<>*/@+|]+|[#\-<>*/@+|]+$", " ")
    x = F.regexp_replace(x, r"(?i)^(?:mirapyra\s+)?(?:formerly|dba|d/b/a|ex|trading\s+as|t/a)\s+", "")
    return squeeze(F.regexp_replace(x, r"[^a-z0-9\s]", " "))


def full_name(raw: Column) -> Column:
    """``name_text`` with legal forms in their short spelling."""
    return squeeze(_chain(name_text(raw), LEGAL_FORMS))


def core_name(full: Column) -> Column:
    """A full name without legal tokens; the full name if nothing is left."""
    return let(full, lambda f: F.coalesce(F.nullif(squeeze(F.regexp_replace(f, LEGAL_TOKENS, " ")), F.lit("")), f))


def business_name(raw: Column) -> Column:
    """``struct(core, full)`` of a raw name."""
    return let(full_name(raw), lambda full: F.struct(core_name(full).alias("core"), full.alias("full")))


def address_text(raw: Column) -> Column:
    """An address folded, with street words and states abbreviated and leading zeros gone."""
    x = F.replace(fold(safe(raw)), F.lit("&"), F.lit(" and "))
    x = _chain(x, ADDRESS_WORDS)
    states = [(rf"\b{k}\b", v) for k, v in US_STATES.items()]
    x = let(x, lambda y: F.when(y.rlike("|".join(p for p, _ in states)), _chain(y, states)).otherwise(y))
    x = F.regexp_replace(x, r"\b0+([0-9]+)\b", "$1")
    return squeeze(F.regexp_replace(x, r"[^a-z0-9\s]", " "))


def numbers(clean: Column) -> Column:
    """Whole tokens of digits in order, repeats included."""
    return F.regexp_extract_all(clean, F.lit(_DIGITS), F.lit(0))


def present(raw: Column) -> Column:
    """1 if an address holds more than white space, else 0."""
    return (F.regexp_replace(safe(raw), _SPACE, "") != "").cast("int")


def address(raw: Column) -> Column:
    """``struct(clean, numbers, has)`` of a raw address."""
    clean = F.when(present(raw) == 1, address_text(raw)).otherwise("")
    return let(clean, lambda c: F.struct(c.alias("clean"), numbers(c).alias("numbers"), present(raw).alias("has")))


def plain(x: Column) -> Column:
    """The matcher's text: lower case, all but letters, digits, _ and white space as spaces."""
    return squeeze(F.regexp_replace(F.lower(safe(x)), r"[^\p{L}\p{N}_\s\p{Z}]", " "))


def number_set(x: Column) -> Column:
    """Distinct whole numbers without leading zeros; zero itself is none."""
    found = F.regexp_extract_all(x, F.lit(_DIGITS), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda n: F.regexp_replace(n, "^0+", "")), lambda n: n != ""))


def core_tokens(x: Column) -> Column:
    """A plain name without common suffixes; the name itself if nothing is left."""
    return F.coalesce(F.nullif(F.array_join(F.filter(F.split(x, " "), lambda w: ~w.isin(*SUFFIX_TOKENS)), " "), F.lit("")), x)


def name_tokens(x: Column) -> Column:
    """Tokens of a-z and 0-9 with two characters or more that are no stop tokens."""
    found = F.regexp_extract_all(F.lower(safe(x)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_TOKENS))


def digit_runs(x: Column) -> Column:
    """All runs of digits, those inside words too."""
    return F.regexp_extract_all(safe(x), F.lit("[0-9]+"), F.lit(0))


def encoder_text(x: Column, role: str) -> Column:
    """The text that a sentence encoder gets: ``passage: ..`` or ``query: ..``."""
    return F.concat(F.lit(f"{role}: "), safe(x))


def id_list(x: Column, keep_empty: bool = False) -> Column:
    """Ids of a comma list, trimmed; empty pieces are dropped unless asked for. A blank list has none."""
    none = F.array().cast("array<string>")
    parts = F.transform(F.split(safe(x), ","), lambda p: F.trim(p))
    return F.when(F.trim(safe(x)) == "", none).otherwise(parts if keep_empty else F.filter(parts, lambda p: p != ""))


def non_ascii(x: Column) -> Column:
    """Whether a text has a character beyond ASCII."""
    return safe(x).rlike("[^\\x00-\\x7F]")


def path_safe(x: Column) -> Column:
    """A value fit for a folder's name."""
    return F.regexp_replace(safe(x), "[^A-Za-z0-9_-]+", "_")
