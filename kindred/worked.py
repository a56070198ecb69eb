"""Worked cases of functions whose results SQL cannot work out: inputs, and results as literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import addresses, names, translit, udfs
from kindred.functions import strings as st
from kindred.functions.names import Segmenter
from kindred.functions.translit import Dictionary
from kindred.operators import features, normalize, validate

WORDS = Segmenter.of_counts({"harbor": 9, "tea": 4, "house": 7, "north": 5, "star": 6, "inn": 2})
KNOWN = Dictionary({"कमल": "kamal", "लिमिटेड": "limited", "ભારત": "bharat"}, {"कमल": "lotus"})
CITIES = {"US": {"salem", "baton rouge"}, "France": {"nantes", "saint malo"}, "India": {"pune", "navi mumbai"}}


def _texts(spark: SparkSession, rows: tuple) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id int, text string")


def _pairs(spark: SparkSession, rows: tuple, *columns: str) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{c} string" for c in columns))


NAMES = (
    "Blue Heron Pvt. Ltd.", "***  M/s. Green Leaf >>", "O'Neil + Sons @ Bay, L.L.C.", "H3ll0 B00ks Inc", "www.harbor-tea.co.uk", "n0rthstar.in",
    "Quillon Traders formerly North Star Pvt Ltd", "कमल लिमिटेड", "Lotus ભારત Works", "Société du Lac S.A.R.L.", "The Company", "21st Street Cafe & Co", "", "  ",
)
TOKENS = ("कमल", "কমল", "ਕਮਲ", "ગુજરાત", "ଓଡ଼ିଶା", "பிரகாஷ்", "తెలుగు", "ಕಮಲ", "ഭാരത്", "क्षेत्र", "लिमिटेड", "abc", "7", "x-कमल", "", "ありがとう")
TEXTS = ("Lotus 7", "कमल लिमिटेड", "Lotus ஆலை Works", "", "12 - 34", "Été", "ಕಮಲ 12", "ありがとう", "абв कमल", "...")
HOSTS = ("https://www.harbor-tea.co.uk", "n0rthstar.in", "harbor tea . com", "Harbor Tea", "a.b.com", "http://x.org/path", "été.fr", "plain")
GLUED = ("northstarinn", "NorthStar-Inn", "starxyq", "tea42", "harborteahouse", "innharbor7", "zzz", "")
ADDRESSES = (
    ("0417 Alder Ave, Salem, Oregon 97301", "US"), ("OR, SALEM, 417 ALDER AVENUE", "US"), ("Unit B-4, 88 NE Pine Ct, City of Baton Rouge, LA, 70801-0099", "US"),
    ("null", "US"), ("7 TER BD DES ARTS, 44000 NANTES, Loire-Atlantique", "France"), ("12, rue de la Paix, Saint-Malo, Bretagne", "France"),
    ("Plot No. 0062/A, Behind Water Tank, Sec-9, Navi Mumbai 400706, Maharastra", "India"), ("c-12 MG Rd, Pune, MH", "India"), ("Kanaalweg 3, Utrecht, 3526", "Netherlands"),
    ("42nd St & 6th Ave, Salem, OR", "US"), ("", "India"),
)
STREETS = (("45th st n. - bldg 2", "US"), ("h.no. 12 mg rd nr tank", "India"), ("bd des arts", "France"), ("12/4 old-mill ln", "US"), ("#7 xing plz", "US"), ("no change here", "Atlantis"))
RATIOS = (
    ("new york mets", "new york yankees"), ("blue heron", "heron blue"), ("blue heron", "blue heron foods"), ("abc", "xabcx"), ("abcd", "bcde"), ("tea house", "tea"), ("a b c", "d e f"), ("same", "same"),
    ("star", "rats"), ("", "x"),
)
HEADER = ("source1_entity_id", "matched_entity_ids")
LINES = ("source1_entity_id\tmatched_entity_ids", "source1_entity_id,matched_entity_ids", "other\theader", "source1_entity_id", "")
#: Names of a source with translations, and of another in Latin letters; truth pairs them by place.
INDIC = (("कमल मोटर्स", "Kamal Motors"), ("कमल फूड्स", "Kamal Foods"), ("कमल फूड्स", "Lotus Foods"), ("भारत मोटर्स", "Bharat Motors"), ("भारत एक दो", "Bharat One"), ("plain", "Plain"))


def _dictionary(spark: SparkSession) -> DataFrame:
    kind = "entity_id string, business_name string, business_address string"
    s1 = spark.createDataFrame([(f"S1-{i}", b, "Pune, MH") for i, (_, b) in enumerate(INDIC)], kind)
    pool = spark.createDataFrame([(f"S2-{i}", a, "पुणे, MH") for i, (a, _) in enumerate(INDIC)], kind)
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(len(INDIC))], "s1 string, cand string")
    d = normalize.fit_dictionary(s1, pool, truth)
    return spark.createDataFrame([(k, v, d.second.get(k)) for k, v in d.best.items()], "token string, best string, second string")


def _udf(f: Callable, kind: str = "string"):
    return udfs.of_text(f, kind)("text")


def _named(spark: SparkSession) -> DataFrame:
    d = _texts(spark, NAMES).select("id", udfs.name_columns(KNOWN, WORDS)("text").alias("n"))
    return d.select("id", "n.*")


def _parsed(spark: SparkSession) -> DataFrame:
    d = _pairs(spark, ADDRESSES, "text", "country").select("id", udfs.address_columns(CITIES)("text", "country").alias("a"))
    return d.select("id", "a.*")


def _ratios(spark: SparkSession) -> DataFrame:
    return _pairs(spark, RATIOS, "a", "b").select("id", *[F.round(st.scorer(k)("a", "b"), 4).alias(k) for k in ("token_set", "token_sort", "partial", "jaro_winkler")])


def _variants(spark: SparkSession) -> DataFrame:
    rows = (("blue heron", "", "heron blue", "tea"), ("blue heron", "tea house", "house of tea", ""), ("", "", "x", "y"), ("abc", "abd", "", "abd"))
    d = _pairs(spark, rows, "a", "alt", "b", "other")
    each = lambda k: F.round(features.best_over_variants(st.scorer(k), [F.col("a"), F.col("alt")], [F.col("b"), F.col("other")]), 4)
    return d.select("id", each("token_set").alias("best_set"), each("jaro_winkler").alias("best_jw"))


def _streets(spark: SparkSession) -> DataFrame:
    from kindred.functions.lexicon import street_words

    rows = [(i, t, c, " ".join(addresses.street_tokens(t, street_words(c)))) for i, (t, c) in enumerate(STREETS)]
    return spark.createDataFrame([(i, t) for i, *_, t in rows], "id int, tokens string")


MADE: dict[str, Callable[[SparkSession], DataFrame]] = {
    "n2_cleaned_names": lambda spark: _texts(spark, NAMES).select("id", _udf(names.cleaned).alias("cleaned")),
    "n3_script_class": lambda spark: _texts(spark, TEXTS).select("id", _udf(translit.script_class, "int").alias("script")),
    "n4_token_script": lambda spark: _texts(spark, TOKENS).select("id", _udf(lambda t: translit.script_of(t) or "").alias("script"), _udf(translit.is_indic, "boolean").alias("indic")),
    "n6_latin_tokens": lambda spark: _texts(spark, NAMES).select("id", udfs.latin_tokens()("text").alias("tokens")),
    "n11_domain_names": lambda spark: _texts(spark, HOSTS).select("id", _udf(lambda t: names.domain_of(t.lower()) or "").alias("base")),
    "n12_segment": lambda spark: _texts(spark, GLUED).select("id", udfs.segment(WORDS)("text").alias("words")),
    "n13_normalize_name": _named,
    "n14_learned_dictionary": _dictionary,
    "n15_romanisation": lambda spark: _texts(spark, TOKENS).select("id", _udf(translit.romanise).alias("latin"), _udf(lambda t: KNOWN.text(t)[0]).alias("rendered")),
    "n19_components": lambda spark: _texts(spark, tuple(a for a, _ in ADDRESSES)).select("id", _udf(lambda t: "|".join(addresses.components(t))).alias("parts")),
    "n20_street_tokens": _streets,
    "n21_parse_address": _parsed,
    "f7_token_ratios": _ratios,
    "f8_variants_max": _variants,
    "v1_headers": lambda spark: spark.createDataFrame([(i, validate.header_issue(x, HEADER) or "") for i, x in enumerate(LINES)], "id int, issue string"),
}

#: Fixed results: written down from a run of these functions and read through against their rules, so they guard against
#: change; they are no independent computation.
EXPECTED: dict[str, tuple[tuple[str, ...], tuple[tuple, ...]]] = {
    "n2_cleaned_names": (
        ('id', 'cleaned'),
        (
            (0, 'Blue Heron Pvt. Ltd'),
            (1, 'Green Leaf'),
            (2, "O'Neil + Sons @ Bay, L.L.C"),
            (3, 'H3ll0 B00ks Inc'),
            (4, 'www.harbor-tea.co.uk'),
            (5, 'n0rthstar.in'),
            (6, 'Quillon Traders formerly North Star Pvt Ltd'),
            (7, 'कमल लिमिटेड'),
            (8, 'Lotus ભારત Works'),
            (9, 'Société du Lac S.A.R.L'),
            (10, 'The Company'),
            (11, '21st Street Cafe & Co'),
            (12, ''),
            (13, ''),
        ),
    ),
    "n3_script_class": (
        ('id', 'script'),
        (
            (0, 0),
            (1, 1),
            (2, 2),
            (3, 0),
            (4, 0),
            (5, 0),
            (6, 1),
            (7, 0),
            (8, 2),
            (9, 0),
        ),
    ),
    "n4_token_script": (
        ('id', 'script', 'indic'),
        (
            (0, 'DEVANAGARI', True),
            (1, 'BENGALI', True),
            (2, 'GURMUKHI', True),
            (3, 'GUJARATI', True),
            (4, 'ORIYA', True),
            (5, 'TAMIL', True),
            (6, 'TELUGU', True),
            (7, 'KANNADA', True),
            (8, 'MALAYALAM', True),
            (9, 'DEVANAGARI', True),
            (10, 'DEVANAGARI', True),
            (11, '', False),
            (12, '', False),
            (13, 'DEVANAGARI', True),
            (14, '', False),
            (15, '', False),
        ),
    ),
    "n6_latin_tokens": (
        ('id', 'tokens'),
        (
            (0, 'blue heron pvt ltd'),
            (1, 'ms green leaf'),
            (2, 'oneil and sons at bay llc'),
            (3, 'h3ll0 b00ks inc'),
            (4, 'www harbor tea co uk'),
            (5, 'n0rthstar in'),
            (6, 'quillon traders formerly north star pvt ltd'),
            (7, ''),
            (8, 'lotus works'),
            (9, 'societe du lac sarl'),
            (10, 'the co'),
            (11, '21st street cafe and co'),
            (12, ''),
            (13, ''),
        ),
    ),
    "n11_domain_names": (
        ('id', 'base'),
        (
            (0, 'harbortea'),
            (1, 'n0rthstar'),
            (2, 'harbortea'),
            (3, ''),
            (4, ''),
            (5, ''),
            (6, ''),
            (7, ''),
        ),
    ),
    "n12_segment": (
        ('id', 'words'),
        (
            (0, 'north star inn'),
            (1, 'north star inn'),
            (2, 'star xyq'),
            (3, 'tea 42'),
            (4, 'harbor tea house'),
            (5, 'inn harbor 7'),
            (6, 'zzz'),
            (7, ''),
        ),
    ),
    "n13_normalize_name": (
        ('id', 'n_full', 'n_core', 'n_raw_core', 'n_alt1', 'n_alt2', 'n_key', 'n_concat', 'n_suffix', 'n_is_domain', 'n_has_alias', 'n_script', 'n_oov', 'n_ntok'),
        (
            (0, 'blue heron pvt ltd', 'blue heron', 'blue heron', '', '', 'blue heron', 'blueheron', 'ltd pvt', False, False, 0, 0, 2),
            (1, 'green leaf', 'green leaf', 'green leaf', '', '', 'green leaf', 'greenleaf', '', False, False, 0, 0, 2),
            (2, 'oneil and sons at bay llc', 'oneil sons at bay', 'oneil sons at bay', '', '', 'at bay oneil sons', 'oneilsonsatbay', 'llc', False, False, 0, 0, 4),
            (3, 'h3ll0 b00ks inc', 'hello books', 'h3ll0 b00ks', '', '', 'books hello', 'hellobooks', 'inc', False, False, 0, 0, 2),
            (4, 'harbor tea', 'harbor tea', 'harbor tea', '', '', 'harbor tea', 'harbortea', '', True, False, 0, 0, 2),
            (5, 'north star', 'north star', 'north star', '', '', 'north star', 'n0rthstar', '', True, False, 0, 0, 2),
            (6, 'quillon traders north star pvt ltd', 'quillon traders north star', 'quillon traders north star', 'quillon traders', 'north star', 'north quillon star traders', 'quillontradersnorthstar', 'ltd pvt', False, True, 0, 0, 4),
            (7, 'kamal ltd', 'kamal', 'kamal', 'lotus', '', 'kamal', 'kamal', 'ltd', False, False, 1, 0, 1),
            (8, 'lotus bharat works', 'lotus bharat works', 'lotus bharat works', '', '', 'bharat lotus works', 'lotusbharatworks', '', False, False, 2, 0, 3),
            (9, 'societe du lac sarl', 'societe lac', 'societe lac', '', '', 'lac societe', 'societelac', 'sarl', False, False, 0, 0, 2),
            (10, 'the co', 'co', 'co', '', '', 'co', 'co', 'co', False, False, 0, 0, 1),
            (11, '21st street cafe and co', '21st street cafe', '21st street cafe', '', '', '21st cafe street', '21ststreetcafe', 'co', False, False, 0, 0, 3),
            (12, '', '', '', '', '', '', '', '', False, False, 0, 0, 0),
            (13, '', '', '', '', '', '', '', '', False, False, 0, 0, 0),
        ),
    ),
    "n14_learned_dictionary": (
        ('token', 'best', 'second'),
        (
            ('कमल', 'kamal', 'lotus'),
            ('पुणे', 'pune', None),
            ('फूड्स', 'foods', None),
            ('मोटर्स', 'motors', None),
        ),
    ),
    "n15_romanisation": (
        ('id', 'latin', 'rendered'),
        (
            (0, 'kamal', 'kamal'),
            (1, 'kamal', 'kamal'),
            (2, 'kamal', 'kamal'),
            (3, 'gujarat', 'gujarat'),
            (4, 'odisha', 'odisha'),
            (5, 'pirakash', 'pirakash'),
            (6, 'telugu', 'telugu'),
            (7, 'kamal', 'kamal'),
            (8, 'bharat', 'bharat'),
            (9, 'kshetr', 'kshetr'),
            (10, 'limited', 'limited'),
            (11, 'abc', 'abc'),
            (12, '7', '7'),
            (13, 'xkamal', 'xkamal'),
            (14, '', ''),
            (15, '', 'ありがとう'),
        ),
    ),
    "n19_components": (
        ('id', 'parts'),
        (
            (0, '0417 alder ave|salem|oregon 97301'),
            (1, 'or|salem|417 alder avenue'),
            (2, 'unit b-4|88 ne pine ct|city of baton rouge|la|70801-0099'),
            (3, ''),
            (4, '7 ter bd des arts|44000 nantes|loire-atlantique'),
            (5, '12|rue de la paix|saint-malo|bretagne'),
            (6, 'plot no. 0062/a|behind water tank|sec-9|navi mumbai 400706|maharastra'),
            (7, 'c-12 mg rd|pune|mh'),
            (8, 'kanaalweg 3|utrecht|3526'),
            (9, '42nd st & 6th ave|salem|or'),
            (10, ''),
        ),
    ),
    "n20_street_tokens": (
        ('id', 'tokens'),
        (
            (0, '45 street north building 2'),
            (1, '12 mg road near tank'),
            (2, 'boulevard des arts'),
            (3, '12/4 old-mill lane'),
            (4, '7 crossing plaza'),
            (5, 'change here'),
        ),
    ),
    "n21_parse_address": (
        ('id', 'a_state', 'a_city', 'a_postcode', 'a_street', 'a_street_key', 'a_hn_raw', 'a_hn', 'a_hn_suffix', 'a_unit', 'a_nums', 'a_tokens', 'a_empty', 'a_landmark', 'a_ncomp'),
        (
            (0, 'OR', 'salem', '97301', 'alder avenue', 'alder avenue', '0417', '417', '', '', '417 97301', 'alder avenue salem st_or pc_97301 417 97301', False, False, 3),
            (1, 'OR', 'salem', '', 'alder avenue', 'alder avenue', '417', '417', '', '', '417', 'alder avenue salem st_or 417', False, False, 3),
            (2, 'LA', 'baton rouge', '70801', 'northeast pine court', 'court northeast pine', '88', '88', '', 'b-4', '4 70801 88 99', 'northeast pine court baton rouge st_la pc_70801 4 70801 88 99', False, False, 5),
            (3, '', '', '', '', '', '', '', '', '', '', '', True, False, 0),
            (4, 'PDL', 'nantes', '44000', 'boulevard arts', 'arts boulevard', '7', '7', 'ter', '', '44000 7', 'boulevard arts nantes st_pdl pc_44000 44000 7', False, False, 3),
            (5, 'BRE', 'saint malo', '', 'rue paix', 'paix rue', '12', '12', '', '', '12', 'rue paix saint malo st_bre 12', False, False, 4),
            (6, 'MH', 'navi mumbai', '400706', 'water tank', 'tank water', '0062', '62', 'a', '', '400706 62 9', 'water tank navi mumbai st_mh pc_400706 400706 62 9', False, True, 5),
            (7, 'MH', 'pune', '', 'mg road', 'mg road', '12', '12', 'c', '', '12', 'mg road pune st_mh 12', False, False, 3),
            (8, '', '', '3526', 'kanaalweg utrecht', 'kanaalweg utrecht', '', '', '', '', '3 3526', 'kanaalweg utrecht pc_3526 3 3526', False, False, 3),
            (9, 'OR', 'salem', '', 'street avenue', 'avenue street', '', '', '', '', '42 6', 'street avenue salem st_or 42 6', False, False, 3),
            (10, '', '', '', '', '', '', '', '', '', '', '', True, False, 0),
        ),
    ),
    "f7_token_ratios": (
        ('id', 'token_set', 'token_sort', 'partial', 'jaro_winkler'),
        (
            (0, 76.1905, 62.069, 81.8182, 0.9067),
            (1, 100.0, 100.0, 66.6667, 0.5333),
            (2, 100.0, 76.9231, 100.0, 0.925),
            (3, 75.0, 75.0, 100.0, 0.8667),
            (4, 75.0, 75.0, 85.7143, 0.8333),
            (5, 100.0, 50.0, 100.0, 0.8444),
            (6, 40.0, 40.0, 44.4444, 0.6),
            (7, 100.0, 100.0, 100.0, 1.0),
            (8, 25.0, 25.0, 40.0, 0.5),
            (9, 0.0, 0.0, 0.0, 0.0),
        ),
    ),
    "f8_variants_max": (
        ('id', 'best_set', 'best_jw'),
        (
            (0, 100.0, 0.5333),
            (1, 100.0, 0.6442),
            (2, None, None),
            (3, 100.0, 1.0),
        ),
    ),
    "v1_headers": (
        ('id', 'issue'),
        (
            (0, ''),
            (1, 'comma-separated, not tab-separated'),
            (2, "the header is not ('source1_entity_id', 'matched_entity_ids')"),
            (3, "the header is not ('source1_entity_id', 'matched_entity_ids')"),
            (4, 'the file is empty'),
        ),
    ),
}



def sql(name: str) -> str:
    """The results as a table of literals."""
    columns, rows = EXPECTED[name]

    def literal(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, float):
            return f"{x}::DOUBLE"
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({', '.join(columns)})"
