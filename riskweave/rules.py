"""Codes, bounds, coefficients and word lists the results depend on.

Everything here is data. The operators turn these tables into column expressions.
"""

from __future__ import annotations

from typing import NamedTuple

# --------------------------------------------------------------------------- movements


class CategoryRule(NamedTuple):
    category: str
    codes: tuple[int, ...] = ()
    direction: str | None = None
    label_prefixes: tuple[str, ...] = ()


# Movement categories, first match wins.
CATEGORY_RULES: tuple[CategoryRule, ...] = (
    CategoryRule("agios", (9,), "debit"),
    CategoryRule(
        "amort_pret",
        (32, 37, 46, 57, 91, 92, 93, 1191, 1192, 11939),
        "credit",
        ("AMORTISSEMENT PRET",),
    ),
    CategoryRule(
        "atd_tres_pub",
        label_prefixes=(
            "AVIS A TIERS DETENTEUR TRESOR PUBLIC",
            "OPPOSITION A TIERS DETENTEUR COLLECTIVIT",
        ),
    ),
    CategoryRule("attri_blocage", label_prefixes=("SAISIE ATTRIBUTION-BLOCAGE",)),
    CategoryRule("centr_treso>>credit", (98, 557, 1371, 1372, 1373, 4160, 5151, 5152), "credit"),
    CategoryRule(
        "centr_treso>>debit",
        (89, 511, 1321, 1322, 506, 1323, 4110, 5101, 5102, 9102),
        "debit",
    ),
    CategoryRule(
        "cost>>debit",
        (
            1, 2, 6, 8, 11, 12, 13, 18, 19, 21, 22, 23, 24, 25, 27, 28, 31, 32, 33, 34, 35, 37,
            38, 39, 41, 42, 43, 44, 46, 47, 48, 53, 58, 61, 76, 82, 83, 85, 86, 87, 90, 94, 101,
            103, 104, 105, 106, 107, 109, 110, 404, 503, 507, 508, 509, 510, 512, 513, 514, 515,
            516, 519, 529, 548, 549, 801, 802, 803, 804, 805, 806, 807, 808, 809, 810, 811, 812,
            813, 814, 815, 817, 818, 819, 820, 821, 822, 856, 1101, 1102, 1103, 1110, 1111, 1112,
            1113, 1115, 1116, 1117, 1118, 1120, 1121, 1122, 1123, 1125, 1126, 1127, 1128, 1130,
            1324, 1325, 1326, 1327, 1328, 1329, 3001, 4201, 6101, 6201, 6202, 6203, 9101, 9103,
            9104, 9105, 9106, 9107, 9108, 9111,
        ),
        "debit",
    ),
    CategoryRule("cost>>credit", (569, 1191, 1192, 1193, 1194), "credit"),
    CategoryRule("cost>>cash", (60, 84, 403, 405, 1104), "debit"),
    CategoryRule("cost>>provision", (52, 73), "debit"),
    CategoryRule(
        "interets",
        (29, 54, 70, 1114, 1119, 1124, 1129, 1164, 1169, 1174, 1179, 6102),
        "debit",
    ),
    CategoryRule("prlv_sepa_retourne", (856, 859), "credit"),
    CategoryRule("recept_pret>>credit", (26, 78), "credit"),
    CategoryRule("recept_pret>>debit", (74,), "debit"),
    CategoryRule("rejected_check", (1,), "credit"),
    CategoryRule("remb_billet_fin", (36,), "debit"),
    CategoryRule("remb_dette", (56,), "debit"),
    CategoryRule("rembt_prlv_sepa", (857,), "credit"),
    CategoryRule(
        "tax",
        (
            568, 809, 810, 811, 812, 813, 814, 815, 817, 818, 819, 820, 821, 854, 855, 856, 857,
            858, 859, 860,
        ),
        None,
        ("DGFIP", "D.G.F.I.P"),
    ),
    CategoryRule("tax_credit>>sie", (568,), "credit", ("SIE ", "S.I.E")),
    CategoryRule(
        "turnover",
        (
            4, 7, 10, 14, 21, 24, 25, 26, 32, 36, 37, 40, 46, 57, 67, 68, 86, 90, 91, 92, 93, 97,
            99, 101, 103, 105, 106, 151, 152, 155, 158, 451, 553, 558, 560, 561, 563, 568, 814,
            821, 854, 855, 858, 1101, 1102, 1103, 1191, 1192, 1193, 1194, 1351, 1352, 4201, 4251,
            4252, 6101,
        ),
        "credit",
    ),
    CategoryRule("urssaf>>credit", (568, 854, 855, 858, 859, 860), "credit", ("URSSAF",)),
    CategoryRule(
        "urssaf>>debit",
        (529, 809, 810, 811, 812, 813, 814, 815, 817, 818, 819, 820, 821),
        "debit",
        ("URSSAF",),
    ),
)

# Categories regrouped for the model, and the five it keeps.
CATEGORY_REGROUP = {"attri_blocage": "saisie", "atd_tres_pub": "saisie"}
MODEL_CATEGORIES = ("interets", "turnover", "prlv_sepa_retourne", "rembt_prlv_sepa", "saisie")
REFUND_MAX_BOUND = 3493.57007
INTEREST_RATIO_BOUND = -0.00143675995
INTEREST_MIN_OPERATIONS = 60

# --------------------------------------------------------------------------- eligibility

# Scope and eligibility codes.
EXCLUDED_LEGAL_FORMS = ("31", "32", "34", "35", "93", "95", "99")
EXCLUDED_ACTIVITY = "6419Z"
EXCLUDED_PUBLIC_ACTIVITY = ("AP", "8411Z")
KEPT_SEGMENTS = ("ME", "GR", "A3")
EXCLUDED_RISK_CLAIMS = ("1", "2")
EXCLUDED_CLIENT_NATURE = "00003"
EXCLUDED_ECONOMIC_CODES = (
    "011", "012", "021", "031", "039", "111", "112", "121", "131", "132", "133", "134", "135",
    "136", "137", "141", "142", "161", "162", "163", "164", "165", "166", "167", "168", "169",
    "171", "172", "181", "182", "183", "184", "189", "231", "232", "233", "234", "235", "236",
    "237", "238", "239", "251", "252", "253", "254", "261", "262", "263", "264", "265", "266",
    "267", "268", "269", "270", "271", "281", "291", "292", "293", "431", "432", "433",
)

# --------------------------------------------------------------------------- encoders

# Legal form classes; any other value, blank or NULL is "7".
LEGAL_FORM_CLASSES = {
    "1-3": ("26", "27", "33", "30"),
    "4-6": ("20", "21", "29", "55", "59", "64"),
    "7": ("22", "25", "56", "57", "58"),
}
LEGAL_FORM_DEFAULT = "7"

# The published sample of the sector mapping. The full mapping is an input table.
SECTOR_SAMPLE = (
    ("420053", "1"), ("420051", "1"), ("460010", "1"),
    ("360120", "2"), ("500030", "2"), ("470030", "2"),
    ("380020", "3"), ("380030", "3"), ("450080", "3"), ("", "3"),
    ("010010", "4"), ("140020", "4"), ("300010", "4"),
)
SECTOR_DEFAULT = "3"

# --------------------------------------------------------------------------- binning


class Bins(NamedTuple):
    """Ascending upper bounds (exclusive) with one class more than bounds.

    ``default`` is the class of NULL. ``hole`` is a value that belongs to no class.
    """

    bounds: tuple[float, ...]
    classes: tuple[str, ...]
    default: str | None = None
    hole: float | None = None


# Class bounds of the score variables.
RATING_BINS = Bins(
    (
        0.00142771716, 0.00274042692, 0.00563700218, 0.0102700535, 0.0129012, 0.0147122974,
        0.0159990136, 0.0456250459,
    ),
    ("1", "2", "3", "4", "5", "6", "7", "8", "9"),
    None,
    0.0456250459,
)
BALANCE_BINS = Bins((-9.10499954, 15235.6445, 76378.7031), ("1", "2", "3", "4"), "4")
CONSO_MARGIN_BINS = Bins((0.430999994, 2.99849987), ("1", "2", "3"), "2")
CASH_FLOW_BINS = Bins((66.2200012,), ("1", "2"))
RESULT_BINS = Bins((-8.194, 2.020, 7.104), ("1", "2", "3", "4"))
ASSET_BINS = Bins((22.643, 47.462), ("1", "2", "3"))
OVERDRAFT_DAYS_BOUND = 12

# --------------------------------------------------------------------------- score

# Intercept and modality coefficients of the score.
INTERCEPT = -3.86402362750751
PDO_FLOOR = 0.0001
COEFFICIENTS: tuple[tuple[str, str, float], ...] = (
    ("nat_jur_a", "1-3", 0.0),
    ("nat_jur_a", "4-6", 0.242841372870074),
    ("nat_jur_a", ">=7", 1.14619110439058),
    ("secto_b", "1", 0.945818754757707),
    ("secto_b", "2", 0.945818754757707),
    ("secto_b", "3", 0.302139711824692),
    ("secto_b", "4", 0.0),
    ("seg_nae", "ME", 0.0),
    ("seg_nae", "autres", 0.699122196727483),
    ("top_ga", "0", 0.0),
    ("top_ga", "1", 0.381966549691793),
    ("nbj", "<=12", 0.739002401887176),
    ("nbj", ">12", 0.0),
    ("solde_cav_char", "1", 0.0),
    ("solde_cav_char", "2", 0.138176642753287),
    ("solde_cav_char", "3", 0.475979161230845),
    ("solde_cav_char", "4", 0.923960586241845),
    ("reboot_score_char2", "1", 3.92364486708385),
    ("reboot_score_char2", "2", 1.74758134681695),
    ("reboot_score_char2", "3", 1.34323461962549),
    ("reboot_score_char2", "4", 1.09920154963862),
    ("reboot_score_char2", "5", 0.756387308936913),
    ("reboot_score_char2", "6", 0.756387308936913),
    ("reboot_score_char2", "7", 0.756387308936913),
    ("reboot_score_char2", "8", 0.340053879161636),
    ("reboot_score_char2", "9", 0.0),
    ("remb_sepa_max", "1", 0.0),
    ("remb_sepa_max", "2", 1.34614367878806),
    ("pres_prlv_retourne", "1", 0.0),
    ("pres_prlv_retourne", "2", 0.917163902080624),
    ("pres_saisie", "1", 0.0),
    ("pres_saisie", "2", 0.805036359316808),
    ("net_int_turnover", "1", 0.0),
    ("net_int_turnover", "2", 0.479376606177871),
    ("rn_ca_conso_023b", "1", 0.0),
    ("rn_ca_conso_023b", "2", 1.17070023813324),
    ("rn_ca_conso_023b", "3", 1.64465207886908),
    ("caf_dmlt_005", "1", 0.0),
    ("caf_dmlt_005", "2", 0.552998315798404),
    ("res_total_passif_035", "1", 0.0),
    ("res_total_passif_035", "2", 0.332604372992466),
    ("res_total_passif_035", "3", 0.676018969566685),
    ("res_total_passif_035", "4", 0.977499984983427),
    ("immob_total_passif_055", "1", 0.0),
    ("immob_total_passif_055", "2", 0.32870481469531),
    ("immob_total_passif_055", "3", 0.572596945524726),
)
SCORE_VARIABLES = tuple(dict.fromkeys(variable for variable, _, _ in COEFFICIENTS))

# --------------------------------------------------------------------------- statements

# Signed statement codes of the consolidated result and of the cash flow.
CONSO_RESULT = {
    "310": 1, "26": 1, "27": -1, "28": -1, "29": -1, "30": -1, "31": -1, "32": 1, "33": 1,
    "34": -1, "35": -1, "36": 1, "37": -1, "38": 1, "39": -1,
}
CASH_FLOW_REGIME_1 = {
    "182": 1, "469": -1, "287": 1, "290": 1, "289": 1, "288": 1, "471": -1, "286": 1, "470": -1,
    "294": 1,
}
CASH_FLOW_REGIME_2 = {"182": 1, "285": 1, "295": 1}
DAYS_PER_MONTH = 30.44
EXERCISE_MONTHS = 12

# --------------------------------------------------------------------------- monitoring

# Alert bounds.
DRIFT_P_VALUE = 0.01
AUC_DROP = 0.02
DISPARATE_IMPACT = (0.8, 1.25)
CALIBRATION_GAP = 0.05
STT_SUCCESS_TARGET = 0.99
LLM_SUCCESS_TARGET = 0.995
GROUNDING_TARGET = 0.90

# --------------------------------------------------------------------------- text

# Filler words, emphasis and confirmation words, honorifics.
FILLERS = ("euh", "bah", "hum", "hein", "ben")
FILLER_NAME = "ben"
FILLER_PROTECTORS = ("et", "ben", "bon")
FILLER_PATTERN = r"\b(?:e+u+h+|h+u+m+|b+a+h+|h+e+i+n+)\b"
EMPHASIS_WORDS = ("très", "trop", "vraiment", "absolument", "super", "hyper")
CONFIRMATION_WORDS = ("oui", "non", "d'accord", "ok", "bien")
HONORIFICS = (
    "m", "mr", "mme", "mlle", "dr", "pr", "me", "maître", "maitre", "mgr", "col", "cdt", "lt",
    "gal",
)

# Number words.
NUMBER_WORDS = {
    "zéro": 0, "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6,
    "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "onze": 11, "douze": 12, "treize": 13,
    "quatorze": 14, "quinze": 15, "seize": 16, "vingt": 20, "vingts": 20, "trente": 30,
    "quarante": 40, "cinquante": 50, "soixante": 60,
}
NUMBER_MULTIPLIERS = {
    "cent": 100, "cents": 100, "mille": 1000, "million": 10**6, "millions": 10**6,
    "milliard": 10**9, "milliards": 10**9,
}

# Injection patterns.
SQL_INJECTION_PATTERNS = (
    r"(\bunion\b.*\bselect\b)",
    r"(\bor\b.*=.*)",
    r"(\band\b.*=.*)",
    r"(;.*drop\b)",
    r"(;.*delete\b)",
    r"(;.*insert\b)",
    r"(;.*update\b)",
)
SCRIPT_INJECTION_PATTERNS = (
    r"<script[^>]*>",
    r"javascript:",
    r"onerror\s*=",
    r"onload\s*=",
)
SPECIAL_CHARACTER_RATIO = 0.5
CONTROL_CHARACTERS = r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]"
MAX_INPUT_CHARACTERS = 10000
SENSITIVE_KEYS = ("secret", "password", "token", "api_key")
RESPONSE_MAX_CHARACTERS = 1200
MIN_LANGUAGE_CHARACTERS = 10
MIN_LANGUAGE_SCORE = 1e-6
LANGUAGE_GREY_ZONE = (0.3, 0.5)
CHUNK_CHARACTERS = 10000
