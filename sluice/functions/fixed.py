"""Word lists, lookup tables, thresholds and weights.

These have to be exactly as they are for results to be right.
"""

# Cells holding one of these words stand for "no value".
SENTINELS = ("n/a", "na", "null", "none", "-", "--", "nan", "?", "tbd", "undefined", "nil", "n.a.")

TRUE_WORDS = ("true", "t", "yes", "y")
FALSE_WORDS = ("false", "f", "no", "n")

CURRENCY = "$€£"

# Every character that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

COUNTRY_ALIASES = {
    "usa": "United States",
    "us": "United States",
    "u.s.": "United States",
    "u.s.a.": "United States",
    "united states": "United States",
    "united states of america": "United States",
    "uk": "United Kingdom",
    "u.k.": "United Kingdom",
    "great britain": "United Kingdom",
    "britain": "United Kingdom",
    "united kingdom": "United Kingdom",
    "uae": "United Arab Emirates",
    "u.a.e.": "United Arab Emirates",
    "united arab emirates": "United Arab Emirates",
}

MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

# Words in a column name that give it a role, first match wins.
ROLE_WORDS = (
    ("money", ("amount", "price", "cost", "revenue", "balance", "fee", "total")),
    ("quantity", ("qty", "quantity", "units")),
)
FREE_TEXT_WORDS = ("note", "comment", "memo", "description")
COUNTRY_WORDS = ("country", "nation")
KEY_WORDS = ("id", "uuid")

# Lists of records inside a JSON envelope, first match wins.
ENVELOPE_KEYS = ("data", "results", "items", "records", "rows")

# (minimum ratio, severity); a ratio of zero raises nothing.
MONEY_BANDS = ((0.0, "low"), (0.02, "medium"), (0.15, "high"), (0.5, "critical"))
DEFAULT_BANDS = ((0.0, "low"), (0.1, "medium"), (0.35, "high"), (0.6, "critical"))
MISSING_BANDS = {
    "key": ((0.0, "high"), (0.1, "critical")),
    "money": MONEY_BANDS,
    "quantity": MONEY_BANDS,
    "date": ((0.0, "low"), (0.05, "medium"), (0.25, "high"), (0.5, "critical")),
    "email": ((0.0, "low"), (0.08, "medium"), (0.3, "high"), (0.6, "critical")),
    "default": DEFAULT_BANDS,
    "country": DEFAULT_BANDS,
    "free_text": (),
}
SENTINEL_BANDS = ((0.0, "low"), (0.05, "medium"))
NON_NUMERIC_BANDS = ((0.0, "medium"), (0.05, "high"), (0.3, "critical"))
EMAIL_BANDS = ((0.0, "medium"), (0.15, "high"))
DATE_BANDS = ((0.0, "medium"), (0.15, "high"), (0.4, "critical"))

SEVERITY_WEIGHTS = {"critical": 30, "high": 15, "medium": 5, "low": 1}
PASS_SCORE = 70
MIN_ROWS_RETAINED = 0.5

# issue type -> (category, confidence)
CAUSES = {
    "sentinel_values": ("sentinel_encoding", 0.9),
    "numeric_format": ("display_formatting", 0.92),
    "non_numeric": ("invalid_entry", 0.74),
    "exact_duplicates": ("ingestion_replay", 0.86),
    "duplicate_key": ("conflicting_keys", 0.82),
    "whitespace": ("export_formatting", 0.84),
    "inconsistent_categories": ("inconsistent_entry", 0.8),
    "invalid_datetime": ("mixed_date_formats", 0.8),
    "date_format": ("mixed_date_formats", 0.77),
    "negative_values": ("sign_convention", 0.7),
    "missing_values": ("missingness", 0.58),
    "outliers": ("outlier", 0.48),
    "invalid_email": ("invalid_entry", 0.8),
}
UNKNOWN_CAUSE = ("unspecified", 0.4)
TRUNCATED_EXTRACT = ("truncated_extract", 0.72)
UNIT_ERROR = ("unit_error", 0.74)
TAIL_CLUSTER = 0.7

# Repairs run in this order whatever order they were planned in.
STRATEGY_ORDER = (
    "trim_whitespace",
    "replace_sentinels",
    "coerce_numeric",
    "normalize_country",
    "canonicalize_case",
    "coerce_dates",
    "coerce_booleans",
    "drop_exact_duplicates",
    "absolute_value",
    "impute_median",
    "drop_incomplete_rows",
    "drop_outlier_rows",
    "dedupe_key",
)
