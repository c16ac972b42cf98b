"""Fixed values.

They decide results (which rows are kept, what a line says, how a score is
weighted), so they are listed here as plain data and passed as defaults.
"""

# The item class that is loaded and searchable.
INDEXED_CLASS = "foundation_food"

# Measure id -> published name; the ids not listed are not loaded.
MEASURE_NAMES = {1008: "calories", 1003: "protein", 2039: "carbs", 1085: "fat"}

# The names a published measure may have.
PUBLISHED_NAMES = ("calories", "protein", "carbs", "fat")

# Header name in the raw files -> column name used in this package.
REFERENCE_COLUMNS = {"id": "measure_id", "name": "name", "unit_name": "unit_name"}
ITEM_COLUMNS = {
    "fdc_id": "item_id",
    "data_type": "item_class",
    "description": "description",
    "publication_date": "published",
}
MEASURE_COLUMNS = {"id": "row_id", "fdc_id": "item_id", "nutrient_id": "measure_id", "amount": "amount"}

# Names inside change events.
ITEM_TABLE = "foods"
MEASURE_TABLE = "food_nutrients"
EVENT_KEYS = ("table", "op", "fdc_id")

# Titles of the quality report's parts, by source.
REPORT_TITLES = {"food": "Food issues:", "food_nutrient": "Food nutrient issues:", "nutrient": "Nutrient issues:"}

# Fixed sentences of the quality report, which readers of the report rely on; %s stands for the counts by source or the ids.
REPORT_HEADING = "=== Data cleaning report ==="
REPORT_IDS = "Nutrient IDs checked (from config): %s"
REPORT_ISSUES = "Cleaning checks found issues: %s."
REPORT_NO_ISSUES = (
    "Cleaning checks completed. No issues found; data is acceptable for ingest "
    "(filtering and validation will still run at ingest time)."
)

# Request limits and the codes/messages of refused requests.
DEFAULT_SIZE = 20
MIN_SIZE = 1
MAX_SIZE = 100
QUERY_REQUIRED = "QUERY_REQUIRED"
QUERY_REQUIRED_MESSAGE = "query is required"
INVALID_SIZE = "INVALID_SIZE"
INVALID_SIZE_MESSAGE = "size must be between 1 and 100"

# An event that failed is tried again this many times.
MAX_RETRIES = 3

# Seconds before a failed event is tried again.
RETRY_INTERVAL = 10.0

# Clause boosts and BM25 constants.
PHRASE_BOOST = 3.0
PREFIX_BOOST = 2.0
MATCH_BOOST = 1.0
BM25_K1 = 1.2
BM25_B = 0.75

# Whitespace as the raw files' readers understand it: Unicode White_Space plus the
# four ASCII separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Characters a search text may keep, besides whitespace.
QUERY_CHARACTERS = r"a-zA-Z0-9,\-.%'()"
