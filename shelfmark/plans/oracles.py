"""The SQL twin of each query, over the same tables."""

from __future__ import annotations

from shelfmark.plans import bindings as b

ORACLES: dict[str, str] = {}

_FLOAT = r"(?i)([+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?|inf(inity)?)|nan)"
_TOKEN = r"(?:\p{L}+(?:[''’.:·]\p{L}+)*|\p{N}+(?:[''.,;]\p{N}+)*|[\p{M}_]+)+"


def _clean(x: str) -> str:
    return f"trim(coalesce({x}, ''), ' ' || chr(9) || chr(10))"


def _int(x: str) -> str:
    return f"CASE WHEN regexp_full_match({_clean(x)}, '[+-]?[0-9]+') THEN TRY_CAST({_clean(x)} AS BIGINT) END"


def _double(x: str) -> str:
    return f"CASE WHEN regexp_full_match({_clean(x)}, '{_FLOAT}') THEN TRY_CAST({_clean(x)} AS DOUBLE) END"


def _date(x: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({_clean(x)}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') "
        f"THEN TRY_CAST({_clean(x)} AS DATE) END"
    )


def _derived(name: str, columns: dict[str, str], table: str) -> str:
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {table})"


_RAW_ITEMS = _derived("raw_items", b.RAW_ITEMS, "part")
_RAW_MEASURES = _derived("raw_measures", b.RAW_MEASURES, "lineitem")
_RAW_REFERENCE = _derived("raw_reference", b.RAW_REFERENCE, "customer")

_JUDGED_ITEMS = f"""{_RAW_ITEMS}, typed_items AS (
    SELECT {_int('item_id')} AS item_id, {_clean('item_class')} AS item_class,
        {_clean('description')} AS description, {_date('published')} AS published FROM raw_items
), judged_items AS (
    SELECT *, CASE WHEN item_class <> '{b.CLASS}' THEN 'other_class' WHEN item_id IS NULL THEN 'bad_item_id' END AS reason
    FROM typed_items
)"""
_JUDGED_MEASURES = f"""{_JUDGED_ITEMS}, {_RAW_MEASURES}, typed_measures AS (
    SELECT {_int('row_id')} AS row_id, {_int('item_id')} AS item_id, {_int('measure_id')} AS measure_id,
        {_double('amount')} AS amount FROM raw_measures
), judged AS (
    SELECT *, CASE WHEN measure_id IS NULL OR measure_id NOT IN (1, 2, 3, 4) THEN 'unlisted_measure'
        WHEN amount IS NULL THEN 'bad_amount' WHEN row_id IS NULL THEN 'bad_row_id'
        WHEN item_id IS NULL THEN 'bad_item_id'
        WHEN item_id NOT IN (SELECT item_id FROM judged_items WHERE reason IS NULL) THEN 'unknown_item' END AS reason
    FROM typed_measures
)"""

ORACLES["safe_parse"] = f"""WITH {_RAW_ITEMS}, {_RAW_MEASURES},
a AS (SELECT amount AS raw, count(*) AS n FROM raw_measures GROUP BY 1),
i AS (SELECT row_id AS raw, count(*) AS n FROM raw_measures GROUP BY 1),
d AS (SELECT published AS raw, count(*) AS n FROM raw_items GROUP BY 1),
av AS (SELECT raw, n, {_double('raw')} AS v FROM a)
SELECT 'double' AS kind, raw, CAST(NULL AS BIGINT) AS int_value, CASE WHEN isfinite(v) THEN v END AS double_value,
    CASE WHEN isnan(v) THEN 'nan' WHEN isinf(v) THEN 'inf' END AS special, CAST(NULL AS VARCHAR) AS date_value, n FROM av
UNION ALL SELECT 'int', raw, {_int('raw')}, NULL, NULL, NULL, n FROM i
UNION ALL SELECT 'date', raw, NULL, NULL, NULL, CAST({_date('raw')} AS VARCHAR), n FROM d"""

ORACLES["clean_text"] = f"""WITH {_RAW_ITEMS} SELECT {_clean('item_class')} AS item_class,
    {_clean('description')} AS kept_blank, nullif({_clean('description')}, '') AS blank_to_null FROM raw_items"""

ORACLES["load_reference"] = f"""WITH {_RAW_REFERENCE} SELECT CAST({_int('measure_id')} AS INTEGER) AS measure_id,
    nullif({_clean('name')}, '') AS name, nullif({_clean('unit_name')}, '') AS unit_name
    FROM raw_reference WHERE {_int('measure_id')} IN (1, 2, 3, 4)"""

ORACLES["load_items"] = f"""WITH {_JUDGED_ITEMS} SELECT item_id, item_class, description,
    CAST(published AS VARCHAR) AS published FROM judged_items WHERE reason IS NULL"""

ORACLES["load_measures"] = f"""WITH {_JUDGED_MEASURES} SELECT row_id, item_id, CAST(measure_id AS INTEGER) AS measure_id,
    CASE WHEN isnan(amount) THEN 'NaN' WHEN isinf(amount) THEN 'Infinity' ELSE CAST(amount AS VARCHAR) END AS amount
    FROM judged WHERE reason IS NULL"""

ORACLES["reject_reasons"] = f"""WITH {_JUDGED_MEASURES} SELECT coalesce(reason, 'loaded') AS reason, count(*) AS n
    FROM judged GROUP BY 1"""

ORACLES["load_counters"] = f"""WITH {_JUDGED_MEASURES}
SELECT 'items' AS source, count(*) FILTER (WHERE reason IS NULL) AS inserted,
    count(*) FILTER (WHERE reason IS NOT NULL) AS skipped,
    count(DISTINCT item_id) FILTER (WHERE reason IS NULL) AS distinct_ids FROM judged_items
UNION ALL SELECT 'measures', count(*) FILTER (WHERE reason IS NULL),
    count(*) FILTER (WHERE reason <> 'unlisted_measure'), count(DISTINCT row_id) FILTER (WHERE reason IS NULL) FROM judged"""

ORACLES["load_funnel"] = f"""WITH {_JUDGED_MEASURES}, f AS (
    SELECT count(*) AS total_rows, count(*) FILTER (WHERE reason IS DISTINCT FROM 'unlisted_measure') AS listed_measure,
        count(*) FILTER (WHERE reason IS NULL OR reason NOT IN ('unlisted_measure', 'bad_amount')) AS valid_amount,
        count(*) FILTER (WHERE reason IS NULL) AS known_item,
        count(DISTINCT row_id) FILTER (WHERE reason IS NULL) AS to_insert FROM judged)
SELECT total_rows, listed_measure, valid_amount, known_item, known_item - to_insert AS duplicate_row_ids, to_insert,
    listed_measure - to_insert AS skipped FROM f"""

ORACLES["table_totals"] = f"""SELECT count(*) AS items, count(*) FILTER (WHERE p_type = '{b.CLASS}') AS class_items,
    (SELECT count(*) FROM lineitem) AS measures FROM part"""

ORACLES["measure_counts"] = "SELECT l_partkey AS item_id, count(*) AS n FROM lineitem GROUP BY 1"

_ITEMS = "items AS (SELECT p_partkey AS item_id, p_type AS item_class, p_name AS description FROM part)"

ORACLES["class_items"] = f"WITH {_ITEMS} SELECT * FROM items WHERE item_class = '{b.CLASS}'"
ORACLES["paged_items"] = ORACLES["class_items"] + " ORDER BY item_id LIMIT 20 OFFSET 20"
ORACLES["lookup_items"] = f"WITH {_ITEMS} SELECT * FROM items WHERE item_id IN (SELECT user_id FROM events)"

_QUALITY = f"""{_RAW_ITEMS}, {_RAW_MEASURES}, {_RAW_REFERENCE}, qi AS (
    SELECT {_int('item_id')} AS id, {_clean('description')} AS clean, coalesce(description, '') AS raw
    FROM raw_items WHERE {_clean('item_class')} = '{b.CLASS}'
), qm0 AS (
    SELECT CASE WHEN {_clean('amount')} = '' THEN 'empty' WHEN {_double('amount')} IS NULL THEN 'bad'
        WHEN {_int('row_id')} IS NOT NULL THEN 'valid' ELSE 'no_row_id' END AS state,
        {_int('row_id')} AS row_id, {_int('item_id')} AS item_id
    FROM raw_measures WHERE {_int('measure_id')} IN (1, 2, 3, 4)
), qr AS (SELECT {_int('measure_id')} AS id FROM raw_reference), checks AS (
    SELECT 'food' AS source, 'class_rows' AS "check", 'Foundation_food rows in scan (data_type=foundation_food)' AS label,
        (SELECT count(*) FROM qi) AS n
    UNION ALL SELECT 'food', 'duplicate_ids', 'Duplicate fdc_id among foundation_food',
        (SELECT count(*) FROM (SELECT id FROM qi WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1))
    UNION ALL SELECT 'food', 'bad_ids', 'Empty or non-integer fdc_id', (SELECT count(*) FROM qi WHERE id IS NULL)
    UNION ALL SELECT 'food', 'empty_descriptions', 'Empty description', (SELECT count(*) FROM qi WHERE clean = '')
    UNION ALL SELECT 'food', 'padded_descriptions', 'Leading/trailing whitespace in description',
        (SELECT count(*) FROM qi WHERE clean <> '' AND clean <> raw)
    UNION ALL SELECT 'food_nutrient', 'empty_amounts', 'Empty amount (among 4 nutrients we care about)',
        (SELECT count(*) FROM qm0 WHERE state = 'empty')
    UNION ALL SELECT 'food_nutrient', 'bad_amounts', 'Non-numeric amount (among 4 nutrients we care about)',
        (SELECT count(*) FROM qm0 WHERE state = 'bad')
    UNION ALL SELECT 'food_nutrient', 'duplicate_ids', 'Duplicate id (among valid-amount rows for those nutrients)',
        (SELECT count(*) FROM (SELECT row_id FROM qm0 WHERE state = 'valid' GROUP BY 1 HAVING count(*) > 1))
    UNION ALL SELECT 'food_nutrient', 'bad_item_ids', 'Empty or non-integer fdc_id (among valid-amount rows)',
        (SELECT count(*) FROM qm0 WHERE state = 'valid' AND item_id IS NULL)
    UNION ALL SELECT 'food_nutrient', 'bad_measure_ids', 'Empty or non-integer nutrient_id (among valid-amount rows)', 0
    UNION ALL SELECT 'nutrient', 'missing_columns', 'Missing required columns (id, name, unit_name)', 0
    UNION ALL SELECT 'nutrient', 'duplicate_ids', 'Duplicate nutrient id',
        (SELECT count(*) FROM (SELECT id FROM qr WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1))
    UNION ALL SELECT 'nutrient', 'bad_ids', 'Empty or non-integer id', (SELECT count(*) FROM qr WHERE id IS NULL)
), judged_checks AS (
    SELECT *, CASE WHEN "check" = 'class_rows' THEN n <= 0 ELSE n > 0 END AS is_issue FROM checks
)"""
for _name, _source in (("quality_items", "food"), ("quality_measures", "food_nutrient"), ("quality_reference", "nutrient")):
    ORACLES[_name] = f"""WITH {_QUALITY} SELECT "check", n, is_issue FROM judged_checks WHERE source = '{_source}'"""
ORACLES["quality_summary"] = f"""WITH {_QUALITY} SELECT source, count(*) FILTER (WHERE is_issue) AS issues
    FROM judged_checks GROUP BY 1"""
ORACLES["quality_lines"] = f"""WITH {_QUALITY} SELECT source,
    label || CASE WHEN n <= 0 THEN ': none' ELSE ': ' || n || ' found' END AS line FROM judged_checks"""

_MEASURES = """measures AS (
    SELECT row_id, item_id, measure_id, amount, l_returnflag, l_linestatus, l_discount, l_tax FROM (
        SELECT l_orderkey * 10 + l_linenumber AS row_id, l_partkey AS item_id, l_linenumber AS measure_id,
            l_quantity AS amount, l_returnflag, l_linestatus, l_discount, l_tax,
            row_number() OVER (PARTITION BY l_orderkey * 10 + l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC) AS rn
        FROM lineitem) WHERE rn = 1)"""
_IMAGES = f"""{_MEASURES}, old_items AS ({b.OLD_ITEMS}), new_items AS ({b.NEW_ITEMS}),
old_measures AS ({b.OLD_MEASURES}), new_measures AS ({b.NEW_MEASURES})"""

ORACLES["upsert_items"] = f"""WITH old_items AS ({b.OLD_ITEMS}), changed AS (
    SELECT item_id, 'FLAG ' || flag AS item_class, status AS description FROM (
        SELECT l_partkey AS item_id, l_orderkey * 10 + l_linenumber AS seq, max(l_returnflag) AS flag,
            max(l_linestatus) AS status,
            row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC) AS rn
        FROM lineitem GROUP BY 1, 2) WHERE rn = 1)
SELECT * FROM changed UNION ALL SELECT * FROM old_items WHERE item_id NOT IN (SELECT item_id FROM changed)"""

ORACLES["insert_conflicts"] = f"""WITH old_items AS ({b.OLD_ITEMS}), {_derived('new', b.INSERTS, 'events')}
SELECT item_id, seq, CASE WHEN item_id IS NULL THEN 'null_key' WHEN seq IS NULL THEN 'null_order'
    WHEN item_id NOT IN (SELECT item_id FROM old_items) AND seq = min(seq) OVER (PARTITION BY item_id) THEN 'inserted'
    ELSE 'conflict' END AS status FROM new"""

ORACLES["insert_measures"] = f"""WITH {_MEASURES}, {_derived('batch', b.NEW_MEASURES_BATCH, 'events')}, judged AS (
    SELECT *, CASE WHEN item_id IS NULL OR measure_id IS NULL THEN 'null_key'
        WHEN item_id NOT IN (SELECT p_partkey FROM part) THEN 'unknown_item'
        WHEN measure_id NOT IN (SELECT n_nationkey FROM nation) THEN 'unknown_measure' END AS refused FROM batch),
supplied AS (SELECT *, CASE WHEN row_id NOT IN (SELECT row_id FROM measures) AND seq = min(seq) OVER (PARTITION BY row_id)
    THEN 'inserted' ELSE 'conflict' END AS status FROM judged WHERE refused IS NULL AND row_id IS NOT NULL),
highest AS (SELECT max(row_id) AS m FROM (SELECT row_id FROM measures UNION ALL SELECT row_id FROM supplied WHERE status = 'inserted'))
SELECT row_id, item_id, measure_id, amount, seq, refused AS status FROM judged WHERE refused IS NOT NULL
UNION ALL SELECT row_id, item_id, measure_id, amount, seq, status FROM supplied
UNION ALL SELECT (SELECT m FROM highest) + row_number() OVER (ORDER BY seq), item_id, measure_id, amount, seq, 'inserted'
    FROM judged WHERE refused IS NULL AND row_id IS NULL"""

ORACLES["delete_reference"] = """WITH keys AS (SELECT n_nationkey AS nation FROM nation UNION SELECT n_nationkey + 20 FROM nation),
judged AS (SELECT nation, CASE WHEN nation NOT IN (SELECT n_nationkey FROM nation) THEN 'not_found'
    WHEN nation IN (SELECT s_nationkey FROM supplier) THEN 'restricted'
    ELSE 'deleted' END AS status FROM keys)
SELECT CAST(nation AS INTEGER) AS nation, status, status = 'restricted' AS stays FROM judged"""

_UPDATES = """updates AS (SELECT user_id AS item_id, event_id AS seq,
    CASE WHEN event_type = 'click' THEN 'CLICKED' WHEN event_type = 'view' THEN 'VIEWED' END AS item_class,
    CASE WHEN value > 30 THEN props END AS description FROM events)"""
ORACLES["partial_update"] = f"""WITH old_items AS ({b.OLD_ITEMS}), {_UPDATES}, folded AS (
    SELECT item_id, arg_max(item_class, seq) FILTER (WHERE item_class IS NOT NULL) AS c,
        arg_max(description, seq) FILTER (WHERE description IS NOT NULL) AS d FROM updates GROUP BY 1)
SELECT o.item_id, coalesce(c, item_class) AS item_class, coalesce(d, description) AS description
FROM old_items o LEFT JOIN folded f ON o.item_id = f.item_id"""
ORACLES["update_status"] = f"""WITH old_items AS ({b.OLD_ITEMS}), {_UPDATES} SELECT item_id, seq,
    CASE WHEN item_class IS NULL AND description IS NULL THEN 'no_change'
        WHEN item_id IN (SELECT item_id FROM old_items) THEN 'updated' ELSE 'not_found' END AS status FROM updates"""

ORACLES["cascade_delete"] = """SELECT 'items' AS source, p_partkey AS item_id, count(*) AS n FROM part
    WHERE p_type <> 'SMALL' GROUP BY 2
UNION ALL SELECT 'measures', l_partkey, count(*) FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL') GROUP BY 2"""

ORACLES["delete_status"] = f"""WITH old_items AS ({b.OLD_ITEMS}) SELECT DISTINCT c_custkey AS item_id,
    c_custkey IN (SELECT item_id FROM old_items) AS deleted FROM customer"""

ORACLES["delete_measures"] = f"""WITH {_IMAGES} SELECT row_id, item_id,
    CASE WHEN row_id IN (SELECT row_id FROM new_measures) THEN 'left' ELSE 'deleted' END AS outcome FROM old_measures"""

ORACLES["assign_ids"] = f"""WITH {_MEASURES}
SELECT (SELECT max(row_id) FROM measures) + row_number() OVER (ORDER BY event_id) AS row_id, user_id AS item_id,
    value AS amount, event_id AS seq FROM events"""

ORACLES["pk_violations"] = """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
    GROUP BY 1, 2 HAVING count(*) > 1"""
ORACLES["null_violations"] = f"""WITH {_JUDGED_MEASURES}
SELECT 'row_id' AS "column", count(*) FILTER (WHERE row_id IS NULL) AS nulls FROM judged
UNION ALL SELECT 'item_id', count(*) FILTER (WHERE item_id IS NULL) FROM judged
UNION ALL SELECT 'measure_id', count(*) FILTER (WHERE measure_id IS NULL) FROM judged
UNION ALL SELECT 'amount', count(*) FILTER (WHERE amount IS NULL) FROM judged"""
ORACLES["fk_violations"] = f"""WITH {_IMAGES} SELECT item_id, count(*) AS n FROM new_measures
    WHERE item_id NOT IN (SELECT item_id FROM new_items) GROUP BY 1"""
ORACLES["restrict_deletes"] = """SELECT c_nationkey AS nation, count(*) AS "references" FROM customer
    WHERE c_nationkey IN (SELECT n_nationkey FROM nation) GROUP BY 1"""


def _type(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in b.MAPPING.items()) + " END"


_LAST = f"""last AS (SELECT item_id, measure_id, {_type('measure_id')} AS type, amount FROM (
    SELECT l_partkey AS item_id, l_linenumber AS measure_id, l_quantity AS amount,
        row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_shipdate DESC, l_orderkey DESC) AS rn
    FROM lineitem WHERE l_linenumber IN (1, 2, 3, 4)) WHERE rn = 1)"""
ORACLES["map_measures"] = f"WITH {_LAST} SELECT item_id, measure_id, type, amount FROM last"
ORACLES["build_docs"] = f"""WITH {_LAST} SELECT p_partkey AS item_id, p_name AS name, type, amount
    FROM part LEFT JOIN last ON p_partkey = item_id WHERE p_type = '{b.CLASS}'"""


def _image_docs(which: str) -> str:
    """(item_id, name, type, amount) of one image."""
    return f"""{which}_last AS (SELECT item_id, {_type('measure_id')} AS type, amount FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id, measure_id ORDER BY row_id DESC) AS rn
        FROM {which}_measures WHERE measure_id IN (1, 2, 3, 4)) WHERE rn = 1),
    {which}_docs AS (SELECT i.item_id, i.description AS name, type, amount FROM {which}_items i
        LEFT JOIN {which}_last l ON i.item_id = l.item_id WHERE i.item_class = '{b.CLASS}')"""


ORACLES["docs_upsert"] = f"""WITH {_IMAGES}, {_image_docs('old')}, {_image_docs('new')}
SELECT * FROM new_docs UNION ALL SELECT * FROM old_docs WHERE item_id NOT IN (SELECT item_id FROM new_docs)"""
ORACLES["docs_rebuild"] = f"WITH {_IMAGES}, {_image_docs('new')} SELECT * FROM new_docs"

# --- text -------------------------------------------------------------------------


def _sanitize(x: str) -> str:
    """RE2's \\s is ASCII only; no other whitespace is kept by the first step of either."""
    space = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    stripped = rf"regexp_replace(coalesce({x}, ''), '^[{space}]+|[{space}]+$', '', 'g')"
    kept = rf"regexp_replace({stripped}, '[^a-zA-Z0-9{space},\-.%''()]', ' ', 'g')"
    plain = rf"regexp_replace({kept}, '[{space}]-[{space}]|^-|-$', ' ', 'g')"
    single = rf"regexp_replace({plain}, '[{space}]+', ' ', 'g')"
    return f"trim({single}, ' ')"


ORACLES["sanitize_queries"] = f"""SELECT doc_id, {_sanitize("' - ' || text || ' -'")} AS query FROM documents"""

_REQUESTS = _derived("requests", b.CONVERSATION_REQUESTS, "conversations")
ORACLES["search_requests"] = f"""WITH {_REQUESTS}, j AS (
    SELECT query_id, {_clean('query')} AS query, coalesce(size, 20) AS size FROM requests), c AS (
    SELECT *, CASE WHEN query = '' THEN 'QUERY_REQUIRED' WHEN size < 1 OR size > 100 THEN 'INVALID_SIZE' END AS code FROM j)
SELECT query_id, query, CAST(size AS INTEGER) AS size, code, CASE code WHEN 'QUERY_REQUIRED' THEN 'query is required'
    WHEN 'INVALID_SIZE' THEN 'size must be between 1 and 100' END AS message FROM c"""

_CORPUS = "docs AS (SELECT doc_id, text AS name FROM documents)"
_NAMES = "docs AS (SELECT p_partkey AS doc_id, p_name AS name FROM part)"
_PASSAGES = "requests AS (SELECT item_id AS query_id, text AS query, 20 AS size FROM benchmark)"


def _tokens(docs: str) -> str:
    return f"""{docs}, words AS (
        SELECT doc_id, name, regexp_extract_all(lower(coalesce(name, '')), '{_TOKEN}') AS w FROM docs),
    tokens AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM words),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM tokens GROUP BY ALL),
    terms AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    totals AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM words WHERE len(w) > 0)"""


def _query_words(requests: str, text: str) -> str:
    return f"""{requests}, qw AS (
        SELECT query_id, size, regexp_extract_all(lower({text}), '{_TOKEN}') AS w FROM requests
        WHERE trim(query) <> '' AND coalesce(size, 20) BETWEEN 1 AND 100),
    qt AS (SELECT query_id, len(w) AS n, unnest(w) AS qterm, generate_subscripts(w, 1) - 1 AS qpos FROM qw)"""


ORACLES["tokenize"] = f"""WITH {_tokens(_CORPUS)} SELECT doc_id, CAST(dl AS INTEGER) AS doc_len, term, count(*) AS tf,
    CAST(min(pos) AS INTEGER) AS first_pos, CAST(max(pos) AS INTEGER) AS last_pos FROM tokens GROUP BY 1, 2, 3"""
ORACLES["term_stats"] = f"""WITH {_tokens(_CORPUS)} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf,
    (SELECT n_docs FROM totals) AS n_docs FROM tf GROUP BY 1"""

_K = "CASE WHEN length(qterm) <= 2 THEN 0 WHEN length(qterm) <= 5 THEN 1 ELSE 2 END"


def _one_byte(x: str) -> str:
    """DuckDB counts edits in bytes, so each accented letter is stood in for by a capital (terms are lower case)."""
    return f"translate({x}, 'äöüßéèêçñíóáúàâîôûëï', 'ABCDEFGHIJKLMNOPQRST')"


_FUZZY = f"""vocab AS (SELECT term, df, length(term) AS tl, {_one_byte('term')} AS tb FROM terms),
    asked AS (SELECT DISTINCT qterm, length(qterm) AS ql, {_K} AS k, {_one_byte('qterm')} AS qb FROM qt),
    fuzzy AS (SELECT qterm, term, df, damerau_levenshtein(qb, tb) AS edits, least(ql, tl) AS shorter
        FROM asked JOIN vocab ON tl BETWEEN ql - k AND ql + k WHERE damerau_levenshtein(qb, tb) <= k),
    expanded AS (SELECT qterm, term, df, 1.0 - CAST(edits AS DOUBLE) / shorter AS weight FROM fuzzy),
    weighted AS (SELECT *, max(df) OVER (PARTITION BY qterm) AS max_df FROM expanded)"""
ORACLES["fuzzy_terms"] = f"""WITH {_tokens(_CORPUS)}, {_query_words(_PASSAGES, _sanitize('query'))}, {_FUZZY}
SELECT qterm, term, CAST(edits AS INTEGER) AS edits FROM fuzzy"""


def _idf(df: str) -> str:
    return f"ln(1 + (n_docs - {df} + 0.5) / ({df} + 0.5))"


def _saturation(freq: str) -> str:
    return f"2.2 * {freq} / ({freq} + 1.2 * (0.25 + 0.75 * dl / avg_len))"


_MATCH = f"""match_scores AS (
    SELECT query_id, doc_id, weight * {_idf('max_df')} * {_saturation('tf')} AS score
    FROM qt JOIN weighted USING (qterm) JOIN tf USING (term), totals)"""


def _phrases(name: str, slots: str, boost: int) -> str:
    """``slots``: query_id, n, qpos, term, df."""
    return f"""{name}_slots AS ({slots}), {name}_idf AS (
        SELECT query_id, sum({_idf('df')}) AS idf_sum FROM {name}_slots, totals GROUP BY 1),
    {name}_hits AS (SELECT query_id, doc_id, dl, pos - qpos AS start FROM {name}_slots JOIN tokens USING (term)
        GROUP BY 1, 2, 3, 4, n HAVING count(*) = n),
    {name}_freq AS (SELECT query_id, doc_id, dl, count(*) AS freq FROM {name}_hits GROUP BY 1, 2, 3),
    {name}_scores AS (SELECT query_id, doc_id, {boost} * idf_sum * {_saturation('freq')} AS score
        FROM {name}_freq JOIN {name}_idf USING (query_id), totals)"""


_PHRASE = _phrases(
    "phrase", "SELECT query_id, n, qpos, term, df FROM qt JOIN terms ON term = qterm", 3
)
_PREFIX = "heads AS (SELECT DISTINCT qterm FROM qt WHERE qpos = n - 1), prefixed AS (" + """
        SELECT qterm, term, df FROM heads JOIN terms ON starts_with(term, qterm)), """ + _phrases(
    "prefix",
    """SELECT query_id, n, qpos, term, df FROM qt JOIN terms ON term = qterm WHERE qpos < n - 1
        UNION ALL SELECT query_id, n, qpos, term, df FROM qt JOIN prefixed USING (qterm) WHERE qpos = n - 1""",
    2,
)


def _ranked(scores: list[str]) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM {s}_scores" for s in scores)
    return f"""summed AS (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM ({union}) GROUP BY 1, 2),
    ranked AS (SELECT s.query_id, s.doc_id, s.score, d.name, coalesce(q.size, 20) AS size, row_number() OVER (
        PARTITION BY s.query_id ORDER BY s.score DESC, d.name, s.doc_id) AS rank
        FROM summed s JOIN docs d USING (doc_id) JOIN qw q USING (query_id)),
    hits AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score, name FROM ranked WHERE rank <= size)"""


def _search(docs: str, requests: str, combined: bool = True) -> str:
    text = _sanitize("query") if combined else _clean("query")
    parts = [_tokens(docs), _query_words(requests, text), _FUZZY, _MATCH]
    if combined:
        parts += [_PHRASE, _PREFIX]
    parts.append(_ranked(["match", "phrase", "prefix"] if combined else ["match"]))
    return ", ".join(parts)


_NAME_REQUESTS = f"requests AS ({b.NAME_REQUESTS})"
_TYPED_REQUESTS = f"requests AS ({b.TYPED_REQUESTS})"

ORACLES["search_match"] = f"""WITH {_search(_CORPUS, _PASSAGES, combined=False)}
SELECT query_id, rank, doc_id, score FROM hits"""
ORACLES["search_phrase"] = f"""WITH {_tokens(_CORPUS)}, {_query_words(_PASSAGES, _clean('query'))}, {_PHRASE}
SELECT query_id, doc_id, freq FROM phrase_freq"""
ORACLES["search_prefix"] = f"""WITH {_tokens(_NAMES)}, {_query_words(_TYPED_REQUESTS, _sanitize('query'))}, {_PREFIX}
SELECT query_id, doc_id, freq FROM prefix_freq"""
ORACLES["search_ranked"] = f"""WITH {_search(_NAMES, _NAME_REQUESTS)}
SELECT query_id, rank, doc_id, score, name FROM hits"""
ORACLES["search_documents"] = f"WITH {_search(_CORPUS, _PASSAGES)} SELECT query_id, rank, doc_id, score FROM hits"
ORACLES["shape_results"] = f"""WITH {_LAST}, {_search(
    f"docs AS (SELECT p_partkey AS doc_id, p_name AS name FROM part WHERE p_type = '{b.CLASS}')", _TYPED_REQUESTS)}
SELECT query_id, rank, name, type, amount FROM hits LEFT JOIN last ON doc_id = item_id"""

# --- changes ------------------------------------------------------------------------

_EVENTS = f"""feed AS (SELECT event_id AS seq, {b.PAYLOAD} AS payload FROM events),
fields AS (SELECT seq, CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.table') END AS t,
    CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.op') END AS o,
    CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.fdc_id') END AS i FROM feed),
numbered AS (SELECT *, CASE WHEN regexp_full_match(i, '[+-]?[0-9]+') THEN TRY_CAST(i AS BIGINT)
    WHEN regexp_full_match(i, '[+-]?[0-9]+\\.[0-9]*') THEN CAST(trunc(TRY_CAST(i AS DOUBLE)) AS BIGINT) END AS id FROM fields),
parsed AS (SELECT seq, trim(coalesce(t, '')) AS "table", trim(coalesce(o, '')) AS op, id AS item_id,
    CASE WHEN t IS NULL AND o IS NULL AND i IS NULL THEN 'not_an_event' WHEN coalesce(t, '') = '' THEN 'no_table'
        WHEN coalesce(o, '') = '' THEN 'no_op' WHEN i IS NULL THEN 'no_id' WHEN id IS NULL THEN 'bad_id' END AS reject_reason
    FROM numbered),
routed AS (SELECT seq, item_id, CASE WHEN "table" = 'foods' AND op = 'DELETE' THEN 'delete' ELSE 'refresh' END AS action
    FROM parsed WHERE reject_reason IS NULL),
folded AS (SELECT item_id, arg_max(action, seq) AS action FROM routed GROUP BY 1)"""
ORACLES["parse_events"] = f'WITH {_EVENTS} SELECT seq, "table", op, item_id, reject_reason FROM parsed'
ORACLES["route_events"] = f"WITH {_EVENTS} SELECT seq, item_id, action FROM routed"
ORACLES["last_actions"] = f"WITH {_EVENTS} SELECT item_id, action FROM folded"

ORACLES["event_outcomes"] = f"""WITH {_EVENTS} SELECT seq, item_id,
    CAST(CASE WHEN item_id % 3 = 0 THEN seq % 5 + 1 ELSE seq % 5 END AS INTEGER) AS attempt,
    CASE WHEN item_id % 3 <> 0 THEN 'done' WHEN seq % 5 + 1 <= 3 THEN 'retry' ELSE 'dead' END AS outcome FROM routed"""

ORACLES["retry_split"] = """SELECT event_id AS seq, CAST(floor(value / 10) + 1 AS INTEGER) AS attempt,
    CASE WHEN floor(value / 10) + 1 <= 3 THEN 'retry' ELSE 'dead' END AS outcome FROM events"""

ORACLES["derive_events"] = f"""WITH {_IMAGES}, item_changes AS (
    SELECT coalesce(o.item_id, n.item_id) AS item_id, CASE WHEN o.item_id IS NULL THEN 'INSERT'
        WHEN n.item_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op
    FROM old_items o FULL JOIN new_items n ON o.item_id = n.item_id
    WHERE (o.item_id IS NULL OR n.item_id IS NULL OR o.item_class IS DISTINCT FROM n.item_class
        OR o.description IS DISTINCT FROM n.description) AND (o.item_class = '{b.CLASS}' OR n.item_class = '{b.CLASS}')
), measure_changes AS (
    SELECT o.item_id AS before, n.item_id AS after, CASE WHEN o.row_id IS NULL THEN 'INSERT'
        WHEN n.row_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op
    FROM old_measures o FULL JOIN new_measures n ON o.row_id = n.row_id
    WHERE o.row_id IS NULL OR n.row_id IS NULL OR o.item_id <> n.item_id OR o.amount <> n.amount
), all_events AS (
    SELECT 'foods' AS "table", op, item_id FROM item_changes
    UNION ALL SELECT 'food_nutrients', op, coalesce(after, before) FROM measure_changes
    UNION ALL SELECT 'food_nutrients', op, before FROM measure_changes WHERE after <> before)
SELECT "table", op, item_id, '{{"table":"' || "table" || '","op":"' || op || '","fdc_id":' || item_id || '}}' AS payload,
    count(*) AS n FROM all_events GROUP BY ALL"""

ORACLES["apply_events"] = f"""WITH {_IMAGES}, {_image_docs('old')}, {_image_docs('new')}, {_EVENTS}
SELECT * FROM old_docs WHERE item_id NOT IN (SELECT item_id FROM folded)
UNION ALL SELECT * FROM new_docs WHERE item_id IN (SELECT item_id FROM folded WHERE action = 'refresh')"""

ORACLES["search_after_events"] = f"""WITH {_IMAGES}, {_image_docs('old')}, {_image_docs('new')}, {_EVENTS}, {_search(
    """docs AS (SELECT DISTINCT item_id AS doc_id, name FROM old_docs WHERE item_id NOT IN (SELECT item_id FROM folded)
    UNION SELECT item_id, name FROM new_docs WHERE item_id IN (SELECT item_id FROM folded WHERE action = 'refresh'))""",
    _TYPED_REQUESTS)}
SELECT query_id, rank, doc_id, score, name FROM hits"""


# The same rows as without buckets or digests.
ORACLES["upsert_bucketed"] = ORACLES["upsert_items"]
ORACLES["update_bucketed"] = ORACLES["partial_update"]
ORACLES["derive_events_by_digests"] = ORACLES["derive_events"]
ORACLES["store_changes"] = ORACLES["docs_rebuild"]
ORACLES["event_outcomes_keyed"] = ORACLES["event_outcomes"]
ORACLES["observed_counters"] = ORACLES["load_counters"]
ORACLES["observed_funnel"] = ORACLES["load_funnel"]
ORACLES["observed_quality"] = ORACLES["quality_lines"]

_REFERRED = f"""{_MEASURES}, {_derived('batch', b.MEASURE_CHANGES, 'events')}, judged AS (
    SELECT *, CASE WHEN item_id IS NOT NULL AND item_id NOT IN (SELECT p_partkey FROM part) THEN 'unknown_item'
        WHEN measure_id IS NOT NULL AND measure_id NOT IN (SELECT n_nationkey FROM nation) THEN 'unknown_measure' END AS reason
    FROM batch)"""
ORACLES["measure_update_status"] = f"""WITH {_REFERRED} SELECT row_id, seq, CASE WHEN reason IS NOT NULL THEN reason
    WHEN item_id IS NULL AND measure_id IS NULL AND amount IS NULL THEN 'no_change'
    WHEN row_id IN (SELECT row_id FROM measures) THEN 'updated' ELSE 'not_found' END AS status FROM judged"""
ORACLES["update_measures"] = f"""WITH {_REFERRED}, folded AS (
    SELECT row_id, arg_max(item_id, seq) FILTER (WHERE item_id IS NOT NULL) AS item_id,
        arg_max(measure_id, seq) FILTER (WHERE measure_id IS NOT NULL) AS measure_id,
        arg_max(amount, seq) FILTER (WHERE amount IS NOT NULL) AS amount
    FROM judged WHERE reason IS NULL GROUP BY row_id)
SELECT m.row_id, coalesce(f.item_id, m.item_id) AS item_id, coalesce(f.measure_id, m.measure_id) AS measure_id,
    coalesce(f.amount, m.amount) AS amount FROM measures m LEFT JOIN folded f USING (row_id)"""
ORACLES["search_segments"] = ORACLES["search_after_events"]
