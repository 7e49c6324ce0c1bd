"""Registered queries on subject search, erasure, disclosure and streams, each with its checking SQL
where SQL can express it."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stewardry.functions.fuzzy import fuzzy_score
from stewardry.functions.normalise import HONORIFICS, norm_name, norm_phone, norm_postcode
from stewardry.operators import disclosure as di, erasure as er, reports as rp, search as se, search_index as si
from stewardry.plans import lake
from stewardry.plans.queries_basic import BOOKING_FIELDS, CATALOG_NOW, RC_CTES, cat_compliance, json_text
from stewardry.plans.subject_copies import find_subject_copies, unsearched_tables
from stewardry.session import materialise, scratch_folder
from stewardry.sources.derived import check_ctes, load, nicknames
from stewardry.sources.metadata import columns_of
from stewardry.sources.registers import decision_systems
from stewardry.streaming.stamping import read_latest, stamp_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

REGISTER = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "sources", "data", "decision_systems.json")


def add(name: str, query: Query, check: str | None = None) -> None:
    QUERIES[name] = query
    if check is not None:
        CHECKS[name] = check


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- normalisers and tag catalogue --------------------------------------------------------------

_PEOPLE = check_ctes("people")
_HONORIFICS = "|".join(HONORIFICS)


def name_sql(c: str) -> str:
    plain = f"trim(regexp_replace(strip_accents({c}), '\\s+', ' ', 'g'))"
    bare = f"regexp_replace({plain}, '^(?i)({_HONORIFICS})\\.*( |$)', '')"
    return f"lower(trim(regexp_replace(regexp_replace({bare}, '[^\\p{{L}}\\s\\-]', '', 'g'), '\\s+', ' ', 'g')))"


def phone_sql(c: str) -> str:
    return f"right(regexp_replace({c}, '[^0-9]', '', 'g'), 9)"


_POSTCODE = "(?i)\\b([A-Z]{1,2}[0-9][0-9A-Z]?)\\s?([0-9][A-Z]{2})\\b"


def postcode_sql(c: str) -> str:
    return f"""CASE WHEN regexp_matches({c}, '{_POSTCODE}')
 THEN upper(concat(regexp_extract({c}, '{_POSTCODE}', 1), regexp_extract({c}, '{_POSTCODE}', 2))) ELSE {c} END"""


add("tagged_columns", lambda s, d: se.tagged_columns(load(s, d, "cat_tags"), "silver"), f"""{check_ctes('cat_tags')}
SELECT table_catalog, table_schema, table_name, column_name, tag_name FROM cat_tags WHERE tag_name LIKE 'class.%' AND table_catalog = 'silver'""")
add("norm_name", lambda s, d: load(s, d, "people").select("cust_id", norm_name(F.concat(F.lit(" Dr. "), "first_name", F.lit("  "), "last_name")).alias("v")),
    f"{_PEOPLE} SELECT cust_id, {name_sql('v')} AS v FROM (SELECT cust_id, concat(' Dr. ', first_name, '  ', last_name) AS v FROM people)")
add("norm_phone", lambda s, d: load(s, d, "people").select("cust_id", norm_phone("phone").alias("v")), f"{_PEOPLE} SELECT cust_id, {phone_sql('phone')} AS v FROM people")
add("norm_postcode", lambda s, d: load(s, d, "people").select("cust_id", norm_postcode(F.lower("address")).alias("v")),
    f"{_PEOPLE} SELECT cust_id, {postcode_sql('a')} AS v FROM (SELECT cust_id, lower(address) AS a FROM people)")

_CLEAN = f"""clean AS (SELECT DISTINCT subject_id, tag, v AS value FROM (SELECT subject_id, tag, CASE tag WHEN 'class.name' THEN {name_sql('value')}
 WHEN 'class.phone_number' THEN {phone_sql('value')} WHEN 'class.location' THEN {postcode_sql('value')} ELSE value END AS v FROM subjects) WHERE trim(v) <> '')"""
_SUBJECTS = f"{check_ctes('subjects', *lake.TABLES.values())}, {_CLEAN}"
_VARIANTS = """nick(a, b) AS (VALUES ('tony', 'anthony'), ('ant', 'anthony'), ('bill', 'william'), ('will', 'william'), ('peggy', 'margaret'), ('maggie', 'margaret')),
pairs AS (SELECT a, b FROM nick UNION SELECT b, a FROM nick),
tok AS (SELECT DISTINCT subject_id, value, unnest(range(len(string_split(value, ' ')))) AS pos, unnest(string_split(value, ' ')) AS token FROM clean WHERE tag = 'class.name'),
variants AS (SELECT subject_id, value, pos, token, token AS variant FROM tok UNION SELECT subject_id, value, pos, token, b FROM tok JOIN pairs ON a = token)"""
add("normalise_subjects", lambda s, d: se.normalise_subjects(load(s, d, "subjects")), f"{_SUBJECTS} SELECT subject_id, tag, value FROM clean")
add("empty_conditions", lambda s, d: se.empty_conditions(load(s, d, "subjects")), f"""{_SUBJECTS}
SELECT subject_id, tag, value FROM subjects s WHERE NOT EXISTS (SELECT 1 FROM clean c WHERE c.subject_id = s.subject_id AND c.tag = s.tag)""")
add("subject_refs", lambda s, d: se.subject_refs(load(s, d, "subjects")), f"""{_SUBJECTS}
SELECT subject_id, string_agg(concat(tag, '=', value), '; ' ORDER BY tag, value) AS subject_ref FROM subjects GROUP BY subject_id""")
add("expand_tokens", lambda s, d: se.expand_tokens(load(s, d, "subjects"), nicknames(s)), f"""{_SUBJECTS}, {_VARIANTS}
SELECT subject_id, CAST(pos AS INT) AS pos, token, variant FROM variants""")
add("name_slots", lambda s, d: se.assign_name_slots(load(s, d, "cat_name_columns")), f"""{check_ctes('cat_name_columns')}
SELECT table_catalog, table_schema, table_name, column_name, CASE WHEN column_name LIKE '%\\_1' ESCAPE '\\' THEN '1' WHEN column_name LIKE '%\\_2' ESCAPE '\\' THEN '2'
 WHEN column_name LIKE '%1\\_%' ESCAPE '\\' THEN split_part(column_name, '_', 1) WHEN column_name LIKE 'line2%' THEN 'line2' WHEN column_name LIKE 'buyer%' THEN 'buyer' WHEN column_name LIKE 'payee%' THEN 'payee' ELSE 'person' END AS slot FROM cat_name_columns""")

# ---- search -------------------------------------------------------------------------------------

#: The tagged tables, and the rows that requests select in them.
_SELECTED = {"silver.crm.customers": "selected_customers", "silver.crm.bookings": "selected_bookings"}


def row_id_sql(fields: dict[str, str]) -> str:
    return f"sha256({json_text(fields)})"


_ID_PERSON = row_id_sql({"cust_id": "number"})
_ID_BOOKING = row_id_sql(BOOKING_FIELDS)


def _name_hits(table: str, source: str, ident: str, slots: list[str]) -> str:
    """All tokens of a name, in any variant, inside one slot. Each token is looked up on its own."""
    texts = " UNION ALL ".join(
        f"SELECT rn, {ident} AS row_id, {i} AS slot, lower(strip_accents({t})) AS txt FROM numbered_{table}" for i, t in enumerate(slots)
    )
    return f"""numbered_{table} AS (SELECT *, row_number() OVER () AS rn FROM {source}),
texts_{table} AS ({texts}),
wanted_{table} AS (SELECT subject_id, value, count(DISTINCT pos) AS n FROM variants GROUP BY ALL),
nhits_{table} AS (SELECT DISTINCT subject_id, rn, row_id FROM (SELECT v.subject_id, v.value, t.rn, t.row_id, t.slot, count(DISTINCT v.pos) AS got
 FROM variants v JOIN texts_{table} t ON contains(t.txt, v.variant) GROUP BY ALL) h JOIN wanted_{table} w USING (subject_id, value) WHERE got = n)"""


def _person_hits(table: str, source: str, names: dict[str, str]) -> str:
    """(subject, row, tag) hits on a table keyed by cust_id; ``names`` maps a tag to its column."""
    parts = [f"SELECT subject_id, 'class.name' AS tag, rn, row_id FROM nhits_{table}"]
    tests = {
        "class.email_address": "lower({c}) = lower(value)",
        "class.phone_number": phone_sql("{c}") + " = value",
        "class.date_of_birth": "CAST({c} AS VARCHAR) = value",
        "class.location": """CASE WHEN regexp_matches(value, '^[A-Z]{{1,2}}[0-9][0-9A-Z]?[0-9][A-Z]{{2}}$')
 THEN contains(upper(replace({c}, ' ', '')), value) ELSE contains(lower({c}), lower(value)) END""",
    }
    for tag, column in names.items():
        parts.append(f"""SELECT subject_id, tag, rn, {_ID_PERSON} AS row_id FROM (SELECT * FROM clean WHERE tag = '{tag}') JOIN numbered_{table}
 ON {tests[tag].format(c=column)}""")
    return f"hits_{table} AS ({' UNION ALL '.join(parts)})"


def _all_of(name: str, hits: str, full_name: str, tags: str, subjects: str = "SELECT DISTINCT subject_id FROM clean") -> str:
    """Rows where every identifier of a subject that the table has is hit."""
    return f"""{name} AS (SELECT w.subject_id, '{full_name}' AS table_full_name, row_id, matched_on, count(*) AS n_rows FROM (
 SELECT subject_id, string_agg(tag, ', ' ORDER BY tag) AS matched_on, count(*) AS n FROM clean WHERE tag IN ({tags}) AND subject_id IN ({subjects}) GROUP BY subject_id) w
 JOIN (SELECT subject_id, rn, row_id, count(DISTINCT tag) AS got FROM {hits} WHERE tag IN ({tags}) GROUP BY ALL) h ON h.subject_id = w.subject_id AND got = n GROUP BY ALL)"""


_PERSON_COLUMNS = {"class.email_address": "email", "class.phone_number": "phone", "class.date_of_birth": "dob", "class.location": "address"}
_PERSON_TAGS = "'class.name', 'class.email_address', 'class.phone_number', 'class.date_of_birth', 'class.location'"
_HITS = ",\n".join([
    _VARIANTS,
    _name_hits("customers", "customers", _ID_PERSON, ["concat_ws(' ', first_name, last_name)"]),
    _person_hits("customers", "customers", _PERSON_COLUMNS),
    _name_hits("bookings", "bookings", _ID_BOOKING, ["concat_ws(' ', firstname_1, lastname_1)", "concat_ws(' ', firstname_2, lastname_2)"]),
    "hits_bookings AS (SELECT subject_id, 'class.name' AS tag, rn, row_id FROM nhits_bookings)",
])
_DIRECT = ",\n".join([
    _HITS,
    _all_of("d_customers", "hits_customers", "silver.crm.customers", _PERSON_TAGS),
    _all_of("d_bookings", "hits_bookings", "silver.crm.bookings", "'class.name'"),
    "direct AS (SELECT * FROM d_customers UNION ALL SELECT * FROM d_bookings)",
])


def _search(s: SparkSession, d: str, tag: str | None = None, **options) -> DataFrame:
    subjects = load(s, d, "subjects")
    if tag is not None:
        subjects = subjects.filter(F.col("tag") == tag)
    return se.search_tables(subjects, lake.tables(s, d), lake.column_tags(s), nicknames(s), primary_keys=lake.PRIMARY_KEYS, **options)


for _short, _tag in (("email", "class.email_address"), ("phone", "class.phone_number"), ("location", "class.location"), ("dob", "class.date_of_birth"), ("name", "class.name")):
    add(f"match_{_short}", lambda s, d, t=_tag: _search(s, d, t, threshold=None).select("subject_id", "table_full_name", "row_id", "n_rows"), f"""{_SUBJECTS}, {_HITS}
SELECT subject_id, 'silver.crm.customers' AS table_full_name, row_id, count(*) AS n_rows FROM hits_customers WHERE tag = '{_tag}' GROUP BY ALL
UNION ALL SELECT subject_id, 'silver.crm.bookings', row_id, count(*) FROM hits_bookings WHERE tag = '{_tag}' GROUP BY ALL""")
add("search_tables", lambda s, d: _search(s, d, threshold=None).drop("score"), f"{_SUBJECTS}, {_DIRECT} SELECT subject_id, table_full_name, row_id, n_rows, matched_on FROM direct")


def _filed(s: SparkSession, parts: dict[str, list[DataFrame]], folder: str) -> dict[str, DataFrame]:
    """Tables read from files below ``folder``, to which each frame of a table is appended."""
    for name, frames in parts.items():
        for df in frames:
            df.write.mode("append").parquet(f"{folder}/{name}")
    return {name: s.read.parquet(f"{folder}/{name}") for name in parts}


def _index_search(s: SparkSession, d: str, refreshed: bool) -> DataFrame:
    """All subjects searched in a kept index of the tagged tables. With ``refreshed``, the index is first made from a
    third of the customers and from bookings that are replaced, and then brought up to the tables' files."""
    folder = scratch_folder(s, "lake")
    index = si.SearchIndex(f"idx_{uuid.uuid4().hex}", f"{folder}/index")
    tagged = {name: load(s, d, lake.TABLES[name]) for name in _SELECTED}
    customers, bookings = tagged["silver.crm.customers"], tagged["silver.crm.bookings"]
    tags, third = lake.column_tags(s), F.col("cust_id") % 3 == 0
    if refreshed:
        early = _filed(s, {"silver.crm.customers": [customers.filter(third)], "silver.crm.bookings": [bookings.filter("booking_id % 2 = 0")]}, folder)
        si.refresh(index, early, tags, lake.PRIMARY_KEYS)
        late = _filed(s, {"silver.crm.customers": [customers.filter(~third)]}, folder) | _filed(s, {"silver.crm.bookings": [bookings]}, f"{folder}/v2")
        si.refresh(index, late, tags, lake.PRIMARY_KEYS)
        tables = late
    else:
        tables = _filed(s, {name: [df] for name, df in tagged.items()}, folder)
        si.refresh(index, tables, tags, lake.PRIMARY_KEYS)
    found = materialise(si.search_index(index, load(s, d, "subjects"), tables, tags, nicknames(s), threshold=None).drop("score"), "found")
    si.drop(index, s)
    return found


for _name, _kind in (("index_search", False), ("index_search_refreshed", True)):
    add(_name, lambda s, d, k=_kind: _index_search(s, d, k), f"{_SUBJECTS}, {_DIRECT} SELECT subject_id, table_full_name, row_id, n_rows, matched_on FROM direct")
add("fuzzy_matches", lambda s, d: _search(s, d))
add("fuzzy_threshold", lambda s, d: se.above_threshold(load(s, d, "match_log"), 80),
    f"{check_ctes('match_log')} SELECT * FROM match_log WHERE score IS NULL OR score >= 80")
add("preselected_log", lambda s, d: load(s, d, "match_log").withColumn("preselected", se.preselected()),
    f"{check_ctes('match_log')} SELECT *, score IS NULL OR score >= 90 AS preselected FROM match_log")


def _fuzzy_scores(s: SparkSession, d: str) -> DataFrame:
    """Scores with a closed form: an equal name, one with its words turned round, and no text at all."""
    whole, turned = F.concat_ws(" ", "first_name", "last_name"), F.concat_ws(" ", "last_name", "first_name")
    texts = {"same": F.array(whole), "turned": F.array(F.lit(""), turned), "nothing": F.array(F.lit(""))}
    return load(s, d, "people").select("cust_id", *[fuzzy_score(whole, t).alias(name) for name, t in texts.items()])


add("fuzzy_scores", _fuzzy_scores,
    f"{_PEOPLE} SELECT cust_id, 100.0::DOUBLE AS same, 95.0::DOUBLE AS turned, 0.0::DOUBLE AS nothing FROM people")
add("preselected", lambda s, d: _search(s, d).withColumn("preselected", se.preselected()))


def _copies(s: SparkSession, d: str, **options) -> DataFrame:
    return find_subject_copies(
        load(s, d, "subjects"), lake.tables(s, d), lake.column_tags(s), lake.column_edges(s, d), nicknames(s),
        primary_keys=lake.PRIMARY_KEYS, **options,
    )


# Through lineage, a subject matched in customers leads up to the raw people and down to contacts and the
# lead traveller of bookings; one matched in bookings alone leads up to customers and the raw people by name.
_LINEAGE = ",\n".join([
    _DIRECT,
    "in_c AS (SELECT DISTINCT subject_id FROM d_customers), in_b AS (SELECT DISTINCT subject_id FROM d_bookings)",
    _name_hits("contacts", "contacts", _ID_PERSON, ["person"]),
    _person_hits("contacts", "contacts", {"class.email_address": "contact"}),
    _name_hits("lead", "bookings", _ID_BOOKING, ["concat_ws(' ', firstname_1, lastname_1)"]),
    "hits_lead AS (SELECT subject_id, 'class.name' AS tag, rn, row_id FROM nhits_lead)",
    _name_hits("raw", "people_raw", _ID_PERSON, ["concat_ws(' ', first_name, last_name)"]),
    _person_hits("raw", "people_raw", _PERSON_COLUMNS),
    _all_of("u_raw", "hits_raw", "bronze.crm.people_raw", _PERSON_TAGS, "SELECT subject_id FROM in_c"),
    _all_of("u_raw_name", "hits_raw", "bronze.crm.people_raw", "'class.name'", "SELECT subject_id FROM in_b EXCEPT SELECT subject_id FROM in_c"),
    _all_of("u_customers", "hits_customers", "silver.crm.customers", "'class.name'", "SELECT subject_id FROM in_b EXCEPT SELECT subject_id FROM in_c"),
    _all_of("w_contacts", "hits_contacts", "gold.mkt.contacts", "'class.name', 'class.email_address'", "SELECT subject_id FROM in_c"),
    _all_of("w_lead", "hits_lead", "silver.crm.bookings", "'class.name'", "SELECT subject_id FROM in_c EXCEPT SELECT subject_id FROM in_b"),
    """found AS (SELECT 0 AS r, * FROM direct UNION ALL SELECT 1, * FROM u_raw UNION ALL SELECT 1, * FROM u_raw_name UNION ALL SELECT 1, * FROM u_customers
 UNION ALL SELECT 2, * FROM w_contacts UNION ALL SELECT 2, * FROM w_lead)""",
])
add("find_subject_copies", lambda s, d: _copies(s, d, threshold=None).drop("score", "preselected"), f"""{_SUBJECTS}, {_LINEAGE}
SELECT subject_id, table_full_name, row_id, CASE min(r) WHEN 0 THEN 'direct' WHEN 1 THEN 'upstream' ELSE 'downstream' END AS provenance,
 max(matched_on) AS matched_on, max(n_rows) AS n_rows FROM found GROUP BY subject_id, table_full_name, row_id""")
add("find_subject_copies_scored", lambda s, d: _copies(s, d))



def _unsearched(s: SparkSession, d: str) -> DataFrame:
    """The lake without its gold table, and with an edge to a column that the raw people lack."""
    known = {name: table for name, table in lake.tables(s, d).items() if not name.startswith("gold.")}
    edges = lake.column_edges(s, d).drop("last_seen")
    more = s.createDataFrame([("bronze.crm.people_raw", "nick", "silver.crm.customers", "first_name")], edges.schema)
    return unsearched_tables(load(s, d, "subjects"), known, lake.column_tags(s), edges.unionByName(more), nicknames(s),
                             primary_keys=lake.PRIMARY_KEYS, threshold=None)


add("unsearched_tables", _unsearched, f"""{_SUBJECTS}, {_DIRECT},
in_c AS (SELECT DISTINCT subject_id FROM d_customers), in_b AS (SELECT DISTINCT subject_id FROM d_bookings),
named AS (SELECT DISTINCT subject_id FROM clean WHERE tag = 'class.name'), mailed AS (SELECT DISTINCT subject_id FROM clean WHERE tag = 'class.email_address')
SELECT subject_id, 'gold.mkt.contacts' AS table_full_name, 'table not registered' AS reason FROM in_c WHERE subject_id IN (FROM named) OR subject_id IN (FROM mailed)
UNION ALL SELECT subject_id, 'bronze.crm.people_raw', 'no such column: nick' FROM named WHERE subject_id IN (FROM in_c) OR subject_id IN (FROM in_b)""",)

_MATCHES = check_ctes("match_log")
add("case_summary", lambda s, d: se.case_summary(load(s, d, "match_log")), f"""{_MATCHES}
SELECT subject_id, count(DISTINCT table_full_name) AS n_tables, count(DISTINCT split_part(table_full_name, '.', 1)) AS n_catalogs,
 CAST(sum(n_rows) AS BIGINT) AS rows_found, CAST(sum(CASE WHEN score IS NULL OR score >= 90 THEN n_rows ELSE 0 END) AS BIGINT) AS rows_selected FROM match_log GROUP BY subject_id""")
_BY_TABLE = lambda s, d: load(s, d, "match_log").withColumn("subject_id", F.col("table_full_name"))
_UNIQUE = lambda s, d: _BY_TABLE(s, d).withColumn("row_id", F.concat_ws("/", "row_id", F.col("n_rows").cast("string"), "score")).distinct()
_FOUND_M = f"""{_MATCHES},
m AS (SELECT DISTINCT table_full_name AS subject_id, table_full_name, concat_ws('/', row_id, CAST(n_rows AS VARCHAR), CAST(score AS VARCHAR)) AS row_id, n_rows, score FROM match_log),
k AS (SELECT *, row_number() OVER (PARTITION BY subject_id, table_full_name ORDER BY score DESC NULLS FIRST, row_id) AS rank,
 count(*) OVER (PARTITION BY subject_id, table_full_name) AS n_found FROM m)"""
add("top_matches", lambda s, d: se.top_matches(_UNIQUE(s, d)), f"{_FOUND_M} SELECT subject_id, table_full_name, row_id, n_rows, score, n_found FROM k")
add("top_matches_for_review", lambda s, d: se.top_matches(_UNIQUE(s, d), 20), f"""{_FOUND_M}
SELECT subject_id, table_full_name, row_id, n_rows, score, CAST(rank AS INT) AS rank, n_found, n_found > 20 AS capped FROM k WHERE rank <= 20""")
_TIMES = check_ctes("timing_log")
add("timing_summary", lambda s, d: se.timing_summary(load(s, d, "timing_log")).withColumn("total_seconds", F.round("total_seconds", 2)),
    f"{_TIMES} SELECT phase, round(sum(seconds), 2) AS total_seconds, count(*) AS calls FROM timing_log GROUP BY phase")
add("slowest_tables", lambda s, d: se.slowest_tables(load(s, d, "timing_log")).withColumn("total_seconds", F.round("total_seconds", 2)), f"""{_TIMES}
SELECT table_name, round(sum(seconds), 2) AS total_seconds, count(*) AS calls FROM timing_log WHERE table_name IS NOT NULL
GROUP BY table_name ORDER BY sum(seconds) DESC, table_name LIMIT 15""")

# ---- erasure ------------------------------------------------------------------------------------

ERASED_AT = dt.datetime(2002, 1, 1, 9, 30)
_ERASE = check_ctes("selected_customers", "selected_bookings")
_CHECKED = f"""{_ERASE},
sel_b AS (SELECT request_id, {', '.join(BOOKING_FIELDS)}, count(*) AS n FROM selected_bookings GROUP BY ALL),
cb AS (SELECT request_id, CAST(sum(n) AS BIGINT) AS rows_selected FROM sel_b GROUP BY request_id),
mb AS (SELECT s.request_id, count(*) AS matched FROM sel_b s JOIN bookings b ON b.booking_id = s.booking_id GROUP BY s.request_id),
checks AS (SELECT request_id, 'silver.crm.customers' AS table_full_name, 'direct' AS provenance, 'class.email_address' AS matched_column_or_tag, count(*) AS rows_selected,
  count(*) AS matched_count, 'primary_key' AS row_targeting_method, TRUE AS ok FROM selected_customers GROUP BY request_id
 UNION ALL SELECT request_id, 'silver.crm.bookings', 'upstream', 'class.name', rows_selected, matched, 'full_row_equality', rows_selected = matched FROM cb JOIN mb USING (request_id)),
gates AS (SELECT request_id, bool_and(ok) AS all_ok FROM checks GROUP BY request_id)"""


def selected(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {table: load(s, d, name) for table, name in _SELECTED.items()}


def erased_tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {table: load(s, d, lake.TABLES[table]) for table in _SELECTED}


def dry_run(s: SparkSession, d: str) -> DataFrame:
    return er.dry_run(erased_tables(s, d), selected(s, d), lake.PRIMARY_KEYS)


def _retention(s: SparkSession) -> DataFrame:
    props = s.createDataFrame([("silver.crm.bookings", er.RETENTION_PROPERTY, "interval 30 days")], "full_table_name string, key string, value string")
    return er.retention(props)


def _erasure(s: SparkSession, d: str, write=None) -> dict:
    requests = load(s, d, "selected_customers").select(
        "request_id", F.col("email").alias("subject_ref"), F.lit("steward").alias("requested_by"), F.lit("Art. 17").alias("legal_basis"))
    return er.run_erasure(requests, erased_tables(s, d), selected(s, d), lake.PRIMARY_KEYS, _retention(s), ERASED_AT, write=write)


def _failing(df: DataFrame, path: str) -> None:
    """A write that cannot replace the customers."""
    if path.endswith("customers"):
        raise OSError("no space left")
    df.write.parquet(path)


_NOT_SET = "7 days (default — not explicitly set)"
_OTHER = er.ABORTED_BY_OTHER
_ITEMS = f"""items AS (SELECT request_id, table_full_name, provenance, matched_column_or_tag, rows_selected, CASE WHEN all_ok THEN matched_count ELSE 0 END AS rows_deleted,
 row_targeting_method, CASE WHEN table_full_name = 'silver.crm.bookings' THEN 'interval 30 days' ELSE '{_NOT_SET}' END AS vacuum_retention_raw,
 CAST(CASE WHEN table_full_name = 'silver.crm.bookings' THEN 30 ELSE 7 END AS INT) AS vacuum_retention_days,
 TIMESTAMP '2002-01-01 09:30:00' + CASE WHEN table_full_name = 'silver.crm.bookings' THEN INTERVAL 30 DAY ELSE INTERVAL 7 DAY END AS estimated_purge_by,
 CASE WHEN all_ok THEN 'SUCCEEDED' ELSE 'ABORTED' END AS execution_status,
 CASE WHEN NOT ok THEN concat(rows_selected, ' rows were selected but ', matched_count, ' match in the table.') WHEN NOT all_ok THEN '{_OTHER}' END AS error_message,
 TIMESTAMP '2002-01-01 09:30:00' AS executed_at FROM checks JOIN gates USING (request_id))"""
add("primary_keys", lambda s, d: er.primary_keys(load(s, d, "cat_keys"), load(s, d, "cat_constraints")).withColumn("key_columns", F.array_join("key_columns", ",")), f"""{check_ctes('cat_keys', 'cat_constraints')}
SELECT k.table_catalog, k.table_schema, k.table_name, string_agg(k.column_name, ',' ORDER BY k.ordinal_position) AS key_columns
FROM cat_keys k JOIN cat_constraints c ON c.table_catalog = k.table_catalog AND c.table_schema = k.table_schema AND c.table_name = k.table_name AND c.constraint_name = k.constraint_name
WHERE c.constraint_type = 'PRIMARY KEY' GROUP BY ALL""")
add("retention_days", lambda s, d: er.retention(load(s, d, "cat_props")), f"""{check_ctes('cat_props')}
SELECT full_table_name, value AS vacuum_retention_raw, CAST(CASE WHEN regexp_matches(value, '(?i)[0-9]+\\s*day') THEN regexp_extract(value, '(?i)([0-9]+)\\s*day', 1) ELSE '7' END AS INT) AS vacuum_retention_days
FROM cat_props WHERE key = 'delta.deletedFileRetentionDuration'""")
add("dry_run", dry_run, f"{_CHECKED} SELECT * FROM checks")
add("erasure_gate", lambda s, d: er.gate(dry_run(s, d)), f"{_CHECKED} SELECT * FROM gates")
add("erase_survivors", lambda s, d: _erasure(s, d)["survivors"]["silver.crm.bookings"], f"""{_CHECKED}
SELECT * FROM bookings WHERE booking_id NOT IN (SELECT booking_id FROM sel_b JOIN gates USING (request_id) WHERE all_ok)""")
add("erase_survivors_by_key", lambda s, d: _erasure(s, d)["survivors"]["silver.crm.customers"], f"""{_CHECKED}
SELECT * FROM customers WHERE cust_id NOT IN (SELECT cust_id FROM selected_customers JOIN gates USING (request_id) WHERE all_ok)""")
add("erasure_items", lambda s, d: _erasure(s, d)["items"], f"{_CHECKED}, {_ITEMS} SELECT * FROM items")
add("erasure_requests", lambda s, d: _erasure(s, d)["requests"], f"""{_CHECKED}
SELECT request_id, sha256(concat('sar-erasure-v1:', lower(email))) AS subject_ref_hash, 'steward' AS requested_by, 'Art. 17' AS legal_basis,
 TIMESTAMP '2002-01-01 09:30:00' AS requested_at, CASE WHEN all_ok THEN 'COMPLETED' ELSE 'ABORTED' END AS status, TIMESTAMP '2002-01-01 09:30:00' AS completed_at
FROM selected_customers JOIN gates USING (request_id)""")
add("erasure_requests_pending", lambda s, d: _erasure(s, d)["pending"], f"""{_CHECKED}
SELECT request_id, sha256(concat('sar-erasure-v1:', lower(email))) AS subject_ref_hash, 'steward' AS requested_by, 'Art. 17' AS legal_basis,
 TIMESTAMP '2002-01-01 09:30:00' AS requested_at, 'PENDING' AS status, CAST(NULL AS TIMESTAMP) AS completed_at FROM selected_customers""")
_FAILED = f"""{_CHECKED}, {_ITEMS}, failed AS (SELECT * REPLACE (
 CASE WHEN execution_status = 'SUCCEEDED' AND table_full_name LIKE '%customers' THEN 0 ELSE rows_deleted END AS rows_deleted,
 CASE WHEN execution_status = 'SUCCEEDED' AND table_full_name LIKE '%customers' THEN 'FAILED' ELSE execution_status END AS execution_status,
 CASE WHEN execution_status = 'SUCCEEDED' AND table_full_name LIKE '%customers' THEN 'no space left' ELSE error_message END AS error_message) FROM items)"""
add("erasure_items_failed", lambda s, d: _erasure(s, d, _failing)["items"], f"{_FAILED} SELECT * FROM failed")
add("erasure_requests_failed", lambda s, d: _erasure(s, d, _failing)["requests"].select("request_id", "status", "completed_at"), f"""{_FAILED}
SELECT request_id, CASE WHEN bool_or(execution_status = 'ABORTED') THEN 'ABORTED' WHEN bool_and(execution_status = 'FAILED') THEN 'FAILED' ELSE 'PARTIAL' END AS status,
 TIMESTAMP '2002-01-01 09:30:00' AS completed_at FROM failed GROUP BY request_id""")
add("erase_survivors_failed", lambda s, d: _erasure(s, d, _failing)["survivors"]["silver.crm.customers"], f"{check_ctes('customers')} SELECT * FROM customers")
_BOOKING_HASH = f"sha256(concat('sar-erasure-row-v1:', {json_text(BOOKING_FIELDS)}))"
add("erasure_row_hashes", lambda s, d: er.row_hashes({"silver.crm.bookings": load(s, d, "selected_bookings")}), f"""{_CHECKED}
SELECT request_id, 'silver.crm.bookings' AS table_full_name, {_BOOKING_HASH} AS row_key_hash, n FROM sel_b""")
add("packed_row_hashes", lambda s, d: er.pack_hashes(er.row_hashes({"silver.crm.bookings": load(s, d, "selected_bookings")})).select(
        "request_id", "table_full_name", "chunk", F.array_join("row_key_hash", ",").alias("hashes"), F.array_join(F.transform("row_key_count", lambda n: n.cast("string")), ",").alias("counts")),
    f"""{_CHECKED}, h AS (SELECT request_id, {_BOOKING_HASH} AS hash, n FROM sel_b)
SELECT request_id, 'silver.crm.bookings' AS table_full_name, CAST(0 AS INT) AS chunk, string_agg(hash, ',' ORDER BY hash) AS hashes, string_agg(CAST(n AS VARCHAR), ',' ORDER BY hash) AS counts FROM h GROUP BY request_id""")
add("request_status", lambda s, d: er.request_status(load(s, d, "erasure_items")), f"""{check_ctes('erasure_items')}
SELECT request_id, CASE WHEN count(CASE WHEN execution_status = 'ABORTED' THEN 1 END) > 0 THEN 'ABORTED' WHEN count(CASE WHEN execution_status = 'SUCCEEDED' THEN 1 END) = count(*) THEN 'COMPLETED'
 WHEN count(CASE WHEN execution_status = 'FAILED' THEN 1 END) = count(*) THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM erasure_items GROUP BY request_id""")
add("upsert_requests", lambda s, d: er.upsert_requests(load(s, d, "erasure_requests"), er.request_status(load(s, d, "erasure_items")), ERASED_AT),
    f"""{check_ctes('erasure_requests', 'erasure_items')}, st AS (SELECT request_id, CASE WHEN bool_or(execution_status = 'ABORTED') THEN 'ABORTED'
  WHEN count(*) = count(*) FILTER (execution_status = 'SUCCEEDED') THEN 'COMPLETED' WHEN count(*) = count(*) FILTER (execution_status = 'FAILED') THEN 'FAILED' ELSE 'PARTIAL' END AS s
  FROM erasure_items GROUP BY request_id)
SELECT r.request_id, subject_ref_hash, requested_by, legal_basis, requested_at, coalesce(s, status) AS status, CASE WHEN s IS NULL THEN completed_at ELSE TIMESTAMP '2002-01-01 09:30:00' END AS completed_at
FROM erasure_requests r LEFT JOIN st USING (request_id)""")

# ---- restore ------------------------------------------------------------------------------------


def _versions(s: SparkSession, d: str) -> DataFrame:
    return er.pre_delete_version(load(s, d, "deleted_items"), load(s, d, "table_history"))


_NEAREST = f"""{check_ctes('deleted_items', 'table_history')},
near AS (SELECT i.request_id, i.table_full_name, i.executed_at, h.version, h.commit_time, abs(date_diff('microsecond', h.commit_time, i.executed_at)) AS gap,
 row_number() OVER (PARTITION BY i.request_id, i.table_full_name, i.executed_at ORDER BY abs(date_diff('microsecond', h.commit_time, i.executed_at)), h.version) AS rn
 FROM deleted_items i JOIN table_history h ON h.table_full_name = i.table_full_name AND h.operation = 'DELETE')"""
add("pre_delete_version", _versions, f"""{_NEAREST} SELECT request_id, table_full_name, executed_at, version AS matched_version, version - 1 AS pre_delete_version,
 commit_time AS matched_timestamp, gap / 1000000.0::DOUBLE AS time_diff_seconds FROM near WHERE rn = 1""")
add("restorable_items", lambda s, d: er.restorable_items(load(s, d, "erasure_items"), load(s, d, "restorations"), CATALOG_NOW), f"""{check_ctes('erasure_items', 'restorations')}
SELECT i.*, TIMESTAMP '2001-11-05' < estimated_purge_by AS within_window FROM erasure_items i WHERE execution_status = 'SUCCEEDED'
 AND NOT EXISTS (SELECT 1 FROM restorations r WHERE r.request_id = i.request_id AND r.table_full_name = i.table_full_name AND r.execution_status = 'SUCCEEDED')""")


_DELETED_AT = {"silver.crm.customers": 23, "silver.crm.bookings": 17}


def _restores(s: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Both erased tables put back from their snapshots, and the audit rows of the restores."""
    run = _erasure(s, d)
    never = s.createDataFrame([], "request_id string, table_full_name string, execution_status string")
    items = er.restorable_items(run["items"], never, ERASED_AT)
    commits = [(n, v, ERASED_AT + dt.timedelta(seconds=2), "DELETE") for n, v in _DELETED_AT.items()]
    history = load(s, d, "table_history").unionByName(s.createDataFrame(commits, load(s, d, "table_history").schema))
    versions = er.pre_delete_version(items.select("request_id", "table_full_name", "executed_at"), history)
    tables, rows = {}, []
    for name in _SELECTED:
        of_table = F.col("table_full_name") == name
        tables[name], outcome, _ = er.restore_rows(run["survivors"][name], load(s, d, lake.TABLES[name]), run["hashes"].filter(of_table), items.filter(of_table))
        rows.append(er.restoration_rows(outcome, versions, name, "steward", "objection", ERASED_AT).drop("restoration_id"))
    return tables, rows[0].unionByName(rows[1])


add("restore_rows", lambda s, d: _restores(s, d)[0]["silver.crm.bookings"], f"{check_ctes('bookings')} SELECT * FROM bookings")
add("restore_rows_by_key", lambda s, d: _restores(s, d)[0]["silver.crm.customers"], f"{check_ctes('customers')} SELECT * FROM customers")
add("restoration_rows", lambda s, d: _restores(s, d)[1], f"""{_CHECKED}
SELECT request_id, table_full_name, 'steward' AS restored_by, 'objection' AS restoration_reason, CAST(CASE WHEN table_full_name LIKE '%bookings' THEN 16 ELSE 22 END AS BIGINT) AS pre_delete_version,
 CAST(rows_selected AS INT) AS rows_restored, 'SUCCEEDED' AS execution_status, CAST(NULL AS VARCHAR) AS error_message, TIMESTAMP '2002-01-01 09:30:00' AS restored_at
FROM checks JOIN gates USING (request_id) WHERE all_ok""")


def _shared_restores(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Pairs of requests that erased the same bookings: the second of each pair is restored after the first."""
    name = "silver.crm.bookings"
    chosen = load(s, d, "selected_shared")
    asked = chosen.select("request_id").distinct().select("request_id", F.col("request_id").alias("subject_ref"), F.lit("steward").alias("requested_by"), F.lit("Art. 17").alias("legal_basis"))
    run = er.run_erasure(asked, {name: load(s, d, "bookings")}, {name: chosen}, {}, _retention(s), ERASED_AT)
    table, done, outcomes = run["survivors"][name], None, []
    hashes = materialise(run["hashes"], "hashes")
    for first in ("r", "q"):
        turn = run["items"].filter(F.col("request_id").startswith(first) & (F.col("execution_status") == er.SUCCEEDED))
        table, outcome, entries = er.restore_rows(table, load(s, d, "bookings"), hashes, turn, er.ledger(hashes, done))
        done = entries if done is None else done.unionByName(entries)
        outcomes.append(outcome)
    return {"table": table, "items": run["items"], "outcomes": outcomes[0].unionByName(outcomes[1])}


_SHARED = f"""{check_ctes('selected_shared')},
w AS (SELECT request_id, booking_id, count(*) AS n FROM selected_shared GROUP BY ALL),
f AS (SELECT *, min(request_id) OVER (PARTITION BY booking_id) = request_id AS own, max(request_id) OVER (PARTITION BY booking_id) = request_id AS late FROM w)"""
add("erasure_items_shared", lambda s, d: _shared_restores(s, d)["items"].select("request_id", "rows_selected", "rows_deleted", "execution_status"),
    f"{_SHARED} SELECT request_id, CAST(sum(n) AS BIGINT) AS rows_selected, CAST(coalesce(sum(n) FILTER (own), 0) AS BIGINT) AS rows_deleted, 'SUCCEEDED' AS execution_status FROM f GROUP BY request_id")
add("restore_shared_rows", lambda s, d: _shared_restores(s, d)["table"], f"{check_ctes('bookings')} SELECT * FROM bookings")
add("restore_shared_outcomes", lambda s, d: _shared_restores(s, d)["outcomes"], f"""{_SHARED}
SELECT request_id, CAST(coalesce(sum(n) FILTER (late), 0) AS BIGINT) AS rows_restored, CAST(coalesce(sum(n) FILTER (NOT late), 0) AS BIGINT) AS rows_shared,
 'SUCCEEDED' AS execution_status, CAST(NULL AS VARCHAR) AS error_message FROM f GROUP BY request_id""")
add("erasure_requests_list", lambda s, d: er.newest_requests(load(s, d, "erasure_requests")), f"{check_ctes('erasure_requests')} SELECT * FROM erasure_requests ORDER BY requested_at DESC, request_id")
add("erasure_items_list", lambda s, d: er.items_of(load(s, d, "erasure_items"), None, "executed_at"), f"{check_ctes('erasure_items')} SELECT * FROM erasure_items ORDER BY request_id, executed_at")
add("restorations_list", lambda s, d: er.items_of(load(s, d, "restorations"), None, "restored_at"), f"{check_ctes('restorations')} SELECT * FROM restorations ORDER BY request_id, restored_at")

# ---- disclosure ---------------------------------------------------------------------------------

_FULL = "concat(table_catalog, '.', table_schema, '.', table_name)"


def _named(s: SparkSession, d: str, name: str) -> DataFrame:
    return load(s, d, name).withColumn("table_full_name", F.concat_ws(".", "table_catalog", "table_schema", "table_name"))


def _defaults(s: SparkSession, d: str) -> DataFrame:
    return di.default_columns(
        load(s, d, "scope_requests"), _named(s, d, "cat_columns").select("table_full_name", "column_name", "ordinal_position"),
        _named(s, d, "cat_tags"), load(s, d, "scope_searched"))


_SCOPE = f"""{check_ctes('scope_requests', 'scope_searched', 'cat_columns', 'cat_tags')},
cols AS (SELECT {_FULL} AS table_full_name, column_name, ordinal_position FROM cat_columns),
tags AS (SELECT {_FULL} AS table_full_name, column_name, tag_name FROM cat_tags WHERE tag_name LIKE 'class.%'),
def AS (SELECT r.request_id, r.table_full_name, c.column_name, c.ordinal_position, min(t.tag_name) AS tag_name, bool_and(t.tag_name IS NULL OR q.tag_name IS NOT NULL) AS included
 FROM scope_requests r JOIN cols c ON c.table_full_name = r.table_full_name LEFT JOIN tags t ON t.table_full_name = c.table_full_name AND t.column_name = c.column_name
 LEFT JOIN scope_searched q ON q.request_id = r.request_id AND q.tag_name = t.tag_name GROUP BY ALL)"""
add("columns_by_tag", lambda s, d: di.columns_by_tag(_named(s, d, "cat_tags")).withColumn("columns", F.array_join("columns", ",")), f"""{check_ctes('cat_tags')}
SELECT {_FULL} AS table_full_name, tag_name, string_agg(DISTINCT column_name, ',' ORDER BY column_name) AS columns FROM cat_tags WHERE tag_name LIKE 'class.%' GROUP BY ALL""")
add("default_columns", _defaults, f"{_SCOPE} SELECT * FROM def")
add("redacted_columns", lambda s, d: di.column_scope(_defaults(s, d)).select(
        "request_id", "table_full_name", F.array_join("columns_included", ",").alias("columns_included"), F.array_join("columns_redacted", ",").alias("columns_redacted")),
    f"""{_SCOPE} SELECT request_id, table_full_name, coalesce(string_agg(column_name, ',' ORDER BY ordinal_position) FILTER (included), '') AS columns_included,
 coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (NOT included), '') AS columns_redacted FROM def GROUP BY ALL""")
add("categories", lambda s, d: di.categories(_defaults(s, d)).withColumn("categories", F.array_join("categories", ",")),
    f"{_SCOPE} SELECT request_id, coalesce(string_agg(DISTINCT tag_name, ',' ORDER BY tag_name) FILTER (included), '') AS categories FROM def GROUP BY request_id")
add("retention_lines", lambda s, d: di.retention_lines(load(s, d, "scope_requests"), cat_compliance(s, d)), f"""{RC_CTES}, {check_ctes('scope_requests').removeprefix('WITH RECURSIVE ')}
SELECT request_id, table_full_name, CASE WHEN has_delete_at IS NULL THEN {_literal(di.NOT_TRACKED)}
 WHEN NOT has_delete_at THEN {_literal(di.NO_RETENTION)} ELSE concat({_literal(di.RETENTION_FROM)}, freshness_sla, {_literal(di.RETENTION_TO)}) END AS retention_line
FROM scope_requests LEFT JOIN rc ON rc.full_table_name = table_full_name""")
add("table_comments", lambda s, d: di.table_comments(load(s, d, "cat_tables"), load(s, d, "cat_columns")).withColumn(
        "column_comments", F.array_join(F.transform(F.array_sort(F.map_entries("column_comments")), lambda e: F.concat_ws("=", e.key, e.value)), ";")),
    f"""{check_ctes('cat_tables', 'cat_columns')} SELECT concat(t.table_catalog, '.', t.table_schema, '.', t.table_name) AS table_full_name, t.comment AS table_comment, n.column_comments
FROM cat_tables t LEFT JOIN (SELECT table_catalog, table_schema, table_name, string_agg(concat(column_name, '=', comment), ';' ORDER BY column_name) AS column_comments
 FROM cat_columns WHERE comment IS NOT NULL GROUP BY ALL) n ON n.table_catalog = t.table_catalog AND n.table_schema = t.table_schema AND n.table_name = t.table_name""")


def _request_matches(s: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, rows in selected(s, d).items():
        columns = er.row_columns(rows)
        ident = se.row_id(rows.select(*columns), lake.PRIMARY_KEYS.get(name))
        parts.append(rows.select("request_id", F.lit(name).alias("table_full_name"), ident.alias("row_id"), F.col("provenance"), F.col("matched_on")))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("request_id", "table_full_name", "row_id", "provenance", "matched_on").agg(F.count("*").alias("n_rows"))


def _disclosed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(matches per item, scope, column defaults, rows) for requests that searched by name and e-mail."""
    tables = erased_tables(s, d)
    matches = materialise(_request_matches(s, d), "matches")
    matched = matches.groupBy("request_id", "table_full_name").agg(F.min("provenance").alias("provenance"), F.min("matched_on").alias("matched_column_or_tag"))
    columns = columns_of(s, tables).withColumn("table_full_name", F.concat_ws(".", "table_catalog", "table_schema", "table_name"))
    tags = lake.column_tags(s).withColumn("table_full_name", F.concat_ws(".", "table_catalog", "table_schema", "table_name"))
    searched = matched.select("request_id", F.explode(F.array(F.lit("class.name"), F.lit("class.email_address"))).alias("tag_name")).distinct()
    defaults = di.default_columns(matched, columns.select("table_full_name", "column_name", "ordinal_position"), tags, searched)
    scope = di.column_scope(defaults)
    rows = di.disclosed_rows(matches.drop("provenance", "matched_on"), tables, scope, lake.PRIMARY_KEYS)
    return matched, scope, defaults, rows


_OPEN_CUSTOMER = ["cust_id", "first_name", "last_name", "email", "_inserted_at", "_updated_at", "_delete_at"]


def _cells_sql(source: str, table: str, columns: list[str], ident: str, n: str) -> str:
    return " UNION ALL ".join(
        f"SELECT request_id, '{table}' AS table_full_name, {ident} AS row_id, {n} AS n_rows, CAST({i} AS INT) AS position, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {source}"
        for i, c in enumerate(columns))


add("disclosure", lambda s, d: di.disclosure(_disclosed(s, d)[3]), f"""{_CHECKED}
{_cells_sql('selected_customers', 'silver.crm.customers', _OPEN_CUSTOMER, _ID_PERSON, '1')} UNION ALL {_cells_sql('sel_b', 'silver.crm.bookings', list(BOOKING_FIELDS), _ID_BOOKING, 'n')}""")


def _access_items(s: SparkSession, d: str) -> DataFrame:
    matched, scope, _, rows = _disclosed(s, d)
    return di.access_items(rows, scope, matched, ERASED_AT)


add("access_items", lambda s, d: _access_items(s, d).withColumn("columns_included", F.array_join("columns_included", ",")).withColumn("columns_redacted", F.array_join("columns_redacted", ",")), f"""{_CHECKED}
SELECT request_id, 'silver.crm.customers' AS table_full_name, 'direct' AS provenance, 'class.email_address' AS matched_column_or_tag, count(*) AS rows_disclosed,
 '{','.join(_OPEN_CUSTOMER)}' AS columns_included, 'address,age_int,card,dob,ip,phone' AS columns_redacted, TIMESTAMP '2002-01-01 09:30:00' AS generated_at FROM selected_customers GROUP BY request_id
UNION ALL SELECT request_id, 'silver.crm.bookings', 'upstream', 'class.name', rows_selected, '{','.join(BOOKING_FIELDS)}', '', TIMESTAMP '2002-01-01 09:30:00' FROM cb""")
add("access_row_hashes", lambda s, d: di.access_hashes(_disclosed(s, d)[3]).filter("table_full_name = 'silver.crm.bookings'"), f"""{_CHECKED}
SELECT request_id, 'silver.crm.bookings' AS table_full_name, sha256(concat('sar-access-row-v1:', {json_text(BOOKING_FIELDS)})) AS row_key_hash, n FROM sel_b""")
add("access_status", lambda s, d: di.access_status(load(s, d, "erasure_requests"), load(s, d, "erasure_items")), f"""{check_ctes('erasure_requests', 'erasure_items')}
SELECT request_id, CASE WHEN request_id IN (SELECT request_id FROM erasure_items) THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM erasure_requests""")
add("sla_state", lambda s, d: di.sla_state(load(s, d, "erasure_requests"), dt.datetime(2001, 7, 15)), f"""{check_ctes('erasure_requests')}
SELECT request_id, CAST(requested_at + INTERVAL 30 DAY AS DATE) AS deadline, CASE WHEN completed_at <= requested_at + INTERVAL 30 DAY THEN 'on time' WHEN completed_at IS NOT NULL THEN 'late'
 WHEN TIMESTAMP '2001-07-15' <= requested_at + INTERVAL 30 DAY THEN 'open' ELSE 'overdue' END AS sla_state FROM erasure_requests""")
add("access_requests_list", lambda s, d: er.newest_requests(load(s, d, "erasure_requests").drop("legal_basis")),
    f"{check_ctes('erasure_requests')} SELECT request_id, subject_ref_hash, requested_by, requested_at, status, completed_at FROM erasure_requests ORDER BY requested_at DESC, request_id")
add("release_violations", lambda s, d: di.release_violations(load(s, d, "release_requests").withColumnRenamed("request_no", "request_id")).withColumn("violations", F.array_join("violations", "; ")),
    f"""{check_ctes('release_requests')} SELECT * FROM (SELECT request_no AS request_id, concat_ws('; ', CASE WHEN purpose IS NULL OR trim(purpose) = '' THEN 'purpose missing' END,
 CASE WHEN recipients IS NULL OR trim(recipients) = '' THEN 'recipients missing' END, CASE WHEN unsure THEN 'automated decisions unsure' END,
 CASE WHEN NOT unsure AND n_systems > 0 AND none_confirmed THEN 'automated decisions contradictory' END,
 CASE WHEN NOT unsure AND n_systems = 0 AND NOT none_confirmed THEN 'automated decisions unanswered' END) AS violations FROM release_requests) WHERE violations <> ''""")


def _systems(s: SparkSession, requests: DataFrame, d: str) -> DataFrame:
    return di.decision_systems_for(requests, load(s, d, "system_choices"), decision_systems(s, REGISTER))


_REGISTER_ROWS = """VALUES ('fare-check', 'Fare check <travel>', 'A program sets the fare you are offered from the route and the time of booking.', 'You may ask a person to look at the fare again.'),
 ('loyalty-tier', 'Loyalty tier', 'Your tier follows from your journeys of the last year.', 'You may contest the tier.')"""
add("adm_systems", lambda s, d: _systems(s, load(s, d, "erasure_requests"), d), f"""{check_ctes('erasure_requests', 'system_choices')},
reg(id, system_name, statement, safeguards_text) AS ({_REGISTER_ROWS})
SELECT r.request_id, system_name, coalesce(statement, {_literal(di.NO_DECISION_SYSTEM)}) AS statement, safeguards_text
FROM erasure_requests r LEFT JOIN (SELECT c.request_id, g.* FROM system_choices c JOIN reg g ON g.id = c.system_id) x ON x.request_id = r.request_id""")


def reports(s: SparkSession, d: str) -> DataFrame:
    matched, scope, defaults, rows = _disclosed(s, d)
    items = di.retention_lines(di.access_items(rows, scope, matched, ERASED_AT), cat_compliance(s, d))
    requests = di.categories(defaults).select(
        "request_id", F.concat(F.lit("subject of "), "request_id").alias("subject_display"), F.lit("steward").alias("requested_by"),
        F.lit("Running bookings & billing").alias("purpose"), F.lit("None").alias("recipients"), "categories")
    comments = s.createDataFrame([("silver.crm.bookings", "Bookings", {"price": "in euro"})], "table_full_name string, table_comment string, column_comments map<string,string>")
    return rp.render_reports(requests, items, rows, comments, _systems(s, requests, d), ERASED_AT)


def _esc(value: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        value = f"replace({value}, '{plain}', '{entity}')"
    return value


def _report_rows_sql(source: str, table: str, columns: list[str], ident: str, n: str) -> str:
    cells = ", ".join(f"'<td>', {_esc(f'coalesce(CAST({c} AS VARCHAR), {_literal(str())})')}, '</td>'" for c in columns)
    copies = f"CASE WHEN {n} > 1 THEN concat('<td class=\"note\">', {n}, ' equal rows</td>') ELSE '' END"
    return f"SELECT request_id, '{table}' AS t, {ident} AS row_id, concat('<tr>', {cells}, {copies}, '</tr>') AS html FROM {source}"


def _report_sql() -> str:
    """The fragments put together as strings; items here fit one page of rows each."""
    when = ERASED_AT.strftime("%Y-%m-%d %H:%M UTC")
    untracked = _esc(_literal(di.NOT_TRACKED))
    left_out = "Columns left out, as the request does not cover them: address, age_int, card, dob, ip, phone."

    def opening(columns: list[str], rows: str, tag: str, way: str, about: str, notes: dict[str, str]) -> str:
        heads = "".join(f"<th>{c}{'<br>' + notes[c] if c in notes else ''}</th>" for c in columns)
        return f"""concat('<section><h3>', t, '</h3><p class="note">', {rows}, ' rows, found by {tag} ({way}) &middot; ', {untracked}, '</p>{about}<table><thead><tr>{heads}</tr></thead><tbody>')"""

    rights = "".join(f"<li>{what} (Art. {article})</li>" for what, article in rp.RIGHTS)
    customers = opening(_OPEN_CUSTOMER, "rows_selected", "class.email_address", "direct", f'<p class="note">{left_out}</p>', {})
    bookings = opening(list(BOOKING_FIELDS), "rows_selected", "class.name", "upstream", '<p class="note">About this table: Bookings</p>', {"price": "in euro"})
    return f"""{_CHECKED}, {check_ctes('system_choices').removeprefix('WITH RECURSIVE ')},
reg(id, system_name, statement, safeguards_text) AS ({_REGISTER_ROWS}),
asked AS (SELECT DISTINCT request_id FROM checks),
chosen AS (SELECT DISTINCT a.request_id, system_name, coalesce(statement, {_literal(di.NO_DECISION_SYSTEM)}) AS statement, safeguards_text
 FROM asked a LEFT JOIN (SELECT c.request_id, g.* FROM system_choices c JOIN reg g ON g.id = c.system_id) x ON x.request_id = a.request_id),
systems AS (SELECT request_id, string_agg(html, '' ORDER BY html) AS html FROM (SELECT request_id, concat(
 CASE WHEN system_name IS NOT NULL THEN concat('<h3>', {_esc('system_name')}, '</h3>') ELSE '' END, '<p>', {_esc('statement')}, '</p>',
 CASE WHEN safeguards_text IS NOT NULL THEN concat('<p class="note">', {_esc('safeguards_text')}, '</p>') ELSE '' END) AS html FROM chosen) GROUP BY request_id),
rows_html AS ({_report_rows_sql('selected_customers', 'silver.crm.customers', _OPEN_CUSTOMER, _ID_PERSON, '1')}
 UNION ALL {_report_rows_sql('sel_b', 'silver.crm.bookings', list(BOOKING_FIELDS), _ID_BOOKING, 'n')}),
items AS (SELECT request_id, table_full_name AS t, rows_selected FROM checks)
SELECT request_id, '0' AS section, CAST(0 AS INT) AS page, concat('<!doctype html><html><head><meta charset="utf-8"><title>Data report ', request_id,
 {_literal(f"</title><style>{rp._STYLE}</style></head><body><h1>{rp.TITLE}</h1>")}, '<p class="note">Request ', request_id, ' &middot; made on {when} &middot; by steward</p>',
 '<p>This report is about <strong>subject of ', request_id, '</strong>. It shows what our tables hold.</p><h2>Kinds of data</h2><p>class.email_address, class.name</p>',
 '<h2>Why we use it</h2><p>Running bookings &amp; billing</p><h2>Who receives it</h2><p>None</p><h2>Decisions made by programs</h2>', html, '<h2>Table by table</h2>') AS html
 FROM systems
UNION ALL SELECT request_id, concat('1 ', t), 0, CASE WHEN t LIKE '%customers' THEN {customers} ELSE {bookings} END FROM items
UNION ALL SELECT request_id, concat('1 ', t), 1, string_agg(html, chr(10) ORDER BY row_id, html) FROM rows_html GROUP BY request_id, t
UNION ALL SELECT request_id, concat('1 ', t), 2147483647, '</tbody></table></section>' FROM items
UNION ALL SELECT request_id, '2', 0, {_literal(f"<h2>What you may ask for</h2><ul>{rights}</ul></body></html>")} FROM asked"""


add("reports", reports, _report_sql())

# ---- stream -------------------------------------------------------------------------------------

STAMPED_AT = dt.datetime(2024, 2, 1)


def stamped_stream(s: SparkSession, d: str) -> DataFrame:
    """The events in three files by day, streamed one file at a time and kept as one stamped row per user."""
    work = scratch_folder(s, "stream")
    events = load(s, d, "events")
    day = F.dayofmonth("ts")
    for part in (day <= 10, (day > 10) & (day <= 20), day > 20):
        events.filter(part).coalesce(1).write.mode("append").parquet(f"{work}/in")
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in")
    clock = F.lit(STAMPED_AT) + F.make_dt_interval(F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2))
    stamp_stream(stream, ["user_id"], "ts", f"{work}/table", f"{work}/checkpoint", clock=clock).awaitTermination()
    table = read_latest(s, f"{work}/table", ["user_id"])
    return table.select("user_id", "ts", "event_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("_inserted_at", "_updated_at", "_delete_at")])


add("stamped_stream", stamped_stream, """WITH p AS (SELECT *, CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END AS part FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, min(part) OVER (PARTITION BY user_id) AS first_part FROM p)
SELECT user_id, ts, event_id, TIMESTAMP '2024-02-01' + to_days(first_part) AS _inserted_at, TIMESTAMP '2024-02-01' + to_days(part) AS _updated_at,
 TIMESTAMP '2024-02-01' + to_days(part) + INTERVAL 2555 DAY AS _delete_at FROM r WHERE rn = 1""")
