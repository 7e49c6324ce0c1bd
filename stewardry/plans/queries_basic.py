"""Registered queries on audit, masks, policies, lifecycle and lineage, each with its checking SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stewardry.functions import hashing, masks
from stewardry.functions.durations import relative_time, sla_minutes
from stewardry.functions.sql import register_functions
from stewardry.operators import audit, lifecycle as lc, lineage as ln, policies as po
from stewardry.plans import lake
from stewardry.session import scratch_folder
from stewardry.sources.derived import check_ctes, load, nested_audit_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def add(name: str, query: Query, check: str | None = None) -> None:
    QUERIES[name] = query
    if check is not None:
        CHECKS[name] = check


# ---- access audit -----------------------------------------------------------------------------

AUDIT_DAY = dt.date(2024, 1, 25)
_PII = """(service_name = 'unityCatalog' AND action_name = 'generateTemporaryTableCredential'
 AND (full_name_arg LIKE 'silver.%' OR full_name_arg LIKE 'gold.%'))"""
_LOGIN = f"(status_code IS NOT NULL AND status_code <> '200' AND action_name IN {audit.LOGIN_ACTIONS})"
_PERMS = f"action_name IN {audit.PERMISSION_ACTIONS}"
_D7 = "event_date BETWEEN DATE '2024-01-18' AND DATE '2024-01-25'"
_D30 = "event_date BETWEEN DATE '2023-12-26' AND DATE '2024-01-25'"
_AUDIT = check_ctes("audit_log")

add("audit_kpis", lambda s, d: audit.audit_kpis(nested_audit_log(s, d), AUDIT_DAY), f"""{_AUDIT}
SELECT count(CASE WHEN {_D7} AND {_PII} THEN 1 END) AS pii_access_7d,
 count(DISTINCT CASE WHEN {_D7} AND {_PII} THEN email END) AS unique_users_7d,
 count(CASE WHEN {_D7} AND {_LOGIN} THEN 1 END) AS failed_auth_7d,
 count(CASE WHEN {_PERMS} THEN 1 END) AS permission_changes_30d FROM audit_log WHERE {_D30}""")


def _kpis_by_state(s: SparkSession, d: str) -> DataFrame:
    """The KPIs of the report day and of a day ten days earlier, from states that two nightly runs appended."""
    log, folder = nested_audit_log(s, d), scratch_folder(s, "audit-states")
    split = AUDIT_DAY - dt.timedelta(days=3)
    audit.append_day_states(log.filter(F.col("event_date") <= F.lit(split)), folder)
    audit.append_day_states(log.filter(F.col("event_date") > F.lit(split)), folder)
    days = [audit.kpis_from_states(s, folder, day).withColumn("as_of", F.lit(day)) for day in (AUDIT_DAY, AUDIT_DAY - dt.timedelta(days=10))]
    return days[0].unionByName(days[1])


def _kpi_sql(day: dt.date) -> str:
    def since(n: int) -> str:
        return f"event_date BETWEEN DATE '{day - dt.timedelta(days=n)}' AND DATE '{day}'"

    return f"""SELECT count(CASE WHEN {since(7)} AND {_PII} THEN 1 END) AS pii_access_7d, count(DISTINCT CASE WHEN {since(7)} AND {_PII} THEN email END) AS unique_users_7d,
 count(CASE WHEN {since(7)} AND {_LOGIN} THEN 1 END) AS failed_auth_7d, count(CASE WHEN {_PERMS} THEN 1 END) AS permission_changes_30d, DATE '{day}' AS as_of
 FROM audit_log WHERE {since(30)}"""


add("audit_kpis_from_states", _kpis_by_state, f"{_AUDIT} {_kpi_sql(AUDIT_DAY)} UNION ALL {_kpi_sql(AUDIT_DAY - dt.timedelta(days=10))}")
add("pii_access", lambda s, d: audit.pii_access(nested_audit_log(s, d), AUDIT_DAY, tie="event_id"), f"""{_AUDIT}
SELECT event_time, email AS user_email, full_name_arg AS table_name, source_ip_address, status_code
FROM audit_log WHERE {_D7} AND {_PII} ORDER BY event_time DESC, event_id LIMIT 1000""")
add("pii_access_by_user", lambda s, d: audit.pii_access_by_user(nested_audit_log(s, d), AUDIT_DAY), f"""{_AUDIT}
SELECT email AS user_email, count(*) AS access_count FROM audit_log WHERE {_D7} AND {_PII}
GROUP BY email ORDER BY access_count DESC, email LIMIT 20""")
add("pii_access_by_day", lambda s, d: audit.pii_access_by_day(nested_audit_log(s, d), AUDIT_DAY), f"""{_AUDIT}
SELECT event_date, count(*) AS access_count FROM audit_log WHERE {_D7} AND {_PII} GROUP BY event_date""")
add("failed_auth", lambda s, d: audit.failed_auth(nested_audit_log(s, d), AUDIT_DAY, tie="event_id"), f"""{_AUDIT}
SELECT event_time, email AS user_email, action_name, source_ip_address, status_code, error_message
FROM audit_log WHERE {_D7} AND {_LOGIN} ORDER BY event_time DESC, event_id LIMIT 500""")
add("permission_changes", lambda s, d: audit.permission_changes(nested_audit_log(s, d), AUDIT_DAY, tie="event_id"), f"""{_AUDIT}
SELECT event_time, email AS user_email, action_name, securable_type AS object_type, full_name_arg AS object_name, status_code
FROM audit_log WHERE {_D30} AND {_PERMS} ORDER BY event_time DESC, event_id LIMIT 500""")

# ---- masks ------------------------------------------------------------------------------------

_PEOPLE = check_ctes("people")


def mask_email_sql(c: str) -> str:
    """By places: stars up to the first ``@``, stars up to the first dot of what follows it, and the rest as it is."""
    at, after = f"strpos({c}, '@')", f"string_split({c}, '@')[2]"
    dot = f"strpos({after}, '.')"
    stars = f"repeat('*', CASE {dot} WHEN 0 THEN length({after}) ELSE {dot} - 1 END)"
    rest = f"CASE WHEN {dot} > 1 THEN substr({after}, {dot} + 1) ELSE '' END"
    return f"CASE {at} WHEN 0 THEN '[REDACTED]' ELSE repeat('*', {at} - 1) || '@' || {stars} || '.' || {rest} END"


MASK_SQL = {
    "mask_email": mask_email_sql,
    "mask_dob": lambda c: f"make_date(CAST(floor(year({c}) / 10) * 10 AS BIGINT), 1, 1)",
    "mask_age_int": lambda c: f"CAST({c} - {c} % 10 AS BIGINT)",
    "mask_age_str": lambda c: f"coalesce((try_cast({c} AS BIGINT) // 10 || '0-') || (try_cast({c} AS BIGINT) // 10 || '9'), '[REDACTED]')",
    "mask_ip": lambda c: f"coalesce(nullif(regexp_extract(trim({c}), '^(\\d{{1,3}}\\.\\d{{1,3}})(\\.\\d{{1,3}}){{2}}$', 1), '') || '.*.*', '[REDACTED]')",
    "mask_credit_card": lambda c: f"'**** **** **** ' || right(regexp_replace({c}, '[^0-9]', '', 'g'), 4)",
    "mask_phone": lambda c: f"coalesce('+' || nullif(regexp_extract(trim({c}), '^(\\+|00)(\\d{{1,3}})', 2), '') || ' *** *** ****', '[REDACTED]')",
    "mask_location": lambda c: f"coalesce(nullif(regexp_extract(upper({c}), '([A-Z]{{1,2}}[0-9][0-9A-Z]?) [0-9][A-Z]{{2}}', 1), ''), '[REDACTED]')",
    "mask_sensitive": lambda c: "'[REDACTED]'",
}
_MASKED = {
    "mask_email": ("email", masks.mask_email), "mask_dob": ("dob", masks.mask_dob),
    "mask_age_int": ("age_int", masks.mask_age_number), "mask_age_str": ("age_str", masks.mask_age_text),
    "mask_ip": ("ip", masks.mask_ip), "mask_credit_card": ("card", masks.mask_credit_card),
    "mask_phone": ("phone", masks.mask_phone), "mask_location": ("address", masks.mask_location),
    "mask_sensitive": ("last_name", masks.mask_sensitive),
}
for _name, (_column, _mask) in _MASKED.items():
    add(
        _name,
        lambda s, d, c=_column, m=_mask: load(s, d, "people").select("cust_id", m(c).alias("masked")),
        f"{_PEOPLE} SELECT cust_id, {MASK_SQL[_name](_column)} AS masked FROM people",
    )

_FOUND = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"
add("mask_email_documents", lambda s, d: load(s, d, "documents")
    .select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({_FOUND})"))).alias("position", "found"))
    .select("doc_id", "position", masks.mask_email("found").alias("masked")),
    f"""SELECT doc_id, CAST(position AS INT) AS position, {mask_email_sql('found')} AS masked FROM (SELECT doc_id, unnest(found) AS found, unnest(range(len(found))) AS position
 FROM (SELECT doc_id, regexp_extract_all(text, '{_FOUND}') AS found FROM documents))""")


def _masked_by_sql(s: SparkSession, d: str) -> DataFrame:
    """Every mask and hash called in SQL, age as a number and as a text in one VARIANT function."""
    register_functions(s, "sr_")
    return s.sql("""SELECT cust_id, sr_mask_email(email) AS email, sr_mask_dob(dob) AS dob, CAST(sr_mask_age(CAST(age_int AS VARIANT)) AS STRING) AS age_int,
 CAST(sr_mask_age(CAST(age_str AS VARIANT)) AS STRING) AS age_str, sr_mask_age_number(age_int) AS age_number, sr_mask_age_text(age_str) AS age_text,
 sr_mask_ip(ip) AS ip, sr_mask_credit_card(card) AS card, sr_mask_phone(phone) AS phone, sr_mask_location(address) AS address,
 sr_mask_sensitive(CAST(last_name AS VARIANT)) AS last_name, sr_hash_erasure_subject_ref(email) AS subject, sr_hash_access_row_key(email) AS row_key
 FROM {people}""", people=load(s, d, "people"))


add("masks_in_sql", _masked_by_sql, f"""{_PEOPLE} SELECT cust_id, {mask_email_sql('email')} AS email, {MASK_SQL['mask_dob']('dob')} AS dob,
 CAST({MASK_SQL['mask_age_int']('age_int')} AS VARCHAR) AS age_int, {MASK_SQL['mask_age_str']('age_str')} AS age_str, {MASK_SQL['mask_age_int']('age_int')} AS age_number,
 {MASK_SQL['mask_age_str']('age_str')} AS age_text, {MASK_SQL['mask_ip']('ip')} AS ip, {MASK_SQL['mask_credit_card']('card')} AS card, {MASK_SQL['mask_phone']('phone')} AS phone,
 {MASK_SQL['mask_location']('address')} AS address, '[REDACTED]' AS last_name, sha256(concat('sar-erasure-v1:', lower(email))) AS subject,
 sha256(concat('sar-access-row-v1:', email)) AS row_key FROM people""")

# ---- policies ---------------------------------------------------------------------------------

_POLICIES = "policies(policy_name, catalog, tag_name) AS (VALUES " + ", ".join(
    f"('{po.POLICY_NAMES[m]}', '{c}', '{t}')" for c in po.POLICY_CATALOGS for t, m in po.TAG_MASKS.items()
) + ")"


def _customers_view(s: SparkSession, d: str, groups: tuple[str, ...]) -> DataFrame:
    return po.apply_masks(load(s, d, "customers"), "silver.crm.customers", lake.column_tags(s), po.default_policies(s), groups)


add("apply_masks_reader", lambda s, d: _customers_view(s, d, ("analysts",)), f"""{check_ctes('customers')}
SELECT cust_id, '[REDACTED]' AS first_name, '[REDACTED]' AS last_name, {mask_email_sql('email')} AS email,
 {MASK_SQL['mask_phone']('phone')} AS phone, {MASK_SQL['mask_location']('address')} AS address, {MASK_SQL['mask_dob']('dob')} AS dob,
 CAST({MASK_SQL['mask_age_int']('age_int')} AS INT) AS age_int, {MASK_SQL['mask_ip']('ip')} AS ip, {MASK_SQL['mask_credit_card']('card')} AS card,
 _inserted_at, _updated_at, _delete_at FROM customers""")
add("apply_masks_exempt", lambda s, d: _customers_view(s, d, ("data-stewards",)), f"{check_ctes('customers')} SELECT * FROM customers")
add("policy_conflicts", lambda s, d: po.policy_conflicts(load(s, d, "cat_tags"), po.default_policies(s)), f"""{check_ctes('cat_tags')}, {_POLICIES}
SELECT table_catalog, table_schema, table_name, column_name, count(DISTINCT policy_name) AS n_policies
FROM cat_tags t JOIN policies p ON p.catalog = t.table_catalog AND p.tag_name = t.tag_name
GROUP BY ALL HAVING count(DISTINCT policy_name) > 1""")
add("unmasked_tagged_columns", lambda s, d: po.unmasked_tagged_columns(load(s, d, "cat_tags"), po.default_policies(s)), f"""{check_ctes('cat_tags')}, {_POLICIES}
SELECT table_catalog, table_schema, table_name, column_name, tag_name FROM cat_tags t
WHERE tag_name LIKE 'class.%' AND table_catalog IN ('silver', 'gold')
 AND NOT EXISTS (SELECT 1 FROM policies p WHERE p.catalog = t.table_catalog AND p.tag_name = t.tag_name)""")

# ---- hashes -----------------------------------------------------------------------------------

for _kind in ("erasure", "access"):
    add(f"hash_subject_{_kind}",
        lambda s, d, k=_kind: load(s, d, "people").select("cust_id", hashing.hash_subject_ref(F.concat(F.lit("  "), F.upper("email")), k).alias("h")),
        f"{_PEOPLE} SELECT cust_id, sha256(concat('sar-{_kind}-v1:', lower(email))) AS h FROM people")
    add(f"hash_row_{_kind}",
        lambda s, d, k=_kind: load(s, d, "people").select("cust_id", hashing.hash_row_key(F.concat_ws("|", F.col("cust_id").cast("string"), "email"), k).alias("h")),
        f"{_PEOPLE} SELECT cust_id, sha256(concat('sar-{_kind}-row-v1:', CAST(cust_id AS VARCHAR), '|', email)) AS h FROM people")


def json_text(fields: dict[str, str]) -> str:
    """SQL for the JSON text of a row: ``fields`` maps a column to ``text``, ``number`` or ``time``."""
    parts = []
    for i, (column, kind) in enumerate(fields.items()):
        value = {
            "text": f"""concat('"', {column}, '"')""",
            "number": f"CAST({column} AS VARCHAR)",
            "time": f"""concat('"', strftime({column}, '%Y-%m-%d %H:%M:%S.%f'), '"')""",
            "date": f"""concat('"', CAST({column} AS VARCHAR), '"')""",
        }[kind]
        lead = "{" if i == 0 else ","
        parts.append(f"""'{lead}"{column}":', CASE WHEN {column} IS NULL THEN 'null' ELSE {value} END""")
    return "concat(" + ", ".join(parts) + ", '}')"


CUSTOMER_FIELDS = {
    "cust_id": "number", "first_name": "text", "last_name": "text", "email": "text", "phone": "text", "address": "text",
    "dob": "date", "age_int": "number", "ip": "text", "card": "text",
    "_inserted_at": "time", "_updated_at": "time", "_delete_at": "time",
}
BOOKING_FIELDS = {
    "booking_id": "number", "lead_id": "number", "firstname_1": "text", "lastname_1": "text", "firstname_2": "text",
    "lastname_2": "text", "price": "number", "_inserted_at": "time", "_updated_at": "time", "_delete_at": "time",
}
add("row_keys", lambda s, d: hashing.with_row_key(load(s, d, "customers"), "erasure").select("cust_id", "row_key"),
    f"{check_ctes('customers')} SELECT cust_id, sha256(concat('sar-erasure-row-v1:', {json_text(CUSTOMER_FIELDS)})) AS row_key FROM customers")

# ---- lifecycle --------------------------------------------------------------------------------

CATALOG_NOW = dt.datetime(2001, 11, 5)
ROWS_NOW = dt.datetime(2005, 1, 1)
_FULL = "concat(table_catalog, '.', table_schema, '.', table_name)"
_GOVERNED = "table_catalog IN ('bronze', 'silver', 'gold') AND table_schema <> 'information_schema'"
_SLA_SQL = """CASE WHEN regexp_matches(lower(trim(v)), '^[+-]?[0-9]+\\s*[mhdy]$')
 THEN CAST(regexp_extract(lower(trim(v)), '^([+-]?[0-9]+)', 1) AS INT) * CASE right(lower(trim(v)), 1)
  WHEN 'm' THEN 1 WHEN 'h' THEN 60 WHEN 'd' THEN 1440 ELSE 525960 END ELSE 1440 END"""
_FM = f"""fm AS (SELECT e.full_table_name, CASE WHEN f.error IS NULL THEN m.newest END AS max_updated_at,
 CASE WHEN f.error IS NULL THEN coalesce(p.v, '1d') END AS freshness_sla,
 CAST(CASE WHEN f.error IS NULL THEN {_SLA_SQL} ELSE 1440 END AS INT) AS freshness_sla_minutes, f.error
 FROM (SELECT {_FULL} AS full_table_name FROM cat_columns WHERE {_GOVERNED} AND column_name = '_updated_at') e
 LEFT JOIN (SELECT full_table_name, max(_updated_at) AS newest FROM cat_updates GROUP BY 1) m USING (full_table_name)
 LEFT JOIN (SELECT full_table_name, value AS v FROM cat_props WHERE key = 'platform.freshness_sla') p USING (full_table_name)
 LEFT JOIN cat_failures f USING (full_table_name))"""
_FLAGS = [f"has{c}" for c in lc.PLATFORM_COLUMNS]
_SC = f"""held AS (SELECT table_catalog, table_schema, table_name, list(column_name) AS names FROM cat_columns GROUP BY ALL),
sc AS (SELECT DISTINCT table_catalog, table_schema, table_name, {_FULL} AS full_table_name,
 {', '.join(f"coalesce(list_contains(names, '{c}'), FALSE) AS has{c}" for c in lc.PLATFORM_COLUMNS)}
 FROM cat_tables LEFT JOIN held USING (table_catalog, table_schema, table_name)
 WHERE list_contains({list(lc.DATA_CATALOGS)}, table_catalog) AND table_schema <> 'information_schema'
  AND table_type = 'MANAGED' AND NOT regexp_matches(table_name, '^_|^event_log.|_(drift|profile)_metrics$'))"""
#: States of a table's freshness; the first that holds counts.
_STATES = {"NO_COLUMN": "NOT has_updated_at", "ERROR": "error IS NOT NULL", "NEVER_UPDATED": "max_updated_at IS NULL", "STALE": "late", "FRESH": "TRUE"}
_RC = f"""states(place, label) AS (VALUES {', '.join(f"({k}, '{label}')" for k, label in enumerate(_STATES, 1))}),
aged AS (SELECT *, coalesce(fm.freshness_sla_minutes, 1440) AS minutes,
 coalesce((epoch_us(TIMESTAMP '2001-11-05') - epoch_us(max_updated_at)) // 60000000 > coalesce(fm.freshness_sla_minutes, 1440), FALSE) AS late
 FROM sc LEFT JOIN fm USING (full_table_name)),
rc AS (SELECT table_catalog, table_schema, table_name, full_table_name,
 {', '.join(f"['{lc.NON_COMPLIANT}', '{lc.COMPLIANT}'][1 + CAST({flag} AS INT)] AS {name}_status" for flag, name in zip(_FLAGS, ("insertion", "freshness", "retention")))},
 (SELECT min_by(label, place) FROM states WHERE [{', '.join(_STATES.values())}][place]) AS sla_status,
 {', '.join(_FLAGS)}, coalesce(freshness_sla, '1d') AS freshness_sla, CAST(minutes AS INT) AS freshness_sla_minutes, max_updated_at, error AS freshness_error
 FROM aged)"""
_CAT = check_ctes("cat_tables", "cat_columns", "cat_props", "cat_updates", "cat_failures")
RC_CTES = f"{_CAT}, {_FM}, {_SC}, {_RC}"
_BAD = "sla_status IN ('STALE', 'NEVER_UPDATED', 'ERROR', 'NO_COLUMN')"


def cat_metrics(s: SparkSession, d: str) -> DataFrame:
    expected = lc.tables_with_column(load(s, d, "cat_columns"), "_updated_at")
    return lc.freshness_metrics(expected, load(s, d, "cat_updates"), load(s, d, "cat_props"), load(s, d, "cat_failures"))


def cat_compliance(s: SparkSession, d: str) -> DataFrame:
    structure = lc.structural_compliance(load(s, d, "cat_tables"), load(s, d, "cat_columns"))
    return lc.retention_compliance(structure, cat_metrics(s, d), CATALOG_NOW)


def _lake_props(s: SparkSession) -> DataFrame:
    rows = [(n, lc.SLA_PROPERTY, v) for n, v in zip(lake.TABLES, ("4h", "7d", "bad"))]
    return s.createDataFrame(rows, "full_table_name string, key string, value string")


def _lake_freshness(s: SparkSession, d: str) -> DataFrame:
    names = s.createDataFrame([(n,) for n in lake.TABLES], "full_table_name string")
    return lc.freshness_metrics(names, lc.update_times(lake.tables(s, d)), _lake_props(s))


_LAKE = check_ctes(*lake.TABLES.values())
add("sla_minutes", lambda s, d: lc.table_property(load(s, d, "cat_props"), lc.SLA_PROPERTY).select("full_table_name", sla_minutes("value").alias("minutes")),
    f"{check_ctes('cat_props')} SELECT full_table_name, CAST({_SLA_SQL} AS INT) AS minutes FROM (SELECT full_table_name, value AS v FROM cat_props WHERE key = 'platform.freshness_sla')")
add("tables_with_updated_at", lambda s, d: lc.tables_with_column(load(s, d, "cat_columns"), "_updated_at"),
    f"{check_ctes('cat_columns')} SELECT {_FULL} AS full_table_name FROM cat_columns WHERE {_GOVERNED} AND column_name = '_updated_at'")
add("freshness_metrics", cat_metrics, f"{_CAT}, {_FM} SELECT * FROM fm")
add("freshness_metrics_lake", _lake_freshness, _LAKE + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS full_table_name, max(_updated_at) AS max_updated_at, '{sla}' AS freshness_sla, CAST({m} AS INT) AS freshness_sla_minutes, CAST(NULL AS VARCHAR) AS error FROM {t}"
    for (n, t), (sla, m) in zip(lake.TABLES.items(), (("4h", 240), ("7d", 10080), ("bad", 1440), ("1d", 1440)))))


def _freshness_table(s: SparkSession, d: str) -> DataFrame:
    """The metrics table, written from part of the catalog and then replaced by the whole."""
    path = scratch_folder(s, "freshness")
    lc.write_metrics(cat_metrics(s, d).filter("error IS NULL"), path)
    lc.write_metrics(cat_metrics(s, d), path)
    return s.read.parquet(path)


add("freshness_table", _freshness_table, f"{_CAT}, {_FM} SELECT * FROM fm")
add("structural_compliance", lambda s, d: lc.structural_compliance(load(s, d, "cat_tables"), load(s, d, "cat_columns")), f"{_CAT}, {_SC} SELECT * FROM sc")
add("retention_compliance", cat_compliance, f"{RC_CTES} SELECT * FROM rc")
add("problems_first", lambda s, d: lc.problems_first(cat_compliance(s, d)).select("full_table_name", "sla_status"), f"""{RC_CTES}
SELECT full_table_name, sla_status FROM rc ORDER BY CASE WHEN NOT has_inserted_at OR NOT has_updated_at OR NOT has_delete_at OR {_BAD} THEN 0 ELSE 1 END, table_catalog, table_schema, table_name""")
add("stale_tables", lambda s, d: lc.stale_tables(cat_compliance(s, d)), f"""{RC_CTES}
SELECT full_table_name, max_updated_at, freshness_sla, freshness_sla_minutes, sla_status FROM rc WHERE {_BAD}""")
add("non_compliant_tables", lambda s, d: lc.non_compliant_tables(cat_compliance(s, d)), f"""{RC_CTES}
SELECT table_catalog, table_schema, table_name, insertion_status, freshness_status, retention_status, sla_status, freshness_sla_minutes, freshness_sla, max_updated_at
FROM rc WHERE insertion_status = 'NON-COMPLIANT' OR freshness_status = 'NON-COMPLIANT' OR retention_status = 'NON-COMPLIANT' OR {_BAD}""")
_MEASURES = f"""count(*) AS total_tables, count(CASE WHEN has_inserted_at AND has_updated_at AND has_delete_at THEN 1 END) AS fully_compliant_tables,
 count(CASE WHEN NOT (has_inserted_at AND has_updated_at AND has_delete_at) THEN 1 END) AS non_compliant_tables,
 count(CASE WHEN {_BAD} THEN 1 END) AS stale_tables, count(CASE WHEN sla_status = 'NEVER_UPDATED' THEN 1 END) AS never_updated,
 round(count(CASE WHEN has_inserted_at AND has_updated_at AND has_delete_at THEN 1 END) * 100.0::DOUBLE / count(*), 1) AS compliance_pct,
 round(count(CASE WHEN {_BAD} THEN 1 END) * 100.0::DOUBLE / count(*), 1) AS stale_pct"""
add("compliance_metrics_total", lambda s, d: lc.compliance_metrics(cat_compliance(s, d)), f"{RC_CTES} SELECT {_MEASURES} FROM rc")
add("compliance_metrics_by_catalog", lambda s, d: lc.compliance_metrics(cat_compliance(s, d), ["table_catalog"]),
    f"{RC_CTES} SELECT table_catalog, {_MEASURES} FROM rc GROUP BY table_catalog")
add("compliance_metrics_by_schema", lambda s, d: lc.compliance_metrics(cat_compliance(s, d), ["table_catalog", "table_schema"]),
    f"{RC_CTES} SELECT table_catalog, table_schema, {_MEASURES} FROM rc GROUP BY table_catalog, table_schema")
add("compliance_metrics_rollup", lambda s, d: lc.compliance_metrics_rollup(cat_compliance(s, d)),
    f"{RC_CTES} SELECT table_catalog, table_schema, {_MEASURES} FROM rc GROUP BY ROLLUP (table_catalog, table_schema)")
add("ttl_candidates", lambda s, d: lc.ttl_candidates(load(s, d, "cat_tables"), load(s, d, "cat_columns")), f"""{_CAT}
SELECT concat(c.table_catalog, '.', c.table_schema, '.', c.table_name) AS full_table_name FROM cat_columns c JOIN cat_tables t
 ON t.table_catalog = c.table_catalog AND t.table_schema = c.table_schema AND t.table_name = c.table_name
WHERE c.table_catalog IN ('bronze', 'silver', 'gold') AND c.column_name = '_delete_at' AND c.table_schema <> 'information_schema'
 AND t.table_type NOT IN ('VIEW', 'STREAMING_TABLE', 'MATERIALIZED_VIEW') AND c.table_name NOT LIKE '\\_%' ESCAPE '\\'""")
add("expire_rows", lambda s, d: (lambda parts: parts[0].select("booking_id", F.lit("kept").alias("state")).unionByName(
        parts[1].select("booking_id", F.lit("expired").alias("state"))))(lc.expire_rows(load(s, d, "bookings"), ROWS_NOW)),
    f"{check_ctes('bookings')} SELECT booking_id, CASE WHEN _delete_at <= TIMESTAMP '2005-01-01' THEN 'expired' ELSE 'kept' END AS state FROM bookings")
_EXPIRY = " UNION ALL ".join(
    f"SELECT '{n}' AS full_table_name, count(CASE WHEN _delete_at <= TIMESTAMP '2005-01-01' THEN 1 END) AS rows_expired, count(CASE WHEN _delete_at <= TIMESTAMP '2005-01-01' THEN NULL ELSE 1 END) AS rows_kept, 'applied' AS status FROM {t}"
    for n, t in lake.TABLES.items()) + " UNION ALL SELECT full_table_name, 0, 0, 'failed' FROM cat_failures"


def _expired_by_period(s: SparkSession, d: str) -> DataFrame:
    """The bookings laid out by month of expiry, swept once ahead of the day and then on it: what is left."""
    folder = scratch_folder(s, "by-period")
    lc.write_by_period(load(s, d, "bookings"), folder)
    for day in (ROWS_NOW - dt.timedelta(days=100), ROWS_NOW):
        lc.sweep_periods(s, folder, day)
    return lc.read_by_period(s, folder)


add("expire_by_period", _expired_by_period, f"{check_ctes('bookings')} SELECT * FROM bookings WHERE _delete_at IS NULL OR _delete_at > TIMESTAMP '{ROWS_NOW}'")
_expiry = lambda s, d: lc.expiry_report(lake.tables(s, d), ROWS_NOW, load(s, d, "cat_failures"))
add("expiry_report", _expiry, f"{check_ctes(*lake.TABLES.values(), 'cat_failures')} {_EXPIRY}")
add("expiry_summary", lambda s, d: lc.expiry_summary(_expiry(s, d)), f"""{check_ctes(*lake.TABLES.values(), 'cat_failures')}
SELECT count(CASE WHEN status = 'applied' THEN 1 END) AS applied, count(CASE WHEN status = 'failed' THEN 1 END) AS errors,
 count(CASE WHEN status = 'failed' THEN 1 END) > 0 AS run_failed FROM ({_EXPIRY})""")

# ---- lineage ----------------------------------------------------------------------------------

LINEAGE_DAY = dt.date(2001, 11, 5)
ALL_DAYS = 5000
#: A day well inside the log, so that later events must be left out.
COMPACT_DAY = dt.date(2000, 5, 4)
_SPLIT = dt.date(2000, 11, 5)
_TLOG = check_ctes("table_lineage_log")
_CLOG = check_ctes("column_lineage_log")


def _table_edges_sql(name: str, since: str, until: str = "2001-11-05") -> str:
    pick = ", ".join(f"max(CASE WHEN event_time = newest THEN {c} END) AS {c}" for c in ("source_table_catalog", "target_table_catalog", "entity_type"))
    return f"""{name} AS (SELECT source_table_full_name, target_table_full_name, {pick}, max(event_time) AS last_seen FROM (
 SELECT source_table_full_name, target_table_full_name, source_table_catalog, target_table_catalog, coalesce(entity_type, 'unknown') AS entity_type,
  event_time, max(event_time) OVER (PARTITION BY source_table_full_name, target_table_full_name) AS newest
 FROM table_lineage_log WHERE source_table_full_name IS NOT NULL AND target_table_full_name IS NOT NULL
  AND NOT regexp_matches(source_table_full_name, '_(drift|profile)_metrics$') AND NOT regexp_matches(target_table_full_name, '_(drift|profile)_metrics$')
  AND event_date BETWEEN DATE '{since}' AND DATE '{until}') GROUP BY 1, 2)"""


def _column_edges_sql(name: str, since: str, until: str = "2001-11-05") -> str:
    return f"""{name} AS (SELECT source_table_full_name, source_column_name, target_table_full_name, target_column_name, max(event_time) AS last_seen
 FROM column_lineage_log WHERE source_table_full_name IS NOT NULL AND target_table_full_name IS NOT NULL AND event_date BETWEEN DATE '{since}' AND DATE '{until}' GROUP BY ALL)"""


def all_table_edges(s: SparkSession, d: str) -> DataFrame:
    return ln.compact_table_edges(load(s, d, "table_lineage_log"), LINEAGE_DAY, ALL_DAYS)


def all_column_edges(s: SparkSession, d: str) -> DataFrame:
    return ln.compact_column_edges(load(s, d, "column_lineage_log"), LINEAGE_DAY, ALL_DAYS)


def _merged(s: SparkSession, d: str, log: str, compact, merge) -> DataFrame:
    """The log in two batches, the newer one merged first: batches may arrive in any order."""
    rows, split = load(s, d, log), F.lit(_SPLIT)
    newer = compact(rows.filter(F.col("event_date") >= split), LINEAGE_DAY, ALL_DAYS)
    older = compact(rows.filter(F.col("event_date") < split), LINEAGE_DAY, ALL_DAYS)
    return merge(newer, older)


add("compact_table_edges", lambda s, d: ln.compact_table_edges(load(s, d, "table_lineage_log"), COMPACT_DAY, 365),
    f"{_TLOG}, {_table_edges_sql('te', '1999-05-05', '2000-05-04')} SELECT * FROM te")
add("compact_column_edges", lambda s, d: ln.compact_column_edges(load(s, d, "column_lineage_log"), COMPACT_DAY, 365),
    f"{_CLOG}, {_column_edges_sql('ce', '1999-05-05', '2000-05-04')} SELECT * FROM ce")
add("merge_table_edges", lambda s, d: _merged(s, d, "table_lineage_log", ln.compact_table_edges, ln.merge_table_edges),
    f"{_TLOG}, {_table_edges_sql('te', '1988-01-01')} SELECT * FROM te")
add("merge_column_edges", lambda s, d: _merged(s, d, "column_lineage_log", ln.compact_column_edges, ln.merge_column_edges),
    f"{_CLOG}, {_column_edges_sql('ce', '1988-01-01')} SELECT * FROM ce")


#: The last days of the log, as a nightly batch.
_LAST_DAYS = 30


def _refreshed(s: SparkSession, d: str, log: str, compact) -> tuple[str, list[int], list[dict]]:
    """A cache written from the log up to a day and refreshed by a nightly batch: its path, the buckets that the batch
    rewrote, and the buckets' files before and after."""
    rows, path = load(s, d, log), scratch_folder(s, "cache")
    night = F.lit(LINEAGE_DAY - dt.timedelta(days=_LAST_DAYS))
    files = []
    touched: list[int] = []
    for part in (rows.filter(F.col("event_date") < night), rows.filter(F.col("event_date") >= night)):
        touched = ln.refresh_cache(path, compact(part, LINEAGE_DAY, ALL_DAYS), buckets=256)
        seen = s.read.parquet(path).groupBy("bucket").agg(F.sort_array(F.collect_set("_metadata.file_path")).alias("files"))
        files.append({r["bucket"]: r["files"] for r in seen.collect()})
    return path, touched, files


def _untouched(s: SparkSession, d: str) -> DataFrame:
    """Whether the nightly batch replaced the files of its own buckets and kept those of all others."""
    _, touched, (before, after) = _refreshed(s, d, "column_lineage_log", ln.compact_column_edges)
    kept = all(after[b] == names for b, names in before.items() if b not in touched)
    replaced = all(not set(after[b]) & set(before.get(b, [])) for b in touched)
    return s.createDataFrame([(kept, replaced, set(before) <= set(after))], "others_kept boolean, own_replaced boolean, none_lost boolean")


add("lineage_cache_tables", lambda s, d: ln.read_cache(s, _refreshed(s, d, "table_lineage_log", ln.compact_table_edges)[0]),
    f"{_TLOG}, {_table_edges_sql('te', '1988-01-01')} SELECT * FROM te")
add("lineage_cache_columns", lambda s, d: ln.read_cache(s, _refreshed(s, d, "column_lineage_log", ln.compact_column_edges)[0]),
    f"{_CLOG}, {_column_edges_sql('ce', '1988-01-01')} SELECT * FROM ce")
add("lineage_cache_untouched", _untouched, "SELECT TRUE AS others_kept, TRUE AS own_replaced, TRUE AS none_lost")


def _trace(s: SparkSession, d: str, direction: str) -> DataFrame:
    seed = "gold.s1.t0" if direction == "up" else "silver.s1.t0"
    return ln.trace_tables(all_table_edges(s, d), s.createDataFrame([(seed,)], "table_full_name string"), direction)


def _trace_sql(direction: str) -> str:
    near, far, seed, alias, cat = (
        ("target", "source", "gold.s1.t0", "upstream_table", "source_catalog") if direction == "up"
        else ("source", "target", "silver.s1.t0", "downstream_table", "target_catalog")
    )
    return f"""reach_{direction}(node, depth) AS (SELECT '{seed}', 0 UNION SELECT {far}_table_full_name, depth + 1 FROM reach_{direction} JOIN te ON {near}_table_full_name = node WHERE depth < (SELECT count(DISTINCT source_table_full_name) + count(DISTINCT target_table_full_name) FROM te)),
trace_{direction} AS (SELECT {near}_table_full_name AS matched_table, {far}_table_full_name AS {alias}, {far}_table_catalog AS {cat}, entity_type, last_seen, CAST(n.depth + 1 AS INT) AS depth
 FROM (SELECT node, min(depth) AS depth FROM reach_{direction} GROUP BY node) n JOIN te ON {near}_table_full_name = node)"""


_TE_ALL = _table_edges_sql("te", "1988-01-01")
for _dir in ("up", "down"):
    add(f"trace_tables_{_dir}", lambda s, d, k=_dir: _trace(s, d, k), f"{_TLOG}, {_TE_ALL}, {_trace_sql(_dir)} SELECT * FROM trace_{_dir}")


def _deep(s: SparkSession, d: str) -> DataFrame:
    """Chains of 300 tables, walked from their first ones all at once."""
    starts = load(s, d, "deep_edges").filter("level = 0").select(F.col("source_table_full_name").alias("table_full_name"))
    return ln.trace_tables(load(s, d, "deep_edges").drop("level"), starts, "down")


add("trace_tables_deep", _deep, f"""{check_ctes('deep_edges')}
SELECT source_table_full_name AS matched_table, target_table_full_name AS downstream_table, target_table_catalog AS target_catalog, entity_type, last_seen,
 CAST(level + 1 AS INT) AS depth FROM deep_edges""")


def traced_columns(s: SparkSession, d: str, direction: str) -> DataFrame:
    stop = "bronze." if direction == "up" else None
    return ln.trace_columns(all_column_edges(s, d), load(s, d, "trace_starts"), direction, stop_prefix=stop)


def traced_columns_sql(direction: str) -> str:
    near, far = ("target", "source") if direction == "up" else ("source", "target")
    stop = " AND (depth = 0 OR t NOT LIKE 'bronze.%')" if direction == "up" else ""
    return f"""{check_ctes('column_lineage_log', 'trace_starts')}, {_column_edges_sql('ce', '1988-01-01')},
hops AS (SELECT DISTINCT {near}_table_full_name AS nt, {near}_column_name AS nc, {far}_table_full_name AS ft, {far}_column_name AS fc FROM ce
 WHERE source_column_name IS NOT NULL AND target_column_name IS NOT NULL AND len(string_split({far}_table_full_name, '.')) = 3),
reach(st, sc, t, c, depth) AS (SELECT DISTINCT table_full_name, column_name, table_full_name, column_name, 0 FROM trace_starts
 UNION SELECT st, sc, ft, fc, depth + 1 FROM reach JOIN hops ON nt = t AND nc = c WHERE depth < (SELECT count(DISTINCT (nt, nc)) + 1 FROM hops){stop}),
near AS (SELECT st, sc, t, c, min(depth) AS depth FROM reach GROUP BY ALL),
found AS (SELECT subject_id, t, c, depth, tag, value, row_number() OVER (PARTITION BY subject_id, t, c ORDER BY depth, tag, value) AS rn
 FROM trace_starts JOIN near ON st = table_full_name AND sc = column_name),
traced AS (SELECT subject_id, t AS table_full_name, c AS column_name, tag, value, CAST(depth AS INT) AS depth FROM found f WHERE rn = 1
 AND NOT EXISTS (SELECT 1 FROM trace_starts o WHERE o.subject_id = f.subject_id AND o.table_full_name = f.t AND o.column_name = f.c))"""


for _dir in ("up", "down"):
    add(f"trace_columns_{_dir}", lambda s, d, k=_dir: traced_columns(s, d, k), f"{traced_columns_sql(_dir)} SELECT * FROM traced")
add("lineage_conditions", lambda s, d: ln.lineage_conditions(traced_columns(s, d, "up")).withColumn("columns", F.array_join("columns", ",")),
    f"""{traced_columns_sql('up')} SELECT subject_id, table_full_name, tag, string_agg(DISTINCT column_name, ',' ORDER BY column_name) AS columns, min(value) AS value
FROM traced GROUP BY subject_id, table_full_name, tag""")


def relative_sql(ts: str, now: str) -> str:
    days = f"greatest(CAST(floor(date_diff('second', {ts}, {now}) / 86400) AS BIGINT), 0)"
    return f"""CASE WHEN {ts} IS NULL THEN 'unknown' WHEN {days} = 0 THEN 'today' WHEN {days} = 1 THEN 'yesterday' WHEN {days} < 7 THEN concat({days}, ' days ago')
 WHEN {days} < 14 THEN 'last week' WHEN {days} < 30 THEN concat({days} // 7, ' weeks ago') WHEN {days} < 60 THEN 'last month' ELSE concat({days} // 30, ' months ago') END"""


add("relative_time", lambda s, d: load(s, d, "lineitem").select("l_orderkey", "l_linenumber",
        relative_time("l_shipdate", F.lit(dt.datetime(2001, 11, 5, 12)).cast("timestamp_ntz")).alias("label")),
    f"SELECT l_orderkey, l_linenumber, {relative_sql('l_shipdate', chr(39).join(['TIMESTAMP ', '2001-11-05 12:00:00', '']))} AS label FROM lineitem")
add("lineage_summary", lambda s, d: ln.lineage_summary(_trace(s, d, "up"), _trace(s, d, "down"), CATALOG_NOW), f"""{_TLOG}, {_TE_ALL}, {_trace_sql('up')}, {_trace_sql('down')},
both_ways AS (SELECT upstream_table AS name, '↑ Upstream' AS direction, entity_type, last_seen, depth FROM trace_up
 UNION ALL SELECT downstream_table, '↓ Downstream', entity_type, last_seen, depth FROM trace_down),
picked AS (SELECT *, row_number() OVER (PARTITION BY name, direction ORDER BY depth, last_seen DESC, entity_type) AS rn FROM both_ways)
SELECT name, direction, entity_type, {relative_sql('last_seen', chr(39).join(['TIMESTAMP ', '2001-11-05 00:00:00', '']))} AS last_activity, depth FROM picked WHERE rn = 1""")
add("trace_seeds", lambda s, d: ln.trace_seeds(load(s, d, "copies"), _graph_conditions(s, d)), f"""{check_ctes('copies')}
SELECT c.subject_id, c.table_full_name, column_name, 'class.name' AS tag, c.subject_id AS value FROM (SELECT DISTINCT subject_id, table_full_name FROM copies) c
JOIN (VALUES ('silver.crm.bookings', 'lastname_1'), ('silver.crm.bookings', 'firstname_1'), ('bronze.crm.people_raw', 'last_name'),
 ('gold.mkt.contacts', 'person')) v(table_full_name, column_name) ON v.table_full_name = c.table_full_name""")


def _graph_conditions(s: SparkSession, d: str) -> DataFrame:
    rows = [("silver.crm.bookings", ["lastname_1", "firstname_1"]), ("bronze.crm.people_raw", ["last_name"]), ("gold.mkt.contacts", ["person"])]
    looked_at = s.createDataFrame(rows, "table_full_name string, columns array<string>")
    subjects = load(s, d, "copies").select("subject_id", "table_full_name").distinct()
    return subjects.join(looked_at, "table_full_name").select(
        "subject_id", "table_full_name", F.lit("class.name").alias("tag"), "columns", F.col("subject_id").alias("value"))


def _graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    copies = load(s, d, "copies")
    starts = copies.filter("provenance = 'direct'").select("subject_id", "table_full_name").distinct()
    edges = lake.table_edges(s, d)
    up = ln.trace_tables(edges, starts, "up", group="subject_id")
    down = ln.trace_tables(edges, starts, "down", group="subject_id")
    return ln.lineage_graph(copies, _graph_conditions(s, d), up, down)


_GRAPH = f"""{check_ctes('copies')}, te(source, target) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in lake.TABLE_EDGES)}),
starts AS (SELECT DISTINCT subject_id, table_full_name AS node FROM copies WHERE provenance = 'direct'),
ups(subject_id, node) AS (SELECT * FROM starts UNION SELECT subject_id, source FROM ups JOIN te ON target = node),
downs(subject_id, node) AS (SELECT * FROM starts UNION SELECT subject_id, target FROM downs JOIN te ON source = node),
hops AS (SELECT subject_id, source, target FROM ups JOIN te ON target = node UNION SELECT subject_id, source, target FROM downs JOIN te ON source = node),
ranked AS (SELECT subject_id, table_full_name, provenance AS status, n_rows, CASE provenance WHEN 'direct' THEN 0 WHEN 'upstream' THEN 1 ELSE 2 END AS r FROM copies
 UNION ALL SELECT DISTINCT subject_id, node, 'traversed', CAST(NULL AS BIGINT), 3 FROM (SELECT h.subject_id, source AS node FROM hops h JOIN ups u ON u.subject_id = h.subject_id AND u.node = h.target UNION SELECT h.subject_id, target FROM hops h JOIN downs w ON w.subject_id = h.subject_id AND w.node = h.source))"""
add("lineage_nodes", lambda s, d: _graph(s, d)[0], f"""{_GRAPH},
best AS (SELECT *, row_number() OVER (PARTITION BY subject_id, table_full_name ORDER BY r, n_rows) AS rn FROM ranked)
SELECT subject_id, table_full_name, split_part(table_full_name, '.', 1) AS catalog, status, n_rows,
 CASE WHEN status = 'traversed' THEN 'traversed · no PII match' ELSE concat(n_rows, ' row(s)') END AS caption FROM best WHERE rn = 1""")
add("lineage_edges", lambda s, d: _graph(s, d)[1], f"""{_GRAPH},
labels(table_full_name, label) AS (VALUES ('silver.crm.bookings', 'firstname_1, lastname_1'), ('bronze.crm.people_raw', 'last_name'), ('gold.mkt.contacts', 'person')),
found AS (SELECT c.subject_id, CASE WHEN c.provenance = 'upstream' THEN c.table_full_name ELSE m.node END AS source,
  CASE WHEN c.provenance = 'upstream' THEN m.node ELSE c.table_full_name END AS target, c.provenance AS status, label
 FROM copies c JOIN starts m ON m.subject_id = c.subject_id LEFT JOIN labels l ON l.table_full_name = c.table_full_name WHERE c.provenance <> 'direct'),
every AS (SELECT *, CASE status WHEN 'upstream' THEN 1 ELSE 2 END AS r FROM found UNION ALL SELECT subject_id, source, target, 'traversed', NULL, 3 FROM hops),
best AS (SELECT *, row_number() OVER (PARTITION BY subject_id, source, target ORDER BY r, label) AS rn FROM every)
SELECT subject_id, source, target, status, label FROM best WHERE rn = 1""")
