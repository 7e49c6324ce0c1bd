"""Governed tables, metadata and logs derived from the driver's parquet tables.

One SQL text per input serves both Spark and the checking engine; ``{name}`` stands for another
input and ``{ts}`` for the engine's timestamp type. Every input keeps all rows of the tables it
comes from, so the work of a query grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_PLATFORM = """
 CAST(DATE '1998-01-01' + CAST(cust_id * 13 % 1500 AS INT) AS {ts}) AS _inserted_at,
 CAST(DATE '1998-01-01' + CAST(cust_id * 13 % 1500 + cust_id * 7 % 300 AS INT) AS {ts}) AS _updated_at,
 CASE WHEN cust_id % 20 = 19 THEN NULL
   ELSE CAST(DATE '1998-01-01' + CAST(cust_id * 13 % 1500 + 2557 AS INT) AS {ts}) END AS _delete_at"""

_CATALOG_NAME = "CASE {k} % 4 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' WHEN 2 THEN 'gold' ELSE 'admin' END"
_TABLE_NAME = (
    "CASE WHEN {k} % 50 = 49 THEN concat('_tmp', CAST({k} AS STRING))"
    " WHEN {k} % 50 = 48 THEN concat('x', CAST({k} AS STRING), '_drift_metrics')"
    " WHEN {k} % 50 = 47 THEN concat('y', CAST({k} AS STRING), '_profile_metrics')"
    " WHEN {k} % 50 = 46 THEN concat('event_log_', CAST({k} AS STRING))"
    " ELSE concat('t', CAST({k} AS STRING)) END"
)


def _full_name(k: str) -> str:
    return (
        f"concat({_CATALOG_NAME}, '.s', CAST({{k}} % 7 AS STRING), '.', {_TABLE_NAME})".replace("{k}", k)
    )


_NAME_PARTS = (
    f"{_CATALOG_NAME} AS table_catalog, concat('s', CAST({{k}} % 7 AS STRING)) AS table_schema,"
    f" {_TABLE_NAME} AS table_name"
).replace("{k}", "p_partkey")


def _column_branch(name: str, dtype: str, keep: str, position: int) -> str:
    return (
        f"SELECT p_partkey, {_NAME_PARTS}, '{name}' AS column_name, '{dtype}' AS data_type,"
        f" {position} AS ordinal_position,"
        f" CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('{name} of ', p_brand) END AS comment"
        f" FROM {{part}} WHERE {keep}"
    )


_FROM_RAW = ("first_name", "last_name", "email", "phone", "address", "dob", "age_int", "ip", "card")
#: Which columns and tables of the example lake feed which others; its lineage logs hold an event per customer's order.
LAKE_COLUMN_EDGES = (
    *[("bronze.crm.people_raw", c, "silver.crm.customers", c) for c in _FROM_RAW],
    ("silver.crm.customers", "email", "gold.mkt.contacts", "contact"),
    ("silver.crm.customers", "first_name", "gold.mkt.contacts", "person"),
    ("silver.crm.customers", "last_name", "gold.mkt.contacts", "person"),
    ("silver.crm.customers", "first_name", "silver.crm.bookings", "firstname_1"),
    ("silver.crm.customers", "last_name", "silver.crm.bookings", "lastname_1"),
    ("silver.crm.bookings", "price", "dashboard", "total"),
)
LAKE_TABLE_EDGES = (
    ("bronze.crm.people_raw", "silver.crm.customers"),
    ("silver.crm.customers", "gold.mkt.contacts"),
    ("silver.crm.customers", "silver.crm.bookings"),
    ("silver.crm.bookings", "gold.fin.revenue"),
    ("bronze.web.orders_raw", "silver.crm.bookings"),
)


def _edge_log(edges: tuple, fields: tuple[str, ...], extra: str = "") -> str:
    """Each order is an event of the edge that its customer's number picks."""
    rows = " UNION ALL ".join(f"SELECT {k} AS k, " + ", ".join(f"'{v}' AS {f}" for v, f in zip(edge, fields)) for k, edge in enumerate(edges))
    return f"""
SELECT {', '.join(fields)}{extra}, o_orderdate AS event_time, CAST(o_orderdate AS DATE) AS event_date
FROM {{orders}} JOIN ({rows}) e ON e.k = o_custkey % {len(edges)}"""


DERIVED: dict[str, str] = {
    "people": """
SELECT c_custkey AS cust_id,
 CASE c_custkey % 8 WHEN 0 THEN 'Anthony' WHEN 1 THEN 'Tony' WHEN 2 THEN 'William' WHEN 3 THEN 'Bill'
   WHEN 4 THEN 'Margaret' WHEN 5 THEN 'Peggy' WHEN 6 THEN 'José' ELSE 'Ann' END AS first_name,
 concat(CASE c_custkey % 5 WHEN 0 THEN 'Hill' WHEN 1 THEN 'O''Brien' WHEN 2 THEN 'Smith-Jones'
   WHEN 3 THEN 'Müller' ELSE 'García' END,
   translate(CAST(c_custkey AS STRING), '0123456789', 'abeiklmnor')) AS last_name,
 CASE WHEN c_custkey % 50 = 49 THEN 'not-an-email'
   ELSE concat('user', CAST(c_custkey AS STRING), '@mail', CAST(c_custkey % 9 AS STRING), '.example.co.uk') END AS email,
 CASE c_custkey % 4 WHEN 0 THEN concat('+44 7', lpad(CAST(c_custkey AS STRING), 9, '0'))
   WHEN 1 THEN concat('0044 7', lpad(CAST(c_custkey AS STRING), 9, '0'))
   WHEN 2 THEN concat('07', lpad(CAST(c_custkey AS STRING), 9, '0')) ELSE NULL END AS phone,
 CASE WHEN c_custkey % 6 = 5 THEN 'London' ELSE concat(CAST(c_custkey % 20000 + 1 AS STRING), ' High Street, London, ',
   substr('ABEGKLMNSTW', CAST(c_custkey % 11 + 1 AS INT), 1), CAST(c_custkey % 9 + 1 AS STRING),
   CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' ' END, CAST(c_custkey % 10 AS STRING),
   substr('ABDEFGHJLNPQRSTUWXYZ', CAST(c_custkey * 7 % 20 + 1 AS INT), 1),
   substr('ABDEFGHJLNPQRSTUWXYZ', CAST(CAST(floor(c_custkey / 20.0) AS BIGINT) % 20 + 1 AS INT), 1)) END AS address,
 DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INT) AS dob,
 CASE WHEN c_custkey % 20 = 19 THEN 'unknown' ELSE CAST(18 + c_custkey % 70 AS STRING) END AS age_str,
 CAST(18 + c_custkey % 70 AS INT) AS age_int,
 CASE WHEN c_custkey % 10 = 9 THEN '2001:db8::1'
   ELSE concat('10.', CAST(c_custkey % 256 AS STRING), '.', CAST(c_custkey % 100 AS STRING), '.7') END AS ip,
 concat('4111-1111-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), '-',
   lpad(CAST(c_custkey * 7 % 10000 AS STRING), 4, '0')) AS card
FROM {customer}""",
    "subjects": """
SELECT concat('s', CAST(cust_id AS STRING)) AS subject_id, 'class.name' AS tag,
 CASE WHEN cust_id % 9 = 8 THEN '' ELSE concat(CASE cust_id % 9 WHEN 0 THEN 'Mr. ' WHEN 6 THEN 'Dr. ' ELSE '' END,
   CASE first_name WHEN 'Anthony' THEN 'Tony' WHEN 'Tony' THEN 'Anthony' WHEN 'William' THEN 'Bill'
     WHEN 'Margaret' THEN 'Peggy' ELSE first_name END, ' ', last_name) END AS value
FROM {people} WHERE cust_id % 9 IN (0, 5, 6) OR cust_id % 27 = 8
UNION ALL SELECT concat('s', CAST(cust_id AS STRING)), 'class.email_address',
 concat('USER', CAST(cust_id AS STRING), '@MAIL', CAST(cust_id % 9 AS STRING), '.Example.CO.UK')
FROM {people} WHERE cust_id % 9 IN (1, 5, 7)
UNION ALL SELECT concat('s', CAST(cust_id AS STRING)), 'class.phone_number',
 concat('0044 (0)7 ', lpad(CAST(cust_id AS STRING), 9, '0'))
FROM {people} WHERE cust_id % 9 IN (2, 7)
UNION ALL SELECT concat('s', CAST(cust_id AS STRING)), 'class.date_of_birth', CAST(dob AS STRING)
FROM {people} WHERE cust_id % 9 IN (3, 6)
UNION ALL SELECT concat('s', CAST(cust_id AS STRING)), 'class.location',
 CASE WHEN cust_id % 27 = 17 THEN concat(CAST(cust_id % 20000 + 1 AS STRING), ' high street') WHEN cust_id % 27 = 26 THEN '%'
   WHEN address = 'London' THEN concat('flat ', CAST(cust_id AS STRING)) ELSE lower(address) END
FROM {people} WHERE cust_id % 9 = 4 OR cust_id % 27 IN (17, 26)""",
    "people_raw": f"SELECT *, {_PLATFORM} FROM {{people}}",
    "customers": f"""
SELECT cust_id, first_name, last_name, email, phone, address, dob, age_int, ip, card, {_PLATFORM} FROM {{people}}""",
    "bookings_once": """
SELECT o_orderkey AS booking_id, o_custkey AS lead_id, a.first_name AS firstname_1, a.last_name AS lastname_1,
 b.first_name AS firstname_2, b.last_name AS lastname_2, o_totalprice AS price,
 o_orderdate AS _inserted_at, o_orderdate AS _updated_at,
 CASE WHEN o_orderkey % 20 = 19 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + 2557 AS {ts}) END AS _delete_at
FROM {orders} JOIN {people} a ON o_custkey = a.cust_id LEFT JOIN {people} b ON b.cust_id = a.cust_id + 1""",
    "bookings": """
SELECT * FROM {bookings_once} UNION ALL SELECT * FROM {bookings_once} WHERE booking_id % 100 = 0""",
    "contacts": f"""
SELECT cust_id, email AS contact, concat(first_name, ' ', last_name) AS person, {_PLATFORM} FROM {{people}}""",
    "audit_log": """
SELECT event_id, ts AS event_time, CAST(ts AS DATE) AS event_date,
 CASE WHEN event_type IN ('view','click') THEN 'unityCatalog' ELSE 'accounts' END AS service_name,
 CASE event_type WHEN 'view' THEN 'generateTemporaryTableCredential' WHEN 'click' THEN 'generateTemporaryTableCredential'
   WHEN 'error' THEN 'tokenLogin' WHEN 'signup' THEN 'updatePermissions' ELSE 'other' END AS action_name,
 concat(CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END,
   '.s', CAST(user_id % 4 AS STRING), '.t', CAST(event_id % 7 AS STRING)) AS full_name_arg,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'TABLE' END AS securable_type,
 concat('user', CAST(user_id AS STRING), '@example.com') AS email,
 concat('10.0.', CAST(user_id % 200 AS STRING), '.', CAST(event_id % 250 AS STRING)) AS source_ip_address,
 CASE WHEN event_id % 10 = 0 THEN NULL WHEN value > 100 THEN '401' ELSE '200' END AS status_code,
 CASE WHEN value > 100 THEN concat('denied ', CAST(event_id AS STRING)) ELSE NULL END AS error_message
FROM {events}""",
    "table_lineage_log": """
SELECT split_part(source_table_full_name, '.', 1) AS source_table_catalog,
 split_part(target_table_full_name, '.', 1) AS target_table_catalog, e.* FROM (
 SELECT CASE WHEN l_linenumber % 3 = 0 THEN concat('bronze.s', CAST(l_suppkey % 3 AS STRING), '.t', CAST(l_partkey % 6 AS STRING))
   ELSE concat('silver.s', CAST(l_suppkey % 3 AS STRING), '.t', CAST(l_partkey % 6 AS STRING)) END AS source_table_full_name,
 CASE WHEN l_linenumber = 7 AND l_partkey % 5 = 0 THEN NULL
   WHEN l_partkey % 13 = 0 THEN 'silver.s0.t0_drift_metrics'
   WHEN l_linenumber % 3 = 0 THEN concat('silver.s', CAST(l_suppkey % 3 AS STRING), '.t', CAST(l_partkey % 6 AS STRING))
   WHEN l_linenumber % 3 = 1 THEN concat('gold.s', CAST(l_suppkey % 3 AS STRING), '.t', CAST(l_partkey % 4 AS STRING))
   ELSE concat('silver.s', CAST(l_suppkey % 3 AS STRING), '.t', CAST((l_partkey + 1) % 6 AS STRING)) END AS target_table_full_name,
 CASE WHEN l_orderkey % 4 = 0 THEN NULL WHEN l_orderkey % 4 = 1 THEN 'JOB' ELSE 'NOTEBOOK' END AS entity_type,
 l_shipdate AS event_time, CAST(l_shipdate AS DATE) AS event_date, l_orderkey, l_linenumber
FROM {lineitem}) e""",
    "column_lineage_log": """
SELECT source_table_full_name,
 CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE concat('c', CAST(l_orderkey % 3 AS STRING)) END AS source_column_name,
 CASE WHEN l_orderkey % 17 = 0 THEN 'dashboard' ELSE target_table_full_name END AS target_table_full_name,
 concat('c', CAST(l_orderkey % 3 AS STRING)) AS target_column_name, event_time, event_date
FROM {table_lineage_log}""",
    "lake_column_log": _edge_log(
        LAKE_COLUMN_EDGES, ("source_table_full_name", "source_column_name", "target_table_full_name", "target_column_name")),
    "lake_table_log": _edge_log(
        LAKE_TABLE_EDGES, ("source_table_full_name", "target_table_full_name"),
        ", split_part(source_table_full_name, '.', 1) AS source_table_catalog, split_part(target_table_full_name, '.', 1) AS target_table_catalog, 'JOB' AS entity_type"),
    "deep_edges": """
SELECT CAST(event_id % 300 AS INT) AS level,
 concat('silver.l', CAST(event_id % 300 AS STRING), '.t', CAST(CAST(floor(event_id / 300.0) AS BIGINT) AS STRING)) AS source_table_full_name,
 concat('silver.l', CAST(event_id % 300 + 1 AS STRING), '.t', CAST(CAST(floor(event_id / 300.0) AS BIGINT) AS STRING)) AS target_table_full_name,
 'silver' AS source_table_catalog, 'silver' AS target_table_catalog, event_type AS entity_type, ts AS last_seen
FROM {events}""",
    "cat_tables": f"""
SELECT p_partkey, {_NAME_PARTS},
 CASE p_partkey % 11 WHEN 0 THEN 'VIEW' WHEN 1 THEN 'EXTERNAL' WHEN 2 THEN 'STREAMING_TABLE'
   WHEN 3 THEN 'MATERIALIZED_VIEW' ELSE 'MANAGED' END AS table_type,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('about ', p_name) END AS comment FROM {{part}}""",
    "cat_columns": "\nUNION ALL ".join([
        _column_branch("_inserted_at", "timestamp", "p_partkey % 5 <> 0", 1),
        _column_branch("_updated_at", "timestamp", "p_partkey % 6 <> 0", 2),
        _column_branch("_delete_at", "timestamp", "p_partkey % 7 <> 2", 3),
        _column_branch("id", "bigint", "p_size >= 0", 4),
        _column_branch("email", "string", "p_size > 5", 5),
        _column_branch("full_name", "string", "p_size > 20", 6),
        _column_branch("passport_no", "string", "p_size > 40", 7),
    ]),
    "cat_props": f"""
SELECT {_full_name('p_partkey')} AS full_table_name, 'platform.freshness_sla' AS key,
 CASE p_partkey % 7 WHEN 0 THEN '30m' WHEN 1 THEN '4h' WHEN 2 THEN '7d' WHEN 3 THEN '1y' WHEN 4 THEN 'bad'
   WHEN 5 THEN ' 12H ' ELSE '7 d' END AS value FROM {{part}} WHERE p_size > 8
UNION ALL SELECT {_full_name('p_partkey')}, 'delta.deletedFileRetentionDuration',
 CASE p_partkey % 3 WHEN 0 THEN 'interval 7 days' WHEN 1 THEN '30 DAYS' ELSE 'interval 168 hours' END
FROM {{part}} WHERE p_size > 12""",
    "cat_updates": f"""
SELECT {_full_name('l_partkey')} AS full_table_name,
 CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_shipdate END AS _updated_at FROM {{lineitem}}""",
    "cat_failures": f"""
SELECT {_full_name('p_partkey')} AS full_table_name, concat('cannot read ', p_name) AS error
FROM {{part}} WHERE p_size = 1""",
    "cat_tags": """
SELECT table_catalog, table_schema, table_name, column_name,
 CASE column_name WHEN 'email' THEN 'class.email_address' WHEN 'full_name' THEN 'class.name'
   WHEN 'passport_no' THEN 'class.passport' ELSE 'owner.team' END AS tag_name
FROM {cat_columns} WHERE column_name IN ('email', 'full_name', 'passport_no', 'id')
UNION ALL SELECT table_catalog, table_schema, table_name, column_name, 'class.us_ssn'
FROM {cat_columns} WHERE column_name = 'passport_no' AND comment IS NULL
UNION ALL SELECT table_catalog, table_schema, table_name, column_name, 'class.email_address'
FROM {cat_columns} WHERE column_name = 'full_name' AND comment IS NULL""",
    "cat_keys": """
SELECT table_catalog, table_schema, table_name, concat('pk_', table_name) AS constraint_name, column_name,
 10 - ordinal_position AS ordinal_position
FROM {cat_columns} WHERE column_name IN ('id', 'email')""",
    "cat_constraints": """
SELECT DISTINCT table_catalog, table_schema, table_name, concat('pk_', table_name) AS constraint_name,
 CASE WHEN comment IS NULL THEN 'FOREIGN KEY' ELSE 'PRIMARY KEY' END AS constraint_type
FROM {cat_columns} WHERE column_name = 'id'""",
    "cat_name_columns": f"""
SELECT {_NAME_PARTS}, column_name, 'class.name' AS tag_name FROM {{part}} JOIN (
 SELECT 0 AS kind, 'firstname_1' AS column_name UNION ALL SELECT 0, 'lastname_1' UNION ALL SELECT 0, 'firstname_2'
 UNION ALL SELECT 0, 'lastname_2' UNION ALL SELECT 1, 'first_name' UNION ALL SELECT 1, 'last_name'
 UNION ALL SELECT 2, 'buyer_first' UNION ALL SELECT 2, 'buyer_last' UNION ALL SELECT 2, 'payee_first'
 UNION ALL SELECT 2, 'payee_last' UNION ALL SELECT 3, 'full_name' UNION ALL SELECT 4, 'buyer1_first' UNION ALL SELECT 4, 'buyer1_last'
 UNION ALL SELECT 4, 'seller1_first' UNION ALL SELECT 4, 'seller1_last' UNION ALL SELECT 5, 'first_name' UNION ALL SELECT 5, 'last_name'
 UNION ALL SELECT 5, 'line2_name') c ON c.kind = p_partkey % 6""",
    "trace_starts": """
SELECT concat('s', CAST(cust_id AS STRING)) AS subject_id,
 concat(CASE WHEN cust_id % 5 = 0 THEN 'gold' ELSE 'silver' END, '.s', CAST(cust_id % 3 AS STRING), '.t', CAST(cust_id % 4 AS STRING)) AS table_full_name,
 concat('c', CAST(cust_id % 3 AS STRING)) AS column_name,
 CASE WHEN cust_id % 2 = 0 THEN 'class.email_address' ELSE 'class.name' END AS tag, email AS value FROM {people}
UNION ALL SELECT concat('s', CAST(cust_id AS STRING)), concat('silver.s', CAST(cust_id % 3 AS STRING), '.t5'),
 'c1', 'class.phone_number', phone FROM {people} WHERE phone IS NOT NULL""",
    "match_log": """
SELECT concat('s', CAST(l_orderkey AS STRING)) AS subject_id,
 concat(CASE l_linenumber % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END, '.s', CAST(l_suppkey % 3 AS STRING), '.t', CAST(l_partkey % 6 AS STRING)) AS table_full_name,
 concat('k', CAST(l_partkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS row_id, CAST(l_quantity AS BIGINT) AS n_rows,
 CASE WHEN l_linenumber = 1 THEN NULL ELSE 50 + l_quantity END AS score FROM {lineitem}""",
    "copies": """
SELECT concat('s', CAST(cust_id AS STRING)) AS subject_id, 'silver.crm.customers' AS table_full_name, 'direct' AS provenance, CAST(1 AS BIGINT) AS n_rows FROM {people}
UNION ALL SELECT concat('s', CAST(lead_id AS STRING)), 'silver.crm.bookings', 'direct', count(*) FROM {bookings} GROUP BY lead_id
UNION ALL SELECT concat('s', CAST(cust_id AS STRING)), 'bronze.crm.people_raw', 'upstream', CAST(1 AS BIGINT) FROM {people}
UNION ALL SELECT concat('s', CAST(cust_id AS STRING)), 'silver.crm.bookings', 'downstream', CAST(1 AS BIGINT) FROM {people} WHERE phone IS NULL
UNION ALL SELECT concat('s', CAST(cust_id AS STRING)), 'gold.mkt.contacts', 'downstream', CAST(1 AS BIGINT) FROM {people}""",
    "scope_requests": f"""
SELECT DISTINCT concat('r', CAST(l_orderkey AS STRING)) AS request_id, {_full_name('l_partkey')} AS table_full_name FROM {{lineitem}}""",
    "scope_searched": """
SELECT DISTINCT concat('r', CAST(l_orderkey AS STRING)) AS request_id,
 CASE l_linenumber % 3 WHEN 0 THEN 'class.email_address' WHEN 1 THEN 'class.name' ELSE 'class.passport' END AS tag_name FROM {lineitem}""",
    "system_choices": """
SELECT concat('r', CAST(o_orderkey AS STRING)) AS request_id, 'fare-check' AS system_id FROM {orders} WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT concat('r', CAST(o_orderkey AS STRING)), 'loyalty-tier' FROM {orders} WHERE o_orderstatus = 'F'""",
    "erasure_requests": """
SELECT concat('r', CAST(o_orderkey AS STRING)) AS request_id, concat('h', CAST(o_custkey AS STRING)) AS subject_ref_hash,
 concat('steward', CAST(o_custkey % 9 AS STRING)) AS requested_by, 'Art. 17' AS legal_basis,
 o_orderdate AS requested_at, CASE o_orderkey % 5 WHEN 0 THEN 'PENDING' ELSE 'COMPLETED' END AS status,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL
   ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) AS {ts}) END AS completed_at
FROM {orders}""",
    "erasure_items": """
SELECT concat('r', CAST(l_orderkey AS STRING)) AS request_id,
 concat('silver.s', CAST(l_suppkey % 5 AS STRING), '.t', CAST(l_partkey % 11 AS STRING)) AS table_full_name,
 CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN 'ABORTED' ELSE 'SUCCEEDED' END AS execution_status,
 l_shipdate AS executed_at, CAST(CAST(l_shipdate AS DATE) + CAST(l_partkey % 40 AS INT) AS {ts}) AS estimated_purge_by,
 l_orderkey * 10 + l_linenumber AS item_no
FROM {lineitem}""",
    "restorations": """
SELECT request_id, table_full_name, CASE WHEN item_no % 3 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS execution_status,
 executed_at AS restored_at, item_no AS restoration_no
FROM {erasure_items} WHERE execution_status = 'SUCCEEDED' AND table_full_name LIKE '%t3'""",
    "table_history": """
SELECT concat('silver.h.t', CAST(user_id % 40 AS STRING)) AS table_full_name, event_id AS version, ts AS commit_time,
 CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'view' THEN 'WRITE' ELSE 'MERGE' END AS operation
FROM {events}""",
    "deleted_items": """
SELECT concat('r', CAST(event_id AS STRING)) AS request_id, concat('silver.h.t', CAST(event_id % 41 AS STRING)) AS table_full_name,
 ts AS executed_at FROM {events} WHERE event_type = 'signup'""",
    "timing_log": """
SELECT CASE event_type WHEN 'view' THEN 'Direct search' WHEN 'click' THEN 'Upstream table search'
   WHEN 'error' THEN 'Downstream table search' ELSE 'Tag catalogue scan' END AS phase,
 CASE WHEN event_type IN ('view', 'click', 'error') THEN concat('silver.s', CAST(user_id % 4 AS STRING), '.t', CAST(event_id % 37 AS STRING))
   ELSE NULL END AS table_name, value AS seconds, event_id FROM {events}""",
    "selected_customers": """
SELECT concat('r', CAST(c_custkey AS STRING)) AS request_id, 'direct' AS provenance, 'class.email_address' AS matched_on, t.*
FROM {customers} t JOIN {customer} ON c_custkey = cust_id WHERE c_acctbal < 0""",
    "selected_bookings": """
SELECT concat('r', CAST(c_custkey AS STRING)) AS request_id, 'upstream' AS provenance, 'class.name' AS matched_on, t.*
FROM {bookings} t JOIN {customer} ON c_custkey = lead_id WHERE c_acctbal < 0 AND c_mktsegment <> 'MACHINERY'
UNION ALL SELECT concat('r', CAST(c_custkey AS STRING)), 'upstream', 'class.name', t.*
FROM {bookings_once} t JOIN {customer} ON c_custkey = lead_id WHERE c_acctbal < 0 AND c_mktsegment = 'MACHINERY'""",
    "selected_shared": """
SELECT concat('r', CAST(c_custkey AS STRING)) AS request_id, 'upstream' AS provenance, 'class.name' AS matched_on, t.*
FROM {bookings} t JOIN {customer} ON c_custkey = lead_id WHERE c_acctbal < 0
UNION ALL SELECT concat('q', CAST(c_custkey AS STRING)), 'direct', 'class.name', t.*
FROM {bookings} t JOIN {customer} ON c_custkey = lead_id WHERE c_acctbal < 500 AND booking_id % 3 > 0""",
    "release_requests": """
SELECT o_orderkey AS request_no, CASE WHEN o_orderkey % 5 = 0 THEN '  ' WHEN o_orderkey % 5 = 1 THEN NULL ELSE 'Running bookings' END AS purpose,
 CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS recipients, o_orderkey % 3 = 0 AS unsure,
 CAST(o_orderkey % 4 AS INT) AS n_systems, o_orderkey % 2 = 0 AS none_confirmed FROM {orders}""",
}

#: Sample nickname pairs; any larger table with the same two columns works.
NICKNAMES = (
    ("tony", "anthony"), ("ant", "anthony"), ("bill", "william"), ("will", "william"),
    ("peggy", "margaret"), ("maggie", "margaret"),
)

_REF = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or an input derived from the driver tables."""
    if name in DRIVER_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = DERIVED[name].replace("{ts}", "TIMESTAMP_NTZ")
    needed = {ref: load(spark, sf_dir, ref) for ref in set(_REF.findall(text))}
    return spark.sql(text, **needed)


def nested_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log in its nested form: parameters as a map, identity and response as structs."""
    flat = load(spark, sf_dir, "audit_log")
    params = F.create_map(
        F.lit("full_name_arg"), F.col("full_name_arg"), F.lit("securable_type"), F.col("securable_type")
    )
    return flat.select(
        "event_id", "event_time", "event_date", "service_name", "action_name",
        params.alias("request_params"),
        F.struct("email").alias("user_identity"),
        "source_ip_address",
        F.struct("status_code", "error_message").alias("response"),
    )


def nicknames(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NICKNAMES), "nickname string, canonical string")


def check_ctes(*names: str) -> str:
    """``WITH RECURSIVE …`` for the checking engine, holding the named inputs and all they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in DRIVER_TABLES or name in done:
            return
        text = DERIVED[name].replace("{ts}", "TIMESTAMP")
        for ref in _REF.findall(text):
            add(ref)
        done[name] = _REF.sub(lambda m: m.group(1), text)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({t})" for n, t in done.items())
