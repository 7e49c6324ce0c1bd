"""A small three-layer lake over the derived tables, with its tags, keys and column lineage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from stewardry.operators.lineage import compact_column_edges, compact_table_edges
from stewardry.sources.derived import LAKE_TABLE_EDGES as TABLE_EDGES, load  # noqa: F401

#: The lake's logs, read whole.
LOG_END, LOG_DAYS = dt.date(2010, 1, 1), 10_000

TABLES = {
    "bronze.crm.people_raw": "people_raw",
    "silver.crm.customers": "customers",
    "silver.crm.bookings": "bookings",
    "gold.mkt.contacts": "contacts",
}
PRIMARY_KEYS = {
    "bronze.crm.people_raw": ["cust_id"],
    "silver.crm.customers": ["cust_id"],
    "gold.mkt.contacts": ["cust_id"],
}
TAGS = (
    ("silver.crm.customers", "first_name", "class.name"),
    ("silver.crm.customers", "last_name", "class.name"),
    ("silver.crm.customers", "email", "class.email_address"),
    ("silver.crm.customers", "phone", "class.phone_number"),
    ("silver.crm.customers", "address", "class.location"),
    ("silver.crm.customers", "dob", "class.date_of_birth"),
    ("silver.crm.customers", "age_int", "class.age"),
    ("silver.crm.customers", "ip", "class.ip_address"),
    ("silver.crm.customers", "card", "class.credit_card"),
    ("silver.crm.bookings", "firstname_1", "class.name"),
    ("silver.crm.bookings", "lastname_1", "class.name"),
    ("silver.crm.bookings", "firstname_2", "class.name"),
    ("silver.crm.bookings", "lastname_2", "class.name"),
)
def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: load(spark, sf_dir, source) for name, source in TABLES.items()}


def column_tags(spark: SparkSession) -> DataFrame:
    rows = [(*name.split("."), column, tag) for name, column, tag in TAGS]
    return spark.createDataFrame(
        rows, "table_catalog string, table_schema string, table_name string, column_name string, tag_name string"
    )


def column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lake's column lineage log says, compacted as the cache holds it."""
    return compact_column_edges(load(spark, sf_dir, "lake_column_log"), LOG_END, LOG_DAYS)


def table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_table_edges(load(spark, sf_dir, "lake_table_log"), LOG_END, LOG_DAYS)
