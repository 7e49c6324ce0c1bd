"""Catalog metadata as DataFrames, for sessions without an information schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

TABLES_SCHEMA = "table_catalog string, table_schema string, table_name string, table_type string, comment string"
COLUMNS_SCHEMA = (
    "table_catalog string, table_schema string, table_name string, column_name string, data_type string, "
    "ordinal_position int, comment string"
)
PROPS_SCHEMA = "full_table_name string, key string, value string"


def columns_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Column metadata of registered DataFrames; reads schemas, never data."""
    rows = [
        (*name.split("."), f.name, f.dataType.simpleString(), i, f.metadata.get("comment"))
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


def tables_of(
    spark: SparkSession, tables: Mapping[str, DataFrame], types: Mapping[str, str] | None = None,
    comments: Mapping[str, str] | None = None,
) -> DataFrame:
    rows = [(*name.split("."), (types or {}).get(name, "MANAGED"), (comments or {}).get(name)) for name in tables]
    return spark.createDataFrame(rows, TABLES_SCHEMA)


def session_tables(spark: SparkSession, catalog: str, schema: str) -> dict[str, DataFrame]:
    """Tables of one schema of the session catalog, under three-part names."""
    return {
        f"{catalog}.{schema}.{t.name}": spark.table(f"`{schema}`.`{t.name}`")
        for t in spark.catalog.listTables(schema)
        if not t.isTemporary
    }


def session_properties(spark: SparkSession, catalog: str, schema: str) -> DataFrame:
    """Table properties of one schema of the session catalog."""
    rows = [
        (f"{catalog}.{schema}.{t.name}", p["key"], p["value"])
        for t in spark.catalog.listTables(schema)
        if t.tableType != "VIEW" and not t.isTemporary
        for p in spark.sql(f"SHOW TBLPROPERTIES `{schema}`.`{t.name}`").collect()
    ]
    return spark.createDataFrame(rows, PROPS_SCHEMA)
