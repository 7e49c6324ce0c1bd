"""Freshness, structural compliance and row expiry over catalog metadata and platform columns."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stewardry.functions.durations import (
    at,
    SLA_DEFAULT_MINUTES,
    SLA_DEFAULT_TEXT,
    sla_minutes,
    whole_minutes_between,
)
from stewardry.session import materialise, release

# --- fixed values --------------------------------------------------------------------------
DATA_CATALOGS = ("bronze", "silver", "gold")
PLATFORM_COLUMNS = ("_inserted_at", "_updated_at", "_delete_at")
SLA_PROPERTY = "platform.freshness_sla"
BAD_SLA = ("STALE", "NEVER_UPDATED", "ERROR", "NO_COLUMN")
COMPLIANT, NON_COMPLIANT = "COMPLIANT", "NON-COMPLIANT"
STALE_RANK = {"NEVER_UPDATED": 0, "NO_COLUMN": 1, "ERROR": 2}
MANAGED_NAME_EXCLUSIONS = (r"^_", r"_drift_metrics$", r"_profile_metrics$", r"^event.log.")
TTL_TYPES_EXCLUDED = ("VIEW", "STREAMING_TABLE", "MATERIALIZED_VIEW")
# -------------------------------------------------------------------------------------------

_KEY = ["table_catalog", "table_schema", "table_name"]


def full_table_name() -> Column:
    return F.concat_ws(".", *_KEY)


def _governed() -> Column:
    return F.col("table_catalog").isin(*DATA_CATALOGS) & (F.col("table_schema") != "information_schema")


def tables_with_column(columns: DataFrame, column_name: str) -> DataFrame:
    """Governed tables that carry ``column_name``."""
    return columns.filter(_governed() & (F.col("column_name") == column_name)).select(
        full_table_name().alias("full_table_name")
    )


def table_property(props: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """One property of every table that sets it; ``default`` replaces a NULL value."""
    value = F.coalesce(F.col("value"), F.lit(default)) if default is not None else F.col("value")
    return props.filter(F.col("key") == key).select("full_table_name", value.alias("value"))


def update_times(tables: dict[str, DataFrame]) -> DataFrame:
    """``_updated_at`` of many tables in one long frame; each scan reads that column alone."""
    parts = [df.select(F.lit(name).alias("full_table_name"), "_updated_at") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def freshness_metrics(
    expected: DataFrame, updates: DataFrame, props: DataFrame, failures: DataFrame | None = None
) -> DataFrame:
    """Last update and freshness target per table, in one job for all tables.

    ``expected`` names the tables (``full_table_name``), ``updates`` their update times, and
    ``failures`` the tables that could not be read with their ``error``; those get no target text
    and the default minutes. A target that cannot be parsed is kept as text.
    """
    newest = updates.groupBy("full_table_name").agg(F.max("_updated_at").alias("max_updated_at"))
    sla = table_property(props, SLA_PROPERTY).withColumnRenamed("value", "sla_raw")
    joined = expected.join(newest, "full_table_name", "left").join(sla, "full_table_name", "left")
    if failures is None:
        joined = joined.withColumn("error", F.lit(None).cast("string"))
    else:
        joined = joined.join(failures.select("full_table_name", "error"), "full_table_name", "left")
    ok = F.col("error").isNull()
    text = F.when(F.length("sla_raw") > 0, F.col("sla_raw")).otherwise(F.lit(SLA_DEFAULT_TEXT))
    return joined.select(
        "full_table_name",
        F.when(ok, F.col("max_updated_at")).alias("max_updated_at"),
        F.when(ok, text).alias("freshness_sla"),
        F.when(ok, sla_minutes("sla_raw")).otherwise(F.lit(SLA_DEFAULT_MINUTES)).alias("freshness_sla_minutes"),
        "error",
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Replace the metrics table, columns included."""
    metrics.write.mode("overwrite").parquet(path)


def structural_compliance(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Per managed table, which of the three platform columns it has."""
    managed = tables.filter(_governed() & (F.col("table_type") == "MANAGED"))
    for pattern in MANAGED_NAME_EXCLUSIONS:
        managed = managed.filter(~F.col("table_name").rlike(pattern))
    platform = columns.filter(F.col("column_name").isin(*PLATFORM_COLUMNS)).select(*_KEY, "column_name")
    flags = [
        F.coalesce(F.bool_or(F.col("column_name") == name), F.lit(False)).alias(f"has{name}")
        for name in PLATFORM_COLUMNS
    ]
    per_table = managed.select(*_KEY).join(platform, _KEY, "left").groupBy(*_KEY).agg(*flags)
    return per_table.withColumn("full_table_name", full_table_name())


def retention_compliance(compliance: DataFrame, metrics: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Status labels per table; the first that applies of NO_COLUMN, ERROR, NEVER_UPDATED, STALE, FRESH."""
    joined = compliance.join(metrics, "full_table_name", "left")
    minutes = F.coalesce("freshness_sla_minutes", F.lit(SLA_DEFAULT_MINUTES))

    def label(flag: str) -> Column:
        return F.when(F.col(flag), F.lit(COMPLIANT)).otherwise(F.lit(NON_COMPLIANT))

    now = at(as_of, dict(metrics.dtypes)["max_updated_at"])
    sla_status = (
        F.when(~F.col("has_updated_at"), F.lit("NO_COLUMN"))
        .when(F.col("error").isNotNull(), F.lit("ERROR"))
        .when(F.col("max_updated_at").isNull(), F.lit("NEVER_UPDATED"))
        .when(whole_minutes_between("max_updated_at", now) > minutes, F.lit("STALE"))
        .otherwise(F.lit("FRESH"))
    )
    return joined.select(
        *_KEY,
        "full_table_name",
        label("has_inserted_at").alias("insertion_status"),
        label("has_updated_at").alias("freshness_status"),
        label("has_delete_at").alias("retention_status"),
        sla_status.alias("sla_status"),
        "has_inserted_at",
        "has_updated_at",
        "has_delete_at",
        F.coalesce("freshness_sla", F.lit(SLA_DEFAULT_TEXT)).alias("freshness_sla"),
        minutes.alias("freshness_sla_minutes"),
        "max_updated_at",
        F.col("error").alias("freshness_error"),
    )


def _structurally_ok() -> Column:
    return F.col("has_inserted_at") & F.col("has_updated_at") & F.col("has_delete_at")


def problems_first(rc: DataFrame) -> DataFrame:
    """Tables with any problem ahead of the healthy ones, each part by name."""
    bad = ~_structurally_ok() | F.col("sla_status").isin(*BAD_SLA)
    return rc.orderBy(F.when(bad, 0).otherwise(1), *_KEY)


def ttl_candidates(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables whose rows expire by ``_delete_at``."""
    carriers = columns.filter(
        _governed() & (F.col("column_name") == "_delete_at") & ~F.col("table_name").startswith("_")
    )
    eligible = tables.filter(~F.col("table_type").isin(*TTL_TYPES_EXCLUDED))
    return carriers.select(*_KEY).join(eligible.select(*_KEY), _KEY).select(
        full_table_name().alias("full_table_name")
    )


def expire_rows(df: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Split into (kept, expired); a row without ``_delete_at`` never expires."""
    now = at(as_of, dict(df.dtypes)["_delete_at"])
    due = F.coalesce(F.col("_delete_at") <= now, F.lit(False))
    return df.filter(~due), df.filter(due)


#: Months are the periods of tables laid out by expiry; rows that never expire lie in the period of this name.
NEVER = "never"


def _period(delete_at: Column) -> Column:
    return F.coalesce(F.date_format(delete_at, "'p'yyyy-MM"), F.lit(NEVER))


def write_by_period(df: DataFrame, path: str) -> None:
    """Lay a table out by the month in which its rows expire, so that expiry is a matter of whole folders."""
    dealt = df.withColumn("_period", _period(F.col("_delete_at")))
    # A month of a busy table may hold far more rows than another: its rows are spread, not gathered in one task.
    dealt.repartitionByRange("_period", "_delete_at").write.partitionBy("_period").parquet(path)


def read_by_period(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_period")


def sweep_periods(spark: SparkSession, path: str, as_of: dt.datetime) -> list[str]:
    """Remove the rows of a table laid out by :func:`write_by_period` that have expired; returns the periods changed.

    Periods that are over go as folders, unread. Of the period that ``as_of`` lies in, and of no other, the rows are read,
    and those still alive are written back by a dynamic partition overwrite. Running it again changes nothing. A table of
    which no row is left has no files.
    """
    table = spark.read.parquet(path)
    now = at(as_of, dict(table.dtypes)["_delete_at"])
    current = as_of.strftime("p%Y-%m")
    periods = {m[1] for m in (re.search("/_period=([^/]+)/", f) for f in table.inputFiles()) if m}  # from the listing, one a month
    over = sorted(p for p in periods if p != NEVER and p < current)
    release(spark, [f"{path}/_period={p}" for p in over])
    changed = list(over)
    month = table.filter(F.col("_period") == current)
    if current in periods and not month.filter(F.col("_delete_at") <= now).isEmpty():
        kept = materialise(month.filter(F.col("_delete_at") > now), "alive")
        if kept.isEmpty():
            release(spark, [f"{path}/_period={current}"])
        else:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_period").parquet(path)
        changed.append(current)
    spark.catalog.refreshByPath(path)
    return changed


def expiry_report(tables: dict[str, DataFrame], as_of: dt.datetime, unreadable: DataFrame | None = None) -> DataFrame:
    """Expired and kept rows per table, all tables in one job, with status ``applied`` or ``failed``."""
    parts = []
    for name, df in tables.items():
        now = at(as_of, dict(df.dtypes)["_delete_at"])
        parts.append(df.select(F.lit(name).alias("full_table_name"), (F.col("_delete_at") <= now).alias("due")))
    counted = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("full_table_name")
        .agg(
            F.count_if("due").alias("rows_expired"),
            F.count_if(~F.coalesce(F.col("due"), F.lit(False))).alias("rows_kept"),
        )
        .withColumn("status", F.lit("applied"))
    )
    if unreadable is None:
        return counted
    failed = unreadable.select(
        "full_table_name", F.lit(0).cast("bigint").alias("rows_expired"),
        F.lit(0).cast("bigint").alias("rows_kept"), F.lit("failed").alias("status"),
    )
    return counted.unionByName(failed)


def expiry_summary(report: DataFrame) -> DataFrame:
    """Tables applied and failed; the run counts as failed if any table failed."""
    return report.agg(
        F.count_if(F.col("status") == "applied").alias("applied"),
        F.count_if(F.col("status") == "failed").alias("errors"),
        (F.count_if(F.col("status") == "failed") > 0).alias("run_failed"),
    )


def stale_tables(rc: DataFrame) -> DataFrame:
    rank = F.when(F.col("sla_status") == "NEVER_UPDATED", STALE_RANK["NEVER_UPDATED"])
    for status in ("NO_COLUMN", "ERROR"):
        rank = rank.when(F.col("sla_status") == status, STALE_RANK[status])
    columns = ["full_table_name", "max_updated_at", "freshness_sla", "freshness_sla_minutes", "sla_status"]
    return (
        rc.filter(F.col("sla_status").isin(*BAD_SLA))
        .select(*columns)
        .orderBy(rank.otherwise(len(STALE_RANK)), F.asc_nulls_first("max_updated_at"))
    )


def non_compliant_tables(rc: DataFrame) -> DataFrame:
    structural = ["insertion_status", "freshness_status", "retention_status"]
    bad = F.col("sla_status").isin(*BAD_SLA)
    for name in structural:
        bad = bad | (F.col(name) == NON_COMPLIANT)
    columns = [*_KEY, *structural, "sla_status", "freshness_sla_minutes", "freshness_sla", "max_updated_at"]
    return rc.filter(bad).select(*columns).orderBy("table_catalog", "table_schema", "table_name")


def _measures() -> list[Column]:
    structural = [F.col(n) for n in ("insertion_status", "freshness_status", "retention_status")]
    all_good = reduce(lambda a, b: a & b, [c == COMPLIANT for c in structural])
    any_bad = reduce(lambda a, b: a | b, [c == NON_COMPLIANT for c in structural])
    return [
        F.count("*").alias("total_tables"),
        F.count_if(all_good).alias("fully_compliant_tables"),
        F.count_if(any_bad).alias("non_compliant_tables"),
        F.count_if(F.col("sla_status").isin(*BAD_SLA)).alias("stale_tables"),
        F.count_if(F.col("sla_status") == "NEVER_UPDATED").alias("never_updated"),
    ]


def _with_shares(df: DataFrame) -> DataFrame:
    def share(part: str) -> Column:
        return F.round(F.try_divide(F.col(part).cast("double") * 100, F.col("total_tables")), 1)

    return df.withColumn("compliance_pct", share("fully_compliant_tables")).withColumn(
        "stale_pct", share("stale_tables")
    )


def compliance_metrics(rc: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Dashboard measures at any grain. ``non_compliant_tables`` here looks at structure only."""
    return _with_shares(rc.groupBy(*dims).agg(*_measures()))


def compliance_metrics_rollup(rc: DataFrame) -> DataFrame:
    """All three dashboard grains (total, catalog, catalog and schema) from one pass."""
    return _with_shares(rc.rollup("table_catalog", "table_schema").agg(*_measures()))
