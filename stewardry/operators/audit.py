"""Access-audit reports over an event log partitioned by ``event_date``.

Every report filters on ``event_date`` first, so only the days asked for are read, and aggregates
before it shuffles. ``as_of`` is the report date.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stewardry.session import exists, materialise

# --- fixed values: services, actions and layers the reports look for -----------------------
PII_SERVICE = "unityCatalog"
PII_ACTION = "generateTemporaryTableCredential"
PII_LAYERS = ("silver", "gold")
LOGIN_ACTIONS = ("login", "tokenLogin", "oidcTokenExchange", "serviceAccountLogin")
PERMISSION_ACTIONS = (
    "updatePermissions", "updateSharePermissions", "grantPermission", "revokePermission",
)
STATUS_OK = "200"
RECENT_DAYS = 7
LONG_DAYS = 30
# -------------------------------------------------------------------------------------------


def _since(as_of: dt.date, days: int) -> Column:
    """The last ``days`` days up to the report date; later events belong to later reports."""
    return F.col("event_date").between(F.lit(as_of - dt.timedelta(days=days)), F.lit(as_of))


def _object_name() -> Column:
    return F.col("request_params")["full_name_arg"]


def _is_pii() -> Column:
    layer = F.substring_index(_object_name(), ".", 1)
    return (
        (F.col("service_name") == PII_SERVICE)
        & (F.col("action_name") == PII_ACTION)
        & layer.isin(*PII_LAYERS)
        & _object_name().contains(".")
    )


def _is_failed_login() -> Column:
    status = F.col("response.status_code").cast("string")
    return status.isNotNull() & (status != STATUS_OK) & F.col("action_name").isin(*LOGIN_ACTIONS)


def _is_permission_change() -> Column:
    return F.col("action_name").isin(*PERMISSION_ACTIONS)


def _newest(df: DataFrame, n: int, tie: str | None) -> DataFrame:
    """The ``n`` newest rows; the limit is the report's own, kept per task before it is merged.

    Events of one moment go by ``tie`` and then by all that the reports show, so the cut is never random.
    """
    shown = [
        F.col("user_identity.email"), F.col("action_name"), _object_name(), F.col("source_ip_address"),
        F.col("response.status_code").cast("string"), F.col("response.error_message"), F.col("request_params")["securable_type"],
    ]
    return df.orderBy(F.col("event_time").desc(), *([F.col(tie)] if tie else []), *shown).limit(n)


def audit_kpis(audit: DataFrame, as_of: dt.date) -> DataFrame:
    """Four counts in one pass over the last 30 days."""
    recent = _since(as_of, RECENT_DAYS)
    return audit.filter(_since(as_of, LONG_DAYS)).agg(
        F.count_if(recent & _is_pii()).alias("pii_access_7d"),
        F.count_distinct(F.when(recent & _is_pii(), F.col("user_identity.email"))).alias("unique_users_7d"),
        F.count_if(recent & _is_failed_login()).alias("failed_auth_7d"),
        F.count_if(_is_permission_change()).alias("permission_changes_30d"),
    )


def _recent_pii(audit: DataFrame, as_of: dt.date) -> DataFrame:
    return audit.filter(_since(as_of, RECENT_DAYS) & _is_pii())


def pii_access(audit: DataFrame, as_of: dt.date, n: int = 1000, tie: str | None = None) -> DataFrame:
    newest = _newest(_recent_pii(audit, as_of), n, tie)
    return newest.select(
        "event_time",
        F.col("user_identity.email").alias("user_email"),
        _object_name().alias("table_name"),
        "source_ip_address",
        F.col("response.status_code").alias("status_code"),
    )


def pii_access_by_user(audit: DataFrame, as_of: dt.date, n: int = 20) -> DataFrame:
    counts = _recent_pii(audit, as_of).groupBy(F.col("user_identity.email").alias("user_email"))
    ranked = counts.agg(F.count("*").alias("access_count"))
    return ranked.orderBy(F.desc("access_count"), "user_email").limit(n)


def pii_access_by_day(audit: DataFrame, as_of: dt.date) -> DataFrame:
    daily = _recent_pii(audit, as_of).groupBy("event_date").agg(F.count("*").alias("access_count"))
    return daily.orderBy("event_date")


def failed_auth(audit: DataFrame, as_of: dt.date, n: int = 500, tie: str | None = None) -> DataFrame:
    hits = audit.filter(_since(as_of, RECENT_DAYS) & _is_failed_login())
    return _newest(hits, n, tie).select(
        "event_time",
        F.col("user_identity.email").alias("user_email"),
        "action_name",
        "source_ip_address",
        F.col("response.status_code").alias("status_code"),
        F.col("response.error_message").alias("error_message"),
    )


def permission_changes(audit: DataFrame, as_of: dt.date, n: int = 500, tie: str | None = None) -> DataFrame:
    hits = audit.filter(_since(as_of, LONG_DAYS) & _is_permission_change())
    return _newest(hits, n, tie).select(
        "event_time",
        F.col("user_identity.email").alias("user_email"),
        "action_name",
        F.col("request_params")["securable_type"].alias("object_type"),
        _object_name().alias("object_name"),
        F.col("response.status_code").alias("status_code"),
    )


# ---- day states ------------------------------------------------------------------------------------

#: Users to a bitmap, as Spark's bitmap functions cut numbers.
_BITMAP = 32_768


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def append_day_states(audit: DataFrame, folder: str) -> None:
    """Add the states of whole days to those kept in ``folder``; days that are there already are replaced.

    A day's state is its counts and the exact set of its users, as bitmaps over users' numbers: ``users`` gives each e-mail
    address a number for good, ``counts`` and ``sets`` are partitioned by day. States of days merge, so a report of
    any window reads its days' states and not the log.
    """
    spark = audit.sparkSession
    seen = materialise(audit.filter(_is_pii()).select("event_date", F.col("user_identity.email").alias("email")).filter("email IS NOT NULL").distinct(), "seen")
    known = _table(spark, f"{folder}/users")
    new = seen.select("email").distinct()
    base = 0
    if known is not None:
        new = new.join(known, "email", "left_anti")
        base = (known.agg(F.max("number")).first()[0] or 0) + 1
    # Numbers need not be dense: only bitmaps with a user in them are kept.
    new = materialise(new.withColumn("number", F.lit(base) + F.monotonically_increasing_id()), "users")
    new.write.mode("append").parquet(f"{folder}/users")
    numbered = seen.join(spark.read.parquet(f"{folder}/users"), "email")
    bitmap = F.floor(F.col("number") / _BITMAP).alias("bitmap")
    sets = numbered.groupBy("event_date", bitmap).agg(F.bitmap_construct_agg(F.col("number") % _BITMAP).alias("users"))
    counts = audit.groupBy("event_date").agg(
        F.count_if(_is_pii()).alias("pii"), F.count_if(_is_failed_login()).alias("failed"), F.count_if(_is_permission_change()).alias("changes")
    )
    for name, states in (("sets", sets), ("counts", counts)):
        # A replaced day overwrites its own partition only; days without PII access have counts but no set.
        states.repartition("event_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(f"{folder}/{name}")


def kpis_from_states(spark: SparkSession, folder: str, as_of: dt.date) -> DataFrame:
    """:func:`audit_kpis` from the states of its days."""
    recent = _since(as_of, RECENT_DAYS)
    counts = spark.read.parquet(f"{folder}/counts").filter(_since(as_of, LONG_DAYS)).agg(
        F.coalesce(F.sum(F.when(recent, F.col("pii"))), F.lit(0)).alias("pii_access_7d"),
        F.coalesce(F.sum(F.when(recent, F.col("failed"))), F.lit(0)).alias("failed_auth_7d"),
        F.coalesce(F.sum("changes"), F.lit(0)).alias("permission_changes_30d"),
    )
    sets = spark.read.parquet(f"{folder}/sets").filter(recent).groupBy("bitmap").agg(F.bitmap_or_agg("users").alias("users"))
    parts = counts.withColumn("unique_users_7d", F.lit(0).cast("bigint")).unionByName(
        sets.select(F.bitmap_count("users").alias("unique_users_7d")), allowMissingColumns=True
    )
    return parts.agg(*(F.sum(c).alias(c) for c in ("pii_access_7d", "unique_users_7d", "failed_auth_7d", "permission_changes_30d")))
