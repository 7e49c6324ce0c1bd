"""Platform columns on a stream of changes.

Spark's own state store keeps, for each key, when it first came, when it last came and its newest values, so no table is
read or rewritten to find out. Each micro-batch hands on the rows it changed, whole; a folder of such changes, one
partition a batch, is the table, and its newest row per key the current one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stewardry.functions.durations import at

# --- fixed values --------------------------------------------------------------------------
RETENTION_DAYS = 365 * 7
# -------------------------------------------------------------------------------------------

def stamp(df: DataFrame, as_of: dt.datetime | None = None, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """Add the three platform columns to new rows; works on streams and batches."""
    now = F.current_timestamp() if as_of is None else at(as_of, "timestamp")
    return (
        df.withColumn("_inserted_at", now)
        .withColumn("_updated_at", now)
        .withColumn("_delete_at", now + F.make_dt_interval(F.lit(retention_days)))
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last change of each key; changes are combined per task before they are shuffled."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r"))
    return newest.select(*keys, "r.*")


def merge_stamped(current: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert a stamped batch: new values win, but ``_inserted_at`` of known rows stays."""
    columns = [c for c in current.columns if c not in keys]
    old = current.select(*keys, F.struct(*columns).alias("old"))
    new = batch.select(*keys, F.struct(*columns).alias("new"))
    merged = old.join(new, list(keys), "full_outer")
    picked = [
        F.coalesce("old._inserted_at", "new._inserted_at").alias(c) if c == "_inserted_at"
        else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
        for c in columns
    ]
    return merged.select(*keys, *picked)


def stamped_changes(
    stream: DataFrame, keys: Sequence[str], order: str, clock: Column | None = None, retention_days: int = RETENTION_DAYS
) -> DataFrame:
    """The stream's newest row per key with platform columns, as a streaming aggregation.

    ``_inserted_at`` is the time of the key's first batch and stays, ``_updated_at`` that of its last; the newest row is the
    greatest by ``order`` and then by its values. ``clock`` may give a row's time instead of its batch's.
    """
    rest = [c for c in stream.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")
    timed = stream.withColumn("_now", (F.current_timestamp() if clock is None else clock).cast("timestamp"))
    kept = timed.groupBy(*keys).agg(newest, F.min("_now").alias("_inserted_at"), F.max("_now").alias("_updated_at"))
    gone = F.col("_updated_at") + F.make_dt_interval(F.lit(retention_days))
    return kept.select(*keys, "r.*", "_inserted_at", "_updated_at", gone.alias("_delete_at"))


def stamp_stream(
    stream: DataFrame,
    keys: Sequence[str],
    order: str,
    root: str,
    checkpoint: str,
    retention_days: int = RETENTION_DAYS,
    clock: Column | None = None,
) -> StreamingQuery:
    """Write :func:`stamped_changes` below ``root``, one partition a micro-batch.

    A batch that is run again after a failure overwrites its own partition and no other.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    changes = stamped_changes(stream, keys, order, clock, retention_days)
    return (
        changes.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """The current table: of each key the row that the last batch with it wrote."""
    changes = spark.read.parquet(root)
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, "r.*")
