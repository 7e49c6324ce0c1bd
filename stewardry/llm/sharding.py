"""Proportional stratified interleaving: shards that all hold the mixture of the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stewardry.llm.common import grain_bits
from stewardry.session import materialise

#: Rows that one task sorts in one window partition, about.
GRAIN = 5_000


def _ranked(df: DataFrame, group: list[str], bucket: Column, order: list[str], out: str) -> DataFrame:
    """Add the rank from 0 within ``group`` (all rows, if it is empty), and the group's size.

    ``bucket`` grows with ``order``. Buckets are ranked apart and shifted by what lies before them, so no group
    has to fit one task.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *group,
        "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy(*group)).alias("_total"),
    )
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(within))
        .join(shifts, [*group, "_bucket"])
        .withColumn(out, F.col("_shift") + F.col("_rank") - 1)
        .drop("_bucket", "_shift", "_rank")
    )


def interleave(
    df: DataFrame,
    shards: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "source",
    seed: int = 17,
    grain: int = GRAIN,
) -> DataFrame:
    """Deal all rows into ``shards`` shards whose row counts differ by at most one.

    Rows of each stratum are shuffled by a seeded hash and ranked; a row's fractional rank is
    ``(rank + 1/2) / stratum size``. Sorted by it, every stretch of rows holds every stratum in proportion, so
    the sorted rows are cut into ``shards`` equal stretches. Any two shards' rows of one stratum differ by two at
    most. ``slot`` counts a shard's rows from 0 in that order.

    Returns ``doc_id, stratum, size`` (UTF-8 bytes of the text plus 16), ``text_crc32, shard, slot``. A NULL text
    counts as empty, a NULL stratum is a stratum of its own, a NULL id is kept, repeated rows are dealt like any
    others, further columns are ignored, and an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    stratum = F.col(stratum_col).cast("string")
    rows = materialise(
        df.select(
            F.col(id_col).alias("doc_id"),
            stratum.alias("stratum"),
            F.when(stratum.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), stratum)).alias("_stratum"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
        ).withColumn("_draw", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", "_stratum")),
        "shard-rows",
    )
    bits = grain_bits(rows.count(), grain)
    draw_bucket = F.shiftright("_draw", 64 - bits) if bits else F.lit(0).cast("long")
    ranked = _ranked(rows, ["_stratum"], draw_bucket, ["_draw", "doc_id", "text_crc32"], "_place")
    ranked = ranked.withColumn("_fraction", (F.col("_place") + 0.5) / F.col("_total")).drop("_total")
    ranked = ranked.withColumn("_turn", F.xxhash64(F.lit(seed + 1), "_stratum"))
    whole = _ranked(ranked, [], F.floor(F.col("_fraction") * (1 << bits)), ["_fraction", "_turn", "_stratum", "_place"], "_position")
    shard = F.expr(f"(_position * {shards}) div _total")
    return whole.withColumn("_shard", shard).select(
        "doc_id",
        "stratum",
        "size",
        "text_crc32",
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_position") - F.expr(f"(_shard * _total + {shards - 1}) div {shards}")).cast("long").alias("slot"),
    )
