"""Disclose what was found: which columns, which rows, under which facts, with an audit trail."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stewardry.functions.durations import at
from stewardry.functions.hashing import hash_row_key, row_text
from stewardry.operators.search import row_id

# --- fixed values --------------------------------------------------------------------------
SLA_DAYS = 30
NOT_TRACKED = "Not tracked by the platform's retention-compliance view."
NO_RETENTION = "No automatic retention policy configured for this table."
RETENTION_FROM, RETENTION_TO = "Automatic retention configured (freshness SLA: ", ")."
NO_DECISION_SYSTEM = (
    "No automated decision-making system registered as applicable to this "
    "disclosure was identified. This reflects the organisation's registered "
    "automated decision-making systems only."
)
# -------------------------------------------------------------------------------------------

_ITEM = ["request_id", "table_full_name"]


# ---- which columns ---------------------------------------------------------------------------

def columns_by_tag(column_tags: DataFrame) -> DataFrame:
    """All governed columns of each table, by tag. ``column_tags(table_full_name, column_name, tag_name)``."""
    governed = column_tags.filter(F.col("tag_name").startswith("class."))
    return governed.groupBy("table_full_name", "tag_name").agg(F.array_sort(F.collect_set("column_name")).alias("columns"))


def default_columns(matched: DataFrame, columns: DataFrame, column_tags: DataFrame, searched: DataFrame) -> DataFrame:
    """Proposed scope: a column is in unless it is tagged with something that was not searched.

    ``matched(request_id, table_full_name)``, ``columns(table_full_name, column_name,
    ordinal_position)``, ``searched(request_id, tag_name)``.

    Each table's columns with their tags are one row, and so are the tags that a request searched. Only pairs of request
    and table are shuffled; their columns are listed after the last join.
    """
    governed = column_tags.filter(F.col("tag_name").startswith("class."))
    tags = governed.groupBy("table_full_name", "column_name").agg(F.array_sort(F.collect_set("tag_name")).alias("tags"))
    none = F.array().cast("array<string>")
    column = F.struct("column_name", "ordinal_position", F.coalesce("tags", none).alias("tags"))
    layouts = columns.join(tags, ["table_full_name", "column_name"], "left").groupBy("table_full_name").agg(F.collect_set(column).alias("layout"))
    asked = searched.groupBy("request_id").agg(F.collect_set("tag_name").alias("asked"))
    items = matched.select(*_ITEM).distinct().join(asked, "request_id", "left").join(layouts, "table_full_name")
    listed = items.select(*_ITEM, F.coalesce("asked", none).alias("asked"), F.explode("layout").alias("c"))
    return listed.select(
        *_ITEM, "c.column_name", "c.ordinal_position",
        F.array_min("c.tags").alias("tag_name"),
        F.forall("c.tags", lambda t: F.array_contains("asked", t)).alias("included"),
    )


def column_scope(defaults: DataFrame) -> DataFrame:
    """Per item the disclosed columns in table order and the governed columns held back."""
    chosen = F.array_sort(F.collect_list(F.when(F.col("included"), F.struct("ordinal_position", "column_name"))))
    held = F.array_sort(F.collect_list(F.when(~F.col("included") & F.col("tag_name").isNotNull(), F.col("column_name"))))
    scope = defaults.groupBy(*_ITEM).agg(chosen.alias("c"), held.alias("columns_redacted"))
    return scope.select(*_ITEM, F.transform("c", lambda c: c.column_name).alias("columns_included"), "columns_redacted")


def categories(defaults: DataFrame) -> DataFrame:
    """Categories of personal data per request: the tags of the disclosed columns."""
    tags = F.array_sort(F.collect_set(F.when(F.col("included"), F.col("tag_name"))))
    return defaults.groupBy("request_id").agg(tags.alias("categories"))


# ---- facts about the tables ---------------------------------------------------------------------

def retention_lines(matched: DataFrame, rc: DataFrame) -> DataFrame:
    """One sentence on retention per matched table, from the compliance view."""
    facts = rc.select(F.col("full_table_name").alias("table_full_name"), "has_delete_at", "freshness_sla")
    line = (
        F.when(F.col("has_delete_at").isNull(), F.lit(NOT_TRACKED))
        .when(~F.col("has_delete_at"), F.lit(NO_RETENTION))
        .otherwise(F.concat(F.lit(RETENTION_FROM), "freshness_sla", F.lit(RETENTION_TO)))
    )
    return matched.join(facts, "table_full_name", "left").select(*matched.columns, line.alias("retention_line"))


def table_comments(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Table comment and a map of column comments per table."""
    key = ["table_catalog", "table_schema", "table_name"]
    entries = F.array_sort(F.collect_list(F.struct("column_name", "comment")))
    noted = columns.filter(F.col("comment").isNotNull()).groupBy(*key).agg(F.map_from_entries(entries).alias("column_comments"))
    return tables.join(noted, key, "left").select(
        F.concat_ws(".", *key).alias("table_full_name"), F.col("comment").alias("table_comment"), "column_comments"
    )


# ---- which rows -----------------------------------------------------------------------------------

def disclosed_rows(
    matches: DataFrame, tables: Mapping[str, DataFrame], scope: DataFrame, primary_keys: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Every matched row with its disclosed cells, in table order.

    ``matches(request_id, table_full_name, row_id, n_rows)``: all rows found count, whether or not
    they were selected for erasure. Equal rows appear once with their number. Redacted columns are
    dropped, not masked. ``cells`` is ``array<struct<column, value>>``; ``row_key_hash`` covers the
    whole row.
    """
    parts = []
    for name, table in tables.items():
        hits = matches.filter(F.col("table_full_name") == name).join(
            scope.filter(F.col("table_full_name") == name), _ITEM
        )
        rows = table.withColumn("row_id", row_id(table, (primary_keys or {}).get(name)))
        wanted = hits.select("row_id").distinct()
        found = rows.join(wanted, "row_id", "left_semi").dropDuplicates(["row_id"])
        cells = F.create_map(*[x for c in table.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])
        packed = found.select("row_id", cells.alias("all_cells"), hash_row_key(row_text(table.columns), "access").alias("row_key_hash"))
        joined = packed.join(hits, "row_id")
        chosen = F.transform(
            "columns_included", lambda c: F.struct(c.alias("column"), F.element_at("all_cells", c).alias("value"))
        )
        parts.append(joined.select(*_ITEM, "row_id", "n_rows", "row_key_hash", chosen.alias("cells")))
    return reduce(DataFrame.unionByName, parts)


def disclosure(rows: DataFrame) -> DataFrame:
    """Long form: one row per disclosed cell."""
    return rows.select(*_ITEM, "row_id", "n_rows", F.posexplode("cells").alias("position", "cell")).select(
        *_ITEM, "row_id", "n_rows", "position", F.col("cell.column").alias("column_name"), F.col("cell.value").alias("value")
    )


# ---- audit and release ---------------------------------------------------------------------------

def access_items(rows: DataFrame, scope: DataFrame, matched: DataFrame, generated_at: dt.datetime) -> DataFrame:
    """One audit row per item: rows disclosed, columns in and out. ``matched`` gives provenance and
    matched tags per item; hashes go with :func:`access_hashes`."""
    counts = rows.groupBy(*_ITEM).agg(F.sum("n_rows").alias("rows_disclosed"))
    return (
        matched.join(scope, _ITEM)
        .join(counts, _ITEM, "left")
        .select(
            *_ITEM, "provenance", "matched_column_or_tag",
            F.coalesce("rows_disclosed", F.lit(0)).alias("rows_disclosed"),
            "columns_included", "columns_redacted",
            at(generated_at).alias("generated_at"),
        )
    )


def access_hashes(rows: DataFrame) -> DataFrame:
    """Hashes of the disclosed rows in long form, ready for :func:`erasure.pack_hashes`."""
    return rows.select(*_ITEM, "row_key_hash", F.col("n_rows").alias("n"))


def access_status(requests: DataFrame, items: DataFrame) -> DataFrame:
    """COMPLETED, or FAILED for a request without any item."""
    done = items.select("request_id", F.lit(True).alias("done")).distinct()
    status = F.when(F.col("done"), F.lit("COMPLETED")).otherwise(F.lit("FAILED"))
    return requests.select("request_id").join(done, "request_id", "left").select("request_id", status.alias("status"))


def sla_state(requests: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Where each request stands against its deadline of 30 days."""
    kind = dict(requests.dtypes)["requested_at"]
    deadline = F.col("requested_at") + F.make_dt_interval(F.lit(SLA_DAYS))
    now, done = at(as_of, kind), F.col("completed_at")
    state = (
        F.when(done <= deadline, F.lit("on time"))
        .when(done.isNotNull(), F.lit("late"))
        .when(now <= deadline, F.lit("open"))
        .otherwise(F.lit("overdue"))
    )
    return requests.select("request_id", F.to_date(deadline).alias("deadline"), state.alias("sla_state"))


def release_violations(requests: DataFrame) -> DataFrame:
    """What keeps each request from being released: one row per request that may not be.

    ``requests(request_id, purpose, recipients, unsure, n_systems, none_confirmed)``.
    """
    def blank(c: str) -> Column:
        return F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0

    chosen, none = F.col("n_systems") > 0, F.col("none_confirmed")
    checks = {
        "purpose missing": blank("purpose"),
        "recipients missing": blank("recipients"),
        "automated decisions unsure": F.col("unsure"),
        "automated decisions contradictory": ~F.col("unsure") & chosen & none,
        "automated decisions unanswered": ~F.col("unsure") & ~chosen & ~none,
    }
    found = F.array_compact(F.array(*[F.when(test, F.lit(text)) for text, test in checks.items()]))
    return requests.select("request_id", found.alias("violations")).filter(F.size("violations") > 0)


def decision_systems_for(requests: DataFrame, selections: DataFrame, register: DataFrame) -> DataFrame:
    """Statements on automated decisions per request: its selected systems, or the default sentence."""
    chosen = selections.join(register, selections["system_id"] == register["id"]).select(
        "request_id", "system_name", "statement", "safeguards_text"
    )
    return requests.select("request_id").join(chosen, "request_id", "left").select(
        "request_id", "system_name", F.coalesce("statement", F.lit(NO_DECISION_SYSTEM)).alias("statement"), "safeguards_text"
    )
