"""The main job: every copy of many subjects' data, tagged or only reachable through lineage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from stewardry.operators.lineage import lineage_conditions, trace_columns_ways, trace_seeds
from stewardry.operators.search import (
    direct_requests,
    direct_scopes,
    lineage_scopes,
    normalise_subjects,
    preselected,
    search,
    tagged_columns,
)
from stewardry.session import materialise

_RANK = {"direct": 0, "up": 1, "down": 2}


def searched_columns(requests: DataFrame, scopes: Sequence, matches: DataFrame) -> DataFrame:
    """What was looked at where something was found: (subject_id, table_full_name, tag, columns, value)."""
    rows = [(s.name, s.table, tag, list(cols)) for s in scopes for tag, cols in s.columns]
    by_scope = requests.sparkSession.createDataFrame(
        rows, "scope string, table_full_name string, tag string, columns array<string>"
    )
    found = matches.select("subject_id", "scope", "table_full_name").distinct().join(by_scope, ["scope", "table_full_name"])
    return found.join(requests, ["subject_id", "scope", "tag"]).select("subject_id", "table_full_name", "tag", "columns", "value")


def merge_matches(matches: DataFrame) -> DataFrame:
    """One row per (subject, table, row): the best way it was found, and all tags it was found by."""
    rank = F.lit(len(_RANK))
    for way, r in _RANK.items():
        rank = F.when(F.col("way") == way, r).otherwise(rank)
    tags = F.array_distinct(F.flatten(F.collect_set(F.split("matched_on", ", "))))
    merged = matches.groupBy("subject_id", "table_full_name", "row_id").agg(
        F.min_by("way", rank).alias("way"),
        F.array_join(F.array_sort(tags), ", ").alias("matched_on"),
        F.max("score").alias("score"),
        F.max("n_rows").alias("n_rows"),
    )
    provenance = F.when(F.col("way") == "up", "upstream").when(F.col("way") == "down", "downstream").otherwise("direct")
    return merged.select(
        "subject_id", "table_full_name", "row_id", provenance.alias("provenance"),
        "matched_on", "score", "n_rows", preselected().alias("preselected"),
    )


def find_subject_copies(
    subjects: DataFrame,
    tables: Mapping[str, DataFrame],
    column_tags: DataFrame,
    column_edges: DataFrame,
    nicknames: DataFrame,
    **options,
) -> DataFrame:
    """Search tagged tables, follow column lineage from what was found, and search what it leads to.

    Tables that are not in ``tables`` and columns that a table does not have are left out; what that leaves
    unsearched, :func:`unsearched_tables` reports.
    """
    direct, conditions, _ = _followed(subjects, tables, column_tags, column_edges, nicknames, **options)
    led_to, asked = lineage_scopes(_searchable(conditions, tables), tables)
    linked = search(led_to, asked, tables, nicknames, **options)
    return merge_matches(
        direct.withColumn("way", F.lit("direct")).unionByName(
            linked.withColumn("way", F.substring_index("scope", ":", 1))
        )
    )


def _followed(subjects, tables, column_tags, column_edges, nicknames, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Direct matches, the conditions that lineage leads to from them, and the identifiers."""
    identifiers = materialise(normalise_subjects(subjects), "identifiers")
    scopes = direct_scopes(column_tags, tables)
    requests = direct_requests(identifiers, scopes)
    direct = materialise(search(scopes, requests, tables, nicknames, **options), "direct")
    seeds = materialise(trace_seeds(direct, searched_columns(requests, scopes, direct)), "seeds")
    traced = trace_columns_ways(column_edges, seeds, {"up": "bronze.", "down": None})
    return direct, materialise(lineage_conditions(traced), "conditions"), identifiers


def _columns_of(conditions: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    rows = [(name, table.columns) for name, table in tables.items()]
    known = conditions.sparkSession.createDataFrame(rows, "table_full_name string, known array<string>")
    return conditions.join(known, "table_full_name", "left")


def _searchable(conditions: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Conditions with only the columns that their tables have."""
    kept = _columns_of(conditions, tables).withColumn("columns", F.array_sort(F.array_intersect("columns", "known"))).drop("known")
    return kept.filter(F.size("columns") > 0)


def unsearched_tables(
    subjects: DataFrame,
    tables: Mapping[str, DataFrame],
    column_tags: DataFrame,
    column_edges: DataFrame,
    nicknames: DataFrame,
    **options,
) -> DataFrame:
    """Where a subject's data may be and was not looked for: (subject_id, table_full_name, reason).

    Tables that carry a tag the subject has an identifier for, or that lineage leads to, but that are not in
    ``tables``; and columns that lineage names but the table does not have.
    """
    _, conditions, identifiers = _followed(subjects, tables, column_tags, column_edges, nicknames, **options)
    tagged = tagged_columns(column_tags).select(
        F.concat_ws(".", "table_catalog", "table_schema", "table_name").alias("table_full_name"), F.col("tag_name").alias("tag")
    )
    missing = tagged.distinct().filter(~F.col("table_full_name").isin(*tables))
    by_tag = identifiers.join(missing, "tag").select("subject_id", "table_full_name", F.lit("table not registered").alias("reason"))
    led = _columns_of(conditions, tables)
    lost = F.array_join(F.array_except("columns", "known"), ", ")
    reason = F.when(F.col("known").isNull(), F.lit("table not registered")).when(F.length(lost) > 0, F.concat(F.lit("no such column: "), lost))
    by_lineage = led.select("subject_id", "table_full_name", reason.alias("reason")).filter("reason IS NOT NULL")
    return by_tag.unionByName(by_lineage).distinct()
