"""Column-mask policies: which mask a tagged column gets, for whom, and what is left unmasked."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from stewardry.functions.masks import mask_for

# --- fixed values: governed tags, their masks, and the groups that read unmasked values ------
TAG_MASKS = {
    "class.name": "mask_sensitive",
    "class.vin": "mask_sensitive",
    "class.driver_license": "mask_sensitive",
    "class.passport": "mask_sensitive",
    "class.uk_nino": "mask_sensitive",
    "class.uk_nhs": "mask_sensitive",
    "class.iban_code": "mask_sensitive",
    "class.ethnicity": "mask_sensitive",
    "class.marital_status": "mask_sensitive",
    "class.sexual_orientation": "mask_sensitive",
    "class.criminal_background": "mask_sensitive",
    "class.email_address": "mask_email",
    "class.date_of_birth": "mask_dob",
    "class.age": "mask_age",
    "class.ip_address": "mask_ip",
    "class.credit_card": "mask_credit_card",
    "class.phone_number": "mask_phone",
    "class.location": "mask_location",
}
POLICY_NAMES = {
    "mask_sensitive": "mask_sensitive_columns",
    "mask_email": "mask_email_columns",
    "mask_dob": "mask_dob_columns",
    "mask_age": "mask_age_columns",
    "mask_ip": "mask_ip_columns",
    "mask_credit_card": "mask_credit_card_columns",
    "mask_phone": "mask_phone_columns",
    "mask_location": "mask_location_columns",
}
POLICY_CATALOGS = ("silver", "gold")
TAG_PREFIX = "class."
# -------------------------------------------------------------------------------------------

#: Groups that see plain values unless the caller names others.
EXEMPT_GROUPS = ("pii-readers", "data-stewards", "data-product-services")

_TABLE_KEY = ("table_catalog", "table_schema", "table_name")


class PolicyConflict(ValueError):
    """More than one policy applies to one column."""


def default_policies(spark: SparkSession, exempt_groups: Sequence[str] = EXEMPT_GROUPS) -> DataFrame:
    """One row per catalog, policy and tag: (policy_name, catalog, tag_name, mask_name, exempt_groups)."""
    rows = [
        (POLICY_NAMES[mask], catalog, tag, mask, list(exempt_groups))
        for catalog in POLICY_CATALOGS
        for tag, mask in TAG_MASKS.items()
    ]
    schema = "policy_name string, catalog string, tag_name string, mask_name string, exempt_groups array<string>"
    return spark.createDataFrame(rows, schema)


def _matching(column_tags: DataFrame, policies: DataFrame) -> DataFrame:
    """Tagged columns with the policies of their own catalog that name the tag."""
    return column_tags.join(
        policies.withColumnRenamed("catalog", "table_catalog"), ["table_catalog", "tag_name"]
    )


def policy_conflicts(column_tags: DataFrame, policies: DataFrame) -> DataFrame:
    """Columns matched by more than one policy; reading such a column is an error."""
    per_column = _matching(column_tags, policies).groupBy(*_TABLE_KEY, "column_name")
    counted = per_column.agg(F.count_distinct("policy_name").alias("n_policies"))
    return counted.filter(F.col("n_policies") > 1)


def unmasked_tagged_columns(
    column_tags: DataFrame, policies: DataFrame, catalogs: Iterable[str] = POLICY_CATALOGS
) -> DataFrame:
    """Columns of the governed catalogs whose ``class.*`` tag no policy of that catalog names."""
    wanted = column_tags.filter(
        F.col("tag_name").startswith(TAG_PREFIX) & F.col("table_catalog").isin(*catalogs)
    )
    covered = policies.select(F.col("catalog").alias("table_catalog"), "tag_name").distinct()
    return wanted.join(covered, ["table_catalog", "tag_name"], "left_anti").select(
        *_TABLE_KEY, "column_name", "tag_name"
    )


def apply_masks(
    df: DataFrame,
    full_name: str,
    column_tags: DataFrame,
    policies: DataFrame,
    groups: Iterable[str] = (),
) -> DataFrame:
    """The view of ``df`` that a reader in ``groups`` gets: one projection, masks only where due.

    Only this table's own tag rows (at most a few per column) come to the driver, to plan it.
    """
    catalog, schema, table = full_name.split(".")
    mine = (
        (F.col("table_catalog") == catalog) & (F.col("table_schema") == schema) & (F.col("table_name") == table)
    )
    reader = F.array(*[F.lit(g) for g in groups]).cast("array<string>")
    due = (
        _matching(column_tags.filter(mine), policies)
        .filter(~F.arrays_overlap("exempt_groups", reader))
        .select("column_name", "policy_name", "mask_name")
        .distinct()
    )
    mask_of: dict[str, str] = {}
    for row in due.collect():
        if row.column_name in mask_of:
            raise PolicyConflict(f"{full_name}.{row.column_name} is matched by several policies")
        mask_of[row.column_name] = row.mask_name
    return df.select(
        *[
            mask_for(mask_of[f.name], f.name, f.dataType).alias(f.name) if f.name in mask_of else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
