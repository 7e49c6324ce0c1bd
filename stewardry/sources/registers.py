"""Small organisation-kept registers in JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SYSTEM_SCHEMA = """systems array<struct<
 id string, system_name string, decision_type string, solely_automated boolean, human_review_exists string,
 legal_or_significant_effect boolean, statement string, safeguards_text string,
 effective_from string, last_reviewed string, owner string>>"""
TEMPLATE_SCHEMA = "templates array<struct<label string, text string>>"


def decision_systems(spark: SparkSession, path: str) -> DataFrame:
    """The register of automated decision systems, one row per system."""
    return spark.read.json(path, schema=SYSTEM_SCHEMA, multiLine=True).select(F.inline("systems"))


def recipient_templates(spark: SparkSession, path: str) -> DataFrame:
    """Phrases offered for the recipients of a disclosure, one row per phrase."""
    return spark.read.json(path, schema=TEMPLATE_SCHEMA, multiLine=True).select(F.inline("templates"))
