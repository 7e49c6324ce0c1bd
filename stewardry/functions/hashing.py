"""Salted pseudonyms for subjects and rows. Erasure and disclosure use separate salts, so a
hash of one trail can never be taken for a hash of the other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values: versioned salts ---------------------------------------------------------
SUBJECT_SALT = {"erasure": "sar-erasure-v1:", "access": "sar-access-v1:"}
ROW_SALT = {"erasure": "sar-erasure-row-v1:", "access": "sar-access-row-v1:"}
# -------------------------------------------------------------------------------------------

_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_subject_ref(c, purpose: str) -> Column:
    return F.sha2(F.concat(F.lit(SUBJECT_SALT[purpose]), F.lower(F.trim(_col(c)))), 256)


def hash_row_key(c, purpose: str) -> Column:
    return F.sha2(F.concat(F.lit(ROW_SALT[purpose]), _col(c)), 256)


def row_text(columns: Sequence[str]) -> Column:
    """One unambiguous text per row: JSON of the named columns in order, NULLs and microseconds kept.

    Joining rendered values with a separator would depend on the whole batch (a NULL turns an
    integer column into floats) and would confuse values that hold the separator.
    """
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), _JSON)


def with_row_key(
    df: DataFrame, purpose: str, columns: Sequence[str] | None = None, name: str = "row_key"
) -> DataFrame:
    """Add the salted key of each row; by default over all columns in schema order."""
    return df.withColumn(name, hash_row_key(row_text(columns or df.columns), purpose))
