"""Masks and hashes as SQL functions, for sessions and views that are written in SQL.

Spark inlines a SQL function into the query, so a masked scan keeps its code generation. The text functions answer as the
column expressions of :mod:`masks` and :mod:`hashing` do; :data:`FUNCTIONS` holds their bodies. Age and the constant also
take a VARIANT, whose value decides how it is masked.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from stewardry.functions.hashing import ROW_SALT, SUBJECT_SALT
from stewardry.functions.masks import CARD_PREFIX, IPV4_PATTERN, PHONE_TAIL, POSTCODE_WITH_SPACE, REDACTED


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _or_redacted(value: str) -> str:
    return f"coalesce({value}, {_text(REDACTED)})"


def _decade(number: str) -> str:
    return f"({number} - pmod({number}, 10L))"


def _bracket(text: str) -> str:
    low = _decade(f"try_cast({text} AS BIGINT)")
    return _or_redacted(f"concat(CAST({low} AS STRING), '-', CAST({low} + 9 AS STRING))")


_LOCAL, _DOMAIN = "substring_index(v, '@', 1)", "split(v, '@')[1]"
_LABEL = f"substring_index({_DOMAIN}, '.', 1)"
_REST = f"CASE WHEN length({_LABEL}) > 0 THEN substr({_DOMAIN}, length({_LABEL}) + 2) ELSE '' END"
_CODE = f"regexp_extract(trim(v), {_text(r'^(?:[+]|00)([0-9]{1,3})')}, 1)"
_OUTWARD = f"regexp_extract(upper(trim(v)), {_text(POSTCODE_WITH_SPACE)}, 1)"
_WHOLE = "CAST(floor(CAST(v AS DOUBLE)) AS BIGINT)"
_IS_NUMBER = "(schema_of_variant(v) IN ('BIGINT', 'DOUBLE', 'FLOAT') OR schema_of_variant(v) LIKE 'DECIMAL%')"

#: Name to (parameter type, result type, body over ``v``).
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "mask_email": (
        "STRING", "STRING",
        f"CASE WHEN v IS NULL THEN NULL WHEN NOT contains(v, '@') THEN {_text(REDACTED)} "
        f"ELSE concat(repeat('*', length({_LOCAL})), '@', repeat('*', length({_LABEL})), '.', {_REST}) END",
    ),
    "mask_dob": ("DATE", "DATE", "make_date(CAST(year(v) - pmod(year(v), 10) AS INT), 1, 1)"),
    "mask_age": (
        "VARIANT", "VARIANT",
        f"CASE WHEN {_IS_NUMBER} THEN CAST({_decade(_WHOLE)} AS VARIANT) ELSE CAST({_bracket('CAST(v AS STRING)')} AS VARIANT) END",
    ),
    "mask_age_number": ("DOUBLE", "BIGINT", _decade("CAST(floor(v) AS BIGINT)")),
    "mask_age_text": ("STRING", "STRING", _bracket("v")),
    "mask_ip": ("STRING", "STRING", f"CASE WHEN rlike(trim(v), {_text(IPV4_PATTERN)}) THEN concat(substring_index(trim(v), '.', 2), '.*.*') ELSE {_text(REDACTED)} END"),
    "mask_credit_card": ("STRING", "STRING", f"concat({_text(CARD_PREFIX)}, right(regexp_replace(v, '[^0-9]', ''), 4))"),
    "mask_phone": ("STRING", "STRING", _or_redacted(f"concat('+', nullif({_CODE}, ''), {_text(PHONE_TAIL)})")),
    "mask_location": ("STRING", "STRING", _or_redacted(f"nullif({_OUTWARD}, '')")),
    "mask_sensitive": ("VARIANT", "STRING", _text(REDACTED)),
    **{f"hash_{kind}_subject_ref": ("STRING", "STRING", f"sha2(concat({_text(salt)}, lower(trim(v))), 256)") for kind, salt in SUBJECT_SALT.items()},
    **{f"hash_{kind}_row_key": ("STRING", "STRING", f"sha2(concat({_text(salt)}, v), 256)") for kind, salt in ROW_SALT.items()},
}


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Define all functions in the session, under their names with ``prefix`` ahead; returns the names."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(v {takes}) RETURNS {gives} RETURN {body}")
    return [f"{prefix}{name}" for name in FUNCTIONS]
