"""Column masks. All stay JVM-side, so a masked scan keeps whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

# --- fixed values: text and patterns that decide the masked output -------------------------
REDACTED = "[REDACTED]"
CARD_PREFIX = "**** **** **** "
PHONE_TAIL = " *** *** ****"
IPV4_PATTERN = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"
POSTCODE_WITH_SPACE = r"([A-Z]{1,2}[0-9][0-9A-Z]?) [0-9][A-Z]{2}"
# -------------------------------------------------------------------------------------------

_EMAIL_PARTS = r"(?s)^([^@]*)@([^@.]*)(?:(?<=[^@.])\.([^@]+))?"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mask_email(c) -> Column:
    """Star out the local part and the first domain label; NULL stays NULL.

    A value without ``@`` becomes ``[REDACTED]`` (indexing past the split would fail in ANSI mode).
    """
    c = _col(c)

    def part(i: int) -> Column:
        return F.regexp_extract(c, _EMAIL_PARTS, i)

    def stars(p: Column) -> Column:
        return F.repeat(F.lit("*"), F.length(p))

    masked = F.concat(stars(part(1)), F.lit("@"), stars(part(2)), F.lit("."), part(3))
    return F.when(c.isNull(), None).when(c.contains("@"), masked).otherwise(F.lit(REDACTED))


def mask_dob(c) -> Column:
    """First of January of the decade of birth."""
    year = F.year(_col(c))
    return F.make_date(year - F.pmod(year, F.lit(10)), F.lit(1), F.lit(1))


def mask_age_number(c) -> Column:
    """Numeric age to its decade; NULL stays NULL, since text cannot go back into a number column."""
    value = F.floor(_col(c)).cast("bigint")
    return value - F.pmod(value, F.lit(10))


def mask_age_text(c) -> Column:
    """Textual age to a bracket such as ``30-39``; anything but a whole number is redacted."""
    value = _col(c).try_cast("bigint")
    low = value - F.pmod(value, F.lit(10))
    bracket = F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string"))
    return F.coalesce(bracket, F.lit(REDACTED))


def mask_ip(c) -> Column:
    """Keep the first two octets of an IPv4 address; redact everything else, NULL included."""
    text = F.trim(_col(c))
    kept = F.concat(F.substring_index(text, ".", 2), F.lit(".*.*"))
    return F.when(text.rlike(IPV4_PATTERN), kept).otherwise(F.lit(REDACTED))


def mask_credit_card(c) -> Column:
    """Keep the last four digits."""
    digits = F.regexp_replace(_col(c), "[^0-9]", "")
    return F.concat(F.lit(CARD_PREFIX), F.right(digits, F.lit(4)))


def mask_phone(c) -> Column:
    """Keep the country code of ``+…`` and ``00…`` numbers (up to three digits when no space ends it)."""
    text = F.trim(_col(c))
    code = F.regexp_extract(text, r"^(?:\+|00)([0-9]{1,3})", 1)
    return F.when(F.length(code) > 0, F.concat(F.lit("+"), code, F.lit(PHONE_TAIL))).otherwise(
        F.lit(REDACTED)
    )


def mask_location(c) -> Column:
    """Keep a UK outward code that is followed by one space and an inward code; redact the rest."""
    outward = F.regexp_extract(F.upper(F.trim(_col(c))), POSTCODE_WITH_SPACE, 1)
    return F.when(F.length(outward) > 0, outward).otherwise(F.lit(REDACTED))


def mask_sensitive(c) -> Column:
    """Constant text, whatever the input."""
    return F.lit(REDACTED)


def mask_age(c, dtype: T.DataType) -> Column:
    return mask_age_text(c) if isinstance(dtype, T.StringType) else mask_age_number(c)


#: mask name -> (expression builder, accepts only text columns)
_BY_NAME = {
    "mask_email": mask_email,
    "mask_dob": mask_dob,
    "mask_ip": mask_ip,
    "mask_credit_card": mask_credit_card,
    "mask_phone": mask_phone,
    "mask_location": mask_location,
}


def mask_for(name: str, column: str, dtype: T.DataType) -> Column:
    """The mask called ``name`` for a column of type ``dtype``, cast back to that type."""
    quoted = F.col(f"`{column}`")
    if name == "mask_age":
        return mask_age(quoted, dtype).cast(dtype)
    if name == "mask_sensitive":
        if not isinstance(dtype, T.StringType):
            raise TypeError(f"{column}: the constant mask needs a text column, not {dtype.simpleString()}")
        return mask_sensitive(quoted)
    if name not in _BY_NAME:
        raise KeyError(f"unknown mask {name}")
    if name == "mask_dob":
        return mask_dob(quoted.cast("date")).cast(dtype)
    return _BY_NAME[name](quoted.cast("string")).cast(dtype)
