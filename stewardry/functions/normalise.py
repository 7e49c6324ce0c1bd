"""Search-key normalisers for names, phones and postcodes, as JVM column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# --- fixed values: forms of address dropped from the front of a name, and postcode patterns --
HONORIFICS = (
    "mr", "mrs", "ms", "miss", "dr", "prof",
    "sir", "mx", "rev", "lord", "lady",
    "master", "mstr", "dame", "fr", "hon", "cllr",
    "capt", "col", "maj", "sgt", "lt", "gen", "judge",
    "baron", "baroness",
)
POSTCODE_ANYWHERE = r"(?i)\b([A-Z]{1,2}[0-9][0-9A-Z]?)\s?([0-9][A-Z]{2})\b"
POSTCODE_CLEAN = r"^[A-Z]{1,2}[0-9][0-9A-Z]?[0-9][A-Z]{2}$"
PHONE_DIGITS = 9
# -------------------------------------------------------------------------------------------

TAG_NAME = "class.name"
TAG_PHONE = "class.phone_number"
TAG_LOCATION = "class.location"
TAG_EMAIL = "class.email_address"
TAG_DOB = "class.date_of_birth"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition reduced to ASCII, derived from the Unicode database.

    Characters that reduce to one ASCII character go to a translate table; the few in the basic
    plane that reduce to several (ligatures, fractions) go to a map.
    """
    singles: dict[str, str] = {}
    several: dict[str, str] = {}
    for code in range(0x80, 0x20000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        folded = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            singles[ch] = folded
        elif folded and code < 0x10000:
            several[ch] = folded
    return "".join(singles), "".join(singles.values()), several


def fold_accents(c) -> Column:
    """Strip diacritics (``José`` to ``Jose``) and drop Latin letters and symbols without an ASCII form.

    Letters of other scripts stay, so a Greek, Cyrillic or Han name is searched as it is written.

    Plain ASCII text passes through untouched, and text whose characters all fold one to one needs
    a single translation; only the rest is taken apart character by character.
    """
    c = _col(c)
    source, target, several = _fold_tables()
    foreign = r"[^\x00-\x7F]"
    translated = F.translate(c, source, target)
    pairs = "\x01".join(f"{ch}\x02{folded}" for ch, folded in several.items())
    lookup = F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))
    spread = F.array_join(
        F.transform(F.split(translated, ""), lambda ch: F.coalesce(F.element_at(lookup, ch), ch)), ""
    )
    return (
        F.when(~c.rlike(foreign), c)
        .when(~translated.rlike(foreign), translated)
        .otherwise(F.regexp_replace(spread, r"[^\x00-\x7F\p{L}\p{M}\p{Nd}]|[\p{IsLatin}&&[^\x00-\x7F]]", ""))
    )


def norm_name(c) -> Column:
    """Fold accents, drop one leading form of address, keep letters of any script, spaces and hyphens, lower-case."""
    text = F.trim(F.regexp_replace(fold_accents(c), r"\s+", " "))
    lead = r"(?i)^(?:" + "|".join(HONORIFICS) + r")\.*(?: |$)"
    letters = F.regexp_replace(F.regexp_replace(text, lead, ""), r"[^\p{L}\p{M}\s\-]", "")
    return F.lower(F.trim(F.regexp_replace(letters, r"\s+", " ")))


def norm_phone(c) -> Column:
    """The last nine digits, so any country-code prefix falls away."""
    return F.right(F.regexp_replace(_col(c), "[^0-9]", ""), F.lit(PHONE_DIGITS))


def norm_postcode(c) -> Column:
    """First UK postcode found anywhere, upper case without the space; other text unchanged."""
    c = _col(c)
    found = F.upper(
        F.concat(F.regexp_extract(c, POSTCODE_ANYWHERE, 1), F.regexp_extract(c, POSTCODE_ANYWHERE, 2))
    )
    return F.when(F.length(found) > 0, found).otherwise(c)


def is_clean_postcode(c) -> Column:
    return _col(c).rlike(POSTCODE_CLEAN)


def compact_upper(c) -> Column:
    """Upper case without spaces: the form in which postcodes are compared inside addresses."""
    return F.upper(F.regexp_replace(_col(c), " +", ""))


def normalise_for_tag(tag, value) -> Column:
    """Normalise a search value by the kind of identifier; other kinds pass unchanged."""
    tag, value = _col(tag), _col(value)
    return (
        F.when(tag == TAG_NAME, norm_name(value))
        .when(tag == TAG_PHONE, norm_phone(value))
        .when(tag == TAG_LOCATION, norm_postcode(value))
        .otherwise(value)
    )
