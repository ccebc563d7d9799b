"""Text normalisation and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space that a strip removes (no-break spaces stay), ISO controls,
# and the identifier patterns of the contract.
_SPACE = r"[\s\x1C-\x1F\p{Z}&&[^\x{A0}\x{2007}\x{202F}]]"
_CONTROL = r"[\x00-\x1F\x7F-\x9F]"
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,79}$"
USER_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{_SPACE}+", ""), f"{_SPACE}+\\z", "")


def has_control(text: Column) -> Column:
    return text.rlike(_CONTROL)


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def matches(text: Column, pattern: str) -> Column:
    """Whole-text match; ``$`` alone would let a final line break pass."""
    return text.rlike(pattern.replace("$", r"\z"))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order, repeats kept."""
    return F.filter(F.split(F.lower(text), _TOKEN_BREAK), lambda t: t != "")
