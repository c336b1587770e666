"""Record identifiers: 26-character ULID text with Crockford's aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def canonical(c: Column | str) -> Column:
    """Upper case, with the aliases O, I and L replaced. Null stays null."""
    return F.translate(F.upper(F.col(c) if isinstance(c, str) else c), "OIL", "011")


def canonical_text(id: str) -> str:
    """``canonical`` for one Python string."""
    return id.upper().translate(str.maketrans("OIL", "011"))


def canonical_all(c: Column | str) -> Column:
    """Canonical, distinct, non-null ids of an array; a null array is empty."""
    c = F.col(c) if isinstance(c, str) else c
    ids = F.coalesce(c, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(ids, canonical), lambda x: x.isNotNull()))


def is_ulid(c: Column) -> Column:
    """True for text that parses as a ULID: 26 characters of the alphabet or its aliases, first one at most 7."""
    return c.rlike("^[0-7oOiIlL][0-9A-Za-z]{25}$") & ~F.upper(c).contains("U")


def ulid_millis(c: Column) -> Column:
    """The 48-bit time part of a ULID text, in milliseconds; null where the text is no ULID."""
    text = canonical(c)
    value = F.lit(0).cast("bigint")
    for i in range(1, 11):
        digit = (F.instr(F.lit(ALPHABET), F.substring(text, i, 1)) - 1).cast("bigint")
        value = value * 32 + digit
    return F.when(is_ulid(c), value)
