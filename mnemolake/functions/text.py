"""Tokens of a text, the same in Spark, in Python and in SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and ``_``; tokens of one byte are dropped unless numeric."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: (F.octet_length(x) > 1) | x.rlike(r"^\p{N}+$"))


def tokenize(text: str) -> list[str]:
    """``tokens`` for one Python string; ``\\w`` is a letter, a number or ``_``."""
    return [w for w in _WORD.findall(text.lower()) if len(w) > 1 or ord(w) > 127 or w.isnumeric()]
