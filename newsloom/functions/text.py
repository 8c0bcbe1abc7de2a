"""Shared text constants and column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Unicode white space, as Python's ``str.isspace`` has it, for Java character classes.
WS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: a CJK character, an ASCII word, or one other character that isn't white space.
TOKEN = rf"[\u3400-\u9fff]|[A-Za-z0-9_]+|[^{WS}]"
#: Fixed value: the same, with the white space that follows, so that slices join to the source span.
TOKEN_SPACED = rf"(?:{TOKEN})[{WS}]*"
#: Fixed value: sentence ends.
SENTENCE_END = "[。！？!?；;\n]+"


def strip(column: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(column, rf"^[{WS}]+|[{WS}]+$", "")


def token_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(TOKEN))
