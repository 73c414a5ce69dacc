"""Text and key normalisation, as Spark columns wherever Spark has the means."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Exactly the characters that Python's ``str.isspace`` and ``\\s`` accept.
SPACE = r"[\s\u001c-\u001f\u0085\p{Z}]"
#: The same characters, one by one.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Python's ``str.strip``; Spark's ``trim`` removes blanks only."""
    return F.btrim(c, F.lit(SPACES))


def fold_key(c: Column) -> Column:
    """A key without case and surrounding white space; null stays null."""
    return F.lower(strip(c))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC, for which Spark has no function. Null stays null."""
    return s.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))


def normalize_text(c: Column) -> Column:
    """NFKC without any white space; null becomes ''."""
    return F.coalesce(F.regexp_replace(nfkc(c), f"{SPACE}+", ""), F.lit(""))


def hex_to_long(c: Column) -> Column:
    """64 bits in hex as a signed BIGINT; ``conv`` to base -10 wraps where a cast would throw."""
    return F.conv(c, 16, -10).cast("bigint")
