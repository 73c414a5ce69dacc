"""Digests and canonical JSON."""

from __future__ import annotations

import hashlib
import json
import math
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import hex_to_long


def stable_json(value, allow_nan: bool = False) -> str:
    """Canonical JSON text: sorted keys, no spaces, raw Unicode. NaN and infinities are errors unless allowed."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=allow_nan)


def stable_sha256(value, allow_nan: bool = False) -> str:
    return hashlib.sha256(stable_json(value, allow_nan).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON text in canonical form; null for null and broken text. Floats as Python prints them, which ``to_json`` does not."""

    def one(t):
        try:
            return None if t is None else stable_json(json.loads(t))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


def json_sha256(c: Column) -> Column:
    """Digest of the canonical form of JSON text."""
    return F.sha2(canonical_json(c), 256)


def row_sha256(*cols: Column) -> Column:
    """Digest over columns without leaving the JVM: fields are length-prefixed, so no two rows share a text; null has its own mark."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cols]
    return F.sha2(F.concat_ws(";", *parts), 256)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hex."""
    return F.bit_count(hex_to_long(a).bitwiseXOR(hex_to_long(b)))


def perceptual_bits(rows: Column) -> Column:
    """The 64-bit hash of an 8 x 9 array of grey values, as 16 hex digits: bit 0 is the first comparison, set where the left value is greater."""
    bits = F.flatten(F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (r[i] > r[i + 1]).cast("bigint"))))
    packed = F.aggregate(F.transform(bits, lambda b, i: F.expr("0L") + b * F.call_function("shiftleft", F.lit(1).cast("bigint"), i)), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))
    return F.lower(F.lpad(F.hex(packed), 16, "0"))


def deterministic_label(base_seed: Column, row: Column, col: Column) -> Column:
    """``S<10 hex digits>-R<row>-C<col>``, rows and columns from 1 in the label, from 0 in the digest."""
    text = F.concat_ws("|", F.lit("cell-text"), base_seed.cast("string"), row.cast("string"), col.cast("string"))
    return F.format_string("S%s-R%d-C%d", F.upper(F.substring(F.sha2(text, 256), 1, 10)), row + 1, col + 1)


def deterministic_rng(namespace: str, *parts: object) -> random.Random:
    """A generator seeded by the first half of a digest over its name and parts; Spark has none like it."""
    text = "|".join([namespace, *map(str, parts)])
    return random.Random(int.from_bytes(hashlib.sha256(text.encode()).digest()[:16], "big"))


def is_finite(c: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))
