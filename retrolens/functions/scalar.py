"""Scalar functions with the semantics of the source dialect, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*parts: Column) -> Column:
    """Null if any part is."""
    return F.concat(*[p.cast("string") for p in parts])


def length(text: Column) -> Column:
    """Bytes, not characters."""
    return F.octet_length(text)


def int_div(a: Column, b: Column) -> Column:
    """Whole quotient, cut towards zero; null for a zero divisor."""
    divisor = F.nullif(b, F.lit(0))
    return ((a - a % divisor) / divisor).cast("long")


def mod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; null for a zero divisor."""
    return a % F.nullif(b, F.lit(0))


def null_safe_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def bound(value: object, kind: str) -> Column:
    """A recorded value in place of a function that isn't deterministic."""
    return F.lit(value).cast(kind)


# The generator's factor, increment and modulus.
LCG_FACTOR, LCG_STEP, LCG_MODULUS = 1103515245, 12345, 2147483648


def linear_congruence(seed: Column) -> Column:
    """The next number of the generator that stored functions draw from."""
    return ((seed * LCG_FACTOR + LCG_STEP) % LCG_MODULUS).cast("long")


def random_number(seed: Column, low: int, high: int) -> Column:
    return (F.lit(low) + linear_congruence(seed) % (high - low + 1)).cast("long")


def non_uniform(seed: Column, a: int, low: int, high: int, c: int = 0) -> Column:
    """((r1 | r2) + c) mod range + low, two draws from one seed."""
    r1, r2 = linear_congruence(seed) % (a + 1), linear_congruence(linear_congruence(seed)) % (high - low + 1)
    return ((r1.bitwiseOR(low + r2) + c) % (high - low + 1) + low).cast("long")


def json_object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def json_text(document: Column, path: str) -> Column:
    """The value at a path, without quotes."""
    return F.get_json_object(document, path)


def implicit_name(text: Column) -> Column:
    """NAME_CONST(n, v) and character set marks written by statement logging, as the bare value."""
    out = F.regexp_replace(text, r"(?i)NAME_CONST\('[^']*',\s*((?:_\w+)?'(?:[^']|'')*'|[^)']*)(?:\s+COLLATE\s+'?\w+'?)?\)", "$1")
    return F.regexp_replace(out, r"(?i)_(utf8mb4|utf8mb3|utf8|latin1|binary)'", "'")
