"""Scalar column helpers: parsing, clipping and the decimal formatting used in text output."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of a boolean.
TRUE_TOKENS = ["1", "true", "yes", "y", "on"]
FALSE_TOKENS = ["0", "false", "no", "n", "off"]


def safe_double(c: Column, default: float | None = None, finite: bool = False) -> Column:
    """Double or ``default`` for null, unparseable and NaN; with ``finite`` also for infinities."""
    null = F.lit(None).cast("double")
    x = F.nanvl(c.try_cast("double"), null)  # names its input once: inside a lambda an input named twice is evaluated twice
    if finite:
        x = F.when(F.abs(x) == F.lit(float("inf")), null).otherwise(x)
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def to_bool(c: Column, default: bool = False) -> Column:
    token = F.lower(F.trim(c.cast("string")))
    return F.when(token.isin(TRUE_TOKENS), F.lit(True)).when(token.isin(FALSE_TOKENS), F.lit(False)).otherwise(F.lit(default))


def r4(c: Column) -> Column:
    """Four decimals without a negative zero, for reports that are compared across engines."""
    half_up = F.floor(F.abs(c) * 10000.0 + F.lit(0.5)) / F.lit(10000.0)
    return F.when(c < 0, -half_up).otherwise(half_up) + F.lit(0.0)


def _scaled_half_even(x: str, digits: int) -> str:
    """|x|·10^digits as a whole number, rounded on the exact binary value with ties to even (SQL text).

    The error-free product splits |x| into two halves whose products with the small scale are exact.
    """
    scale = f"{10**digits}.0D"
    a = f"abs({x})"
    p, low = f"({a} * {scale})", f"floor({a} * {scale})"
    hi = f"({a} * 134217729.0D - ({a} * 134217729.0D - {a}))"
    err = f"(({hi} * {scale} - {p}) + ({a} - {hi}) * {scale})"
    at_half = f"CASE WHEN {err} < 0 THEN {low} WHEN {err} > 0 THEN {low} + 1 ELSE {low} + {low} % 2 END"
    # only a product at one half can hide on which side of it the exact value lies
    return f"CASE WHEN {p} - {low} = 0.5D THEN {at_half} ELSE rint({p}) END"


def half_even_sql(x: str, digits: int) -> str:
    """Correctly rounded decimal of the exact binary value of ``x`` (SQL text)."""
    return f"(CASE WHEN {x} < 0 THEN -1.0D ELSE 1.0D END * ({_scaled_half_even(x, digits)}) / {10**digits}.0D)"


def fixed_sql(x: str, digits: int, plus: bool = False) -> str:
    """Fixed-point text of ``x``; ``plus`` writes a sign on non-negative values too (SQL text).

    Below 1e12 the rounded value has at most 15 digits, so a decimal holds just these; printf, which costs more, writes the rest: larger
    values, NaN and infinities. Null is written out; printf would cut the word to ``digits`` letters.
    """
    rounded = f"{_scaled_half_even(x, digits)} / {10**digits}.0D"
    # only the text of a zero tells its sign
    negative = f"({x} < 0 OR ({x} = 0 AND startswith(cast({x} AS string), '-')))"
    exact = f"concat(if({negative}, '-', '{'+' if plus else ''}'), cast(cast({rounded} AS decimal(18, {digits})) AS string))"
    printed = f"format_string('%{'+' if plus else ''}.{digits}f', {half_even_sql(x, digits)})"
    return f"(CASE WHEN abs({x}) < 1e12D THEN {exact} WHEN {x} IS NULL THEN 'null' ELSE {printed} END)"


def round_half_even(x: Column, digits: int) -> Column:
    """Half-even decimal rounding of a column, exact for binary ties."""
    scale = float(10**digits)
    p = F.abs(x) * F.lit(scale)
    t = F.abs(x) * F.lit(134217729.0)
    hi = t - (t - F.abs(x))
    err = (hi * F.lit(scale) - p) + (F.abs(x) - hi) * F.lit(scale)
    low = F.floor(p).cast("double")
    at_half = F.when(err < 0, low).when(err > 0, low + 1).otherwise(low + low % 2)
    v = F.when(p - low == 0.5, at_half).otherwise(F.rint(p)) / F.lit(scale)
    return F.when(x < 0, -v).otherwise(v)


def parse_day(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd")) -> Column:
    """First format that parses wins; anything else is null."""
    return F.coalesce(*[F.try_to_date(c, f) for f in formats])


def mean_of(num: Column, den: Column) -> Column:
    """num/den with 0 on an empty denominator."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)
