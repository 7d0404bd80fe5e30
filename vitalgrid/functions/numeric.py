"""Number expressions: lenient parsing, exact rounding, clamping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"
# Fixed value: texts that count as numbers (digits may be grouped with single
# underscores; no type suffixes, no hexadecimal), with white space around.
NUMBER_PATTERN = (
    "^" + _BLANK + r"([+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?"
    r"|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN]))" + _BLANK + "$"
)


def parse_number(text: Column) -> Column:
    """Double for a numeric text, NULL for anything else. ``nan`` and ``inf`` count.

    Plain decimals are cast at once. For the rest, a text that does not match the full
    pattern is extracted as the empty one, which casts to NULL.
    """
    digits = F.replace(F.regexp_extract(text, NUMBER_PATTERN, 1), F.lit("_"), F.lit(""))
    plain = text.rlike(r"^[0-9.]+$")
    return F.when(plain, text.try_cast("double")).otherwise(digits.try_cast("double"))


def comparable(value: Column) -> Column:
    """NaN becomes NULL, so that no threshold test holds for it."""
    return F.nanvl(value, F.lit(None).cast("double"))


def round_exact(value: Column, digits: int) -> Column:
    """Nearest decimal of the binary value, halves to even.

    ``round`` and ``bround`` work on the shortest decimal text of a double and are off
    for values such as 0.665. Scaling is exact except on an apparent half; there the
    rounding error of the product (split into 26-bit halves) decides.
    """
    scale = float(10**digits)
    scaled = value * F.lit(scale)
    wide = value * F.lit(134217729.0)
    high = wide - (wide - value)
    error = (high * F.lit(scale) - scaled) + (value - high) * F.lit(scale)
    on_half = (
        F.when(error > 0, F.ceil(scaled).cast("double"))
        .when(error < 0, F.floor(scaled).cast("double"))
        .otherwise(F.rint(scaled))
    )
    is_half = scaled - F.floor(scaled) == 0.5
    return F.when(is_half, on_half).otherwise(F.rint(scaled)) / F.lit(scale)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def percent(fraction: Column, digits: int) -> Column:
    return round_exact(fraction * F.lit(100.0), digits)


def standardized(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / std
