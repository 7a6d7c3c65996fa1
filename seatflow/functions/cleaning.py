"""Text clean-up and recoding of single columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Unicode calls white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Trim every kind of white space; the plain ``trim`` only knows the blank."""
    return F.trim(col, F.lit(WHITE_SPACE))


def scrub(col: Column, sentinel: str = "na") -> Column:
    """Trimmed text, NULL where only the missing-value word is left (case-sensitive)."""
    return F.nullif(strip(col), F.lit(sentinel))


def canonical(col: Column) -> Column:
    return F.upper(strip(col))


def straight_apostrophe(col: Column) -> Column:
    return F.replace(col, F.lit("\u2019"), F.lit("'"))


def recode(col: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, keep all others."""
    picked = reduce(
        lambda acc, pair: acc.when(col == F.lit(pair[0]), F.lit(pair[1])),
        mapping.items(),
        F,
    )
    return picked.otherwise(col)


def fill_when(col: Column, condition: Column, value: object) -> Column:
    """``value`` where the column is NULL and the condition holds."""
    return F.when(col.isNull() & condition, F.lit(value)).otherwise(col)


def round_binary(col: Column, digits: int) -> Column:
    """Rounding of the exact binary value, half to even, as float formatting does it.

    The product with a power of ten is taken with its rounding error, so a value
    just beside a rounding edge falls on its own side. For values below 2**26.
    """
    scale = float(10**digits)
    spread = col * F.lit(134217729.0)  # 2**27 + 1 halves the bits of a double
    high = spread - (spread - col)
    product = col * F.lit(scale)
    error = (high * F.lit(scale) - product) + (col - high) * F.lit(scale)
    floor = F.floor(product).cast("double")
    rest = product - floor
    up = (rest > 0.5) | (
        (rest == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(floor, F.lit(2.0)) == 1)))
    )
    return (floor + up.cast("int")) / F.lit(scale)


def round_to(col: Column, digits: int) -> Column:
    """Half-up rounding that does not depend on the order floats were added in.

    The value first becomes an exact decimal, so last-bit noise from a
    different partitioning cannot tip a value that lies on a rounding edge.
    """
    return F.round(col.cast("decimal(38,12)"), digits).cast("double")
