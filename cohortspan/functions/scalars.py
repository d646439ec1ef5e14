"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """Text to DOUBLE; anything that is not a number becomes null instead of raising."""
    return F.trim(text).try_cast("double")


def is_number_list(text: Column) -> Column:
    """True where a cell holds only digits, points and blanks, such as ``"0.0 0.01 5"``."""
    return text.rlike(r"^[0-9. ]+$")


def plus_zero(value: Column) -> Column:
    """Turn -0.0 into 0.0 so that it prints without a sign."""
    return value + F.lit(0.0)


def two_decimals(value: Column) -> Column:
    """``%.2f`` as C prints it: the binary value is rounded, halves to even.

    ``format_string`` rounds the shortest decimal form half up, which differs on values such as
    0.125 or -0.005. Those are found first; the sign of the exact difference between 1000 times
    the value and the whole number it stands for then decides. The product is split into exact
    parts (Dekker) because a rounded one would hide that difference.
    """
    thousand = F.lit(1000.0)
    whole = F.rint(value * thousand)
    tie = (value == whole / thousand) & (F.abs(whole) % 10 == 5)
    spread = value * F.lit(134217729.0)
    high = spread - (spread - value)
    low = value - high
    product = value * thousand
    excess = (product - whole) + ((high * thousand - product) + low * thousand)
    outward = excess * F.signum(value)
    under = F.floor((F.abs(whole) - 5) / 10)
    cents = F.when(outward > 0, under + 1).when(outward < 0, under).otherwise(under + under % 2)
    text = F.format_string(
        "%s%d.%02d",
        F.when(value < 0, F.lit("-")).otherwise(F.lit("")),
        F.floor(cents / 100),
        cents % 100,
    )
    return F.when(tie, text).otherwise(F.format_string("%.2f", value))


def arm_label(active: Column, control: Column) -> Column:
    """``"active - control"``; null when either part is null."""
    return F.concat(active, F.lit(" - "), control)

