"""Keys as bytes in the order of what they stand for, and their bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_key(c: Column, width: int = 8) -> Column:
    """A non-negative whole number as `width` big-endian bytes: bytewise order is numeric order."""
    return F.unhex(F.lpad(F.hex(c.cast("long")), 2 * width, "0"))


def signed_key(c: Column) -> Column:
    """Any long as eight bytes in numeric order (the sign bit is turned)."""
    return F.unhex(F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def text_key(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def fixed_key(c: Column, width: int) -> Column:
    """Keys padded with zero bytes to a fixed width; a longer key is an error, a shorter one meets its padded twin."""
    padded = F.unhex(F.rpad(F.hex(c), 2 * width, "0"))
    return F.when(F.octet_length(c) <= width, padded).otherwise(F.raise_error(F.lit(f"a key has more than {width} bytes")))


def check_bounds(low, high) -> None:
    """Both ends belong to a range; reversed ends are an error."""
    if low > high:
        raise ValueError(f"the lower bound {low!r} lies above the upper bound {high!r}")
