"""Byte widths, big-endian numbers and the size model of the packed index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_needed(value: Column) -> Column:
    """Bytes of an unsigned number, 1 to 8; null of null."""
    out = F.lit(8)
    for n in range(7, 0, -1):
        out = F.when(value < F.lit(1 << (8 * n)), F.lit(n)).otherwise(out)
    return F.when(value < 0, F.lit(8)).when(value.isNotNull(), out)


def put_be(value: Column, width: Column) -> Column:
    """The number in ``width`` bytes, most significant first."""
    return F.unhex(F.lpad(F.right(F.hex(value), 2 * width), 2 * width, F.lit("0")))


def get_be(raw: Column) -> Column:
    return F.conv(F.hex(raw), 16, 10).cast("long")


def marker(offset: Column, off_num: Column, off_add: Column, rest: Column, rest_num: Column) -> Column:
    """Header byte of an entry: has offset | width of its count | of its add | has rest | width of its count."""
    width = lambda present, v: F.when(present, bytes_needed(v) - 1).otherwise(0)
    return (
        F.when(offset, 0x80).otherwise(0)
        + F.shiftleft(width(offset, off_num), 5)
        + F.shiftleft(width(offset, off_add), 3)
        + F.when(rest, 0x04).otherwise(0)
        + width(rest, rest_num)
    ).cast("int")


def breakeven_coverage(pb: Column, max_add: int, limit: int = 64) -> Column:
    """Least coverage whose saved positions outweigh the bytes of an offset entry; ``limit`` if none up to it does.

    With no position width (pb <= 0) it is the default floor of 3.
    """
    pays = lambda num: pb * (num - 1) - bytes_needed(F.lit(max_add)) - bytes_needed(num) > 0
    least = F.array_min(F.filter(F.sequence(F.lit(1), F.lit(limit)), pays))
    return F.when(pb <= 0, F.lit(3)).otherwise(F.coalesce(least, F.lit(limit))).cast("int")


def estimated_width(n: Column) -> Column:
    """Position width for a text of n letters, as the size model estimates it (from n - 1)."""
    return bytes_needed(F.greatest(n - 1, F.lit(0)))


def elias_fano_bits(n: Column, universe: Column) -> Column:
    """Model size of n ascending starts below ``universe``: n * (2 + floor(log2(universe / n))) bits."""
    low = F.floor(F.log2(universe / n)).cast("long")
    return F.when((n <= 0) | (universe <= 0), F.lit(0).cast("long")).otherwise(n * (2 + F.greatest(low, F.lit(0).cast("long"))))
