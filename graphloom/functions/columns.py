"""Column expressions that partitioning, programs and readers share; all stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schema of edges.
EDGE = "src long, dst long"
#: Fixed value: low word of the hash multiplier; ids are unsigned 32-bit, so the high word drops out.
HASH_FACTOR = 444_984_403
#: Fixed value: stands for an unreachable vertex in the compatible form of distances.
UNREACHED = 268_435_455


def bucket_hash(id: Column) -> Column:
    """((id * factor) modulo 2 ** 32) >> 1, on longs."""
    low = id.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftrightunsigned((low * F.lit(HASH_FACTOR)).bitwiseAND(F.lit(0xFFFFFFFF)), 1)


def range_owner(id: Column, vertices: Column, n: int) -> Column:
    """floor(id / ceil(vertices / n)) modulo n."""
    return F.pmod(F.floor(id / F.ceil(vertices / F.lit(n))), F.lit(n)).cast("int")


#: A prime of 31 bits: draws are whole numbers below it.
PRIME = 2_147_483_647


def draw(*values: Column) -> Column:
    """A whole number from 0 to PRIME - 1 that looks random and follows from the values alone, in arithmetic that any SQL has."""
    h = F.lit(1).cast("long")
    for v in values:
        h = F.pmod(h * 48_271 + F.pmod(v.cast("long"), F.lit(PRIME)), F.lit(PRIME))
    for _ in range(2):
        h = F.pmod(h * (F.pmod(h, F.lit(46_337)) + 1) + 12_345, F.lit(PRIME))
    return h


def edge_parts(line: Column, sep: str) -> tuple[Column, Column]:
    """The two ids of a line such as 3,17."""
    part = F.split(line, "\\Q" + sep + "\\E", 3)
    return F.get(part, 0).try_cast("long"), F.get(part, 1).try_cast("long")


#: Combiners of messages by name; partial aggregation runs them before the shuffle.
combiners: dict[str, Callable[[Column], Column]] = {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg, "or": F.bool_or}
