"""Seeded draws that are a function of a seed and a row key only.

``md5`` of the joined key parts gives the same stream in any SQL engine and
does not depend on partitioning, task order or retries.  The key has to be
unique within the group being drawn from.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4294967296  # 2^32: eight hex digits


def _part(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(str(x))


def draw(*parts) -> Column:
    """Hex digest of the key parts; sorting by it is a random order."""
    return F.md5(F.concat_ws("|", *[_part(p) for p in parts]))


def draw_int(*parts) -> Column:
    """Integer in [0, 2^32)."""
    return F.conv(F.substring(draw(*parts), 1, 8), 16, 10).cast("bigint")


def draw_unit(*parts) -> Column:
    """Double in [0, 1)."""
    return draw_int(*parts) / F.lit(float(SPAN))


def draw_head(*parts) -> Column:
    """The leading key parts of draws that differ in the last one, joined once for all of them."""
    return F.concat_ws("|", *[_part(p) for p in parts], F.lit(""))


def draw_unit_after(head: Column, last: Column) -> Column:
    """``draw_unit`` of the parts of ``draw_head`` and one more."""
    return F.conv(F.substring(F.md5(F.concat(head, _part(last))), 1, 8), 16, 10).cast("bigint") / F.lit(float(SPAN))


def draw_index(n, *parts) -> Column:
    """Integer in [0, n)."""
    n = n.cast("bigint") if isinstance(n, Column) else F.lit(n).cast("bigint")
    return draw_int(*parts) % n


PRIME = 2147483647  # 2^31 - 1


def seeds(*parts) -> Column:
    """Three integers below ``PRIME``, the coefficients of an item's draws over many replicates."""
    h = draw(*parts)
    return F.transform(F.array(h), lambda x: F.array(*[F.conv(F.substring(x, at, 8), 16, 10).cast("bigint") % PRIME for at in (1, 9, 17)]))[0]


def replicate_draw(b: Column, rep: Column) -> Column:
    """Integer in [0, PRIME): a polynomial in the replicate, so draws of an item are independent in any three replicates."""
    r = rep.cast("bigint")
    return ((b[2] * r + b[1]) % PRIME * r + b[0]) % PRIME
