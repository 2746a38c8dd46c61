"""Numbers as SQL rounds them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, digits: int) -> Column:
    """A double rounded as the SQL does it: scaled, rounded half away from zero, scaled back. Spark's own ``round`` goes by the
    shortest decimal form of a double instead, so the two differ where a sum stands just beside a half."""
    scale = F.lit(10.0**digits)
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value * scale, 0) / scale


def rounded_float(value: float, digits: int) -> float:
    """The same for a Python float; ``round`` goes by the exact binary value and to even."""
    scaled = abs(float(value)) * 10.0**digits
    low = float(math.floor(scaled))
    return math.copysign(low + (scaled - low >= 0.5), value) / 10.0**digits
