"""Content hashes over an explicit, order-stable text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(*cols: Column) -> Column:
    """Length-prefixed join of the values, so that no two inputs share a text form."""
    parts = []
    for c in cols:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("~")))
    return F.concat_ws("|", *parts)


def record_hash(*cols: Column) -> Column:
    return F.sha2(canonical(*cols), 256)
