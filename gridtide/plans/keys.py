"""Several key columns as one value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_of(keys: Sequence[str]) -> Column:
    """All key columns as one struct, which is never NULL itself and in which NULL equals NULL."""
    return F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("all"))
