"""Running sums in the order of values, without putting all rows into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridtide.plans.keys import key_of
from gridtide.session import cut


def running_sums(df: DataFrame, by: Sequence[Column], sums: Mapping[str, Column],
                 keys: Sequence[str] = ()) -> DataFrame:
    """Add inclusive running sums over the order `by` within `keys`; a NULL key is a key like others.

    Rows are spread by ranges of (keys, by), which splits a hot key too; the number of ranges is given,
    so that adaptive execution doesn't merge them. The ranges are drawn from a sample, so the spread rows
    are written out once before they are used twice: for the sums inside a range, and for the totals of
    the ranges before it, a table of one row per key and range.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_key", key_of(keys))
    spread = cut(keyed.repartitionByRange(ranges, "_key", *by).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_key", "_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    rows = spread.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    totals = spread.groupBy("_key", "_part").agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_key", "_part", *(F.sum(f"_sum_{n}").over(earlier).alias(f"_carry_{n}") for n in sums))
    joined = rows.join(carried, ["_key", "_part"], "left")
    out = joined.withColumns({n: F.col(n) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0)) for n in sums})
    return out.drop("_key", "_part", *(f"_carry_{n}" for n in sums))
