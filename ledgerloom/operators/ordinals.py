"""Running sums and numbering that split large groups.

A plain ``sum() over (partition by key order by pos)`` sorts a whole key in one task. Here each
key is cut into position ranges; a range is summed in its own task and then shifted by the totals
of the ranges before it, of which there are a few thousand times fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_BITS = 12


def running_sum(
    df: DataFrame, keys: list[str], position: str, value: Column, out: str, range_bits: int = RANGE_BITS
) -> DataFrame:
    """Inclusive running sum of ``value`` per ``keys`` in ``position`` order (unique bigint)."""
    split = df.withColumn("__range", F.shiftright(F.col(position).cast("bigint"), range_bits)).withColumn("__v", value)
    split = split.repartition(*keys, "__range")
    inner = Window.partitionBy(*keys, "__range").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        split.groupBy(*keys, "__range")
        .agg(F.sum("__v").alias("__t"))
        .withColumn("__shift", F.coalesce(F.sum("__t").over(before), F.lit(0)))
        .filter("__range <> 0 and __shift <> 0")
        .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"), "__shift")
    )
    within = split.withColumn("__s", F.sum("__v").over(inner))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__range") == F.col("__r")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return within.join(shift, cond, "left").select(
        *df.columns, (F.col("__s") + F.coalesce(F.col("__shift"), F.lit(0))).alias(out)
    )


def numbered(df: DataFrame, keys: list[str], position: str, out: str, range_bits: int = RANGE_BITS) -> DataFrame:
    """1-based row number per ``keys`` in ``position`` order (unique bigint)."""
    return running_sum(df, keys, position, F.lit(1).cast("bigint"), out, range_bits)
