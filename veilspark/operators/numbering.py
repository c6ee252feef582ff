"""Numbers in an order, without one task that holds them all.

Rows are dealt into ranges of the order by a sample of it, so a range has about as many rows as any other however they
are spread.  Each range is numbered apart; what comes before it is the sum of the counts of the ranges before, and there
are as many counts as ranges and groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept


def numbered(rows: DataFrame, order: list[str], by: str | None = None, name: str = "n") -> DataFrame:
    """rows with their number from 1, in an order that no two rows share, within each value of `by` if given."""
    group = [by] if by else []
    dealt = rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    dealt = kept(dealt)  # ranges come from a sample, so they are fixed before they are counted
    counts = dealt.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select(F.col("_part").alias("_earlier"), F.col("_c").alias("_of"), *[F.col(c).alias("_by") for c in group])
    same: Column = F.col("_earlier") < F.col("_part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col("_by"))
    counts = counts.join(F.broadcast(before), same, "left").groupBy("_part", *group).agg(F.coalesce(F.sum("_of"), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    at = F.col("r._part") == F.col("c._part")
    for c in group:
        at &= F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}"))
    out = dealt.withColumn("_own", own).alias("r").join(F.broadcast(counts).alias("c"), at)
    return out.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("r._own") + F.col("c._before")).alias(name))
