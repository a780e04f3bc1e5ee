"""Running totals over a global order without a single task for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.lineage import cut, drop


def running_totals(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """``df`` with ``cum_<c>`` (inclusive, by ascending ``order`` within ``by``) and ``all_<c>`` for each column ``c``.

    Rows are dealt by range; sums of whole ranges are scanned first (a row per range), then each range for itself. A
    value of ``order`` occurs once within ``by``. Nulls in ``by`` form a group of their own.
    """
    if not columns:
        return df
    # Dealing by range reads its input twice, once to find the ranges, so it is written first.
    df = cut(df)
    dealt = cut(df.repartitionByRange(*[F.col(c) for c in (*by, order)]).withColumn("_range", F.spark_partition_id()))
    key = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in by]
    drop(df)
    dealt = dealt.withColumn("_key", F.concat_ws("\u0001", *key) if key else F.lit(""))
    ranges = dealt.groupBy("_key", "_range").agg(*(F.sum(c).alias(f"_s_{c}") for c in columns))
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    ranges = ranges.select("_key", "_range", *(F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in columns), *(F.sum(f"_s_{c}").over(whole).alias(f"all_{c}") for c in columns))
    inner = Window.partitionBy("_key", "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(ranges, ["_key", "_range"])
    for c in columns:
        out = out.withColumn(f"cum_{c}", F.col(f"_b_{c}") + F.sum(c).over(inner))
    return out.drop("_key", "_range", *(f"_b_{c}" for c in columns))
