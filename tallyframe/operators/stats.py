"""Exact statistics that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.names import quoted
from tallyframe.functions.ordering import placed

#: Rows up to which the built-in median, which gathers all distinct values in one task, does.
ONE_TASK_ROWS = 2_000_000


def _median(df: DataFrame, column: str) -> DataFrame:
    """One row (value): distinct values with their counts are sorted over all partitions, the middle is where half the counts lie before."""
    counted = df.select(F.col(quoted(column)).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    rows = placed(counted, "v")
    sums = rows.groupBy("_part").agg(F.sum("n").alias("_sum"))  # a row a partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    total = F.broadcast(sums.agg(F.sum("_sum").alias("_total")))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_to", F.sum("n").over(inside)).join(F.broadcast(before), "_part").crossJoin(total)
    last = F.col("_before") + F.col("_to")
    first = last - F.col("n")
    half = lambda k: (first <= k) & (k < last)
    low, high = F.expr("(_total - 1) div 2"), F.expr("_total div 2")
    return ranked.agg(((F.max(F.when(half(low), F.col("v"))) + F.max(F.when(half(high), F.col("v")))) / 2).alias("value"))


def medians(df: DataFrame, columns: list[str], names: list[str], one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """One row of the columns' medians, called ``names``; exact at any size."""
    if df.count() <= one_task_rows:
        return df.agg(*[F.median(F.col(quoted(c)).cast("double")).alias(n) for c, n in zip(columns, names, strict=True)])
    out = None
    for c, n in zip(columns, names, strict=True):
        one = _median(df, c).withColumnRenamed("value", n)
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def mode(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row: the most frequent value, the smallest of equals, null if there is none."""
    counted = df.select(F.col(quoted(column)).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), "v").limit(1).agg(F.max("v").alias(name))


def value_counts(df: DataFrame, columns: list[str], most: int) -> dict[str, int]:
    """Distinct values of each column, null being one of them; exact up to ``most``, columns of more are left out.

    Sketches (no shuffle of values) put most columns of many values aside, the rest is counted exactly.
    """
    if not columns:
        return {}
    about = df.agg(*[F.approx_count_distinct(F.col(quoted(c)), 0.05).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    few = [c for c, n in zip(columns, about, strict=True) if n <= 2 * most + 10]
    if not few:
        return {}
    exact = df.agg(*[(F.count_distinct(F.col(quoted(c))) + F.coalesce(F.max(F.col(quoted(c)).isNull().cast("int")), F.lit(0))).alias(f"n{i}") for i, c in enumerate(few)]).first()
    return {c: n for c, n in zip(few, exact, strict=True) if n <= most}
