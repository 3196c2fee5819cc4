"""Column profiles and what they say about join keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.names import JOIN_KEY, quoted, visible


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(position, column, dtype, row_count, null_count, null_pct, n_unique), a row a column.

    One pass over narrow rows: every row becomes pairs of a position and a value's 128-bit hash, which are counted
    before the shuffle, so that no value is shuffled. ``approximate`` keeps a sketch a column instead.
    """
    names = visible(df)
    dtypes = dict(df.dtypes)
    known = df.sparkSession.createDataFrame([(i, n, dtypes[n]) for i, n in enumerate(names)], "position int, column string, dtype string")
    if not names:
        return known.selectExpr("*", "0L row_count", "0L null_count", "0D null_pct", "0L n_unique")
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), *_hashes(F.col(quoted(n)).cast("string"))) for i, n in enumerate(names)])).alias("p")).select("p.*")
    if approximate:
        counted = pairs.groupBy("position").agg(
            F.count("*").alias("row_count"), F.count_if(F.col("h1").isNull()).alias("null_count"), (F.approx_count_distinct("h1") + F.max(F.col("h1").isNull().cast("int"))).alias("n_unique")
        )
    else:
        by_value = pairs.groupBy("position", "h1", "h2").agg(F.count("*").alias("n"))
        counted = by_value.groupBy("position").agg(
            F.sum("n").alias("row_count"), F.sum(F.when(F.col("h1").isNull(), F.col("n")).otherwise(0)).alias("null_count"), F.count("*").alias("n_unique")
        )
    zero = F.lit(0).cast("long")
    filled = known.join(counted, "position", "left").select("position", "column", "dtype", *[F.coalesce(c, zero).cast("long").alias(c) for c in ("row_count", "null_count", "n_unique")])
    pct = F.when(F.col("row_count") > 0, F.round(F.col("null_count") * 100.0 / F.col("row_count"), 2)).otherwise(0.0)
    return filled.select("position", "column", "dtype", "row_count", "null_count", pct.alias("null_pct"), "n_unique")


def _hashes(value: Column) -> list[Column]:
    """Two independent halves of a hash; null for null."""
    return [F.when(value.isNotNull(), h).alias(name) for name, h in (("h1", F.xxhash64(value)), ("h2", F.xxhash64(F.lit(7), value)))]


def join_key_candidates(profile: DataFrame) -> DataFrame:
    """(column, rank): 0 named like a key, 1 nearly unique and named like an id, 2 unique; by rank, then name."""
    named = F.regexp_replace(F.trim("column"), " ", "_").rlike(f"(?i){JOIN_KEY.pattern}")
    ratio = F.col("n_unique") / F.col("row_count")
    several = F.col("n_unique") > 1
    rank = F.when(named, 0).when((ratio >= 0.95) & several, 2).when((ratio >= 0.85) & several & F.lower("column").contains("id"), 1)
    ranked = profile.filter("row_count > 0").withColumn("rank", rank)
    return ranked.filter(F.col("rank").isNotNull() & (F.col("null_count") * 100.0 / F.col("row_count") <= 50)).select("column", "rank")


def head(df: DataFrame, n: int = 20) -> DataFrame:
    """The first rows, in the order of ``_row_id`` if there is one."""
    return (df.orderBy("_row_id") if "_row_id" in df.columns else df).limit(n)
