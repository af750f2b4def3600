"""Joins that keep or place rows: semi, anti, as-of; sets and lists of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def having(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """The rows that ``other`` has a partner for, each once; null keys have none."""
    return rows.join(other.select(*on).distinct(), on, "left_semi")


def lacking(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """The rows that ``other`` has no partner for; null keys stay."""
    return rows.join(other.select(*on).distinct(), on, "left_anti")


def as_of(rows: DataFrame, other: DataFrame, by: list[str], at: str, take: list[str]) -> DataFrame:
    """Each row with the columns ``take`` of the last row of ``other`` at or before it, per key; null without one.

    One shuffle by key and one sort, no pairs. Of rows of ``other`` at the same
    time the one with the largest ``take`` counts. Rows without key or time get nulls.
    """
    mine = rows.withColumn("__row", F.struct(*rows.columns)).select(*by, F.col(at).alias("__at"), F.lit(1).alias("__side"), "__row", *[F.lit(None).cast(dict(other.dtypes)[c]).alias(f"__{c}") for c in take])
    theirs = other.groupBy(*by, F.col(at).alias("__at")).agg(F.max(F.struct(*take)).alias("__best")).filter(F.col("__at").isNotNull())
    theirs = theirs.select(*by, "__at", F.lit(0).alias("__side"), F.lit(None).cast(mine.schema["__row"].dataType).alias("__row"), *[F.col(f"__best.`{c}`").alias(f"__{c}") for c in take])
    last = Window.partitionBy(*by).orderBy(F.col("__at").asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    known = F.coalesce(*[F.col(c).isNotNull() for c in by]) if by else F.lit(True)
    met = F.last(F.when(F.col("__side") == 0, F.struct(*[F.col(f"__{c}").alias(c) for c in take])), ignorenulls=True).over(last)
    out = mine.unionByName(theirs).withColumn("__met", F.when(known & F.col("__at").isNotNull(), met)).filter("__side = 1")
    return out.select("__row.*", *[F.col(f"__met.`{c}`").alias(c) for c in take])


def common_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct ids that both sides have."""
    return a.select(key).filter(F.col(key).isNotNull()).intersect(b.select(key))


def other_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct ids of ``a`` that ``b`` lacks."""
    return a.select(key).filter(F.col(key).isNotNull()).subtract(b.select(key))


def merged_list(first: Column, second: Column) -> Column:
    """The first list, then what the second adds, each value once, in order; nulls go."""
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(first, F.array()), F.coalesce(second, F.array()))))
