"""Reports in one scan, and sketches that add up.

Several histograms and roll-ups come from one pass by grouping sets. Sketches
are kept per window: distinct values as HyperLogLog, quantiles as counts of
logarithmic buckets; both merge, so that a report over any span of windows
reads sketches only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histograms(rows: DataFrame, sets: list[list[str]], **totals: Column) -> DataFrame:
    """``(report, keys..., totals...)``: one group-by for each list of columns, all in one scan.

    ``report`` joins the set's columns by commas; keys outside of a set are
    null. An empty list is the total.
    """
    keys = sorted({c for s in sets for c in s})
    name = F.lit(None).cast("string")
    for s in sets:
        here = F.lit(True)
        for c in keys:
            here = here & (F.grouping(c) == int(c not in s))
        name = F.when(here, F.lit(",".join(s))).otherwise(name)
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in keys])
    return grouped.agg(name.alias("report"), *[v.alias(k) for k, v in totals.items()]).select("report", *keys, *totals)


def failures(rows: DataFrame, group: str, reason: str, example: str) -> DataFrame:
    """``(group, reason, n, share, first)``: failures by group and reason, their share of all failures, and the least example; one scan."""
    sets = histograms(rows.filter(F.col(reason).isNotNull()), [[group, reason], []], n=F.count("*"), first=F.min(example))
    # The report's own rows, one for each group and reason, meet in one window.
    total = F.max(F.when(F.col("report") == "", F.col("n"))).over(Window.partitionBy(F.lit(1)))
    out = sets.withColumn("share", F.col("n") / total)
    return out.filter("report <> ''").select(group, reason, "n", "share", "first")


#: Relative error of quantiles: a bucket is twice as wide, and some.
ACCURACY = 0.01
#: Bits of the HyperLogLog registers' index; the standard error is 1.04 / sqrt(2 ^ bits).
HLL_BITS = 12


def bucket(x: Column, accuracy: float = ACCURACY) -> Column:
    """The logarithmic bucket of a number; 0 for zero, signs apart, null for null and NaN."""
    step = math.log((1 + accuracy) / (1 - accuracy))
    place = F.ceil(F.log(F.abs(x)) / step).cast("long") + F.lit(1 << 20)
    return F.when(x == 0, F.lit(0).cast("long")).when(~F.isnan(x), F.when(x > 0, place).otherwise(-place))


def bucket_value(b: Column, accuracy: float = ACCURACY) -> Column:
    """The number that stands for a bucket: within ``accuracy`` of all in it."""
    ratio = (1 + accuracy) / (1 - accuracy)
    size = F.pow(F.lit(ratio), F.abs(b) - F.lit(1 << 20)) * (2 / (1 + ratio))
    return F.when(b == 0, F.lit(0.0)).when(b > 0, size).otherwise(-size)


def distinct_sketch(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``(by..., n, sketch)``: a HyperLogLog sketch of each group's values."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.hll_sketch_agg(value, F.lit(HLL_BITS)).alias("sketch"))


def merge_distinct(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., n, n_distinct)`` from stored sketches: equal to a sketch of all rows."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(False))).alias("n_distinct"))


def quantile_sketch(rows: DataFrame, by: list[str], value: str, accuracy: float = ACCURACY) -> DataFrame:
    """``(by..., bucket, n)``: counts of logarithmic buckets; sketches of parts add up to that of the whole."""
    return rows.withColumn("bucket", bucket(F.col(value).cast("double"), accuracy)).filter("bucket IS NOT NULL").groupBy(*by, "bucket").agg(F.count("*").alias("n"))


def merge_quantiles(sketches: DataFrame, by: list[str], quantiles: list[float], accuracy: float = ACCURACY) -> DataFrame:
    """``(by..., n, q0, q1, ...)``: the values of the given ranks, each within ``accuracy`` of a true one.

    A group has some two thousand buckets at most for a factor of 10^17
    between its numbers.
    """
    merged = sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    listed = merged.groupBy(*by).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("bucket", F.col("n").alias("m")))).alias("b"))

    def at(q: float) -> Column:
        rank = F.floor(F.lit(q) * (F.col("n") - 1))
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("found"))
        done = F.aggregate("b", start, lambda s, x: F.struct((s["seen"] + x["m"]).alias("seen"), F.coalesce(s["found"], F.when(s["seen"] + x["m"] > rank, x["bucket"])).alias("found")))
        return bucket_value(done["found"], accuracy)

    return listed.select(*by, "n", *[at(q).alias(f"q{i}") for i, q in enumerate(quantiles)])
