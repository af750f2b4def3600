"""Expected against returned rows, completeness, status roll-ups, merges of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_ids(expected: DataFrame, returned: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, n, problem)``: ids that are missing, unknown or duplicate; problem is null where all is well."""
    got = returned.groupBy(*key).agg(F.count("*").alias("n"))
    want = expected.select(*key).distinct().withColumn("want", F.lit(True))
    both = want.join(got, key, "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return both.select(*key, F.coalesce("n", F.lit(0)).alias("n"), problem.alias("problem"))


def completeness(expected: DataFrame, returned: DataFrame, by: list[str], key: str, valid: Column) -> DataFrame:
    """``(*by, expected, valid, ratio)``: distinct valid answers over what was expected, 1 if nothing was."""
    ok = returned.filter(valid).select(*by, key).distinct().withColumn("ok", F.lit(1))
    out = expected.select(*by, key).distinct().join(ok, [*by, key], "left").groupBy(*by).agg(F.count(key).alias("expected"), F.count("ok").alias("valid"))
    return out.withColumn("ratio", F.coalesce(F.col("valid") / F.nullif("expected", F.lit(0)), F.lit(1.0)))


def fill_from(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Left rows with their values where they have one, else the right side's; ``filled`` counts them."""
    r = right.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = left.join(r, key, "left")
    n = sum((F.col(c).isNull() & F.col(f"__{c}").isNotNull()).cast("int") for c in columns)
    return out.withColumn("filled", n).withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def regroup(items: DataFrame, expected: DataFrame, group: str, key: str, order: str) -> DataFrame:
    """``(group, n, missing, items)``: items of each chunk in order, and how many of the expected are not there."""
    n = expected.groupBy(group).agg(F.countDistinct(key).alias("want"))
    have = items.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(key).alias("d"), F.array_sort(F.collect_list(F.struct(order, key))).alias("rows"))
    out = n.join(have, group, "left")
    return out.select(group, F.coalesce("n", F.lit(0)).alias("n"), (F.col("want") - F.coalesce("d", F.lit(0))).alias("missing"), F.transform("rows", lambda r: r[key]).alias("items"))


def merge_fields(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed merge in which incoming values that are neither null nor empty win."""
    cols = [c for c in old.columns if c != key]
    both = old.alias("o").join(new.alias("n"), key, "full_outer")
    pick = lambda c: F.coalesce(F.when(F.col(f"n.{c}").cast("string") != "", F.col(f"n.{c}")), F.col(f"o.{c}")).alias(c)
    return both.select(key, *[pick(c) for c in cols])


def replace_partition(store: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """The store with all rows of the fresh rows' keys replaced by them."""
    return store.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)


def roll_up(rows: DataFrame, by: list[str], status: str, priority: tuple[tuple[tuple[str, ...], str], ...], otherwise: str) -> DataFrame:
    """One status per group: the first of the priority list of which some row has one."""
    seen = rows.groupBy(*by).agg(F.collect_set(status).alias("__s"))
    out = F.lit(otherwise)
    for members, name in reversed(priority):
        out = F.when(F.arrays_overlap("__s", F.array(*map(F.lit, members))), name).otherwise(out)
    return seen.select(*by, out.alias("status"))


CAMPAIGN = ((("running",), "running"), (("failed",), "failed"), (("stale",), "stale"), (("pending",), "partial"))
ANALYSIS = ((("failed",), "failed"), (("stale",), "stale"), (("review_required",), "review_required"))


def unique_names(rows: DataFrame, base: str, order: str, name: str = "name") -> DataFrame:
    """Adds a name that is the base, then base_2, base_3 and so on in order."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn("__n", n).withColumn(name, F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat_ws("_", base, F.col("__n").cast("string")))).drop("__n")


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def wide(rows: DataFrame, key: str, variant: str, value: str, variants: list[str]) -> DataFrame:
    """One row per item, one column per variant; of rows that repeat the largest value."""
    return rows.groupBy(key).pivot(variant, variants).agg(F.max(value))
