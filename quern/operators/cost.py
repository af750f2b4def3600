"""Token and cost estimates with longest-prefix prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import token_estimate

#: Different lengths of prefixes that a price table may have; more are refused.
MAX_LENGTHS = 1_000


def price_for(rows: DataFrame, prices: DataFrame, name: str, prefix: str = "prefix", keep: tuple[str, ...] = ("input_rate", "output_rate")) -> DataFrame:
    """Adds the rates of the longest price entry that ``name`` starts with; null without one.

    The candidates of a name are its own prefixes of the lengths that the
    table has, so the join is on equality and the table may be of any size.
    """
    lengths = [r[0] for r in prices.select(F.length(prefix)).distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"prefixes of more than {MAX_LENGTHS} lengths")
    names = rows.select(name).filter(F.col(name).isNotNull()).distinct()
    tries = F.filter(F.array(*[F.when(F.length(name) >= n, F.substring(name, 1, n)) for n in sorted(lengths) if n]), lambda x: x.isNotNull()) if any(lengths) else F.array().cast("array<string>")
    found = names.withColumn(prefix, F.explode(tries)).join(prices, prefix)
    best = found.groupBy(name).agg(F.max_by(F.struct(prefix, *keep), F.length(prefix)).alias("__best"))
    out = rows.join(best, name, "left")
    return out.select(*rows.columns, *[F.col("__best")[c].alias(c) for c in (prefix, *keep)])


def estimate(prompt: Column, output: Column, input_rate: Column, output_rate: Column) -> Column:
    """Cost of known counts at rates per million; null without a rate or with a rate whose count is unknown."""
    rate_in, rate_out = F.coalesce(input_rate, F.lit(0.0)), F.coalesce(output_rate, F.lit(0.0))
    known = ((rate_in == 0) | (prompt >= 0)) & ((rate_out == 0) | (output >= 0)) & ((rate_in != 0) | (rate_out != 0))
    sum_ = F.greatest(F.coalesce(prompt, F.lit(0)), F.lit(0)) * rate_in + F.greatest(F.coalesce(output, F.lit(0)), F.lit(0)) * rate_out
    return F.when(known, F.bround(sum_ / 1_000_000, 8))


def text_volume(rows: DataFrame, by: list[str], parts: str) -> DataFrame:
    """Characters and estimated tokens of an array of text parts, per group."""
    flat = rows.select(*by, F.explode_outer(parts).alias("part"))
    out = flat.groupBy(*by).agg(F.coalesce(F.sum(F.length("part")), F.lit(0)).alias("chars"))
    return out.withColumn("tokens", token_estimate(F.col("chars")))


def over_budget(rows: DataFrame, estimate_col: str, most: float) -> DataFrame:
    """Rows whose estimate is above the limit."""
    return rows.filter(F.col(estimate_col) > most)
