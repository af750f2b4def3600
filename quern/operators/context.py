"""Windows over ordered units: context, segments, runs, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context_window(rows: DataFrame, by: list[str], order: list[str], text: str, before: int = 1, after: int = 1, name: str = "context") -> DataFrame:
    """Adds the texts around each row in its file, joined by line breaks."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-before, after)
    return rows.withColumn(name, F.array_join(F.collect_list(text).over(w), "\n"))


def neighbours(rows: DataFrame, by: list[str], order: list[str], text: str) -> DataFrame:
    """Adds ``previous`` and ``next`` text and the 1-based ``ordinal`` in the file."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumns({"previous": F.lag(text).over(w), "next": F.lead(text).over(w), "ordinal": F.row_number().over(w)})


def runs(rows: DataFrame, by: list[str], order: list[str], value: str, name: str = "run") -> DataFrame:
    """Numbers runs of consecutive equal values, from 0; a value that comes back starts a new run."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(~F.lag(value).over(w).eqNullSafe(F.col(value)), 1).otherwise(0)
    first = F.row_number().over(w) == 1
    return rows.withColumn("__new", F.when(first, 0).otherwise(new)).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def local_context(rows: DataFrame, by: list[str], order: list[str], block: str, text: str, before: int = 30, after: int = 10) -> DataFrame:
    """Adds context inside a block run: ``before`` and ``after`` arrays and flags that more was there."""
    marked = runs(rows, by, order, block, "__run")
    w = Window.partitionBy(*by, "__run").orderBy(*order)
    place, total = F.row_number().over(w), F.count("*").over(Window.partitionBy(*by, "__run"))
    out = marked.withColumns(
        {
            "before": F.collect_list(text).over(w.rowsBetween(-before, -1)),
            "after": F.collect_list(text).over(w.rowsBetween(1, after)),
            "before_cut": place - 1 > before,
            "after_cut": total - place > after,
        }
    )
    return out.drop("__run")


def segments(rows: DataFrame, by: list[str], order: list[str], size: int, name: str = "segment") -> DataFrame:
    """Numbers groups of ``size`` rows in each file, from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def block_occurrences(rows: DataFrame, by: list[str], order: list[str], block: str, name: str = "occurrence") -> DataFrame:
    """Numbers, from 1, which run of its block name in the file a row is in."""
    marked = runs(rows, by, order, block, "__run")
    return marked.withColumn(name, F.dense_rank().over(Window.partitionBy(*by, block).orderBy("__run"))).drop("__run")


def greedy_batches(rows: DataFrame, by: list[str], order: list[str], chars: str, max_items: int = 40, max_chars: int = 12_000) -> DataFrame:
    """Adds ``batch``: it closes when full, or when the next item would bring it over ``max_chars``.

    A batch takes one item at least. The state is two numbers, so that files
    stream through in order, each in the task that has it.
    """
    out = rows.repartition(*by).sortWithinPartitions(*by, *order) if by else rows.coalesce(1).sortWithinPartitions(*order)
    columns = rows.columns

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, batch, items, used = None, 0, 0, 0
        for f in frames:
            keys = list(f[by].itertuples(index=False, name=None)) if by else [()] * len(f)
            numbers = []
            for key, n in zip(keys, f[chars].fillna(0).tolist(), strict=True):
                if key != at:
                    at, batch, items, used = key, 0, 0, 0
                elif items and (items >= max_items or used + n > max_chars):
                    batch, items, used = batch + 1, 0, 0
                items, used = items + 1, used + n
                numbers.append(batch)
            yield f[columns].assign(batch=numbers)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return out.mapInPandas(go, f"{schema}, batch long")


def fit_lines(lines: Column, budget: int) -> Column:
    """Lines that fit a character budget, in order: one too long is passed over, the very first is cut instead.

    ``lines`` is a short array (the hits of one prompt).
    """
    none = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("long").alias("used"))

    def add(state: Column, line: Column) -> Column:
        cost = F.length(line) + F.when(F.size(state["kept"]) > 0, 1).otherwise(0)
        room = state["used"] + cost <= budget
        first = F.size(state["kept"]) == 0
        taken = F.when(room, line).when(first, F.substring(line, 1, budget))
        return F.when(taken.isNotNull(), F.struct(F.array_append(state["kept"], taken).alias("kept"), (state["used"] + F.least(cost, F.lit(budget))).cast("long").alias("used"))).otherwise(state)

    return F.aggregate(lines, none, add, lambda s: s["kept"])


def even_sample(rows: DataFrame, order: list[str], n: int, by: list[str] | None = None) -> DataFrame:
    """``n`` rows of each group at even distances, ends included; for 1 the middle one."""
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)
    whole = Window.partitionBy(*(by or [F.lit(1)]))
    at, last = F.col("__at"), F.col("__n") - 1
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * last / F.lit(max(n - 1, 1))))
    chosen = (F.col("__n") <= n) | (F.array_contains(spots, at) if n > 1 else at == F.floor(F.col("__n") / 2))
    return rows.withColumn("__at", (F.row_number().over(w) - 1).cast("long")).withColumn("__n", F.count("*").over(whole)).filter(chosen).drop("__at", "__n")
