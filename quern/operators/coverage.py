"""Classification counts, invariants, freshness and review samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(rows: DataFrame, value: str, known: list[str] | None = None) -> DataFrame:
    """``(value, n)``; with ``known`` every class has a row, 0 included."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    if known is None:
        return counts
    classes = rows.sparkSession.createDataFrame([(k,) for k in known], f"`{value}` string")
    return classes.join(counts, value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


def array_histogram(rows: DataFrame, values: str, name: str = "value") -> DataFrame:
    """How often each element occurs in the arrays."""
    return rows.select(F.explode(values).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def histogram_delta(base: DataFrame, target: DataFrame, value: str) -> DataFrame:
    """``(value, base_n, target_n, delta)`` per class of either side."""
    a, b = histogram(base, value).withColumnRenamed("n", "base_n"), histogram(target, value).withColumnRenamed("n", "target_n")
    return a.join(b, value, "full_outer").na.fill(0, ["base_n", "target_n"]).withColumn("delta", F.col("target_n") - F.col("base_n"))


def invariants(rows: DataFrame, **tests: Column) -> DataFrame:
    """``(invariant, violations)``: rows that break each test; a test that is null is broken."""
    counts = rows.agg(*[F.count_if(~F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("invariant"), F.col(n).alias("violations")) for n in tests])).alias("x")).select("x.*")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that several rows have, with their number."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def stale_reasons(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds ``stale``, the names of the fingerprints that differ between their two columns."""
    return rows.withColumn("stale", F.array_compact(F.array(*[F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(n)) for n, (a, b) in pairs.items()])))


def injectable(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Published rows all of whose fingerprints agree."""
    return stale_reasons(rows, pairs).filter((F.col("status") == "published") & (F.size("stale") == 0)).drop("stale")


def review_sample(rows: DataFrame, kind: str, key: str, attention: Column, each: int = 5) -> DataFrame:
    """All rows that need attention and the first ``each`` others of every kind."""
    mark = F.coalesce(attention, F.lit(False))
    w = Window.partitionBy(kind, mark).orderBy(key)
    return rows.withColumn("__n", F.row_number().over(w)).filter(mark | (F.col("__n") <= each)).drop("__n")


def progress(base: Column, done: Column) -> tuple[Column, Column]:
    """Pending count, never negative, and percent done to one place; null if there is nothing."""
    return F.greatest(base - done, F.lit(0)), F.bround(F.when(base > 0, 100.0 * F.least(done, base) / base), 1)


#: The names of the states of a translation.
STATES = {"unknown": "待确认", "running": "翻译中", "packed": "待反编译", "untouched": "未开始", "unextracted": "待提取", "finished": "已完成", "polish": "待润色", "open": "待翻译"}


def suggest_status(rows: DataFrame) -> Column:
    """Translation status that a project's counts suggest; the first rule that applies.

    Reads ``in_pipeline, status, status_source, active_batch, has_work,
    archives, scripts, translated_files, has_original, pending, percent``;
    those that ``rows`` lacks count as null.
    """
    have = lambda c, kind="boolean": F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    yes = lambda c: F.coalesce(have(c), F.lit(False))
    count = lambda c: F.coalesce(have(c, "long"), F.lit(0))
    state, given = {k: F.lit(v) for k, v in STATES.items()}, F.nullif(have("status", "string"), F.lit(""))
    percent = have("percent", "double")
    return (
        F.when(~F.coalesce(have("in_pipeline"), F.lit(True)), F.coalesce(given, state["unknown"]))
        .when((have("status_source", "string") == "manual") & given.isNotNull(), given)
        .when(yes("active_batch"), state["running"])
        .when(~yes("has_work"), F.when((count("archives") > 0) & (count("scripts") == 0), state["packed"]).otherwise(state["untouched"]))
        .when(count("translated_files") <= 0, F.when(yes("has_original"), state["unextracted"]).otherwise(state["untouched"]))
        .when(count("pending") <= 0, state["finished"])
        .when(percent >= 95, state["polish"])
        .when(percent <= 1, state["open"])
        .when(count("pending") >= 50, state["open"])
        .otherwise(state["polish"])
    )


def search(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows in which some column holds the text, case aside."""
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))
