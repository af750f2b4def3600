"""Queries on reports in one scan, stored sketches and revision corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import reports as P
from quern.sources import snapshots as S

from .book import query


@query(
    "report_one_scan",
    """SELECT CASE WHEN GROUPING(event_type) = 0 AND GROUPING(hour) = 0 THEN 'event_type,hour' WHEN GROUPING(event_type) = 0 THEN 'event_type' WHEN GROUPING(hour) = 0 THEN 'hour' WHEN GROUPING(heavy) = 0 THEN 'heavy' ELSE '' END AS report, event_type, heavy, hour, COUNT(*) AS n, CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
       FROM (SELECT event_type, CAST(hour(ts) AS VARCHAR) AS hour, value > 50 AS heavy, value FROM events) GROUP BY GROUPING SETS ((event_type, hour), (event_type), (hour), (heavy), ())""",
)
def report_one_scan(t):
    """Five histograms of the events at once."""
    rows = t("events").select("event_type", F.hour("ts").cast("string").alias("hour"), (F.col("value") > 50).alias("heavy"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return P.histograms(rows, [["event_type", "hour"], ["event_type"], ["hour"], ["heavy"], []], n=F.count("*"), cents=F.sum("cents"))


@query(
    "failure_groups",
    """WITH f AS (SELECT user_id % 10 AS team, CASE WHEN value < 5 THEN 'small' WHEN value > 80 THEN 'large' WHEN value IS NULL THEN 'none' END AS reason, event_id FROM events WHERE event_type IN ('error', 'click'))
       SELECT team, reason, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER () AS share, MIN(event_id) AS first FROM f WHERE reason IS NOT NULL GROUP BY 1, 2""",
)
def failure_groups(t):
    """Failures by team and reason, with the first of each."""
    v = F.col("value")
    rows = t("events").filter("event_type IN ('error', 'click')").select((F.col("user_id") % 10).alias("team"), F.when(v < 5, "small").when(v > 80, "large").when(v.isNull(), "none").alias("reason"), "event_id")
    return P.failures(rows, "team", "reason", "event_id")


def _windows(t):
    return t("events").select("event_type", F.window("ts", "1 hour")["start"].alias("hour"), "user_id", "value")


@query("sketch_distinct", "SELECT event_type, COUNT(user_id) AS n, true AS is_near FROM events GROUP BY 1")
def sketch_distinct(t):
    """Users of each type from hourly sketches; near is within five standard errors of the exact number."""
    hourly = P.distinct_sketch(_windows(t), ["event_type", "hour"], "user_id")
    exact = t("events").groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 5 * 1.04 / 2 ** (P.HLL_BITS / 2) * F.col("exact") + 1
    return P.merge_distinct(hourly, ["event_type"]).join(exact, "event_type").select("event_type", "n", near.alias("is_near"))


_STEP = "ln(1.01 / 0.99)"


@query(
    "sketch_quantiles",
    f"""WITH v AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
        q AS (SELECT event_type, n, max(CASE WHEN i = floor(0.5 * (n - 1)) THEN x END) AS a, max(CASE WHEN i = floor(0.9 * (n - 1)) THEN x END) AS b, max(CASE WHEN i = floor(0.99 * (n - 1)) THEN x END) AS c FROM v GROUP BY 1, 2)
        SELECT event_type, n, CASE WHEN a = 0 THEN 0 ELSE pow(1.01 / 0.99, ceil(ln(a) / {_STEP})) * 0.99 END AS q0, CASE WHEN b = 0 THEN 0 ELSE pow(1.01 / 0.99, ceil(ln(b) / {_STEP})) * 0.99 END AS q1, CASE WHEN c = 0 THEN 0 ELSE pow(1.01 / 0.99, ceil(ln(c) / {_STEP})) * 0.99 END AS q2 FROM q""",
)
def sketch_quantiles(t):
    """Median and high quantiles of the values of each type, from hourly sketches."""
    hourly = P.quantile_sketch(_windows(t), ["event_type", "hour"], "value")
    return P.merge_quantiles(hourly, ["event_type"], [0.5, 0.9, 0.99])


_ITEMS = """i AS (SELECT conv_id % 20 AS path, conv_id * 100 + turn AS position, conv_id || ':' || turn AS identity, text AS source, CASE WHEN turn % 2 = 0 THEN reverse(text) END AS translation, CAST(turn AS VARCHAR) AS line, CASE WHEN turn % 5 = 1 THEN 'n' || turn WHEN turn % 5 = 2 THEN '' ELSE ' ' || turn END AS start FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)"""


def _items(t):
    d = t("conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    turn = F.col("turn").cast("string")
    k = F.col("turn") % 5
    return d.select(
        (F.col("conv_id") % 20).alias("path"), (F.col("conv_id") * 100 + F.col("turn")).alias("position"), F.concat_ws(":", "conv_id", "turn").alias("identity"), F.col("text").alias("source"), F.when(F.col("turn") % 2 == 0, F.reverse("text")).alias("translation"), F.col("role").alias("speaker"),
        turn.alias("line"), F.when(k == 1, F.concat(F.lit("n"), turn)).when(k == 2, "").otherwise(F.concat(F.lit(" "), turn)).alias("start"), F.lit(None).cast("string").alias("end"), turn.alias("line_number"),
    )


@query(
    "revision_items",
    f"""WITH {_ITEMS} SELECT path, row_number() OVER w AS ordinal, identity, CAST(line AS BIGINT) AS line, CASE WHEN position % 100 % 5 IN (1, 2) THEN 0 ELSE CAST(trim(start) AS BIGINT) END AS start, coalesce(translation, '') AS translation, coalesce(lag(coalesce(translation, '')) OVER w, '-') AS before, coalesce(lead(coalesce(source, '')) OVER w, '-') AS after
        FROM i WINDOW w AS (PARTITION BY path ORDER BY position)""",
)
def revision_items(t):
    """Revision items with their neighbours; what is no number is 0."""
    rows = S.revision_corpus(_items(t))[0]
    return rows.select("path", "ordinal", "identity", "line", "start", "translation", F.coalesce("previous.translation", F.lit("-")).alias("before"), F.coalesce("next.source", F.lit("-")).alias("after"))


@query("revision_rejects", f"WITH {_ITEMS} SELECT identity, 'start' AS field, start AS value, 'LOCATOR_NON_NUMERIC' AS code FROM i WHERE starts_with(start, 'n')")
def revision_rejects(t):
    """Locators that are no numbers."""
    return S.revision_corpus(_items(t))[1]
