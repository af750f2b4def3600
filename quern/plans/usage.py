"""Queries on ``events`` as usage records and on ``part`` as a price table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import cost, usage
from quern.streaming import ledger

from .book import query

#: Every tenth counter is unknown.
_K = "CASE WHEN CAST(props->>'$.k' AS BIGINT) % 10 = 0 THEN NULL ELSE CAST(props->>'$.k' AS BIGINT) END"
_RUN = "CAST(user_id AS VARCHAR)"


def records(t):
    k = usage.counter(F.col("props"), "$.k")
    return t("events").select(
        "event_id", F.col("event_type").alias("task_mode"), F.col("user_id").cast("string").alias("run_id"), F.col("ts").alias("recorded_at"), "value",
        F.when(F.col("user_id") % 3 == 0, "").when(F.col("user_id") % 3 == 1, "Alpha").otherwise("beta").alias("provider"),
        F.when(k % 10 != 0, k).alias("prompt_tokens"), F.when(k % 4 != 0, k * 2).alias("reasoning_tokens"), F.when(k % 6 != 0, k * 3).alias("text_output_tokens"),
    )


_R = f"""(SELECT event_id, event_type AS task_mode, {_RUN} AS run_id, ts AS recorded_at, value, CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Alpha' ELSE 'beta' END AS provider,
          {_K} AS prompt_tokens, CASE WHEN k % 4 <> 0 THEN k * 2 END AS reasoning_tokens, CASE WHEN k % 6 <> 0 THEN k * 3 END AS text_output_tokens FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events))"""


@query(
    "usage_report",
    f"""SELECT task_mode, CASE WHEN provider = '' THEN 'unknown' ELSE provider END AS provider, COUNT(*) AS calls, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens, COUNT(prompt_tokens) AS prompt_tokens_known,
          COUNT(*) - COUNT(prompt_tokens) AS prompt_tokens_unknown,
          ROUND(SUM(CASE WHEN reasoning_tokens IS NOT NULL AND text_output_tokens IS NOT NULL THEN reasoning_tokens END) / SUM(CASE WHEN reasoning_tokens IS NOT NULL AND text_output_tokens IS NOT NULL THEN reasoning_tokens + text_output_tokens END), 9) AS reasoning_share
        FROM {_R} GROUP BY 1, 2""",
)
def usage_report(t):
    """Calls, known sums and reasoning share by task and provider."""
    out = usage.usage_report(records(t), ("task", "provider"), ("prompt_tokens",))
    return out.withColumn("reasoning_share", F.round("reasoning_share", 9))


@query("usage_filter", f"SELECT event_id FROM {_R} WHERE lower(provider) = 'alpha' AND lower(task_mode) = 'click'")
def usage_filter(t):
    """Filters that ignore case."""
    return usage.usage_filter(records(t), provider="ALPHA", task="Click").select("event_id")


@query(
    "usage_dedupe_insert",
    """WITH e AS (SELECT event_id, event_type || '|' || CAST(user_id AS VARCHAR) AS k FROM events), l AS (SELECT DISTINCT k FROM e WHERE event_id % 5 = 0)
       SELECT k AS dedupe_key, MIN(event_id) AS event_id FROM e WHERE k NOT IN (SELECT k FROM l) GROUP BY k""",
)
def usage_dedupe_insert(t):
    """New keys of a batch, the first of each."""
    e = t("events").select("event_id", F.concat_ws("|", "event_type", "user_id").alias("dedupe_key"), F.col("event_id").alias("ordinal"))
    return usage.insert_new(e.filter("event_id % 5 = 0"), e).select("dedupe_key", "event_id")


@query(
    "usage_cost_by_currency",
    """SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, ROUND(SUM(CASE WHEN event_id % 7 <> 0 THEN value END), 4) AS cost FROM events GROUP BY 1, 2""",
)
def usage_cost_by_currency(t):
    """Known costs of each currency, out of the map."""
    e = t("events").select("event_type", F.when(F.col("user_id") % 2 == 0, "EUR").otherwise("USD").alias("currency"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("cost"))
    rows = usage.cost_by_currency(e, ["event_type"], "cost", "currency")
    return rows.select("event_type", F.explode("costs").alias("currency", "cost")).withColumn("cost", F.round("cost", 4))


@query("usage_conditions", f"SELECT task_mode, COUNT(*) FILTER (WHERE prompt_tokens IS NULL) AS unknown, COUNT(*) FILTER (WHERE value > 50) AS large, COUNT(*) FILTER (WHERE provider = '') AS unnamed FROM {_R} GROUP BY 1")
def usage_conditions(t):
    """Conditional counts."""
    return usage.condition_counts(records(t), ["task_mode"], unknown=F.col("prompt_tokens").isNull(), large=F.col("value") > 50, unnamed=F.col("provider") == "")


@query("usage_latest_run", "SELECT event_id, user_id FROM events WHERE user_id = (SELECT user_id FROM events ORDER BY ts DESC, event_id LIMIT 1)")
def usage_latest_run(t):
    """All records of the run that holds the latest."""
    return usage.latest_run(t("events"), "user_id", "ts", "event_id").select("event_id", "user_id")


@query(
    "price_longest_prefix",
    """WITH p AS (SELECT * FROM (VALUES ('Brand#', 1.0), ('Brand#2', 2.0), ('Brand#25', 3.0), ('Brand#31', 4.0)) v(prefix, rate))
       SELECT p_brand, COUNT(*) AS n, MAX(prefix) AS prefix, ROUND(SUM(p_size * rate) / 1000000, 8) AS cost FROM (
         SELECT p_brand, p_size, prefix, rate, ROW_NUMBER() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS r FROM part JOIN p ON starts_with(p_brand, prefix)) WHERE r = 1 GROUP BY 1""",
)
def price_longest_prefix(t):
    """Rates of the longest price entry that a brand starts with."""
    part = t("part")
    prices = part.sparkSession.createDataFrame([("Brand#", 1.0, 0.0), ("Brand#2", 2.0, 0.0), ("Brand#25", 3.0, 0.0), ("Brand#31", 4.0, 0.0)], "prefix string, input_rate double, output_rate double")
    rows = cost.price_for(part.select("p_brand", "p_size"), prices, "p_brand")
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("prefix").alias("prefix"), F.round(F.sum(F.col("p_size") * F.col("input_rate")) / 1_000_000, 8).alias("cost"))


@query(
    "cost_estimate",
    """SELECT event_id, CASE WHEN pt IS NULL THEN NULL ELSE ROUND((pt * 0.75 + coalesce(ot, 0) * 0.0) / 1000000, 8) END AS cost FROM (SELECT event_id, CASE WHEN CAST(props->>'$.k' AS BIGINT) % 10 = 0 THEN NULL ELSE CAST(props->>'$.k' AS BIGINT) END AS pt, CASE WHEN event_id % 2 = 0 THEN 5 END AS ot FROM events)""",
)
def cost_estimate(t):
    """Cost of known counts; unknown counts with a rate have none."""
    r = records(t)
    return r.select("event_id", F.round(cost.estimate(F.col("prompt_tokens"), F.when(F.col("event_id") % 2 == 0, 5), F.lit(0.75), F.lit(0.0)), 8).alias("cost"))


@query("text_volume", "SELECT source, CAST(SUM(length(text)) AS BIGINT) AS chars, CAST(floor(SUM(length(text)) / 4.0 + 0.999999) AS BIGINT) AS tokens FROM documents GROUP BY source")
def text_volume(t):
    """Characters and estimated tokens of each source's texts."""
    d = t("documents").select("source", F.split("text", "\n").alias("parts"), "text")
    return cost.text_volume(d.withColumn("parts", F.array("text")), ["source"], "parts")


@query(
    "json_last_wins",
    "SELECT user_id, k FROM (SELECT user_id, CAST(props->>'$.k' AS BIGINT) AS k, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
)
def json_last_wins(t):
    """The last record of each key, out of JSON."""
    rows = t("events").select("user_id", "event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return rows.groupBy("user_id").agg(F.max_by("k", "event_id").alias("k"))


@query(
    "ext_usage_rollup",
    "SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS side, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY ROLLUP (1, 2)",
)
def ext_usage_rollup(t):
    """Totals and subtotals."""
    return t("events").withColumn("side", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")).rollup("event_type", "side").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("ext_hourly_totals", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, COUNT(*) AS calls, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_hourly_totals(t):
    """Tumbling windows of an hour, as the stream computes them."""
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ledger.windowed_totals(e, ["event_type"], "ts", "value")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "calls", F.round("total", 4).alias("total"))


@query(
    "ext_sessions",
    """SELECT user_id, s AS session, COUNT(*) AS n FROM (SELECT user_id, SUM(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY 1, 2""",
)
def ext_sessions(t):
    """Sessions six hours apart, numbered per user."""
    from pyspark.sql import Window

    out = ledger.sessions(t("events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "6 hours")
    return out.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("start")).cast("long").alias("session"), "n")


# -- answers of four kinds of providers, built from the events

_ANSWERS = r"""WITH e AS (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_id % 4 AS f FROM events),
    n AS (SELECT *, CASE WHEN f < 3 THEN k END AS prompt_tokens, CASE f WHEN 0 THEN k + 1 WHEN 1 THEN 2 * k ELSE k END AS completion_tokens, CASE f WHEN 0 THEN k % 7 WHEN 1 THEN k % 5 END AS reasoning_tokens,
      CASE f WHEN 0 THEN k + 1 WHEN 1 THEN k END AS text_output_tokens, CASE f WHEN 0 THEN 2 * k + 1 + k % 7 WHEN 1 THEN 3 * k WHEN 2 THEN 2 * k + 3 END AS total_tokens, f < 2 AS total_tokens_derived,
      CASE f WHEN 0 THEN k + 1 + k % 7 WHEN 1 THEN 2 * k WHEN 2 THEN k + 3 ELSE k END AS billable_output_tokens FROM e)"""


def _answers(t):
    k, f = F.regexp_extract("props", "([0-9]+)", 1), F.col("event_id") % 4
    n = k.cast("long")
    payload = (
        F.when(f == 0, F.format_string('{"promptTokenCount": %d, "candidatesTokenCount": %d, "thoughtsTokenCount": %d}', n, n + 1, n % 7))
        .when(f == 1, F.format_string('{"prompt_tokens": "%d", "completion_tokens": %d, "completion_tokens_details": {"reasoning_tokens": %d, "text_tokens": %d}}', n, 2 * n, n % 5, n))
        .when(f == 2, F.format_string('{"input_tokens": %d, "output_tokens": %d, "total_tokens": %d, "total_cost": -1, "cost": 0.%d, "currency": " EUR "}', n, n, 2 * n + 3, n))
        .otherwise(F.format_string('{"outputTokenCount": %d, "reasoning_tokens": true, "prompt_tokens": -1}', n))
    )
    rows = t("events").select("event_id", payload.alias("provider_usage"), F.when(F.col("event_id") % 3 == 0, " \n").otherwise("text").alias("response_text"), F.when(F.col("event_id") % 5 == 0, "length").otherwise("stop").alias("finish_reason"), F.lit(60).alias("max_output_tokens"))
    return usage.normalise(rows)


_COUNTS = ("prompt_tokens", "completion_tokens", "reasoning_tokens", "text_output_tokens", "total_tokens", "total_tokens_derived", "billable_output_tokens")


@query("usage_normalised", f"{_ANSWERS} SELECT event_id, {', '.join(_COUNTS)} FROM n")
def usage_normalised(t):
    """Counters out of four kinds of answers."""
    return _answers(t).select("event_id", *_COUNTS)


@query(
    "usage_budget_diagnostics",
    f"""{_ANSWERS}, d AS (SELECT *, event_id % 3 = 0 AS empty, event_id % 5 = 0 AS cut, billable_output_tokens >= 60 AS spent, event_id % 3 = 0 AND coalesce(reasoning_tokens, 0) > 0 AND coalesce(text_output_tokens, 0) = 0 AS silent FROM n)
        SELECT event_id, empty AS empty_text, cut AS truncated, spent AS budget_exhausted, CASE WHEN silent THEN spent OR cut WHEN cut THEN coalesce(reasoning_tokens / nullif(CAST(billable_output_tokens AS DOUBLE), 0) >= 0.5, false) ELSE false END AS reasoning_budget_pressure,
          CASE WHEN silent THEN CASE WHEN spent OR cut THEN 'reasoning_budget_exhausted' ELSE 'reasoning_without_text_output' END WHEN cut THEN 'truncated_output' WHEN empty THEN 'empty_response_text' ELSE '' END AS reason_code FROM d""",
)
def usage_budget_diagnostics(t):
    """Why answers are empty or cut."""
    return usage.budget_diagnostics(_answers(t)).select("event_id", "empty_text", "truncated", "budget_exhausted", "reasoning_budget_pressure", "reason_code")


@query("usage_actual_cost", r"""SELECT event_id, CAST('0.' || regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS cost, 'EUR' AS currency, 'usage.cost' AS source FROM events WHERE event_id % 4 = 2
    UNION ALL SELECT event_id, CAST(event_id AS DOUBLE) / 8, 'USD', '_hidden_params.response_cost' FROM events WHERE event_id % 4 = 3""")
def usage_actual_cost(t):
    """Costs that providers state."""
    beside = F.when(F.col("event_id") % 4 == 3, F.format_string('{"_hidden_params": {"response_cost": %s}}', (F.col("event_id") / 8).cast("string")))
    return _answers(t).select("event_id", usage.actual_cost(F.col("provider_usage"), beside).alias("c")).select("event_id", "c.cost", "c.currency", "c.source").filter("cost IS NOT NULL")
