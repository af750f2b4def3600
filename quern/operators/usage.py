"""Usage records: normalising, de-duplicating, filtering, grouping, costs.

Unknown is not zero: counters stay null until something is known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Group keys that reports use, by the names that callers may give.
ALIASES = {"task": "task_mode", "stage": "stage", "provider": "provider", "model": "model", "run": "run_id", "execution": "execution_mode", "thinking": "thinking_level"}
#: Filters on these ignore case.
CASELESS = ("provider", "task_mode", "stage", "execution_mode")


#: Where providers' answers have each counter, the first that is there counts.
COUNTERS = {
    "prompt_tokens": ("promptTokenCount", "prompt_token_count", "prompt_tokens", "input_tokens", "inputTokenCount"),
    "completion_tokens": ("candidatesTokenCount", "candidates_token_count", "completion_tokens", "output_tokens", "outputTokenCount"),
    "reasoning_tokens": ("thoughtsTokenCount", "thoughts_token_count", "thoughts_tokens", "reasoning_tokens", "completion_tokens_details.reasoning_tokens", "output_tokens_details.reasoning_tokens"),
    "text_output_tokens": ("candidatesTokenCount", "candidates_token_count", "text_output_tokens", "output_text_tokens", "completion_tokens_details.text_tokens", "output_tokens_details.text_tokens"),
    "cached_tokens": ("cachedContentTokenCount", "cached_content_token_count", "cached_tokens", "cache_read_input_tokens", "prompt_tokens_details.cached_tokens", "input_tokens_details.cached_tokens"),
    "total_tokens": ("totalTokenCount", "total_token_count", "total_tokens"),
}
#: Counters that leave thoughts out; reasons why an answer ended too early; where answers have their cost.
WITHOUT_THOUGHTS = ("candidatesTokenCount", "candidates_token_count")
TRUNCATED = ("MAX_TOKENS", "MAX_TOKEN", "LENGTH", "TOKEN_LIMIT", "OUTPUT_TOKEN_LIMIT")
COSTS = ("actual_cost", "total_cost", "response_cost", "cost")


def counter(payload: Column, *paths: str) -> Column:
    """The first of the JSON paths that is a number of 0 or more, cut to a whole one; true and false are not numbers."""
    tries = [F.get_json_object(payload, p) for p in paths]
    return F.coalesce(*[F.when(t.rlike(r"^\s*\+?\d+(\.\d*)?\s*$"), F.floor(F.trim(t).cast("decimal(38,6)")).cast("long")) for t in tries])


def normalise(raw: DataFrame, payload: str = "provider_usage") -> DataFrame:
    """Adds token counters out of a provider's JSON, whichever names it uses, with ``billable_output_tokens`` and ``total_tokens_derived``.

    Visible text is never computed from other counters, as providers disagree
    on whether completion includes reasoning. A total is, from prompt and
    completion, with the thoughts where completion leaves them out.
    """
    p = F.col(payload)
    out = raw.withColumns({name: counter(p, *[f"$.{x}" for x in paths]) for name, paths in COUNTERS.items()})
    apart = F.when(F.coalesce(*[F.get_json_object(p, f"$.{x}") for x in WITHOUT_THOUGHTS]).isNotNull(), F.coalesce("reasoning_tokens", F.lit(0))).otherwise(0)
    spoken = F.col("completion_tokens") + apart
    out = out.withColumn("total_tokens_derived", F.col("total_tokens").isNull() & F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull())
    out = out.withColumn("total_tokens", F.coalesce("total_tokens", F.col("prompt_tokens") + spoken))
    return out.withColumn("billable_output_tokens", F.coalesce(F.when(F.col("total_tokens") >= F.col("prompt_tokens"), F.col("total_tokens") - F.col("prompt_tokens")).when(F.col("total_tokens") < F.col("prompt_tokens"), 0), spoken))


def budget_diagnostics(rows: DataFrame, text: str = "response_text", finish: str = "finish_reason", limit: str = "max_output_tokens") -> DataFrame:
    """Adds why an answer has no text or ends early, to rows of ``normalise``.

    ``empty_text, truncated, budget_exhausted, reasoning_ratio,
    reasoning_budget_pressure, reason_code``; the code is empty where nothing
    is wrong. A limit of 0 or less is none.
    """
    most = F.when(F.col(limit) > 0, F.col(limit))
    used, reasoning = F.col("billable_output_tokens"), F.col("reasoning_tokens")
    out = rows.withColumns(
        {
            "empty_text": F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")) == "",
            "truncated": F.upper(F.trim(F.coalesce(finish, F.lit("")))).isin(*TRUNCATED),
            "budget_exhausted": F.coalesce(used >= most, F.lit(False)),
            "reasoning_ratio": F.when(used > 0, reasoning / used),
        }
    )
    silent = F.col("empty_text") & F.coalesce(reasoning > 0, F.lit(False)) & (F.coalesce("text_output_tokens", F.lit(0)) == 0)
    spent = F.col("budget_exhausted") | F.col("truncated")
    pressure = F.when(silent, spent).when(F.col("truncated"), F.coalesce(F.col("reasoning_ratio") >= 0.5, F.lit(False))).otherwise(False)
    code = F.when(silent & spent, "reasoning_budget_exhausted").when(silent, "reasoning_without_text_output").when(F.col("truncated"), "truncated_output").when(F.col("empty_text"), "empty_response_text").otherwise("")
    return out.withColumns({"reasoning_budget_pressure": pressure, "reason_code": code})


def actual_cost(usage: Column, response: Column) -> Column:
    """``(cost, currency, source)`` that a provider states, in the usage or beside the answer; nulls without one."""
    number = lambda c: F.when(c.rlike(r"^\s*\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), c.try_cast("double"))
    named = lambda j, *names: F.coalesce(*[F.nullif(F.trim(F.get_json_object(j, f"$.{n}")), F.lit("")) for n in names])
    kinds = [F.struct(number(F.get_json_object(usage, f"$.{k}")).alias("cost"), named(usage, "cost_currency", "currency").alias("currency"), F.lit(f"usage.{k}").alias("source")) for k in COSTS]
    kinds.append(F.struct(number(F.get_json_object(response, "$._hidden_params.response_cost")).alias("cost"), F.coalesce(named(response, "_hidden_params.response_cost_currency", "_hidden_params.currency"), F.lit("USD")).alias("currency"), F.lit("_hidden_params.response_cost").alias("source")))
    return F.get(F.filter(F.array(*kinds), lambda k: k["cost"].isNotNull()), F.lit(0))


def dedupe_key(*parts: Column) -> Column:
    """Digest of the parts, null and empty told apart."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def insert_new(ledger: DataFrame, batch: DataFrame, key: str = "dedupe_key", order: str = "ordinal") -> DataFrame:
    """The rows of ``batch`` that the ledger lacks, the first of each key."""
    fresh = batch.join(ledger.select(key).distinct(), key, "left_anti")
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return fresh.withColumn("__place", place).filter("__place = 1").drop("__place")


def usage_filter(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality on the named fields; provider, task, stage and execution ignore case."""
    for name, value in wanted.items():
        if value is not None:
            c = ALIASES.get(name, name)
            rows = rows.filter(F.lower(c) == value.lower() if c in CASELESS else F.col(c) == value)
    return rows


def _key(c: str) -> Column:
    return F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0"), F.lit("unknown")).otherwise(F.col(c).cast("string"))


def usage_report(rows: DataFrame, by: tuple[str, ...] = ("task", "stage", "provider", "model"), counters: tuple[str, ...] = ("prompt_tokens", "completion_tokens", "total_tokens")) -> DataFrame:
    """One row per group: calls, null-aware sums with known and unknown counts, and the reasoning share.

    Empty keys are ``unknown``. The reasoning share uses only rows that know
    both parts, and is null where their sum is 0.
    """
    keys = [_key(ALIASES.get(k, k)).alias(ALIASES.get(k, k)) for k in by]
    aggs = [F.count("*").alias("calls")]
    for c in counters:
        aggs += [F.sum(c).alias(c), F.count(c).alias(f"{c}_known"), (F.count("*") - F.count(c)).alias(f"{c}_unknown")]
    if {"reasoning_tokens", "text_output_tokens"} <= set(rows.columns):
        both = F.col("reasoning_tokens").isNotNull() & F.col("text_output_tokens").isNotNull()
        thought, spoken = F.sum(F.when(both, F.col("reasoning_tokens"))), F.sum(F.when(both, F.col("text_output_tokens")))
        aggs.append((thought / F.nullif(thought + spoken, F.lit(0))).alias("reasoning_share"))
    names = [ALIASES.get(k, k) for k in by]
    return rows.groupBy(*keys).agg(*aggs).orderBy(*names)


def cost_by_currency(rows: DataFrame, by: list[str], cost: str, currency: str) -> DataFrame:
    """``costs``, a map of currency to its sum rounded to 8 places, with ``known`` and ``unknown`` counts.

    A cost below zero, NaN or infinite is unknown.
    """
    given = F.col(cost).cast("double")
    rows = rows.withColumn(cost, F.when((given >= 0) & (given < float("inf")), F.col(cost)))
    one = rows.groupBy(*by, currency).agg(F.sum(cost).alias("__sum"), F.count(cost).alias("__known"), F.count("*").alias("__all"))
    pairs = F.sort_array(F.collect_list(F.when(F.col("__sum").isNotNull(), F.struct(F.coalesce(currency, F.lit("unknown")), F.bround("__sum", 8)))))
    return one.groupBy(*by).agg(F.map_from_entries(pairs).alias("costs"), F.sum("__known").alias("known"), (F.sum("__all") - F.sum("__known")).alias("unknown"))


def condition_counts(rows: DataFrame, by: list[str], **tests: Column) -> DataFrame:
    """How many rows of each group meet each test."""
    return rows.groupBy(*by).agg(*[F.count_if(t).alias(name) for name, t in tests.items()])


def latest_run(rows: DataFrame, run: str = "run_id", at: str = "recorded_at", order: str = "ordinal") -> DataFrame:
    """All rows of the run that holds the latest record; of equal times the first row counts."""
    last = rows.filter(F.col(run).isNotNull()).orderBy(F.col(at).desc(), order).limit(1).select(run)
    return rows.join(F.broadcast(last), run, "left_semi")  # one row


def journal_state(events: DataFrame, attempt: str = "attempt_id", event: str = "event", order: str = "ordinal") -> DataFrame:
    """State of the latest attempt in a submit journal: which steps it has, and what is uncertain."""
    named = events.filter(F.coalesce(F.col(attempt), F.lit("")) != "")
    last = named.orderBy(F.col(order).desc()).limit(1).select(attempt)
    rows = named.join(F.broadcast(last), attempt, "left_semi").groupBy(attempt)
    has = {s: F.max((F.col(event) == s).cast("int")) == 1 for s in ("begin", "uploaded", "job_created", "committed")}
    out = rows.agg(*[F.coalesce(x, F.lit(False)).alias(s) for s, x in has.items()])
    state = F.when(F.col("committed"), "committed").when(F.col("job_created"), "created_uncommitted").when(F.col("uploaded"), "uploaded_without_job").otherwise("begun")
    return out.withColumn("state", state)


def all_of(tests: list[Column]) -> Column:
    """Conjunction; nothing to test is true."""
    return reduce(lambda a, b: a & b, tests, F.lit(True))
