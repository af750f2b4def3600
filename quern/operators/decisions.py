"""Reviewers' decisions on candidates: an ordered log, its state machine, and what follows from the states.

A candidate is decided once: the first acceptance or rejection that its own
columns allow. So the machine needs no fold: that decision is a minimum over
the log, every other entry is judged by its place before or behind it, and
what an override replaces is the nearest applied one above it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a log may ask for.
ACTIONS = ("accept", "reject", "override_translation", "split_lineage", "merge_lineage")


def _first_of(tests: list[tuple[Column, str]]) -> Column:
    """The name of the first test that holds, else null."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), name) for test, name in tests])


def audit_trail(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """One row per log entry, in order: what it did, or why it was refused.

    ``candidates`` has ``candidate_id, target_id, options, ambiguous,
    translation, base_source`` and ``option_sources`` (those of ``options``, in
    order); ``options`` are the targets that an ambiguous one may resolve to.
    ``log`` has ``candidate_id, ordinal, action, reviewer, reviewer_type,
    target_id, text, lineage_id, related`` (an array), ordinals unique within a
    candidate. Refused entries change nothing.

    Returns ``(candidate_id, ordinal, action, reviewer, problem,
    previous_status, status, resolved, previous_text, text, lineage_id,
    related)``; ``problem`` is null where the entry took effect.
    """
    known = candidates.select("candidate_id", F.col("target_id").alias("own"), "options", "option_sources", "ambiguous", "translation", "base_source", F.lit(True).alias("known"))
    rows = log.join(known, "candidate_id", "left")
    told = F.nullif(F.trim("target_id"), F.lit(""))
    at = F.array_position("options", told)
    same_source = F.get("option_sources", (at - 1).cast("int")).eqNullSafe(F.col("base_source"))
    accept, reject, override = (F.col("action") == a for a in ACTIONS[:3])
    split, merge = (F.col("action") == a for a in ACTIONS[3:])
    related = F.array_sort(F.array_distinct(F.coalesce("related", F.array().cast("array<string>"))))
    fixed = _first_of(
        [
            (F.col("known").isNull(), "unknown_candidate"),
            (~F.coalesce(F.col("action"), F.lit("")).isin(*ACTIONS), "unknown_action"),
            ((accept | override) & F.col("translation").isNull(), "no_record"),
            (accept & F.col("ambiguous") & ~F.col("reviewer_type").eqNullSafe("human"), "needs_human"),
            (accept & F.col("ambiguous") & ~(F.coalesce(at, F.lit(0)) > 0), "not_an_option"),
            (accept & F.col("ambiguous") & ~same_source, "source_differs"),
            (accept & ~F.col("ambiguous") & told.isNotNull() & ~told.eqNullSafe(F.col("own")), "other_target"),
            (override & (F.trim(F.coalesce("text", F.lit(""))) == ""), "empty_text"),
            ((split | merge) & (F.trim(F.coalesce("lineage_id", F.lit(""))) == ""), "no_lineage"),
            (merge & (F.size(related) == 0), "nothing_to_merge"),
            (split & (F.size(related) > 0), "split_with_relations"),
        ]
    )
    rows = rows.withColumn("fixed", fixed).withColumn("resolved", F.when(F.col("ambiguous"), told).otherwise(F.col("own"))).withColumn("related", related)
    # The one decision that counts; it is small, one row for each candidate at most.
    decisive = rows.filter(F.col("fixed").isNull() & (accept | reject)).groupBy("candidate_id").agg(F.min(F.struct("ordinal", "action")).alias("first"))
    rows = rows.join(decisive, "candidate_id", "left")
    verdict = F.when(F.col("first.action") == "accept", "accepted").otherwise("rejected")
    before = F.when(F.col("first.ordinal") < F.col("ordinal"), verdict).otherwise("pending")
    after = F.when(F.col("first.ordinal") <= F.col("ordinal"), verdict).otherwise("pending")
    late = _first_of([((accept | reject) & (before != "pending"), "not_pending"), (override & (before == "rejected"), "rejected_before")])
    rows = rows.withColumn("problem", F.coalesce("fixed", late)).withColumn("previous_status", before).withColumn("status", after)
    applied = F.when(override & F.col("problem").isNull(), F.col("text"))
    above = F.last(applied, ignorenulls=True).over(Window.partitionBy("candidate_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    old = F.when(applied.isNotNull(), F.coalesce(above, "translation"))
    return rows.select("candidate_id", "ordinal", "action", "reviewer", "problem", F.when(F.col("known"), F.col("previous_status")).alias("previous_status"), F.when(F.col("known"), F.col("status")).alias("status"), F.when(accept & F.col("problem").isNull(), F.col("resolved")).alias("resolved"), old.alias("previous_text"), applied.alias("text"), "lineage_id", "related")


def states(candidates: DataFrame, trail: DataFrame) -> DataFrame:
    """``candidates`` with ``status, resolved, final, reviewer, last_reviewer, n_applied, n_refused`` after the log.

    ``final`` is the text of the last override, else the record's; ``reviewer``
    decided, ``last_reviewer`` wrote the text in force: an override's reviewer
    keeps it, whether the acceptance comes before or after. Of accepted
    candidates with one target the one decided first keeps it (``target_taken``
    marks the others).
    """
    ok = F.col("problem").isNull()
    decides, override = ok & F.col("action").isin("accept", "reject"), ok & (F.col("action") == "override_translation")
    done = trail.groupBy("candidate_id").agg(
        F.max(F.when(decides, F.struct("ordinal", "action", "reviewer", "resolved"))).alias("d"),
        F.max(F.when(override, F.struct("ordinal", "text", "reviewer"))).alias("o"),
        F.count_if(ok).alias("n_applied"), F.count_if(~ok).alias("n_refused"),
    )
    rows = candidates.join(done, "candidate_id", "left")
    status = F.when(F.col("d.action") == "accept", "accepted").when(F.col("d.action") == "reject", "rejected").otherwise("pending")
    rows = rows.withColumns({"status": status, "resolved": F.col("d.resolved"), "decided": F.col("d.ordinal"), "final": F.coalesce("o.text", "translation"), "reviewer": F.col("d.reviewer"), "last_reviewer": F.coalesce("o.reviewer", "d.reviewer")})
    taken = rows.filter(F.col("resolved").isNotNull()).groupBy("resolved").agg(F.min(F.struct("decided", "candidate_id")).alias("keeps"))
    rows = rows.join(taken, "resolved", "left").withColumn("target_taken", F.coalesce(F.col("keeps.candidate_id") != F.col("candidate_id"), F.lit(False)))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_applied", "n_refused")}
    return rows.withColumns(zero).select(*candidates.columns, "status", "resolved", "final", "reviewer", "last_reviewer", "n_applied", "n_refused", "target_taken")


def prefill(decided: DataFrame, targets: DataFrame) -> DataFrame:
    """``(candidate_id, resolved, final, gate)``: which accepted texts may go into their targets.

    ``targets`` has ``target_id, source, translation``. ``gate`` is null where
    the text may be filled in, else ``not_accepted``, ``target_taken``,
    ``target_gone``, ``source_differs`` or ``already_translated``.
    """
    rows = decided.join(targets.select(F.col("target_id").alias("resolved"), F.col("source").alias("__source"), F.col("translation").alias("__done"), F.lit(True).alias("__there")), "resolved", "left")
    gate = _first_of(
        [
            (F.col("status") != "accepted", "not_accepted"),
            (F.col("target_taken"), "target_taken"),
            (F.col("__there").isNull(), "target_gone"),
            (~F.col("__source").eqNullSafe(F.col("base_source")), "source_differs"),
            (F.trim(F.coalesce("__done", F.lit(""))) != "", "already_translated"),
        ]
    )
    return rows.select("candidate_id", "resolved", "final", gate.alias("gate"))


def revise(old: DataFrame, new: DataFrame, key: str = "record_id") -> DataFrame:
    """``new`` records with ``history``: what ``old`` records of the same key said, if text or origin changed.

    ``old`` has ``translation, origin, history`` (structs ``origin,
    translation, digest, superseded_by``), ``new`` ``translation, origin``.
    Texts are compared without white space at their ends. No time is stored, so
    that equal input gives equal history.
    """
    flat = lambda c: F.trim(F.coalesce(c, F.lit("")))
    before = old.select(key, F.col("translation").alias("__text"), F.col("origin").alias("__origin"), F.col("history").alias("__history"))
    rows = new.join(before, key, "left")
    digest = F.sha2(F.to_json(F.struct(F.col(key), F.col("__text"), F.col("__origin"))).cast("binary"), 256)
    entry = F.struct(F.col("__origin").alias("origin"), F.col("__text").alias("translation"), digest.alias("digest"), F.col("origin").alias("superseded_by"))
    kept = F.coalesce("__history", F.array().cast(f"array<struct<origin:{_type(old, 'origin')},translation:string,digest:string,superseded_by:{_type(new, 'origin')}>>"))
    changed = F.col("__origin").isNotNull() & ((flat(F.col("__text")) != flat(F.col("translation"))) | (flat(F.col("__origin")) != flat(F.col("origin"))))
    return rows.withColumn("history", F.when(changed, F.concat(kept, F.array(entry))).otherwise(kept)).drop("__text", "__origin", "__history")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


#: States from the weakest to the strongest; a unit only moves to the right.
STATES = ("pending", "running", "failed", "done")


def merge_results(units: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units after a batch of results, and the results that did not count, with ``problem``.

    ``units`` has ``unit_id, status, digest, payload``, ids unique; ``results``
    has ``unit_id, status, digest, payload``. A result counts if its unit is
    there and has its digest (``unknown_unit``, ``stale_digest``) and its state
    is one of ``STATES`` (``unknown_state``). The greatest of what counts and
    what the unit is, by state and then by payload, is the new state. That is
    the maximum of a set: batches may come in any order, together, cut up or
    twice, and the outcome is the same.
    """
    of = lambda c: F.array_position(F.array(*map(F.lit, STATES)), F.coalesce(c, F.lit("")))
    rows = results.join(units.select("unit_id", F.col("digest").alias("__digest"), F.lit(True).alias("__there")), "unit_id", "left")
    problem = _first_of([(F.col("__there").isNull(), "unknown_unit"), (~F.col("digest").eqNullSafe(F.col("__digest")), "stale_digest"), (of(F.col("status")) == 0, "unknown_state")])
    rows = rows.withColumn("problem", problem)
    good = rows.filter("problem IS NULL").select("unit_id", of(F.col("status")).alias("rank"), "status", "payload", "digest")
    own = units.select("unit_id", of(F.col("status")).alias("rank"), "status", "payload", "digest")
    best = own.unionByName(good).groupBy("unit_id").agg(F.max(F.struct("rank", F.coalesce("payload", F.lit("")).alias("said"), "status", "payload", "digest")).alias("m"))
    return best.select("unit_id", "m.status", "m.digest", "m.payload"), rows.filter("problem IS NOT NULL").select(*results.columns, "problem")


def finish(units: DataFrame) -> DataFrame:
    """Units at the end of a run: what still runs has no result, and fails."""
    return units.withColumn("payload", F.when(F.col("status") == "running", "missing_result_row").otherwise(F.col("payload"))).withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))


def campaign_status(units: DataFrame, by: list[str]) -> DataFrame:
    """Per group: units in each state and the state of the whole: ``empty`` never occurs, else ``done``, ``failed`` (nothing runs or waits), ``running`` or ``pending``."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATES]
    total = reduce(lambda a, b: a + b, [F.col(s) for s in STATES])
    whole = F.when(F.col("done") == total, "done").when(F.col("running") > 0, "running").when(F.col("pending") == total, "pending").when(F.col("pending") > 0, "running").otherwise("failed")
    return units.groupBy(*by).agg(*counts).withColumn("status", whole)
