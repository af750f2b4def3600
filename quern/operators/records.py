"""Records around translations: preserved terms, findings, candidates, registries, gates. All of it projections, joins and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import compact, match_key, word_pattern


def _first_of(tests: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), name) for test, name in tests])


# -- terms and candidates


def missing_terms(rows: DataFrame, terms: list[str], source: str = "source", translation: str = "translation") -> Column:
    """The terms that the source has and the translation lacks, in their order.

    Terms of up to three letters count as whole words only; a field such as
    ``[name]`` is kept by ``[name!t]`` as well.
    """
    s, t = F.col(source), F.col(translation)
    tests = []
    for term in terms:
        if term.isalpha() and term.isascii() and len(term) <= 3:
            has, kept = F.regexp_like(s, word_pattern(F.lit(term))), F.regexp_like(t, word_pattern(F.lit(term)))
        else:
            has, kept = F.contains(s, F.lit(term)), F.contains(t, F.lit(term))
            if term.startswith("[") and term.endswith("]"):
                kept = kept | F.contains(t, F.lit(term[:-1] + "!"))
        tests.append(F.when(has & ~kept, F.lit(term)))
    said = (F.coalesce(s, F.lit("")) != "") & (F.coalesce(t, F.lit("")) != "")
    return F.when(said, F.array_compact(F.array(*tests))).otherwise(F.array().cast("array<string>"))


def ui_noise(source: Column, evidence: Column, words: list[str], marks: list[str]) -> Column:
    """Candidates that come from a screen: listed words, evidence with a mark, up to three ASCII letters with any evidence."""
    s, e = match_key(source), match_key(F.coalesce(evidence, F.lit("")))
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains(e, F.lit(m.lower()))
    short = compact(source).rlike("^[A-Za-z]{1,3}$") & (e != "")
    return F.coalesce((s != "") & (s.isin(*[w.lower() for w in words]) | marked | short), F.lit(False))


def classify_candidates(candidates: DataFrame) -> DataFrame:
    """Adds ``section`` (``preserve`` where source and target agree, case aside, else ``normalize``) and ``warnings``.

    ``candidates`` has ``source, target, confidence, evidence, status``.
    Warnings: ``same_as_source``, ``long_source`` (over 40 signs),
    ``low_confidence`` (below 0.6), ``no_evidence``, ``history_conflict``.
    """
    same = match_key(F.col("source")) == match_key(F.col("target"))
    tests = [
        (same, "same_as_source"), (F.length(compact(F.col("source"))) > 40, "long_source"), (F.coalesce("confidence", F.lit(0.0)) < 0.6, "low_confidence"),
        (F.coalesce(compact(F.col("evidence")), F.lit("")) == "", "no_evidence"), (F.col("status").isin("conflict", "ambiguous"), "history_conflict"),
    ]
    return candidates.withColumn("section", F.when(same, "preserve").otherwise("normalize")).withColumn("warnings", F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for t, n in tests])))


def attach_evidence(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """``candidates`` with ``history``, a struct of status, occurrences and translations; ``unavailable`` where there is none."""
    key = match_key(F.col("source"))
    known = evidence.groupBy(key.alias("__k")).agg(F.max(F.struct("n", "status", "n_translations")).alias("h"))
    rows = candidates.withColumn("__k", key).join(known, "__k", "left")
    history = F.struct(F.coalesce("h.status", F.lit("unavailable")).alias("status"), F.coalesce("h.n", F.lit(0).cast("long")).alias("n"), F.coalesce("h.n_translations", F.lit(0).cast("long")).alias("n_translations"))
    return rows.withColumn("history", history).drop("__k", "h")


def evidence_complete(row: DataFrame) -> Column:
    """Whether history evidence lets a candidate in without a review: consistent, seen, with one translation, which is the candidate's."""
    h = F.col("history")
    agrees = match_key(F.col("target")) == match_key(F.col("seen_target"))
    return F.coalesce((h["status"] == "consistent") & (h["n"] > 0) & (h["n_translations"] == 1) & agrees & (compact(F.col("source")) != ""), F.lit(False))


def glossary_digest(glossary: DataFrame) -> DataFrame:
    """``(section, n, digest)`` of a glossary ``(section, source, target)``, in any order; equal rows count once."""
    line = F.md5(F.concat_ws("\x1f", compact(F.col("source")), compact(F.col("target"))).cast("binary"))
    rows = glossary.filter(compact(F.col("source")) != "").select("section", line.alias("d")).distinct()
    half = lambda at: F.conv(F.substring("d", at, 16), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy("section").agg(F.count("*").alias("n"), F.sum(half(1)).alias("a"), F.sum(half(17)).alias("b"))
    return sums.select("section", "n", F.md5(F.concat_ws(":", "n", "a", "b").cast("binary")).alias("digest"))


# -- findings and reports


def finding_problems(findings: DataFrame) -> Column:
    """The first reason for which a finding breaks its contract, else null."""
    return _first_of(
        [
            (F.trim(F.coalesce("finding_id", F.lit(""))) == "", "no_id"),
            (~F.coalesce("reason_code", F.lit("")).rlike(r"^quality\.[a-z_]+\.[a-z_]+$"), "bad_reason"),
            (~F.coalesce("severity", F.lit("")).isin("low", "medium", "high"), "bad_severity"),
            (~F.coalesce("disposition", F.lit("")).isin("blocker", "warning", "off"), "bad_disposition"),
            ((F.col("disposition") == "blocker") & (F.col("severity") != "high"), "mild_blocker"),
        ]
    )


def unmatched_subjects(subjects: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """One finding if some subjects have no item: ``(reason_code, evidence, n)``, evidence the counts as JSON."""
    lost = subjects.join(items.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("lost"))
    rows = subjects.agg(F.count("*").alias("all")).join(F.broadcast(lost)).filter("lost > 0")  # one row each
    told = F.to_json(F.struct((F.col("all") - F.col("lost")).alias("matched"), F.col("all").alias("subjects"), F.col("lost").alias("unmatched")))
    return rows.select(F.lit("quality.collection.unmatched_subject").alias("reason_code"), told.alias("evidence"), F.col("lost").alias("n"))


def finding_order(findings: DataFrame) -> DataFrame:
    """Adds ``place``: findings of a file by line, then reason, then id."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("line", "reason_code", "finding_id")))


def to_markdown(findings: DataFrame) -> DataFrame:
    """``(file, line, markdown)``: a row of a report's table for each finding, pipes escaped, line breaks out."""
    cell = lambda c: F.replace(compact(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("|"), F.lit("\\|"))
    return findings.select("file", "line", F.concat(F.lit("| "), F.concat_ws(" | ", cell("file"), cell("line"), cell("reason_code"), cell("severity"), cell("text")), F.lit(" |")).alias("markdown"))


def readiness(items: DataFrame, by: str, allow_pending: Column | None = None) -> DataFrame:
    """``(by, n, pending, state)``: ``ready`` if there are items and none is pending (or pending ones are allowed), else ``empty`` or ``pending``."""
    ok = allow_pending if allow_pending is not None else F.lit(False)
    rows = items.groupBy(by).agg(F.count("item_id").alias("n"), F.count_if(F.col("status") == "pending").alias("pending"), F.max(ok).alias("ok"))
    return rows.select(by, "n", "pending", F.when(F.col("n") == 0, "empty").when((F.col("pending") == 0) | F.col("ok"), "ready").otherwise("pending").alias("state"))


def record_problems(records: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``records (record_id, occurrence_id, source)`` with ``problem``: ``unknown_occurrence``, ``duplicate`` (all but the first id), ``source_changed`` or null."""
    first = records.groupBy("occurrence_id").agg(F.min("record_id").alias("__first"))
    rows = records.join(first, "occurrence_id", "left").join(occurrences.select("occurrence_id", F.col("source").alias("__now"), F.lit(True).alias("__there")), "occurrence_id", "left")
    tests = [(F.col("__there").isNull(), "unknown_occurrence"), (F.col("record_id") != F.col("__first"), "duplicate"), (~compact(F.coalesce("source", F.lit(""))).eqNullSafe(compact(F.coalesce("__now", F.lit("")))), "source_changed")]
    return rows.withColumn("problem", _first_of(tests)).select(*records.columns, "problem")


# -- caches and registries


def cache_split(texts: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts with the vector that the cache ``(sha256, embedding)`` has for them, and the distinct texts that it lacks, once each."""
    rows = texts.withColumn("sha256", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    hits = rows.join(cache.select("sha256", "embedding"), "sha256")
    misses = rows.join(cache.select("sha256"), "sha256", "left_anti").groupBy("sha256").agg(F.min(text).alias(text), F.count("*").alias("n"))
    return hits, misses


def refresh(old: DataFrame, found: DataFrame, key: str, read: list[str], kept: list[str]) -> DataFrame:
    """A registry after a new look: ``(key, read..., kept..., change)``.

    Columns ``read`` come from what was found, columns ``kept`` (a person's
    notes) stay. ``change`` is ``added``, ``changed``, ``same`` or ``missing``;
    missing entries keep all they had.
    """
    digest = lambda p: F.md5(F.to_json(F.struct(*[F.col(f"{p}.{c}") for c in read])).cast("binary"))
    a = old.select(key, F.struct(*read, *kept).alias("a"))
    b = found.select(key, F.struct(*read).alias("b"))
    rows = a.join(b, key, "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "missing").when(digest("a") != digest("b"), "changed").otherwise("same")
    new = [F.when(F.col("b").isNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in read]
    return rows.select(key, *new, *[F.col(f"a.{c}").alias(c) for c in kept], change.alias("change"))


def registry_order(rows: DataFrame, by: str, key: str, descending: bool = False) -> DataFrame:
    """Adds ``place``: rows by a column, text without case, nulls last, then by key."""
    c = F.lower(by) if dict(rows.dtypes)[by] == "string" else F.col(by)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), key)))
