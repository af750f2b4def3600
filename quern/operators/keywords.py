"""Keyword evidence: terms in a corpus, their history status, and glossary merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import FIELD, match_key, plural_forms

#: Occurrences that an evidence record lists.
MAX_REPORTED = 32


def words(text: Column) -> Column:
    """Lower-case ASCII words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def probe_join(corpus: DataFrame, terms: DataFrame, text: str, term: str, keys: list[str]) -> DataFrame:
    """Pairs of rows and terms that stand in them as whole words, with the number of places.

    A term is found through its longest word, an equality join, and confirmed
    by looking for all its words in a row. Terms without a word match nothing,
    nor do rows with a null in ``keys``; equal rows of ``terms`` count once.
    """
    ws = words(F.col(term))
    longest = F.element_at(F.array_sort(F.transform(F.array_distinct(ws), lambda w: F.struct((-F.length(w)).alias("less"), w.alias("w")))), 1)["w"]
    t = terms.withColumn("__needle", F.array_join(ws, " ")).filter("__needle <> ''").withColumn("__probe", longest)
    c = corpus.select(*keys, F.explode(F.array_distinct(words(F.col(text)))).alias("__probe"))
    # Only keys and single words meet the terms; the texts come back for what was found.
    hits = c.join(t, "__probe").drop("__probe").distinct()
    both = hits.join(corpus.select(*keys, F.concat(F.lit(" "), F.array_join(words(F.col(text)), "  "), F.lit(" ")).alias("__hay")), keys)
    # Words are two blanks apart, so that every place of a repeated word counts.
    needle = F.concat(F.lit(" "), F.replace("__needle", F.lit(" "), F.lit("  ")), F.lit(" "))
    places = ((F.length("__hay") - F.length(F.replace("__hay", needle, F.lit("")))) / F.length(needle)).cast("long")
    return both.withColumn("places", places).filter("places > 0").drop("__needle", "__hay")


#: Kinds of a hit, the best first.
MATCH_KINDS = ("exact", "possessive_variant", "case_variant", "plural_variant")


def occurrences(corpus: DataFrame, candidates: DataFrame, source: str = "source", key: list[str] | None = None) -> DataFrame:
    """Corpus rows that hold a candidate's term, with the best ``match_kind`` of ``MATCH_KINDS``.

    A place inside a field in brackets counts only for terms that have
    brackets. A term that is followed by ``'s`` wherever it stands is a
    possessive variant.
    """
    key = key or ["occurrence_id"]
    forms = candidates.select("term", F.explode(F.concat(F.array(F.struct(F.col("term").alias("form"), F.lit(0).alias("way"))), F.transform(plural_forms(F.col("term")), lambda x: F.struct(x.alias("form"), F.lit(3).alias("way")))))).select("term", "col.*")
    hits = probe_join(corpus, forms, source, "form", key)
    joined = hits.join(corpus.select(*key, F.col(source).alias("__source")), key)
    plain = F.when(F.contains("form", F.lit("[")), F.col("__source")).otherwise(F.regexp_replace("__source", FIELD, " "))
    # A sign that stands for 's sticks to its word.
    bound = F.regexp_replace(plain, r"(?<=[A-Za-z0-9_])['’]s(?![A-Za-z0-9_])", "\u0001")
    joined = joined.withColumn("__plain", bound)
    spaced = lambda c, other: F.concat(F.lit(" "), F.regexp_replace(c, f"[^A-Za-z0-9_{other}]+", " "), F.lit(" "))
    form = spaced(F.col("form"), "")
    alone, owned = F.contains(spaced(F.col("__plain"), "\u0001"), form), F.contains(spaced(F.regexp_replace("__plain", "\u0001", " "), ""), form)
    there = F.contains(F.lower(spaced(F.regexp_replace("__plain", "\u0001", " "), "")), F.lower(form))
    joined = joined.filter(there)
    kind = F.when(F.col("way") == 0, F.when(alone, 0).when(owned, 1).otherwise(2)).otherwise(3)
    best = joined.groupBy("term", *key).agg(F.min(kind).alias("kind"), F.max("places").alias("places"))
    return best.withColumn("match_kind", F.element_at(F.array(*map(F.lit, MATCH_KINDS)), F.col("kind") + 1)).drop("kind")


def history_status(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """``(term, target, n, n_translations, status, reasons)`` of every candidate.

    ``found`` has ``term, occurrence_order, source, translation, match_kind``.
    Status by the first that holds: nothing found is unmatched; a whole-text
    match with another translation is a conflict; several translations are
    ambiguous; a term kept as it is is preserve_evidence; any other reason is
    ambiguous; else consistent.
    """
    first = F.min_by(F.struct("source", "translation"), "occurrence_order")
    flags = found.groupBy("term").agg(
        F.count("*").alias("n"),
        F.countDistinct(F.when(match_key(F.col("translation")) != "", match_key(F.col("translation")))).alias("n_translations"),
        F.max((F.col("match_kind") == "case_variant").cast("int")).alias("case"),
        F.max((F.col("match_kind") == "plural_variant").cast("int")).alias("plural"),
        F.max((F.col("match_kind") == "possessive_variant").cast("int")).alias("owned"),
        F.max((match_key(F.col("source")) == match_key(F.col("translation"))).cast("int")).alias("kept"),
        first.alias("first"),
        F.min(F.struct("occurrence_order", match_key(F.col("translation")).alias("t"))).alias("unused"),
    ).drop("unused")
    rank = F.row_number().over(Window.partitionBy("term").orderBy("occurrence_order"))
    seen = found.withColumn("r", rank).filter(F.col("r") <= MAX_REPORTED).join(candidates.select("term", "target"), "term")
    visible = seen.groupBy("term").agg(F.max(F.contains(match_key(F.col("translation")), match_key(F.col("target"))).cast("int")).alias("visible"))
    out = candidates.select("term", "target").join(flags, "term", "left").join(visible, "term", "left")
    whole, target = match_key(F.col("term")) == match_key(F.col("first.source")), F.coalesce(match_key(F.col("target")), F.lit(""))
    conflict = whole & (target != "") & (match_key(F.col("first.translation")) != target)
    unaligned = ~whole & (target != "") & (F.col("visible") == 0)
    preserved = (match_key(F.col("term")) == target) & (F.col("kept") == 1)
    tests = (("case_variant", F.col("case") == 1), ("plural_variant", F.col("plural") == 1), ("possessive_variant", F.col("owned") == 1), ("multiple_historical_translations", F.col("n_translations") > 1), ("preserve_evidence", preserved), ("candidate_target_conflict", conflict), ("translation_alignment_unknown", unaligned))
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests]))
    has = lambda x: F.array_contains("reasons", x)
    out = out.withColumn("reasons", F.when(F.col("n").isNull(), F.array(F.lit("no_history_occurrence"))).otherwise(reasons))
    status = (
        F.when(F.col("n").isNull(), "unmatched").when(has("candidate_target_conflict"), "conflict").when(has("multiple_historical_translations"), "ambiguous").when(has("preserve_evidence"), "preserve_evidence")
        .when(F.size("reasons") > 0, "ambiguous").otherwise("consistent")
    )
    return out.select("term", "target", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_translations", F.lit(0)).alias("n_translations"), status.alias("status"), "reasons")


def evidence(found: DataFrame, order: list[str], keep: list[str], most: int = MAX_REPORTED) -> DataFrame:
    """``(term, n, occurrences)``: the first ``most`` occurrences of each term; partial lists stay short."""
    place = F.row_number().over(Window.partitionBy("term").orderBy(*order))
    top = found.withColumn("__p", place).filter(F.col("__p") <= most).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("__p", *keep))).alias("o"))
    n = found.groupBy("term").agg(F.count("*").alias("n"))
    return n.join(top, "term").select("term", "n", F.transform("o", lambda x: F.struct(*[x[c].alias(c) for c in keep])).alias("occurrences"))


def glossary_hits(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, kind)``: terms inside texts, case included; of equal terms normalize, then preserve, then non_translatable."""
    priority = {"normalize": 0, "preserve": 1, "non_translatable": 2}
    rank = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col("kind")]
    best = terms.withColumn("__r", rank).groupBy("term").agg(F.min_by("kind", "__r").alias("kind"))
    # Texts and terms meet by a term's first two signs (or its only one); keys and terms only. Then the whole term is looked for.
    signs = F.split(text, "")
    firsts = F.array_distinct(F.concat(signs, F.array_compact(F.zip_with(signs, F.slice(signs, 2, F.greatest(F.length(text) - 1, F.lit(0))), lambda a, b: F.concat(a, b)))))
    probes = texts.select(key, F.explode(firsts).alias("__probe"))
    near = probes.join(best.filter("term <> ''").withColumn("__probe", F.substring("term", 1, 2)), "__probe").select(key, "term", "kind").distinct()
    return texts.select(key, F.col(text).alias("__t")).join(near, key).filter(F.contains("__t", "term")).select(key, "term", "kind")


def merge_plan(candidates: DataFrame, glossary: DataFrame, min_confidence: float = 0.6, overwrite: bool = False) -> DataFrame:
    """``(ordinal, term, target, action)``: what becomes of each candidate, in order.

    Empty, then low confidence, then what is known already (duplicate if
    equal, else conflict or overwrite), else accept; of accepted candidates
    with one key the first stands and later ones are judged against it.
    """
    known = glossary.groupBy(match_key(F.col("term")).alias("__k")).agg(F.min_by("target", "priority").alias("__known"))
    rows = candidates.withColumn("__k", match_key(F.col("term"))).join(known, "__k", "left")
    good = (F.coalesce(F.trim("term"), F.lit("")) != "") & (F.coalesce(F.trim("target"), F.lit("")) != "") & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    w = Window.partitionBy("__k").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    if overwrite:
        before = F.last(F.when(good, F.col("target")), ignorenulls=True).over(w)
    else:
        before = F.first(F.when(good & F.col("__known").isNull(), F.col("target")), ignorenulls=True).over(w)
    now = F.coalesce(before, "__known") if overwrite else F.coalesce("__known", before)
    rows = rows.withColumn("__now", now)
    action = (
        F.when((F.coalesce(F.trim("term"), F.lit("")) == "") | (F.coalesce(F.trim("target"), F.lit("")) == ""), "empty")
        .when(F.coalesce("confidence", F.lit(0.0)) < min_confidence, "low_confidence")
        .when(F.col("__now").isNull(), "accept")
        .when(match_key(F.col("__now")) == match_key(F.col("target")), "duplicate")
        .otherwise("overwrite" if overwrite else "conflict")
    )
    return rows.select("ordinal", "term", "target", action.alias("action"))


def merged_glossary(glossary: DataFrame, plan: DataFrame) -> DataFrame:
    """The glossary with the accepted and overwriting rows of a plan, the last of each key."""
    new = plan.filter(F.col("action").isin("accept", "overwrite")).groupBy(match_key(F.col("term")).alias("__k")).agg(F.max_by("term", "ordinal").alias("__term"), F.max_by("target", "ordinal").alias("__target"))
    old = glossary.withColumn("__k", match_key(F.col("term")))
    both = old.join(new, "__k", "full_outer")
    return both.select(F.coalesce("term", "__term").alias("term"), F.coalesce("__target", "target").alias("target"), F.coalesce("priority", F.lit(0)).alias("priority"))
