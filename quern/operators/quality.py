"""Rule-based quality findings on (source, translation) subjects, and the gate over them.

A rule is a function from a subject's columns to an array of evidence strings;
each evidence becomes a finding. Rules run in one projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import CJK, LATIN_TOKEN, mask_markup

#: Tokens that may stay Latin next to Chinese text.
ALLOWED_LATIN = ("Ren'Py", "OK", "NG", "CG", "BGM", "SE", "HP", "MP", "TP", "XP", "LV", "AI", "ID", "VIP", "DLC", "RPG", "CPU", "USB", "TV", "PC", "URL")
#: Interjections.
INTERJECTIONS = ("Hm", "Hmm", "Oh", "Ow", "Whoa", "Wow", "Hey", "Ah", "Eh", "Ugh", "Ouch", "Huh", "Eek", "Argh", "Gah")
#: Endings of speaker labels that name an occupation.
SPEAKER_LABELS = (
    "Knight", "Guard", "Bouncer", "Merchant", "Captain", "Doctor", "Nurse", "Priest", "Priestess", "Maid", "Butler", "Sister", "Brother",
    "Father", "Mother", "Chief", "Elder", "Witch", "Wizard", "Hunter", "Smith", "Teacher", "Soldier", "Commander", "Adventurer", "Guild",
    "Church", "City", "Sir", "Boss", "Master", "Miss", "Mr", "Mrs", "Ms",
)
SEVERITIES = ("low", "medium", "high")


@dataclass(frozen=True)
class Policy:
    """What a project allows."""

    allowed: tuple[str, ...] = ALLOWED_LATIN
    interjections: tuple[str, ...] = INTERJECTIONS
    labels: tuple[str, ...] = SPEAKER_LABELS
    garbled: tuple[str, ...] = ()
    blockers: tuple[str, ...] = ("quality.structure.unclosed_delimiters",)
    severity: dict[str, str] = field(default_factory=dict)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _allowed(policy: Policy) -> Callable[[Column], Column]:
    return lambda x: F.lower(x).isin([a.lower() for a in policy.allowed])


def wait_tag_in_cjk(s: DataFrame, p: Policy) -> Column:
    return _all(s["translation"], rf"{CJK}\s*\{{w(?:=[^{{}}\r\n]*)?\}}\s*{CJK}")


def unclosed_delimiters(s: DataFrame, p: Policy) -> Column:
    t = s["translation"]
    for mark in ("{{", "}}", "[[", "]]"):
        t = F.replace(t, F.lit(mark), F.lit(""))
    # An array of one element names the text, so that it is made once.
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    odd = lambda x: F.array_compact(F.array(*[F.when(count(x, a) != count(x, b), F.lit(a + b)) for a, b in ("{}", "[]")]))
    return F.when(s["translation"].rlike(r"[{}\[\]]"), F.element_at(F.transform(F.array(t), odd), 1)).otherwise(F.array().cast("array<string>"))


def english_suffix_next_to_cjk(s: DataFrame, p: Policy) -> Column:
    found = _all(s["masked"], rf"(?<={CJK})({LATIN_TOKEN})", 1)
    return F.filter(found, lambda x: x.rlike(r"(?:'s|s|es|ed|ing|er|est|ly|ness|ment|tion|able|ible|ful|less)$") & ~_allowed(p)(x))


def cjk_latin_spacing(s: DataFrame, p: Policy) -> Column:
    found = _all(s["masked"], rf"(?<={CJK}){LATIN_TOKEN}|(?<![A-Za-z0-9'’\-]){LATIN_TOKEN}(?![A-Za-z0-9'’\-])(?={CJK})")
    return F.filter(found, lambda x: ~_allowed(p)(x))


def halfwidth_punctuation(s: DataFrame, p: Policy) -> Column:
    return _all(s["translation"], rf"""(?<={CJK})[,.;:!?()"]|[,.;:!?()"](?={CJK})""")


def ascii_ellipsis(s: DataFrame, p: Policy) -> Column:
    return _all(s["translation"], rf"(?<={CJK})\.{{3,}}|(?<!\.)\.{{3,}}(?={CJK})")


def english_residue(s: DataFrame, p: Policy) -> Column:
    found = F.filter(_all(s["masked"], LATIN_TOKEN), lambda x: (F.length(x) >= 2) & ~_allowed(p)(x))
    return F.when(s["translation"].rlike(CJK), found).otherwise(F.array().cast("array<string>"))


def speaker_label_untranslated(s: DataFrame, p: Policy) -> Column:
    if "speaker_name" not in s.columns:
        return F.array().cast("array<string>")
    name = F.trim(F.coalesce(s["speaker_name"], F.lit("")))
    label = F.regexp_extract(name, rf"({'|'.join(x for x in p.labels if x.lower() not in {a.lower() for a in p.allowed})})$", 1)
    there = F.lit(False)
    for x in p.labels:
        there = there | ((label == x) & s["translation"].rlike(rf"(?<![A-Za-z0-9'\-]){x}(?![A-Za-z0-9'\-])"))
    own = s["speaker_name_translation"].rlike(CJK) if "speaker_name_translation" in s.columns else F.lit(False)
    whole = ~s["translation"].rlike(CJK) & s["source"].rlike(CJK)
    bad = (label != "") & ~whole & (there | (~F.coalesce(own, F.lit(False)) & s["translation"].rlike(CJK)))
    return F.when(bad, F.array(label)).otherwise(F.array().cast("array<string>"))


def interjection_untranslated(s: DataFrame, p: Policy) -> Column:
    low = lambda c: F.transform(_all(c, r"[A-Za-z][A-Za-z'\-]*"), F.lower)
    kept = F.array_sort(F.array_intersect(F.array_intersect(low(s["source"]), F.array(*[F.lit(x.lower()) for x in p.interjections])), low(s["translation"])))
    # Words are listed only where one of the interjections stands at all.
    some = s["translation"].rlike(rf"(?i)(?<![A-Za-z])(?:{'|'.join(p.interjections)})(?![A-Za-z])") if p.interjections else F.lit(False)
    return F.coalesce(F.when(some & ~s["source"].rlike(CJK), F.when(F.size(kept) > 0, F.array(F.array_join(kept, ",")))), F.array().cast("array<string>"))


def garbled_phrase(s: DataFrame, p: Policy) -> Column:
    return F.array_compact(F.array(*[F.when(s["translation"].contains(x), F.lit(x)) for x in p.garbled])) if p.garbled else F.array().cast("array<string>")


#: Rules by reason code; the codes are fixed values. Others may be added; each takes the subjects and the policy.
RULES: dict[str, Callable[[DataFrame, Policy], Column]] = {
    "quality.renpy.wait_tag_inside_cjk": wait_tag_in_cjk,
    "quality.structure.unclosed_delimiters": unclosed_delimiters,
    "quality.language.english_suffix_adjacent": english_suffix_next_to_cjk,
    "quality.typography.cjk_latin_spacing": cjk_latin_spacing,
    "quality.typography.halfwidth_punctuation": halfwidth_punctuation,
    "quality.typography.ascii_ellipsis": ascii_ellipsis,
    "quality.language.suspicious_english_residue": english_residue,
    "quality.speaker.label_untranslated": speaker_label_untranslated,
    "quality.completeness.interjection_untranslated": interjection_untranslated,
    "quality.garbled.known_bad_phrase": garbled_phrase,
}


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all tasks, where their files would give fewer tasks than there are cores: rules cost far more than moving texts."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores) if not rows.isStreaming and rows.rdd.getNumPartitions() < cores else rows


def find(subjects: DataFrame, policy: Policy = Policy(), rules: dict | None = None, key: str = "item_id") -> DataFrame:
    """``(item_id, file, line, reason_code, evidence, n_evidence, severity, disposition, finding_id)``, one row per subject and reason.

    ``subjects`` needs ``source`` and ``translation``; null is empty. Rules
    also see ``masked``, the translation without its markup. A blocker is always of high severity.
    """
    s = spread(subjects).withColumns({c: F.coalesce(c, F.lit("")) for c in ("source", "translation")})
    # Made once, as several rules read it.
    s = s.withColumn("masked", mask_markup(F.col("translation")))
    chosen = rules or RULES
    found = F.array(*[F.struct(F.lit(code).alias("reason_code"), rule(s, policy).alias("evidence")) for code, rule in chosen.items()])
    place = [F.col(c) if c in s.columns else F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("line", "int"))]
    rows = s.select(key, *place, F.explode(F.filter(found, lambda x: F.size(x["evidence"]) > 0)).alias("f"))
    code = F.col("f.reason_code")
    blocker = code.isin(list(policy.blockers))
    given = F.lit("medium")
    for c, level in policy.severity.items():
        given = F.when(code == c, level).otherwise(given)
    rows = rows.select(
        key, "file", "line", code.alias("reason_code"), F.col("f.evidence").alias("evidence"), F.size("f.evidence").cast("long").alias("n_evidence"),
        F.when(blocker, "high").otherwise(given).alias("severity"), F.when(blocker, "blocker").otherwise("warning").alias("disposition"),
    )
    return rows.withColumn("finding_id", F.substring(F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), "reason_code", F.array_join("evidence", "\x1e")), 256), 1, 16))


def glossary_not_applied(subjects: DataFrame, glossary: DataFrame, key: str = "item_id") -> DataFrame:
    """``(item_id, term, target)``: the source term stands in both texts and its target is not used.

    Terms are looked up by their first word, so the join is on equality.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9_'\-]+|[^\sA-Za-z0-9_'\-]"), F.lit(0)))
    terms = glossary.select("term", "target", F.element_at(words(F.col("term")), 1).alias("probe"))
    s = subjects.select(key, "source", "translation", F.explode(words(F.col("source"))).alias("probe"))
    within = lambda text, term: F.expr(rf"concat(' ', regexp_replace({text}, '[^A-Za-z0-9_\'\\-]+', ' '), ' ') LIKE concat('% ', {term}, ' %')")
    hit = within("source", "term") & within("translation", "term") & ~F.when(F.col("target").rlike("[A-Za-z]"), within("translation", "target")).otherwise(F.expr("contains(translation, target)"))
    return s.join(terms, "probe").filter(hit).select(key, "term", "target").distinct()


def findings_filter(findings: DataFrame, reasons: list[str] | None = None, files: list[str] | None = None, min_severity: str | None = None, dispositions: list[str] | None = None, text: str | None = None, items: list | None = None) -> DataFrame:
    """All given conditions at once; an empty one filters nothing. Files match by path (see ``path_match``).

    The text is looked for in source, translation and evidence, case aside;
    of these, columns that the findings lack say nothing.
    """
    out = findings
    if reasons:
        out = out.filter(F.col("reason_code").isin(reasons))
    if files:
        cond = F.lit(False)
        for f in files:
            cond = cond | path_match(F.col("file"), f)
        out = out.filter(cond)
    if min_severity:
        out = out.filter(F.col("severity").isin(list(SEVERITIES[SEVERITIES.index(min_severity) :])))
    if dispositions:
        out = out.filter(F.col("disposition").isin([d.strip().lower() for d in dispositions]))
    if items:
        out = out.filter(F.col("item_id").cast("string").isin([str(i).strip() for i in items]))
    if text and text.strip():
        said = [F.col(c) for c in ("source", "translation") if c in findings.columns]
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", *said, F.array_join("evidence", " "))), F.lit(text.strip().lower())))
    return out


def path_match(path: Column, wanted: str) -> Column:
    """Equal, below it, one of the path's components, or, for a bare fragment, part of it; case and kind of slash aside."""
    path, wanted = F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), wanted.replace("\\", "/").strip().lower()
    if not wanted:
        return F.lit(False)
    out = (path == wanted) | path.startswith(wanted.rstrip("/") + "/") | F.array_contains(F.split(path, "/"), wanted)
    return out | path.contains(wanted) if "/" not in wanted and "." not in wanted else out


def gate(findings: DataFrame, acknowledged: DataFrame, key: str = "finding_id") -> DataFrame:
    """One row: counts and decision. Warnings may be acknowledged, blockers never."""
    seen = acknowledged.select(key).distinct().withColumn("__ack", F.lit(True))
    return gate_marked(findings.join(seen, key, "left"), F.col("__ack"))


def gate_marked(findings: DataFrame, acknowledged: Column) -> DataFrame:
    """``gate`` where a column of the findings tells what is acknowledged, in one pass."""
    warning, ack = F.col("disposition") == "warning", F.coalesce(acknowledged, F.lit(False))
    out = findings.agg(F.count_if(F.col("disposition") == "blocker").alias("blockers"), F.count_if(warning).alias("warnings"), F.count_if(warning & ack).alias("acknowledged"))
    open_ = (F.col("blockers") > 0) | (F.col("warnings") > F.col("acknowledged"))
    return out.withColumn("decision", F.when(open_, "needs_review").when(F.col("warnings") > 0, "acknowledged").otherwise("pass"))


def validate_translation(rows: DataFrame, source: str = "source", translation: str = "translation") -> DataFrame:
    """Adds ``problem``: the first rule that fails, by tokens that both texts must have equally often."""
    s, t = F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(translation), F.lit(""))
    same = lambda p: F.array_sort(_all(s, p)) == F.array_sort(_all(t, p))
    problem = (
        F.when(F.trim(t) == "", "empty")
        .when(~same(r"\{[^{}\r\n]*\}"), "tags")
        .when(~same(r"\[[^\[\]\r\n]*\]"), "fields")
        .when(~same(r"%(?:\([^)]+\))?[#0 +\-]*\d*(?:\.\d+)?[hlL]?[diouxXeEfFgGcrsa](?![A-Za-z])"), "formats")
    )
    return rows.withColumn("problem", problem)


def token_deltas(rows: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """``(key, token, missing, extra)``: multiset difference of two arrays of tokens, both ways."""
    count = lambda c, n: rows.select(key, F.explode(c).alias("token")).groupBy(key, "token").agg(F.count("*").alias(n))
    both = count(left, "a").join(count(right, "b"), [key, "token"], "full_outer").na.fill(0, ["a", "b"])
    return both.filter("a <> b").select(key, "token", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("missing"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("extra"))
