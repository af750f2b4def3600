"""Queries on quality rules, keywords and glossaries.

``documents`` has no Chinese text: its lines get some, with tags and marks, in
the place of common words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import keywords as K
from quern.operators import quality as Q

from .book import query

#: What stands for common words in the translation of a line; some lines get other signs, by document and line.
_SWAPS = ((" the ", "的"), (" de ", " 的"), (" la ", "啦 "), (" and ", " {w}和{w} "), (" que ", "好{w=1}好"), (" is ", " [is] "), (" der ", "的OK"), (", ", "，"))
_SOME = ((3, ". ", "..."), (5, " of ", "的, "), (7, " in ", "在{in "), (11, " to ", "[to到"))


def subjects(t):
    """A subject for each line of each document."""
    lines = t("documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    out = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), _SWAPS, F.col("said"))
    for n, old, new in _SOME:
        out = F.when((F.col("doc_id") + F.col("line")) % n == 0, F.replace(out, F.lit(old), F.lit(new))).otherwise(out)
    return lines.select(F.concat_ws(":", "doc_id", "line").alias("item_id"), F.col("source").alias("file"), "line", F.col("said").alias("source"), out.alias("translation"))


def _found() -> str:
    """The rules in SQL: one row per subject and reason."""
    swapped = reduce(lambda c, x: f"replace({c}, '{x[0]}', '{x[1]}')", _SWAPS, "said")
    steps = f"t0 AS (SELECT *, {swapped} AS t FROM l)"
    for k, (n, old, new) in enumerate(_SOME):
        steps += f", t{k + 1} AS (SELECT * REPLACE (CASE WHEN (doc_id + line) % {n} = 0 THEN replace(t, '{old}', '{new}') ELSE t END AS t) FROM t{k})"
    cjk, latin = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]", "[A-Za-z][A-Za-z0-9''’-]*"
    names = lambda words: "[" + ", ".join("'" + w.lower().replace("'", "''") + "'" for w in words) + "]"
    strange = lambda group, at: f"[x FOR x IN regexp_extract_all(m, '{group}', {at}) IF NOT list_contains({names(Q.ALLOWED_LATIN)}, lower(x))]"
    spoken = lambda c: f"[lower(x) FOR x IN regexp_extract_all({c}, '[A-Za-z][A-Za-z''-]*')]"
    bare = "replace(replace(replace(replace(t, '{{', ''), '}}', ''), '[[', ''), ']]', '')"
    signs = lambda a, b: f"length({bare}) - length(replace({bare}, '{a}', '')) <> length({bare}) - length(replace({bare}, '{b}', ''))"
    rules = {
        "quality.renpy.wait_tag_inside_cjk": rf"regexp_matches(t, '{cjk}\s*\{{w(=[^{{}}\r\n]*)?\}}\s*{cjk}')",
        "quality.structure.unclosed_delimiters": f"({signs('{', '}')} OR {signs('[', ']')})",
        "quality.language.english_suffix_adjacent": f"len([y FOR y IN {strange(f'{cjk}({latin})', 1)} IF regexp_matches(y, '(''s|s|es|ed|ing|er|est|ly|ness|ment|tion|able|ible|ful|less)$')]) > 0",
        "quality.typography.cjk_latin_spacing": f"(len({strange(f'{cjk}({latin})', 1)}) > 0 OR len({strange(f'(^|[^A-Za-z0-9’{chr(39) * 2}-])({latin}){cjk}', 2)}) > 0)",
        "quality.typography.halfwidth_punctuation": f"""regexp_matches(t, '{cjk}[,.;:!?()"]|[,.;:!?()"]{cjk}')""",
        "quality.typography.ascii_ellipsis": rf"regexp_matches(t, '{cjk}\.\.\.|\.\.\.{cjk}')",
        "quality.language.suspicious_english_residue": f"(regexp_matches(t, '{cjk}') AND len([y FOR y IN {strange(latin, 0)} IF length(y) > 1]) > 0)",
        "quality.completeness.interjection_untranslated": f"(NOT regexp_matches(said, '{cjk}') AND len(list_intersect(list_intersect({spoken('said')}, {names(Q.INTERJECTIONS)}), {spoken('t')})) > 0)",
    }
    cases = ", ".join(f"CASE WHEN {test} THEN '{code}' END" for code, test in rules.items())
    return rf"""WITH l AS (SELECT doc_id, source AS file, CAST(line - 1 AS INT) AS line, said FROM (SELECT doc_id, source, generate_subscripts(p, 1) AS line, unnest(p) AS said FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents))), {steps},
        m AS (SELECT *, regexp_replace(t, '\{{[^{{}}\r\n]*\}}|\[[^\[\]\r\n]*\]', ' ', 'g') AS m FROM t{len(_SOME)}), f AS (SELECT doc_id || ':' || line AS item_id, file, line, unnest([{cases}]) AS reason_code FROM m)"""


_FOUND = _found()
_BLOCKER = "reason_code = 'quality.structure.unclosed_delimiters'"


@query("quality_findings", f"{_FOUND} SELECT item_id, file, line, reason_code, CASE WHEN {_BLOCKER} THEN 'high' ELSE 'medium' END AS severity, CASE WHEN {_BLOCKER} THEN 'blocker' ELSE 'warning' END AS disposition FROM f WHERE reason_code IS NOT NULL")
def quality_findings(t):
    """All rules on all subjects."""
    return Q.find(subjects(t)).select("item_id", "file", "line", "reason_code", "severity", "disposition")


@query("quality_histogram", f"{_FOUND} SELECT reason_code, COUNT(*) AS n FROM f WHERE reason_code IS NOT NULL GROUP BY 1")
def quality_histogram(t):
    """Findings per reason."""
    return Q.find(subjects(t)).groupBy("reason_code").agg(F.count("*").alias("n"))


@query(
    "quality_gate",
    f"""{_FOUND}, c AS (SELECT file, COUNT(*) FILTER (WHERE {_BLOCKER}) AS blockers, COUNT(*) FILTER (WHERE NOT {_BLOCKER}) AS warnings, COUNT(*) FILTER (WHERE reason_code = 'quality.typography.halfwidth_punctuation') AS acknowledged FROM f WHERE reason_code IS NOT NULL AND (file = 'src3' OR {_BLOCKER} OR reason_code LIKE '%halfwidth%') GROUP BY ALL)
        SELECT CAST(SUM(blockers) AS BIGINT) AS blockers, CAST(SUM(warnings) AS BIGINT) AS warnings, CAST(SUM(acknowledged) AS BIGINT) AS acknowledged, CASE WHEN SUM(blockers) > 0 OR SUM(warnings) > SUM(acknowledged) THEN 'needs_review' WHEN SUM(warnings) > 0 THEN 'acknowledged' ELSE 'pass' END AS decision FROM c""",
)
def quality_gate(t):
    """The gate over one file's findings and those of two reasons elsewhere; one reason acknowledged, blockers stay."""
    found = Q.find(subjects(t)).filter("file = 'src3' OR reason_code IN ('quality.structure.unclosed_delimiters', 'quality.typography.halfwidth_punctuation')")
    return Q.gate_marked(found, F.col("reason_code").isin("quality.typography.halfwidth_punctuation", "quality.structure.unclosed_delimiters"))


@query("quality_filter", f"{_FOUND} SELECT item_id, reason_code FROM f WHERE reason_code IN ('quality.typography.ascii_ellipsis', 'quality.typography.halfwidth_punctuation') AND file IN ('src3', 'src4')")
def quality_filter(t):
    """Reasons and files at once."""
    return Q.findings_filter(Q.find(subjects(t)), reasons=["quality.typography.ascii_ellipsis", "quality.typography.halfwidth_punctuation"], files=["SRC3", "src4"]).select("item_id", "reason_code")


@query("path_match", "SELECT page_id FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://(.*?)([?#].*)?$', 1) AS p FROM pages) WHERE p = 'en' OR starts_with(p, 'en/') OR list_contains(string_split(p, '/'), 'en') OR contains(p, 'en')")
def path_match(t):
    """Paths that a bare fragment matches."""
    p = F.regexp_extract("url", r"^[a-z]+://(.*?)([?#].*)?$", 1)
    return t("pages").withColumn("p", p).filter(Q.path_match(F.col("p"), "en")).select("page_id")


_TOKENS = ((" the ", " {i}the{/i} "), (" de ", " [name] "), (" la ", " %d, "), (" and ", " %s; "), (" der ", " {b} "))
_LOST = ((3, "{i}", ""), (4, "[name]", "name"), (5, "%d,", "%s,"), (7, " %s;", ""))


def _checked() -> str:
    """Lines with tags, fields and formats, some lost in the translation, in SQL."""
    source = reduce(lambda c, x: f"replace({c}, '{x[0]}', '{x[1]}')", _TOKENS, "translate(coalesce(said, ''), '%{}[]', '')")
    lost = reduce(lambda c, x: f"CASE WHEN (doc_id + line) % {x[0]} = 0 THEN replace({c}, '{x[1]}', '{x[2]}') ELSE {c} END", _LOST, "s")
    return f"""l AS (SELECT doc_id, CAST(line - 1 AS INT) AS line, said FROM (SELECT doc_id, generate_subscripts(p, 1) AS line, unnest(p) AS said FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))),
        a AS (SELECT doc_id, line, {source} AS s FROM l), b AS (SELECT *, CASE WHEN (doc_id + line) % 11 = 0 THEN ' ' ELSE {lost} END AS t FROM a)"""


def _same(pattern: str) -> str:
    return f"list_sort(regexp_extract_all(s, '{pattern}')) = list_sort(regexp_extract_all(t, '{pattern}'))"


@query(
    "translation_checks",
    rf"""WITH {_checked()} SELECT coalesce(CASE WHEN trim(t) = '' THEN 'empty' WHEN NOT {_same(r"\{[^{}\r\n]*\}")} THEN 'tags' WHEN NOT {_same(r"\[[^\[\]\r\n]*\]")} THEN 'fields' WHEN NOT {_same("%[ds]")} THEN 'formats' END, 'none') AS problem, COUNT(*) AS n FROM b GROUP BY 1""",
)
def translation_checks(t):
    """The first token rule that the translation of a line breaks."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    source = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), _TOKENS, F.translate(F.coalesce("said", F.lit("")), "%{}[]", ""))
    rows = lines.select("doc_id", "line", source.alias("source"))
    at = F.col("doc_id") + F.col("line")
    lost = reduce(lambda c, x: F.when(at % x[0] == 0, F.replace(c, F.lit(x[1]), F.lit(x[2]))).otherwise(c), _LOST, F.col("source"))
    checked = Q.validate_translation(rows.select("source", F.when(at % 11 == 0, " ").otherwise(lost).alias("translation")))
    return checked.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


_LINES = "(SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(
    "token_deltas",
    r"""WITH w AS (SELECT conv_id, role, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM conversations), a AS (SELECT conv_id, w, COUNT(*) AS n FROM w WHERE role = 'user' GROUP BY 1, 2), b AS (SELECT conv_id, w, COUNT(*) AS n FROM w WHERE role <> 'user' GROUP BY 1, 2)
       SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.w, b.w) AS token, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS missing, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS extra FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.w = b.w WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
)
def token_deltas(t):
    """Words that the two sides of a conversation do not say equally often."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    none = F.array().cast("array<string>")
    rows = t("conversations").select("conv_id", F.when(F.col("role") == "user", words).otherwise(none).alias("a"), F.when(F.col("role") != "user", words).otherwise(none).alias("b"))
    return Q.token_deltas(rows, "conv_id", "a", "b")


def _terms(t):
    """The words of each benchmark item."""
    w = F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9_]+", " "), " ")
    return t("benchmark").select("item_id", F.concat_ws(" ", F.filter(w, lambda x: x != "")).alias("term")).filter("term <> ''")


@query(
    "keyword_hits",
    r"""WITH t AS (SELECT item_id, array_to_string([x for x in string_split(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'), ' ') if x <> ''], ' ') AS term FROM benchmark),
        d AS (SELECT doc_id, '  ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), '  ') || '  ' AS h FROM documents)
        SELECT item_id, doc_id FROM t JOIN d ON contains(h, ' ' || replace(term, ' ', '  ') || ' ') WHERE term <> ''""",
)
def keyword_hits(t):
    """Documents in which a whole item stands."""
    return K.probe_join(t("documents").select("doc_id", "text"), _terms(t), "text", "term", ["doc_id"]).select("item_id", "doc_id")


@query(
    "keyword_evidence",
    r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents), t AS (SELECT unnest(['the', 'der', 'les', 'zzz']) AS term), o AS (SELECT DISTINCT term, doc_id FROM t JOIN d ON d.w = t.term)
        SELECT term, COUNT(*) AS n, (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM (SELECT doc_id FROM o x WHERE x.term = o.term ORDER BY doc_id LIMIT 5)) AS occurrences FROM o GROUP BY term""",
)
def keyword_evidence(t):
    """The first five documents of each term, and how many there are."""
    docs = t("documents")
    terms = docs.sparkSession.createDataFrame([("the",), ("der",), ("les",), ("zzz",)], "term string")
    found = K.probe_join(docs.select("doc_id", "text"), terms, "text", "term", ["doc_id"])
    out = K.evidence(found, ["doc_id"], ["doc_id"], 5)
    return out.select("term", "n", F.array_join(F.transform("occurrences", lambda o: o["doc_id"].cast("string")), ",").alias("occurrences"))


@query(
    "keyword_status",
    """WITH c AS (SELECT * FROM (VALUES (1, 'src0', 'en'), (2, 'src1', 'fr'), (3, 'src2', 'src2'), (4, 'nothing', 'x')) v(i, term, target)),
       f AS (SELECT term, COUNT(*) AS n, COUNT(DISTINCT lang) AS k, arg_min(lang, doc_id) AS first FROM c JOIN documents d ON d.source = c.term GROUP BY 1)
       SELECT c.term, coalesce(n, 0) AS n, coalesce(k, 0) AS n_translations, CASE WHEN n IS NULL THEN 'unmatched' WHEN first <> target THEN 'conflict' WHEN k > 1 THEN 'ambiguous' ELSE 'consistent' END AS status FROM c LEFT JOIN f ON c.term = f.term""",
)
def keyword_status(t):
    """History status of four candidates: sources stand for terms, languages for translations."""
    docs = t("documents")
    cand = docs.sparkSession.createDataFrame([("src0", "en"), ("src1", "fr"), ("src2", "src2"), ("nothing", "x")], "term string, target string")
    found = docs.select(F.col("source").alias("term"), F.col("doc_id").alias("occurrence_order"), "source", F.col("lang").alias("translation"), F.lit("exact").alias("match_kind"))
    return K.history_status(cand, found.join(cand.select("term"), "term", "left_semi")).select("term", "n", "n_translations", "status")


@query(
    "glossary_hits",
    """SELECT doc_id, term, kind FROM documents, (SELECT * FROM (VALUES ('Licensed', 'normalize'), ('MIT', 'preserve'), ('token', 'non_translatable')) v(term, kind)) WHERE contains(text, term)""",
)
def glossary_hits(t):
    """Glossary terms in texts; equal terms by priority of their section."""
    docs = t("documents")
    terms = docs.sparkSession.createDataFrame([("Licensed", "normalize"), ("MIT", "preserve"), ("MIT", "non_translatable"), ("token", "non_translatable")], "term string, kind string")
    return K.glossary_hits(docs, terms, "doc_id", "text")


@query(
    "glossary_merge_plan",
    """WITH c AS (SELECT doc_id AS ordinal, CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS term, lang AS target, (doc_id % 10) / 10.0 AS confidence FROM documents), g AS (SELECT 'src1' AS term, 'en' AS target),
       a AS (SELECT term, arg_min(target, ordinal) AS first, MIN(ordinal) AS at FROM c WHERE term <> '' AND confidence >= 0.6 GROUP BY 1)
       SELECT action, COUNT(*) AS n FROM (SELECT CASE WHEN c.term = '' THEN 'empty' WHEN confidence < 0.6 THEN 'low_confidence' WHEN g.target IS NULL AND c.ordinal = a.at THEN 'accept' WHEN coalesce(g.target, a.first) = c.target THEN 'duplicate' ELSE 'conflict' END AS action
         FROM c LEFT JOIN g ON g.term = c.term LEFT JOIN a ON a.term = c.term) GROUP BY 1""",
)
def glossary_merge_plan(t):
    """What becomes of candidates, in order."""
    d = t("documents").select(F.col("doc_id").alias("ordinal"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("source")).alias("term"), F.col("lang").alias("target"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"))
    glossary = d.sparkSession.createDataFrame([("src1", "en", 0)], "term string, target string, priority int")
    return K.merge_plan(d, glossary).groupBy("action").agg(F.count("*").alias("n"))


@query(
    "keyword_plurals",
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS term FROM documents), l AS (SELECT term, lower(term) AS low, length(term) AS n FROM w WHERE length(term) > 2), p AS (SELECT *, regexp_matches(low, 's$') AND NOT regexp_matches(low, '(ss|us|is)$') AND n > 3 AS plural FROM l),
        f AS (SELECT term, low, CASE WHEN low LIKE '%ies' AND n > 3 THEN term[:-4] || 'y' WHEN regexp_matches(low, '(ses|xes|zes|ches|shes)$') THEN term[:-3] WHEN plural THEN term[:-2] END AS form FROM p
          UNION ALL SELECT term, low, CASE WHEN regexp_matches(low, '[^aeiou]y$') THEN term[:-2] || 'ies' WHEN regexp_matches(low, '(s|x|z|ch|sh)$') THEN term || 'es' ELSE term || 's' END FROM p WHERE NOT plural)
        SELECT term, form FROM f WHERE form IS NOT NULL AND lower(form) <> low""",
)
def keyword_plurals(t):
    """Other-number forms of all words of the documents."""
    words = t("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("term")).distinct()
    return words.select("term", F.explode(T.plural_forms(F.col("term"))).alias("form"))
