"""Queries on scripts: the lines of each document become script lines of six forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.sources import lexer as L

from .book import query

_SAID = r"""x AS (SELECT doc_id, k, 'Said ' || translate(said, '"''\', '') AS s, (doc_id + k) % 6 AS m FROM (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS k, unnest(p) AS said FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))"""
_CN = "猫"


def script_lines(t):
    """``(path, line, text)``: translations with their sources, old and new strings, literals over several lines, definitions, open ones."""
    put = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    def form(said, at):
        s, k = F.concat(F.lit("Said "), F.translate(said, "\"'\\", "")), at.cast("string")
        forms = [
            F.array(put("translate zh b", (at % 3).cast("string"), ":"), put('    # e "', s, '"'), put('    e "', s, '"')),
            F.array(put('    old "', s, '"'), put(f'    new "{_CN} ', s, '"')),
            F.array(put("    e '''", s), F.lit("it's \"more\" # no comment"), F.lit("end''' with fade")),
            F.array(put("define e", k, ' = Character("Name")'), put("    e", k, ' happy "', s, '" # "not this"')),
            F.array(F.lit('    voice "a.ogg"'), put('    menu "', s, " \\"), F.lit('joined"')),
            F.array(put('    "open ', s), put('    x = f(name="', s, "\", other=r'raw\\n')")),
        ]
        m, out = (F.col("doc_id") + at) % 6, forms[0]
        for n in range(1, 6):
            out = F.when(m == n, forms[n]).otherwise(out)
        return F.struct(at.alias("k"), out.alias("lines"))

    # Whole texts meet, before their lines become longer.
    texts = t("documents").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    formed = F.flatten(F.transform("texts", lambda x: F.transform(F.split(x, "\n"), form)))
    files = texts.select("doc_id", F.flatten(F.transform(F.array_sort(formed), lambda r: r["lines"])).alias("lines"))
    return files.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.posexplode("lines").alias("line", "text"))


_FILE = rf"""{_SAID}, f AS (SELECT doc_id, string_agg(CASE m WHEN 0 THEN 'translate zh b' || k % 3 || ':' || chr(10) || '    # e "' || s || '"' || chr(10) || '    e "' || s || '"' WHEN 1 THEN '    old "' || s || '"' || chr(10) || '    new "{_CN} ' || s || '"'
    WHEN 2 THEN '    e ''''''' || s || chr(10) || 'it''s "more" # no comment' || chr(10) || 'end'''''' with fade' WHEN 3 THEN 'define e' || k || ' = Character("Name")' || chr(10) || '    e' || k || ' happy "' || s || '" # "not this"'
    WHEN 4 THEN '    voice "a.ogg"' || chr(10) || '    menu "' || s || ' \' || chr(10) || 'joined"' ELSE '    "open ' || s || chr(10) || '    x = f(name="' || s || '", other=r''raw\n'')' END, chr(10) ORDER BY k) AS body FROM x GROUP BY doc_id)"""


@query(
    "script_literals",
    rf"""WITH {_FILE}, g AS (SELECT doc_id, [y FOR y IN regexp_extract_all(body, '(?s)''''''.*?''''''|"(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|"[^\n]*|#[^\n]*') IF y[1] <> '#'] AS y FROM f),
        h AS (SELECT doc_id, y, [CASE WHEN starts_with(z, '''''''') THEN z[4:-4] ELSE replace(z[2:-2], '\' || chr(10), '') END FOR z IN y IF length(z) > 1 AND right(z, 1) IN ('"', '''')] AS b FROM g)
        SELECT 'doc' || doc_id AS path, CAST(len(y) AS BIGINT) AS n_literals, CAST(len(y) - len(b) AS BIGINT) AS n_open, CAST(list_sum([length(z) FOR z IN b]) AS BIGINT) AS chars, md5(array_to_string(b, chr(31))) AS bodies FROM h WHERE len(y) > 0""",
)
def script_literals(t):
    """String literals of each script, by the automaton."""
    rows = L.literals(script_lines(t), chunk=50)
    body = F.when(F.col("closed"), F.col("body"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("closed"), F.struct("line", "first", "body")))), lambda x: x["body"]), "\x1f")
    return rows.groupBy("path").agg(F.count("*").alias("n_literals"), F.count_if(~F.col("closed")).alias("n_open"), F.sum(F.length(body)).cast("long").alias("chars"), F.md5(listed.cast("binary")).alias("bodies"))


_PLACED = f"""{_SAID}, y AS (SELECT *, coalesce(sum([3, 2, 3, 2, 3, 2][m + 1]) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, bool_or(m = 0) OVER (PARTITION BY doc_id) AS tr,
      count(*) FILTER (WHERE m = 0) OVER (PARTITION BY doc_id ORDER BY k) AS opening, last_value(CASE WHEN m = 0 THEN 'b' || k % 3 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM x),
    z AS (SELECT doc_id, base + 2 AS line, 1 AS place, opening, b, 'translatable' AS c, true AS counts, 'e' AS speaker, NULL AS name FROM y WHERE m = 0
      UNION ALL SELECT doc_id, base, 1, opening, b, CASE WHEN tr THEN 'explicitly_excluded' ELSE 'translatable' END, NOT tr, NULL, NULL FROM y WHERE m = 1
      UNION ALL SELECT doc_id, base + 1, 1, opening, b, CASE WHEN tr THEN 'already_translated' ELSE 'unsupported' END, tr, NULL, NULL FROM y WHERE m = 1
      UNION ALL SELECT doc_id, base, 1, opening, b, 'translatable', true, 'e', NULL FROM y WHERE m = 2
      UNION ALL SELECT doc_id, base, 1, opening, b, 'explicitly_excluded', false, NULL, NULL FROM y WHERE m = 3 AND tr
      UNION ALL SELECT doc_id, base, 1, opening, b, 'explicitly_excluded', false, NULL, NULL FROM y WHERE m = 3 AND NOT tr
      UNION ALL SELECT doc_id, base + 1, 1, opening, b, 'translatable', true, 'e' || k, 'Name' FROM y WHERE m = 3
      UNION ALL SELECT doc_id, base, 1, opening, b, 'explicitly_excluded', false, NULL, NULL FROM y WHERE m = 4
      UNION ALL SELECT doc_id, base + 1, 1, opening, b, 'translatable', true, NULL, NULL FROM y WHERE m = 4
      UNION ALL SELECT doc_id, base, 1, opening, b, 'parse_error', false, NULL, NULL FROM y WHERE m = 5
      UNION ALL SELECT doc_id, base + 1, 1, opening, b, CASE WHEN tr THEN 'explicitly_excluded' ELSE 'translatable' END, NOT tr, NULL, NULL FROM y WHERE m = 5
      UNION ALL SELECT doc_id, base + 1, 2, opening, b, CASE WHEN tr THEN 'explicitly_excluded' ELSE 'unknown' END, false, NULL, NULL FROM y WHERE m = 5),
    q AS (SELECT *, coalesce(b, '_global') AS block, CASE WHEN counts THEN row_number() OVER (PARTITION BY doc_id, opening, counts ORDER BY line, place) END AS i, CASE WHEN counts THEN dense_rank() OVER (PARTITION BY doc_id, coalesce(b, '_global'), counts ORDER BY opening) END AS o FROM z)"""


@query("script_inventory", f"WITH {_PLACED} SELECT 'doc' || doc_id AS path, c AS classification, COUNT(*) AS n FROM q GROUP BY ALL")
def script_inventory(t):
    """How many strings of each script are in which class."""
    return L.inventory(script_lines(t), chunk=50).groupBy("path", "classification").agg(F.count("*").alias("n"))


@query("script_tasks", f"WITH {_PLACED} SELECT 'doc' || doc_id AS path, CAST(line AS BIGINT) AS line, block, CAST(o AS INT) AS occurrence, CAST(i AS INT) AS index, speaker, name AS speaker_name FROM q WHERE c = 'translatable'")
def script_tasks(t):
    """What is to be translated, where it stands and who says it."""
    return L.pending_tasks(script_lines(t), chunk=50).select("path", "line", "block", "occurrence", "index", "speaker", "speaker_name")


@query("script_progress", f"WITH {_PLACED} SELECT 'doc' || doc_id AS path, COUNT(*) AS candidates, COUNT(*) FILTER (c = 'translatable') AS pending, COUNT(*) FILTER (c = 'already_translated') AS translated, COUNT(*) FILTER (c = 'parse_error') AS parse_errors FROM q GROUP BY 1")
def script_progress(t):
    """What is done and what is open in each script."""
    return L.progress(script_lines(t), chunk=50)
