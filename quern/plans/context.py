"""Queries on ordered text units: context, runs, segments, batches, paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import context as C
from quern.sources import readers

from .book import query


@query(
    "context_window",
    """SELECT conv_id, turn, md5(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS context FROM conversations""",
)
def context_window(t):
    """Each turn with the ones before and after it."""
    out = C.context_window(t("conversations"), ["conv_id"], ["turn"], "text")
    return out.select("conv_id", "turn", F.md5("context").alias("context"))


@query(
    "context_neighbours",
    """SELECT conv_id, turn, length(LAG(text) OVER w) AS previous, length(LEAD(text) OVER w) AS next, ROW_NUMBER() OVER w AS ordinal FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def context_neighbours(t):
    """Lengths of the turns around, and the ordinal."""
    out = C.neighbours(t("conversations"), ["conv_id"], ["turn"], "text")
    return out.select("conv_id", "turn", F.length("previous").cast("long").alias("previous"), F.length("next").cast("long").alias("next"), F.col("ordinal").cast("long").alias("ordinal"))


@query(
    "context_runs",
    """SELECT user_id, run, MIN(event_type) AS event_type, COUNT(*) AS n FROM (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type THEN 1 ELSE 0 END AS new FROM events)) GROUP BY 1, 2""",
)
def context_runs(t):
    """Contiguous runs of one event type per user."""
    out = C.runs(t("events"), ["user_id"], ["ts", "event_id"], "event_type")
    return out.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query(
    "context_local",
    """WITH r AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN LAG(event_id % 7 < 5) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> (event_id % 7 < 5) THEN 1 ELSE 0 END AS new FROM events)),
       n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS p, COUNT(*) OVER (PARTITION BY user_id, run) AS t FROM r)
       SELECT event_id, least(p - 1, 3) AS n_before, least(t - p, 2) AS n_after, p - 1 > 3 AS before_cut, t - p > 2 AS after_cut FROM n""",
)
def context_local(t):
    """Context of 3 before and 2 after that stops where the block changes."""
    e = t("events").withColumn("block", F.col("event_id") % 7 < 5)
    out = C.local_context(e, ["user_id"], ["ts", "event_id"], "block", "event_type", 3, 2)
    return out.select("event_id", F.size("before").cast("long").alias("n_before"), F.size("after").cast("long").alias("n_after"), "before_cut", "after_cut")


@query("context_segments", "SELECT source, s AS segment, COUNT(*) AS n, MIN(doc_id) AS first, MAX(doc_id) AS last FROM (SELECT source, doc_id, CAST((ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 4 AS BIGINT) AS s FROM documents) GROUP BY 1, 2")
def context_segments(t):
    """Segments of four rows per file."""
    out = C.segments(t("documents").select("source", "doc_id"), ["source"], ["doc_id"], 4)
    return out.groupBy("source", "segment").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query(
    "context_block_occurrence",
    """WITH r AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type THEN 1 ELSE 0 END AS new FROM events))
       SELECT event_id, DENSE_RANK() OVER (PARTITION BY user_id, event_type ORDER BY run) AS occurrence FROM r""",
)
def context_block_occurrence(t):
    """Which opening of its block each row is in."""
    out = C.block_occurrences(t("events"), ["user_id"], ["ts", "event_id"], "event_type")
    return out.select("event_id", F.col("occurrence").cast("long").alias("occurrence"))


@query(
    "context_greedy_batches",
    """WITH RECURSIVE o AS (SELECT source, n_chars AS c, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) AS i, doc_id FROM documents),
       g AS (SELECT source, i, doc_id, CAST(0 AS BIGINT) AS batch, 1 AS items, c AS used FROM o WHERE i = 1
         UNION ALL SELECT o.source, o.i, o.doc_id, CASE WHEN g.items >= 8 OR g.used + o.c > 12000 THEN g.batch + 1 ELSE g.batch END, CASE WHEN g.items >= 8 OR g.used + o.c > 12000 THEN 1 ELSE g.items + 1 END, CASE WHEN g.items >= 8 OR g.used + o.c > 12000 THEN o.c ELSE g.used + o.c END
         FROM g JOIN o ON o.source = g.source AND o.i = g.i + 1)
       SELECT doc_id, batch FROM g""",
)
def context_greedy_batches(t):
    """Batches of at most 8 documents and 12,000 characters."""
    out = C.greedy_batches(t("documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars", 8, 12_000)
    return out.select("doc_id", "batch")


@query("context_paragraphs", r"SELECT doc_id, CAST(ordinal - 1 AS BIGINT) AS ordinal, length(trim(regexp_replace(p, '\s*\n\s*', ' ', 'g'))) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS ordinal FROM documents) WHERE length(trim(p)) >= 6")
def context_paragraphs(t):
    """Lines of a document as paragraphs of six characters or more."""
    docs = t("documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return readers.paragraphs(docs, "doc_id", "text").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.length("text").cast("long").alias("n"))


@query(
    "context_even_sample",
    """WITH o AS (SELECT source, doc_id, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, COUNT(*) OVER (PARTITION BY source) AS n FROM documents)
       SELECT DISTINCT source, doc_id FROM o, range(0, 5) r(k) WHERE n <= 5 OR i = (k * (n - 1)) // 4""",
)
def context_even_sample(t):
    """Five documents of each source at even distances."""
    return C.even_sample(t("documents").select("source", "doc_id"), ["doc_id"], 5, ["source"])


@query("context_slice", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25 OFFSET 40")
def context_slice(t):
    """Rows 40 to 64 by id."""
    return t("documents").select("doc_id").orderBy("doc_id").offset(40).limit(25)


@query(
    "context_budget_lines",
    """SELECT doc_id, len(k) AS n, list_sum([length(x) for x in k]) AS chars FROM (SELECT doc_id, list_reduce([CAST([] AS VARCHAR[])] || [[x] for x in string_split(text, chr(10))], lambda a, b: CASE WHEN length(array_to_string(a || b, ' ')) <= 300 THEN a || b WHEN len(a) = 0 THEN [b[1][1:300]] ELSE a END) AS k FROM documents)""",
)
def context_budget_lines(t):
    """Lines of each document that fit 300 characters; one that does not fit is passed over."""
    out = t("documents").select("doc_id", C.fit_lines(F.split("text", "\n"), 300).alias("k"))
    return out.select("doc_id", F.size("k").cast("long").alias("n"), F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query(
    "text_functions",
    r"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS compact, CASE WHEN length(text) > 60 THEN text[1:57] || '...' ELSE text END AS short, regexp_matches(text, '[A-Za-z]') AS english,
          trim(lower(regexp_replace(text, '[^\p{L}\p{N}]+', '_', 'g')), '_') AS slug, sha1(text)[1:8] AS digest, len(list_distinct([text[i:i+2] for i in range(1, length(text) - 1)])) AS n_trigrams FROM documents""",
)
def text_functions(t):
    """Compacting, cutting, tests, slugs, digests, trigrams."""
    x = F.col("text")
    return t("documents").select(
        "doc_id", F.md5(T.compact(x)).alias("compact"), T.truncate(x, 60).alias("short"), T.english_like(x).alias("english"), T.slug(x).alias("slug"),
        F.substring(F.sha1(x), 1, 8).alias("digest"), F.size(T.trigrams(x)).cast("long").alias("n_trigrams"),
    )


@query("text_identity", "SELECT doc_id, source || ':' || lang || CASE WHEN doc_id % 3 > 0 THEN '#' || (doc_id % 3 + 1) ELSE '' END || ':' || doc_id || ':' || sha1(text)[1:8] AS unit_id FROM documents")
def text_identity(t):
    """Natural keys."""
    return t("documents").select("doc_id", T.identity(F.col("source"), F.col("lang"), F.col("doc_id") % 3 + 1, F.col("doc_id"), F.col("text")).alias("unit_id"))


@query("text_non_translatable", r"""WITH w AS (SELECT word, trim(word, ' ') AS p FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents))
        SELECT md5(word) AS word, COUNT(*) AS n FROM w WHERE p = '' OR NOT regexp_matches(p, '[A-Za-z0-9\x{4e00}-\x{9fff}]') OR regexp_full_match(p, '\{[^}]+\}|[\p{L}\p{N}\p{M}_.-]+\.[\p{L}\p{N}\p{M}_]+|[+-](?i:[IVXLCDM]+)|(?i:[IVXLCDM]{2,})|(%[A-Za-z]|[%:\s,./0-9-])+|[A-Za-z_][A-Za-z0-9_]*_(name|label|id)|[A-Za-z]\.?(\s+[A-Za-z]\.?)+')
        GROUP BY word""")
def text_non_translatable(t):
    """Words that need no translation."""
    words = t("documents").select(F.explode(F.split("text", " ")).alias("word"))
    return words.filter(T.non_translatable(F.col("word"))).groupBy("word").agg(F.count("*").alias("n")).withColumn("word", F.md5("word"))


@query("text_line_totals", "SELECT lang, COUNT(*) AS lines, CAST(SUM(length(l)) AS BIGINT) AS chars FROM (SELECT lang, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY lang")
def text_line_totals(t):
    """Lines and characters per language."""
    return t("documents").select("lang", F.explode(F.split("text", "\n")).alias("l")).groupBy("lang").agg(F.count("*").alias("lines"), F.sum(F.length("l")).alias("chars"))
