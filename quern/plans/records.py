"""Queries on records: terms, candidates, findings, gates, caches and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import quality as Q
from quern.operators import records as R
from quern.operators import relations

from .book import query
from .quality import _FOUND, subjects

_TERMS = ("the", "Licensed", "[name]", "que", "secret")


@query(
    "missing_terms",
    r"""WITH l AS (SELECT doc_id, CAST(k - 1 AS INT) AS line, s FROM (SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))),
        t AS (SELECT doc_id, line, replace(s, ' in ', ' [name] ') AS s, CASE (doc_id + line) % 3 WHEN 0 THEN replace(replace(replace(s, ' in ', ' [name!t] '), ' the ', ' '), ' que ', ' ') WHEN 1 THEN replace(s, 'Licensed', 'Free') ELSE '' END AS t FROM l),
        w AS (SELECT doc_id, line, [x FOR x IN [CASE WHEN regexp_matches(s, '(^|[^A-Za-z0-9_''-])the($|[^A-Za-z0-9_''-])') AND NOT regexp_matches(t, '(^|[^A-Za-z0-9_''-])the($|[^A-Za-z0-9_''-])') THEN 'the' END, CASE WHEN contains(s, 'Licensed') AND NOT contains(t, 'Licensed') THEN 'Licensed' END,
          CASE WHEN contains(s, '[name]') AND NOT contains(t, '[name]') AND NOT contains(t, '[name!') THEN '[name]' END, CASE WHEN regexp_matches(s, '(^|[^A-Za-z0-9_''-])que($|[^A-Za-z0-9_''-])') AND NOT regexp_matches(t, '(^|[^A-Za-z0-9_''-])que($|[^A-Za-z0-9_''-])') THEN 'que' END, CASE WHEN contains(s, 'secret') AND NOT contains(t, 'secret') THEN 'secret' END] IF x IS NOT NULL] AS m FROM t WHERE s <> '' AND t <> '')
        SELECT doc_id, line, array_to_string(m, ',') AS missing FROM w WHERE len(m) > 0""",
)
def missing_terms(t):
    """Terms that the translation of a line lost."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    r = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    k = (F.col("doc_id") + F.col("line")) % 3
    s = F.col("s")
    out = F.when(k == 0, r(r(r(s, " in ", " [name!t] "), " the ", " "), " que ", " ")).when(k == 1, r(s, "Licensed", "Free")).otherwise("")
    rows = lines.select("doc_id", "line", r(s, " in ", " [name] ").alias("source"), out.alias("translation"))
    return rows.withColumn("m", R.missing_terms(rows, list(_TERMS))).filter(F.size("m") > 0).select("doc_id", "line", F.array_join("m", ",").alias("missing"))


@query(
    "candidate_sections",
    """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text ELSE source END AS s, CASE WHEN doc_id % 5 = 0 THEN upper(source) ELSE lang END AS t, doc_id % 10 / 10.0 AS k, CASE WHEN doc_id % 7 > 0 THEN lang END AS e, CASE doc_id % 4 WHEN 0 THEN 'conflict' WHEN 1 THEN 'ambiguous' ELSE 'consistent' END AS h FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL),
        f AS (SELECT doc_id, lower(trim(regexp_replace(s, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS same, length(trim(regexp_replace(s, '\\s+', ' ', 'g'))) > 40 AS long, k < 0.6 AS low, e IS NULL AS bare, h IN ('conflict', 'ambiguous') AS odd FROM c)
        SELECT CASE WHEN same THEN 'preserve' ELSE 'normalize' END AS section, array_to_string([x FOR x IN [CASE WHEN same THEN 'same_as_source' END, CASE WHEN long THEN 'long_source' END, CASE WHEN low THEN 'low_confidence' END, CASE WHEN bare THEN 'no_evidence' END, CASE WHEN odd THEN 'history_conflict' END] IF x IS NOT NULL], ',') AS warnings, COUNT(*) AS n FROM f GROUP BY ALL""".replace("\\\\s", "\\s"),
)
def candidate_sections(t):
    """Sections and warnings of candidates."""
    d, i = t("documents").filter("source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL"), F.col("doc_id")
    rows = d.select(F.when(i % 9 == 0, F.col("text")).otherwise(F.col("source")).alias("source"), F.when(i % 5 == 0, F.upper("source")).otherwise(F.col("lang")).alias("target"), (i % 10 / 10.0).alias("confidence"), F.when(i % 7 > 0, F.col("lang")).alias("evidence"), F.when(i % 4 == 0, "conflict").when(i % 4 == 1, "ambiguous").otherwise("consistent").alias("status"))
    return R.classify_candidates(rows).groupBy("section", F.array_join("warnings", ",").alias("warnings")).agg(F.count("*").alias("n"))


@query("ui_noise", "SELECT page_id FROM pages WHERE url IS NOT NULL AND (lower(regexp_extract(url, '://[a-z]*[.]?([A-Za-z]+)', 1)) IN ('thing', 'menu') OR contains(lower(url), '/fr/') OR regexp_matches(regexp_extract(url, '://[a-z]*[.]?([A-Za-z]+)', 1), '^[A-Za-z]{1,3}$')) AND regexp_extract(url, '://[a-z]*[.]?([A-Za-z]+)', 1) <> ''")
def ui_noise(t):
    """Pages whose name looks like a label on a screen."""
    name = F.regexp_extract("url", "://[a-z]*[.]?([A-Za-z]+)", 1)
    return t("pages").filter(R.ui_noise(name, F.col("url"), ["thing", "menu"], ["/fr/"])).select("page_id")


@query("finding_contract", f"{_FOUND} SELECT problem, COUNT(*) AS n FROM (SELECT CASE WHEN line % 10 = 1 THEN 'no_id' WHEN line % 10 = 2 THEN 'bad_reason' WHEN line % 10 = 3 THEN 'bad_severity' WHEN line % 10 = 4 THEN 'bad_disposition' WHEN line % 10 = 5 AND reason_code = 'quality.structure.unclosed_delimiters' THEN 'mild_blocker' ELSE 'fine' END AS problem FROM f WHERE reason_code IS NOT NULL) GROUP BY 1")
def finding_contract(t):
    """Findings that were damaged by their lines' numbers, and what is wrong with them."""
    k = F.col("line") % 10
    f = Q.find(subjects(t)).withColumns({"finding_id": F.when(k != 1, F.col("finding_id")), "reason_code": F.when(k == 2, "other").otherwise(F.col("reason_code")), "severity": F.when(k == 3, "dire").when(k == 5, "medium").otherwise(F.col("severity")), "disposition": F.when(k == 4, "maybe").otherwise(F.col("disposition"))})
    return f.groupBy(F.coalesce(R.finding_problems(f), F.lit("fine")).alias("problem")).agg(F.count("*").alias("n"))


@query("unmatched_subjects", "SELECT 'quality.collection.unmatched_subject' AS reason_code, '{\"matched\":' || COUNT(*) FILTER (l.doc_id IS NOT NULL) || ',\"subjects\":' || COUNT(*) || ',\"unmatched\":' || COUNT(*) FILTER (l.doc_id IS NULL) || '}' AS evidence, COUNT(*) FILTER (l.doc_id IS NULL) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def unmatched_subjects(t):
    """Documents without a label, as one finding."""
    return R.unmatched_subjects(t("documents").select(F.col("doc_id").alias("item_id")), t("labels").select(F.col("doc_id").alias("item_id")))


@query("review_readiness", "SELECT conv_id, COUNT(*) AS n, COUNT(*) FILTER (turn % 5 = 4) AS pending, CASE WHEN COUNT(*) FILTER (turn % 5 = 4) = 0 OR conv_id % 3 = 0 THEN 'ready' ELSE 'pending' END AS state FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1")
def review_readiness(t):
    """Conversations whose turns are all reviewed, or that may go without."""
    items = t("conversations").filter("conv_id IS NOT NULL").select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("item_id"), F.when(F.col("turn") % 5 == 4, "pending").otherwise("done").alias("status"))
    return R.readiness(items, "conv_id", F.col("conv_id") % 3 == 0)


@query(
    "record_problems",
    """WITH r AS (SELECT doc_id AS record_id, CASE WHEN doc_id % 6 = 0 THEN doc_id + 1 WHEN doc_id % 17 = 0 THEN -doc_id - 1 ELSE doc_id END AS o, CASE WHEN doc_id % 5 = 0 THEN 'x' || coalesce(text, '') ELSE text END AS s FROM documents), m AS (SELECT o, MIN(record_id) AS first FROM r GROUP BY 1)
        SELECT coalesce(CASE WHEN d.doc_id IS NULL THEN 'unknown_occurrence' WHEN record_id <> first THEN 'duplicate' WHEN trim(regexp_replace(coalesce(s, ''), '\\s+', ' ', 'g')) <> trim(regexp_replace(coalesce(d.text, ''), '\\s+', ' ', 'g')) THEN 'source_changed' END, 'fine') AS problem, COUNT(*) AS n FROM r JOIN m USING (o) LEFT JOIN documents d ON d.doc_id = r.o GROUP BY 1""".replace("\\\\s", "\\s"),
)
def record_problems(t):
    """Records against the occurrences that they name."""
    i, d = F.col("doc_id"), t("documents")
    records = d.select(i.alias("record_id"), F.when(i % 6 == 0, i + 1).when(i % 17 == 0, -i - 1).otherwise(i).alias("occurrence_id"), F.when(i % 5 == 0, F.concat(F.lit("x"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("source"))
    rows = R.record_problems(records, d.select(i.alias("occurrence_id"), F.col("text").alias("source")))
    return rows.groupBy(F.coalesce("problem", F.lit("fine")).alias("problem")).agg(F.count("*").alias("n"))


@query("embedding_cache", "WITH d AS (SELECT doc_id, coalesce(text, '') AS h FROM documents), c AS (SELECT DISTINCT h FROM d WHERE doc_id % 3 = 0) SELECT 'hit' AS kind, COUNT(*) AS n, COUNT(DISTINCT h) AS n_texts FROM d WHERE h IN (SELECT h FROM c) UNION ALL SELECT 'miss', COUNT(*), COUNT(DISTINCT h) FROM d WHERE h NOT IN (SELECT h FROM c)")
def embedding_cache(t):
    """Texts that a cache of every third document knows, and those that are to be embedded."""
    d = t("documents").select("doc_id", "text")
    cache = d.filter("doc_id % 3 = 0").select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256")).distinct().withColumn("embedding", F.array(F.lit(0.0)))
    hits, misses = R.cache_split(d, cache)
    known = hits.agg(F.lit("hit").alias("kind"), F.count("*").alias("n"), F.count_distinct("sha256").alias("n_texts"))
    return known.unionByName(misses.agg(F.lit("miss").alias("kind"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("n_texts")))


@query("registry_refresh", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_name || ' old' ELSE c_name END AS c_name_before, c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AS is_there, CASE WHEN c_custkey % 11 = 0 THEN CASE WHEN c_custkey % 13 = 0 THEN 'none' ELSE 'added' END WHEN c_custkey % 13 = 0 THEN 'missing' WHEN c_custkey % 7 = 0 THEN 'changed' ELSE 'same' END AS change FROM customer WHERE NOT (c_custkey % 11 = 0 AND c_custkey % 13 = 0)")
def registry_refresh(t):
    """Customers as a registry that is looked at again; notes stay."""
    c, k = t("customer"), F.col("c_custkey")
    before = F.when(k % 7 == 0, F.concat("c_name", F.lit(" old"))).otherwise(F.col("c_name"))
    old = c.filter(k % 11 != 0).select("c_custkey", before.alias("c_name"), "c_nationkey", F.concat(F.lit("note "), "c_name").alias("note"))
    rows = R.refresh(old, c.filter(k % 13 != 0), "c_custkey", ["c_name", "c_nationkey"], ["note"])
    named = rows.join(c.select("c_custkey", before.alias("c_name_before")), "c_custkey")
    return named.select("c_custkey", "c_name_before", (F.col("change").isin("same", "changed")).alias("is_there"), "change")


@query("registry_order", "SELECT s_suppkey, row_number() OVER (ORDER BY lower(s_name) DESC NULLS LAST, s_suppkey) AS place FROM supplier")
def registry_order(t):
    """Suppliers by name, case aside, from the last."""
    return R.registry_order(t("supplier"), "s_name", "s_suppkey", descending=True).select("s_suppkey", F.col("place").cast("long").alias("place"))


@query(
    "similarity_edges",
    """WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1),
        p AS (SELECT CAST(a.label AS VARCHAR) AS l, CAST(b.label AS VARCHAR) AS r, sum(a.x * b.x) / (any_value(na.n) * any_value(nb.n)) AS score FROM m a JOIN m b ON a.i = b.i AND a.label::VARCHAR < b.label::VARCHAR JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY 1, 2),
        g AS (SELECT * FROM p WHERE score > 0), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, l, r) AS rank, (SELECT greatest(0.55, quantile_cont(score, 0.7)) FROM g) AS cut, (SELECT COUNT(DISTINCT label) FROM embeddings) AS people FROM g)
        SELECT l AS "left", r AS "right", ROUND(score, 6) AS score FROM k WHERE (score >= cut AND rank <= greatest(people - 1, 3)) OR rank <= 3""",
)
def similarity_edges(t):
    """Labels whose mean vectors are most alike."""
    e = t("embeddings")
    flat = e.select(F.col("label").cast("string").alias("label"), F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norms = flat.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    a, b = flat.toDF("left", "i", "x"), flat.toDF("right", "i", "y")
    dots = a.join(b, "i").filter("left < right").groupBy("left", "right").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scores = dots.join(norms.toDF("left", "nl"), "left").join(norms.toDF("right", "nr"), "right").select("left", "right", (F.col("dot") / (F.col("nl") * F.col("nr"))).alias("score"))
    people = e.select("label").distinct().count()
    return relations.select_edges(scores, people=people, floor=0.55, quantile=0.7).select("left", "right", F.round("score", 6).alias("score"))
