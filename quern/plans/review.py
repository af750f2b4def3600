"""Queries on decisions, merged results and digests of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import decisions as D
from quern.operators import lineage as N

from .book import query

# -- decisions: users are candidates, their events a log

_LOG = """c AS (SELECT user_id AS id, 'u' || user_id AS candidate_id, CASE WHEN user_id % 4 = 3 THEN NULL ELSE 't' || user_id % 90 END AS own, user_id % 4 = 3 AS ambiguous, ['t' || user_id % 90, 't' || (user_id + 1) % 90] AS options, CASE WHEN user_id % 13 = 0 THEN NULL ELSE 'text ' || user_id END AS translation, user_id % 5 AS src FROM (SELECT DISTINCT user_id FROM events)),
  l AS (SELECT 'u' || user_id AS candidate_id, user_id AS id, event_id AS ordinal, CASE event_id % 7 WHEN 0 THEN 'accept' WHEN 1 THEN 'override_translation' WHEN 2 THEN 'override_translation' WHEN 3 THEN 'split_lineage' WHEN 4 THEN 'merge_lineage' WHEN 5 THEN CASE WHEN event_id % 3 = 0 THEN 'reject' ELSE 'accept' END ELSE 'nod' END AS action,
    event_type AS reviewer, event_id % 3 > 0 AS human, CASE WHEN event_id % 2 = 0 THEN 't' || (user_id + event_id // 2 % 3) % 90 END AS told, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'by ' || event_id END AS text, CASE WHEN event_id % 17 = 0 THEN '' ELSE 'line' END AS lineage_id, CASE WHEN event_id % 9 < 6 THEN ['r' || event_id % 9] ELSE [] END AS related FROM events),
  f AS (SELECT l.*, c.own, c.ambiguous, c.translation, CASE WHEN c.ambiguous THEN told ELSE c.own END AS res, CASE WHEN action = 'nod' THEN 'unknown_action' WHEN action IN ('accept', 'override_translation') AND c.translation IS NULL THEN 'no_record'
      WHEN action = 'accept' AND c.ambiguous AND NOT human THEN 'needs_human' WHEN action = 'accept' AND c.ambiguous AND NOT coalesce(list_contains(c.options, told), false) THEN 'not_an_option'
      WHEN action = 'accept' AND c.ambiguous AND (CASE WHEN told = c.options[1] THEN c.src ELSE (l.id + 1) % 5 END) <> c.src THEN 'source_differs' WHEN action = 'accept' AND NOT c.ambiguous AND told IS NOT NULL AND told <> c.own THEN 'other_target'
      WHEN action = 'override_translation' AND trim(text) = '' THEN 'empty_text' WHEN action IN ('split_lineage', 'merge_lineage') AND lineage_id = '' THEN 'no_lineage' WHEN action = 'merge_lineage' AND len(related) = 0 THEN 'nothing_to_merge' WHEN action = 'split_lineage' AND len(related) > 0 THEN 'split_with_relations' END AS fixed
    FROM l JOIN c USING (candidate_id)),
  g AS (SELECT candidate_id, min(ordinal) AS first, arg_min(action, ordinal) AS verdict, arg_min(res, ordinal) AS res, arg_min(reviewer, ordinal) AS reviewer FROM f WHERE fixed IS NULL AND action IN ('accept', 'reject') GROUP BY 1),
  h AS (SELECT f.candidate_id, ordinal, action, f.reviewer, f.text, f.translation, f.res, CASE WHEN g.first < ordinal THEN CASE verdict WHEN 'accept' THEN 'accepted' ELSE 'rejected' END ELSE 'pending' END AS before, CASE WHEN g.first <= ordinal THEN CASE verdict WHEN 'accept' THEN 'accepted' ELSE 'rejected' END ELSE 'pending' END AS after, fixed FROM f LEFT JOIN g USING (candidate_id)),
  k AS (SELECT *, coalesce(fixed, CASE WHEN action IN ('accept', 'reject') AND before <> 'pending' THEN 'not_pending' WHEN action = 'override_translation' AND before = 'rejected' THEN 'rejected_before' END) AS problem FROM h),
  m AS (SELECT *, CASE WHEN action = 'override_translation' AND problem IS NULL THEN text END AS applied FROM k)"""


def _candidates(t):
    u = F.col("user_id")
    target = lambda n: F.concat(F.lit("t"), (n % 90).cast("string"))
    rows = t("events").select("user_id").distinct()
    return rows.select(
        F.concat(F.lit("u"), u.cast("string")).alias("candidate_id"), F.when(u % 4 != 3, target(u)).alias("target_id"), F.array(target(u), target(u + 1)).alias("options"), F.array((u % 5).cast("string"), ((u + 1) % 5).cast("string")).alias("option_sources"),
        (u % 4 == 3).alias("ambiguous"), F.when(u % 13 != 0, F.concat(F.lit("text "), u.cast("string"))).alias("translation"), (u % 5).cast("string").alias("base_source"),
    )


def _log(t):
    e, u = F.col("event_id"), F.col("user_id")
    named = F.when(e % 7 == 0, "accept").when((e % 7).isin(1, 2), "override_translation").when(e % 7 == 3, "split_lineage").when(e % 7 == 4, "merge_lineage").when(e % 7 == 5, F.when(e % 3 == 0, "reject").otherwise("accept")).otherwise("nod")
    return t("events").select(
        F.concat(F.lit("u"), u.cast("string")).alias("candidate_id"), e.alias("ordinal"), named.alias("action"), F.col("event_type").alias("reviewer"), F.when(e % 3 > 0, "human").otherwise("model").alias("reviewer_type"),
        F.when(e % 2 == 0, F.concat(F.lit("t"), ((u + F.floor(e / 2) % 3) % 90).cast("string"))).alias("target_id"), F.when(e % 11 == 0, " ").otherwise(F.concat(F.lit("by "), e.cast("string"))).alias("text"),
        F.when(e % 17 == 0, "").otherwise("line").alias("lineage_id"), F.when(e % 9 < 6, F.array(F.concat(F.lit("r"), (e % 9).cast("string")))).alias("related"),
    )


@query("decision_trail", f"WITH {_LOG} SELECT candidate_id, ordinal, action, reviewer, problem, before AS previous_status, after AS status, CASE WHEN action = 'accept' AND problem IS NULL THEN res END AS resolved, CASE WHEN applied IS NOT NULL THEN coalesce(last_value(applied IGNORE NULLS) OVER (PARTITION BY candidate_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), translation) END AS previous_text, applied AS text FROM m")
def decision_trail(t):
    """What each entry of the log did, or why it was refused."""
    return D.audit_trail(_candidates(t), _log(t)).drop("lineage_id", "related")


_STATES = f"""{_LOG}, o AS (SELECT candidate_id, arg_max(applied, ordinal) AS said, arg_max(reviewer, ordinal) AS who FROM m WHERE applied IS NOT NULL GROUP BY 1), n AS (SELECT candidate_id, COUNT(*) FILTER (problem IS NULL) AS n_applied, COUNT(*) FILTER (problem IS NOT NULL) AS n_refused FROM m GROUP BY 1),
  s AS (SELECT c.candidate_id, c.src, CASE g.verdict WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN g.verdict = 'accept' THEN g.res END AS resolved, g.first, coalesce(o.said, c.translation) AS final, g.reviewer, coalesce(o.who, g.reviewer) AS last_reviewer, coalesce(n.n_applied, 0) AS n_applied, coalesce(n.n_refused, 0) AS n_refused
    FROM c LEFT JOIN g USING (candidate_id) LEFT JOIN o USING (candidate_id) LEFT JOIN n USING (candidate_id)),
  t AS (SELECT *, resolved IS NOT NULL AND row_number() OVER (PARTITION BY resolved ORDER BY first, candidate_id) > 1 AS target_taken FROM s)"""


@query("decision_states", f"WITH {_STATES} SELECT candidate_id, status, resolved, final, reviewer, last_reviewer, n_applied, n_refused, target_taken FROM t")
def decision_states(t):
    """Every candidate after the log; targets go to who is accepted first."""
    c = _candidates(t)
    return D.states(c, D.audit_trail(c, _log(t))).select("candidate_id", "status", "resolved", "final", "reviewer", "last_reviewer", "n_applied", "n_refused", "target_taken")


@query(
    "decision_prefill",
    f"""WITH {_STATES}, x AS (SELECT 't' || i AS target_id, i % 5 AS src, i % 8 = 0 AS done FROM range(0, 85) r(i)) SELECT coalesce(CASE WHEN status <> 'accepted' THEN 'not_accepted' WHEN target_taken THEN 'target_taken' WHEN x.target_id IS NULL THEN 'target_gone' WHEN x.src <> t.src THEN 'source_differs' WHEN x.done THEN 'already_translated' END, 'fill') AS gate, COUNT(*) AS n
        FROM t LEFT JOIN x ON x.target_id = t.resolved GROUP BY 1""",
)
def decision_prefill(t):
    """How many accepted texts may be filled in, and what keeps the others back."""
    c = _candidates(t)
    i = F.col("id")
    targets = t("events").sparkSession.range(85).select(F.concat(F.lit("t"), i.cast("string")).alias("target_id"), (i % 5).cast("string").alias("source"), F.when(i % 8 == 0, "done").alias("translation"))
    rows = D.prefill(D.states(c, D.audit_trail(c, _log(t))), targets)
    return rows.groupBy(F.coalesce("gate", F.lit("fill")).alias("gate")).agg(F.count("*").alias("n"))


@query(
    "record_history",
    """WITH d AS (SELECT conv_id || ':' || turn AS record_id, text, role, turn FROM conversations WHERE turn IS NOT NULL) SELECT record_id, CASE WHEN turn % 3 = 0 THEN text || ' new' ELSE text END AS translation, CASE WHEN turn % 4 = 0 THEN 'review' ELSE role END AS origin, CASE WHEN turn % 3 = 0 OR (turn % 4 = 0 AND role <> 'review') THEN 1 ELSE 0 END AS n_history,
        CASE WHEN turn % 3 = 0 OR turn % 4 = 0 THEN role || '>' || CASE WHEN turn % 4 = 0 THEN 'review' ELSE role END ELSE '' END AS trail FROM d""",
)
def record_history(t):
    """Records frozen again: what changed keeps its former text and origin."""
    d = t("conversations").filter("turn IS NOT NULL").select(F.concat_ws(":", "conv_id", "turn").alias("record_id"), F.col("text").alias("translation"), F.col("role").alias("origin"), "turn")
    old = d.drop("turn").withColumn("history", F.array().cast("array<struct<origin:string,translation:string,digest:string,superseded_by:string>>"))
    new = d.select("record_id", F.when(F.col("turn") % 3 == 0, F.concat("translation", F.lit(" new"))).otherwise(F.col("translation")).alias("translation"), F.when(F.col("turn") % 4 == 0, "review").otherwise(F.col("origin")).alias("origin"))
    rows = D.revise(old, new)
    return rows.select("record_id", "translation", "origin", F.size("history").alias("n_history"), F.array_join(F.transform("history", lambda h: F.concat(h["origin"], F.lit(">"), h["superseded_by"])), ",").alias("trail"))


# -- results merged into units: orders are units, their lines results

_RANK = "list_position(['pending', 'running', 'failed', 'done'], status)"
_UNITS = f"""u AS (SELECT o_orderkey AS unit_id, CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' ELSE 'failed' END AS status, 'd' || o_orderkey % 5 AS digest, NULL AS payload, o_orderstatus AS campaign FROM orders),
  r AS (SELECT CASE WHEN l_partkey % 50 = 0 THEN -l_orderkey ELSE l_orderkey END AS unit_id, CASE l_linenumber % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'done' ELSE 'odd' END AS status, 'd' || (CASE WHEN l_suppkey % 7 = 0 THEN l_orderkey + 1 ELSE l_orderkey END) % 5 AS digest, l_returnflag AS payload FROM lineitem),
  j AS (SELECT r.*, CASE WHEN u.unit_id IS NULL THEN 'unknown_unit' WHEN r.digest <> u.digest THEN 'stale_digest' WHEN r.status = 'odd' THEN 'unknown_state' END AS problem FROM r LEFT JOIN u USING (unit_id)),
  a AS (SELECT unit_id, {_RANK} AS rank, status, payload FROM u UNION ALL SELECT unit_id, {_RANK}, status, payload FROM j WHERE problem IS NULL),
  b AS (SELECT unit_id, max({{'rank': rank, 'said': coalesce(payload, ''), 'status': status, 'payload': payload}}) AS m FROM a GROUP BY 1)"""


def _units(t):
    k = F.col("o_orderkey")
    return t("orders").select(k.alias("unit_id"), F.when(k % 3 == 0, "pending").when(k % 3 == 1, "running").otherwise("failed").alias("status"), F.concat(F.lit("d"), (k % 5).cast("string")).alias("digest"), F.lit(None).cast("string").alias("payload"), F.col("o_orderstatus").alias("campaign"))


def _results(t):
    k, n = F.col("l_orderkey"), F.col("l_linenumber") % 4
    unit = F.when(F.col("l_partkey") % 50 == 0, -k).otherwise(k)
    return t("lineitem").select(unit.alias("unit_id"), F.when(n == 0, "running").when(n == 1, "failed").when(n == 2, "done").otherwise("odd").alias("status"), F.concat(F.lit("d"), (F.when(F.col("l_suppkey") % 7 == 0, k + 1).otherwise(k) % 5).cast("string")).alias("digest"), F.col("l_returnflag").alias("payload"))


@query("merged_results", f"WITH {_UNITS} SELECT unit_id, m.status AS status, m.payload AS payload FROM b")
def merged_results(t):
    """Units after their results, whatever their order."""
    return D.merge_results(_units(t).drop("campaign"), _results(t))[0].select("unit_id", "status", "payload")


@query("refused_results", f"WITH {_UNITS} SELECT problem, COUNT(*) AS n FROM j WHERE problem IS NOT NULL GROUP BY 1")
def refused_results(t):
    """Results that did not count, by reason."""
    return D.merge_results(_units(t).drop("campaign"), _results(t))[1].groupBy("problem").agg(F.count("*").alias("n"))


@query(
    "campaign_states",
    f"""WITH {_UNITS}, e AS (SELECT u.campaign, CASE WHEN m.status = 'running' THEN 'failed' ELSE m.status END AS status FROM b JOIN u USING (unit_id)), n AS (SELECT campaign, COUNT(*) FILTER (status = 'pending') AS pending, COUNT(*) FILTER (status = 'running') AS running, COUNT(*) FILTER (status = 'failed') AS failed, COUNT(*) FILTER (status = 'done') AS done FROM e GROUP BY 1)
        SELECT *, CASE WHEN done = pending + running + failed + done THEN 'done' WHEN running > 0 THEN 'running' WHEN pending = pending + running + failed + done THEN 'pending' WHEN pending > 0 THEN 'running' ELSE 'failed' END AS status FROM n""",
)
def campaign_states(t):
    """Campaigns at the end of a run: units without a result fail."""
    units = _units(t)
    merged = D.finish(D.merge_results(units.drop("campaign"), _results(t))[0])
    return D.campaign_status(merged.join(units.select("unit_id", "campaign"), "unit_id"), ["campaign"])


# -- digests: documents are units of chunks (languages) of campaigns (sources)

_LEAVES = "d AS (SELECT coalesce(source, '') AS campaign, coalesce(lang, '') AS chunk, doc_id FROM documents), x AS (SELECT * FROM d WHERE doc_id % 97 = 5)"


def _leaves(t):
    docs = t("documents")
    text = F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    before = docs.select(F.coalesce("source", F.lit("")).alias("campaign"), F.coalesce("lang", F.lit("")).alias("chunk"), F.col("doc_id").alias("unit_id"), "text")
    after = docs.filter("doc_id % 101 <> 7").select(F.coalesce("source", F.lit("")).alias("campaign"), F.coalesce("lang", F.lit("")).alias("chunk"), F.col("doc_id").alias("unit_id"), text.alias("text"))
    return before, after


@query(
    "stale_records",
    """WITH d AS (SELECT coalesce(source, '') AS a, coalesce(lang, '') AS c, doc_id AS i, CASE WHEN doc_id % 101 = 7 THEN 'gone' WHEN doc_id % 97 = 5 AND text IS NOT NULL THEN 'changed' END AS change FROM documents),
        n AS (SELECT a, c, bool_and(change IS NOT NULL AND change = 'gone') AS gone, bool_or(change IS NOT NULL) AS hit FROM d GROUP BY 1, 2), m AS (SELECT a, bool_and(coalesce(change, '') = 'gone') AS gone, bool_or(change IS NOT NULL) AS hit FROM d GROUP BY 1)
        SELECT 'unit' AS level, a || '/' || c || '/' || i AS name, change FROM d WHERE change IS NOT NULL UNION ALL SELECT 'chunk', a || '/' || c, CASE WHEN gone THEN 'gone' ELSE 'changed' END FROM n WHERE hit UNION ALL SELECT 'campaign', a, CASE WHEN gone THEN 'gone' ELSE 'changed' END FROM m WHERE hit""",
)
def stale_records(t):
    """One changed or missing document names itself, its chunk and its campaign."""
    before, after = _leaves(t)
    levels = ["campaign", "chunk"]
    return N.stale(N.tree(before, levels, ["text"]), N.tree(after, levels, ["text"]), levels)


@query(
    "stale_conversations",
    """WITH d AS (SELECT coalesce(source, '') || '/' || coalesce(lang, '') AS c, bool_or(doc_id % 101 = 7 OR (doc_id % 97 = 5 AND text IS NOT NULL)) AS hit FROM documents GROUP BY 1), k AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i FROM d), n AS (SELECT COUNT(*) AS n FROM k),
        v AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, unnest([conv_id % n, (conv_id * 3 + 1) % n]) AS i FROM v, n) SELECT r.conv_id AS record_id, COUNT(DISTINCT d.c) AS n_stale FROM r JOIN k ON k.i = r.i JOIN d ON d.c = k.c AND d.hit GROUP BY 1""",
)
def stale_conversations(t):
    """Conversations that rest on two chunks each, and whose chunks changed."""
    before, after = _leaves(t)
    levels = ["campaign", "chunk"]
    changed = N.stale(N.tree(before, levels, ["text"]), N.tree(after, levels, ["text"]), levels)
    names = before.select(F.concat_ws("/", "campaign", "chunk").alias("c")).distinct().agg(F.array_sort(F.collect_set("c")).alias("all"))
    n, v = F.size("all"), F.col("conv_id")
    pick = lambda i: F.get("all", i.cast("int"))
    records = t("conversations").select("conv_id").distinct().join(F.broadcast(names)).select(v.alias("record_id"), F.array(pick(v % n), pick((v * 3 + 1) % n)).alias("inputs"))
    return N.depends_on_stale(records, changed, "chunk").select("record_id", F.size("stale_inputs").cast("long").alias("n_stale"))
