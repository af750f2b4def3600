"""Queries on versions, routes, contracts, intervals, coverage and registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import contracts as C
from quern.operators import coverage as V
from quern.operators import graph as G
from quern.operators import intervals as I
from quern.operators import keywords as K
from quern.operators import versions as R

from .book import query

# -- versions of conversations: the target lacks every ninth turn, moves every fourth, edits every fifth, and has new ones


def _turns(t):
    return t("conversations").select("conv_id", "turn", (F.col("conv_id") * 7 + F.col("turn")).alias("k"), F.concat_ws("-", "conv_id", "turn").alias("name"), "role", "text")


def _versions(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = _turns(t).withColumns({"before": F.lag("text").over(w), "after": F.lead("text").over(w)})
    sides = []
    for side, keep in (("b", F.col("k") % 10 != 1), ("t", F.col("k") % 9 != 1)):
        edited = F.when((F.lit(side) == "t") & (F.col("k") % 5 == 0), F.concat("text", F.lit(" indeed"))).otherwise(F.col("text"))
        moved = F.when((F.lit(side) == "t") & (F.col("k") % 4 == 0), F.col("turn") + 1000).otherwise(F.col("turn"))
        sides.append(
            d.filter(keep).select(
                F.concat(F.lit(side), "name").alias("id"), F.lit(None).cast("string").alias("lineage"), F.concat_ws(":", "conv_id", moved.cast("string")).alias("locator"),
                F.md5(F.concat(F.col("conv_id").cast("string"), F.lit("|"), F.col("text"))).alias("content"), edited.alias("source"), "before", "after", F.col("role").alias("speaker"),
            )
        )
    return sides


_V = """WITH d AS (SELECT conv_id, turn, conv_id * 7 + turn AS k, conv_id || '-' || turn AS name, text AS h FROM conversations), b AS (SELECT *, turn AS n FROM d WHERE k % 10 <> 1), t AS (SELECT *, CASE WHEN k % 4 = 0 THEN turn + 1000 ELSE turn END AS n FROM d WHERE k % 9 <> 1)"""


_ONCE = """, lb AS (SELECT conv_id, n, MIN(name) AS name, MIN(h) AS h FROM b GROUP BY 1, 2 HAVING COUNT(*) = 1), lt AS (SELECT conv_id, n, MIN(name) AS name, MIN(h) AS h FROM t GROUP BY 1, 2 HAVING COUNT(*) = 1),
    l AS (SELECT lb.name AS x, lt.name AS y FROM lb JOIN lt USING (conv_id, n)),
    cb AS (SELECT conv_id, h, MIN(name) AS name, MIN(n) AS n FROM b WHERE h IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) = 1), ct AS (SELECT conv_id, h, MIN(name) AS name, MIN(n) AS n FROM t WHERE h IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) = 1),
    c AS (SELECT cb.name AS x, ct.name AS y FROM cb JOIN ct USING (conv_id, h) WHERE cb.n <> ct.n AND cb.name NOT IN (SELECT x FROM l) AND ct.name NOT IN (SELECT y FROM l))"""


@query("version_locator_matches", f"{_V}{_ONCE} SELECT 'b' || x AS base_id, 't' || y AS target_id FROM l")
def version_locator_matches(t):
    """Rows that stay in their place, edited or not."""
    base, target = _versions(t)
    return R.exact_matches(base, target).filter("kind = 'locator_exact'").select("base_id", "target_id")


@query("version_content_candidates", f"{_V}{_ONCE} SELECT 'b' || x AS base_id, 't' || y AS target_id FROM c")
def version_content_candidates(t):
    """Rows that moved, whose content both versions have once."""
    base, target = _versions(t)
    return R.exact_matches(base, target).filter("kind = 'content_exact'").select("base_id", "target_id")


@query("version_reconcile")
def version_reconcile(t):
    """Dispositions of both versions, modified sources included."""
    base, target = _versions(t)
    return R.reconcile(base, target)


@query("version_reuse_summary")
def version_reuse_summary(t):
    """What of the old translations can be used again."""
    base, target = _versions(t)
    records = base.filter("crc32(id) % 5 <> 0").select("id", F.reverse("source").alias("translation"))
    out = R.reuse_candidates(R.reconcile(base, target, fuzzy=False), base, target, records)
    return out.groupBy("reuse", "kind").agg(F.count("*").alias("n"))


@query(
    "version_relocate",
    f"""{_V}, x AS (SELECT name AS id, h FROM b), y AS (SELECT CASE WHEN k % 4 = 0 THEN 'm' ELSE '' END || name AS id, h FROM t), s AS (SELECT id FROM x JOIN y USING (id)),
        ox AS (SELECT h, MIN(id) AS id FROM x WHERE id NOT IN (SELECT id FROM s) GROUP BY h HAVING COUNT(*) = 1), oy AS (SELECT h, MIN(id) AS id FROM y WHERE id NOT IN (SELECT id FROM s) GROUP BY h HAVING COUNT(*) = 1)
        SELECT id, id AS new_id, 'identity' AS how FROM s UNION ALL SELECT ox.id, oy.id, 'content' FROM ox JOIN oy USING (h)""",
)
def version_relocate(t):
    """Rows found again by identity, else by content that is unique."""
    d = _turns(t).withColumn("content", F.col("text"))
    old = d.filter("k % 10 <> 1").select(F.col("name").alias("id"), "content", F.lit("l").alias("locator"))
    new = d.filter("k % 9 <> 1").select(F.concat(F.when(F.col("k") % 4 == 0, "m").otherwise(""), "name").alias("id"), "content", F.lit("l").alias("locator"))
    return R.relocate(old, new)


# -- routes: page links and headings as jumps and labels


def _numbered(t):
    """Events with their place in their user's file; files are the key, so that what follows by file needs no other shuffle."""
    e = t("events").withColumn("file", F.col("user_id").cast("string"))
    return e.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("event_id")) - 1)


def _script(t):
    """Events as scripts, a file per user: labels every tenth row, jumps to labels ahead."""
    e = _numbered(t)
    own = F.concat(F.lit("L"), F.floor(F.col("n") / 10).cast("string"))
    text = F.when(F.col("n") % 10 == 0, F.concat(F.lit("label "), own, F.lit(":"))).when(F.col("n") % 10 == 3, F.concat(F.lit("    jump L"), (F.floor(F.col("n") / 10) + 1 + F.col("user_id") % 3).cast("string")))
    return e.select("file", F.col("n").cast("long").alias("line"), F.coalesce(F.concat(F.lit(""), text), F.lit('"say"')).alias("text"))


_N = """WITH e AS (SELECT user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events), l AS (SELECT DISTINCT 'L' || (n // 10) AS label FROM e WHERE n % 10 = 0), j AS (SELECT 'L' || (n // 10) AS source, 'L' || (n // 10 + 1 + user_id % 3) AS target FROM e WHERE n % 10 = 3)"""


@query("route_edges", f"{_N} SELECT source, target, CASE WHEN label IS NULL THEN 'unresolved' ELSE 'jump' END AS kind, COUNT(*) AS n FROM j LEFT JOIN l ON label = target GROUP BY 1, 2, 3")
def route_edges(t):
    """Jumps between labels; unknown targets are unresolved."""
    _, edges = G.labels_and_edges(_script(t))
    return edges.groupBy("source", "target", "kind").agg(F.count("*").alias("n"))


@query("route_degrees", f"{_N} SELECT label, COUNT(source) AS n_in, COUNT(DISTINCT source) AS n_sources, COUNT(source) = 0 AS is_entry, COUNT(DISTINCT source) > 1 AS is_shared FROM l LEFT JOIN j ON target = label GROUP BY 1")
def route_degrees(t):
    """Entries and shared labels."""
    return G.degrees(*G.labels_and_edges(_script(t)))


def _chunks(t):
    """Seven lines each of every file, with what stands there as evidence."""
    e = _numbered(t)
    c = F.floor(F.col("n") / 7)
    rows = e.groupBy("file", c.alias("c")).agg(F.min("n").cast("long").alias("first_line"), F.max("n").cast("long").alias("last_line"), F.array_sort(F.collect_set("event_type")).alias("evidence"))
    return rows.select(F.format_string("%s-%04d", "file", "c").alias("chunk_id"), "file", "first_line", "last_line", F.when(F.col("c") % 4 != 3, F.concat(F.lit("Part "), F.col("c").cast("string"))).alias("summary"), "evidence")


@query(
    "route_labels",
    f"""{_N}, n AS (SELECT user_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events), c AS (SELECT user_id, n // 7 AS c, MIN(n) AS a, MAX(n) AS b, list_sort(list(DISTINCT event_type)) AS evidence FROM n GROUP BY 1, 2),
        s AS (SELECT user_id, 'L' || (n // 10) AS label, MIN(n) AS x, MAX(n) AS y FROM n GROUP BY 1, 2), h AS (SELECT c.*, label, x, least(b, y) - greatest(a, x) + 1 AS k FROM c JOIN s ON s.user_id = c.user_id AND least(b, y) >= greatest(a, x)),
        m AS (SELECT user_id, c, any_value(evidence) AS evidence, arg_max(label, {{'k': k, 'x': -x, 'label': label}}) AS label FROM h GROUP BY 1, 2), p AS (SELECT label, string_agg(CASE WHEN c % 4 <> 3 THEN 'Part ' || c END, chr(10) ORDER BY user_id || '-' || lpad(c::VARCHAR, 4, '0')) AS said, COUNT(*) AS n_chunks, list(evidence) AS ev FROM m GROUP BY 1),
        d AS (SELECT DISTINCT source AS label FROM j WHERE target NOT IN (SELECT label FROM l))
        SELECT l.label, coalesce(said, 'Label `' || l.label || '`') || CASE WHEN d.label IS NULL THEN '' ELSE chr(10) || '[unresolved dynamic jump/call present]' END AS summary, array_to_string(list_sort(list_distinct(flatten(ev))), ',') AS evidence, coalesce(n_chunks, 0) AS n_upstream, d.label IS NOT NULL AS unresolved FROM l LEFT JOIN p USING (label) LEFT JOIN d USING (label)""",
)
def route_labels(t):
    """What each label's chunks say, with their evidence."""
    nodes, edges = G.labels_and_edges(_script(t))
    rows = G.label_records(nodes, edges, G.assign_labels(_chunks(t), nodes))
    return rows.select("label", "summary", F.array_join(F.array_sort("evidence"), ",").alias("evidence"), F.size("upstream").cast("long").alias("n_upstream"), "unresolved")


@query("route_records")
def route_records(t):
    """Routes from every entry, told in the order of their labels."""
    nodes, edges = G.labels_and_edges(_script(t))
    labels = G.label_records(nodes, edges, G.assign_labels(_chunks(t), nodes))
    return G.route_records(G.routes(nodes, edges, max_depth=8, max_routes=16), labels).select("entry", "route", "summary", F.array_join("evidence", ",").alias("evidence"), "unresolved")


@query(
    "invalidation",
    """WITH c AS (SELECT doc_id FROM documents WHERE doc_id % 50 = 0), s AS (SELECT DISTINCT source AS id FROM documents WHERE doc_id % 50 = 0), l AS (SELECT DISTINCT 'l' || source[1:4] AS id FROM documents WHERE source IN (SELECT id FROM s))
       SELECT kind, stale, COUNT(*) AS n FROM (SELECT 'chunk' AS kind, doc_id % 50 = 0 AS stale FROM documents UNION ALL SELECT 'scene', source IN (SELECT id FROM s) FROM (SELECT DISTINCT source FROM documents)
         UNION ALL SELECT 'label', 'l' || p IN (SELECT id FROM l) FROM (SELECT DISTINCT source[1:4] AS p FROM documents) UNION ALL SELECT 'brief', true) GROUP BY 1, 2""",
)
def invalidation(t):
    """Stale records per kind after every fiftieth document changed: chunks, scenes of a source, labels of sources."""
    d = t("documents").select(F.col("doc_id").cast("string").alias("doc"), F.col("source").alias("scene"), F.concat(F.lit("l"), F.substring("source", 1, 4)).alias("label"), (F.col("doc_id") % 50 == 0).alias("new"))
    records = [d.select(F.col(c).alias("id"), F.lit(kind).alias("kind")).distinct() for c, kind in (("doc", "chunk"), ("scene", "scene"), ("label", "label"))]
    brief = d.sparkSession.createDataFrame([("brief", "brief")], "id string, kind string")
    links = d.select(F.col("scene").alias("id"), F.col("doc").alias("up")).unionByName(d.select(F.col("label").alias("id"), F.col("scene").alias("up")))
    out = G.invalidate(reduce(DataFrame.unionByName, [*records, brief]), links, d.filter("new").select(F.col("doc").alias("id")))
    return out.groupBy("kind", "stale").agg(F.count("*").alias("n"))


@query("resume", "SELECT status, COUNT(*) AS n FROM (SELECT CASE WHEN doc_id % 6 = 5 THEN 'pending' WHEN doc_id % 5 = 4 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'stale' WHEN doc_id % 2 = 0 THEN 'done' ELSE 'failed' END AS status FROM documents WHERE NOT (doc_id % 6 = 5 AND doc_id % 5 = 4)) GROUP BY 1")
def resume(t):
    """Stored units against live digests."""
    d = t("documents").select("doc_id", F.md5("text").alias("digest"))
    units = d.filter("doc_id % 6 <> 5").select(F.col("doc_id").alias("unit_id"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("digest")).alias("digest"), F.when(F.col("doc_id") % 2 == 0, "done").otherwise("failed").alias("status"))
    live = d.filter("doc_id % 5 <> 4").select(F.col("doc_id").alias("unit_id"), "digest")
    return G.resume_state(units, live).groupBy("status").agg(F.count("*").alias("n"))


# -- contracts: orders are chunks, line items their items


@query("contract_ids", "WITH r AS (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey + 10000000 FROM orders WHERE o_orderkey % 500 = 0) SELECT problem, COUNT(*) AS n FROM (SELECT CASE WHEN n IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS problem FROM orders FULL JOIN (SELECT l_orderkey, COUNT(*) AS n FROM r GROUP BY 1) g ON o_orderkey = l_orderkey) GROUP BY 1")
def contract_ids(t):
    """Missing, unknown and duplicate ids."""
    returned = t("lineitem").filter("l_linenumber <= 2 AND l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("k")).unionAll(t("orders").filter("o_orderkey % 500 = 0").select(F.col("o_orderkey") + 10_000_000))
    out = C.check_ids(t("orders").select(F.col("o_orderkey").alias("k")), returned, ["k"])
    return out.groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


@query("contract_completeness", "SELECT l_returnflag, COUNT(DISTINCT l_orderkey) AS expected, COUNT(DISTINCT CASE WHEN l_quantity > 45 THEN l_orderkey END) AS valid, ROUND(COUNT(DISTINCT CASE WHEN l_quantity > 45 THEN l_orderkey END) / COUNT(DISTINCT l_orderkey), 9) AS ratio FROM lineitem GROUP BY 1")
def contract_completeness(t):
    """Orders with a valid line over all orders, per flag."""
    rows = t("lineitem").select("l_returnflag", "l_orderkey", "l_quantity")
    return C.completeness(rows, rows, ["l_returnflag"], "l_orderkey", F.col("l_quantity") > 45).withColumn("ratio", F.round("ratio", 9))


@query("contract_regroup", "SELECT o_orderkey, COALESCE(n, 0) AS n, want - COALESCE(d, 0) AS missing FROM (SELECT l_orderkey AS o_orderkey, COUNT(DISTINCT l_linenumber) AS want FROM lineitem GROUP BY 1) LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n, COUNT(DISTINCT l_linenumber) AS d FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY 1) ON l_orderkey = o_orderkey")
def contract_regroup(t):
    """Lines of each order that came back, and how many did not."""
    l = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return C.regroup(l.filter("l_partkey % 4 <> 0"), l, "o_orderkey", "l_linenumber", "l_partkey").select("o_orderkey", "n", "missing")


@query("contract_fill", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'SEG' || c_nationkey ELSE c_mktsegment END AS segment FROM customer")
def contract_fill(t):
    """Empty values filled from another table."""
    c = t("customer")
    left = c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    right = c.select("c_custkey", F.concat(F.lit("SEG"), F.col("c_nationkey").cast("string")).alias("segment"))
    return C.fill_from(left, right, ["c_custkey"], ["segment"]).select("c_custkey", "segment")


@query("registry_merge", "SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN b.s_suppkey IS NULL OR b.s_suppkey % 2 = 0 THEN a.s_name ELSE b.s_name || '!' END AS s_name FROM (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) a FULL JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 = 0) b ON a.s_suppkey = b.s_suppkey")
def registry_merge(t):
    """Incoming values win unless they are empty."""
    s = t("supplier").select("s_suppkey", "s_name")
    new = s.filter("s_suppkey % 3 = 0").withColumn("s_name", F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.concat("s_name", F.lit("!"))))
    return C.merge_fields(s.filter("s_suppkey % 5 <> 0"), new, "s_suppkey")


@query("replace_partition", "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders")
def replace_partition(t):
    """A customer's rows replaced as a whole."""
    o = t("orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return C.replace_partition(o, o.filter("o_custkey % 4 = 0").withColumn("status", F.lit("new")), ["o_custkey"]).select("o_orderkey", "status")


@query("status_roll_up", "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'partial' WHEN bool_or(o_orderstatus = 'O') THEN 'open' ELSE 'done' END AS status FROM orders GROUP BY 1")
def status_roll_up(t):
    """One status per customer, by priority."""
    return C.roll_up(t("orders"), ["o_custkey"], "o_orderstatus", ((("P",), "partial"), (("O",), "open")), "done")


@query("unique_names", "SELECT p_partkey, p_type || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS name FROM (SELECT p_partkey, p_type, ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part)")
def unique_names(t):
    """Names made unique by suffixes."""
    return C.unique_names(t("part"), "p_type", "p_partkey").select("p_partkey", "name")


@query("first_seen", "SELECT o_custkey, MIN(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def first_seen(t):
    """The first order of each customer."""
    return C.first_seen(t("orders"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("variant_table", "SELECT conv_id, MAX(CASE WHEN turn % 2 = 0 THEN length(text) END) AS a, MAX(CASE WHEN turn % 2 = 1 THEN length(text) END) AS b FROM conversations GROUP BY 1")
def variant_table(t):
    """Two variants side by side."""
    rows = t("conversations").select("conv_id", F.when(F.col("turn") % 2 == 0, "a").otherwise("b").alias("v"), F.length("text").cast("long").alias("n"))
    return C.wide(rows, "conv_id", "v", "n", ["a", "b"])


# -- intervals: line items as line ranges of an order


_I = "WITH a AS (SELECT o_orderkey AS left_id, o_custkey AS file, CAST(o_orderkey % 700 AS BIGINT) AS f, CAST(o_orderkey % 700 + 90 AS BIGINT) AS l FROM orders), b AS (SELECT o_orderkey AS right_id, o_custkey AS file, CAST(o_orderkey % 900 AS BIGINT) AS f, CAST(o_orderkey % 900 + o_orderkey % 400 AS BIGINT) AS l FROM orders)"


def _intervals(t):
    o = t("orders")
    a = o.select(F.col("o_orderkey").alias("left_id"), F.col("o_custkey").alias("file"), (F.col("o_orderkey") % 700 + 90).alias("first"), (F.col("o_orderkey") % 700).alias("last"))
    b = o.select(F.col("o_orderkey").alias("right_id"), F.col("o_custkey").alias("file"), (F.col("o_orderkey") % 900).alias("first"), (F.col("o_orderkey") % 900 + F.col("o_orderkey") % 400).alias("last"))
    return a, b


@query("interval_overlaps", f"{_I} SELECT left_id, right_id, least(a.l, b.l) - greatest(a.f, b.f) + 1 AS common FROM a JOIN b ON a.file = b.file AND a.f <= b.l AND b.f <= a.l")
def interval_overlaps(t):
    """Pairs of ranges of one file with common lines; the left ends come reversed."""
    return I.overlaps(*_intervals(t)).select("left_id", "right_id", "common")


@query("interval_tightest", f"{_I} SELECT left_id, right_id FROM (SELECT left_id, right_id, ROW_NUMBER() OVER (PARTITION BY left_id ORDER BY b.l - b.f, right_id) AS r FROM a JOIN b ON a.file = b.file AND a.f <= b.l AND b.f <= a.l) WHERE r = 1")
def interval_tightest(t):
    """The shortest range that each one meets."""
    return I.tightest(I.overlaps(*_intervals(t)), "left_id", "right_id").select("left_id", "right_id")


@query("interval_points", f"{_I} SELECT left_id, right_id FROM a JOIN b ON a.file = b.file AND a.f BETWEEN b.f AND b.l")
def interval_points(t):
    """Ranges that a line lies in."""
    a, b = _intervals(t)
    return I.containing(a.select("left_id", "file", F.col("last").alias("line")), b).select("left_id", "right_id")


@query(
    "scene_scores",
    f"""{_I}, s AS (SELECT left_id, right_id, 50 + CASE WHEN a.f <= b.l AND b.f <= a.l THEN 100 + least(a.l, b.l) - greatest(a.f, b.f) + 1 WHEN b.l < a.f THEN greatest(0, 40 - least(a.f - b.l, 40)) ELSE greatest(0, 40 - least(b.f - a.l, 40)) END + 8 * CAST(left_id % 3 = right_id % 3 AS INT) AS score FROM a JOIN b ON a.file = b.file)
        SELECT left_id AS target_id, right_id AS scene_id, score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS rank FROM s) WHERE rank <= 3""",
)
def scene_scores(t):
    """The three best scenes of each target by lines and people."""
    a, b = _intervals(t)
    a = I.ordered(a, "first", "last").select(F.col("left_id").alias("target_id"), "file", "first", "last", F.array((F.col("left_id") % 3).cast("string")).alias("people"))
    b = b.select(F.col("right_id").alias("scene_id"), "file", "first", "last", F.array((F.col("right_id") % 3).cast("string")).alias("people"))
    return I.scene_scores(a, b).withColumn("rank", F.col("rank").cast("long"))


@query("overlapping_writes", "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, f, MAX(f + CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY f, f + CAST(l_quantity AS BIGINT), l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM (SELECT *, l_linenumber * 30 AS f FROM lineitem)) WHERE f < e")
def overlapping_writes(t):
    """Edits that begin inside earlier ones."""
    ops = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 30).cast("long").alias("f"), (F.col("l_linenumber") * 30 + F.col("l_quantity").cast("long")).alias("l"))
    return I.overlapping_writes(ops, ["l_orderkey"], "f", "l").select("l_orderkey", "l_linenumber")


# -- coverage


@query("coverage_histogram", "SELECT c AS lang, COUNT(lang) AS n FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'xx']) AS c) LEFT JOIN documents ON lang = c GROUP BY 1")
def coverage_histogram(t):
    """Every known class, those without rows too."""
    return V.histogram(t("documents"), "lang", ["de", "en", "es", "fr", "xx"])


@query("coverage_reasons", "SELECT value, COUNT(*) AS n FROM (SELECT unnest([CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END]) AS value FROM labels) GROUP BY 1")
def coverage_reasons(t):
    """Elements of reason lists."""
    rows = t("labels").select(F.array(F.when(F.col("quality") == 1, "good").otherwise("bad"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean")).alias("r"))
    return V.array_histogram(rows, "r")


@query("coverage_delta", "SELECT lang, COUNT(*) FILTER (WHERE doc_id % 3 = 0) AS base_n, COUNT(*) FILTER (WHERE doc_id % 3 = 1) AS target_n, COUNT(*) FILTER (WHERE doc_id % 3 = 1) - COUNT(*) FILTER (WHERE doc_id % 3 = 0) AS delta FROM documents GROUP BY 1")
def coverage_delta(t):
    """Class counts of two versions."""
    d = t("documents")
    return V.histogram_delta(d.filter("doc_id % 3 = 0"), d.filter("doc_id % 3 = 1"), "lang")


@query("coverage_invariants", "SELECT 'has_text' AS invariant, COUNT(*) FILTER (WHERE length(text) <= 100) AS violations FROM documents UNION ALL SELECT 'counted', COUNT(*) FILTER (WHERE n_chars <> length(text)) FROM documents")
def coverage_invariants(t):
    """Rows that break a rule."""
    return V.invariants(t("documents"), has_text=F.length("text") > 100, counted=F.col("n_chars") == F.length("text"))


@query("coverage_duplicates", "SELECT md5(text) AS digest, COUNT(*) AS n FROM documents GROUP BY 1 HAVING COUNT(*) > 1")
def coverage_duplicates(t):
    """Texts that several documents have."""
    return V.duplicates(t("documents").select(F.md5("text").alias("digest")), ["digest"])


@query("coverage_review_sample", "SELECT doc_id FROM (SELECT doc_id, n_chars < 100 AS a, ROW_NUMBER() OVER (PARTITION BY lang, n_chars < 100 ORDER BY doc_id) AS r FROM documents) WHERE a OR r <= 5")
def coverage_review_sample(t):
    """Short documents and five others of each language."""
    return V.review_sample(t("documents"), "lang", "doc_id", F.col("n_chars") < 100).select("doc_id")


@query("coverage_stale", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'text' ELSE '' END || CASE WHEN doc_id % 4 = 0 AND doc_id % 6 = 0 THEN ',' ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN 'lang' ELSE '' END AS stale FROM documents")
def coverage_stale(t):
    """Fingerprints that differ, by name."""
    d = t("documents").select("doc_id", "text", F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.col("text")).alias("text2"), "lang", F.when(F.col("doc_id") % 6 != 0, F.col("lang")).alias("lang2"))
    return V.stale_reasons(d, {"text": ("text", "text2"), "lang": ("lang", "lang2")}).select("doc_id", F.array_join("stale", ",").alias("stale"))


@query("coverage_progress", "SELECT o_custkey, COUNT(*) - COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS pending, round_even(100.0 * COUNT(*) FILTER (WHERE o_orderstatus = 'F') / COUNT(*), 1) AS percent FROM orders GROUP BY 1")
def coverage_progress(t):
    """Pending count and percent done."""
    g = t("orders").groupBy("o_custkey").agg(F.count("*").alias("base"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    pending, percent = V.progress(F.col("base"), F.col("done"))
    return g.select("o_custkey", pending.alias("pending"), percent.alias("percent"))


@query("registry_search", "SELECT s_suppkey FROM supplier WHERE contains(lower(s_name || ' ' || s_nationkey), '7')")
def registry_search(t):
    """Text anywhere in a row."""
    return V.search(t("supplier"), ["s_name", "s_nationkey"], "7").select("s_suppkey")


@query(
    "set_digest",
    """WITH r AS (SELECT source, sha256(doc_id::VARCHAR || chr(31) || coalesce(text, chr(0))) AS h FROM documents), n AS (SELECT source, [('0x' || substr(h, 1 + 15 * i, 15))::UBIGINT::HUGEINT FOR i IN range(4)] AS p FROM r),
        s AS (SELECT source, COUNT(*) AS n, SUM(p[1]) AS a, SUM(p[2]) AS b, SUM(p[3]) AS c, SUM(p[4]) AS d FROM n GROUP BY 1) SELECT source, sha256(n || ':' || a || ':' || b || ':' || c || ':' || d) AS digest, n FROM s""",
)
def set_digest(t):
    """Order-free digest of each source's rows."""
    return G.digest_of(t("documents"), ["source"], F.col("doc_id"), F.col("text"))


@query(
    "keyword_occurrences",
    r"""WITH t AS (SELECT * FROM (VALUES ('Licensed', 'Licensed', 0), ('Licensed', 'Licenseds', 3), ('license', 'license', 0), ('license', 'licenses', 3), ('token', 'token', 0), ('token', 'tokens', 3), ('works', 'works', 0), ('works', 'work', 3)) v(term, form, way)),
        d AS (SELECT doc_id, '  ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), '  ') || '  ' AS h, regexp_replace(regexp_replace(text, '\[[^\[\]\r\n]*\]', ' ', 'g'), '([A-Za-z0-9_])[''’]s([^A-Za-z0-9_]|$)', '\1' || chr(1) || '\2', 'g') AS p FROM documents),
        h AS (SELECT doc_id, term, form, way, CAST((length(h) - length(replace(h, ' ' || lower(form) || ' ', ''))) / (length(form) + 2) AS BIGINT) AS places, ' ' || regexp_replace(p, '[^A-Za-z0-9_' || chr(1) || ']+', ' ', 'g') || ' ' AS a, ' ' || regexp_replace(p, '[^A-Za-z0-9_]+', ' ', 'g') || ' ' AS b FROM d, t),
        k AS (SELECT term, doc_id, places, CASE WHEN way = 3 THEN 3 WHEN contains(a, ' ' || form || ' ') THEN 0 WHEN contains(b, ' ' || form || ' ') THEN 1 ELSE 2 END AS k FROM h WHERE places > 0 AND contains(lower(b), ' ' || lower(form) || ' '))
        SELECT term, doc_id AS occurrence_id, MAX(places) AS places, ['exact', 'possessive_variant', 'case_variant', 'plural_variant'][MIN(k) + 1] AS match_kind FROM k GROUP BY 1, 2""",
)
def keyword_occurrences(t):
    """Terms with their case and number variants."""
    docs = t("documents").select(F.col("doc_id").alias("occurrence_id"), F.col("text").alias("source"))
    cand = docs.sparkSession.createDataFrame([("Licensed",), ("license",), ("token",), ("works",)], "term string")
    return K.occurrences(docs, cand)
