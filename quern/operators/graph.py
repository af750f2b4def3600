"""Route graphs of label scripts, and what changes make stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.tables import cut
from quern.operators.intervals import blocks


def _in_order(place: str, name: str) -> Column:
    """Values of ``name`` in a group, in the order of ``place``."""
    return F.transform(F.sort_array(F.collect_list(F.struct(place, name))), lambda s: s[name]).alias(name)


def labels_and_edges(lines: DataFrame, file: str = "file", line: str = "line", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Nodes ``(label, file, first_line, last_line)`` and edges ``(source, target, kind, line)``.

    An edge belongs to the last label above it in its file; its kind is jump,
    call or unresolved (an expression). Edges above all labels have none. Lines
    are read once: what is found in them is written, and so are the nodes, as
    most uses take both tables several times.
    """
    t = F.col(text)
    label = F.regexp_extract(t, r"^\s*label\s+([A-Za-z_.][\w.]*)\s*(?:\([^)]*\))?\s*:", 1)
    w = Window.partitionBy(file).orderBy(line)
    rows = lines.withColumn("own", F.when(label != "", label)).withColumn("label", F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    verb = F.regexp_extract(t, r"^\s*(jump|call)\s+(expression\s+)?(\S.*?)\s*$", 1)
    expr = F.regexp_extract(t, r"^\s*(jump|call)\s+(expression\s+)?(\S.*?)\s*$", 2) != ""
    name = F.regexp_extract(t, r"^\s*(?:jump|call)\s+(?:expression\s+)?([A-Za-z_.][\w.]*|\S+)", 1)
    kind = F.when(verb != "", F.when(expr, "unresolved").otherwise(verb))
    rows = cut(rows.select("label", F.col(file).alias("file"), F.col(line).alias("line"), kind.alias("kind"), F.when((verb != "") & ~expr, name).alias("target")).filter("label IS NOT NULL OR kind IS NOT NULL"), "lines")
    nodes = cut(rows.filter("label IS NOT NULL").groupBy("label", F.col("file").alias(file)).agg(F.min("line").alias("first_line"), F.max("line").alias("last_line")), "nodes")
    edges = rows.filter("kind IS NOT NULL").select(F.col("label").alias("source"), "target", "kind", "line", "file")
    known = nodes.select(F.col("label").alias("target")).distinct().withColumn("known", F.lit(True))
    edges = edges.join(known, "target", "left").withColumn("kind", F.when(F.col("known"), F.col("kind")).otherwise("unresolved")).drop("known")
    return nodes, edges.select("source", "target", "kind", "line", "file")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(label, n_in, n_sources, is_entry, is_shared)`` by jumps; entries have none, shared labels several sources."""
    inn = edges.filter("kind = 'jump'").groupBy(F.col("target").alias("label")).agg(F.count("*").alias("n_in"), F.countDistinct("source").alias("n_sources"))
    out = nodes.select("label").distinct().join(inn, "label", "left").na.fill(0)
    return out.withColumns({"is_entry": F.col("n_in") == 0, "is_shared": F.col("n_sources") > 1})


def routes(nodes: DataFrame, edges: DataFrame, max_depth: int = 32, max_routes: int = 32) -> DataFrame:
    """``(entry, route, path, ends)``: simple paths of jumps from every entry, at most ``max_routes`` each.

    A path ends at a label without jumps, at the depth limit, or where only
    labels on the path follow (``cycle``). Both limits are part of the report:
    routes are taken in the order of the jumps' lines, of one line in the order
    of their targets (files can share labels). Paths are extended one
    step at a time; the limits bound each step's table. Jumps and entries
    are written once, as each step reads them again.
    """
    jumps = cut(edges.filter("kind = 'jump' AND source IS NOT NULL").groupBy("source", "target").agg(F.min("line").alias("line")), "jumps")
    entry = cut(degrees(nodes, edges).filter("is_entry").select("label"), "entries")
    live = entry.select(F.col("label").alias("entry"), F.array("label").alias("path"), F.array().cast("array<struct<line:bigint,label:string>>").alias("way"))
    done = None
    for depth in range(max_depth):
        tip = live.withColumn("tip", F.element_at("path", -1))
        nxt = tip.join(jumps.withColumnRenamed("source", "tip"), "tip", "left")
        nxt = nxt.withColumn("again", F.col("target").isNotNull() & F.array_contains("path", F.col("target")))
        free = F.max((F.col("target").isNotNull() & ~F.col("again")).cast("int")).over(Window.partitionBy("entry", "way"))
        nxt = nxt.withColumn("free", free)
        stop = nxt.filter("free = 0").groupBy("entry", "way").agg(F.first("path").alias("path"), F.max("again").alias("again"))
        stop = stop.select("entry", "way", "path", F.when(F.col("again"), "cycle").otherwise("end").alias("ends"))
        done = stop if done is None else done.unionByName(stop)
        grown = nxt.filter("target IS NOT NULL AND NOT again").select("entry", F.array_append("path", F.col("target")).alias("path"), F.array_append("way", F.struct(F.col("line").cast("long").alias("line"), F.col("target").alias("label"))).alias("way"))
        place = F.row_number().over(Window.partitionBy("entry").orderBy("way"))
        live = cut(grown.withColumn("p", place).filter(F.col("p") <= max_routes).drop("p"), "routes")
        if not live.limit(1).count():
            break
    if depth == max_depth - 1:
        done = done.unionByName(live.select("entry", "way", "path", F.lit("depth").alias("ends")))
    number = F.row_number().over(Window.partitionBy("entry").orderBy("way"))
    return done.withColumn("route", number).filter(F.col("route") <= max_routes).select("entry", "route", "path", "ends")


def ancestry(parents: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """``(id, root, depth, cycle)``: the end of each row's chain of parents, found by doubling steps.

    Rows still moving after as many steps as there are rows are in a cycle, or
    lead into one; their ``root`` is the smallest id of the cycle and their
    ``depth`` null. A parent that is no row ends the chain before it.
    """
    up = parents.select(F.col(key).alias("id"), F.col(parent).alias("next"))
    known = parents.select(F.col(key).alias("next")).distinct().withColumn("there", F.lit(True))
    # ``low`` is the smallest id met so far.
    up = up.join(known, "next", "left").select("id", F.when(F.col("there"), F.col("next")).alias("next"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"))
    up = cut(up.withColumn("low", F.least("id", F.coalesce("next", "id"))).withColumn("last", F.coalesce("next", "id")), "ancestry")
    rows, steps = up.count(), 1
    while steps <= rows and not up.filter("next IS NOT NULL").isEmpty():
        above = up.select(F.col("id").alias("next"), F.col("next").alias("higher"), F.col("depth").alias("more"), F.col("low").alias("lower"), F.col("last").alias("further"))
        up = up.join(above, "next", "left").select("id", F.col("higher").alias("next"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.least("low", F.coalesce("lower", "low")).alias("low"), F.coalesce("further", "last").alias("last"))
        up = cut(up, "ancestry")
        steps *= 2
    cycle = F.col("next").isNotNull()
    if not up.filter(cycle).isEmpty():
        # ``next`` is on the cycle, and its own smallest id is the cycle's.
        ring = up.filter(cycle).select(F.col("id").alias("next"), F.col("low").alias("ring"))
        up = up.join(ring, "next", "left")
    else:
        up = up.withColumn("ring", F.col("low"))
    return up.select("id", F.when(cycle, F.col("ring")).otherwise(F.col("last")).alias("root"), F.when(~cycle, F.col("depth")).alias("depth"), cycle.alias("cycle"))


def invalidate(records: DataFrame, links: DataFrame, changed: DataFrame) -> DataFrame:
    """``(id, kind, stale, cause, n_causes)``: records whose sources changed, level by level.

    ``records`` has ``id, kind`` with kind chunk, scene, label, route or brief,
    ``links`` ``id, up``, a row for each record that another stands on. A
    record is stale if it changed or a record of an earlier level that it
    stands on is stale; ``cause`` is ``changed``, else the smallest of those,
    ``n_causes`` how many there are. A brief depends on every other record
    (cause ``any``). Links that repeat count once.
    """
    stale = cut(records.select("id").join(changed.select("id").distinct(), "id", "left_semi").select("id", F.lit(True).alias("own"), F.lit(None).cast("string").alias("cause"), F.lit(1).cast("long").alias("n")), "stale")
    for kind in ("scene", "label", "route"):
        level = links.select("id", "up").distinct().join(records.filter(F.col("kind") == kind).select("id"), "id", "left_semi")
        hit = level.join(stale.select(F.col("id").alias("up")), "up").groupBy("id").agg(F.min("up").alias("cause"), F.count("*").alias("n"))
        both = stale.unionByName(hit.withColumn("own", F.lit(False)))
        stale = cut(both.groupBy("id").agg(F.max("own").alias("own"), F.min("cause").alias("cause"), F.sum("n").alias("n")), "stale")
    some = not stale.isEmpty()
    out = records.select("id", "kind").join(stale, "id", "left")
    brief = (F.col("kind") == "brief") & F.lit(some)
    cause = F.when(F.col("own"), "changed").otherwise(F.coalesce("cause", F.when(brief, "any")))
    return out.select("id", "kind", cause.isNotNull().alias("stale"), cause.alias("cause"), F.coalesce("n", F.lit(0)).alias("n_causes"))


def resume_state(units: DataFrame, live: DataFrame, key: str = "unit_id") -> DataFrame:
    """``(unit_id, status, todo)``: stored units against live digests; other digests are stale, missing units gone."""
    both = units.select(key, F.col("digest").alias("stored"), F.col("status").alias("was")).join(live.select(key, F.col("digest").alias("now")), key, "full_outer")
    status = F.when(F.col("was").isNull(), "pending").when(F.col("now").isNull(), "removed").when(~F.col("stored").eqNullSafe(F.col("now")), "stale").otherwise(F.col("was"))
    return both.select(key, status.alias("status"), status.isin("pending", "stale", "failed", "running").alias("todo"))


def digest_of(rows: DataFrame, by: list[str], *parts: Column) -> DataFrame:
    """``(*by, digest, n)``: order-free digest of each group's rows.

    Row digests are summed as numbers, so no group is gathered in one place.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)
    number = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(number(1 + 15 * i)).alias(f"s{i}") for i in range(4)])
    return sums.select(*by, F.sha2(F.concat_ws(":", "n", *[f"s{i}" for i in range(4)]), 256).alias("digest"), "n")


def assign_labels(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``chunks`` with ``label``: of the label that shares most lines in its file (the first of several), else the file's only label, else ``_unassigned``.

    ``chunks`` has ``chunk_id, file, first_line, last_line`` (lines may be null).
    Chunks meet the labels of their file through blocks of lines, and are
    written once with what is known of their file.
    """
    files = nodes.groupBy("file").agg(F.min("first_line").alias("__lo"), F.max("last_line").alias("__hi"), F.min("label").alias("only"), F.max("label").alias("__other"))
    rows = cut(chunks.join(files.withColumn("only", F.when(F.col("only") == F.col("__other"), F.col("only"))).drop("__other"), "file", "left"), "chunks")
    # A chunk without a first or last line goes as far as its file's labels do.
    low, high = F.greatest("first_line", "__lo"), F.least("last_line", "__hi")
    met = rows.filter(F.col("__lo").isNotNull() & (low <= high)).select("chunk_id", "file", "first_line", "last_line", blocks(low, high).alias("block"))
    spans = nodes.select("label", "file", F.col("first_line").alias("a"), F.col("last_line").alias("b"), blocks(F.col("first_line"), F.col("last_line")).alias("block"))
    shared = F.least("last_line", "b") - F.greatest("first_line", "a") + 1
    hits = met.join(spans, ["file", "block"]).filter(shared > 0)
    best = hits.groupBy("chunk_id").agg(F.max(F.struct(shared.alias("n"), (-F.col("a")).alias("back"), "label")).alias("m")).select("chunk_id", F.col("m.label").alias("by_lines"))
    rows = rows.join(best, "chunk_id", "left").withColumn("label", F.coalesce("by_lines", "only", F.lit("_unassigned")))
    return rows.drop("by_lines", "only", "__lo", "__hi")


def label_records(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(label, summary, evidence, upstream, unresolved, digest)`` of every label.

    ``chunks`` has ``label, chunk_id, summary, evidence`` (an array): a label's
    summary joins those of its chunks in order of their ids, or is ``Label
    `name```; evidence comes once each, in that order. A dynamic jump is noted
    in the summary. The digest changes with what the record is made of.

    A few labels may have all chunks: these are sorted by ranges of label and
    id, a range's rows of a label become one piece in its own task, and a label
    only joins its pieces in order.
    """
    none = F.array().cast("array<string>")
    c = F.struct(F.col("chunk_id").cast("string").alias("id"), F.trim(F.coalesce("summary", F.lit(""))).alias("summary"), F.coalesce("evidence", none).alias("evidence"))
    ranged = cut(chunks.select("label", c.alias("c")), "placed").repartitionByRange("label", "c").withColumn("part", F.spark_partition_id())
    pieces = ranged.groupBy("label", "part").agg(F.sort_array(F.collect_list("c")).alias("c"))
    said = F.array_join(F.filter(F.transform("c", lambda c: c["summary"]), lambda s: s != ""), "\n")
    shown = F.array_distinct(F.filter(F.flatten(F.transform("c", lambda c: c["evidence"])), lambda e: F.coalesce(e, F.lit("")) != ""))
    listed = F.to_json("c")
    pieces = pieces.select("label", "part", said.alias("said"), shown.alias("shown"), F.transform("c", lambda c: c["id"]).alias("ids"), F.substring(listed, F.lit(2), F.length(listed) - 2).alias("json"))
    parts = pieces.groupBy("label").agg(*[_in_order("part", name) for name in ("said", "shown", "ids", "json")])
    dynamic = edges.filter("kind = 'unresolved'").select(F.col("source").alias("label")).distinct().withColumn("unresolved", F.lit(True))
    rows = nodes.select("label").distinct().join(parts, "label", "left").join(dynamic, "label", "left").withColumn("unresolved", F.coalesce("unresolved", F.lit(False)))
    told = F.array_join(F.filter("said", lambda s: s != ""), "\n")
    body = F.coalesce(F.when(told != "", told), F.concat(F.lit("Label `"), F.col("label"), F.lit("`")))
    body = F.when(F.col("unresolved"), F.concat(body, F.lit("\n[unresolved dynamic jump/call present]"))).otherwise(body)
    # The JSON of (label, c, unresolved), of pieces.
    chunk_json = F.coalesce(F.concat(F.lit(',"c":['), F.array_join("json", ","), F.lit("]")), F.lit(""))
    json = F.concat(F.rtrim(F.to_json(F.struct("label")), F.lit("}")), chunk_json, F.lit(',"unresolved":'), F.col("unresolved").cast("string"), F.lit("}"))
    evidence, upstream = F.array_distinct(F.flatten("shown")), F.flatten("ids")
    return rows.select("label", body.alias("summary"), F.coalesce(evidence, none).alias("evidence"), F.coalesce(upstream, none).alias("upstream"), "unresolved", F.sha2(json.cast("binary"), 256).alias("digest"))


def route_records(found: DataFrame, labels: DataFrame) -> DataFrame:
    """``(entry, route, summary, evidence, unresolved, digest)`` of every route, folded along its path.

    ``found`` is what ``routes`` returns, ``labels`` what ``label_records``
    does. Paths have a bounded length, so that a route's parts fit a row.
    """
    steps = found.select("entry", "route", F.posexplode("path").alias("place", "label")).join(labels, "label", "left")
    summary = F.concat(F.lit("## "), F.col("label"), F.lit("\n"), F.coalesce("summary", F.lit("(no label summary)")))
    steps = steps.select("entry", "route", "place", summary.alias("said"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), F.coalesce("digest", F.lit("")).alias("digest"), F.coalesce("unresolved", F.lit(False)).alias("unresolved"))
    # A list of its own for each column, so that one that nobody asks for is not made.
    rows = steps.groupBy("entry", "route").agg(*[_in_order("place", name) for name in ("said", "evidence", "digest")], F.max("unresolved").alias("unresolved"))
    body = F.array_join("said", "\n\n")
    body = F.when(F.col("unresolved"), F.concat(body, F.lit("\n\n[route contains unresolved dynamic jump/call]"))).otherwise(body)
    digest = F.sha2(F.concat_ws(",", "digest").cast("binary"), 256)
    return rows.select("entry", "route", body.alias("summary"), F.array_distinct(F.flatten("evidence")).alias("evidence"), "unresolved", digest.alias("digest"))
