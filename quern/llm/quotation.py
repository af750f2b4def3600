"""Operator 3: chat formatting by quotation linking.

Lines that start with ``>`` are quoted, once per sign. A passage is a run of
lines of one level, without the lines that announce deeper quotes. Its
normalised text is hashed and joined to the message of the same conversation
that first said it: as a whole, as a paragraph, a line or a sentence. A passage
that nobody said in one piece is joined by its paragraphs and sentences (a line
without a full stop is one): it comes from the message that said most of its
sentences, if that is more than half of them; a passage of which half or more
is unknown comes from nowhere. A message answers the latest of the messages
that its shallowest passages come from. Messages, freed of quotes, are ordered
by thread and laid out as conversations.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A line that announces a quotation; it goes with the quotes.
ATTRIBUTION = r"^\s*(On|Am|Le|El)\b.*\b(wrote|schrieb|a écrit|escribió):?\s*$"
#: White space between sentences.
SENTENCE = r"(?<=[.!?])[ \t]+"
#: Turns of a thread that one row of a conversation holds.
PART_TURNS = 1000


def normalise(text: Column) -> Column:
    """Lower case (A-Z), white space as single spaces, none at the ends."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[\x09-\x0D\x20]+", " "))


def _mark(text: Column) -> Column:
    return F.md5(normalise(text).cast("binary"))


def _quoted_text(passage: Column, depth: Column) -> Column:
    """The passage without its announcing lines, as ``own`` is; one of such lines alone, with nothing deeper, is a quote of them."""
    rest = F.array_join(F.filter(F.split(passage["body"], "\n"), lambda x: ~x.rlike(ATTRIBUTION)), "\n")
    return F.when((normalise(rest) == "") & (passage["level"] == depth), passage["body"]).otherwise(rest)


def _sentences(text: Column) -> Column:
    return F.flatten(F.transform(F.split(text, "\n"), lambda x: F.split(x, SENTENCE)))


def _lines(text: Column) -> Column:
    """``(line, para)`` marks of the different sentences with words, each with its paragraph's."""
    paras = F.transform(F.split(text, r"\n[ \t]*\n"), lambda p: F.struct(_mark(p).alias("para"), F.transform(F.filter(_sentences(p), lambda x: normalise(x) != ""), _mark).alias("lines")))
    return F.array_distinct(F.flatten(F.transform(paras, lambda p: F.transform(p["lines"], lambda x: F.struct(x.alias("line"), p["para"].alias("para"))))))


def parse_quotes(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``passages``, an array of ``(level, body)`` runs in order, ``own`` and ``depth``.

    ``own`` is the text without quoted and announcing lines, ``depth`` the
    deepest level. A null text has no passage and stays null.
    """
    lines = F.split(F.col(text_col), "\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, r"^(?:[ \t]*>)+", 0), "[ \t]", ""))
    bare = lambda x: F.regexp_replace(x, r"^(?:[ \t]*>)+[ \t]?", "")
    out = messages.withColumn("__lines", F.transform(lines, lambda x: F.struct(level(x).alias("level"), bare(x).alias("body"))))
    # Runs begin where the level differs from the line before.
    out = out.withColumn("__starts", F.expr("filter(sequence(1, size(__lines)), i -> i = 1 OR __lines[i - 1].level <> __lines[i - 2].level)"))
    out = out.withColumn(
        "__runs",
        F.expr(
            """transform(__starts, (s, k) -> named_struct('level', __lines[s - 1].level, 'body',
               array_join(transform(slice(__lines, s, coalesce(get(__starts, k + 1), size(__lines) + 1) - s), x -> x.body), '\n')))"""
        ),
    )
    out = out.withColumn("passages", F.expr("coalesce(filter(__runs, r -> r.level > 0), array())"))
    out = out.withColumn("depth", F.coalesce(F.array_max(F.transform("passages", lambda r: r["level"])), F.lit(0)))
    own = F.array_join(F.transform(F.filter("__lines", lambda x: (x["level"] == 0) & ~((F.col("depth") > 0) & x["body"].rlike(ATTRIBUTION))), lambda x: x["body"]), "\n")
    return out.withColumn("own", F.when(F.col("depth") > 0, F.trim(F.regexp_replace(own, r"\n{3,}", "\n\n"))).otherwise(F.col(text_col))).drop("__lines", "__starts", "__runs")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, reply_to, thread, n_quotes, n_linked, depth)`` of every message.

    ``text`` is free of quotes, ``reply_to`` the turn that it answers or null,
    ``thread`` the turn that its chain of answers starts from. Ordered by
    ``(thread, turn)`` a conversation has every answer after what it answers,
    thread by thread. Passages and originals without words do not link, nor do
    messages without conversation or turn. Of originals that said as many
    sentences of a passage the first turn counts, and only turns before the quoting one. Rows that repeat are all
    returned; an empty table gives an empty result; other columns are not read;
    texts of any length are parsed whole.
    """
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("said"))
    parsed = parse_quotes(rows, "said").withColumn("text_id", F.md5(F.coalesce("said", F.lit("")).cast("binary")))

    # Filters come before parsing, and explode_outer infers none: the optimizer
    # would copy the parsing into a filter that stands after it.
    placed = rows.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("said").isNotNull()).withColumn("text_id", F.md5(F.col("said").cast("binary")))
    quoted = parse_quotes(placed.filter(F.col("said").rlike(r"(^|\n)[ \t]*>")), "said")
    quoted = quoted.select("conv_id", "turn", "text_id", "depth", F.array_min(F.transform("passages", lambda p: p["level"])).alias("top"), F.explode_outer("passages").alias("p"))
    quoted = quoted.select("conv_id", "turn", "text_id", "top", "p.level", _quoted_text(F.col("p"), F.col("depth")).alias("plain")).filter(normalise(F.col("plain")) != "")
    quoted = materialize(quoted.select("conv_id", "turn", "text_id", "top", "level", _mark(F.col("plain")).alias("mark"), _lines(F.col("plain")).alias("lines")).withColumn("run_id", F.md5(F.to_json("lines"))), "quoted")

    pieces = F.array_distinct(F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n"), _sentences(F.col("own"))))
    said = parse_quotes(placed, "said").select("conv_id", "turn", F.explode_outer(F.array_distinct(F.transform(F.filter(pieces, lambda x: normalise(x) != ""), _mark))).alias("mark")).filter("mark IS NOT NULL")
    # A passage of one line has no smaller pieces; one line said over and over has.
    smaller = F.exists("lines", lambda x: x["line"] != F.col("mark"))
    runs = quoted.filter(smaller).dropDuplicates(["conv_id", "run_id"]).select("conv_id", "run_id", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("at", "l"))
    parts = runs.select("conv_id", "run_id", "n_lines", "at", F.explode(F.array_distinct(F.array("l.line", "l.para"))).alias("mark"))
    wanted = quoted.select("conv_id", "mark").union(parts.select("conv_id", "mark")).distinct()
    held = materialize(said.join(wanted, ["conv_id", "mark"], "left_semi"), "held")
    # Pre-aggregated, so that a line that all turns repeat joins once.
    first = held.groupBy("conv_id", "mark").agg(F.min("turn").alias("original"))
    links = quoted.join(first, ["conv_id", "mark"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))

    # Of messages that hold the same wanted pieces only the first can be an original.
    same = held.groupBy("conv_id", "turn").agg(F.md5(F.array_join(F.array_sort(F.collect_set("mark")), "")).alias("held_id")).groupBy("conv_id", "held_id").agg(F.min("turn").alias("turn")).select("conv_id", "turn")
    shared = parts.join(held.join(same, ["conv_id", "turn"], "left_semi"), ["conv_id", "mark"]).groupBy("conv_id", "run_id", "n_lines", "turn").agg(F.countDistinct("at").alias("covered"))
    shared = shared.filter(F.col("covered") * 2 > F.col("n_lines")).groupBy("conv_id", "run_id", "covered").agg(F.min("turn").alias("part"))
    rest = links.filter(F.col("original").isNull() & smaller).select("conv_id", "run_id", "turn").distinct()
    found = rest.join(shared, ["conv_id", "run_id"]).filter("part < turn").groupBy("conv_id", "run_id", "turn").agg(F.max_by("part", "covered").alias("part"))
    links = links.join(found, ["conv_id", "run_id", "turn"], "left").withColumn("original", F.coalesce("original", "part"))
    # Rows that repeat bring their passages again; n_linked counts distinct ones.
    links = links.groupBy("conv_id", "turn", "text_id").agg(
        F.max(F.when(F.col("level") == F.col("top"), F.col("original"))).alias("near"), F.max("original").alias("far"), F.countDistinct(F.when(F.col("original").isNotNull(), F.struct("level", "mark"))).alias("n_linked")
    )
    links = materialize(links.select("conv_id", "turn", "text_id", F.coalesce("near", "far").alias("reply_to"), "n_linked"), "links")

    # Chains of answers, halved in each step until none moves.
    up = materialize(links.filter("reply_to IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("thread")), "chains")
    while True:
        above = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"))
        up = materialize(up.join(above, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("higher", "thread").alias("thread"), F.col("higher").isNotNull().alias("moved")), "chains")
        if not up.filter("moved").limit(1).count():
            break
    out = parsed.join(links, ["conv_id", "turn", "text_id"], "left").join(up.drop("moved"), ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.size("passages").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("depth").cast("long").alias("depth")
    )


def build_conversations(linked: DataFrame) -> DataFrame:
    """``(conv_id, thread, part, messages)`` from ``link_quotes``: a thread's messages in the order of answers.

    ``messages`` are ``(turn, role, text, reply_to)``, free of quotes; answers
    come after what they answer. A row holds the turns of one thousand
    (``PART_TURNS``), so that a conversation of any length is rows in order of
    ``(thread, part)``, none of which grows with it. Messages without
    conversation or turn stand alone, a row each.
    """
    said = F.struct("turn", "role", "text", "reply_to")
    placed = linked.filter("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("part", F.floor(F.col("turn") / PART_TURNS))
    rows = placed.groupBy("conv_id", "thread", "part").agg(F.array_sort(F.collect_list(said)).alias("messages"))
    alone = linked.filter("conv_id IS NULL OR turn IS NULL").select("conv_id", "thread", F.lit(None).cast("long").alias("part"), F.array(said).alias("messages"))
    return rows.unionByName(alone)
