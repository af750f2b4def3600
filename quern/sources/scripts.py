"""Dialogue scripts as DataFrames: pairs, units with identities, dialogue lines.

The line rules are regular expressions on one line; what depends on lines
above (block, speaker, pair) are windows over the file's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import identity
from quern.operators.context import block_occurrences

_STRING = r'"((?:[^"\\]|\\.)*)"'


def unescape(text: Column) -> Column:
    """Escaped quotes, line breaks and backslashes of a script string."""
    parts = F.split(text, r"\\\\", -1)  # what stands between escaped backslashes
    plain = F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')))
    return F.array_join(plain, "\\")


def character_names(lines: DataFrame) -> DataFrame:
    """``(speaker, name)`` from ``define x = Character("Name")`` lines; later definitions win."""
    p = rf"^\s*define\s+([A-Za-z_]\w*)\s*=\s*Character\(\s*(?:_\()?{_STRING}"
    rows = lines.filter(F.contains("text", F.lit("Character("))).select(F.regexp_extract("text", p, 1).alias("speaker"), F.regexp_extract("text", p, 2).alias("name"), F.struct("path", "line").alias("at")).filter("speaker <> ''")
    return rows.groupBy("speaker").agg(F.max_by("name", "at").alias("name"))


def dialogue(lines: DataFrame) -> DataFrame:
    """``(path, line, speaker, text)`` of spoken and narrated lines.

    ``extend`` takes the speaker of the line before it; a line without speaker
    resets it.
    """
    p = rf"^\s*(?:([A-Za-z_]\w*)(?:\s+[a-z_]\w*)*\s+)?{_STRING}\s*(?:with\s+\w+)?\s*$"
    said = lines.filter(F.col("text").rlike(p)).select("path", "line", F.regexp_extract("text", p, 1).alias("who"), unescape(F.regexp_extract("text", p, 2)).alias("text"))
    said = said.filter(~F.col("who").isin("voice", "play", "old", "new", "label", "scene", "show", "image"))
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("who") != "extend", F.col("who")), ignorenulls=True).over(w)
    return said.withColumn("speaker", F.nullif(F.when(F.col("who") == "extend", carried).otherwise(F.col("who")), F.lit(""))).select("path", "line", "speaker", "text")


def translation_pairs(lines: DataFrame) -> DataFrame:
    """``(path, line, source, translation, form)``: commented sources over their lines, and old/new pairs.

    Voice lines between a source and its translation are passed over.
    """
    w = Window.partitionBy("path").orderBy("line")
    kept = lines.filter(~F.col("text").rlike(r"^\s*(?:#\s*)?voice\b") & (F.trim("text") != ""))
    note, own = rf"^\s*#\s*(?:[A-Za-z_]\w*(?:\s+\w+)*\s+)?{_STRING}\s*$", rf"^\s*(?:[A-Za-z_]\w*(?:\s+\w+)*\s+)?{_STRING}\s*$"
    old, new = rf"^\s*old\s+{_STRING}\s*$", rf"^\s*new\s+{_STRING}\s*$"
    rows = kept.withColumn("next", F.lead("text").over(w)).withColumn("next_line", F.lead("line").over(w))
    form = F.when(F.col("text").rlike(note) & F.col("next").rlike(own), "comment").when(F.col("text").rlike(old) & F.col("next").rlike(new), "old_new")
    pick = lambda a, b, c: F.when(F.col("form") == "comment", F.regexp_extract(c, a, 1)).otherwise(F.regexp_extract(c, b, 1))
    rows = rows.withColumn("form", form).filter("form IS NOT NULL")
    return rows.select("path", F.col("next_line").alias("line"), unescape(pick(note, old, "text")).alias("source"), unescape(pick(own, new, "next")).alias("translation"), "form")


def units(lines: DataFrame) -> DataFrame:
    """``(path, line, block, occurrence, index, source, translation, unit_id, translated)`` of a translation tree.

    The block is the nearest ``translate`` header above; ``index`` counts the
    pairs of a block's run from 0.
    """
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = r"^\s*translate\s+\w+\s+([\w.]+)\s*:"
    block = F.last(F.when(F.col("text").rlike(head), F.regexp_extract("text", head, 1)), ignorenulls=True).over(w)
    opened = F.count_if(F.col("text").rlike(head)).over(w)
    places = lines.select("path", "line", F.coalesce(block, F.lit("")).alias("block"), opened.alias("opening"))
    rows = translation_pairs(lines).join(places, ["path", "line"])
    rows = block_occurrences(rows.withColumn("key", F.struct("block", "opening")), ["path"], ["line"], "key", "run").drop("key", "run")
    rows = rows.withColumn("occurrence", F.dense_rank().over(Window.partitionBy("path", "block").orderBy("opening")))
    rows = rows.withColumn("index", F.row_number().over(Window.partitionBy("path", "opening").orderBy("line")) - 1)
    rows = rows.withColumn("unit_id", identity(F.col("path"), F.col("block"), F.col("occurrence"), F.col("index"), F.col("source")))
    done = (F.trim("translation") != "") & (F.col("translation") != F.col("source"))
    return rows.withColumn("translated", done).select("path", "line", "block", "occurrence", "index", "source", "translation", "unit_id", "translated")


def classify(units_: DataFrame, excluded: Column | None = None) -> DataFrame:
    """Adds ``classification``: explicitly_excluded, already_translated, translatable or unsupported, the first that holds."""
    ex = excluded if excluded is not None else F.lit(False)
    c = F.when(F.coalesce(ex, F.lit(False)), "explicitly_excluded").when(F.col("translated"), "already_translated").when(F.col("source").rlike(r"\p{L}"), "translatable").otherwise("unsupported")
    return units_.withColumn("classification", c)


def line_counts(lines: DataFrame) -> DataFrame:
    """Per file: blocks, old, new, commented source lines, and new lines with text."""
    t = F.col("text")
    return lines.groupBy("path").agg(
        F.count_if(t.rlike(r"^\s*translate\s+\w+\s+\S+:")).alias("blocks"),
        F.count_if(t.rlike(r'^\s*old\s+"')).alias("old_lines"),
        F.count_if(t.rlike(r'^\s*new\s+"')).alias("new_lines"),
        F.count_if(t.rlike(r'^\s*#\s*.*"')).alias("commented"),
        F.count_if(t.rlike(r'^\s*new\s+"[^"]')).alias("translated_new"),
    )


def splice(files: DataFrame, edits: DataFrame) -> DataFrame:
    """``(path, line, text)`` with the edits of each line applied from right to left.

    ``edits`` has ``path, line, first, last, replacement``, offsets in
    characters, last exclusive; edits of a line must not overlap.
    """
    packed = edits.groupBy("path", "line").agg(F.sort_array(F.collect_list(F.struct("first", "last", "replacement")), asc=False).alias("edits"))
    out = files.join(packed, ["path", "line"], "left")
    change = F.aggregate("edits", F.col("text"), lambda t, e: F.concat(F.substring(t, F.lit(1), e["first"]), e["replacement"], F.substring(t, e["last"] + 1, F.length(t))))
    return out.select("path", "line", F.coalesce(change, "text").alias("text"))
