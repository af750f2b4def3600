"""Story retrieval: what a batch of lines needs to know of characters, terms, scenes and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.tables import cut

from .intervals import scene_scores

#: Aliases up to which every task gets all of them.
BROADCAST_ALIASES = 100_000
#: Fixed value: aliases that are matched as words, not as parts of words.
WORD_LIKE = r"^[A-Za-z0-9_ -]+$"


def target_spans(items: DataFrame, key: str = "target_id") -> DataFrame:
    """``(target_id, first, last)``: the lines that a target's items cover; null without any.

    Items may have ``line_start, line_end, line_number`` and ``line``, which
    counts from 0. An item's last line is its end, else its number, else its line.
    """
    have = lambda c: F.col(c).cast("int") if c in items.columns else F.lit(None).cast("int")
    end = F.coalesce(have("line_end"), have("line_number"), have("line") + 1)
    lines = F.array_compact(F.array(have("line_start"), end))
    return items.groupBy(key).agg(F.min(F.array_min(lines)).alias("first"), F.max(F.array_max(lines)).alias("last"))


def _pairs_of_chars(text: Column) -> Column:
    chars = F.split(text, "")
    return F.array_compact(F.zip_with(chars, F.slice(chars, 2, F.greatest(F.length(text) - 1, F.lit(0))), lambda a, b: F.concat(a, b)))


def alias_hits(texts: DataFrame, aliases: DataFrame, key: str, text: str, who: str, alias: str = "alias", broadcast_aliases: int = BROADCAST_ALIASES) -> DataFrame:
    """``(key, who)``: distinct texts and the owners of the aliases that stand in them, case aside.

    Aliases of one character match nothing. Those of letters, digits, ``_``,
    blanks and ``-`` match whole words, others anywhere. Texts and aliases meet
    by the alias' first word, or its first two signs, and are confirmed then.
    Few aliases are handed to the tasks that read the texts; where there are
    many, probes meet them without their texts, which are joined again.
    """
    low = aliases.select(who, F.lower(F.trim(alias)).alias("__alias")).filter(F.length("__alias") > 1).distinct()
    token = F.regexp_extract("__alias", "[a-z0-9_]+", 0)
    word = F.col("__alias").rlike(WORD_LIKE) & (token != "")
    low = low.withColumn("__word", F.col("__alias").rlike(WORD_LIKE)).withColumn("__probe", F.when(word, F.concat(F.lit("w"), token)).otherwise(F.concat(F.lit("c"), F.substring("__alias", 1, 2))))
    # Written, as its size decides how probes meet it: they are many times the texts, whatever Spark takes them for.
    low = cut(low, "aliases")
    n, n_signs = low.agg(F.count("*"), F.count_if(F.col("__probe").startswith("c"))).first()
    said = texts.select(key, F.lower(text).alias("__text")).filter("__text IS NOT NULL")
    words = F.transform(F.regexp_extract_all("__text", F.lit("[a-z0-9_]+"), F.lit(0)), lambda x: F.concat(F.lit("w"), x))
    chars = F.transform(_pairs_of_chars(F.col("__text")), lambda x: F.concat(F.lit("c"), x))
    # Pairs of signs are listed only if an alias asks for them.
    probe = F.explode(F.array_distinct(F.concat(words, chars) if n_signs else words)).alias("__probe")
    if n <= broadcast_aliases:
        near = said.select(key, "__text", probe).join(F.broadcast(low), "__probe")
    else:
        near = said.select(key, probe).join(low.hint("merge"), "__probe").drop("__probe").distinct().join(said, key)
    whole = F.expr(r"regexp_like(__text, concat('(?<![a-z0-9_])\\Q', __alias, '\\E(?![a-z0-9_])'))")
    return near.filter(F.when(F.col("__word"), whole).otherwise(F.contains("__text", F.col("__alias")))).select(key, who).distinct()


def active_characters(targets: DataFrame, speakers: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(target_id, char_id)``: characters whose alias speaks or is named in a target.

    ``targets`` has ``target_id, text``, ``speakers`` ``target_id, speaker``,
    ``aliases`` ``char_id, alias``. Speakers match whole aliases, of any length.
    """
    named = alias_hits(targets, aliases, "target_id", "text", "char_id")
    norm = lambda c: F.lower(F.trim(c))
    voice = speakers.select("target_id", norm("speaker").alias("a")).filter("a <> ''").distinct().join(aliases.select("char_id", norm("alias").alias("a")), "a").select("target_id", "char_id")
    return named.unionByName(voice).distinct()


def retrieve(targets: DataFrame, speakers: DataFrame, aliases: DataFrame, scenes: DataFrame, relations: DataFrame, terms: DataFrame, top_relations: int = 6, top_terms: int = 12, top_scenes: int = 3) -> dict[str, DataFrame]:
    """What each target needs to know, as tables ``characters, scenes, relations, terms`` by ``target_id``.

    ``targets`` has ``target_id, file, first, last, text``, ``scenes``
    ``scene_id, file, first, last, people``, ``relations`` ``left, right,
    confidence``, ``terms`` ``ordinal, term, alias``. Characters that speak or
    are named choose the scenes; the people of the best scenes join them;
    relations need both ends among them, the surest first (a confidence that is
    no finite number counts as 0); terms come in their own order.
    """
    # Each is read several times. Of tables that come from the driver Spark knows no size, and might hand out the other side.
    aliases, relations, terms, scenes = cut(aliases, "aliases"), cut(relations, "relations"), cut(terms, "terms"), cut(scenes, "scenes")
    active = cut(active_characters(targets, speakers, aliases), "active")
    people = active.groupBy("target_id").agg(F.collect_set("char_id").alias("people"))
    placed = cut(targets.select("target_id", "file", "first", "last").join(people, "target_id", "left"), "placed")
    ranked = cut(scene_scores(placed, scenes, top_scenes), "ranked")
    joined = ranked.join(scenes.select("scene_id", F.explode("people").alias("char_id")), "scene_id").filter(F.trim("char_id") != "").select("target_id", "char_id")
    cast = cut(active.unionByName(joined).distinct(), "cast")

    sure = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    sure = F.when(F.isnan(sure) | (F.abs(sure) == float("inf")), 0.0).otherwise(sure)
    both = relations.join(cast.withColumnRenamed("char_id", "left"), "left").join(cast.withColumnRenamed("char_id", "right"), ["target_id", "right"])
    place = lambda *order: F.row_number().over(Window.partitionBy("target_id").orderBy(*order))
    both = both.withColumn("rank", place(sure.desc(), "left", "right")).filter(F.col("rank") <= top_relations)
    hits = alias_hits(targets, terms, "target_id", "text", "ordinal").withColumn("rank", place("ordinal")).filter(F.col("rank") <= top_terms)
    return {"characters": cast, "scenes": ranked, "relations": both.select("target_id", "left", "right", "confidence", "rank"), "terms": hits.join(terms.select("ordinal", "term").distinct(), "ordinal").select("target_id", "term", "rank")}
