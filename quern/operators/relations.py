"""Relation graphs of speakers: shared scenes, dialogue next to each other, mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .context import runs

#: Weights of the components in the total, in tie order, and of co-mentions.
COMPONENTS = (("scene", 0.45), ("dialogue", 0.35), ("mention", 0.20))
CO_MENTION_BY_SPEAKER, CO_MENTION_ALONE = 0.35, 0.55
#: Least score and quantile of relation edges.
EDGE_FLOOR, EDGE_QUANTILE = 0.18, 0.65


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """Unordered pair as (smaller, larger)."""
    return F.least(a, b), F.greatest(a, b)


def participants(units: DataFrame, speaker: str, mentioned: str | None) -> Column:
    """Distinct people of a unit: its speaker and those it mentions."""
    own = F.array_compact(F.array(F.col(speaker)))
    return F.array_distinct(F.concat(own, F.col(mentioned)) if mentioned else own)


def scenes(units: DataFrame, source: str, order: list[str], size: int = 12) -> DataFrame:
    """Adds ``run`` and ``scene``: ``size`` rows each, from the start of every run of one source."""
    marked = runs(units, [], order, source, "run") if source not in order else units.withColumn("run", F.col(source))
    w = Window.partitionBy("run").orderBy(*order)
    return marked.withColumn("scene", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def scene_pairs(units: DataFrame, people: str = "participants") -> DataFrame:
    """``(left, right, value)``: scenes that two people share. Needs ``run`` and ``scene``."""
    cast = units.select("run", "scene", F.explode(people).alias("who")).distinct()
    a, b = cast.withColumnRenamed("who", "left"), cast.withColumnRenamed("who", "right")
    return a.join(b, ["run", "scene"]).filter("left < right").groupBy("left", "right").agg(F.count("*").cast("double").alias("value"))


def dialogue_pairs(units: DataFrame, run: str, order: list[str], speaker: str) -> DataFrame:
    """``(left, right, value)``: spoken rows next to each other with different speakers."""
    before = F.lag(speaker).over(Window.partitionBy(run).orderBy(*order))
    near = units.filter(F.col(speaker).isNotNull()).select(F.col(speaker).alias("a"), before.alias("b")).filter("b IS NOT NULL AND a <> b")
    left, right = pair(F.col("a"), F.col("b"))
    return near.groupBy(left.alias("left"), right.alias("right")).agg(F.count("*").cast("double").alias("value"))


def mention_pairs(units: DataFrame, speaker: str, mentioned: str) -> DataFrame:
    """``(left, right, value)``: a speaker and whom they mention 1 each, people mentioned together a part."""
    said = units.filter(F.col(speaker).isNotNull()).select(F.col(speaker).alias("a"), F.explode(F.array_distinct(mentioned)).alias("b")).filter("a <> b")
    left, right = pair(F.col("a"), F.col("b"))
    direct = said.select(left.alias("left"), right.alias("right"), F.lit(1.0).alias("w"))
    others = F.array_sort(F.filter(F.array_distinct(mentioned), lambda m: ~m.eqNullSafe(F.col(speaker))))
    both = units.select(F.when(F.col(speaker).isNotNull(), CO_MENTION_BY_SPEAKER).otherwise(CO_MENTION_ALONE).alias("w"), others.alias("m")).filter(F.size("m") > 1)
    both = both.select("w", "m", F.posexplode("m").alias("i", "left")).select("w", "left", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("right"))
    return direct.unionByName(both.select("left", "right", "w")).groupBy("left", "right").agg(F.sum("w").alias("value"))


def density(pairs: DataFrame, presence: DataFrame) -> DataFrame:
    """Each value over the geometric mean of both people's presence ``(who, n)``, at least 1 each."""
    one = F.lit(1)
    out = pairs.join(presence.select(F.col("who").alias("left"), F.col("n").alias("nl")), "left", "left").join(presence.select(F.col("who").alias("right"), F.col("n").alias("nr")), "right", "left")
    size = F.sqrt(F.greatest(one, F.coalesce("nl", one)) * F.greatest(one, F.coalesce("nr", one)).cast("double"))
    return out.select("left", "right", (F.col("value") / size).alias("value"))


def scaled(pairs: DataFrame) -> DataFrame:
    """Values over their maximum; all 0 if it is not above 0."""
    top = pairs.agg(F.max("value").alias("__top"))
    return pairs.join(F.broadcast(top)).select("left", "right", F.when(F.col("__top") > 0, F.col("value") / F.col("__top")).otherwise(0.0).alias("value"))  # one row


def relation_scores(people: DataFrame, scene: DataFrame, dialogue: DataFrame, mention: DataFrame) -> DataFrame:
    """``(left, right, scene, dialogue, mention, score, dominant)`` of all pairs of the chosen ``people (who)``.

    Pairs that never meet score 0. The first of the largest weighted
    components is the dominant one, null if the score is 0. ``people`` is the
    short list that a report is about.
    """
    out = people.select(F.col("who").alias("left")).join(people.select(F.col("who").alias("right")), F.col("left") < F.col("right"))
    for name, part in (("scene", scene), ("dialogue", dialogue), ("mention", mention)):
        out = out.join(part.withColumnRenamed("value", name), ["left", "right"], "left")
    weighted = {n: F.coalesce(F.col(n), F.lit(0.0)) * w for n, w in COMPONENTS}
    total, top = weighted["scene"] + weighted["dialogue"] + weighted["mention"], F.greatest(*weighted.values())
    dominant = F.when(top <= 0, None)
    for n, w in weighted.items():
        dominant = dominant.when(w == top, n)
    return out.select("left", "right", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n, _ in COMPONENTS], total.alias("score"), dominant.alias("dominant"))


def select_edges(scores: DataFrame, people: int, floor: float = EDGE_FLOOR, quantile: float = EDGE_QUANTILE) -> DataFrame:
    """Edges worth showing: above the floor and the quantile, at most one less than people (3 at least), 3 if there are."""
    good = scores.filter("score > 0")
    cut = good.agg(F.greatest(F.lit(floor), F.percentile("score", quantile)).alias("__cut"), F.count("*").alias("__n"))
    # Only what can be shown is ranked.
    most, best = max(people - 1, 3), (F.col("score").desc(), F.col("left"), F.col("right"))
    ranked = good.orderBy(*best).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*best)))
    keep = ((F.col("score") >= F.col("__cut")) & (F.col("rank") <= most)) | (F.col("rank") <= F.least(F.lit(3), F.col("__n")))
    return ranked.join(F.broadcast(cut)).filter(keep).drop("__cut", "__n")  # one row


def speaker_statistics(units: DataFrame, speaker: str, file: str, line: str, name: str) -> DataFrame:
    """Per speaker: lines, files, first and last line, names by frequency, then in order."""
    named = units.filter(F.col(speaker).isNotNull())
    base = named.groupBy(speaker).agg(F.count("*").alias("lines"), F.countDistinct(file).alias("files"), F.min(line).alias("first_line"), F.max(line).alias("last_line"))
    names = named.filter(F.col(name).isNotNull()).groupBy(speaker, name).agg(F.count("*").alias("n"))
    packed = names.groupBy(speaker).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), F.lower(name).alias("low"), F.col(name).alias("name")))).alias("names"))
    return base.join(packed, speaker, "left").withColumn("names", F.transform("names", lambda x: x["name"]))


def top_speakers(units: DataFrame, name: str, n: int) -> DataFrame:
    """The ``n`` most frequent names; ties in order of the lower-case name."""
    return units.filter(F.col(name) != "").groupBy(name).agg(F.count("*").alias("lines")).orderBy(F.col("lines").desc(), F.lower(name), name).limit(n)


def seed(scores: DataFrame, raw: str = "score") -> DataFrame:
    """Relations with evidence, confidence rounded to 4 places."""
    return scores.filter(F.col(raw) > 0).select("left", "right", "dominant", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(raw))), 4).alias("confidence"))
