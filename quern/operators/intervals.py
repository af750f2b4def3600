"""Line intervals: overlaps, points, distances.

Intervals of one file are joined through the blocks of ``BLOCK`` lines that
they touch, an equality join, so that long files do not become all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
#: Fixed value: lines within which a scene counts as near.
REACH = 40


def blocks(first: Column, last: Column) -> Column:
    """A row for each block that the lines touch."""
    return F.explode(F.sequence(F.floor(first / BLOCK).cast("long"), F.floor(last / BLOCK).cast("long")))


def ordered(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Swapped ends put right, a missing end filled from the other."""
    a, b = F.coalesce(first, last), F.coalesce(last, first)
    return rows.withColumns({first: F.least(a, b), last: F.greatest(a, b)})


def overlaps(left: DataFrame, right: DataFrame, file: str = "file", first: str = "first", last: str = "last", left_id: str = "left_id", right_id: str = "right_id") -> DataFrame:
    """``(left_id, right_id, common, length)``: pairs of one file with common lines; length is the right one's."""
    a = ordered(left, first, last).filter(F.col(first).isNotNull()).select(left_id, F.col(file).alias("__f"), F.col(first).alias("a1"), F.col(last).alias("a2")).withColumn("__b", blocks(F.col("a1"), F.col("a2")))
    b = ordered(right, first, last).filter(F.col(first).isNotNull()).select(right_id, F.col(file).alias("__f"), F.col(first).alias("b1"), F.col(last).alias("b2")).withColumn("__b", blocks(F.col("b1"), F.col("b2")))
    # A pair is met in each block that both touch and counted in the first of them.
    here = F.col("__b") == F.floor(F.greatest("a1", "b1") / BLOCK)
    hit = a.join(b, ["__f", "__b"]).filter((F.col("a1") <= F.col("b2")) & (F.col("b1") <= F.col("a2")) & here)
    return hit.select(left_id, right_id, (F.least("a2", "b2") - F.greatest("a1", "b1") + 1).alias("common"), (F.col("b2") - F.col("b1")).alias("length"))


def tightest(pairs: DataFrame, left_id: str, right_id: str, n: int = 1) -> DataFrame:
    """The ``n`` shortest right intervals of each left one; ties by id."""
    w = Window.partitionBy(left_id).orderBy("length", right_id)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def containing(points: DataFrame, spans: DataFrame, file: str = "file", line: str = "line", point_id: str = "left_id", span_id: str = "right_id") -> DataFrame:
    """Spans that a line lies in, as ``overlaps``."""
    return overlaps(points.withColumns({"first": F.col(line), "last": F.col(line)}), spans, file, "first", "last", point_id, span_id)


def scene_scores(targets: DataFrame, scenes: DataFrame, top: int = 3) -> DataFrame:
    """``(target_id, scene_id, score, rank)`` of the best scenes of each target.

    100 and the common lines where they overlap, else 40 less the distance;
    50 for the same file, 8 for each shared person. Scenes of another file are
    left out; where either has no file, people alone bring them together.
    ``scenes`` and ``targets`` have ``file, first, last, people``.

    Scenes of a file within ``REACH`` lines meet through blocks. All others
    score by people alone: of scenes with the same people the first ``top`` by
    id, and of these the best for each set of people that a target has.
    """
    people = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    t = targets.select("target_id", F.col("file").alias("tf"), F.col("first").alias("t1"), F.col("last").alias("t2"), people("people").alias("tp"))
    s = scenes.select("scene_id", F.col("file").alias("sf"), F.col("first").alias("s1"), F.col("last").alias("s2"), people("people").alias("sp"))
    # Without a file on both sides only shared people score: they are the key.
    some = lambda d, c: d.withColumn("who", F.explode(c))
    lone_t, lone_s = t.filter("tf IS NULL"), s.filter("sf IS NULL")
    loose = some(lone_t, "tp").join(some(s, "sp"), "who").unionByName(some(t.filter("tf IS NOT NULL"), "tp").join(some(lone_s, "sp"), "who")).drop("who").dropDuplicates(["target_id", "scene_id"])
    over = (F.col("s1") <= F.col("t2")) & (F.col("t1") <= F.col("s2"))
    common = F.least("s2", "t2") - F.greatest("s1", "t1") + 1
    far = F.when(F.col("s2") < F.col("t1"), F.col("t1") - F.col("s2")).otherwise(F.col("s1") - F.col("t2"))
    near = F.when(F.col("s1").isNull() | F.col("t1").isNull(), 0).when(over, 100 + common).otherwise(F.greatest(F.lit(0), REACH - F.least(far, F.lit(REACH))))
    shared = F.size(F.array_intersect("sp", "tp"))

    t, s = t.filter("tf IS NOT NULL"), s.filter("sf IS NOT NULL")
    # Ends that are missing or swapped fit no block; such rows meet their whole file.
    odd = lambda a, b: F.coalesce((F.col(a).isNotNull() & F.col(b).isNull()) | (F.col(b) < F.col(a)), F.lit(False))
    plain_t, plain_s = t.filter(~odd("t1", "t2") & F.col("t1").isNotNull()), s.filter(~odd("s1", "s2") & F.col("s1").isNotNull())
    same = F.col("tf") == F.col("sf")
    rest = t.filter(odd("t1", "t2")).join(s, same).unionByName(t.filter(~odd("t1", "t2")).join(s.filter(odd("s1", "s2")), same))
    # A pair is met in each block that both touch and counted in the first of them.
    met = plain_t.withColumn("tb", blocks(F.col("t1") - REACH, F.col("t2") + REACH)).join(plain_s.withColumn("sb", blocks(F.col("s1"), F.col("s2"))), same & (F.col("tb") == F.col("sb")))
    met = met.filter(F.col("tb") == F.floor(F.greatest(F.col("t1") - REACH, F.col("s1")) / BLOCK)).drop("tb", "sb")
    close = met.unionByName(rest).filter(near > 0)

    first = F.row_number().over(Window.partitionBy("sf", "sp").orderBy("scene_id"))
    kept = s.withColumn("place", first).filter(F.col("place") <= top).drop("place")
    best = F.row_number().over(Window.partitionBy("tf", "tp").orderBy(shared.desc(), "scene_id"))
    chosen = t.select("tf", "tp").distinct().join(kept, same).withColumn("place", best).filter(F.col("place") <= top).drop("place")
    apart = t.join(chosen, ["tf", "tp"]).filter(near <= 0)

    scored = close.unionByName(apart).unionByName(loose).withColumn("score", (F.when(same, 50 + near).otherwise(0) + 8 * shared).cast("long")).filter("score > 0")
    w = Window.partitionBy("target_id").orderBy(F.col("score").desc(), "scene_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("target_id", "scene_id", "score", "rank")


def active_relations(relations: DataFrame, active: DataFrame) -> DataFrame:
    """Relations both of whose ends are active, the surest first (what is no finite number counts as 0)."""
    who = active.select("who").distinct()
    out = relations.join(who.withColumnRenamed("who", "left"), "left", "left_semi").join(who.withColumnRenamed("who", "right"), "right", "left_semi")
    sure = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    return out.orderBy(F.when(F.isnan(sure) | (F.abs(sure) == float("inf")), 0.0).otherwise(sure).desc(), "left", "right")


def overlapping_writes(ops: DataFrame, by: list[str], first: str, last: str) -> DataFrame:
    """Operations that begin before all earlier ones of their line have ended."""
    w = Window.partitionBy(*by).orderBy(first, last).rowsBetween(Window.unboundedPreceding, -1)
    return ops.withColumn("__end", F.max(last).over(w)).filter(F.col(first) < F.col("__end")).drop("__end")
