"""Story retrieval: each turn of a conversation is a target, every three turns are a scene."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import story as S

from .book import query

#: Aliases of characters, relations of characters with their confidence, and terms with aliases.
_ALIASES = (("c1", "user"), ("c1", "is"), ("c2", "assistant"), ("c2", "der"), ("c3", "les"), ("c3", "of the"), ("c4", "un"))
_RELATIONS = (("c1", "c2", 0.9), ("c1", "c3", 0.5), ("c2", "c3", float("nan")), ("c2", "c4", 0.7), ("c3", "c4", 0.5), ("c1", "c4", None))
_TERMS = ((1, "article", "the"), (2, "article", "le"), (3, "and", "and"), (4, "and", "und"), (5, "two", "in the"))


def _values(rows) -> str:
    say = lambda x: "NULL" if x is None else "'NaN'::DOUBLE" if x != x else repr(x)
    return "VALUES " + ", ".join("(" + ", ".join(map(say, r)) + ")" for r in rows)


_WORD = "regexp_matches(lower(text), '(^|[^a-z0-9_])' || {0} || '([^a-z0-9_]|$)')"


@query(
    "story_context",
    f"""WITH t AS (SELECT conv_id || ':' || turn AS target_id, conv_id, turn, text, role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL), al(who, alias) AS ({_values(_ALIASES)}), rl(l, r, sure) AS ({_values(_RELATIONS)}), tm(i, term, alias) AS ({_values(_TERMS)}),
        a AS (SELECT DISTINCT target_id, who FROM t, al WHERE {_WORD.format("alias")} OR lower(role) = alias), s AS (SELECT DISTINCT conv_id, turn // 3 AS k, 'c' || ((conv_id + turn // 3) % 4 + 1) AS who FROM t),
        p AS (SELECT t.target_id, t.conv_id || '-' || k AS scene_id, s.who, 50 + CASE WHEN turn // 3 = k THEN 101 ELSE greatest(0, 40 - least(CASE WHEN k * 3 + 2 < turn THEN turn - k * 3 - 2 ELSE k * 3 - turn END, 40)) END + CASE WHEN a.who IS NULL THEN 0 ELSE 8 END AS score FROM t JOIN s ON s.conv_id = t.conv_id LEFT JOIN a ON a.target_id = t.target_id AND a.who = s.who),
        q AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, scene_id) AS rank FROM p), b AS (SELECT * FROM q WHERE rank <= 3), c AS (SELECT target_id, who FROM a UNION SELECT target_id, who FROM b),
        x AS (SELECT c.target_id, l || '>' || r AS item, row_number() OVER (PARTITION BY c.target_id ORDER BY CASE WHEN sure IS NULL OR isnan(sure) THEN 0 ELSE sure END DESC, l, r) AS rank FROM rl JOIN c ON c.who = l JOIN c d ON d.who = r AND d.target_id = c.target_id),
        y AS (SELECT DISTINCT target_id, i, term FROM t, tm WHERE {_WORD.format("alias")}), z AS (SELECT target_id, term, row_number() OVER (PARTITION BY target_id ORDER BY i) AS rank FROM y)
        SELECT target_id, 'character' AS kind, who AS item, 0 AS rank FROM c UNION ALL SELECT target_id, 'scene', scene_id, rank FROM b UNION ALL SELECT target_id, 'relation', item, rank FROM x WHERE rank <= 6 UNION ALL SELECT target_id, 'term', term, rank FROM z WHERE rank <= 12""",
)
def story_context(t):
    """Characters, scenes, relations and terms that each turn needs."""
    c = t("conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("target_id", F.concat_ws(":", "conv_id", "turn"))
    spark = c.sparkSession
    k = F.floor(F.col("turn") / 3)
    targets = c.select("target_id", F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("first"), F.col("turn").alias("last"), "text")
    scenes = c.select("conv_id", k.alias("k")).distinct().select(F.concat_ws("-", "conv_id", "k").alias("scene_id"), F.col("conv_id").cast("string").alias("file"), (F.col("k") * 3).alias("first"), (F.col("k") * 3 + 2).alias("last"), F.array(F.concat(F.lit("c"), ((F.col("conv_id") + F.col("k")) % 4 + 1).cast("string"))).alias("people"))
    found = S.retrieve(
        targets, c.select("target_id", F.col("role").alias("speaker")), spark.createDataFrame(_ALIASES, "char_id string, alias string"), scenes,
        spark.createDataFrame(_RELATIONS, "left string, right string, confidence double"), spark.createDataFrame(_TERMS, "ordinal int, term string, alias string"),
    )
    said = {"characters": ("character", F.col("char_id"), F.lit(0)), "scenes": ("scene", F.col("scene_id"), F.col("rank")), "relations": ("relation", F.concat("left", F.lit(">"), "right"), F.col("rank")), "terms": ("term", F.col("term"), F.col("rank"))}
    parts = [found[n].select("target_id", F.lit(kind).alias("kind"), item.alias("item"), rank.cast("long").alias("rank")) for n, (kind, item, rank) in said.items()]
    return reduce(DataFrame.unionByName, parts)
