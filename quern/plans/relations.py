"""Queries on ``events`` and ``conversations`` as dialogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import relations as R

from .book import query

# Events as dialogue: a user's events in time are a script, the event type speaks.
_SCENE = """WITH u AS (SELECT user_id, event_type AS who, (ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 12 AS scene FROM events),
 c AS (SELECT DISTINCT user_id, scene, who FROM u), p AS (SELECT a.who AS l, b.who AS r, COUNT(*) AS v FROM c a JOIN c b ON a.user_id = b.user_id AND a.scene = b.scene AND a.who < b.who GROUP BY 1, 2)"""
_DIALOGUE = """d AS (SELECT least(a, b) AS l, greatest(a, b) AS r, COUNT(*) AS v FROM (SELECT event_type AS a, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2)"""
_NS = "ns AS (SELECT who, COUNT(*) AS n FROM c GROUP BY 1), nd AS (SELECT event_type AS who, COUNT(*) AS n FROM events GROUP BY 1)"


def _parts(t):
    e = t("events").select("user_id", "ts", "event_id", F.col("event_type").alias("who"))
    units = R.scenes(e.withColumn("participants", F.array("who")), "user_id", ["user_id", "ts", "event_id"])
    scene, dialogue = R.scene_pairs(units), R.dialogue_pairs(e, "user_id", ["ts", "event_id"], "who")
    cast = units.select("run", "scene", F.explode("participants").alias("who")).distinct().groupBy("who").agg(F.count("*").alias("n"))
    spoken = e.groupBy("who").agg(F.count("*").alias("n"))
    return e, scene, dialogue, R.density(scene, cast), R.density(dialogue, spoken)


@query("relation_scene_pairs", f'{_SCENE} SELECT l AS "left", r AS "right", CAST(v AS DOUBLE) AS value FROM p')
def relation_scene_pairs(t):
    """Scenes of twelve rows that two speakers share."""
    return _parts(t)[1]


@query("relation_dialogue_pairs", f'WITH {_DIALOGUE} SELECT l AS "left", r AS "right", CAST(v AS DOUBLE) AS value FROM d')
def relation_dialogue_pairs(t):
    """Speakers next to each other."""
    return _parts(t)[2]


#: Whoever speaks two rows later in a user's script is spoken of by a row of a high value.
_MENTION = """w AS (SELECT least(a, b) AS l, greatest(a, b) AS r, COUNT(*) AS v FROM (SELECT event_type AS a, LEAD(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, value FROM events) WHERE value > 50 AND b IS NOT NULL AND a <> b GROUP BY 1, 2)"""
_PARTS = f"""{_SCENE}, {_DIALOGUE}, {_NS}, {_MENTION}, sd AS (SELECT l, r, v / SQRT(a.n * b.n) AS v FROM p JOIN ns a ON a.who = l JOIN ns b ON b.who = r), dd AS (SELECT l, r, v / SQRT(a.n * b.n) AS v FROM d JOIN nd a ON a.who = l JOIN nd b ON b.who = r),
     s AS (SELECT l, r, coalesce(sd.v / (SELECT MAX(v) FROM sd), 0) AS s, coalesce(dd.v / (SELECT MAX(v) FROM dd), 0) AS d, coalesce(w.v / (SELECT MAX(v) FROM w), 0) AS m FROM sd FULL JOIN dd USING (l, r) FULL JOIN w USING (l, r)), t AS (SELECT *, s * 0.45 + d * 0.35 + m * 0.2 AS score FROM s)"""


@query("relation_scores", f"""{_PARTS} SELECT l AS "left", r AS "right", ROUND(s, 6) AS scene, ROUND(d, 6) AS dialogue, ROUND(m, 6) AS mention, ROUND(score, 6) AS score, CASE greatest(s * 0.45, d * 0.35, m * 0.2) WHEN s * 0.45 THEN 'scene' WHEN d * 0.35 THEN 'dialogue' ELSE 'mention' END AS dominant FROM t""")
def relation_scores(t):
    """Scaled densities and mentions, weighted total and dominant component of all pairs."""
    return _scores(t).select("left", "right", *[F.round(c, 6).alias(c) for c in ("scene", "dialogue", "mention", "score")], "dominant")


def _scores(t):
    e, _, _, scene, dialogue = _parts(t)
    later = F.lead("who", 2).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    spoken = t("events").select("user_id", "ts", "event_id", F.col("event_type").alias("who"), "value").withColumn("m", F.array_compact(F.array(later)))
    mention = R.mention_pairs(spoken.filter("value > 50"), "who", "m")
    return R.relation_scores(e.select("who").distinct(), R.scaled(scene), R.scaled(dialogue), R.scaled(mention))


@query(
    "relation_edges",
    f"""{_PARTS}, k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, l, r) AS rank, (SELECT greatest(0.18, quantile_cont(score, 0.65)) FROM t) AS cut FROM t WHERE score > 0)
     SELECT l AS "left", r AS "right", ROUND(score, 6) AS score, rank FROM k WHERE (score >= cut AND rank <= 4) OR rank <= 3""",
)
def relation_edges(t):
    """Edges above the floor and the quantile of scores."""
    return R.select_edges(_scores(t), people=5).select("left", "right", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "relation_mentions",
    """WITH u AS (SELECT role AS a, text FROM conversations), m AS (SELECT a, x.w AS b, row_number() OVER () AS i FROM u, (SELECT unnest(['ing', 'der', 'que']) AS w) x WHERE contains(text, x.w)),
       k AS (SELECT conv_id, turn, role AS a, w AS b FROM conversations, (SELECT unnest(['ing', 'der', 'que']) AS w) x WHERE contains(text, w))
       SELECT l AS "left", r AS "right", ROUND(SUM(v), 4) AS value FROM (SELECT least(a, b) AS l, greatest(a, b) AS r, 1.0 AS v FROM k WHERE a <> b
         UNION ALL SELECT x.b, y.b, 0.35 FROM k x JOIN k y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.b < y.b) GROUP BY 1, 2""",
)
def relation_mentions(t):
    """Who speaks of what: syllables stand for names."""
    names = F.filter(F.array(*[F.when(F.col("text").contains(w), F.lit(w)) for w in ("ing", "der", "que")]), lambda x: x.isNotNull())
    out = R.mention_pairs(t("conversations").withColumn("m", names), "role", "m")
    return out.withColumn("value", F.round("value", 4))


@query(
    "relation_speaker_statistics",
    """SELECT role, COUNT(*) AS lines, COUNT(DISTINCT conv_id) AS files, MIN(turn) AS first_line, MAX(turn) AS last_line, (SELECT string_agg(n, ',' ORDER BY c DESC, lower(n)) FROM (SELECT CAST(turn % 3 AS VARCHAR) AS n, COUNT(*) AS c FROM conversations z WHERE z.role = conversations.role GROUP BY 1)) AS names FROM conversations GROUP BY role""",
)
def relation_speaker_statistics(t):
    """Lines, conversations, span and name histogram per role."""
    c = t("conversations").withColumn("name", (F.col("turn") % 3).cast("string"))
    return R.speaker_statistics(c, "role", "conv_id", "turn", "name").withColumn("names", F.array_join("names", ","))


@query("relation_top_speakers", "SELECT event_type, COUNT(*) AS lines FROM events GROUP BY 1 ORDER BY 2 DESC, lower(event_type) LIMIT 3")
def relation_top_speakers(t):
    """The three most frequent."""
    return R.top_speakers(t("events"), "event_type", 3)
