"""Queries on ``embeddings``: search, filters, upsert, prune, means."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import vectors as O

from .book import query

_COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(s.embedding AS DOUBLE[]))"


@query(
    "vector_top_k",
    f"""SELECT query_id, vec_id, ROUND(score, 6) AS score, rank FROM (
          SELECT q.vec_id AS query_id, s.vec_id, {_COS} AS score, ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY ROUND({_COS}, 12) DESC, s.vec_id) AS rank
          FROM embeddings s JOIN (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q ON q.vec_id <> s.vec_id WHERE {_COS} >= 0.2) WHERE rank <= 4""",
)
def vector_top_k(t):
    """Best 4 of the store for every vector whose id is divisible by 20, itself left out."""
    store = t("embeddings").select("vec_id", "embedding")
    queries = store.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = O.top_k(store, queries, k=5, min_similarity=0.2).filter("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return hits.withColumn("rank", place).filter("rank <= 4").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    "vector_top_k_by_quality",
    f"""SELECT query_id, vec_id, ROUND(score, 6) AS score, rank FROM (
          SELECT q.vec_id AS query_id, s.vec_id, {_COS} AS score, ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY ROUND({_COS}, 12) DESC, s.label DESC, s.vec_id) AS rank
          FROM embeddings s, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q WHERE {_COS} >= 0.1) WHERE rank <= 6""",
)
def vector_top_k_by_quality(t):
    """Best 6, equal scores by label: the queries are the vectors whose id is divisible by 20."""
    store = t("embeddings")
    queries = store.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return O.top_k(store, queries, k=6, min_similarity=0.1, tie=(F.col("label"),)).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    "vector_drop_reasons",
    """SELECT coalesce(reason, 'none') AS reason, COUNT(*) AS n FROM (
         SELECT CASE WHEN label % 2 = 1 THEN 'model' WHEN len(e) = 0 THEN 'empty' WHEN len(e) <> 64 THEN 'dimension' WHEN list_sum([x * x for x in e]) = 0 THEN 'zero_norm' END AS reason
         FROM (SELECT label, CASE WHEN vec_id % 7 = 0 THEN CAST([] AS FLOAT[]) WHEN vec_id % 7 = 1 THEN embedding[1:32] WHEN vec_id % 7 = 2 THEN [CAST(0 AS FLOAT) for x in embedding] ELSE embedding END AS e FROM embeddings)) GROUP BY 1""",
)
def vector_drop_reasons(t):
    """Why store rows cannot be searched, each counted once."""
    e = F.expr("CASE WHEN vec_id % 7 = 0 THEN array() WHEN vec_id % 7 = 1 THEN slice(embedding, 1, 32) WHEN vec_id % 7 = 2 THEN transform(embedding, x -> CAST(0 AS FLOAT)) ELSE embedding END")
    rows = O.drop_reasons(t("embeddings").withColumn("embedding", e), dim=64, model=F.col("label") % 2 != 1)
    return rows.groupBy(F.coalesce("drop_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "vector_upsert",
    """WITH s AS (SELECT vec_id, embedding[1] AS x, label FROM embeddings WHERE vec_id % 4 <> 0), f AS (SELECT vec_id, embedding[1] AS x, CASE WHEN vec_id % 3 = 0 THEN label + 1 ELSE label END AS label FROM embeddings WHERE vec_id % 4 < 2)
       SELECT coalesce(s.vec_id, f.vec_id) AS vec_id, coalesce(f.label, s.label) AS label, CASE WHEN s.vec_id IS NULL THEN 'added' WHEN f.vec_id IS NULL OR f.label = s.label THEN 'kept' ELSE 'updated' END AS change FROM s FULL JOIN f USING (vec_id)""",
)
def vector_upsert(t):
    """Merge of a batch into a store; equal rows do not count as changed."""
    e = t("embeddings")
    fresh = e.filter("vec_id % 4 < 2").withColumn("label", F.when(F.col("vec_id") % 3 == 0, F.col("label") + 1).otherwise(F.col("label")))
    return O.upsert(e.filter("vec_id % 4 <> 0"), fresh, "vec_id").select("vec_id", F.col("label").cast("int").alias("label"), "change")


@query("vector_prune", "SELECT vec_id, label FROM embeddings WHERE label % 2 = 0 OR vec_id % 5 <> 0")
def vector_prune(t):
    """Odd labels are in the scan's scope; every fifth vector is gone from it."""
    e = t("embeddings")
    return O.prune(e, e.filter("vec_id % 5 <> 0"), "vec_id", F.col("label") % 2 == 1).select("vec_id", "label")


@query("vector_still_to_embed", "SELECT vec_id, label FROM embeddings WHERE NOT (vec_id % 3 = 0 AND label % 2 = 0)")
def vector_still_to_embed(t):
    """Rows whose key and checksum the store lacks."""
    e = t("embeddings").select("vec_id", "label", F.md5(F.col("label").cast("string")).alias("sum"))
    store = e.filter("vec_id % 3 = 0").withColumn("sum", F.when(F.col("label") % 2 == 0, F.col("sum")).otherwise("old"))
    return O.still_to_embed(e, store, ["vec_id", "sum"]).select("vec_id", "label")


@query(
    "vector_mean",
    "SELECT label, CAST(i AS INT) AS i, ROUND(AVG(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM embeddings, range(1, 65) r(i) GROUP BY label, i",
)
def vector_mean(t):
    """Mean vector of each label, one row per component."""
    means = O.mean_vector(t("embeddings"), ["label"])
    return means.select("label", F.posexplode("embedding").alias("i", "mean")).select("label", (F.col("i") + 1).alias("i"), F.round("mean", 6).alias("mean"))


@query(
    "vector_centred_cosine",
    """WITH m AS (SELECT label, i, AVG(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
            c AS (SELECT label, i, x - AVG(x) OVER (PARTITION BY i) AS x FROM m)
       SELECT a.label AS "left", b.label AS "right", ROUND(SUM(a.x * b.x) / (SQRT(SUM(a.x * a.x)) * SQRT(SUM(b.x * b.x))), 5) AS cosine FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""",
)
def vector_centred_cosine(t):
    """Similarity of the labels' means, their common mean taken off."""
    pairs = O.centred_cosines(O.mean_vector(t("embeddings"), ["label"]), "label")
    return pairs.select("left", "right", F.round("cosine", 5).alias("cosine"))


@query("vector_norms", "SELECT vec_id, ROUND(SQRT(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding])), 6) AS norm FROM embeddings")
def vector_norms(t):
    """Norms, to be stored beside the vectors."""
    return t("embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))
