"""Embedding stores: search, upsert, prune, skip and averages.

A store is a DataFrame with an id, an ``array`` of numbers and whatever
metadata; nothing is kept between calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V

#: Numbers of the query vectors that one block may hold.
BLOCK_NUMBERS = 8_000_000
#: Scores that a task holds at once, for all queries of a tile and all rows of a batch.
TILE_NUMBERS = 500_000
#: What scores of one pair may differ by, and ties with the last of the best with it.
MARGIN = 1e-12


def drop_reasons(store: DataFrame, dim: int | None = None, vector: str = "embedding", model: Column | None = None, task: Column | None = None) -> DataFrame:
    """Adds ``drop_reason``, the first of model, task, empty, dimension, zero norm that applies, else null."""
    v = F.col(vector)
    reason = F.when(v.isNull() | (F.size(v) == 0), "empty")
    if dim is not None:
        reason = reason.when(F.size(v) != dim, "dimension")
    reason = reason.when(V.norm(v) == 0, "zero_norm")
    for name, ok in (("task", task), ("model", model)):
        if ok is not None:
            reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    return store.withColumn("drop_reason", reason)


class _Block:
    """Query vectors of one block, by length, and the ``k``-th best score that each has found so far."""

    def __init__(self, ids: pa.Array, vectors: pa.ListArray, k: int, least: float):
        self.ids, self.k = ids, k
        self.sizes = _sizes(vectors)
        self.by_dim = {int(dim): (own := np.flatnonzero(self.sizes == dim), _unit(_matrix(vectors, own, int(dim)))) for dim in np.unique(self.sizes[self.sizes > 0])}
        self.least = np.full(len(ids), least, dtype=np.float64)

    def search(self, b: pa.RecordBatch, rest: list[str]) -> Iterator[pa.RecordBatch]:
        """Of a batch of the store what may be among the best ``k`` of each query, ties with the last among them.

        Queries are taken in tiles, so that no table of scores has more than
        ``TILE_NUMBERS`` numbers, however many queries there are.
        """
        v = b.column("__v")
        sizes = _sizes(v)
        there = {dim: (rows := np.flatnonzero(sizes == dim), _unit(_matrix(v, rows, dim))) for dim in self.by_dim}
        # Vectors of other lengths score 0.
        tile = max(1, TILE_NUMBERS // max(1, b.num_rows))
        for start in range(0, len(self.ids), tile):
            n, score = min(tile, len(self.ids) - start), None
            for dim, (own, m) in self.by_dim.items():
                rows, x = there[dim]
                i, j = np.searchsorted(own, (start, start + n))
                if j - i == n and len(rows) == b.num_rows:
                    score = m[i:j] @ x.T
                elif len(rows) and i < j:
                    score = np.zeros((n, b.num_rows)) if score is None else score
                    score[np.ix_(own[i:j] - start, rows)] = m[i:j] @ x.T
            score = np.zeros((n, b.num_rows)) if score is None else score
            q, at, found = self._best(score, start)
            if len(q):
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(q)), b.column("__id").take(take), pa.array(found), *(b.column(c).take(take) for c in rest)], names=["q", "id", "score", *rest])

    def _best(self, score: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = self.least[start : start + len(score)]
        good = score >= own[:, None]
        if 0 < self.k:
            many = np.flatnonzero(np.count_nonzero(good, axis=1) >= self.k)
            for i in many.tolist():
                at = np.flatnonzero(good[i])
                # Sums of another batch may differ in their last places, hence the margin.
                own[i] = max(own[i], np.partition(score[i, at], len(at) - self.k)[len(at) - self.k] - MARGIN)
                good[i, at] = score[i, at] >= own[i]
        q, at = np.nonzero(good)
        return q + start, at, score[q, at]


def _sizes(v: pa.ListArray) -> np.ndarray:
    return np.diff(np.asarray(v.offsets)[: len(v) + 1])


def _whole(c: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], type=c.type)


def _matrix(v: pa.ListArray, rows: np.ndarray, dim: int) -> np.ndarray:
    return np.asarray(v.take(pa.array(rows)).flatten(), dtype=np.float64).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def top_k(store: DataFrame, queries: DataFrame, k: int = 4, min_similarity: float = 0.72, store_id: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", tie: tuple[Column, ...] = (), keep: tuple[str, ...] = (), block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """``(query_id, store_id, score, rank, *keep)``: exact cosine, the best ``k`` of each query at the threshold.

    Order is score, then ``tie``, then the store's id; ``k`` of 0 or less means
    all. Vectors of other lengths score 0. Queries of ``block_numbers`` numbers
    or less in all are broadcast; more are dealt into blocks of that size, and
    blocks meet parts of the store in tasks of their own. Each Arrow batch
    hands on ``k`` rows a query, and Spark the best of a task before rows of
    one query meet; a task hands on nothing worse than the ``k`` that it has.
    """
    spark = store.sparkSession
    slim = store.select(F.col(store_id).alias("__id"), F.col(vector).cast("array<double>").alias("__v"), *keep, *[t.alias(f"__t{i}") for i, t in enumerate(tie)])
    asked = queries.select(F.col(query_id).alias("__q"), F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")).alias("__w"))
    rest = [c for c in slim.columns if c not in ("__id", "__v")]
    fields = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = f"q {dict(asked.dtypes)['__q']}, id {fields['__id']}, score double" + "".join(f", `{c}` {fields[c]}" for c in rest)
    blocks = -(-(asked.agg(F.sum(F.size("__w") + 1)).first()[0] or 1) // block_numbers)

    def by_block(shared):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with pa.ipc.open_stream(shared.value) as stream:
                mine = stream.read_all().combine_chunks()
            block = _Block(_whole(mine.column("__q")), _whole(mine.column("__w")), k, min_similarity)
            for b in batches:
                yield from block.search(b, rest)

        return go

    def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, block = [], None, None
        for b in batches:
            cell = np.stack([b.column(c).to_numpy() for c in ("__block", "__part", "__side")])
            edges = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                run = b.slice(i, j - i)
                if tuple(cell[:2, i].tolist()) != at:
                    held, at, block = [], tuple(cell[:2, i].tolist()), None
                if cell[2, i] == 0:
                    held.append(run.select(["__q", "__w"]))
                elif held or block:
                    if not block:
                        mine = pa.Table.from_batches(held)
                        held, block = [], _Block(_whole(mine.column("__q")), _whole(mine.column("__w")), k, min_similarity)
                    yield from block.search(run, rest)

    if blocks == 1:
        sink = pa.BufferOutputStream()
        mine = asked.toArrow()
        with pa.ipc.new_stream(sink, mine.schema) as stream:
            stream.write_table(mine)
        found = slim.mapInArrow(by_block(spark.sparkContext.broadcast(sink.getvalue().to_pybytes())), schema)
    else:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cells = slim.withColumn("__part", F.pmod(F.xxhash64("__id"), F.lit(parts)).cast("int")).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("__side", F.lit(1))
        mine = asked.withColumn("__block", F.pmod(F.xxhash64("__q"), F.lit(blocks)).cast("int")).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("__side", F.lit(0))
        both = cells.unionByName(mine, allowMissingColumns=True)
        found = both.repartition("__block", "__part").sortWithinPartitions("__block", "__part", "__side").mapInArrow(by_cell, schema)
    order = Window.partitionBy("q").orderBy(F.round("score", 12).desc(), *[F.col(f"__t{i}").desc() for i in range(len(tie))], "id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    if k > 0:
        ranked = ranked.filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("id").alias(store_id), "score", "rank", *keep)


def upsert(store: DataFrame, fresh: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """The merged store with ``change``: ``added``, ``updated`` or ``kept``. Rows of ``fresh`` without vector are left out."""
    cols = [c for c in store.columns if c != key]
    new = fresh.filter(F.size(vector) > 0).select(F.col(key), F.struct(*cols).alias("__new"))
    old = store.select(F.col(key), F.struct(*cols).alias("__old"))
    both = old.join(new, key, "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull() | F.col("__new").eqNullSafe(F.col("__old")), "kept").otherwise("updated")
    row = F.coalesce("__new", "__old")
    return both.select(key, *[row[c].alias(c) for c in cols], change.alias("change"))


def prune(store: DataFrame, current: DataFrame, key: str, scope: Column | None = None) -> DataFrame:
    """The store without rows that the current scan no longer has, of those in ``scope``."""
    if scope is None:
        return store.join(current.select(key).distinct(), key, "left_semi")
    stale = store.filter(scope).join(current.select(key).distinct(), key, "left_anti").select(key)
    return store.join(stale, key, "left_anti")


def still_to_embed(rows: DataFrame, store: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key, checksums and model attributes the store does not have."""
    return rows.join(store.select(*on).distinct(), on, "left_anti")


def mean_vector(rows: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Component-wise mean of each group, partial sums before the shuffle."""
    parts = rows.select(*by, F.posexplode(vector).alias("__at", "__x")).groupBy(*by, "__at").agg(F.avg(F.col("__x").cast("double")).alias("__x"))
    packed = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__at", "__x"))).alias("__p"))
    return packed.select(*by, F.transform("__p", lambda p: p["__x"]).alias(vector))


def centred_cosines(means: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Cosines of all pairs of a small table of vectors, once its mean is taken off."""
    centre = mean_vector(means.withColumn("__all", F.lit(1)), ["__all"], vector).select(F.col(vector).alias("__m"))
    moved = means.join(F.broadcast(centre)).select(key, F.zip_with(vector, "__m", lambda x, m: x - m).alias("v"))
    left, right = moved.select(F.col(key).alias("left"), F.col("v").alias("a")), moved.select(F.col(key).alias("right"), F.col("v").alias("b"))
    return left.join(right, F.col("left") < F.col("right")).select("left", "right", V.cosine(F.col("a"), F.col("b")).alias("cosine"))
