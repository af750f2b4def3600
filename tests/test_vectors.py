"""Vector search in one block and in many, on odd vectors."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from quern.operators import vectors


def test_blocks_give_the_same(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice([4, 4, 4, 6]))], f"n{i}") for i in range(120)] + [(200, None, "x"), (201, [], "y"), (202, [0.0] * 4, "z"), (203, [1.0, 0.0, 0.0, 0.0], "e"), (204, [2.0, 0.0, 0.0, 0.0], "f")]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<double>, name string")
    queries = store.filter("vec_id % 3 = 0 OR vec_id > 199").selectExpr("concat('q', vec_id) AS query_id", "embedding")
    wanted = []
    for i, v, _ in rows:
        if i % 3 and i < 200 or not v:
            continue
        scores = []
        for j, w, name in rows:
            if w and len(w) == len(v) and np.linalg.norm(v) and np.linalg.norm(w):
                scores.append((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12), j, name))
        wanted += [(f"q{i}", j, name, at + 1) for at, (s, j, name) in enumerate([x for x in sorted(scores) if -x[0] >= 0.3][:4])]
    for size in (8_000_000, 40):
        got = vectors.top_k(store, queries, k=4, min_similarity=0.3, keep=("name",), block_numbers=size).collect()
        assert sorted((r.query_id, r.vec_id, r.name, r["rank"]) for r in got) == sorted(wanted)
    assert vectors.top_k(store, queries.limit(0)).count() == 0 and vectors.top_k(store.limit(0), queries, block_numbers=40).count() == 0


def test_scores_are_held_by_tiles():
    """Many queries against a full batch: their scores are never held all at once, and nothing is missed or handed on in vain."""
    rng = np.random.default_rng(1)
    lists = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())
    m, x = rng.normal(size=(6000, 8)), rng.normal(size=(9000, 8))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 3000)), lists(x[i : i + 3000])], names=["__id", "__v"]) for i in range(0, 9000, 3000)]
    tracemalloc.start()
    block = vectors._Block(pa.array(range(6000)), lists(m), 3, 0.1)
    got = [b for batch in batches for b in block.search(batch, [])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 3000 * 8 / 2
    rows = sorted((r["q"], -r["score"], r["id"]) for b in got for r in b.to_pylist())
    assert len(rows) < 6000 * 3 * 2.5
    best = {}
    for q, _, i in rows:
        best.setdefault(q, []).append(i)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    for q in range(0, 6000, 97):
        s = unit(m)[q] @ unit(x).T
        assert best[q][:3] == np.argsort(-s)[:3].tolist()
