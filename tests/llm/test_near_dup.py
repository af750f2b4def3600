import random
import re

import numpy as np
import pytest

from quern.llm import near_dup
from quern.llm.near_dup import Likeness


def brute(rows, like):
    sets = {}
    for i, t in rows:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        k = min(like.shingle, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= like.percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows = [None, "", "  ", "one", "ONE", "one two", "two one", "One  two\n"]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 30, 120, 200]))]
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy))
    # A chain, each text like the next only.
    text = [rng.choice(vocab) for _ in range(100)]
    for k in range(20):
        text[5 * k : 5 * k + 1] = [f"new{k}"]
        rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("like, most", [(Likeness(shingle=3, percent=85), 1_000_000), (Likeness(), 1)])
def test_against_all_pairs(spark, like, most, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK", 4)
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", most)
    rows = corpus(like.shingle)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_shingles int, node int")
    assert sorted(map(tuple, near_dup.near_duplicates(df, like).collect())) == brute(rows, like)


def test_odd_rows(spark):
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (1, None)], "doc_id long, text string")
    got = sorted(near_dup.near_duplicates(df).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(3, 1, 3, True), (3, 1, 3, True), (None, 1, None, True), (1, 0, 1, True)], key=str)
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_estimate_follows_similarity():
    like = Likeness()
    maker = near_dup.Sketcher(like)
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        gaps = []
        for _ in range(30):
            pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            cut = int(1000 * (1 - share) / 2)
            a, b = np.sort(pool[: 1000 - cut]), np.sort(pool[cut:])
            _, sigs = maker.sketch(np.stack([maker.minima(a), maker.minima(b)]))
            gaps.append(near_dup.similarity(int(near_dup.agreeing(sigs[:1], sigs[1:], like)[0, 0]), like) - share)
        assert abs(np.mean(gaps)) < 0.03


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = ("alpha " + " ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, b), (5, c), (6, c), (6, None), (6, " "), (7, c), (7, a + " x"), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(df, near_dup.Likeness(3, 85)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.n_shingles} == {i: 1 for i in range(1, 8)}
    assert sorted((r.doc_id, r.component_id) for r in got if not r.n_shingles) == [(6, 6), (6, 6)]


def test_shared_ids_near_the_end_of_the_range(spark):
    top, text = 2**63 - 1, " ".join(f"t{i}" for i in range(40))
    rows = [(top, text), (top, "x y z v w u"), (top - 1, text), (5, "x y z v w u"), (-7, "alone in here with it")]
    got = {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(top, 5), (top - 1, 5), (5, 5), (-7, -7)}
    with pytest.raises(ValueError):
        near_dup.near_duplicates(spark.createDataFrame([*rows, (-(2**63), "z")], "doc_id long, text string"))
