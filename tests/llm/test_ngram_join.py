import random
import re
from collections import Counter

import numpy as np
import pytest

from quern.llm import ngram_join as N


def sets_of(rows, shingle):
    out = []
    for i, t in rows:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        k = min(shingle, len(w))
        out.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()))
    return out


def brute(rows, shingle, percent):
    sets = sets_of(rows, shingle)
    ids = {i: i for i, _ in rows if i is not None}

    def find(i):
        while ids[i] != i:
            i = ids[i]
        return i

    links = [0] * len(sets)
    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if x and y and i is not None and j is not None and 100 * len(x & y) >= percent * len(x | y):
                links[a] += 1
                links[b] += 1
                low, high = sorted((find(i), find(j)))
                ids[high] = low
    return sorted(((i, len(s), None if i is None else find(i), n) for (i, s), n in zip(sets, links, strict=True)), key=repr)


def corpus(seed, sizes):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    common = [" ".join(rng.choices(vocab, k=60)) for _ in range(2)]
    rows = [None, "", "  ", "one", "ONE", "one two", "two one", "One  two\n", "a b c d e f g h i j k", "a b c d e f g h i j k l", "z a b c d e f g h i j k l"]
    for _ in range(30):
        base = [rng.choice(vocab) for _ in range(rng.choice(sizes))]
        if rng.random() < 0.5:
            base += rng.choice(common).split()
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy))
    text = [rng.choice(vocab) for _ in range(150)]
    for k in range(20):  # a chain
        text[7 * k : 7 * k + 1] = [f"new{k}"]
        rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("percent, frequent, cell", [(90, (32, 1024), 2048), (90, (2, 5), 6), (80, (1, 4), 3)])
def test_against_all_pairs(spark, percent, frequent, cell, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", cell)
    monkeypatch.setattr(N, "ENTRY_ROWS", cell)
    rows = corpus(percent + cell, [5, 30, 120, 200])
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, n_shingles int, node int, band string")
    assert sorted(map(tuple, N.similar_classes(df, 3, percent, frequent=frequent).collect()), key=repr) == brute(rows, 3, percent)


def test_shared_and_null_ids_and_copies(spark):
    long = " ".join(f"v{i % 977}x{i // 7}" for i in range(150_000))
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(3, text), (1, text), (1, text), (None, text), (7, text + " end"), (9, long), (8, long + " more"), (5, "x y z"), (5, "p q r s"), (6, "p q r s"), (-(2**62), "x y z"), (2**63 - 2, None)]
    got = {(r.doc_id, r.component_id) for r in N.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {(3, 1), (1, 1), (None, None), (7, 1), (9, 8), (8, 8), (5, -(2**62)), (6, -(2**62)), (-(2**62), -(2**62)), (2**63 - 2, 2**63 - 2)}
    links = [r.n_links for r in N.similar_classes(spark.createDataFrame(rows[:5], "doc_id long, text string"), 3, 90).orderBy("doc_id").collect()]
    assert links == [0, 3, 3, 3, 3]


def test_empty_table(spark):
    assert N.similar_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("seed", range(10))
def test_linked_sets_share_an_entry(seed):
    """The index misses no pair, however frequent the tokens; bitmaps reject none."""
    rng = np.random.default_rng(seed)
    percent, frequent = [90, 85, 80, 60, 50][seed % 5], [(2, 6), (1, 3), (32, 1024)][seed % 3]
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
    sets = {}
    for _ in range(12):
        size = int(rng.integers(1, 250))
        base = np.unique(rng.choice(pool, size)) if rng.random() < 0.6 else np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        for _ in range(int(rng.integers(1, 14))):
            kept = base[rng.random(len(base)) > rng.choice([0, 0.02, 0.05, 0.1])]
            s = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, int(rng.integers(0, 4)), dtype=np.uint64)]))
            sets[s.tobytes()] = s
    sets = [s for s in sets.values() if len(s)]
    lows = [int(np.searchsorted(s, np.uint64(N.LOW))) for s in sets]
    given = [s[:0] if N.alone(len(s), percent) else s[:low] if low >= N.enough(len(s), percent) else s for s, low in zip(sets, lows, strict=True)]
    count = Counter(t for g in given for t in g.tolist())
    made = []
    for s, low, g in zip(sets, lows, given, strict=True):
        known = np.array([t for t in g.tolist() if count[t] > 1], dtype=np.uint64)
        known = known[rng.permutation(len(known))]
        made.append(set(N.entries(len(s), low, len(g), known, np.array([count[t] for t in known.tolist()], dtype=np.int64), percent, frequent)) if len(known) else set())
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            same = len(np.intersect1d(x, y))
            if 100 * same >= percent * (len(x) + len(y) - same):
                a, b = N.bitmap(x), N.bitmap(y)
                width = min(len(a), len(b))
                assert made[i] & made[j]
                assert np.bitwise_count(N.fold(a, width) ^ N.fold(b, width)).sum() <= N.may_differ(len(x) + len(y), percent)
