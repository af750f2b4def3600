import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import periodic_runs as P


def brute(w):
    """All runs, period by period."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            part = w[start : start + length]
            if i > start and length >= max(6, 4 * q) and not any(all(part[x] == part[x + r] for x in range(length - r)) for r in range(1, q)):
                out.append((start, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts(seed, n):
    rng = random.Random(seed)
    out = [None, "", "  \n", "a", "a a a a a", "a a a a a a", "A a " * 5, "ü\x0bü " * 7]
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(1, 6)):
            base = [f"w{rng.randrange(rng.choice([2, 3, 60]))}" for _ in range(rng.randrange(1, 8))]
            w += (base * 9)[: rng.randrange(1, 45)]
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = "x"
        out.append(rng.choice([" ", "\n", "\t  "]).join(w))
    return out


def test_against_every_period(spark):
    rows = [(i, t) for i, t in enumerate(texts(1, 150))]
    rows += [(3, rows[20][1]), (3, rows[20][1]), (None, "b c " * 6)]
    df = spark.createDataFrame([(i, t, 5, "r") for i, t in rows], "doc_id long, text string, n_words int, runs string")
    got = P.periodic_runs(df, keep=("doc_id", "n_words", "runs")).collect()
    assert {r.kept_n_words for r in got} == {5} and len(got) == len(rows)
    shown = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(w)
        gone = {x for a, n, q in runs for x in range(a + q, a + n)}
        shown.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got], key=repr) == sorted(shown, key=repr)


def test_query_against_every_period(spark):
    rows = [(i, t) for i, t in enumerate(texts(2, 200))] + [(None, "b c " * 6)]
    got = {r.doc_id: tuple(r[1:]) for r in P.digest(P.periodic_runs(P.planted(spark.createDataFrame(rows, "doc_id long, text string")))).collect()}
    hits = 0
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            hits += 1
        runs = brute(w)
        gone = {x for a, m, q in runs for x in range(a + q, a + m)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed, left = "".join(f"{a},{m},{q}\n" for a, m, q in runs), " ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[i] == (len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())
    assert hits > 10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4))
def test_small_alphabets(lists):
    sizes = np.array([len(w) for w in lists])
    base = np.concatenate([[0], np.cumsum(sizes)])
    got = P.find_runs(np.array([x for w in lists for x in w], dtype=np.int64), np.repeat(np.arange(len(lists)), sizes))
    assert sorted(map(tuple, got.tolist())) == sorted((a + int(base[k]), n, q) for k, w in enumerate(lists) for a, n, q in brute(w))


def test_colliding_hashes(monkeypatch):
    """Where hashes mean nothing, words still decide."""
    monkeypatch.setattr(P, "BASE", 1)
    monkeypatch.setattr(P.Hashes, "powers", [1])
    rng = random.Random(4)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(40)] + [0, 1] * rng.randrange(9) + [rng.randrange(2) for _ in range(20)]
        assert sorted(map(tuple, P.find_runs(np.array(w), np.zeros(len(w), dtype=np.int64)).tolist())) == sorted(brute(w))


@pytest.mark.parametrize("text, runs", [("a " * 120_000, 1), (" ".join(f"w{i % 500}" for i in range(120_000)), 1), (" ".join(f"w{i}" for i in range(120_000)), 0)])
def test_long_texts(spark, text, runs):
    row = P.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(row.runs) == runs and row.n_words == 120_000


def test_empty_table(spark):
    assert P.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
