"""The Arrow functions against plain Python."""

import difflib
import random
from functools import lru_cache

from pyspark.sql import functions as F

from quern.functions import udfs


def plain_common(a, b):
    @lru_cache(None)
    def go(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + go(i + 1, j + 1) if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))

    return go(0, 0)


def test_longest_common():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(0, 14))) for _ in range(2))
        assert udfs.longest_common(a, b) == plain_common(a, b)


def test_ratio_from_is_the_ratio_or_null(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices("ab c", k=rng.randrange(0, 12))), "".join(rng.choices("ab c", k=rng.randrange(0, 12)))) for _ in range(150)] + [(None, "a"), ("a", None), ("", "")]
    got = spark.createDataFrame(rows, "x string, y string").select("x", "y", udfs.ratio_from("x", "y", F.lit(0.6)).alias("r"), udfs.sequence_ratio("x", "y").alias("whole")).collect()
    for r in got:
        whole = None if r.x is None or r.y is None else difflib.SequenceMatcher(None, r.x, r.y, autojunk=False).ratio()
        assert r.whole == whole and (r.r == whole or (r.r is None and (whole is None or whole < 0.6)))


def test_text_functions(spark):
    row = spark.createDataFrame([("e\u0301  STRASSE \u00df",)], "t string").select(udfs.nfc("t").alias("n"), udfs.casefold_key("t").alias("k")).first()
    assert row.n == "\u00e9  STRASSE \u00df" and row.k == "\u00e9 strasse ss"


def test_spans_and_json(spark):
    row = spark.createDataFrame([("a1 b22", r"[0-9]+", '{"b": 1, "a": [2, null]}')], "t string, p string, j string").select(udfs.spans("t", "p").alias("s"), udfs.canonical_json("j").alias("c")).first()
    assert [(x.match, x.first, x.last) for x in row.s] == [("1", 1, 2), ("22", 4, 6)]
    assert row.c == '{"a":[2,null],"b":1}'
