"""Operator 13: periodic runs of words, by Lyndon words under both orders.

A run is a stretch of words with smallest period ``q`` that no neighbouring
word extends. The longest Lyndon word that starts at each place, under one of
the two orders of the words, is the root of every run there. So the words are
scanned from right to left with a stack, once in each order; suffixes are
compared by their first words, and by their longest common extension where
these agree. A common extension is found by binary search over rolling hashes
modulo 2^61 - 1 and confirmed word by word. Each root of period ``p`` whose
next ``2 p`` words repeat is extended both ways, likewise by hashes, and the
run is confirmed word by word.

Only words inside three-word windows that their text holds twice can lie in a
run of at least ``least`` words, so that other words are left out before.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, keep_apart, slices

#: A run has at least this many words, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: The rolling hash: a prime modulus and a base.
PRIME, BASE = (1 << 61) - 1, 0x1B0A3C5D7E9F2461


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a * b`` modulo 2^61 - 1, for arrays of smaller numbers."""
    low, high, part = np.uint64((1 << 32) - 1), np.uint64(32), np.uint64(PRIME)
    a0, a1, b0, b1 = a & low, a >> high, b & low, b >> high
    middle = a0 * b1 + a1 * b0  # below 2^62, as the upper halves are below 2^29
    total = (a0 * b0 & part) + (a0 * b0 >> np.uint64(61)) + ((middle & np.uint64((1 << 29) - 1)) << high) + (middle >> np.uint64(29)) + (a1 * b1 << np.uint64(3))
    return total % part


class Hashes:
    """Prefix hashes of a sequence of numbers; equal stretches have equal hashes, others hardly ever."""

    powers: list[int] = [1]

    def __init__(self, words: np.ndarray):
        n = len(words)
        known = Hashes.powers
        if len(known) <= n:
            known.extend(accumulate(range(n + 1 - len(known)), lambda x, _: x * BASE % PRIME, initial=known[-1] * BASE % PRIME))
        self.power = np.array(known[: n + 1], dtype=np.uint64)
        term = _times(words.astype(np.uint64) + np.uint64(1), self.power[:n])
        low, high = np.cumsum(term & np.uint64((1 << 32) - 1)), np.cumsum(term >> np.uint64(32))
        whole = (_times(high % np.uint64(PRIME), np.full(n, 1 << 32, dtype=np.uint64)) + low % np.uint64(PRIME)) % np.uint64(PRIME)
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), whole])

    def same(self, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether the ``k`` words at ``i`` hash like those at ``j``, for ``i <= j``."""
        part = np.uint64(PRIME)
        mine, yours = (self.sums[i + k] + part - self.sums[i]) % part, (self.sums[j + k] + part - self.sums[j]) % part
        return _times(mine, self.power[j - i]) == yours

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that follow alike from ``i`` and from ``j``, at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high + 1) // 2, low)
            ok = self.same(i, j, middle)
            low, high = np.where(ok, middle, low), np.where(ok | ~open_, high, middle - 1)
        return low

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that precede alike before ``i`` and before ``j``, at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high + 1) // 2, low)
            ok = self.same(i - middle, j - middle, middle)
            low, high = np.where(ok, middle, low), np.where(ok | ~open_, high, middle - 1)
        return low


class Common:
    """Longest common extensions inside one stretch: hashes propose, words confirm."""

    def __init__(self, words: list[int], sums: list[int], power: list[int]):
        self.words, self.sums, self.power = words, sums, power
        #: For a distance, a stretch of places known to hold the word that stands that far ahead.
        self.sure: dict[int, tuple[int, int]] = {}

    def length(self, i: int, j: int) -> int:
        """How many words from ``i`` and from ``j > i`` agree; those at both places do.

        The search gallops from what was confirmed for the same distance.
        """
        sums, scale = self.sums, self.power[j - i]
        first, last = self.sure.get(j - i, (0, 0))
        low, high = last - i if first <= i + 1 <= last else 1, len(self.words) - j
        step = 1
        while low + step <= high and not ((sums[i + low + step] - sums[i]) * scale - sums[j + low + step] + sums[j]) % PRIME:
            low, step = low + step, 2 * step
        high = min(high, low + step - 1)
        while low < high:
            middle = (low + high + 1) // 2
            if ((sums[i + middle] - sums[i]) * scale - sums[j + middle] + sums[j]) % PRIME:
                high = middle - 1
            else:
                low = middle
        return self.confirmed(i, j, low)

    def confirmed(self, i: int, j: int, k: int) -> int:
        """``k``, or less if the words disagree earlier; what was confirmed for the same distance is not read again."""
        words, apart = self.words, j - i
        first, last = self.sure.get(apart, (i, i))
        if first > i + k or last < i:
            first = last = i
        for a, b in ((i, min(first, i + k)), (max(last, i), i + k)):
            if a < b and words[a:b] != words[a + apart : b + apart]:
                return next(x for x in range(a, b) if words[x] != words[x + apart]) - i
        self.sure[apart] = min(first, i), max(last, i + k)
        return k


def lyndon_ends(words: list[int], common: Common, upward: bool) -> list[int]:
    """Where the longest Lyndon word from each place ends, in the order of the numbers or in the opposite one.

    The places that are still open, from right to left, form a stack: each
    takes over the words behind it as long as it is the smaller suffix.
    """
    n = len(words)
    ends = [n] * n
    for i in range(n - 1, -1, -1):
        mine, j = words[i], i + 1
        while j < n:
            yours = words[j]
            if mine == yours:
                k = common.length(i, j)
                if j + k == n:
                    break  # the rest of the text is the smaller suffix
                mine_, yours = words[i + k], words[j + k]
                smaller = mine_ < yours if upward else mine_ > yours
            else:
                smaller = mine < yours if upward else mine > yours
            if not smaller:
                break
            j = ends[j]
        ends[i] = j
    return ends


def stretches(words: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the stretches of ``least`` words or more all of whose words lie in three-word windows that their text holds twice."""
    n = len(words)
    if n < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # Windows that hash alike only by chance make a stretch longer, never shorter.
    mix = np.uint64(0x9E3779B97F4A7C15)
    w = (words.astype(np.uint64) + np.uint64(1)) * mix
    w ^= w >> np.uint64(29)
    key = ((w[:-2] * mix + w[1:-1]) * mix + w[2:]) * mix
    key ^= (owner[:-2].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(owner[:-2] == owner[2:])
    order = np.argsort(key[at], kind="stable")
    sorted_ = key[at][order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(at) else np.zeros(0, dtype=bool)
    twice = at[order][~new | np.append(~new[1:], False)] if len(at) else at
    inside = np.zeros(n + 1, dtype=bool)
    for k in range(3):
        inside[twice + k] = True
    # A stretch ends with its text.
    edge = np.concatenate([[True], owner[1:] != owner[:-1], [True]])
    begins = np.flatnonzero(inside[:-1] & (~np.concatenate([[False], inside[:-2]]) | edge[:-1]))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge[1:])) + 1
    long = ends - begins >= least
    return begins[long], ends[long]


def find_runs(words: np.ndarray, owner: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows ``(first, length, period)`` of all runs of at least ``least`` words and ``periods`` periods, in order.

    ``words`` are the word numbers of all texts, end to end, ``owner`` the text
    of each; ``least`` is at least 6 and ``periods`` at least 4.
    """
    if least < 6 or periods < 4:
        raise ValueError("shorter runs may lie outside of repeated windows")
    begins, ends = stretches(words, owner, least)
    none = np.zeros((0, 3), dtype=np.int64)
    if not len(begins):
        return none
    # The stretches end to end, as they are hashed.
    sizes = ends - begins
    base = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(base[-1]) - np.repeat(base[:-1] - begins, sizes)
    flat = words[place]
    hashes = Hashes(flat)
    all_words, sums, power = flat.tolist(), hashes.sums.tolist(), Hashes.powers
    first, second = [], []
    for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True):
        part = all_words[a:b]
        common = Common(part, sums[a : b + 1], power)
        for upward in (True, False):
            roots = lyndon_ends(part, common, upward)
            first.append(np.arange(a, b))
            second.append(np.array(roots, dtype=np.int64) + a)
    i, j = np.concatenate(first), np.concatenate(second)
    stretch = np.searchsorted(base, i, side="right") - 1
    low, high = base[stretch], base[stretch + 1]
    # A run of four periods has a root whose next two periods are in it too.
    period = j - i
    some = j + 2 * period <= high
    i, j, low, high, period = (x[some] for x in (i, j, low, high, period))
    some = hashes.same(i, j, 2 * period)
    i, j, low, high, period = (x[some] for x in (i, j, low, high, period))
    if not len(i):
        return none
    start, end = i - hashes.backward(i, j, i - low), j + hashes.forward(i, j, high - j)
    big = end - start >= np.maximum(least, periods * period)
    found = np.unique(np.stack([start, end, period], axis=1)[big], axis=0)
    kept = [r for r in found.tolist() if _holds(flat, r, base)]
    if len(kept) < len(found):  # a hash met by chance: extend those roots word by word
        kept = sorted({r for r in (_by_words(flat, p, q, base) for p, q in zip(i.tolist(), j.tolist(), strict=True)) if r[1] - r[0] >= max(least, periods * r[2])})
    out = np.array(kept, dtype=np.int64).reshape(-1, 3)
    return np.stack([place[out[:, 0]], out[:, 1] - out[:, 0], out[:, 2]], axis=1)


def _holds(flat: np.ndarray, run: list[int], base: np.ndarray) -> bool:
    """Whether every word of the run is the one a period later, and its neighbours are not."""
    start, end, q = run
    k = bisect_right(base, start) - 1
    inside = bool((flat[start : end - q] == flat[start + q : end]).all())
    return inside and (start == base[k] or flat[start - 1] != flat[start - 1 + q]) and (end == base[k + 1] or flat[end] != flat[end - q])


def _by_words(flat: np.ndarray, i: int, j: int, base: np.ndarray) -> tuple[int, int, int]:
    """The stretch of period ``j - i`` around ``i``, without hashes."""
    q, k = j - i, bisect_right(base, i) - 1
    start, end = i, j
    while end < base[k + 1] and flat[end] == flat[end - q]:
        end += 1
    while start > base[k] and flat[start - 1] == flat[start - 1 + q]:
        start -= 1
    return start, end, q


_RUN = pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """The ``keep`` columns, ``n_words``, ``runs`` and the ``collapsed`` text of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0; ``runs`` are structs
    ``(first, length, period)`` of all runs of at least ``least`` words and
    ``periods`` periods, by ``first``, then ``period``. ``collapsed`` has the
    words that no run contains after its first period, joined by one space.
    A null text has no words, no runs and an empty ``collapsed``. Rows that
    repeat are judged alike; an empty table gives an empty result. Texts are
    laid end to end in slices bounded by bytes; a longer text is a slice of its
    own, whole. A kept column that has the name of a returned one comes back as
    ``kept_<name>``.
    """
    bound_batches(docs.sparkSession)
    slim = keep_apart(docs, keep, ("n_words", "runs", "collapsed"), text_col)
    names = slim.columns[:-1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            texts = [(t or "").encode("utf-8", "replace").split() for t in b.column("__text").to_pylist()]
            numbers: dict[bytes, int] = {}
            coded = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], dtype=np.int64)
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            base = np.concatenate([[0], np.cumsum(sizes)])
            rows = find_runs(coded, np.repeat(np.arange(len(texts)), sizes), least, periods)
            rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
            # Words that a run contains after its first period.
            change = np.zeros(len(coded) + 1, dtype=np.int64)
            np.add.at(change, rows[:, 0] + rows[:, 2], 1)
            np.add.at(change, rows[:, 0] + rows[:, 1], -1)
            gone = np.cumsum(change)[:-1] > 0
            of = np.searchsorted(base, rows[:, 0], side="right") - 1
            edges = np.searchsorted(of, np.arange(len(texts) + 1))
            runs, collapsed = [], []
            for k, t in enumerate(texts):
                mine = rows[edges[k] : edges[k + 1]]
                runs.append([{"first": a - int(base[k]), "length": n, "period": q} for a, n, q in mine.tolist()])
                left = t if not len(mine) else [t[x] for x in np.flatnonzero(~gone[base[k] : base[k + 1]]).tolist()]
                collapsed.append(b" ".join(left).decode("utf-8"))
            new = [pa.array(sizes), pa.array(runs, type=_RUN), pa.array(collapsed, type=pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *new], names=[*names, "n_words", "runs", "collapsed"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema.fields[:-1])
    return slim.mapInArrow(scan, fields + "n_words long, runs array<struct<first: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of all documents, a tenth of them by ``crc32`` of the id with a periodic end; a null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", (F.floor(h / 10)).alias("g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("hit"))
    rows = rows.withColumn("w", F.when(F.col("hit"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).withColumn("n", F.size("w"))
    some = F.col("hit") & (F.col("n") > 0)
    rows = rows.withColumn("a", F.when(some, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.when(some, F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))))
    # Whole periods are sliced and repeated, so that no word is looked up by itself.
    cycle = F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    tail = F.flatten(F.array_repeat(cycle, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    new = F.slice(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), F.lit(1), F.col("n"))
    return rows.select("doc_id", F.when(some, F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The runs of each row in short: their number, the longest, and hashes of all and of the collapsed text."""
    runs = F.col("runs")
    # The longest; of those the one that starts first, then of the smallest period.
    order = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["first"]).alias("back"), (-r["period"]).alias("less")))
    rows = found.withColumn("best", F.array_max(order))
    listed = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["first"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    listed = F.when(F.size(runs) > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    length, period = F.col("best.length"), -F.col("best.less")
    return rows.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
