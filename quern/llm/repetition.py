"""Operator 9: quality rules on repetition, from suffix arrays over words.

The texts of a slice are laid end to end as word numbers. Only words inside a
three-word window that its text holds twice can start a longer repeat, so the
suffix array (prefix doubling) is built over those alone. Its longest common
prefixes give the intervals of maximal repeats; the union of their spans is
the covered part of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bound_batches, keep_apart, mix64, slices, word_hashes

#: Words of a repeat that counts towards the method's limits.
MIN_REPEAT = 10
#: A text fails if repeats of that length cover more of its words than this (the part of duplicate lines
#: that public filters of web corpora allow, well below the base's half of all words),
MAX_COVERED = 0.3
#: or if its longest repeat is longer than this many words and than this part of its words.
MAX_LONGEST, MAX_LONGEST_PART = 50, 0.2

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_maximal", "covered", "longest")


def line_stats(text: bytes) -> tuple[int, int, int]:
    """Code points in words, symbol characters, repeated lines that have a word."""
    raw = np.frombuffer(text, dtype=np.uint8)
    chars = int(np.count_nonzero((raw & 0xC0) != 0x80)) - int(np.count_nonzero(SPACE[raw]))
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    return chars, int(np.count_nonzero(_SYMBOL[raw])), again


def suffix_ranks(number: np.ndarray, start: np.ndarray, width: int) -> list[np.ndarray]:
    """Ranks of all places by their first window, first two windows, first four windows and so on.

    ``number`` orders the windows of ``width`` words at each place; it is the
    place of the first equal window in sorted order, which leaves room for the
    ranks that a group splits into. Only places in ``start`` may be equal.
    """
    n = len(number)
    rank = np.append(number, -1)
    levels = [rank]
    while len(start):
        follow = rank[np.minimum(start + width, n)]
        order = np.lexsort((follow, rank[start]))
        start, a, b, at = start[order], rank[start][order], follow[order], np.arange(len(start))
        group = np.concatenate([[True], a[1:] != a[:-1]])
        part = group | np.concatenate([[True], b[1:] != b[:-1]])
        rank = rank.copy()
        rank[start] = a + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank)
        start = start[~part | np.append(~part[1:], False)]
        width *= 2
    return levels


def repeats(words: np.ndarray, owner: np.ndarray, min_repeat: int = MIN_REPEAT) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per text: whether each word lies in a repeated 3-word window; then n_maximal, covered and longest.

    ``words`` are the word hashes of all texts, ``owner`` the text of each.
    """
    texts = int(owner.max()) + 1 if len(owner) else 0
    n, zero = len(words), np.zeros(texts, dtype=np.int64)
    hit = np.zeros(n, dtype=bool)
    if n < 3:
        return hit, [zero, zero.copy(), zero.copy()]
    own = mix64(owner.astype(np.uint64) + np.uint64(1))
    tri = mix64(words[:-2] * np.uint64(3) + mix64(words[1:-1] + mix64(words[2:] ^ own[:-2])))
    whole = owner[:-2] == owner[2:]
    at = np.flatnonzero(whole)
    order = np.argsort(tri[at], kind="stable")
    key = tri[at][order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    twice = ~new | np.concatenate([~new[1:], [False]])
    start = at[order][twice]
    for k in range(3):
        hit[start + k] = True
    if not len(start):
        return hit, [zero, zero.copy(), zero.copy()]
    # Number the repeated places and those that follow them in the order of their words.
    places = np.unique(np.concatenate([start, np.minimum(start + 3, n - 1)]))
    three = []
    for k in range(3):
        p = np.minimum(places + k, n - 1)
        three.append(np.where((places + k < n) & (owner[p] == owner[places]), words[p], np.uint64(0)))
    order = np.lexsort((three[2], three[1], three[0], owner[places]))
    cols = [owner[places][order], *(t[order] for t in three)]
    new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])
    number = -2 - np.arange(n, dtype=np.int64)
    number[places[order]] = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
    levels = suffix_ranks(number, np.sort(start), 3)
    # Suffix order of the repeated places by their last rank; then common prefixes, from wide levels to narrow.
    sa = start[np.lexsort((start, levels[-1][start]))]
    left, right = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(left), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width, rank = 3 << k, levels[k]
        both = np.flatnonzero((left < n) & (right < n))
        same = both[rank[left[both]] == rank[right[both]]]
        lcp[same] += width
        left[same] += width
        right[same] += width
    for _ in range(2):  # up to two more words than whole windows
        both = np.flatnonzero((lcp > 0) & (left < n) & (right < n))
        both = both[(words[left[both]] == words[right[both]]) & (owner[left[both]] == owner[sa[:-1][both]]) & (owner[right[both]] == owner[sa[1:][both]])]
        lcp[both] += 1
        left[both] += 1
        right[both] += 1
    best = np.zeros(n, dtype=np.int64)
    np.maximum.at(best, sa[:-1], lcp)
    np.maximum.at(best, sa[1:], lcp)
    counts = [maximal_intervals(sa, lcp, words, owner, min_repeat, texts)]
    longest = np.zeros(texts, dtype=np.int64)
    np.maximum.at(longest, owner, best)
    reach = np.where(best >= min_repeat, np.arange(n) + best, 0)
    covered = np.maximum.accumulate(reach) > np.arange(n)
    return hit, [counts[0], np.bincount(owner[covered], minlength=texts).astype(np.int64), longest]


def maximal_intervals(sa: np.ndarray, lcp: np.ndarray, words: np.ndarray, owner: np.ndarray, least: int, texts: int) -> np.ndarray:
    """Number of maximal repeats of ``least`` words or more in each text.

    A repeat is an interval of suffixes whose common prefix neither neighbour
    shares; it is maximal if not all its suffixes follow the same word.
    """
    out = np.zeros(texts, dtype=np.int64)
    if not len(lcp) or lcp.max() < least:
        return out
    before = [int(words[p - 1]) if p and owner[p - 1] == owner[p] else -1 - int(p) for p in sa.tolist()]
    stack: list[list] = []  # common prefix, the word before (None: several)
    for i, depth in enumerate([*lcp.tolist(), 0]):
        run = before[i]
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            top[1] = top[1] if top[1] == run else None
            out[owner[sa[i]]] += top[1] is None
            run = top[1]
        if depth >= least:
            if stack and stack[-1][0] == depth:
                stack[-1][1] = stack[-1][1] if stack[-1][1] == run else None
            else:
                stack.append([depth, run])
    return out


def judge_repetition(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, max_longest_part: float = MAX_LONGEST_PART) -> DataFrame:
    """The ``keep`` columns, the counts of every text and its verdict.

    Counts are ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``
    and, of repeats of ``min_repeat`` words or more, ``n_maximal`` and
    ``covered`` words, with ``longest``, the words of the longest repeat of
    three or more. Null is an empty text: all counts 0, so the base fails it.
    Rows that repeat are judged alike; an empty table gives an empty result.
    Texts are laid end to end in slices bounded by bytes; a longer text is a
    slice of its own, whole. A kept column that has the name of a returned one
    comes back as ``kept_<name>``.
    """
    bound_batches(docs.sparkSession)
    slim = keep_apart(docs, keep, (*_NUMBERS, "base_failed", "kept"), text_col)
    names = slim.columns[:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            raw = [(t or "").encode("utf-8", "replace") for t in b.column("__text").to_pylist()]
            words = [word_hashes(t, lower=False) for t in raw]
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            lines = np.array([line_stats(t) for t in raw], dtype=np.int64).reshape(-1, 3)
            owner = np.repeat(np.arange(len(raw)), sizes)
            hit, more = repeats(np.concatenate(words), owner, min_repeat)
            more = [np.pad(m, (0, len(raw) - len(m))) for m in more]
            cols = [sizes, lines[:, 0], lines[:, 1], lines[:, 2], np.bincount(owner[hit], minlength=len(raw)), *more]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(np.asarray(c, dtype=np.int64)) for c in cols)], names=[*names, *_NUMBERS])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema.fields[:-1])
    rows = slim.mapInArrow(count, fields + ", ".join(f"{c} long" for c in _NUMBERS))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    method = (F.col("covered") > max_covered * F.col("n_words")) | ((F.col("longest") > max_longest) & (F.col("longest") > max_longest_part * F.col("n_words")))
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & ~method)
