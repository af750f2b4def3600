"""The Arrow UDFs: what Spark's built-in functions cannot express."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def casefold_key(text: pd.Series) -> pd.Series:
    """Composed, compact, case-folded."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()).casefold())


@F.pandas_udf(DoubleType())
def sequence_ratio(base: pd.Series, target: pd.Series) -> pd.Series:
    """Ratio of matching blocks; not symmetric, ``base`` comes first."""
    return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in zip(base, target, strict=True)])


def longest_common(a: str, b: str, least: float = 0) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of a number.

    Where it turns out on the way that it is below ``least``, a number below
    ``least`` that it does not exceed.
    """
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for j, c in enumerate(b):
        if at := row & places.get(c, 0):
            row = (row + at | row - at) & full
        if least and j % 32 == 31 and (most := len(a) - row.bit_count() + len(b) - j - 1) < least:
            return most
    return len(a) - row.bit_count()


class Packed:
    """Texts side by side, 64 characters of each in a word, so that one operation on words serves all of them."""

    def __init__(self, texts: list[str]):
        self.texts, self.lengths = texts, np.array([len(t) for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.points, code = np.unique(points, return_inverse=True)
        row = np.repeat(np.arange(len(texts)), self.lengths)
        place = np.arange(points.size) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        #: By character, word and text.
        self.places = np.zeros((self.points.size, max(1, -(-int(self.lengths.max(initial=0)) // 64)), len(texts)), dtype=np.uint64)
        np.bitwise_or.at(self.places, (code, place >> 6, row), np.uint64(1) << (place & 63).astype(np.uint64))

    def longest_common(self, b: str, least: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
        """``longest_common`` of each of the texts, or of those at ``at``, and ``b``; of one that stays below its ``least``, a number below it.

        A pair that reaches ``least`` leaves few characters out, so that two
        that match stand at near places: words further off are not read. What
        is left of both bounds what can still be reached, and texts that cannot
        reach theirs are dropped on the way; the last few go on alone.
        """
        at = np.arange(self.lengths.size) if at is None else at
        least = np.zeros(at.size, dtype=np.int64) if least is None else least.astype(np.int64)
        keep, n, m, out = np.arange(at.size), self.lengths[at], len(b), np.zeros(at.size, dtype=np.int64)
        points = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = np.searchsorted(self.points, points)
        code = [int(c) if c < self.points.size and self.points[c] == p else -1 for c, p in zip(code, points, strict=True)]
        masks = {u: self.places[u] if at.size == self.lengths.size else self.places[u].take(at, axis=1) for u in {*code} - {-1}}
        words, every = self.places.shape[1], max(16, m // 16)
        rows = np.full((words, at.size), ~np.uint64(0))
        stop, changed, band = 4 * every, True, None
        for j, u in enumerate(code):
            if j == stop:
                stop += every
                # Equal ends of both may match whole; what stands before them is counted.
                upto = np.clip(n[keep] - m + j - 64 * np.arange(words)[:, None], 0, 64).astype(np.uint64)
                inside = np.where(upto == 64, ~np.uint64(0), (np.uint64(1) << (upto & np.uint64(63))) - np.uint64(1))
                most = np.bitwise_count(~rows & inside).sum(axis=0, dtype=np.int64) + m - j
                alive = np.flatnonzero(most >= least[keep])
                if alive.size * 5 < keep.size * 4:
                    keep, changed = keep[alive], True
                    if keep.size * 20 < m - j:
                        out[keep] = [longest_common(self.texts[at[i]], b, least[i]) for i in keep.tolist()]
                        return out
                    rows, masks = rows.take(alive, axis=1), {u: masks[u].take(alive, axis=1) for u in {*code[j:]} - {-1}}
            if changed:
                below, above = int((m - least[keep]).max(initial=0)), int((n[keep] - least[keep]).max(initial=0))
                matches, sums, over = np.empty_like(rows), np.empty_like(rows), np.empty(rows.shape, dtype=bool)
                changed, band = False, None
            first, last = max(0, j - below) >> 6, min(words, (j + above >> 6) + 1)
            if u < 0 or first >= last:
                continue
            if band != (first, last):
                band = first, last
                v, t, s, carry = (x[first:last] for x in (rows, matches, sums, over))
                low, up, carry = s[:-1], s[1:], carry[1:]
            np.bitwise_and(v, masks[u][first:last], out=t)
            np.add(v, t, out=s)
            if last - first > 1:
                np.less(low, v[:-1], out=carry)
                np.add(up, carry, out=up)
                while np.count_nonzero(up) < up.size:  # a full word hands on what it gets
                    carry[1:] = (carry & (up == 0))[:-1]
                    carry[0] = False
                    if not carry.any():
                        break
                    np.add(up, carry, out=up)
            np.bitwise_xor(v, t, out=v)
            np.bitwise_or(v, s, out=v)
        out[keep] = np.bitwise_count(~rows).sum(axis=0, dtype=np.int64)
        return out


#: Length of the pieces by which long matching blocks are found, and of texts for which that is not worth it.
_PIECE, _SHORT = 16, 48


def _longest_block(a: str, b: str) -> tuple[int, int, int]:
    """Place in both texts and length of their longest common piece, the first of them; a length of 0 where it is below ``_PIECE``."""
    places: dict[str, list[int]] = {}
    for i in range(len(a) - _PIECE + 1):
        places.setdefault(a[i : i + _PIECE], []).append(i)
    best = (0, 0, 0)
    for j in range(len(b) - _PIECE + 1):
        for i in places.get(b[j : j + _PIECE], ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n, by = _PIECE, 256
            while by:
                while i + n + by <= len(a) and a[i + n : i + n + by] == b[j + n : j + n + by]:
                    n += by
                by //= 2
            best = max(best, (n, -i, -j))
    return -best[1], -best[2], best[0]


def matching(a: str, b: str) -> int:
    """Characters in the matching blocks of ``SequenceMatcher``, which looks at short blocks only."""
    total, open_ = 0, [(a, b)]
    while open_:
        x, y = open_.pop()
        if x in y or y in x:
            total += min(len(x), len(y))
            continue
        i, j, n = _longest_block(x, y) if min(len(x), len(y)) > _SHORT else (0, 0, 0)
        if n:
            total += n
            open_ += [(x[:i], y[:j]), (x[i + n :], y[j + n :])]
        else:
            total += sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
    return total


def ratio_at(a: str, b: str, least: float) -> float | None:
    """``sequence_ratio`` where it is ``least`` or more, else None."""
    ratio = 2.0 * matching(a, b) / (len(a) + len(b)) if a or b else 1.0
    return ratio if ratio >= least else None


@F.pandas_udf(DoubleType())
def ratio_from(base: pd.Series, target: pd.Series, least: pd.Series) -> pd.Series:
    """``sequence_ratio`` where a common subsequence lets it reach ``least``, else null."""
    out = []
    for a, b, low in zip(base, target, least, strict=True):
        hopeless = a is None or b is None or 2 * longest_common(a, b) < low * (len(a) + len(b))
        out.append(None if hopeless else difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())
    return pd.Series(out, dtype="float64")


@F.pandas_udf(ArrayType(StructType().add("match", StringType()).add("first", IntegerType()).add("last", IntegerType())))
def spans(text: pd.Series, pattern: pd.Series) -> pd.Series:
    """All matches of a pattern with their offsets in code points, last exclusive."""
    return pd.Series([[] if t is None or p is None else [{"match": m[0], "first": m.start(), "last": m.end()} for m in re.finditer(p, t)] for t, p in zip(text, pattern, strict=True)])


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and no blanks; null where it does not parse."""

    def one(t):
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return text.map(one)


@F.pandas_udf(StringType())
def salvage_json(text: pd.Series) -> pd.Series:
    """The JSON in a model's answer: fenced, surrounded by talk, or cut off after a complete element."""

    def one(t):
        if t is None:
            return None
        fenced = re.search(r"```(?:json)?\s*(.*?)```", t, re.S)
        body = (fenced[1] if fenced else t).strip()
        start = min((i for i in (body.find("["), body.find("{")) if i >= 0), default=-1)
        if start < 0:
            return None
        body = body[start:]
        try:
            return json.dumps(json.JSONDecoder().raw_decode(body)[0], ensure_ascii=False)
        except ValueError:
            pass
        for end in (m.end() for m in reversed(list(re.finditer(r"\}", body)))):
            for close in ("]", "]}", "}", ""):
                try:
                    return json.dumps(json.loads(body[:end] + close), ensure_ascii=False)
                except ValueError:
                    continue
        return None

    return text.map(one)
