"""Two versions of a corpus: one-to-one reconciliation and reuse of translations."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.tables import cut
from quern.functions.udfs import Packed, longest_common, ratio_at

#: Rank of each kind of match and what context adds to it, limits of modified sources, options shown.
RANKS = {"confirmed_lineage": 600.0, "locator_exact": 500.0, "content_exact": 450.0, "moved_exact": 300.0, "source_modified": 200.0}
MOVED_BONUS = {"speaker": 30.0, "before": 12.0, "after": 12.0, "mode": 4.0}
MODIFIED_BONUS = {"speaker": 8.0, "before": 4.0, "after": 4.0}
MIN_RATIO, MARGIN, MIN_LENGTH, OPTIONS = 0.82, 5.0, 4, 8
#: Words of the texts that are compared with another one at a time; texts below which each goes alone.
PACKED, ALONE = 1 << 23, 12
#: Columns of counts that one product takes; common pieces of texts that are listed at a time.
COLUMNS, LISTED = 1024, 1 << 19
#: Columns of a version that may be missing; they are null then.
OPTIONAL = ("lineage", "locator", "content", "before", "after", "speaker", "mode")


def _version(df: DataFrame) -> DataFrame:
    """The columns that matching reads, texts normalised, empty ones null."""
    text = lambda c: F.nullif(F.trim(F.regexp_replace(c, "\r\n?", "\n")), F.lit(""))
    have = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in OPTIONAL]
    rows = df.select("id", F.col("source"), *have)
    rows = rows.withColumns({c: text(F.col(c)) for c in ("source", "before", "after", "speaker")})
    # A neighbour that says the same as the row is no context.
    return rows.withColumns({c: F.when(F.col(c) != F.col("source"), F.col(c)) for c in ("before", "after")})


def _once(rows: DataFrame, key: str) -> DataFrame:
    """``(key, id, ...)`` of keys that one row has."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min("id").alias("id"), *[F.min(c).alias(c) for c in ("lineage", "locator") if c != key]).filter("n = 1").drop("n")


def _pairs_of_once(base: DataFrame, target: DataFrame, key: str, kind: str, differ: tuple[str, ...]) -> DataFrame:
    """``(base_id, target_id, kind, score)`` of keys that one row of each side has; stronger keys must not agree."""
    a = _once(base, key).withColumnsRenamed({"id": "base_id"} | {c: f"b_{c}" for c in differ})
    b = _once(target, key).withColumnsRenamed({"id": "target_id"} | {c: f"t_{c}" for c in differ})
    same = reduce(lambda x, y: x | y, [F.coalesce(F.col(f"b_{c}") == F.col(f"t_{c}"), F.lit(False)) for c in differ], F.lit(False))
    return a.select(key, "base_id", *[f"b_{c}" for c in differ]).join(b.select(key, "target_id", *[f"t_{c}" for c in differ]), key).filter(~same).select("base_id", "target_id", F.lit(kind).alias("kind"), F.lit(RANKS[kind]).alias("score"), F.lit(1.0).alias("confidence"))


def _less(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return rows.join(pairs.select(F.col(f"{side}_id").alias("id")), "id", "left_anti")


def exact_matches(base: DataFrame, target: DataFrame) -> DataFrame:
    """``(base_id, target_id, kind, score, confidence)`` by lineage, then locator, then content.

    Rows share a key with one row of the other side, and it with one of theirs,
    or the key decides nothing: lineage and locator among rows that are left,
    content among all. No pair of a common key is listed.
    """
    a, b = _version(base), _version(target)
    found = cut(_pairs_of_once(a, b, "lineage", "confirmed_lineage", ()), "lineage")
    place = _pairs_of_once(_less(a, found, "base"), _less(b, found, "target"), "locator", "locator_exact", ("lineage",))
    found = cut(found.unionByName(place), "locator")
    content = _pairs_of_once(a, b, "content", "content_exact", ("lineage", "locator"))
    content = content.join(found.select("base_id"), "base_id", "left_anti").join(found.select("target_id"), "target_id", "left_anti")
    return found.unionByName(content)


def _patterns() -> list[tuple[tuple[str, ...], float]]:
    """Which context two rows may share, and what that adds; those with the same sum add up."""
    names = tuple(MOVED_BONUS)
    some = [tuple(n for k, n in enumerate(names) if i >> k & 1) for i in range(1 << len(names))]
    return [(p, sum(MOVED_BONUS[n] for n in p)) for p in some]


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("side", F.lit("base")).unionByName(b.withColumn("side", F.lit("target")))


def moved_matches(a: DataFrame, b: DataFrame, counts: DataFrame) -> DataFrame:
    """``(base_id, target_id, kind, score, confidence)`` of rows with the same source, mutual best by shared context.

    For every set of context fields, rows are counted by their values: the
    highest sum for which the other side has a row tells a row's best, and a
    count of one that it is the only one. So no pair of a common source is
    listed. ``counts`` tells how often each source is said in both versions; a
    source that either says twice needs context. Matched rows leave and the
    others are counted again, until no pair is found.
    """
    rows = cut(_sides(a, b).join(counts.filter("b_n > 0 AND t_n > 0"), "source"), "moved")
    matched = None
    while True:
        options = F.array(
            *[
                F.when(
                    reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in p], (F.col("b_n") * F.col("t_n") == 1) | F.lit(bool({*p} - {"mode"}))),
                    F.struct(F.lit(bonus).alias("bonus"), F.sha2(F.to_json(F.struct(F.lit(",".join(p)).alias("p"), "source", *p)).cast("binary"), 256).alias("key")),
                )
                for p, bonus in _patterns()
            ]
        )
        keyed = rows.select("id", "side", F.explode(F.filter(options, lambda o: o.isNotNull())).alias("o")).select("id", "side", "o.bonus", "o.key")
        by_key = keyed.groupBy("key").agg(*[f(F.when(F.col("side") == s, F.col("id"))).alias(f"{s}_{n}") for s in ("base", "target") for f, n in ((F.count, "n"), (F.min, "id"))]).filter("base_n > 0 AND target_n > 0")
        other = lambda c: F.when(F.col("side") == "base", F.col(f"target_{c}")).otherwise(F.col(f"base_{c}"))
        sums = keyed.join(by_key, "key").groupBy("id", "side", "bonus").agg(F.sum(other("n")).alias("n"), F.min(other("id")).alias("choice"))
        best = sums.groupBy("id", "side").agg(F.max(F.struct("bonus", "n", "choice")).alias("b")).filter("b.n = 1").select("id", "side", "b.bonus", "b.choice")
        mine = best.filter("side = 'base'").select(F.col("id").alias("base_id"), F.col("choice").alias("target_id"), "bonus")
        yours = best.filter("side = 'target'").select(F.col("choice").alias("base_id"), F.col("id").alias("target_id"))
        new = mine.join(yours, ["base_id", "target_id"]).join(a.select(F.col("id").alias("base_id"), "source"), "base_id").join(counts, "source")
        plain = (F.col("b_n") == 1) & (F.col("t_n") == 1)
        context = F.col("bonus") > MOVED_BONUS["mode"]
        new = cut(new.select("base_id", "target_id", F.when(plain | ~context, "moved_exact").otherwise("context_high_confidence").alias("kind"), (F.lit(RANKS["moved_exact"]) + F.col("bonus")).alias("score"), F.when(context, 0.98).otherwise(0.93).alias("confidence")), "moved")
        if new.isEmpty():
            return matched if matched is not None else new
        matched = new if matched is None else matched.unionByName(new)
        gone = new.select(F.explode(F.array(F.struct(F.lit("base").alias("side"), F.col("base_id").alias("id")), F.struct(F.lit("target").alias("side"), F.col("target_id").alias("id")))).alias("g")).select("g.*")
        rows = cut(rows.join(gone, ["side", "id"], "left_anti"), "moved")


def _counts(texts: list[str], size: int, width: int) -> np.ndarray:
    """How often each text has the pieces of ``size`` characters, by ``width`` hashed places."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), n)
    key = c * np.uint64(0x9E3779B1)
    if size == 2:
        key, row = (key[:-1] + c[1:])[row[:-1] == row[1:]], row[:-1][row[:-1] == row[1:]]
    place = (key * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40)) % np.uint64(width)
    return np.bincount(row * width + place.astype(np.int64), minlength=len(texts) * width).reshape(len(texts), width)


def _common_pieces(a: list[str], b: list[str], size: int, width: int) -> np.ndarray:
    """For all pairs, an upper bound of the pieces of one or two characters that both have, as often as both have them.

    Whether a place has a count or more is a sign of a vector, so that products
    of matrices count what is common for all pairs. Counts above 32 are told
    apart by a sixteenth and count as the highest that they may be.
    """
    x, y = _counts(a, size, width), _counts(b, size, width)
    top = np.minimum(x.max(axis=0), y.max(axis=0))
    kind = np.float32 if max(x.sum(axis=1).max(), y.sum(axis=1).max()) < 1 << 22 else np.float64
    total, left, right, held, level = np.zeros((len(a), len(b)), dtype=kind), [], [], 0, 1
    while True:
        at, step = np.flatnonzero(top >= level), max(1, level // 16)
        if at.size:
            left.append((x[:, at] >= level).astype(kind) * kind(step))
            right.append((y[:, at] >= level).astype(kind))
        held, level = held + at.size, level + step
        if left and (held >= COLUMNS or not at.size):
            total += np.concatenate(left, axis=1) @ np.concatenate(right, axis=1).T
            left, right, held = [], [], 0
        if not at.size:
            return total


def _ranks(xs: list[str], ys: list[str], wanted: float) -> tuple[dict[int, np.ndarray], int]:
    """Numbers of the pieces of 1, 2, 4, 8 and some other length at each place of all texts, and that length.

    Every text has an end of its own, so that no piece goes over into the next
    text. The length is the least at which about ``wanted`` places of both
    sides have the same piece.
    """
    points = np.frombuffer("".join([*xs, *ys]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    n = np.array([len(t) for t in [*xs, *ys]], dtype=np.int64)
    points = np.insert(points, np.cumsum(n), (1 << 21) + np.arange(n.size))
    number = lambda key: np.unique(key, return_inverse=True)[1].astype(np.int64)
    first = int(n[: len(xs)].sum()) + len(xs)

    def longer(r: np.ndarray, by: int) -> np.ndarray:
        later = np.concatenate([r[by:], np.full(by, r.max() + 1)])
        return number(r * (r.max() + 2) + later)

    def shared(r: np.ndarray) -> float:
        return float(np.bincount(r[:first], minlength=r.max() + 1).astype(float) @ np.bincount(r[first:], minlength=r.max() + 1))

    ranks = {1: number(points)}
    for size in (1, 2, 4):
        ranks[2 * size] = longer(ranks[size], size)
    four, eight = shared(ranks[4]) + 1, shared(ranks[8]) + 1
    size = 4 if four <= wanted else 4 + math.ceil(4 * math.log(four / wanted) / max(math.log(four / eight), 0.01))
    size = min(16, size)
    if size not in ranks:
        ranks[size] = longer(ranks[4 if size < 8 else 8], size - (4 if size < 8 else 8))
    return ranks, size


def _blocks(xs: list[str], ys: list[str], some: np.ndarray, common: np.ndarray, wanted: float) -> np.ndarray:
    """The pairs of ``some`` whose matching blocks may hold ``common`` characters or more.

    As ``SequenceMatcher`` does, the longest common piece of a pair (the first
    of them) cuts it into what is before and what is behind, and so on. Left of
    a piece that stands at far places, or right of it, one text has little to
    match. Where no common piece of the listed length is left, blocks are
    shorter, and two of them have a character between them. Texts that repeat
    themselves so that their pieces are too many to list stay in ``some``.
    """
    if max(map(len, xs)) >= 1 << 20 or max(map(len, ys)) >= 1 << 20:
        return some
    ranks, size = _ranks(xs, ys, wanted * some.sum())
    n, m = (np.array([len(t) for t in side], dtype=np.int64) for side in (xs, ys))
    begin_a = np.cumsum(n + 1) - n - 1
    begin_b = np.cumsum(m + 1) - m - 1 + (n + 1).sum()
    last = int((n + 1).sum())
    row_a, row_b = np.repeat(np.arange(n.size), n + 1), np.repeat(np.arange(m.size), m + 1)
    chars, ids = ranks[1], ranks[size]
    times = np.bincount(ids[last:], minlength=ids.max() + 1)
    places = np.argsort(ids[last:], kind="stable") + last
    start = np.cumsum(times) - times
    listed = times[ids[:last]]
    by_row = np.add.reduceat(listed, begin_a)
    out, row = some.copy(), 0
    most = (1 << 20) - 1
    while row < n.size:
        upto = row + max(1, min(LISTED // m.size, int(np.searchsorted(np.cumsum(by_row[row:]), LISTED, side="right"))))
        if by_row[row] > LISTED or not some[row:upto].any():
            row = upto
            continue
        span = slice(begin_a[row], begin_a[upto] if upto < n.size else last)
        k = listed[span]
        i = np.repeat(np.arange(span.start, span.stop), k)
        j = places[np.repeat(start[ids[span]] - np.cumsum(k) + k, k) + np.arange(i.size)]
        # Only where a common piece begins: the characters before differ.
        begins = (i == 0) | (chars[i - 1] != chars[j - 1])
        i, j = i[begins], j[begins]
        pair = (row_a[i] - row) * m.size + row_b[j - last]
        asked = some[row:upto].ravel()[pair]
        i, j, pair = i[asked], j[asked], pair[asked]
        length, on = np.full(i.size, size), np.arange(i.size)
        while on.size:
            on = on[(i[on] + length[on] < last) & (j[on] + length[on] < ids.size)]
            on = on[ids[i[on] + length[on]] == ids[j[on] + length[on]]]
            length[on] += size
        for by in (8, 4, 2, 1):
            at = np.flatnonzero((i + length < last) & (j + length < ids.size))
            length[at[ranks[by][i[at] + length[at]] == ranks[by][j[at] + length[at]]]] += by
        i, j = i - begin_a[row_a[i]], j - begin_b[row_b[j - last]]
        # Parts of pairs: places in both texts, from and to; the common pieces in each part.
        of = np.flatnonzero(some[row:upto].ravel())
        place = np.zeros((upto - row) * m.size, dtype=np.int64)
        place[of] = np.arange(of.size)
        need = common[row:upto].ravel()[of]
        sure, node = np.zeros(of.size, dtype=np.int64), place[pair]
        whose, a0, b0 = np.arange(of.size), np.zeros(of.size, dtype=np.int64), np.zeros(of.size, dtype=np.int64)
        a1, b1 = n[row + of // m.size], m[of % m.size]
        while True:
            best = np.zeros(whose.size, dtype=np.int64)
            np.maximum.at(best, node, length << 40 | (most - i) << 20 | (most - j))
            cut_ = best > 0
            w, h = a1 - a0, b1 - b0
            none = np.minimum(np.minimum(w, h), ((w + h + 1) * (size - 1) // (2 * size - 1)))
            k, x, y = best >> 40, most - (best >> 20 & most), most - (best & most)
            add = lambda values, at: np.bincount(whose[at], weights=values[at], minlength=of.size).astype(np.int64)  # noqa: B023, E731
            sure += add(np.where(cut_, k, none), slice(None))
            if not cut_.any():
                break
            rest = np.minimum(x - a0, y - b0) + np.minimum(a1 - x - k, b1 - y - k)
            alive = sure + add(rest, cut_) >= need
            go = cut_ & alive[whose]
            sure[~alive] = -1
            # The parts on both sides of each longest piece, and what the other pieces have in them.
            new = np.cumsum(go) - 1
            on = go[node]
            i, j, length, node = i[on], j[on], length[on], node[on]
            x_, y_, k_ = x[node], y[node], k[node]
            ahead = np.minimum(length, np.minimum(x_ - i, y_ - j))
            behind = np.maximum(0, np.maximum(x_ + k_ - i, y_ + k_ - j))
            l, r = ahead >= size, length - behind >= size
            half = int(go.sum())
            whose, a0, b0, a1, b1 = (np.concatenate(p) for p in ((whose[go], whose[go]), (a0[go], (x + k)[go]), (b0[go], (y + k)[go]), (x[go], a1[go]), (y[go], b1[go])))
            i, j, length, node = (np.concatenate(p) for p in ((i[l], (i + behind)[r]), (j[l], (j + behind)[r]), (ahead[l], (length - behind)[r]), (new[node][l], new[node][r] + half)))
        out[row:upto].ravel()[of[sure < need]] = False
        row = upto
    return out


def _possible(xs: list[str], ys: list[str], least: float, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that lengths, common characters, bigrams and pieces let be ``least`` alike, and how many characters each has in common then."""
    n, m = np.array([len(t) for t in xs]), np.array([len(t) for t in ys])
    both = n[:, None] + m[None, :]
    common = np.ceil(least / 2 * both - 1e-9)
    some = (2 * np.minimum(n[:, None], m[None, :]) >= least * both) & (np.maximum(n[:, None], m[None, :]) >= min_length)
    width = 1 << max(8, min(13, int(max(n.max(), m.max())).bit_length() + 1))
    if some.any():
        some &= _common_pieces(xs, ys, 1, 256) >= common
    if some.any():
        some &= _common_pieces(xs, ys, 2, width) >= 3 * common - both - 1
    # Numbering the pieces is worth it where many pairs of long texts are left.
    if some.sum() * n.mean() > 16 * (n.sum() + m.sum()):
        some = _blocks(xs, ys, some, common, max(32.0, n.mean() / 16))
    return some, common


def _subsequences(xs: list[str], ys: list[str], some: np.ndarray, common: np.ndarray) -> Iterator[tuple[int, int]]:
    """The pairs of ``some`` with a common subsequence of ``common`` characters or more.

    A text of one side passes many of the other side at once, as many as
    ``PACKED`` words hold; where few are left, each goes alone.
    """
    words = len({*"".join(xs)}) * -(-max(map(len, xs), default=1) // 64) + 1
    size = max(64, PACKED // words)
    for first in range(0, len(xs), size):
        part, packed = xs[first : first + size], None
        for j in np.flatnonzero(some[first : first + size].any(axis=0)).tolist():
            at = np.flatnonzero(some[first : first + size, j])
            least = common[first + at, j]
            if at.size < ALONE:
                found = np.array([longest_common(xs[first + i], ys[j], c) for i, c in zip(at.tolist(), least.tolist(), strict=True)])
            else:
                packed = packed or Packed(part)
                found = packed.longest_common(ys[j], least, at)
            yield from ((first + i, j) for i in at[found >= least].tolist())


def similar_pairs(a: DataFrame, b: DataFrame, least: float = MIN_RATIO, min_length: int = MIN_LENGTH) -> DataFrame:
    """``(base_id, target_id, ratio)`` of all pairs of ``(id, source)`` whose sources are ``least`` alike or more; the longer one has ``min_length`` characters.

    No pair is missed: a ratio needs a common subsequence of ``least / 2`` of
    all characters, which leaves all but a stated number of bigrams in common.
    Rows fall into buckets by length (a quarter apart) and blocks by id; blocks
    whose lengths may match meet in cells, where products of matrices bound the
    common characters and bigrams of all their pairs, and the common pieces of
    some characters bound their matching blocks. Only pairs within the bounds
    have their texts compared, as far as they can still be alike. A cell holds
    two blocks; their number grows with the product of the sides, as any exact
    join at such a ratio does.
    """
    step = math.log(1.25)
    apart = math.ceil(math.log((2 - least) / least) / step + 1e-9)
    # Long texts have wide vectors, so that their blocks are small.
    rows = lambda bucket: F.greatest(F.lit(64), F.least(F.lit(2048), F.floor(F.lit(1 << 20) / F.exp(F.col(bucket) * step)))).cast("int")
    buckets, sides = [], []
    for df, bucket, part in ((a, "ka", "pa"), (b, "kb", "pb")):
        have = df.filter(F.length("source") > 0).select("id", "source", F.floor(F.log(F.length("source").cast("double")) / step).cast("int").alias(bucket))
        counts = cut(have.groupBy(bucket).agg(F.count("*").alias("n")).select(bucket, F.ceil(F.col("n") / rows(bucket)).cast("int").alias("parts")), "buckets")
        sides.append(have.join(F.broadcast(counts), bucket).withColumn(part, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts"))
        buckets.append(counts.select(bucket, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(part)))
    # Buckets are at most some hundred and fifty a side; a block meets those whose lengths are near.
    near = buckets[1].withColumn("ka", F.explode(F.sequence(F.col("kb") - apart, F.col("kb") + apart)))
    cells = buckets[0].join(near, "ka").select("ka", "pa", "kb", "pb")
    keys = ("ka", "pa", "kb", "pb")
    left, right = sides[0].join(cells, ["ka", "pa"]).select(*keys, "id", "source"), sides[1].join(cells, ["kb", "pb"]).select(*keys, "id", "source")
    ids = [f.dataType.simpleString() for f in (a.schema["id"], b.schema["id"])]

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        xs, ys = x.column("source").to_pylist(), y.column("source").to_pylist()
        us, vs, ratios = [], [], []
        if xs and ys:
            some, common = _possible(xs, ys, least, min_length)
            for i, j in _subsequences(xs, ys, some, common):
                ratio = ratio_at(xs[i], ys[j], least)
                if ratio is not None:
                    us.append(i)
                    vs.append(j)
                    ratios.append(ratio)
        return pa.table({"base_id": x.column("id").take(pa.array(us, type=pa.int64())), "target_id": y.column("id").take(pa.array(vs, type=pa.int64())), "ratio": pa.array(ratios, type=pa.float64())})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, f"base_id {ids[0]}, target_id {ids[1]}, ratio double")


def modified_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(base_id, target_id, score, confidence, context)`` of rows whose sources are ``MIN_RATIO`` alike or more."""
    chars = lambda d, n: d.select(F.col("id").alias(f"{n}_id"), F.col("source").alias(f"{n}_source"), *[F.col(c).alias(f"{n}_{c}") for c in ("speaker", "before", "after")])
    pairs = cut(similar_pairs(a.select("id", "source"), b.select("id", "source")), "similar")
    scored = pairs.join(chars(a, "base"), "base_id").join(chars(b, "target"), "target_id")
    # A neighbour that is the other side's source is no context either.
    same = {c: F.coalesce(F.col(f"base_{c}") == F.col(f"target_{c}"), F.lit(False)) for c in MODIFIED_BONUS}
    for c in ("before", "after"):
        same[c] = same[c] & (F.col(f"base_{c}") != F.col("target_source")) & (F.col(f"target_{c}") != F.col("base_source"))
    score = reduce(lambda x, c: x + F.when(same[c], MODIFIED_BONUS[c]).otherwise(0.0), same, F.lit(RANKS["source_modified"]) + 100 * F.col("ratio"))
    sure = F.least(F.lit(0.99), 0.88 * F.col("ratio") + F.when(same["speaker"], 0.05).otherwise(0.0) + F.when(same["before"], 0.025).otherwise(0.0) + F.when(same["after"], 0.025).otherwise(0.0))
    return scored.select("base_id", "target_id", score.alias("score"), sure.alias("confidence"), (same["speaker"] | same["before"] | same["after"]).alias("context"))


def match_one_to_one(pairs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Mutual best pairs of ``(base_id, target_id, score, usable, ...)`` until none is left.

    A pair is best if it is ``usable`` and no other pair of its row comes
    within ``margin``. Matched rows leave, so that others may become best in
    the next round; every round but the last matches a pair, and each reads
    what the one before left.
    """
    left, matched = cut(pairs, "pairs"), None
    while True:
        own = left
        for side in ("base_id", "target_id"):
            w = Window.partitionBy(side).orderBy(F.col("score").desc(), "base_id", "target_id")
            own = own.withColumn(f"p_{side}", F.row_number().over(w)).withColumn(f"n_{side}", F.lead("score").over(w))
            own = own.withColumn(f"ok_{side}", (F.col(f"p_{side}") == 1) & (F.col(f"n_{side}").isNull() | (F.col("score") - F.col(f"n_{side}") > margin)))
        new = cut(own.filter("ok_base_id AND ok_target_id AND usable").select(*pairs.columns), "pairs")
        if new.isEmpty():
            return matched if matched is not None else new
        matched = new if matched is None else matched.unionByName(new)
        left = cut(left.join(new.select("base_id"), "base_id", "left_anti").join(new.select("target_id"), "target_id", "left_anti"), "pairs")


def reconcile(base: DataFrame, target: DataFrame, fuzzy: bool = True) -> DataFrame:
    """``(disposition, kind, base_id, target_id, options, confidence)`` of every row of both versions.

    Both sides have ``id`` and ``source``, and may have ``lineage, locator,
    content, before, after, speaker, mode``. Ids are unique within a side; null
    or empty keys agree with nothing. Kinds are tried from the strongest to the
    weakest: ``confirmed_lineage, locator_exact, content_exact, moved_exact``
    (``context_high_confidence`` where context decided among equal sources),
    ``source_modified``. A row that shares a key with rows left over, or is
    like one, is ``ambiguous`` (base) or ``ambiguous_target``; ``options``
    shows the first of them (at most ``OPTIONS``). Without any it is
    ``deleted`` or ``added``. Rows whose content is on the other side, but not
    once on each, are not matched as moved.
    """
    a, b = cut(_version(base), "base"), cut(_version(target), "target")
    exact = cut(exact_matches(base, target), "exact")
    counts = _sides(a, b).filter("source IS NOT NULL").groupBy("source").agg(F.count_if(F.col("side") == "base").alias("b_n"), F.count_if(F.col("side") == "target").alias("t_n"))
    counts = cut(counts, "counts")
    left_a, left_b = cut(_less(a, exact, "base"), "left"), cut(_less(b, exact, "target"), "left")
    shared = a.filter("content IS NOT NULL").select("content").distinct().join(b.select("content").distinct(), "content")
    free = lambda d: d.join(shared, "content", "left_anti")
    moved = moved_matches(free(left_a), free(left_b), counts)
    matched = cut(exact.unionByName(moved), "matched")
    left_a, left_b = cut(_less(left_a, moved, "base"), "left"), cut(_less(left_b, moved, "target"), "left")

    # Rows left over that share a key; what is related is a pair of keys, not of rows.
    related = lambda d: d.select("id", F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in ("lineage", "locator", "content", "source")])).alias("key")).filter("key IS NOT NULL")
    has_key = related(a).join(related(b).select("key").distinct(), "key", "left_semi").select("id").distinct()
    keys_a, keys_b = related(left_a), related(left_b)
    shown = keys_b.withColumn("p", F.row_number().over(Window.partitionBy("key").orderBy("id"))).filter(F.col("p") <= OPTIONS).groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    options = keys_a.join(shown, "key").select("id", F.col("ids"))
    unsure = keys_b.join(keys_a.select("key").distinct(), "key", "left_semi").select("id")
    if fuzzy:
        pairs = modified_pairs(left_a.join(has_key, "id", "left_anti"), left_b)
        said = lambda d, n, c: d.select(F.col("id").alias(f"{n}_id"), "source").join(counts.select("source", F.col(c).alias(f"{n}_n")), "source").drop("source")
        pairs = pairs.join(said(left_a, "base", "b_n"), "base_id").join(said(left_b, "target", "t_n"), "target_id")
        pairs = cut(pairs.select("base_id", "target_id", "score", "confidence", (F.col("context") | ((F.col("base_n") == 1) & (F.col("target_n") == 1))).alias("usable")), "modified")
        like = match_one_to_one(pairs)
        matched = cut(matched.unionByName(like.select("base_id", "target_id", F.lit("source_modified").alias("kind"), "score", "confidence")), "matched")
        rest = pairs.join(like.select("base_id"), "base_id", "left_anti").join(like.select("target_id"), "target_id", "left_anti")
        left_a, left_b = _less(left_a, like, "base"), _less(left_b, like, "target")
        best = rest.withColumn("p", F.row_number().over(Window.partitionBy("base_id").orderBy(F.col("score").desc(), "target_id"))).filter(F.col("p") <= OPTIONS)
        options = options.unionByName(best.groupBy(F.col("base_id").alias("id")).agg(F.array_sort(F.collect_set("target_id")).alias("ids")))
        # A target that a modified source took is no option any more.
        options = options.select("id", F.explode("ids").alias("one")).join(like.select(F.col("target_id").alias("one")), "one", "left_anti").groupBy("id").agg(F.collect_set("one").alias("ids"))
        unsure = unsure.unionByName(rest.select(F.col("target_id").alias("id")))
    options = options.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, OPTIONS).alias("options"))

    none, ids = F.lit(None), base.schema["id"].dataType
    empty = F.array().cast(f"array<{ids.simpleString()}>")
    out = matched.select(F.lit("matched").alias("disposition"), "kind", "base_id", "target_id", F.array("target_id").alias("options"), F.bround("confidence", 4).alias("confidence"))
    open_a = left_a.select("id").join(options, "id", "left")
    open_a = open_a.select(F.when(F.col("options").isNull(), "deleted").otherwise("ambiguous").alias("disposition"), none.cast("string").alias("kind"), F.col("id").alias("base_id"), none.cast(ids).alias("target_id"), F.coalesce("options", empty).alias("options"), F.lit(0.0).alias("confidence"))
    open_b = left_b.select("id").join(unsure.distinct().withColumn("some", F.lit(True)), "id", "left")
    open_b = open_b.select(F.when(F.col("some"), "ambiguous_target").otherwise("added").alias("disposition"), none.cast("string").alias("kind"), none.cast(ids).alias("base_id"), F.col("id").alias("target_id"), empty.alias("options"), F.lit(0.0).alias("confidence"))
    return out.unionByName(open_a).unionByName(open_b)


DISPOSITIONS = ("matched", "ambiguous", "ambiguous_target", "deleted", "added")


def disposition_rank(c: Column) -> Column:
    """Sort key of dispositions."""
    return F.array_position(F.array(*map(F.lit, DISPOSITIONS)), c)


def reuse_candidates(items: DataFrame, base: DataFrame, target: DataFrame, records: DataFrame) -> DataFrame:
    """Matched items with both texts and the base row's translation; exact, fuzzy, or without a record."""
    m = items.filter(F.col("disposition") == "matched").select("base_id", "target_id", "kind", "confidence")
    out = m.join(base.select(F.col("id").alias("base_id"), F.col("source").alias("base_source")), "base_id").join(target.select(F.col("id").alias("target_id"), F.col("source").alias("target_source")), "target_id")
    out = out.join(records.select(F.col("id").alias("base_id"), "translation"), "base_id", "left")
    kind = F.when(F.col("translation").isNull(), "no_record").when(F.col("base_source") == F.col("target_source"), "exact").otherwise("changed")
    return out.withColumn("reuse", kind)


def apply_decisions(cands: DataFrame, decisions: DataFrame) -> DataFrame:
    """The candidates with ``status``, ``final`` text and ``reviewer`` after their decisions, in order.

    ``decisions`` has ``target_id, ordinal, action, text, reviewer``; an
    override after an accept takes the reviewer over.
    """
    d = decisions.filter(F.col("action").isin("accept", "reject", "override_translation"))
    verdict = d.groupBy("target_id").agg(
        F.max_by("action", "ordinal").alias("action"), F.max_by("reviewer", "ordinal").alias("reviewer"),
        F.max_by("text", F.when(F.col("action") == "override_translation", F.col("ordinal"))).alias("text"), F.count("*").alias("n_decisions"),
    )
    out = cands.join(verdict, "target_id", "left")
    status = F.when(F.col("action").isNull(), "pending").when(F.col("action") == "reject", "rejected").otherwise("accepted")
    return out.withColumn("status", status).withColumn("final", F.when(status == "accepted", F.coalesce("text", "translation"))).drop("action", "text").withColumn("n_decisions", F.coalesce("n_decisions", F.lit(0)))


def relocate(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(id, new_id, how)``: by identity, else by a content key that is unique on both sides."""
    same = old.join(new.select("id", F.col("locator").alias("nl")), "id", "left_semi").select("id", F.col("id").alias("new_id"), F.lit("identity").alias("how"))
    only = lambda d: d.join(same.select("id"), "id", "left_anti").groupBy("content").agg(F.count("*").alias("n"), F.min("id").alias("one")).filter("n = 1")
    moved = only(old).select("content", F.col("one").alias("id")).join(only(new).select("content", F.col("one").alias("new_id")), "content").select("id", "new_id", F.lit("content").alias("how"))
    return same.unionByName(moved)
