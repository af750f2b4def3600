"""Operator 12: exact Jaccard join of word n-gram sets by token-combination prefixes.

1. Equal sets fold into one class under its smallest id.
2. Shingles (tokens) have one order for all sets: a fifth of them, by hash,
   before the others, then rare before frequent, then by hash. Two sets that
   link miss few of each other's tokens, so that they share what they need
   within a short prefix in that order. Rare tokens are indexed by themselves;
   frequent ones fall into small classes by hash and are indexed by pairs or
   triples of a class. A prefix is extended until ``sum(max(0, n_c - k_c + 1))``
   over its classes exceeds the tokens that may be missing (``n_c`` tokens of a
   class indexed by ``k_c`` at a time), so that every linked pair shares an
   index entry. A set whose tokens nobody shares within its prefix has none.
   As a fifth of the tokens nearly always holds the prefix, only these are
   counted and moved; small sets take all.
3. Sets that share an entry are candidates. A bitmap of token parities bounds
   the size of the symmetric difference from below, so that pairs beyond the
   limit are dropped with certainty.
4. Sets that are like the smallest set of an entry form families; members are
   kept as differences from their family's smallest set and compared with each
   other in cells, exactly. Candidates of different families are confirmed on
   their full sets. Links are counted, not listed; components come from
   alternating star steps.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, mix64, salted_join, slices
from .near_dup import Likeness, _by_cell, _common, _differences, _linked, _numbered, connected, shingle_set

#: Tokens below this hash come first: a fifth.
LOW = (1 << 64) // 5
#: Tokens of a prefix, about, that fall into one class of frequent tokens.
ROOM = 8
#: Sets that hold a token: above the first number it is indexed by pairs, above the second by triples.
FREQUENT = (32, 1024)
#: Tokens of so many sets that their list is broadcast: at most this many can have that frequency.
BROADCAST_TOKENS = 100_000
#: Sets like the smallest of an entry by this percentage, as far as bitmaps tell, join its family.
FAMILY = 75
#: Members, and bytes of differences, of a part of a family; members of a part of an entry.
CELL_ROWS, CELL_BYTES, ENTRY_ROWS, BLOCK = 512, 16 << 20, 1024, 512

#: Sizes from which the levels start; a level is less than half an octave.
_BOUNDS = sorted({int(2 ** (k / 2)) for k in range(100)})


def need(size: int, percent: int) -> int:
    """One more token than a set of ``size`` may lack in a set that it links with."""
    return size - -(-percent * size // 100) + 1


def levels(size: int, percent: int) -> range:
    """Levels of the sets that are as large as this one, or larger, and may link with it."""
    return range(bisect_right(_BOUNDS, size), bisect_right(_BOUNDS, 100 * size // percent) + 1)


@lru_cache(maxsize=None)
def classes_of(level: int, percent: int) -> int:
    """Classes of the tokens indexed by pairs, and of those by triples, at a level; 0: all tokens are indexed alone there.

    The smallest set that comes to the level must be able to extend its prefix
    by one token for each class of pairs and by two for each of triples.
    """
    first = _BOUNDS[level - 1]
    many = -(-need(first * 3 // 2, percent) // ROOM)
    smallest = -(-percent * first // 100)
    return many if smallest - need(smallest, percent) >= 3 * many + 2 else 0


def enough(size: int, percent: int) -> int:
    """Tokens that hold the prefix of a set of this size whatever their frequencies."""
    return need(size, percent) + 3 * max(classes_of(level, percent) for level in levels(size, percent))


def alone(size: int, percent: int) -> bool:
    """Whether a set of this size links with equal sets only."""
    return 100 * size < percent * (size + 1)


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by their last bits, two bits or more a token."""
    width = max(64, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(bits: bytes, size: int) -> np.ndarray:
    """The bitmap at a smaller width: parities add up."""
    words = np.frombuffer(bits, dtype=np.uint64)
    while len(words) * 8 > size:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def may_differ(total, percent: int):
    """Most tokens that only one of two sets holds if they link, by the sum of their sizes."""
    return total * (100 - percent) // (100 + percent)


def _features(docs: DataFrame, like: Likeness) -> DataFrame:
    """Per text: the digest of its set, its size, the tokens that can be in its prefix, its bitmap."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingle_set(t, like.shingle) for t in b.column("text").to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            tokens, lows = [], []
            for s in sets:
                low = int(np.searchsorted(s, np.uint64(LOW)))
                lows.append(low)
                if not len(s) or alone(len(s), like.percent):
                    tokens.append(s[:0])
                else:
                    tokens.append(s[:low] if low >= enough(len(s), like.percent) else s)
            upto = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            flat = pa.array(np.concatenate(tokens).view(np.int64)) if tokens else pa.array([], type=pa.int64())
            cols = [b.column("doc_id"), b.column("own"), pa.array(digests, type=pa.binary()), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(lows, type=pa.int64()), pa.ListArray.from_arrays(pa.array(upto), flat), pa.array([bitmap(s) for s in sets], type=pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "own", "set_id", "n_shingles", "n_low", "tokens", "bits"])

    return docs.mapInArrow(go, "doc_id long, own long, set_id binary, n_shingles long, n_low long, tokens array<long>, bits binary")


def _frequencies(classes: DataFrame) -> DataFrame:
    """``(node, token, n)`` of the tokens that ``n`` sets, two or more, hold.

    The few tokens of very many sets are known to all tasks; the others meet
    their count in a shuffle.
    """
    tokens = classes.select("node", F.explode("tokens").alias("token"))
    counts = materialize(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    total = classes.agg(F.sum(F.size("tokens"))).first()[0] or 0
    most = max(FREQUENT[0], total // BROADCAST_TOKENS)
    hot, rest = F.broadcast(counts.filter(F.col("n") > most)), counts.filter(F.col("n") <= most)
    met = tokens.join(hot, "token").select("node", "token", "n")
    return met.unionByName(tokens.join(hot.select("token"), "token", "left_anti").join(rest, "token").select("node", "token", "n"))


def entries(size: int, n_low: int, tokens: np.ndarray, known: np.ndarray, counts: np.ndarray, percent: int, frequent: tuple[int, int] = FREQUENT) -> list[int]:
    """Index entries of one set at all its levels.

    ``tokens`` is how many tokens the set has given to be counted, ``known``
    are those that others hold and ``counts`` how many sets do.
    """
    low = known < np.uint64(LOW)
    rank = np.frexp(counts.astype(np.float64))[1]
    out: list[int] = []
    for level in levels(size, percent):
        many = classes_of(level, percent)
        missing = need(size, percent)
        picked: list[np.ndarray] = []  # tokens of the prefix, and how many of them make an entry
        by: list[np.ndarray] = []
        for mine, given in ((low, min(n_low, tokens)), (~low, max(0, tokens - n_low))):
            missing -= given - int(mine.sum())  # tokens that no other set holds
            if missing <= 0:
                break
            order = np.lexsort((known[mine], rank[mine]))
            some, n = known[mine][order], counts[mine][order]
            k = np.ones(len(some), dtype=np.int64) if not many else 1 + (n > frequent[0]) + (n > frequent[1])
            # A class gains nothing before it has as many tokens as make an entry.
            spot = np.where(k > 1, (mix64(some) % np.uint64(max(many, 1))).astype(np.int64) * 4 + k, 0)
            place = _occurrence(spot)
            if picked:
                earlier = Counter(np.concatenate([_spots(p, q, many) for p, q in zip(picked, by, strict=True)]).tolist())
                place = place + np.array([earlier[x] for x in spot.tolist()], dtype=np.int64)
            gain = np.cumsum((k == 1) | (place >= k))
            take = int(np.searchsorted(gain, missing)) + 1
            picked.append(some[:take])
            by.append(k[:take])
            missing -= int(gain[min(take, len(gain)) - 1]) if len(gain) else 0
            if missing <= 0:
                break
        if missing > 0:
            raise ValueError("a prefix does not hold its set's tokens")
        if picked:
            out += _made(np.concatenate(picked), np.concatenate(by), level, many)
    return out


def _spots(tokens: np.ndarray, k: np.ndarray, many: int) -> np.ndarray:
    return np.where(k > 1, (mix64(tokens) % np.uint64(max(many, 1))).astype(np.int64) * 4 + k, 0)


def _occurrence(values: np.ndarray) -> np.ndarray:
    """The how-manieth of its value each place is, from 1."""
    order = np.argsort(values, kind="stable")
    sorted_ = values[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)
    run = np.repeat(first, np.diff(np.append(first, len(values))))
    out = np.empty(len(values), dtype=np.int64)
    out[order] = np.arange(len(values)) - run + 1
    return out


def _made(tokens: np.ndarray, k: np.ndarray, level: int, many: int) -> list[int]:
    """Entries of a prefix: single tokens, and combinations inside each class."""
    factor, start = np.uint64(0x9E3779B97F4A7C15), mix64(np.array([level], dtype=np.uint64) + np.uint64(77))
    out = mix64(start * factor + tokens[k == 1]).view(np.int64).tolist()
    spots = _spots(tokens, k, many)
    for spot in np.unique(spots[spots > 0]).tolist():
        mine = np.sort(tokens[spots == spot])
        pick = np.array(list(combinations(range(len(mine)), spot % 4)), dtype=np.int64).reshape(-1, spot % 4)
        acc = np.full(len(pick), start[0] + np.uint64(spot % 4), dtype=np.uint64)
        for c in range(spot % 4):
            acc = mix64(acc * factor + mine[pick[:, c]])
        out += acc.view(np.int64).tolist()
    return out


def _index(classes: DataFrame, like: Likeness, frequent: tuple[int, int]) -> DataFrame:
    """``(band, node)``: the index entries of every set that has some."""
    met = _frequencies(classes).groupBy("node").agg(F.collect_list("token").alias("known"), F.collect_list("n").alias("counts"))
    sizes = classes.select("node", "n_shingles", "n_low", F.size("tokens").alias("given"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, bands = [], []
            known, counts = b.column("known"), b.column("counts")
            for row, (node, size, low, given) in enumerate(zip(*(b.column(c).to_pylist() for c in ("node", "n_shingles", "n_low", "given")), strict=True)):
                made = entries(size, low, given, known[row].values.to_numpy(zero_copy_only=False).view(np.uint64), counts[row].values.to_numpy(zero_copy_only=False), like.percent, frequent)
                bands += made
                nodes += [node] * len(made)
            yield pa.RecordBatch.from_arrays([pa.array(bands, type=pa.int64()), pa.array(nodes, type=pa.int64())], names=["band", "node"])

    return met.join(sizes, "node").select("node", "n_shingles", "n_low", "given", "known", "counts").mapInArrow(go, "band long, node long")


def _stars(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` of a set and the smallest of its entry that may be alike as a family is."""
    side = lambda name, n, bits: maps.select(F.col("node").alias(name), F.col("n_shingles").alias(n), F.col("bits").alias(bits))
    both = salted_join(pairs, side("u", "nu", "a"), "u", F.col("v"), "inner").join(side("v", "nv", "b"), "v").select("u", "v", "nu", "nv", "a", "b")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for nu, nv, x, y in zip(*(b.column(c).to_pylist() for c in ("nu", "nv", "a", "b")), strict=True):
                size = min(len(x), len(y))
                ok.append(int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= may_differ(nu + nv, FAMILY))
            keep = pa.array(ok, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], names=["u", "v"])

    return both.mapInArrow(go, "u long, v long")


def _families(diffs: DataFrame, weights: DataFrame) -> DataFrame:
    """Members of each family in the cells ``(pivot, i, j)`` in which their parts meet; the pivot is a member."""
    heads = diffs.groupBy("pivot").agg(F.first("size").alias("size"), F.greatest(F.ceil(F.count("*") / CELL_ROWS), F.ceil(F.sum(F.length("lacks") + F.length("adds")) / CELL_BYTES)).cast("int").alias("parts"))
    empty = F.lit(b"")
    rows = diffs.unionByName(heads.select(F.col("pivot").alias("node"), "pivot", "size", empty.alias("lacks"), empty.alias("adds"), F.lit(True).alias("linked"))).join(weights, "node")
    rows = salted_join(rows, heads.select("pivot", F.greatest("parts", F.lit(1)).alias("parts")), "pivot", F.col("node"), "inner")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("pivot", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "size", "lacks", "adds", "linked", "weight")


def _blocks(n: int) -> list[slice]:
    return [slice(a, a + BLOCK) for a in range(0, n, BLOCK)]


def _compare_family(like: Likeness):
    """Rows ``(u, v, links)`` of a cell: ``u = v`` with the links of a member there, others as what connects them."""

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        node, part, linked, weight = (t.column(c).to_numpy() for c in ("node", "part", "linked", "weight"))
        i, j, size = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("size")[0].as_py()
        lacks, adds = ([np.frombuffer(v, dtype=np.uint64) for v in t.column(c).to_pylist()] for c in ("lacks", "adds"))
        less, more = np.array([len(v) for v in lacks]), np.array([len(v) for v in adds])
        whole = size - less + more
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        links, us, vs = np.zeros(len(node), dtype=np.int64), [], []
        for a, sa in enumerate(_blocks(len(left))):
            for b, sb in enumerate(_blocks(len(right))):
                if i == j and b < a:
                    continue
                x, y = left[sa], right[sb]
                pick, mine, yours = np.concatenate([x, y]), np.arange(len(x)), np.arange(len(x), len(x) + len(y))
                same = size - less[x][:, None] - less[y][None, :] + _common([lacks[k] for k in pick], mine, yours) + _common([adds[k] for k in pick], mine, yours)
                ok = (same > 0) & (100 * same >= like.percent * (whole[x][:, None] + whole[y][None, :] - same)) & (node[x][:, None] != node[y][None, :])
                links[x] += ok @ weight[y]
                if not (i == j and a == b):
                    links[y] += ok.T @ weight[x]
                # The least label among what a member links with, until none changes; all that link with the pivot share one.
                label = np.where(linked[pick], -1, node[pick])
                big = np.iinfo(np.int64).max
                while True:
                    u = np.minimum(label[mine], np.where(ok, label[yours][None, :], big).min(axis=1, initial=big))
                    v = np.minimum(label[yours], np.where(ok, u[:, None], big).min(axis=0, initial=big))
                    now = np.concatenate([u, v])
                    if (now == label).all():
                        break
                    label = now
                for k in np.flatnonzero(label != np.where(linked[pick], -1, node[pick])).tolist():
                    us.append(int(node[pick[k]]))
                    vs.append(int(label[k]) if label[k] >= 0 else t.column("pivot")[0].as_py())
        some = np.flatnonzero(links)
        cols = [np.concatenate([node[some], np.array(us, dtype=np.int64)]), np.concatenate([node[some], np.array(vs, dtype=np.int64)]), np.concatenate([links[some], np.zeros(len(us), dtype=np.int64)])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["u", "v", "links"]) if len(cols[0]) else None

    return compare


def _candidates(members: DataFrame, live: DataFrame, like: Likeness) -> DataFrame:
    """``(u, v)``: pairs of different families in one entry that their bitmaps allow.

    ``members`` has ``(band, node, family, n_shingles, bits)``, ``live`` the
    size of each entry that two families share.
    """
    parts = F.ceil(F.col("size") / ENTRY_ROWS).cast("int")
    cells = salted_join(members, live, "band", F.col("node"), "inner").withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = cells.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "family", "n_shingles", "bits")

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        node, family, part, size = (t.column(c).to_numpy() for c in ("node", "family", "part", "n_shingles"))
        raw = t.column("bits").to_pylist()
        width = min(map(len, raw))
        bits = np.stack([fold(x, width) for x in raw])
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        us, vs = [], []
        for a, sa in enumerate(_blocks(len(left))):
            for b, sb in enumerate(_blocks(len(right))):
                if i == j and b < a:
                    continue
                x, y = left[sa], right[sb]
                differ = np.zeros((len(x), len(y)), dtype=np.int64)
                for w in range(bits.shape[1]):
                    differ += np.bitwise_count(bits[x, w][:, None] ^ bits[y, w][None, :])
                good = (differ <= may_differ(size[x][:, None] + size[y][None, :], like.percent)) & (family[x][:, None] != family[y][None, :])
                p, q = np.nonzero(good)
                us += np.minimum(node[x[p]], node[y[q]]).tolist()
                vs += np.maximum(node[x[p]], node[y[q]]).tolist()
        return pa.RecordBatch.from_arrays([pa.array(us, type=pa.int64()), pa.array(vs, type=pa.int64())], names=["u", "v"]) if us else None

    return _by_cell(cells, "band", compare, "u long, v long").distinct()


def similar_classes(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", frequent: tuple[int, int] = FREQUENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` of every row.

    A row's set are its distinct ``shingle``-word shingles, A-Z lower-cased;
    with fewer words, the whole sequence as one. Rows link if 100 times the
    common shingles are at least ``percent`` times all their shingles;
    ``component_id`` is the smallest id reachable over links, itself included,
    ``n_links`` the number of other rows that link with the row. Null texts and
    texts without words have no shingle and link with nothing; a row without id
    links with nothing and has no component. Rows that share an id are one
    document with the links of all of them. Equal rows are all returned, and
    link. An empty table gives an empty result; other columns are not read.
    Texts of any length count whole, in slices bounded by bytes. ``frequent``
    says from how many sets on a token is indexed by pairs and by triples; it
    changes the work, not the result.
    """
    spark, like = docs.sparkSession, Likeness(shingle=shingle, percent=percent)
    bound_batches(spark)
    texts, twins, shift = _numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    features = materialize(_features(texts, like), "features")
    some = features.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "n_low", "tokens", "bits")]
    classes = materialize(some.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.count("*").alias("weight"), *firsts), "classes")
    maps, weights = classes.select("node", "n_shingles", "bits"), classes.select("node", "weight")
    spread = materialize(_index(classes, like, frequent), "entries")
    shared = spread.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("top")).filter("center < top").select("band", "center")
    members = materialize(salted_join(spread, shared, "band", F.col("node"), "inner"), "members")

    stars = members.filter("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct()
    families = connected(_stars(stars, maps))
    diffs = materialize(_differences(families, texts, like), "differences")
    inside = materialize(_by_cell(_families(diffs, weights), "pivot", _compare_family(like), "u long, v long, links long"), "inside")
    placed = members.select("band", "node").join(families, "node", "left").select("band", "node", F.coalesce("root", "node").alias("family"))
    placed = materialize(placed.join(maps, "node"), "placed")
    live = placed.groupBy("band").agg(F.min("family").alias("a"), F.max("family").alias("b"), F.count("*").alias("size")).filter("a < b").select("band", "size")
    across = materialize(_linked(materialize(_candidates(placed, live, like), "candidates"), texts, like), "across")

    links = diffs.filter("linked").select(F.col("pivot").alias("u"), F.col("node").alias("v")).unionByName(inside.filter("u <> v").select("u", "v")).unionByName(across)
    if twins is not None:
        nodes = features.filter("doc_id IS NOT NULL").join(classes.select("set_id", "node"), "set_id").select("doc_id", "node").distinct()
        links = links.unionByName(twins.join(nodes.toDF("own", "u"), "own").join(nodes.toDF("doc_id", "v"), "doc_id").select("u", "v"))
    labels = connected(links)
    both = across.unionByName(across.select(F.col("v").alias("u"), F.col("u").alias("v")))
    counted = salted_join(both, weights.select(F.col("node").alias("v"), "weight"), "v", F.col("u"), "inner").select("u", F.col("weight").alias("links"))
    counts = counted.unionByName(inside.filter("u = v").select("u", "links")).groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    known = classes.select("set_id", "node", "weight").join(labels, "node", "left").join(counts, "node", "left")
    rows = features.select(F.col("own").alias("doc_id"), F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"), "n_shingles").join(known, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node", "doc_id"))
    return rows.select((F.col("doc_id") + F.lit(shift)).alias("doc_id"), "n_shingles", (component + F.lit(shift)).alias("component_id"), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).cast("long").alias("n_links"))
