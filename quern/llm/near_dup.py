"""Operator 8: near-duplicate classes by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts gives each document the digest of its shingle set,
   band keys of its MinHash minima, and a signature that packs the low bits of
   the minima. Documents with equal sets fall into one class at once; the class
   goes on under its smallest id.
2. Classes that share a band key are candidates. Each class is compared by
   signature with the smallest class of its buckets; agreeing bits, corrected
   for chance, estimate the similarity. Classes that are broadly alike form a
   family, and each member is kept as its difference from the family's
   smallest class: the shingles it lacks and those it adds.
3. Inside a family the differences give the exact common shingles of any two
   members. Members that do not link with the smallest class are compared with
   all others in cells of at most ``CHUNK`` x ``CHUNK``, however large the
   family is; only links leave a cell.
4. Pairs in shared buckets but of different families are compared by signature
   in like cells; likely pairs go on, the best of each class first, and are
   confirmed on their full sets, made from the texts again.
5. Connected classes get their smallest id by alternating large-star and
   small-star steps.

No step keeps a list of links, classes or signatures on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, mix64, salted_join, slices, word_hashes

#: Members of a bucket that one cell compares with as many others.
CHUNK = 256
#: Estimated similarity from which a class joins the family of a bucket's smallest class.
FAMILY = 0.5
#: Pairs that each class may propose in a round, best first; the last round proposes all that are left.
ROUNDS = (4, 64, None)


@dataclass(frozen=True)
class Likeness:
    """What counts as alike, and how candidates are found.

    With 38 bands of 5 minima a pair at similarity 0.85 is missed with
    probability 2e-10, at 0.8 with 3e-7.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 38
    rows: int = 5
    bits: int = 2
    seed: int = 11

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreeing(self) -> int:
        """Agreeing minima below which a pair at the limit falls with probability under 1e-6."""
        chance = 2.0**-self.bits
        p = self.percent / 100 * (1 - chance) + chance
        return int(self.minima * p - 5 * (self.minima * p * (1 - p)) ** 0.5)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles; a shorter text is one shingle, an empty one none."""
    words = word_hashes(text.encode("utf-8", "replace")) if text else np.zeros(0, dtype=np.uint64)
    n = len(words)
    if not n:
        return words
    k = min(n, size)
    acc = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i])
    return np.unique(acc)


class Sketcher:
    """Minima, band keys and packed low bits of shingle sets."""

    def __init__(self, like: Likeness):
        rng = np.random.default_rng(like.seed)
        self.like = like
        self.mul = rng.integers(0, 1 << 32, like.minima, dtype=np.uint32)[:, None] | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, like.minima, dtype=np.uint32)[:, None]
        self.band_seed = rng.integers(0, 1 << 63, like.bands, dtype=np.uint64)
        self.words = -(-like.minima * like.bits // 64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low, x = np.full(self.like.minima, 0xFFFFFFFF, dtype=np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(x), 512):
            np.minimum(low, (self.mul * x[None, i : i + 512] + self.add).min(axis=1), out=low)
        return low

    def sketch(self, minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys and packed signatures of rows of minima."""
        like = self.like
        wide = mix64(minima.astype(np.uint64))
        keys = np.tile(self.band_seed, (len(minima), 1))
        for r in range(like.rows):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + wide[:, r :: like.rows])
        low = (wide >> np.uint64(64 - like.bits)).astype(np.uint64)
        per = 64 // like.bits
        sigs = np.zeros((len(minima), self.words), dtype=np.uint64)
        for i in range(like.minima):
            sigs[:, i // per] |= low[:, i] << np.uint64(like.bits * (i % per))
        return keys, sigs


def agreeing(a: np.ndarray, b: np.ndarray, like: Likeness) -> np.ndarray:
    """How many low-bit minima agree, for all rows of ``a`` with all rows of ``b``."""
    ones = np.uint64(sum(1 << i for i in range(0, 64, like.bits)))
    out = np.zeros((len(a), len(b)), dtype=np.int32)
    for w in range(a.shape[1]):
        differ = a[:, w][:, None] ^ b[:, w][None, :]
        for k in range(1, like.bits):
            differ |= (a[:, w][:, None] ^ b[:, w][None, :]) >> np.uint64(k)
        out += np.bitwise_count(~differ & ones)
    return out - (a.shape[1] * (64 // like.bits) - like.minima)


def agreeing_rows(a: np.ndarray, b: np.ndarray, like: Likeness) -> np.ndarray:
    """How many low-bit minima agree, row by row."""
    ones = np.uint64(sum(1 << i for i in range(0, 64, like.bits)))
    differ = a ^ b
    for k in range(1, like.bits):
        differ |= (a ^ b) >> np.uint64(k)
    return np.bitwise_count(~differ & ones).sum(axis=1, dtype=np.int64) - (a.shape[1] * (64 // like.bits) - like.minima)


def similarity(agree: int, like: Likeness) -> float:
    """The estimate from agreeing minima, corrected for chance agreement of the low bits."""
    chance = 2.0**-like.bits
    return max(0.0, (agree / like.minima - chance) / (1 - chance))


def _features(docs: DataFrame, like: Likeness) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketcher(like)
        for b in slices(batches, "text"):
            sets = [shingle_set(t, like.shingle) for t in b.column("text").to_pylist()]
            keys, sigs = maker.sketch(np.stack([maker.minima(s) for s in sets]))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("own"), pa.array(digests, type=pa.binary()), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(keys.view(np.int64).tolist(), type=pa.list_(pa.int64())), pa.array([s.tobytes() for s in sigs], type=pa.binary())],
                names=["doc_id", "own", "set_id", "n_shingles", "bands", "sig"],
            )

    return docs.mapInArrow(go, "doc_id long, own long, set_id binary, n_shingles long, bands array<long>, sig binary")


#: Ids (of 8 bytes) that are broadcast at most; beyond it texts are shuffled to meet them.
BROADCAST_IDS = 1_000_000
#: Texts that have a word.
WORDED = r"text RLIKE '[^\\x20\\x09-\\x0D]'"


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of the texts with words whose id is among ``ids``; few ids are broadcast, so that only these texts move."""
    ids = materialize(ids.distinct(), "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return texts.filter(WORDED).filter("doc_id IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(u, v, text_u, text_v)`` of the pairs."""
    # Rows that repeat fold after the others have gone.
    slim = _texts_of(texts, pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id")))).dropDuplicates(["doc_id"])
    both = pairs.join(slim.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u").join(slim.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    return both.select("u", "v", "text_u", "text_v")


def _cached_sets(like: Likeness):
    """``shingle_set`` that remembers the last few texts: a task meets the same ones in a row."""
    last: dict[str, np.ndarray] = {}

    def made(text: str) -> np.ndarray:
        if text not in last:
            if len(last) >= 64:
                last.clear()
            last[text] = shingle_set(text, like.shingle)
        return last[text]

    return made


def _linked(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """The pairs ``(u, v)`` whose full shingle sets meet the limit."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _cached_sets(like)
        for b in slices(batches, "text_u"):
            ok = []
            for tu, tv in zip(b.column("text_u").to_pylist(), b.column("text_v").to_pylist(), strict=True):
                x, y = made(tu), made(tv)
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(same > 0 and 100 * same >= like.percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([b.column("u").filter(pa.array(ok)), b.column("v").filter(pa.array(ok))], names=["u", "v"])

    return _with_texts(pairs, texts).mapInArrow(go, "u long, v long")


def _pair_scores(pairs: DataFrame, sigs: DataFrame, like: Likeness) -> DataFrame:
    """The pairs ``(u, v)`` whose signatures agree as families do."""
    least = next(n for n in range(like.minima + 1) if similarity(n, like) >= FAMILY)
    both = pairs.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("a")), "u").join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("b")), "v")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint64).reshape(b.num_rows, -1) for c in "ab")
                keep = pa.array(agreeing_rows(x, y, like) >= least)
                yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], names=["u", "v"])

    return both.select("u", "v", "a", "b").mapInArrow(go, "u long, v long")


def _differences(families: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """``(node, pivot, size, lacks, adds, linked)`` of every member but the pivot; ``size`` is the pivot's.

    ``lacks`` and ``adds`` hold shingle hashes, packed. A family is cut into
    cells of about ``CHUNK`` members, each of which gets the pivot's text once.
    """
    members = families.filter("node <> root")
    counts = members.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("cells"))
    placed = salted_join(members, counts, "root", F.col("node"), "inner").select("root", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int").alias("cell"), "node")
    heads = counts.select("root", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.col("root").alias("node"))
    rows = materialize(placed.unionByName(heads), "cells")
    slim = _texts_of(texts, rows.select(F.col("node").alias("doc_id"))).withColumnRenamed("doc_id", "node")
    # Rows that repeat follow each other, and count once.
    ordered = rows.join(slim, "node").select("root", "cell", "node", "text").repartition("root", "cell").sortWithinPartitions("root", "cell", F.col("node") != F.col("root"), "node")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, last = np.zeros(0, dtype=np.uint64), None
        for b in slices(batches, "text"):
            nodes, roots, cols = [], [], [[], [], [], []]
            for root, node, text in zip(*(b.column(c).to_pylist() for c in ("root", "node", "text")), strict=True):
                if (root, node) == last:
                    continue
                last = root, node
                y = shingle_set(text, like.shingle)
                if node == root:
                    x = y
                    continue
                lacks, adds = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                same = len(x) - len(lacks)
                nodes.append(node)
                roots.append(root)
                for c, value in zip(cols, (len(x), lacks.tobytes(), adds.tobytes(), same > 0 and 100 * same >= like.percent * (len(x) + len(adds))), strict=True):
                    c.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array(roots, type=pa.int64()), pa.array(cols[0], type=pa.int64()), pa.array(cols[1], type=pa.binary()), pa.array(cols[2], type=pa.binary()), pa.array(cols[3], type=pa.bool_())], names=["node", "pivot", "size", "lacks", "adds", "linked"])

    return ordered.mapInArrow(go, "node long, pivot long, size long, lacks binary, adds binary, linked boolean")


def _family_links(diffs: DataFrame) -> DataFrame:
    """Exploded cells ``(pivot, i, j, part, node, size, lacks, adds)``: unlinked members with all, pivot included."""
    empty = F.lit(b"")
    pivots = diffs.groupBy("pivot").agg(F.first("size").alias("size"), F.count_if("linked").alias("near"), F.count_if(~F.col("linked")).alias("far")).filter("far > 0")
    counts = pivots.select("pivot", F.ceil((F.col("near") + 1) / CHUNK).cast("int").alias("na"), F.ceil(F.col("far") / CHUNK).cast("int").alias("nb"))
    rows = diffs.unionByName(pivots.select(F.col("pivot").alias("node"), "pivot", "size", empty.alias("lacks"), empty.alias("adds"), F.lit(True).alias("linked")))
    rows = rows.join(counts, "pivot")
    spot = F.xxhash64("node")
    part = F.when(F.col("linked"), F.pmod(spot, F.col("na"))).otherwise(F.col("na") + F.pmod(spot, F.col("nb"))).cast("int")
    last = F.col("na") + F.col("nb") - 1
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.when(F.col("linked"), F.sequence("na", last)).otherwise(F.sequence(F.lit(0), last))))
    return rows.select("pivot", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "size", "lacks", "adds", "linked")


def _by_cell(cells: DataFrame, key: str, compare, schema: str) -> DataFrame:
    """Rows of each cell ``(key, i, j)`` to ``compare``, which returns one Arrow batch or None."""
    cells = cells.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in (key, "i", "j")])
            edges = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
            for s, e in zip([0, *edges], [*edges, b.num_rows], strict=True):
                here = tuple(keys[:, s].tolist())
                if here != at:
                    if held and (out := compare(pa.Table.from_batches(held))) is not None:
                        yield out
                    held, at = [], here
                held.append(b.slice(s, e - s))
        if held and (out := compare(pa.Table.from_batches(held))) is not None:
            yield out

    return cells.mapInArrow(go, schema)


def _common(values: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each row of ``left`` has in common with each of ``right``."""
    row = np.repeat(np.arange(len(values)), [len(v) for v in values])
    all_ = np.concatenate(values) if values else np.zeros(0, dtype=np.uint64)
    _, col, count = np.unique(all_, return_inverse=True, return_counts=True)
    shared = count > 1  # the others are in no intersection
    keep = shared[col] if len(col) else np.zeros(0, dtype=bool)
    place = np.cumsum(shared) - 1
    row, col = row[keep], place[col[keep]] if len(col) else col
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int(shared.sum()), 8192):
        here = (col >= at) & (col < at + 8192)
        grid = np.zeros((len(values), min(8192, int(shared.sum()) - at)), dtype=np.float32)
        grid[row[here], col[here] - at] = 1
        out += grid[left] @ grid[right].T
    return np.rint(out).astype(np.int64)


def _compare_family(like: Likeness):
    def compare(t: pa.Table) -> pa.RecordBatch | None:
        node, part, linked = (t.column(c).to_numpy() for c in ("node", "part", "linked"))
        i, j, size = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("size")[0].as_py()
        lacks, adds = ([np.frombuffer(v, dtype=np.uint64) for v in t.column(c).to_pylist()] for c in ("lacks", "adds"))
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        nl, na = np.array([len(v) for v in lacks]), np.array([len(v) for v in adds])
        us, vs = [], []
        for a in range(0, len(left), 2 * CHUNK):
            for b in range(0, len(right), 2 * CHUNK):
                x, y = left[a : a + 2 * CHUNK], right[b : b + 2 * CHUNK]
                pick = np.concatenate([x, y])
                mine, yours = np.arange(len(x)), np.arange(len(x), len(pick))
                both = _common([lacks[k] for k in pick], mine, yours)
                same = size - nl[x][:, None] - nl[y][None, :] + both + _common([adds[k] for k in pick], mine, yours)
                whole = (size - nl + na)[x][:, None] + (size - nl + na)[y][None, :] - same
                ok = (same > 0) & (100 * same >= like.percent * whole) & (node[x][:, None] != node[y][None, :])
                # All linked members are one: a row needs one of them only. Of the rest a spanning forest will do.
                root: dict[int, int] = {}
                for p, q in zip(*(k.tolist() for k in np.nonzero(ok)), strict=True):
                    u, v = int(node[x[p]]), int(node[y[q]])
                    ru, rv = (-1 if linked[k] else w for k, w in ((x[p], u), (y[q], v)))
                    while (up := root.get(ru, ru)) != ru:
                        ru = up
                    while (up := root.get(rv, rv)) != rv:
                        rv = up
                    if ru != rv:
                        root[ru] = rv
                        us.append(min(u, v))
                        vs.append(max(u, v))
        if us:
            return pa.RecordBatch.from_arrays([pa.array(us, type=pa.int64()), pa.array(vs, type=pa.int64())], names=["u", "v"])
        return None

    return compare


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of the edges ``(u, v)``: root is the smallest node it reaches."""
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        # Large star: larger neighbours of a node move to its smallest neighbour.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.filter("v > u"), least, "u", F.col("v"), "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Small star: smaller neighbours and the node itself move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, low, "u", F.col("v"), "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = materialize(small.filter("u <> v").distinct(), "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _proposals(members: DataFrame, live: DataFrame, like: Likeness, most: int | None) -> DataFrame:
    """``(u, v, cut)``: likely pairs of unconnected classes in shared buckets, the best ``most`` of each class.

    ``members`` has ``(band, node, family, comp, sig)``, ``live`` the size of
    each bucket. ``cut`` tells that a class had more pairs than it proposed.
    """
    parts = F.ceil(F.col("size") / CHUNK).cast("int")
    cells = salted_join(members, live, "band", F.col("node"), "inner").withColumn("part", F.when(parts > 1, F.pmod(F.xxhash64("node"), parts)).otherwise(0).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = cells.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "family", "comp", "sig")
    floor = like.least_agreeing

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        node, family, comp, part = (t.column(c).to_numpy() for c in ("node", "family", "comp", "part"))
        sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        us, vs, cuts = [], [], []
        for a in range(0, len(left), 2 * CHUNK):
            for b in range(0, len(right), 2 * CHUNK):
                x, y = left[a : a + 2 * CHUNK], right[b : b + 2 * CHUNK]
                agree = agreeing(sigs[x], sigs[y], like)
                done = (comp[x][:, None] == comp[y][None, :]) | (family[x][:, None] == family[y][None, :])
                agree[done | ((i == j) & (node[x][:, None] >= node[y][None, :]))] = -1
                good = agree >= floor
                cut = False
                if most is not None:
                    take = np.zeros_like(good)
                    for axis in (0, 1):
                        if agree.shape[axis] > most:
                            nth = -np.partition(-agree, most - 1, axis=axis).take([most - 1], axis=axis)
                            rank = np.cumsum((agree == nth) & good, axis=axis)
                            take |= good & ((agree > nth) | ((agree == nth) & (rank <= most)))
                        else:
                            take |= good
                    cut = bool((good & ~take).any())
                    good = take
                p, q = np.nonzero(good)
                us += np.minimum(node[x[p]], node[y[q]]).tolist()
                vs += np.maximum(node[x[p]], node[y[q]]).tolist()
                cuts += [cut] * len(p)
        if us:
            return pa.RecordBatch.from_arrays([pa.array(us, type=pa.int64()), pa.array(vs, type=pa.int64()), pa.array(cuts)], names=["u", "v", "cut"])
        return None

    return _by_cell(cells, "band", compare, "u long, v long, cut boolean").groupBy("u", "v").agg(F.max("cut").alias("cut"))


#: Ids from here on leave too little room above them for further numbers.
HIGH = 1 << 62


def _numbered(texts: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """``(doc_id, own, text)``, ``(own, doc_id)`` of texts that share their id ``own`` with another text, and what was taken off all ids.

    All but one of the texts of an id get numbers above all ids; where no id
    has two texts, nothing changes. If the largest id leaves no room above it,
    ``HIGH`` is taken off all ids first; then none may be below ``-HIGH``.
    """
    worded = texts.filter("doc_id IS NOT NULL").filter(WORDED).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    shared = materialize(worded.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high"), "shared")
    plain = texts.select("doc_id", F.col("doc_id").alias("own"), "text")
    if shared.isEmpty():
        return plain, None, 0
    top, least = texts.agg(F.max("doc_id"), F.min("doc_id")).first()
    shift = HIGH if top >= HIGH else 0
    if shift:
        if least < -HIGH:
            raise ValueError("ids at both ends of the range, some of them shared")
        down = lambda df, *cols: df.withColumns({c: F.col(c) - F.lit(HIGH) for c in cols})
        worded, shared, plain, top = down(worded, "doc_id"), down(shared, "doc_id"), down(plain, "doc_id", "own"), top - HIGH
    extra = worded.join(shared, "doc_id").filter("digest <> low").select("doc_id", "digest").distinct()
    extra = materialize(extra.select(F.col("doc_id").alias("own"), "digest", (F.lit(top + 1) + F.monotonically_increasing_id()).alias("number")), "numbers")
    named = plain.withColumn("digest", F.md5(F.col("text").cast("binary"))).drop("doc_id").join(extra, ["own", "digest"], "left")
    return named.select(F.coalesce("number", "own").alias("doc_id"), "own", "text"), extra.select("own", F.col("number").alias("doc_id")), shift


def near_duplicates(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row.

    Rows link if 100 times the common shingles are at least ``percent`` times
    all their shingles; ``component_id`` is the smallest id reachable over
    links, ``kept`` marks its row. Null texts and texts without words have no
    shingle, link with nothing and are kept. A row without id links with
    nothing, has no component and is kept. Rows that share an id are one
    document with the links of all of them. Equal rows are both returned. An
    empty table gives an empty result; other columns are not read. Texts of any
    length count whole, in slices bounded by bytes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts, twins, shift = _numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    features = materialize(_features(texts, like), "features")
    classes = features.filter("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = materialize(classes, "classes")
    spread = classes.select("node", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("node").alias("center"), F.max("node").alias("top")).filter("center < top").select("band", "center")
    members = materialize(salted_join(spread, shared, "band", F.col("node"), "inner"), "members")

    sigs = classes.groupBy("node").agg(F.first("sig").alias("sig"))

    # Families and what can be settled inside them.
    stars = members.filter("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct()
    families = connected(_pair_scores(stars, sigs, like))
    diffs = materialize(_differences(families, texts, like), "differences")
    inside = _by_cell(_family_links(diffs), "pivot", _compare_family(like), "u long, v long")
    links = diffs.filter("linked").select(F.col("pivot").alias("u"), F.col("node").alias("v")).unionByName(inside)
    if twins is not None:
        nodes = features.filter("doc_id IS NOT NULL").join(classes.select("set_id", "node"), "set_id").select("doc_id", "node").distinct()
        links = links.unionByName(twins.join(nodes.toDF("own", "u"), "own").join(nodes.toDF("doc_id", "v"), "doc_id").select("u", "v"))
    labels = connected(links)

    # Pairs of different families, in rounds over what is still unconnected.
    placed = materialize(members.select("band", "node").join(families, "node", "left").select("band", "node", F.coalesce("root", "node").alias("family")), "placed")
    for most in ROUNDS:
        named = placed.join(labels, "node", "left").select("band", "node", "family", F.coalesce("root", "node").alias("comp"))
        live = named.groupBy("band").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("family").alias("c"), F.max("family").alias("d"), F.count("*").alias("size")).filter("a < b AND c < d").select("band", "size")
        pairs = materialize(_proposals(named.join(sigs, "node"), live, like, most), "pairs")
        n, cut = pairs.agg(F.count("*"), F.max("cut")).first()
        if not n:
            break
        fresh = materialize(_linked(pairs.select("u", "v"), texts, like), "links")
        labels = connected(fresh.unionByName(labels.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        if not cut:
            break
    rows = features.select(F.col("own").alias("doc_id"), "set_id", "n_shingles").join(classes.select("set_id", "node"), "set_id", "left").join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node", "doc_id"))
    return rows.select((F.col("doc_id") + F.lit(shift)).alias("doc_id"), "n_shingles", (component + F.lit(shift)).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
