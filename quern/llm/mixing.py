"""Operator 5: mixing sources to target weights by Sainte-Laguë apportionment.

The words of a source, its documents in a seeded order, form a tape that is
cut into blocks of equal size, to within a word. All blocks of the mix are seats: the sources win
them by highest quotients ``target / (2 k + 1)``. Highest-quotient seats keep
when the house grows, so the seats of shard ``s`` are those between the first
``s`` and ``s + 1`` shards' worth, integers that always add up. A source that
wins more seats than it has blocks repeats its whole tape and then takes the
rest by a seeded choice of distinct blocks. Its seats go to the shards in that
order: whole tapes along the tape, then the chosen blocks.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is repeated this often at most.
MAX_REPEATS = 3
#: Words of a block, about.
BLOCK_WORDS = 64
#: The recipe (one row per source) is held on the driver; more sources are refused.
MAX_SOURCES = 100_000
#: Shards of the query's mix.
SHARDS = 8
#: Documents of one tape segment; offsets are summed per segment, then inside it.
SEGMENT_ROWS = 2_000


_NEW = ("doc_id", "size", "source_size", "target", "taken", "passes")


@dataclass(frozen=True)
class Share:
    """What the recipe says about one source."""

    source: str | None
    rows: int
    size: int
    target: float
    blocks: int
    seats: int


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], cap: int = MAX_REPEATS) -> list[float]:
    """Share out ``sum(sizes)`` by weight; none gets over ``cap`` times its size, the excess is reshared."""
    left, open_ = float(sum(sizes)), [i for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(shares: list[float], house: int, most: list[int]) -> list[int]:
    """Seats by highest quotients ``share / (2 k + 1)``, at most ``most[i]`` each; ties go to the earlier."""
    house = min(house, sum(m for s, m in zip(shares, most, strict=True) if s > 0))
    if house <= 0:
        return [0] * len(shares)

    def won(floor: float) -> list[int]:
        return [min(m, int(math.floor((s / floor + 1) / 2))) if s > 0 else 0 for s, m in zip(shares, most, strict=True)]

    low, high = min(s for s in shares if s > 0) / (4.0 * max(house, max(most)) + 4), 2 * max(shares)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(won(mid)) > house:
            low = mid
        else:
            high = mid
    seats = won(high)
    while (missing := house - sum(seats)) > 0:  # quotients that tie at the last seats
        order = sorted((i for i in range(len(shares)) if shares[i] > 0 and seats[i] < most[i]), key=lambda i: (-shares[i] / (2 * seats[i] + 1), i))
        for i in order[:missing]:
            seats[i] += 1
    return seats


def shard_quotas(recipe: list[Share], shards: int) -> list[list[int]]:
    """Seats of each source in each shard; shards have equal seats, to within one, and sum to the recipe's."""
    house, most = sum(r.seats for r in recipe), [r.seats for r in recipe]
    upto = [sainte_lague([r.target / (r.size / r.blocks) if r.size else 0.0 for r in recipe], house * s // shards, most) for s in range(shards)] + [most]
    return [[b - a for a, b in zip(x, y, strict=True)] for x, y in zip(upto, upto[1:], strict=False)]


def make_recipe(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, cap: int = MAX_REPEATS) -> list[Share]:
    """One ``Share`` per source, in code-point order with null last."""
    totals = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], cap)
    blocks = [max(1, round(s / block_words)) for s in sizes]
    seats = sainte_lague([g / (s / b) if s else 0.0 for g, s, b in zip(goal, sizes, blocks, strict=True)], round(sum(g / (s / b) for g, s, b in zip(goal, sizes, blocks, strict=True) if s)), [cap * b for b in blocks])
    return [Share(r.source, r.rows, r["size"], g, b, q) for r, g, b, q in zip(totals, goal, blocks, seats, strict=True)]


def _shuffle(n: int, seed: int, name: str | None) -> tuple[int, int]:
    """``(a, b)`` drawn by seed and name such that ``j -> (a * j + b) mod n`` permutes the numbers below ``n``."""
    drawn = hashlib.sha256(f"{seed}:{name is None}:{name}".encode()).digest()
    a, b = int.from_bytes(drawn[:16], "big") % n, int.from_bytes(drawn[16:], "big") % n
    while math.gcd(a, n) != 1:
        a += 1
    return a, b


def by_shard(passes: str, shards: int) -> Column:
    """Words that each shard takes, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(F.filter(passes, lambda p: p["shard"] == s), F.lit(0).cast("long"), lambda a, p: a + (p["last"] - p["first"]) * p["times"]))


def mix(docs: DataFrame, recipe: list[Share] | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), shards: int = 1, **options) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, passes, *keep)`` of every row.

    ``passes`` lists the parts that the mix takes: ``(first, last, times,
    shard)`` word ranges of the document, last exclusive, in order, and how
    often the shard (from 0) has them. Each shard has its ``shard_quotas`` of
    every source's blocks; what is taken in all does not depend on ``shards``.
    ``taken`` is the words in the parts, repeats counted, never over three times ``size``. Null
    texts have size 0 and take nothing; the null source is a source of its
    own; rows that repeat are documents of their own, and rows of one id, or without
    an id, are in order of a hash of their texts. An empty table gives
    an empty result. Other columns are read only if named in ``keep``; one
    with the name of a returned column comes back as ``kept_<name>``. Texts of
    any length count whole.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(text_col)).alias("text_hash"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep])
    recipe = make_recipe(sized, **options) if recipe is None else recipe
    if shards < 1:
        raise ValueError("a mix has one shard at least")
    ends = list(accumulate(shard_quotas(recipe, shards)[:-1], lambda x, y: [a + b for a, b in zip(x, y, strict=True)]))
    schema = "at int, name string, source_size long, target double, blocks long, whole long, extra long, factor decimal(19,0), shift decimal(19,0), segments long, ends array<long>"
    table = spark.createDataFrame([(i, r.source, r.size, r.target, r.blocks, r.seats // r.blocks, r.seats % r.blocks, *map(Decimal, _shuffle(r.blocks, seed, r.source)), max(1, r.rows // SEGMENT_ROWS), [e[i] for e in ends]) for i, r in enumerate(recipe)], schema)
    # The recipe has MAX_SOURCES rows at most.
    rows = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name")), "left").drop("name", "source")
    # Rows without an id are in order of their texts; of one id, too.
    order = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(seed), F.col("doc_id"))).otherwise(F.col("text_hash"))
    rows = rows.withColumn("order", order).withColumn("segment", F.pmod(F.shiftright("order", 20), F.col("segments")))
    sums = rows.groupBy("at", "segment").agg(F.sum("size").alias("words"))
    sums = sums.select("at", "segment", (F.sum("words").over(Window.partitionBy("at").orderBy("segment")) - F.col("words")).alias("before"))
    inside = Window.partitionBy("at", "segment").orderBy("order", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(sums, ["at", "segment"])
    # The first `size % blocks` blocks of a source have one word more than the others; no product passes its size.
    rows = rows.withColumn("first", F.col("before") + F.col("inside")).withColumn("last", F.col("first") + F.col("size"))
    rows = rows.withColumn("each", F.expr("source_size div blocks")).withColumn("wide", F.expr("source_size % blocks"))
    block = "IF({0} < wide * (each + 1), {0} div (each + 1), wide + ({0} - wide * (each + 1)) div greatest(each, 1))".format
    parts = F.expr(
        f"""CASE WHEN size > 0 THEN transform(sequence({block("first")}, {block("(last - 1)")}),
             j -> transform(array(CAST(pmod(CAST(j AS DECIMAL(19,0)) * factor + shift, CAST(blocks AS DECIMAL(19,0))) AS BIGINT)), turn -> named_struct(
               'first', greatest(0, j * each + least(j, wide) - first),
               'last', least(size, (j + 1) * each + least(j + 1, wide) - first),
               'shards', transform(filter(sequence(0L, whole), t -> t < whole OR turn < extra),
                 t -> size(filter(ends, e -> e <= t * blocks + IF(t < whole, j, turn))))))[0])
           ELSE CAST(array() AS ARRAY<STRUCT<first: BIGINT, last: BIGINT, shards: ARRAY<INT>>>) END"""
    )
    rows = rows.withColumn("parts", F.filter(parts, lambda p: p["first"] < p["last"]))
    times = """flatten(transform(parts, p -> transform(array_distinct(p.shards), s -> named_struct(
             'first', p.first, 'last', p.last, 'times', CAST(size(filter(p.shards, x -> x = s)) AS BIGINT), 'shard', s))))"""
    rows = rows.withColumn("passes", F.expr(times))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + (p["last"] - p["first"]) * p["times"])
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "passes", *[F.col(f"`keep_{c}`").alias(f"kept_{c}" if c in _NEW else c) for c in keep])
