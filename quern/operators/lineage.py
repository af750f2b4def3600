"""Digests carried up a tree of records, and what is stale when one of them changes.

A group's digest is made of the number and the sums of its members' digests:
sums need no order and no list, so that groups of any size are added up before
they are shuffled, and digests of parts can be added to digests of wholes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(*columns: str | Column) -> Column:
    """A digest of some columns; null differs from the empty string."""
    parts = [F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("-")) for c in columns]
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.md5(F.concat(*sized).cast("binary"))


def _halves(c: str) -> list[Column]:
    """The two halves of a digest as numbers."""
    return [F.conv(F.substring(c, at, 16), 16, 10).cast("decimal(38,0)") for at in (1, 17)]


def group_digest(rows: DataFrame, by: list[str], member: str = "digest") -> DataFrame:
    """``(by..., n, digest)``: one digest of each group's members, in any order; equal members count as often as they occur."""
    high, low = _halves(member)
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(high).alias("__high"), F.sum(low).alias("__low"))
    return sums.select(*by, "n", digest("n", "__high", "__low").alias("digest"))


def tree(leaves: DataFrame, levels: list[str], payload: list[str], key: str = "unit_id") -> dict[str, DataFrame]:
    """Digests of every level: ``{"unit": (key, levels..., digest), level: (levels from the top..., n, digest)}``.

    ``levels`` run from the top, as columns of ``leaves``. A node's digest is
    made of its children's: of units at the lowest level, of the level below
    else.
    """
    units = leaves.select(*levels, key, digest(key, *payload).alias("digest"))
    out, below = {"unit": units}, units
    for k in range(len(levels), 0, -1):
        below = group_digest(below, levels[:k])
        out[levels[k - 1]] = below
    return out


def stale(before: dict[str, DataFrame], after: dict[str, DataFrame], levels: list[str], key: str = "unit_id") -> DataFrame:
    """``(level, name, change)`` of every node whose digest is not as before: ``changed``, ``added`` or ``gone``.

    ``name`` joins a node's levels, and its key if it is a unit, by slashes.
    """
    parts = []
    for level in ("unit", *reversed(levels)):
        by = [*levels, key] if level == "unit" else levels[: levels.index(level) + 1]
        name = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
        # Nodes meet by a digest of their place, as null and empty have one name.
        a, b = (d[level].select(digest(*by).alias("place"), name.alias(f"name_{n}"), F.col("digest").alias(n)) for d, n in ((before, "a"), (after, "b")))
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
        parts.append(a.join(b, "place", "full_outer").select(F.lit(level).alias("level"), F.coalesce("name_a", "name_b").alias("name"), change.alias("change")).filter("change IS NOT NULL"))
    return reduce(lambda x, y: x.unionByName(y), parts)


def depends_on_stale(records: DataFrame, changed: DataFrame, level: str) -> DataFrame:
    """The ``records`` (with ``inputs``, an array of node names of ``level``) that have a changed input, with ``stale_inputs``."""
    bad = changed.filter(F.col("level") == level).select(F.col("name").alias("input")).distinct()
    hits = records.select("record_id", F.explode(F.array_distinct("inputs")).alias("input")).join(bad, "input").groupBy("record_id").agg(F.array_sort(F.collect_set("input")).alias("stale_inputs"))
    return records.join(hits, "record_id")
