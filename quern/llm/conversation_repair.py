"""Operator 11: repair of conversation structure by the cheapest edits.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Its
rows in order and the four places in that pattern make a graph whose arcs keep,
rerole, delete or insert a row. Minimum costs forward from the start and
backward from the end tell which arcs lie on a cheapest path (the tight ones);
from the start, the set of places that can be reached is moved along the tight
arcs of the least letter, step by step, which gives the least of the cheapest
edit strings.

Costs compose: rows are sorted over all tasks and cut into parts of at most
``PART_ROWS``. Only the conversations that are cut exchange 4 x 4 cost
matrices, boundary costs and boundary places; a conversation is never held
whole, however long. Equal rows of a turn are counted, not listed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, salted_join

#: Rows and characters of one part of a conversation.
PART_ROWS, PART_CHARS = 1000, 1 << 20
#: Places in the pattern: at the start, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
PLACES = (START, SYSTEM, USER, ASSISTANT)
#: What a repaired conversation may end with.
ENDS = (START, ASSISTANT)
#: The place that a user or assistant row leads to, from each place, and that row's role.
NEXT, ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 60

_WORD = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


class Row(NamedTuple):
    """A row and how many equal ones follow it; ``initial`` is its role's."""

    role: str
    text: str
    copies: int
    blank: bool
    repeated: bool
    truncated: bool

    @property
    def initial(self) -> str:
        return self.role[:1]

    @property
    def arcs(self) -> list[list[tuple[str, int, int]]]:
        """From each place: letter, cost and place of the row's edits. Equal rows that follow are deleted with it."""
        rest = DELETE * (self.copies - 1)
        out = []
        for place in PLACES:
            some = [("D", DELETE + rest, place)]
            if not (self.blank or self.repeated):
                stay = rest + TRUNCATED * self.truncated
                # Where a row is kept that is what the place asks for.
                if self.initial == "s" and place == START:
                    some.append(("K", stay, SYSTEM))
                elif self.initial == ROLE[place][0]:
                    some.append(("K", stay, NEXT[place]))
                some.append(("R", stay + REROLE, NEXT[place]))
            out.append(some)
        return out


def _inserted(cost: list[int]) -> list[int]:
    """Forward costs with inserts before a row: two in a row reach every place that inserts reach."""
    for _ in range(2):
        for place in PLACES:
            cost[NEXT[place]] = min(cost[NEXT[place]], cost[place] + INSERT)
    return cost


def _inserted_back(cost: list[int]) -> list[int]:
    """Backward costs with inserts before a row."""
    for _ in range(2):
        for place in PLACES:
            cost[place] = min(cost[place], INSERT + cost[NEXT[place]])
    return cost


#: Costs from each place to an end behind the last row.
FINAL = _inserted_back([0 if place in ENDS else NEVER for place in PLACES])
FIRST = [0, NEVER, NEVER, NEVER]


def forward(rows: list[Row], start: list[int]) -> list[list[int]]:
    """Least costs to every place before each row, inserts included, and without them behind the last."""
    out, now = [], list(start)
    for row in rows:
        now = _inserted(now)
        out.append(now)
        then = [NEVER] * 4
        for place, some in zip(PLACES, row.arcs, strict=True):
            for _, cost, to in some:
                then[to] = min(then[to], now[place] + cost)
        now = then
    return [*out, now]


def backward(rows: list[Row], end: list[int]) -> list[list[int]]:
    """Least costs from every place before each row and behind the last one, to the end."""
    out, now = [list(end)], end
    for row in reversed(rows):
        now = _inserted_back([min(cost + now[to] for _, cost, to in some) for some in row.arcs])
        out.append(now)
    return out[::-1]


def matrix(rows: list[Row]) -> list[int]:
    """Least costs from each place before the rows to each place behind them, row by row of 4 x 4."""
    return [c for place in PLACES for c in forward(rows, [0 if p == place else NEVER for p in PLACES])[-1]]


def walk(rows: list[Row], before: list[list[int]], after: list[list[int]], place: int, last: bool) -> tuple[str, list[tuple[str, str]], int]:
    """Letters, repaired turns and final place of the least cheapest path from ``place``.

    An arc is tight if the costs before and after it and its own make the least
    of all. A part that is not the last stops behind its last row: what is
    inserted there belongs to the next one.
    """
    total = min(a + b for a, b in zip(before[0], after[0], strict=True))
    if last:
        before = [*before[:-1], _inserted(list(before[-1]))]
    frontier, i, letters, turns = {place}, 0, [], []
    while i < len(rows) or last:
        if i == len(rows) and any(p in ENDS and before[i][p] == total for p in frontier):
            break
        tight: dict[str, set[int]] = {}
        for p in frontier:
            if before[i][p] + INSERT + after[i][NEXT[p]] == total:
                tight.setdefault("I", set()).add(NEXT[p])
            if i < len(rows):
                for letter, cost, to in rows[i].arcs[p]:
                    if before[i][p] + cost + after[i + 1][to] == total:
                        tight.setdefault(letter, set()).add(to)
        letter = min(tight)
        letters.append(letter)
        if letter == "I":
            turns.append((ROLE[min(frontier)], ""))
        else:
            if letter == "K":
                turns.append((rows[i].role, rows[i].text))
            elif letter == "R":
                turns.append((ROLE[min(frontier)], rows[i].text))
            letters.append("D" * (rows[i].copies - 1))
            i += 1
        frontier = tight[letter]
    return "".join(letters), turns, min(frontier)


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "n_turns")
_PART = pa.schema([
    ("key", pa.string()), ("part", pa.int64()), ("alone", pa.bool_()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("repeated", pa.list_(pa.bool_())),
    ("costs", pa.list_(pa.int64())), *((c, pa.int64()) for c in _COUNTS), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()),
])
_PART_DDL = "key string, part long, alone boolean, roles array<string>, texts array<string>, copies array<long>, repeated array<boolean>, costs array<long>, " + ", ".join(f"{c} long" for c in _COUNTS) + ", first_turn long, last_turn long, first_role string, last_role string"


def _rows(roles: list[str], texts: list[str], copies: list[int], repeated: list[bool]) -> list[Row]:
    return [Row(r, t, n, not _WORD.search(t), again, not _LAST.search(t)) for r, t, n, again in zip(roles, texts, copies, repeated, strict=True)]


def _pack(batches: Iterator[pa.RecordBatch], part_rows: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to parts. A conversation is ``alone`` in its part if it surely has no other."""
    at = TaskContext.get().partitionId() << 40
    held: list[dict] = []  # of one part
    done: list[dict] = []
    state = {"parts": 0, "first": True}  # parts of the conversation so far; whether it is the task's first

    def close(ends: bool) -> None:
        nonlocal at, held
        roles, texts, copies, again, turns = ([r[c] for r in held] for c in ("role", "text", "n", "repeated", "turn"))
        rows = _rows(roles, texts, copies, again)
        seen = [t for t in turns if t is not None]
        alone = ends and not state["parts"] and not state["first"]
        done.append({
            "key": held[0]["key"], "part": at, "alone": alone, "roles": roles, "texts": texts, "copies": copies, "repeated": again, "costs": None if alone else matrix(rows),
            "blank": sum(r.copies for r in rows if r.blank), "duplicate": sum(r.copies - (not r.repeated) for r in rows if not r.blank), "truncated": sum(r.truncated and not r.blank and not r.repeated for r in rows),
            "illegal": sum(r.copies - 1 for r in rows) + sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
            "n_turns": len(set(seen)), "first_turn": seen[0] if seen else None, "last_turn": seen[-1] if seen else None, "first_role": rows[0].initial, "last_role": rows[-1].initial,
        })
        at += 1
        state["parts"] += 1
        held = []

    chars = 0
    for b in batches:
        for r in b.to_pylist():
            if held and r["key"] != held[0]["key"]:
                close(True)
                state["parts"], state["first"], chars = 0, False, 0
            elif held and (len(held) >= part_rows or chars >= PART_CHARS):
                close(False)
                chars = 0
            held.append(r)
            chars += len(r["text"])
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_PART)
            done.clear()
    if held:
        close(False)
        yield pa.RecordBatch.from_pylist(done, schema=_PART)


def _streamed(slim: DataFrame, order, state, step, schema: str) -> DataFrame:
    """Rows of each ``key`` in order through ``step(state, row) -> (state, values)``; the state is all that is held."""
    names = [f.split()[0] for f in schema.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["key"] != key:
                    key, now = r["key"], state()
                now, values = step(now, r)
                out.append(dict(zip(names, values, strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "string": pa.string()}
    arrow = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, schema.split(", "), strict=True)])
    return slim.repartition("key").sortWithinPartitions("key", order).mapInArrow(go, schema)


def _bounds(parts: DataFrame) -> DataFrame:
    """``(part, first, last, before, after, place)`` of the parts of conversations that may be cut.

    ``before`` are the least costs to each place before the part, ``after``
    those from each place behind it, ``place`` is where the path enters.
    """
    cut = parts.filter("NOT alone")

    def ahead(now, r):
        into = now if now is not None else FIRST
        costs = [min(into[p] + r["costs"][4 * p + q] for p in PLACES) for q in PLACES]
        return [min(c, NEVER) for c in costs], (r["part"], into, now is None)

    def back(now, r):
        rest = now if now is not None else FINAL
        # The matrix has the inserts before each row, so those before the first as well.
        costs = [min(r["costs"][4 * p + q] + rest[q] for q in PLACES) for p in PLACES]
        return [min(c, NEVER) for c in costs], (r["part"], rest, now is None)

    slim = cut.select("key", "part", "costs")
    before = _streamed(slim, "part", lambda: None, ahead, "part long, before array<long>, first boolean")
    after = _streamed(slim, F.desc("part"), lambda: None, back, "part long, after array<long>, last boolean")
    both = materialize(before.join(after, "part"), "bounds")

    # Where each place before a part leads to, so that the places at the borders can be told in order.
    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                rows = _rows(r["roles"], r["texts"], r["copies"], r["repeated"])
                f, g = forward(rows, r["before"]), backward(rows, r["after"])
                total = min(x + y for x, y in zip(f[0], g[0], strict=True))
                ends = [walk(rows, f, g, p, r["last"])[2] if r["before"][p] + g[0][p] == total else -1 for p in PLACES]
                out.append({"key": r["key"], "part": r["part"], "leads": ends})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("part", pa.int64()), ("leads", pa.list_(pa.int64()))]))

    led = cut.join(both, "part").select("key", "part", "roles", "texts", "copies", "repeated", "before", "after", "last").mapInArrow(leads, "key string, part long, leads array<long>")
    place = _streamed(led, "part", lambda: START, lambda now, r: (r["leads"][now], (r["part"], now)), "part long, place long")
    return both.join(place, "part")


def repair(turns: DataFrame, conv_col: str = "conv_id", part_rows: int = PART_ROWS) -> DataFrame:
    """Conversations in parts, each with its edits and repaired turns.

    ``turns`` has ``conv_id, turn, role, text``; other columns are not read.
    Nulls in role and text count as one space, a null ``conv_id`` is a
    conversation of its own. Rows are taken by turn, nulls first, those of a
    turn by role and then by a hash of the text; equal rows all count. A row is
    blank without a visible character, else duplicate if its role and text came
    before, else truncated unless it ends with ``.``, ``!`` or ``?``.

    Returns ``(key, part, alone, letters, turns, cost, blank, duplicate,
    truncated, illegal, n_turns, first_turn, last_turn, first_role,
    last_role)``: ``key`` is ``=conv_id`` or empty, parts are in order of
    ``part``, ``letters`` are the edits (Delete, Insert, Keep, Rerole),
    ``turns`` what they leave, as ``(role, text)``. ``illegal`` counts pairs
    inside the part, ``n_turns`` distinct turns; ``alone`` parts are whole
    conversations. An empty table gives an empty result.
    """
    spark = turns.sparkSession
    bound_batches(spark)
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(key.alias("key"), F.col("turn").cast("long").alias("turn"), some("role").alias("role"), some("text").alias("text"))
    rows = rows.groupBy("key", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("same", F.md5(F.concat(F.md5(F.col("key").cast("binary")), F.md5(F.col("role").cast("binary")), F.col("digest")).cast("binary")))
    rows = materialize(rows, "turns")
    firsts = rows.groupBy("same").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    marked = salted_join(rows, firsts, "same", F.col("turn"))
    marked = marked.select("key", "turn", "role", "digest", "text", "n", F.coalesce(~F.col("first.turn").eqNullSafe(F.col("turn")) & F.col("first").isNotNull(), F.lit(False)).alias("repeated"))
    order = ("key", "turn", "role", "digest")
    ordered = materialize(marked, "marked").repartitionByRange(*order).sortWithinPartitions(*order).drop("digest")
    parts = materialize(ordered.mapInArrow(lambda batches: _pack(batches, part_rows), _PART_DDL), "parts")
    bounds = materialize(_bounds(parts), "bounds")
    kept = ("key", "part", "alone", *_COUNTS, "first_turn", "last_turn", "first_role", "last_role")
    joined = parts.join(bounds.drop("first"), "part", "left").select(*kept, "roles", "texts", "copies", "repeated", "before", "after", "last", "place")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for b in batches:
            letters, said, costs = [], [], []
            for r in b.to_pylist():
                rows = _rows(r["roles"], r["texts"], r["copies"], r["repeated"])
                last = r["alone"] or r["last"]
                f, g = forward(rows, r["before"] or FIRST), backward(rows, FINAL if last else r["after"])
                edits, left, _ = walk(rows, f, g, r["place"] or START, last)
                letters.append(edits)
                said.append([{"role": role, "text": text} for role, text in left])
                costs.append(min(x + y for x, y in zip(f[0], g[0], strict=True)))
            new = [pa.array(letters, type=pa.string()), pa.array(said, type=turn), pa.array(costs, type=pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], names=[*kept, "letters", "turns", "cost"])

    fields = "key string, part long, alone boolean, " + ", ".join(f"{c} long" for c in _COUNTS) + ", first_turn long, last_turn long, first_role string, last_role string"
    return joined.mapInArrow(mend, fields + ", letters string, turns array<struct<role: string, text: string>>, cost long")


class _Sum:
    """A conversation's numbers, from its parts in order."""

    def __init__(self):
        self.audit, self.hash, self.turns = [], hashlib.sha256(), 0
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.role = None
        self.cost = 0

    def add(self, r: dict) -> None:
        self.audit.append(r["letters"])
        for turn in r["turns"]:
            self.hash.update((("\n" if self.turns else "") + turn["role"] + ":" + turn["text"]).encode("utf-8", "replace"))
            self.turns += 1
        for c in _COUNTS:
            self.counts[c] += r[c]
        if r["first_turn"] is not None:
            self.counts["n_turns"] -= self.high == r["first_turn"]
            self.low = r["first_turn"] if self.low is None else self.low
            self.high = r["last_turn"]
        if self.role is not None:
            self.counts["illegal"] += self.role + r["first_role"] not in ("su", "ua", "au")
        self.role, self.cost = r["last_role"], r["cost"]

    def row(self, key: str) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["n_turns"]
        return {"key": key, "gaps": gaps, **{c: self.counts[c] for c in _COUNTS[:4]}, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


_DIGEST = pa.schema([("key", pa.string()), ("gaps", pa.int64()), *((c, pa.int64()) for c in _COUNTS[:4]), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def digest(parts: DataFrame) -> DataFrame:
    """``(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of each conversation.

    Parts that are alone stay where they are; of others the parts of a
    conversation stream through one task, in order, as their hash demands.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if now is None or r["key"] != key:
                    if now is not None:
                        out.append(now.row(key))
                    key, now = r["key"], _Sum()
                now.add(r)
            yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row(key)], schema=_DIGEST)

    schema = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    cut = parts.filter("NOT alone").repartition("key").sortWithinPartitions("key", "part")
    return parts.filter("alone").mapInArrow(go, schema).unionByName(cut.mapInArrow(go, schema))


def damaged(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults by ``crc32(conv_id:turn) % 20``; nulls count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    said = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def repaired(turns: DataFrame) -> DataFrame:
    """The query's rows: every conversation of ``turns`` with its numbers after ``damaged``; without rows left, zeros and empty strings' hashes."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    all_ = turns.select("conv_id").distinct().withColumn("key", key)
    found = all_.join(digest(repair(damaged(turns))), "key", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
