import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quern.llm import conversation_repair as R

TURNS = "conv_id long, turn long, role string, text string, key string, part long, letters string"


def brute(rows):
    """Costs, letters and text of the cheapest edits, place by place; faults counted."""
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    best, seen, before = {"": (0, "", ())}, set(), None
    role_of = {"": "user", "s": "user", "u": "assistant", "a": "user"}

    def inserts(now):
        for _ in range(3):
            for place, (cost, letters, said) in list(now.items()):
                role = role_of[place]
                new = (cost + 2, letters + "I", (*said, role + ":"))
                if role[0] not in now or new < now[role[0]]:
                    now[role[0]] = new
        return now

    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        again = (role, text) in seen
        seen.add((role, text))
        torn = not blank and not again and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
        counts["blank"] += blank
        counts["duplicate"] += again and not blank
        counts["truncated"] += torn
        if before is not None:
            counts["illegal"] += before + role[:1] not in ("su", "ua", "au")
        before, then = role[:1], {}
        for place, (cost, letters, said) in inserts(best).items():
            some = [(place, (cost + 3, letters + "D", said))]
            if not blank and not again:
                want = role_of[place]
                if role[:1] == want[0] or (place == "" and role[:1] == "s"):
                    some.append((role[:1], (cost + torn, letters + "K", (*said, f"{role}:{text}"))))
                some.append((want[0], (cost + 2 + torn, letters + "R", (*said, f"{want}:{text}"))))
            for to, new in some:
                if to not in then or new < then[to]:
                    then[to] = new
        best = then
    cost, letters, said = min(x for place, x in inserts(best).items() if place in ("", "a"))
    return counts, cost, letters, hashlib.sha256("\n".join(said).encode()).hexdigest()


def expected(rows, damage=False):
    groups, all_ = defaultdict(list), {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        groups[conv] += [(turn, "user" if h == 4 else role, text)] * (1 + (h == 3))
    out = {}
    for conv in all_ if damage else groups:
        some = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in some if t is not None]
        counts, cost, letters, digest = brute([(r, t) for _, r, t in some])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), cost, letters, digest)
    return out


def table(seed, convs, size):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", "  ", "Why?\n", "Ok!", "a b. ", None, "ünï.", "Long " * 300]
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(1, size)):
            for _ in range(rng.choice([1, 1, 1, 1, 2, 0])):
                text = rng.choice(texts) if rng.random() < 0.3 else f"Said {turn} {rng.random():.3f}{rng.choice(['.', '', '!'])}"
                rows.append((conv, rng.choice([turn, turn, turn, turn, None, turn + 5]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, "x") for r in rows], TURNS)


@pytest.mark.parametrize("part_rows", [3, 1000])
def test_against_all_paths(spark, part_rows):
    rows = table(part_rows, [*range(40), -3, None], 14)
    got = R.digest(R.repair(frame(spark, rows), part_rows=part_rows)).collect()
    keys = {("" if c is None else f"={c}"): x for c, x in expected(rows).items()}
    assert {r.key: tuple(r[1:]) for r in got} == keys


def test_long_conversation_in_parts(spark):
    """One conversation holds most rows, and is cut over tasks; one row repeats two thousand times."""
    rows = table(1, [5] * 4, 1500) + table(2, range(6, 12), 6) + [(5, 700, "user", "again and again.")] * 2000
    parts = R.repair(frame(spark, rows), part_rows=50)
    got = {r.key: tuple(r[1:]) for r in R.digest(parts).collect()}
    assert got == {f"={c}": x for c, x in expected(rows).items()}
    assert parts.filter("key = '=5'").count() > 40


def test_turns_are_the_repaired_ones(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "user", "Well?"), (1, 3, "assistant", "Yes")]
    part = R.repair(frame(spark, rows)).first()
    # Deleting the first user row costs more than to insert an answer behind it.
    assert (part.letters, part.cost) == ("KKIKK", 3) and [t.text for t in part.turns] == ["Be kind.", "Hello.", "", "Well?", "Yes"]
    assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in part.turns)) and part.cost == brute([r[2:] for r in rows])[1]


def test_query_with_damage(spark):
    rows = table(9, [*range(60), None], 9)
    got = {r.conv_id: tuple(r[1:]) for r in R.repaired(frame(spark, rows)).collect()}
    assert got == expected(rows, damage=True)


def test_empty_table(spark):
    assert R.repaired(frame(spark, [(1, 1, "user", "x")]).limit(0)).collect() == []
    # All rows of a conversation are dropped.
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert tuple(R.repaired(frame(spark, [(gone, 0, "user", "Hi.")])).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
