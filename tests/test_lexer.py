"""The lexer against a walk over each file, sign by sign."""

import random
from pathlib import Path

import pytest

from quern.plans import QUERIES
from quern.sources import lexer as L


def walk(lines):
    """Literals of a file: (line, first, end line, last, prefix, quote, body, closed)."""
    out, at, n = [], 0, 0
    while n < len(lines):
        text = lines[n]
        if at >= len(text) or text[at] == "#":
            n, at = n + 1, 0
            continue
        c = text[at]
        if c.isalnum() or c == "_":
            end = at
            while end < len(text) and (text[end].isalnum() or text[end] == "_"):
                end += 1
            word = text[at:end]
            if not (word.lower() in ("r", "u", "b", "f", "br", "rb", "fr", "rf") and end < len(text) and text[end] in "'\""):
                at = end
                continue
        elif c in "'\"":
            word = ""
        else:
            at += 1
            continue
        start, first = n, at
        at += len(word)
        quote = text[at] * 3 if text[at : at + 3] == text[at] * 3 else text[at]
        at, body, closed = at + len(quote), "", False
        last = None
        while True:
            text = lines[n]
            if at >= len(text):
                if len(quote) == 3 and n + 1 < len(lines):
                    body, n, at = body + "\n", n + 1, 0
                    continue
                body += "\n" if len(quote) == 3 else ""
                last = len(text)
                break
            if text[at : at + len(quote)] == quote:
                at += len(quote)
                closed, last = True, at
                break
            if text[at] == "\\" and at + 1 < len(text):
                body, at = body + text[at : at + 2], at + 2
            elif text[at] == "\\" and len(quote) == 1:
                if n + 1 < len(lines):
                    n, at = n + 1, 0
                else:
                    at += 1
            else:
                body, at = body + text[at], at + 1
        out.append((start, first, n, last, word, quote, body, closed))
        if not closed:
            n, at = n + 1, 0
    return out


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_against_a_walk(spark, chunk):
    rng = random.Random(chunk)
    signs = ["'''", '"""', '"', "'", "\\", "a", "é ", "#", "r", "f", "e ", "= ", "x.", "\\n", "猫", " "]
    files = {f"p{k}": ["".join(rng.choices(signs, k=rng.randrange(0, 9))) for _ in range(rng.randrange(1, 14))] for k in range(120)}
    rows = [(p, i, t, "z") for p, lines in files.items() for i, t in enumerate(lines)]
    rng.shuffle(rows)
    got = {}
    for r in L.literals(spark.createDataFrame(rows, "path string, line int, text string, body string"), chunk).collect():
        got.setdefault(r.path, []).append((r.line, r.first, r.end_line, r.last, r.prefix, r.quote, r.body, r.closed))
    assert {p: sorted(x) for p, x in got.items()} == {p: sorted(w) for p, lines in files.items() if (w := walk(lines))}


def test_classes_and_speakers(spark):
    lines = ['define e = Character("Eileen")', "translate zh start_1:", '    # e "Hello there."', '    voice "a.ogg"', '    e happy "猫 你好"', "", '    # "More text here."', '    "More text here."', '    old "Save game"', '    new ""', '    new "Save game"', '    e "open', '    e "x"', '    f(tag="value here")', '    e "a/b"', None]
    rows = L.inventory(spark.createDataFrame([("a", i, t) for i, t in enumerate(lines)], "path string, line int, text string")).orderBy("line").collect()
    assert [(r.line, r.classification) for r in rows] == [(0, "explicitly_excluded"), (3, "explicitly_excluded"), (4, "already_translated"), (7, "translatable"), (8, "explicitly_excluded"), (9, "unsupported"), (10, "translatable"), (11, "parse_error"), (12, "unknown"), (13, "explicitly_excluded"), (14, "unknown")]
    said = {r.line: r for r in rows}
    assert (said[4].source, said[4].speaker, said[4].speaker_name, said[4]["index"], said[4].occurrence, said[4].block) == ("Hello there.", "e", "Eileen", 1, 1, "start_1")
    assert (said[7]["index"], said[7].speaker) == (2, None) and L.inventory(spark.createDataFrame([], "path string, line int, text string")).count() == 0


def test_lines_are_read_once_for_all_that_may_be_open(monkeypatch):
    """The kinds that may be open before a chunk soon agree; from there on no line is read again."""
    lines = [(n, f"e 'said {n}' # \"no\"") for n in range(200)]
    want = []
    for kind in L.KINDS:
        state = (kind, None, None)
        for n, text in lines:
            state = L._step(state, n, text)
        want.append(state)
    read, scan = [], L.scan
    monkeypatch.setattr(L, "scan", lambda text, kind: read.append(kind) or scan(text, kind))
    assert L._exits(lines) == want
    # Literals in three quotes stay open to the end, all others agree.
    assert len(read) < 3 * len(lines) + 20


def test_texts_are_dealt_once(spark):
    """An inventory writes no table on the way; maps, whole and cut literals read one exchange of the texts."""
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    rng = random.Random(12)
    lines = ["translate zh b1:", '    # e "A longer text."', '    e "A longer text."', "    e '''open", "more", "end'''", '    menu "a \\', 'b c d"', "", '    voice "a.ogg"', '    old "Save"', '    new "猫"', 'define f = Character("Fay")', '    f "Said so."', '"""']
    rows = [(f"p{p}", i, t) for p in range(20) for i, t in enumerate(rng.choices(lines, k=rng.choice([1, 2, 3, 4, 9, 30])))]
    frame = spark.createDataFrame(rows, "path string, line int, text string")
    whole = L.inventory(frame, 1000)
    want = sorted(map(str, whole.collect()))
    for chunk in (1, 2, 3):
        got = L.inventory(frame, chunk)
        assert sorted(map(str, got.collect())) == want
    assert set(shared.iterdir()) == before
    tasks = L.pending_tasks(frame, 3).select("path", "line", "index")
    tasks.collect()
    plan = tasks._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") >= 2


def test_script_queries_write_no_tables(spark, small):
    """What the queries on scripts need beside their exchanges is small."""
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    assert QUERIES["script_inventory"](spark, small).count() > 0
    assert set(shared.iterdir()) == before
