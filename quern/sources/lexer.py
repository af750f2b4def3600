"""String literals of scripts by an automaton over ordered lines, and what is to be done with each.

The automaton carries an open literal from line to line. Long files are cut
into chunks: each chunk tells, for every kind of literal that may be open
before it, what is open behind it; these maps are chained along the file, and
then every chunk is read with what it really starts with. So no file is read
in one piece by one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import has_cjk, identity, non_translatable

from .scripts import character_names, unescape

#: Lines that one chunk of a file holds.
CHUNK = 1000
#: What may be open before a line: nothing, a literal in three quotes, one whose line ends with a backslash.
CODE, TRIPLE, DOUBLE_TRIPLE, SINGLE, DOUBLE = range(5)
KINDS = range(5)
_QUOTE = {TRIPLE: "'''", DOUBLE_TRIPLE: '"""', SINGLE: "'", DOUBLE: '"'}
_OPEN = re.compile(r"(?P<word>\w+)?(?P<quote>'''|\"\"\"|'|\")|\w+|#")
_PREFIX = re.compile(r"(?i)(r|u|b|f|br|rb|fr|rf)")
_BODY = {q: re.compile(rf"((?:[^\\{q[0]}]|\\.|{q[0]}(?!{q[0]}{q[0]}))*){q}" if len(q) == 3 else rf"((?:[^\\{q}]|\\.)*){q}", re.S) for q in _QUOTE.values()}
_TAIL = re.compile(r"(?:[^\\]|\\.)*\\", re.S)

#: What is told of a line, as bits.
TRANSLATE, OLD, VOICE, NEW, PASSED = (1 << k for k in range(5))

#: Of a literal, or of its piece in a chunk: where it is, what it says, and its line (flags, block and openings so far, the line above).
_PIECE = [
    ("path", pa.string()), ("at_line", pa.int64()), ("at", pa.int64()), ("end_line", pa.int64()), ("last", pa.int64()), ("prefix", pa.string()), ("quote", pa.string()), ("body", pa.string()), ("closed", pa.bool_()), ("code", pa.string()),
    ("flags", pa.int32()), ("is_translation", pa.bool_()), ("block", pa.string()), ("opening", pa.int64()), ("above", pa.string()),
]
#: Of a chunk of a long file: what is open behind it for each kind before it, and what its lines leave to the next one.
_MAPPED = [("path", pa.string()), ("part", pa.int64()), *[(n, pa.list_(pa.int64())) for n in ("kinds", "lines", "firsts")], ("translate", pa.bool_()), ("heads", pa.int64()), ("head", pa.string()), ("kept", pa.string())]
#: What a chunk really starts with, whether the file goes on behind it, and whether a literal is open at one of its ends.
_START = [("path", pa.string()), ("part", pa.int64()), ("kind", pa.int64()), ("open_line", pa.int64()), ("open_first", pa.int64()), ("block", pa.string()), ("opening", pa.int64()), ("above", pa.string()), ("is_translation", pa.bool_()), ("more", pa.bool_()), ("cut", pa.bool_())]
_SQL = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
#: Rows of literals that are handed on at a time.
_ROWS = 5000


def scan(text: str, kind: int) -> tuple[list[tuple], int]:
    """Pieces ``(first, last, opens, prefix, quote, body, closes)`` of literals in a line, and what is open behind it."""
    if kind == CODE and '"' not in text and "'" not in text:
        return [], CODE
    out, at = [], 0
    prefix, first, opens = "", 0, False
    while True:
        if kind == CODE:
            m = _OPEN.search(text, at)
            while m and not m["quote"] and m[0] != "#":
                m = _OPEN.search(text, m.end())
            if not m or m[0] == "#":
                return out, CODE
            word = m["word"] or ""
            prefix = word if _PREFIX.fullmatch(word) else ""
            kind = next(k for k, q in _QUOTE.items() if q == m["quote"])
            first, at, opens = m.start("quote") - len(prefix), m.end(), True
        quote = _QUOTE[kind]
        m = _BODY[quote].match(text, at) if text.find(quote, at) >= 0 else None
        if m:
            out.append((first, m.end(), opens, prefix, quote, m[1], True))
            at, kind, prefix, opens = m.end(), CODE, "", False
            continue
        rest = text[at:]
        if len(quote) == 3:
            out.append((first, len(text), opens, prefix, quote, rest + "\n", False))
            return out, kind
        if rest and _TAIL.fullmatch(rest):  # a backslash joins the next line
            out.append((first, len(text), opens, prefix, quote, rest[:-1], False))
            return out, kind
        out.append((first, len(text), opens, prefix, quote, rest, False))
        return out, CODE


def _step(state: tuple, n: int, text: str) -> tuple:
    """What is open behind a line, and where it opened; no place if it was open before the chunk."""
    pieces, kind = scan(text, state[0])
    if kind == CODE:
        return CODE, None, None
    return (kind, n, pieces[-1][0]) if pieces and pieces[-1][2] else (kind, *state[1:])


def _exits(texts: list[tuple[int, str]]) -> list[tuple]:
    """The state behind the lines for each kind that may be open before them.

    Where a kind comes to the state of another one, it goes on like that, so
    that most lines are read once and not once for each kind.
    """
    out, known = [], []
    for kind in KINDS:
        state, passed = (kind, None, None), []
        for at, (n, text) in enumerate(texts):
            state = _step(state, n, text)
            passed.append(state)
            same = next((k for k in known if k[at] == state), None)
            if same:
                passed += same[at + 1 :]
                state = same[-1]
                break
        known.append(passed)
        out.append(state)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple[int, str, int, str | None]]]]:
    """The first row of each chunk and its lines; rows come sorted."""
    key, row, held = None, None, []
    for b in batches:
        path, part, *line = (b.column(n).to_pylist() for n in ("path", "part", "line", "text", "flags", "head"))
        for i, new in enumerate(zip(path, part, strict=True)):
            if new != key:
                if held:
                    yield row, held
                key, row, held = new, {n: b.column(n)[i].as_py() for n in b.schema.names}, []
            held.append((line[0][i], line[1][i], line[2][i], line[3][i]))
    if held:
        yield row, held


def _table(fields: list, out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _batched(fields: list, rows: Iterator) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= _ROWS:
            yield _table(fields, out)
            out = []
    if out:
        yield _table(fields, out)


def _schema(fields: list) -> str:
    return ", ".join(f"{n} {_SQL[t]}" for n, t in fields)


def _placed(lines: DataFrame, chunk: int, flags: Column, head: Column) -> DataFrame:
    """Every string literal with its line: columns as in ``_PIECE``.

    ``flags`` and ``head`` tell of a line what ``inventory`` asks, ``head`` the
    name of the block that it opens. Texts are dealt once by file and chunk,
    and all that follows reads that exchange: the maps of chunks of long files,
    the literals inside of a chunk, and those that stand in several.
    """
    n = F.col("line").cast("long")
    dealt = lines.select("path", F.floor(F.col("line") / chunk).cast("long").alias("part"), n.alias("line"), F.coalesce("text", F.lit("")).alias("text"), flags.cast("int").alias("flags"), head.cast("string").alias("head")).repartition("path", "part")
    order = ("path", "part", "line")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for r, held in _chunks(batches):
                if r["part"] == 0 and len(held) < chunk:
                    continue  # the whole file
                heads = [h for *_, h in held if h is not None]
                # Behind a chunk that is not full there is none.
                ends = _exits([x[:2] for x in held]) if len(held) >= chunk else [(CODE, None, None)] * len(KINDS)
                kept = next((x[1] for x in reversed(held) if not x[2] & PASSED), None)
                yield r["path"], r["part"], *zip(*ends, strict=True), any(x[2] & TRANSLATE for x in held), len(heads), heads[-1] if heads else None, kept

        yield from _batched(_MAPPED, rows())

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            path, now, block, opening, above = None, (CODE, None, None), None, 0, None
            for b in batches:
                for r in b.to_pylist():
                    if r["path"] != path:
                        path, now, block, opening, above = r["path"], (CODE, None, None), None, 0, None
                    kind, line, first = (r[c][now[0]] for c in ("kinds", "lines", "firsts"))
                    yield path, r["part"], *now, block, opening, above, r["is_translation"], r["more"], now[0] != CODE or (r["more"] and kind != CODE)
                    now = (kind, line if line is not None or kind == CODE else now[1], first if line is not None or kind == CODE else now[2])
                    block, opening, above = r["head"] if r["heads"] else block, opening + r["heads"], above if r["kept"] is None else r["kept"]

        yield from _batched(_START, rows())

    mapped = dealt.sortWithinPartitions(*order).mapInArrow(maps, _schema(_MAPPED)).repartition("path")
    w = Window.partitionBy("path")
    mapped = mapped.withColumns({"is_translation": F.max("translate").over(w), "more": F.lead("part").over(w.orderBy("part")).isNotNull()})
    # Small: a row for each chunk of a file of several.
    starts = mapped.sortWithinPartitions("path", "part").mapInArrow(chain, _schema(_START))

    def read(whole: bool):
        def literals_of(r: dict, held: list) -> Iterator[list]:
            kind, opening, block, above = r["kind"] or CODE, r["opening"] or 0, r["block"], r["above"]
            translation = r["is_translation"] if r["is_translation"] is not None else any(x[2] & TRANSLATE for x in held)
            out = []
            if kind != CODE:
                out.append([r["path"], r["open_line"], r["open_first"], None, None, "", _QUOTE[kind], "", False, "", None, None, None, None, None])
            split = {0} if kind != CODE else set()
            for n, text, flags, head in held:
                if head is not None:
                    block, opening = head, opening + 1
                pieces, kind = scan(text, kind)
                for first, last, opens, prefix, quote, body, closes in pieces:
                    if opens:
                        # What a line above may quote stands in double quotes.
                        out.append([r["path"], n, first, n, last, prefix, quote, body, closes, text[:first], flags, translation, block, opening, above if above and '"' in above else None])
                    else:
                        out[-1][3], out[-1][4], out[-1][8] = n, last, closes
                        out[-1][7] += body
                if not flags & PASSED:
                    above = text
            if kind != CODE and r["more"]:
                split.add(len(out) - 1)
            return (x for k, x in enumerate(out) if (k in split) != whole)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batched(_PIECE, (x for r, held in _chunks(batches) if whole or r["cut"] for x in literals_of(r, held)))

        # An inner join would ask for other rows of the exchange, and have it made again; no line is below 0.
        rows = dealt.join(starts.hint("shuffle_hash"), ["path", "part"], "left")
        rows = rows if whole else rows.filter(F.col("cut") | (F.col("line") < 0))
        return rows.sortWithinPartitions(*order).mapInArrow(run, _schema(_PIECE))

    # The pieces of a literal that stands in several chunks, in the order of their lines.
    parts = read(False).groupBy("path", "at_line", "at").agg(
        F.max("end_line").alias("end_line"), F.max_by("last", "end_line").alias("last"), F.max("prefix").alias("prefix"), F.max("quote").alias("quote"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("end_line", "body"))), lambda p: p["body"]), "").alias("body"), F.max("closed").alias("closed"), F.max("code").alias("code"),
        *[F.max(c).alias(c) for c in ("flags", "is_translation", "block", "opening", "above")],
    )
    raw = F.lower("prefix").contains("r")
    rows = read(True).unionByName(parts).withColumnsRenamed({"at_line": "line", "at": "first"})
    return rows.withColumn("text", F.when(raw, F.col("body")).otherwise(unescape(F.col("body"))))


def literals(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(path, line, first, end_line, last, prefix, quote, body, text, closed, code)`` of every string literal.

    ``lines`` has ``path, line, text``, lines numbered from 0 without gaps; a
    null text is an empty line. ``first`` and ``last`` are offsets in code
    points, prefix and quotes included, ``last`` exclusive and in ``end_line``;
    ``code`` is what stands before the literal in its line. What follows a
    ``#`` is no literal. One that its line or file does not end is not
    ``closed``. ``text`` has escapes undone unless the prefix has an ``r``.
    """
    return _placed(lines, chunk, F.lit(0), F.lit(None)).select("path", "line", "first", "end_line", "last", "prefix", "quote", "body", "text", "closed", "code")


#: Words before a string that name no speaker.
NOT_SPEAKERS = (
    "_", "call", "default", "define", "elif", "else", "extend", "hide", "if", "image", "init", "jump", "label", "menu", "old", "python", "renpy", "return",
    "scene", "screen", "set", "show", "stop", "style", "text", "textbutton", "transform", "translate", "use", "voice", "while", "window", "with", "new", "play", "queue",
)
CLASSES = ("parse_error", "explicitly_excluded", "already_translated", "translatable", "unsupported", "unknown")


def speaker_of(code: Column) -> Column:
    """The first name before a string that can be a speaker's; none beside brackets or an assignment."""
    before = F.trim(F.element_at(F.split(code, ":"), -1))
    names = F.filter(F.regexp_extract_all(before, F.lit(r"[A-Za-z_]\w*"), F.lit(0)), lambda w: ~F.lower(w).isin(*NOT_SPEAKERS))
    return F.when(~before.rlike(r"[=()\[\]{}]"), F.get(names, F.lit(0)))


def wants_translation(text: Column) -> Column:
    """Untranslated text of more than a sign, a path or a small word."""
    plain = (F.length(text) > 1) & ~has_cjk(text) & ~non_translatable(text) & ~(~text.contains(" ") & text.rlike(r"[/\\]"))
    return F.coalesce(plain & (text.contains(" ") | (F.length(text) > 15) | text.rlike(r"^\p{Lu}")), F.lit(False))


def inventory(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per string literal of each script, with its class, block, index, source and speaker.

    Returns ``(path, line, first, end_line, last, prefix, quote, text,
    classification, block, occurrence, index, source, unit_id, speaker,
    speaker_name)``. A file with a ``translate`` line is a translation: there
    the source of a string is the commented or ``old`` string in the nearest
    line above that is neither empty nor a voice line. Strings that have such a
    source, or want translation, count: ``index`` numbers them in their block,
    from 1, and ``occurrence`` the openings of a block's name that have one.
    """
    t = F.trim(F.coalesce("text", F.lit("")))
    head = r"^\s*translate\s+\S+\s+([^\s:]+)\s*:"
    says_voice = (t == "voice") | t.startswith("voice ")
    passed = (t == "") | says_voice | t.rlike(r'^#\s*voice(\s[^"]*)?".*"$')
    told = {TRANSLATE: t.startswith("translate "), OLD: t.startswith("old "), VOICE: says_voice, NEW: t.startswith("new "), PASSED: passed}
    flags = reduce(lambda x, y: x + y, [F.when(c, bit).otherwise(0) for bit, c in told.items()])
    block = F.when(F.col("text").contains("translate") & F.col("text").rlike(head), F.regexp_extract("text", head, 1))
    rows = _placed(lines, chunk, flags, block).filter("path IS NOT NULL").withColumn("block", F.coalesce("block", F.lit("_global")))
    said = lambda bit: F.col("flags").bitwiseAND(bit) > 0
    marks = F.coalesce(*[F.when(F.col("above").rlike(p), F.regexp_extract("above", p, 1)) for p in (r'^\s*#\s*[^"]*?"(.*)"\s*$', r'^\s*old\s+"(.*)"\s*$')])
    rows = rows.withColumn("source", F.when(F.col("is_translation"), unescape(marks)))
    old = F.col("is_translation") & said(OLD)
    named = F.col("is_translation") & F.col("code").rlike(r"[A-Za-z_]\w*\s*=\s*$")
    shown = F.col("code").rlike(r"^\s*define\s+[A-Za-z_]\w*\s*=\s*Character\s*\(\s*(_\(\s*)?$")
    left_out = said(VOICE) | said(TRANSLATE) | old | named | shown
    # Each made once, as several columns read it.
    rows = rows.withColumns({"wanted": wants_translation(F.col("text")), "cjk": has_cjk(F.col("text")), "inert": non_translatable(F.col("text"))})
    wanted, cjk, inert = F.col("wanted"), F.col("cjk"), F.col("inert")
    kind = (
        F.when(~F.col("closed"), "parse_error")
        .when(left_out, "explicitly_excluded")
        .when(F.col("source").isNotNull() & cjk, "already_translated")
        .when(wanted, "translatable")
        .when(inert | cjk, "unsupported")
        .otherwise("unknown")
    )
    counts = F.col("closed") & ~left_out & (F.col("source").isNotNull() | wanted)
    # Known before the strings of a file meet, so that only what is asked for is moved.
    rows = rows.withColumns({"classification": kind, "counts": counts, "speaker": F.when(~said(NEW), speaker_of(F.col("code")))}).repartition("path")
    number = F.sum(F.when(F.col("counts"), 1).otherwise(0))
    rows = rows.withColumn("index", F.when(F.col("counts"), number.over(Window.partitionBy("path", "opening").orderBy("line", "first"))).cast("int"))
    which = F.dense_rank().over(Window.partitionBy("path", "block", "counts").orderBy("opening"))
    rows = rows.withColumn("occurrence", F.when(F.col("counts"), which))
    names = character_names(lines).withColumnRenamed("name", "speaker_name")
    rows = rows.join(names, "speaker", "left")
    source = F.when(F.col("counts"), F.coalesce("source", "text"))
    unit = F.when(F.col("counts"), identity(F.col("path"), F.col("block"), F.col("occurrence"), F.col("index"), source))
    return rows.select("path", "line", "first", "end_line", "last", "prefix", "quote", "text", "classification", "block", "occurrence", "index", source.alias("source"), unit.alias("unit_id"), "speaker", "speaker_name")


def pending_tasks(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The strings that are to be translated, with their ids, places and speakers."""
    return inventory(lines, chunk).filter("classification = 'translatable'").drop("classification")


def progress(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per file: literals, pending tasks, translated strings and parse errors."""
    n = lambda c: F.count_if(F.col("classification") == c)
    return inventory(lines, chunk).groupBy("path").agg(F.count("*").alias("candidates"), n("translatable").alias("pending"), n("already_translated").alias("translated"), n("parse_error").alias("parse_errors"))
