"""Scripts, readers and routes on small files."""

import pytest

from quern.functions import text as T
from quern.operators import graph, verbs
from quern.sources import readers, scripts

SCRIPT = """define e = Character("Eileen", color="#fff")
define m = Character(_("Me"))
define e = Character("Eileen B")
label start:
    e "Hi \\"you\\"" with dissolve
    e happy "two\\nlines"
    extend " and more"
    "narrated \\\\n kept"
    voice "a.ogg"
    show eileen
    m "ok"
    extend "again"
"""
TL = """# game/script.rpy:1
translate chinese start_1:

    # e "Hello"
    voice "x.ogg"
    e "你好"

translate chinese strings:

    old "Start"
    new "开始"

    old "..."
    new ""

translate chinese start_1:
    # "Bye"
    "Bye"
"""


def as_lines(spark, **files):
    return readers.lines(spark.createDataFrame([(k, v) for k, v in files.items()], "path string, content string").selectExpr("path", "encode(content, 'UTF-8') AS content"))


def test_names_and_dialogue(spark):
    rows = as_lines(spark, a=SCRIPT)
    assert {(r.speaker, r.name) for r in scripts.character_names(rows).collect()} == {("e", "Eileen B"), ("m", "Me")}
    said = [(r.speaker, r.text) for r in scripts.dialogue(rows).orderBy("line").collect()]
    assert said == [("e", 'Hi "you"'), ("e", "two\nlines"), ("e", " and more"), (None, "narrated \\n kept"), ("m", "ok"), ("m", "again")]


def test_pairs_units_and_classes(spark):
    rows = as_lines(spark, tl=TL)
    pairs = [(r.source, r.translation, r.form) for r in scripts.translation_pairs(rows).orderBy("line").collect()]
    assert pairs == [("Hello", "你好", "comment"), ("Start", "开始", "old_new"), ("...", "", "old_new"), ("Bye", "Bye", "comment")]
    found = scripts.units(rows).orderBy("line").collect()
    assert [(r.block, r.occurrence, r["index"], r.translated) for r in found] == [("start_1", 1, 0, True), ("strings", 1, 0, True), ("strings", 1, 1, False), ("start_1", 2, 0, False)]
    assert len({r.unit_id for r in found}) == 4
    classes = [r.classification for r in scripts.classify(scripts.units(rows), T.F.col("block") == "nothing").orderBy("line").collect()]
    assert classes == ["already_translated", "already_translated", "unsupported", "translatable"]
    count = scripts.line_counts(rows).first()
    assert (count.blocks, count.old_lines, count.new_lines, count.commented, count.translated_new) == (3, 2, 2, 2, 1)
    assert scripts.units(rows.limit(0)).count() == 0


def test_splice(spark):
    rows = as_lines(spark, a="say hello now\nkeep")
    edits = spark.createDataFrame([("a", 1, 4, 9, "你好"), ("a", 1, 10, 13, "later")], "path string, line int, first int, last int, replacement string")
    assert [r.text for r in scripts.splice(rows, edits).orderBy("line").collect()] == ["say 你好 later", "keep"]


def test_file_tree(spark, tmp_path):
    for name, text in (("script.rpy", "a\r\nb"), ("sub/x.rpy", "c"), ("tl/zh/y.rpy", "d"), ("sub/z.txt", "e")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text, newline="")
    tree = readers.file_tree(spark, str(tmp_path))
    assert {r.path for r in tree.collect()} == {"script.rpy", "sub/x.rpy"}
    assert {r.path for r in readers.file_tree(spark, str(tmp_path), prefixes=["sub/"]).collect()} == {"sub/x.rpy"}
    assert {r.path for r in readers.file_tree(spark, str(tmp_path), include=["tl/zh/y.rpy"], skip=()).collect()} == {"tl/zh/y.rpy"}
    assert [(r.line, r.text) for r in readers.lines(tree.filter("path = 'script.rpy'")).orderBy("line").collect()] == [(1, "a"), (2, "b")]


def test_jsonl(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"k": "a", "n": 1}\n\n{"k": "a", "n": 2}\n{"k": "b", "n": 3}\n')
    bad.write_text('{"k": "a", "n": 1}\n{"k": \n[1]\n')
    assert sorted(tuple(r) for r in readers.read_jsonl(spark, str(good), "k string, n int", key="k").collect()) == [("a", 2), ("b", 3)]
    assert [tuple(r) for r in readers.read_jsonl(spark, str(bad), "k string, n int").collect()] == [("a", 1)]
    assert sum(r._corrupt_record is not None for r in readers.read_jsonl(spark, str(bad), "k string, n int", policy="keep").collect()) >= 1
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        readers.read_jsonl(spark, str(bad), "k string, n int", policy="fail").collect()
    assert readers.is_complete(spark, str(good)) and not readers.is_complete(spark, str(bad))
    first, second = (readers.write_versioned(spark.range(2), str(tmp_path / "v")) for _ in range(2))
    assert first != second and spark.read.parquet(first).count() == 2


def test_routes(spark):
    nodes = spark.createDataFrame([("start",), ("a",), ("b",), ("end",), ("loop",)], "label string")
    edges = spark.createDataFrame([("start", "a", "jump", 1), ("start", "b", "jump", 2), ("a", "end", "jump", 3), ("b", "loop", "jump", 4), ("loop", "b", "jump", 5), ("a", "b", "call", 6)], "source string, target string, kind string, line int")
    got = [(r.entry, r.route, r.path, r.ends) for r in graph.routes(nodes, edges).orderBy("entry", "route").collect() if r.entry == "start"]
    assert got == [("start", 1, ["start", "a", "end"], "end"), ("start", 2, ["start", "b", "loop"], "cycle")]


def test_verbs_on_odd_rows(spark):
    rows = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 9, "z"), (None, 3, "n"), (1, None, "m"), (1, 5, "x")], "k int, at int, v string")
    other = spark.createDataFrame([(1, 2, "p"), (1, 5, "q"), (1, 5, "r"), (None, 1, "s"), (1, None, "t")], "k int, at int, w string")
    got = sorted((str(r.v), r.w) for r in verbs.as_of(rows, other, ["k"], "at", ["w"]).collect())
    assert got == [("m", None), ("n", None), ("x", "r"), ("x", "r"), ("y", None), ("z", None)]
    assert verbs.having(rows, other, ["k"]).count() == 4 and verbs.lacking(rows, other, ["k"]).count() == 2
    one = spark.createDataFrame([(["b", "a"], ["a", None, "c"]), (None, ["z"])], "x array<string>, y array<string>")
    assert [r[0] for r in one.select(verbs.merged_list(T.F.col("x"), T.F.col("y"))).collect()] == [["b", "a", "c"], ["z"]]
