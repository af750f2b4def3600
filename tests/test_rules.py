"""Rules whose queries cannot show every case, on hand-made rows."""

import random
import re
import time

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import contracts, coverage, graph, intervals, quality, usage
from quern.sources import readers


def values(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_markup_to_any_depth(spark):
    texts = ["a{b}c", "{a{b{c{d{e{f}}}}}}x", "[a[b]]{c[d]}y", "{open", None, "", "{a}{b}", "x[{i}]y{"]
    assert values(spark, texts, T.strip_markup) == ["ac", "x", "y", "{open", None, "", "", "xy{"]
    masked = values(spark, texts, T.mask_markup)
    assert masked == ["a   c", " " * 18 + "x", " " * 12 + "y", "{open", None, "", " " * 6, "x     y{"]


def test_non_translatable(spark):
    yes = ["", " ", None, "{w}", "...", "a.png", "screenshot_final.png", "II", "iv", "+X", "%H:%M", "12/5", "my_long_label", "player_id", "A B C", "{b}[x]{/b}"]
    no = ["I", "snake_case", "Hello.", "word", "中文"]
    assert values(spark, yes, T.non_translatable) == [True] * len(yes)
    assert values(spark, no, T.non_translatable) == [False] * len(no)


def test_display_name(spark):
    assert values(spark, ["anna_happy", "anna_no_side", "old_man_sad_small", "anna_casual", " ", None], T.display_name) == ["Anna", "Anna", "Old Man", "Anna Casual", None, None]


def findings(spark, rows):
    return spark.createDataFrame(rows, "finding_id string, item_id string, file string, reason_code string, severity string, disposition string, source string, translation string, evidence array<string>")


def test_gate_and_filters(spark):
    rows = [
        ("1", "a", "Game\\\\Script.rpy".replace("\\\\", "\\"), "r1", "low", "warning", "Hello", "TEXT", ["x"]),
        ("2", "b", "game/xscript.rpy", "r2", "high", "warning", "bye", "t", ["Evid"]),
    ]
    f = findings(spark, rows)
    ids = lambda d: sorted(r.finding_id for r in d.collect())
    assert ids(quality.findings_filter(f, files=["script.rpy"])) == ["1"] and ids(quality.findings_filter(f, files=["SCRIPT"])) == ["1", "2"]
    assert ids(quality.findings_filter(f, text="hello")) == ["1"] and ids(quality.findings_filter(f, text="evid")) == ["2"] and ids(quality.findings_filter(f, text="r1")) == []
    assert ids(quality.findings_filter(f, items=["b"], min_severity="medium")) == ["2"]
    ack = lambda *x: spark.createDataFrame([(i,) for i in x] or [("none",)], "finding_id string")
    decision = lambda d, a: quality.gate(d, a).first().decision
    assert decision(f, ack("1")) == "needs_review" and decision(f, ack("1", "2")) == "acknowledged" and decision(f.limit(0), ack()) == "pass"
    blocked = f.union(findings(spark, [("3", "c", None, "r", "high", "blocker", None, None, [])]))
    assert quality.gate(blocked, ack("1", "2", "3")).first()[0:4] == (1, 2, 2, "needs_review")


def test_status(spark):
    s = coverage.STATES
    cases = [
        ({"in_pipeline": False}, s["unknown"]), ({"status": "x", "status_source": "manual", "active_batch": True}, "x"), ({"active_batch": True}, s["running"]),
        ({"archives": 2}, s["packed"]), ({"archives": 2, "scripts": 1}, s["untouched"]), ({"has_work": True, "has_original": True}, s["unextracted"]), ({"has_work": True}, s["untouched"]),
        ({"has_work": True, "translated_files": 1}, s["finished"]), ({"has_work": True, "translated_files": 1, "pending": 60, "percent": 96.0}, s["polish"]),
        ({"has_work": True, "translated_files": 1, "pending": 3, "percent": 1.0}, s["open"]), ({"has_work": True, "translated_files": 1, "pending": 50, "percent": 60.0}, s["open"]), ({"has_work": True, "translated_files": 1, "pending": 49}, s["polish"]),
    ]
    schema = "i int, in_pipeline boolean, status string, status_source string, active_batch boolean, has_work boolean, archives long, scripts long, translated_files long, has_original boolean, pending long, percent double"
    names = [x.split()[0] for x in schema.split(", ")][1:]
    df = spark.createDataFrame([(i, *[c.get(n) for n in names]) for i, (c, _) in enumerate(cases)], schema)
    assert [r[0] for r in df.orderBy("i").select(coverage.suggest_status(df)).collect()] == [want for _, want in cases]


def test_ancestry_of_long_chains_and_cycles(spark):
    rows = [(i, i - 1 if i else None) for i in range(150)] + [(201, 203), (202, 201), (203, 202), (210, 203), (300, 999), (301, 301)]
    got = {r.id: (r.root, r.depth, r.cycle) for r in graph.ancestry(spark.createDataFrame(rows, "id long, parent_id long")).collect()}
    assert all(got[i] == (0, i, False) for i in range(150))
    assert all(got[i] == (201, None, True) for i in (201, 202, 203, 210))
    assert got[300] == (300, 0, False) and got[301] == (301, None, True)


def test_scenes_without_a_file(spark):
    shape = "file string, first int, last int, people array<string>"
    targets = spark.createDataFrame([("t1", "f", 10, 12, ["a"]), ("t2", None, None, None, ["a", "b"])], "target_id string, " + shape)
    scenes = spark.createDataFrame([("s1", "f", 11, 20, ["b"]), ("s2", None, 1, 2, ["a"]), ("s3", "g", 1, 2, ["a", "b"])], "scene_id string, " + shape)
    got = {(r.target_id, r.scene_id): r.score for r in intervals.scene_scores(targets, scenes).collect()}
    assert got == {("t1", "s1"): 152, ("t1", "s2"): 8, ("t2", "s1"): 8, ("t2", "s2"): 8, ("t2", "s3"): 16}


def test_scenes_of_a_long_file_are_not_all_paired(spark):
    """Near scenes by blocks, far ones by people: the same ranks as all pairs, of a small part of their number."""
    rng = random.Random(3)
    people = lambda: rng.choice([None, [], ["a"], ["b"], ["a", "b"], ["b", "a"], ["c", None]])
    span = lambda: rng.choice([(x := rng.randrange(3000), x + rng.randrange(5)), (x, x + 500), (x, None), (x + 3, x), (None, None)])
    rows = lambda n, m: [(f"{n}{i:03}", rng.choice("fffg"), *(span() if rng.random() < 0.2 else (x := rng.randrange(3000), x + rng.randrange(9))), people()) for i in range(m)]
    ts, ss = rows("t", 150), rows("s", 300)
    shape = "file string, first int, last int, people array<string>"
    targets, scenes = spark.createDataFrame(ts, "target_id string, " + shape), spark.createDataFrame(ss, "scene_id string, " + shape)
    low = lambda *x: min(v for v in x if v is not None)
    want = set()
    for t, tf, t1, t2, tp in ts:
        scored = []
        for s, sf, s1, s2, sp in ss:
            if tf != sf:
                continue
            before = s2 is not None and t1 is not None and s2 < t1
            far = t1 - s2 if before else None if s1 is None or t2 is None else s1 - t2
            over = None not in (s1, s2, t1, t2) and s1 <= t2 and t1 <= s2
            near = 0 if s1 is None or t1 is None else 101 + low(s2, t2) - max(s1, t1) if over else max(0, 40 - low(far, 40))
            scored.append((-(50 + near + 8 * len({*(tp or [])} & {*(sp or [])})), s))
        want |= {(t, s, -score, k + 1) for k, (score, s) in enumerate(sorted(scored)[:3])}
    frame = intervals.scene_scores(targets, scenes)
    assert {tuple(r) for r in frame.collect()} == want and len(want) == 450


def test_few_files_do_not_bind_the_rules_to_few_tasks(spark):
    """One partition of subjects is judged by all cores; what each rule finds stays the same."""
    said = ["的OK 的cats", "walk的dog's 的", "的的Bob和 Al的", "x-的 ’a的", "oh的 OH, xoh ohx Hmm", "no", "", None]
    rows = spark.createDataFrame([(i, "oh hmm", t) for i, t in enumerate(said)], "item_id int, source string, translation string").coalesce(1)
    found = quality.find(rows)
    assert found.rdd.getNumPartitions() > 1
    got = {(r.item_id, r.reason_code.rsplit(".", 1)[1]): r.evidence for r in found.collect()}
    assert {k[0]: v for k, v in got.items() if k[1] == "english_suffix_adjacent"} == {0: ["cats"], 1: ["dog's"]}
    assert {k[0]: v for k, v in got.items() if k[1] == "cjk_latin_spacing"} == {0: ["cats"], 1: ["walk", "dog's"], 2: ["Bob", "Al"], 3: ["x-"], 4: ["oh"]}
    assert {k[0]: v for k, v in got.items() if k[1] == "interjection_untranslated"} == {4: ["hmm,oh"]}


def test_small_contracts(spark, tmp_path):
    rows = spark.createDataFrame([("k", "a", 1), ("k", "a", 3), ("k", "b", 2)], "k string, v string, n int")
    assert contracts.wide(rows, "k", "v", "n", ["a", "b"]).first()[0:3] == ("k", 3, 2)
    costs = spark.createDataFrame([("x", 1.0, "USD"), ("x", -5.0, "USD"), ("x", float("nan"), "USD"), ("x", None, "USD")], "g string, c double, u string")
    got = usage.cost_by_currency(costs, ["g"], "c", "u").first()
    assert (got.costs, got.known, got.unknown) == ({"USD": 1.0}, 1, 3)
    (tmp_path / "t.md").write_text("| a | b |\n|-|-|\n| 1 | 2 |\n| 3 | |\n")
    assert [tuple(r) for r in readers.markdown_table(spark, str(tmp_path / "t.md")).collect()] == [("1", "2"), ("3", "")]
    try:
        readers.markdown_table(spark, str(tmp_path / "t.md"), most=2)
        raise AssertionError("not refused")
    except ValueError:
        pass


def test_ledger_from_nothing_and_again(spark, tmp_path):
    from quern.streaming import ledger

    source, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    prepare = lambda d: d.select("dedupe_key", "n")
    for rows in ([("a", 1), ("b", 2), ("a", 1)], [("b", 2), ("c", 3)]):
        spark.createDataFrame(rows, "dedupe_key string, n int").coalesce(1).write.mode("append").parquet(source)
        ledger.ingest(spark.readStream.schema("dedupe_key string, n int").parquet(source), path, str(tmp_path / "cp"), prepare).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_invalidation_says_why(spark):
    records = spark.createDataFrame([("c1", "chunk"), ("c2", "chunk"), ("s1", "scene"), ("s2", "scene"), ("l1", "label"), ("r1", "route"), ("b", "brief")], "id string, kind string")
    links = spark.createDataFrame([("s1", "c1"), ("s1", "c1"), ("s1", "c2"), ("s2", "c9"), ("l1", "s1"), ("l1", "s2"), ("r1", "l1")], "id string, up string")
    changed = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r.id: (r.stale, r.cause, r.n_causes) for r in graph.invalidate(records, links, changed("c1", "c2", "l1")).collect()}
    assert got == {"c1": (True, "changed", 1), "c2": (True, "changed", 1), "s1": (True, "c1", 2), "s2": (False, None, 0), "l1": (True, "changed", 2), "r1": (True, "l1", 1), "b": (True, "any", 0)}
    assert not any(r.stale for r in graph.invalidate(records, links, changed("other")).collect())


def test_markup_of_many_signs_is_linear(spark):
    """A hundred thousand signs in one text; the rounds stop when nothing changes."""
    deep = "{" * 60 + "x" + "}" * 60
    texts = ["{" * 100_000, "{a}" * 33_000, "[" * 50_000 + "]" * 3, "}{" * 50_000, "a{b" + "[c]" * 5 + "}d", deep, "{a[b}c]", "{ {a} [b} ]", None, ""]
    started = time.perf_counter()
    masked, bare = values(spark, texts, T.mask_markup), values(spark, texts, T.strip_markup)
    assert time.perf_counter() - started < 60

    def rounds(text, blank):
        before = None
        while text is not None and before != text:
            before = text
            for pattern in (T.TAG, T.FIELD):
                text = re.sub(pattern, (lambda m: " " * len(m[0])) if blank else "", text)
        return text

    assert masked == [rounds(t, True) for t in texts] and bare == [rounds(t, False) for t in texts]
