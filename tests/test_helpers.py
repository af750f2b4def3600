"""Small functions and operators that no query shows in full, on hand-made rows."""

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import intervals, keywords, quality, usage, versions
from quern.operators import records as R
from quern.sources import readers, scripts


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(f(F.col("x"))).collect()]


def test_texts(spark):
    both = spark.createDataFrame([("a b", "x"), ("a  b", "a b"), ("", "x"), (None, "x"), ("x", " ")], "s string, t string")
    assert [r[0] for r in both.select(T.indexable(F.col("s"), F.col("t"))).collect()] == [True, False, False, None, False]
    assert column(spark, ["cat and dog", "cats", "a cat's", "x-cat", None], lambda c: F.regexp_like(c, T.word_pattern(F.lit("cat")))) == [True, False, False, False, None]
    assert column(spark, ["f(x)+", "f(x)+y"], lambda c: F.regexp_like(c, T.word_pattern(F.lit("f(x)+")))) == [True, False]
    assert column(spark, ["aXb", None], lambda c: T.replace_terms(c, [("X", "Y"), ("Y", "ZZ")])) == ["aZZb", None]
    assert column(spark, ["./a//b/", "a\\b/./c", "../x", "a/../b", "/a/", None], T.normalise_path) == ["a/b", "a/b/c", None, None, "a", None]
    assert column(spark, [0.5, -1.0, 7.0, float("nan"), None], T.clamp_confidence, "double") == [0.5, 0.0, 1.0, 0.0, 0.0]
    assert column(spark, ["a/b", "ab", "a", "c/d/e"], lambda c: readers.path_prefix(c, ["a/", "c/d"])) == [True, False, True, True]
    keys = spark.createDataFrame([("a", None), ("a", ""), (None, "a"), ("a", None)], "x string, y string").select(usage.dedupe_key(F.col("x"), F.col("y"))).collect()
    assert len({r[0] for r in keys}) == 3


def test_scripts(spark):
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(["translate zh a:", '    # e "x"', '    e "y"', "    old \"a\"", '    new ""', '    new "b"'])], "path string, line int, text string")
    assert tuple(scripts.line_counts(lines).first()) == ("f", 1, 1, 2, 1, 1)
    edits = spark.createDataFrame([("f", 2, 7, 8, "long text"), ("f", 2, 4, 5, "Eileen"), ("f", 1, 0, 0, ">")], "path string, line int, first int, last int, replacement string")
    out = {r.line: r.text for r in scripts.splice(lines, edits).collect()}
    assert (out[2], out[1], out[0]) == ('    Eileen "long text"', '>    # e "x"', "translate zh a:")


def test_quality_rules(spark):
    rows = spark.createDataFrame([("1", "Hello Guard", "你好 Guard 坏", "Guard"), ("2", "Hello", "你好 bad", None), ("3", "no", "没有", "Guard")], "item_id string, source string, translation string, speaker_name string")
    policy = quality.Policy(garbled=("坏", "bad"))
    found = {(r.item_id, r.reason_code) for r in quality.find(rows, policy).collect()}
    assert {("1", "quality.garbled.known_bad_phrase"), ("2", "quality.garbled.known_bad_phrase"), ("1", "quality.speaker.label_untranslated")} <= found
    own = {"quality.own.no_digits": lambda s, p: F.regexp_extract_all(s["source"], F.lit("o+"), F.lit(0))}
    assert {(r.item_id, tuple(r.evidence)) for r in quality.find(rows, policy, own).collect()} == {("1", ("o",)), ("2", ("o",)), ("3", ("o",))}
    glossary = spark.createDataFrame([("Guard", "卫兵"), ("Hello", "你好")], "term string, target string")
    assert {tuple(r) for r in quality.glossary_not_applied(rows, glossary).collect()} == {("1", "Guard", "卫兵")}


def test_versions_and_journal(spark):
    items = spark.createDataFrame([("matched", "b1", "t1", "locator_exact", 1.0), ("matched", "b2", "t2", "moved_exact", 0.9), ("matched", "b3", "t3", "source_modified", 0.8), ("deleted", "b4", None, None, 0.0)], "disposition string, base_id string, target_id string, kind string, confidence double")
    base = spark.createDataFrame([("b1", "x"), ("b2", "y"), ("b3", "z"), ("b4", "w")], "id string, source string")
    target = spark.createDataFrame([("t1", "x"), ("t2", "y"), ("t3", "zz")], "id string, source string")
    records = spark.createDataFrame([("b1", "X"), ("b3", "Z")], "id string, translation string")
    cands = versions.reuse_candidates(items, base, target, records)
    assert {r.base_id: r.reuse for r in cands.collect()} == {"b1": "exact", "b2": "no_record", "b3": "changed"}
    log = spark.createDataFrame([("t1", 1, "accept", None, "ann"), ("t1", 2, "override_translation", "XX", "bob"), ("t3", 1, "reject", None, "ann")], "target_id string, ordinal int, action string, text string, reviewer string")
    done = {r.target_id: (r.status, r.final, r.reviewer) for r in versions.apply_decisions(cands, log).collect()}
    assert done == {"t1": ("accepted", "XX", "bob"), "t2": ("pending", None, None), "t3": ("rejected", None, "ann")}
    assert column(spark, ["added", "matched", "deleted"], versions.disposition_rank) == [5, 1, 4]
    journal = spark.createDataFrame([("a", "begin", 1), ("a", "committed", 2), ("b", "begin", 3), ("b", "uploaded", 4), (None, "committed", 5)], "attempt_id string, event string, ordinal int")
    row = usage.journal_state(journal).first()
    assert (row.attempt_id, row.state, row.committed) == ("b", "uploaded_without_job", False)


def test_keyword_kinds(spark):
    corpus = spark.createDataFrame([(1, "The Red Key is here"), (2, "the Red Key's lock and [Red Key]"), (3, "a red key"), (4, "two Red Keys"), (5, "only [Red Key] here"), (6, "Red Key’s, then Red Key")], "occurrence_id int, source string")
    got = {r.occurrence_id: r.match_kind for r in keywords.occurrences(corpus, spark.createDataFrame([("Red Key",)], "term string")).collect()}
    assert got == {1: "exact", 2: "possessive_variant", 3: "case_variant", 4: "plural_variant", 6: "exact"}
    found = spark.createDataFrame([("Red Key", 1, "the Red Key's", "钥匙", "possessive_variant")], "term string, occurrence_order int, source string, translation string, match_kind string")
    row = keywords.history_status(spark.createDataFrame([("Red Key", "钥匙")], "term string, target string"), found).first()
    assert (row.status, row.reasons) == ("ambiguous", ["possessive_variant"])


def test_relations_and_filters(spark):
    rel = spark.createDataFrame([("a", "b", 0.5), ("a", "c", float("inf")), ("b", "c", float("nan")), ("a", "d", 1.0), ("c", "b", None)], "left string, right string, confidence double")
    rows = intervals.active_relations(rel, spark.createDataFrame([("a",), ("b",), ("c",)], "who string")).collect()
    assert [(r.left, r.right) for r in rows] == [("a", "b"), ("a", "c"), ("b", "c"), ("c", "b")]


def test_records(spark):
    rows = spark.createDataFrame([("Hi [name], the OK", "你好 [name!t]"), ("Moon Mo", "月"), ("", "x")], "source string, translation string")
    assert [r[0] for r in rows.select(R.missing_terms(rows, ["[name]", "Mo", "OK", "the"])).collect()] == [["OK", "the"], ["Mo"], []]
    glossary = [("normalize", "a", "A"), ("normalize", "b", "B"), ("normalize", "b", "B"), ("preserve", "c", "c"), ("preserve", " ", "x")]
    digests = [{r.section: (r.n, r.digest) for r in R.glossary_digest(spark.createDataFrame(g, "section string, source string, target string")).collect()} for g in (glossary, glossary[::-1], [*glossary[:-1], ("preserve", "c", "d")])]
    assert digests[0] == digests[1] and digests[0]["normalize"][0] == 2 and digests[0]["preserve"] != digests[2]["preserve"]
    cands = spark.createDataFrame([("Key", "键", 0.9), ("Door", "门", 0.9)], "source string, target string, confidence double")
    known = spark.createDataFrame([("key", 3, "consistent", 1)], "source string, n long, status string, n_translations long")
    rows = R.attach_evidence(cands, known).withColumn("seen_target", F.col("target"))
    assert {r.source: (r.history.status, r.history.n, r.ok) for r in rows.withColumn("ok", R.evidence_complete(rows)).collect()} == {"Key": ("consistent", 3, True), "Door": ("unavailable", 0, False)}
    found = spark.createDataFrame([("f", 2, "b", "2", "low", "x|y"), ("f", 1, "b", "1", "low", None), ("f", 1, "a", "3", "low", "p\nq")], "file string, line int, reason_code string, finding_id string, severity string, text string")
    assert [r.finding_id for r in R.finding_order(found).orderBy("place").collect()] == ["3", "1", "2"]
    assert {r.markdown for r in R.to_markdown(found).collect()} == {"| f | 2 | b | low | x\\|y |", "| f | 1 | b | low |  |", "| f | 1 | a | low | p q |"}
