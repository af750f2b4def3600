"""Story retrieval on a small story."""

import re

from quern.operators import story


def test_spans(spark):
    rows = [("a", 3, 9, None, None), ("a", None, None, 12, None), ("b", None, None, None, 4), ("b", 2, None, None, None), ("c", None, None, None, None)]
    df = spark.createDataFrame(rows, "target_id string, line_start int, line_end int, line_number int, line int")
    assert {r.target_id: (r.first, r["last"]) for r in story.target_spans(df).collect()} == {"a": (3, 12), "b": (2, 5), "c": (None, None)}


def test_aliases(spark):
    texts = ["Anna met Bob-Lee.", "annabel sang", "小红来了", "the old man; OLD MAN", "", None, "a b", "x+y=z (x+y)", "anna_2 anna"]
    aliases = [(1, "Anna"), (2, "Bob-Lee"), (3, "小红"), (4, "old man"), (5, "a"), (6, "x+y"), (7, "bel"), (8, "- -"), (9, "  ")]
    t = spark.createDataFrame(list(enumerate(texts)), "t int, text string")
    a = spark.createDataFrame(aliases, "who int, alias string")
    want = set()
    for i, text in enumerate(texts):
        for who, alias in aliases:
            low = alias.strip().lower()
            if text is None or len(low) <= 1:
                continue
            if re.fullmatch(r"[A-Za-z0-9_ -]+", low):
                found = re.search(r"(?<![A-Za-z0-9_])" + re.escape(low) + r"(?![A-Za-z0-9_])", text.lower())
            else:
                found = low in text.lower()
            if found:
                want.add((i, who))
    assert {(r.t, r.who) for r in story.alias_hits(t, a, "t", "text", "who").collect()} == want
    assert want == {(0, 1), (0, 2), (2, 3), (3, 4), (7, 6), (8, 1)}
    assert {(r.t, r.who) for r in story.alias_hits(t, a, "t", "text", "who", broadcast_aliases=0).collect()} == want
    words = a.filter("who IN (1, 2, 4)")
    assert {(r.t, r.who) for r in story.alias_hits(t, words, "t", "text", "who").collect()} == {x for x in want if x[1] in (1, 2, 4)}


def test_probes_of_texts_are_not_handed_out(spark, capsys):
    """Few aliases whose size Spark does not know: they are broadcast, not the many probes of the texts."""
    a = spark.createDataFrame([(1, "one"), (2, "two")], "who int, alias string")
    spark.range(50).selectExpr("id AS t", "concat('one ', id) AS text").write.mode("overwrite").saveAsTable("few_texts")
    hits = story.alias_hits(spark.table("few_texts"), a, "t", "text", "who")
    assert hits.count() == 50
    hits.explain()
    plan = capsys.readouterr().out
    handed = plan[plan.index("BroadcastExchange") :]
    assert "Generate explode" in plan and "Generate explode" not in handed
    spark.sql("DROP TABLE few_texts")


def test_retrieve(spark):
    aliases = spark.createDataFrame([("anna", "Anna"), ("anna", "安娜"), ("bob", "b"), ("cleo", "Cleo"), ("dan", "Dan")], "char_id string, alias string")
    targets = spark.createDataFrame([("t1", "f", 10, 20, "Anna says the Moon Gate is open"), ("t2", None, None, None, "nobody")], "target_id string, file string, first int, last int, text string")
    speakers = spark.createDataFrame([("t1", "B"), ("t2", " ")], "target_id string, speaker string")
    scenes = spark.createDataFrame([("s1", "f", 18, 30, ["cleo"]), ("s2", "f", 100, 110, ["anna"]), ("s3", "g", 1, 2, ["anna"])], "scene_id string, file string, first int, last int, people array<string>")
    relations = spark.createDataFrame([("anna", "bob", 0.5), ("anna", "cleo", float("nan")), ("bob", "cleo", 0.9), ("anna", "dan", 1.0)], "left string, right string, confidence double")
    terms = spark.createDataFrame([(0, "gate", "moon gate"), (1, "moon", "Moon"), (2, "sun", "sun")], "ordinal int, term string, alias string")
    got = story.retrieve(targets, speakers, aliases, scenes, relations, terms, top_relations=2)
    assert {(r.target_id, r.char_id) for r in got["characters"].collect()} == {("t1", "anna"), ("t1", "bob"), ("t1", "cleo")}
    assert [(r.scene_id, r.score) for r in got["scenes"].orderBy("rank").collect()] == [("s1", 153), ("s2", 58)]
    assert [(r.left, r.right) for r in got["relations"].orderBy("rank").collect()] == [("bob", "cleo"), ("anna", "bob")]
    assert [r.term for r in got["terms"].orderBy("rank").collect()] == ["gate", "moon"]
