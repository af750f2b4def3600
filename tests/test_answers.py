"""Answers by contract, and routes told along their paths."""

import hashlib
import json
import random

from quern.operators import answers as A
from quern.operators import graph as G


def test_keyword_answers(spark):
    good = {"source": "Key", "suggested_target": "键", "category": "item", "confidence": 0.5, "evidence": "e", "source_item_ids": ["1", "2"]}
    items = [good, {**good, "confidence": True}, {**good, "confidence": "high"}, {**good, "source_item_ids": []}, {**good, "source_item_ids": ["9"]}, {k: v for k, v in good.items() if k != "category"}, {**good, "source": " "}, 5, None, {**good, "category": None}]
    answers = [("a", ["1", "2"], json.dumps({"candidates": items})), ("b", ["1"], json.dumps({"candidates": [{**good, "source_item_ids": ["1"]}]})), ("c", ["1", "1"], None), ("d", [], "{}"), ("e", ["4"], '{"candidates": null}')]
    got, issues, retry = A.read_answers(spark.createDataFrame(answers, "request_id string, expected array<string>, answer string"), "keyword")
    assert sorted((r.request_id, r["index"], r.fields["source"], json.loads(r.fields["source_item_ids"])) for r in got.collect()) == [("a", 0, "Key", ["1", "2"]), ("b", 0, "Key", ["1"])]
    assert sorted((r.request_id, -1 if r["index"] is None else r["index"], r.field or "", r.code) for r in issues.collect()) == [
        ("a", 1, "confidence", "wrong_type"), ("a", 2, "confidence", "wrong_type"), ("a", 3, "source_item_ids", "empty_field"), ("a", 4, "source_item_ids", "unknown_id"), ("a", 5, "category", "missing_field"), ("a", 6, "source", "empty_field"),
        ("a", 7, "", "item_not_object"), ("a", 8, "", "item_not_object"), ("a", 9, "category", "missing_field"), ("c", -1, "", "not_json"), ("d", -1, "", "envelope_missing"), ("e", -1, "", "items_not_array"),
    ]
    assert sorted(map(tuple, retry.collect())) == [("a", "1"), ("a", "2"), ("c", "1"), ("e", "4")]


def test_routes_are_told_in_order(spark):
    rng = random.Random(3)
    lines, n = [], 0
    for k in range(6):
        lines.append(("f", n, f"label L{k}:"))
        for _ in range(4):
            n += 1
            lines.append(("f", n, rng.choice(['"say"', f"    jump L{k + rng.randrange(1, 4)}", "    jump expression x"])))
        n += 1
    chunks = [(f"c{i:02}", "f", i * 4, i * 4 + 3, rng.choice([None, " ", f"part {i}"]), [f"e{i}", "shared", None, ""]) for i in range(8)] + [("far", "f", 900, 910, "far away", ["z"]), ("none", "g", None, None, "no file", [])]
    nodes, edges = G.labels_and_edges(spark.createDataFrame(lines, "file string, line long, text string"))
    parts = spark.createDataFrame(chunks, "chunk_id string, file string, first_line long, last_line long, summary string, evidence array<string>")
    placed = G.assign_labels(parts, nodes)
    spans = {r.label: (r.first_line, r.last_line) for r in nodes.collect()}
    jumps = {(r.source, r.target, r.kind) for r in edges.collect()}
    home = {}
    for i, _, a, b, _, _ in chunks:
        shared = {k: min(b, y) - max(a, x) + 1 for k, (x, y) in spans.items()} if a is not None and i != "far" else {}
        best = max(shared.values(), default=0)
        home[i] = min((spans[k][0], k) for k, v in shared.items() if v == best)[1] if best > 0 else "_unassigned"
    assert {r.chunk_id: r.label for r in placed.collect()} == home
    labels = G.label_records(nodes, edges, placed)
    told = {}
    for name in spans:
        mine = sorted(c for c in chunks if home[c[0]] == name)
        said = "\n".join(c[4].strip() for c in mine if (c[4] or "").strip()) or f"Label `{name}`"
        dynamic = any(s == name and k == "unresolved" for s, _, k in jumps)
        evidence = list(dict.fromkeys(e for c in mine for e in c[5] if e))
        told[name] = (said + ("\n[unresolved dynamic jump/call present]" if dynamic else ""), evidence, dynamic)
    assert {r.label: (r.summary, r.evidence, r.unresolved) for r in labels.collect()} == told
    found = G.routes(nodes, edges, max_depth=8, max_routes=16)
    records = {(r.entry, r.route): r for r in G.route_records(found, labels).collect()}
    paths = {(r.entry, r.route): r.path for r in found.collect()}
    assert set(records) == set(paths) and len(paths) > 2
    for key, path in paths.items():
        body = "\n\n".join(f"## {x}\n{told[x][0]}" for x in path)
        open_ = any(told[x][2] for x in path)
        assert records[key].summary == body + ("\n\n[route contains unresolved dynamic jump/call]" if open_ else "")
        assert records[key].evidence == list(dict.fromkeys(e for x in path for e in told[x][1])) and records[key].unresolved == open_
        assert len(records[key].digest) == len(hashlib.sha256().hexdigest())


def test_answers_are_parsed_once_for_their_items(spark, capsys):
    """Items that repeat are found without joining the answers with themselves."""
    answer = '[{"id": "a", "translation": "x"}, {"id": " a", "translation": "y"}, {"id": "b", "translation": " "}, {"id": "b", "translation": "z"}]'
    rows = spark.createDataFrame([(1, ["a", "b"], answer), (2, ["a"], answer)], "request_id long, expected array<string>, answer string")
    items, issues, _ = A.read_answers(rows, "translation")
    assert sorted((r.request_id, r["index"]) for r in items.collect()) == [(1, 0), (1, 3), (2, 0)]
    assert sorted((r.request_id, r["index"], r.code) for r in issues.collect()) == [(1, 1, "duplicate_id"), (1, 2, "empty_field"), (2, 1, "duplicate_id"), (2, 2, "empty_field"), (2, 3, "unknown_id")]
    items.explain()
    assert "Join" not in capsys.readouterr().out


def test_routes_of_files_that_share_labels(spark):
    """Jumps of several files stand on the same lines: each path is a route, in the order of lines and targets."""
    lines = [(f"f{i}", 10 * k + n, text) for i in range(3) for k in range(6) for n, text in ((0, f"label L{k}:"), (3, f"    jump L{k + 1 + i}"), (4, '"say"'))]
    nodes, edges = G.labels_and_edges(spark.createDataFrame(lines, "file string, line long, text string"))
    after = {f"L{k}": sorted((10 * k + 3, f"L{k + 1 + i}") for i in range(3) if k + 1 + i < 6) for k in range(6)}
    walk = lambda path: [p for _, x in after[path[-1]] for p in walk([*path, x])] if after[path[-1]] else [path]
    all_ = walk(["L0"])
    assert len(all_) > 9
    for most in (9, 32):
        got = sorted((r.route, r.path) for r in G.routes(nodes, edges, max_depth=8, max_routes=most).collect() if r.entry == "L0")
        assert got == [(n + 1, p) for n, p in enumerate(all_[:most])]


def test_lines_are_read_once_for_routes(spark, capsys):
    """What is found in the lines is a table of its own; a label's chunks are put together from pieces."""
    lines = spark.createDataFrame([("f", 0, "label a:"), ("f", 1, "    jump b"), ("f", 2, "label b:")], "file string, line long, text string")
    nodes, edges = G.labels_and_edges(lines)
    nodes.explain()
    edges.explain()
    assert "Window" not in capsys.readouterr().out
    chunks = spark.createDataFrame([("c", "f", 0, 2, "s", ["e"])], "chunk_id string, file string, first_line long, last_line long, summary string, evidence array<string>")
    labels = G.label_records(nodes, edges, G.assign_labels(chunks, nodes))
    G.route_records(G.routes(nodes, edges), labels).select("summary").explain()
    out = capsys.readouterr().out
    assert "lag" not in out and "to_json" not in out and "partition_id" in out.lower()


def test_chunks_of_long_files(spark):
    """Chunks within, across and beyond blocks of lines, without ends or with swapped ones, against all pairs."""
    rng = random.Random(5)
    lines = [(f, 7 * n, f"label {f}{rng.randrange(30)}:" if n % 9 == 0 else '"say"') for f in ("p", "q") for n in range(300)]
    lines += [("one", 5, "label only:"), ("one", 6, '"say"')]
    nodes, edges = G.labels_and_edges(spark.createDataFrame(lines, "file string, line long, text string"))
    ends = [(a, a + rng.choice((0, 6, 90, 700))) for a in (rng.randrange(-300, 2400) for _ in range(60))] + [(None, None), (None, 40), (500, None), (90, 20), (10**12, 10**13), (-(10**12), 10**12)]
    chunks = [(f"{f}{i:03}", f, a, b, f"s{i}" if i % 4 else None, [f"e{i % 5}", None]) for f in ("p", "q", "one", "none") for i, (a, b) in enumerate(ends)]
    spans = {(r.file, r.label): (r.first_line, r.last_line) for r in nodes.collect()}
    least, most = (lambda *x: min(v for v in x if v is not None)), (lambda *x: max(v for v in x if v is not None))
    home = {}
    for i, f, a, b, _, _ in chunks:
        shared = [(least(b, y) - most(a, x) + 1, -x, name) for (g, name), (x, y) in spans.items() if g == f]
        home[i] = max(s for s in shared)[2] if shared and max(shared)[0] > 0 else "only" if f == "one" else "_unassigned"
    placed = G.assign_labels(spark.createDataFrame(chunks, "chunk_id string, file string, first_line long, last_line long, summary string, evidence array<string>"), nodes)
    assert {r.chunk_id: r.label for r in placed.collect()} == home and placed.count() == len(chunks)
    for r in G.label_records(nodes, edges, placed).collect():
        mine = sorted(c for c in chunks if home[c[0]] == r.label)
        assert r.upstream == [c[0] for c in mine] and r.evidence == list(dict.fromkeys(c[5][0] for c in mine))
        made = {"label": r.label} | ({"c": [{"id": c[0], "summary": c[4] or "", "evidence": c[5]} for c in mine]} if mine else {}) | {"unresolved": False}
        assert r.digest == hashlib.sha256(json.dumps(made, separators=(",", ":")).encode()).hexdigest()
