"""Decisions against a fold, merged results in any order, digests against a recomputation."""

import random

from quern.operators import decisions as D
from quern.operators import lineage as N

CANDIDATES = "candidate_id string, target_id string, options array<string>, option_sources array<string>, ambiguous boolean, translation string, base_source string"
LOG = "candidate_id string, ordinal long, action string, reviewer string, reviewer_type string, target_id string, text string, lineage_id string, related array<string>"


def fold(c, entries):
    """One entry after the other, with a status that changes."""
    status, text, out = "pending", c["translation"] if c else None, []
    for e in entries:
        before, problem, resolved, old, new = status, None, None, None, None
        told = (e["target_id"] or "").strip() or None
        related = sorted(set(e["related"] or []))
        if c is None:
            out.append((e["ordinal"], "unknown_candidate", None, None, None, None, None))
            continue
        if e["action"] not in D.ACTIONS:
            problem = "unknown_action"
        elif e["action"] == "accept":
            if c["translation"] is None:
                problem = "no_record"
            elif c["ambiguous"]:
                if e["reviewer_type"] != "human":
                    problem = "needs_human"
                elif told not in c["options"]:
                    problem = "not_an_option"
                elif c["option_sources"][c["options"].index(told)] != c["base_source"]:
                    problem = "source_differs"
            elif told is not None and told != c["target_id"]:
                problem = "other_target"
            if problem is None and status != "pending":
                problem = "not_pending"
            if problem is None:
                status, resolved = "accepted", told if c["ambiguous"] else c["target_id"]
        elif e["action"] == "reject":
            if status != "pending":
                problem = "not_pending"
            else:
                status = "rejected"
        elif e["action"] == "override_translation":
            if c["translation"] is None:
                problem = "no_record"
            elif not (e["text"] or "").strip():
                problem = "empty_text"
            elif status == "rejected":
                problem = "rejected_before"
            else:
                old, new, text = text, e["text"], e["text"]
        elif not (e["lineage_id"] or "").strip():
            problem = "no_lineage"
        elif e["action"] == "merge_lineage" and not related:
            problem = "nothing_to_merge"
        elif e["action"] == "split_lineage" and related:
            problem = "split_with_relations"
        out.append((e["ordinal"], problem, before, status, resolved, old, new))
    return out, status, text


def test_trail_against_a_fold(spark):
    rng = random.Random(6)
    cands = [{"candidate_id": f"c{i}", "target_id": rng.choice(["t1", "t2", None]), "options": ["t1", "t2"], "option_sources": [rng.choice("ab"), "a"], "ambiguous": rng.random() < 0.4, "translation": rng.choice(["x", "y", None]), "base_source": rng.choice("ab")} for i in range(60)]
    log = [
        {"candidate_id": rng.choice([f"c{i}" for i in range(60)] + ["nobody"]), "ordinal": n, "action": rng.choice([*D.ACTIONS, "accept", "override_translation", "nod", None]), "reviewer": rng.choice("pq"), "reviewer_type": rng.choice(["human", "human", "model", None]),
         "target_id": rng.choice(["t1", "t2", "t3", " ", None]), "text": rng.choice(["new", "newer", " ", None]), "lineage_id": rng.choice(["l", "", None]), "related": rng.choice([None, [], ["r"], ["r", "q", "r"]])}
        for n in range(600)
    ]
    shuffled = rng.sample(log, len(log))
    order = lambda rows, schema: [tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows]
    frame = spark.createDataFrame(order(cands, CANDIDATES), CANDIDATES)
    trail = D.audit_trail(frame, spark.createDataFrame(order(shuffled, LOG), LOG))
    got = {}
    for r in trail.orderBy("ordinal").collect():
        got.setdefault(r.candidate_id, []).append((r.ordinal, r.problem, r.previous_status, r.status, r.resolved, r.previous_text, r.text))
    final = {r.candidate_id: r for r in D.states(frame, trail).collect()}
    assert len(final) == 60
    accepted = {}
    for c in cands:
        mine = [e for e in log if e["candidate_id"] == c["candidate_id"]]
        out, status, text = fold(c, mine) if mine else ([], "pending", c["translation"])
        assert got.get(c["candidate_id"], []) == out
        assert (final[c["candidate_id"]].status, final[c["candidate_id"]].final) == (status, text)
        for o, problem, _, _, resolved, _, _ in out:
            if resolved and not problem:
                accepted.setdefault(resolved, []).append((o, c["candidate_id"]))
    keep = {min(x)[1] for x in accepted.values()}
    assert {i for i, r in final.items() if r.target_taken} == {i for x in accepted.values() for _, i in x} - keep
    assert [r[1] for r in got["nobody"]] == ["unknown_candidate"] * len(got["nobody"])


def test_merge_in_any_order(spark):
    rng = random.Random(8)
    schema = "unit_id long, status string, digest string, payload string"
    units = spark.createDataFrame([(i, rng.choice(D.STATES), f"d{i % 3}", rng.choice([None, "old"])) for i in range(50)], schema)
    results = [(rng.randrange(-3, 50), rng.choice([*D.STATES, "odd", None]), f"d{rng.randrange(3)}", rng.choice([None, "p", "q"])) for _ in range(400)]
    outcomes = set()
    for k in range(4):
        rows = rng.sample(results, len(results)) + (rng.sample(results, 100) if k else [])
        now, parts = units, 1 + k % 3
        for p in range(parts):
            now = D.merge_results(now, spark.createDataFrame(rows[p::parts], schema))[0].checkpoint()
        outcomes.add(tuple(sorted(map(tuple, now.collect()), key=repr)))
    assert len(outcomes) == 1
    rank = {s: k for k, s in enumerate(D.STATES)}
    before = {r.unit_id: rank[r.status] for r in units.collect()}
    assert all(rank[s] >= before[i] for i, s, _, _ in next(iter(outcomes)))
    problems = {r.problem for r in D.merge_results(units, spark.createDataFrame(results, schema))[1].collect()}
    assert problems == {"unknown_unit", "stale_digest", "unknown_state"}
    assert D.finish(units).filter("status = 'running'").count() == 0


def test_stale_nodes_against_a_recomputation(spark):
    rng = random.Random(9)
    rows = [(i, f"a{i % 3}", rng.choice(["x", "y", None, "z" * (i % 4)]), rng.choice(["t", None, "t" * 9])) for i in range(300)]
    after = [r for r in rows if r[0] % 50 != 7]
    after = [(i, a, b, "new" if i % 60 == 4 else t) for i, a, b, t in after] + [(999, "a9", None, "t")]
    schema, levels = "unit_id long, campaign string, chunk string, text string", ["campaign", "chunk"]
    trees = [N.tree(spark.createDataFrame(rng.sample(x, len(x)), schema), levels, ["text"]) for x in (rows, after)]
    got = {(r.level, r.name, r.change) for r in N.stale(*trees, levels).collect()}
    want = set()
    for level, key in (("unit", lambda r: (r[1], r[2], r[0])), ("chunk", lambda r: (r[1], r[2])), ("campaign", lambda r: (r[1],))):
        sides = []
        for x in (rows, after):
            groups = {}
            for r in x:
                groups.setdefault(key(r), []).append(r)
            sides.append({k: sorted(map(repr, v)) for k, v in groups.items()})
        for k in {*sides[0], *sides[1]}:
            a, b = (s.get(k) for s in sides)
            if a != b:
                want.add((level, "/".join("" if p is None else str(p) for p in k), "added" if a is None else "gone" if b is None else "changed"))
    # A null chunk and an empty one are two chunks of one name.
    assert got == want
    again = N.tree(spark.createDataFrame(rng.sample(rows, len(rows)), schema), levels, ["text"])
    assert N.stale(trees[0], again, levels).count() == 0
