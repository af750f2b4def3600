"""Reconciliation against the rules applied to every pair."""

import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np

from quern.functions import udfs
from quern.functions.udfs import Packed, longest_common
from quern.operators import versions as R

COLUMNS = ("id", "lineage", "locator", "content", "source", "before", "after", "speaker", "mode")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)


def evidence(x, y):
    speaker = bool(x["speaker"]) and x["speaker"] == y["speaker"]
    before, after = (bool(x[c]) and x[c] == y[c] and x[c] not in (x["source"], y["source"]) for c in ("before", "after"))
    if x["lineage"] and x["lineage"] == y["lineage"]:
        return "confirmed_lineage", 600.0, 1.0, True
    if x["locator"] == y["locator"]:
        return "locator_exact", 500.0, 1.0, True
    if x["content"] == y["content"]:
        return "content_exact", 450.0, 1.0, True
    some = speaker or before or after
    if x["source"] and x["source"] == y["source"]:
        return "moved_exact", 300.0 + 30 * speaker + 12 * before + 12 * after + 4 * (x["mode"] == y["mode"]), 0.98 if some else 0.93, some
    if not x["source"] or not y["source"] or max(len(x["source"]), len(y["source"])) < 4:
        return None
    ratio = SequenceMatcher(None, x["source"], y["source"], autojunk=False).ratio()
    if ratio < 0.82:
        return None
    return "source_modified", 200 + 100 * ratio + 8 * speaker + 4 * before + 4 * after, min(0.99, ratio * 0.88 + 0.05 * speaker + 0.025 * before + 0.025 * after), some


def brute(base, target):
    """Matches and what is left, by all pairs."""
    counts = {c: (Counter(x[c] for x in base), Counter(y[c] for y in target)) for c in ("source", "content")}
    pairs = defaultdict(list)
    for x in base:
        exact = [y for y in target if any(x[c] and x[c] == y[c] for c in ("lineage", "locator", "content", "source"))]
        for y in exact or target:
            if found := evidence(x, y):
                many = any(n[x["source"]] > 1 or n[y["source"]] > 1 for n in counts["source"])
                copies = counts["content"][0][x["content"]] > 1 or counts["content"][1][y["content"]] > 1
                kind, score, sure, some = found
                usable = not (kind == "content_exact" and copies) and (kind not in ("moved_exact", "source_modified") or not (counts["source"][0][x["source"]] > 1 or counts["source"][1][y["source"]] > 1) or some)
                if kind == "moved_exact" and many and some:
                    shown = "context_high_confidence"
                else:
                    shown = kind
                pairs[kind].append((x["id"], y["id"], shown, score, sure, usable))
    open_a, open_b, matched = {x["id"] for x in base}, {y["id"] for y in target}, {}
    for kind in R.RANKS:
        margin = 5.0 if kind == "source_modified" else 0.0
        while True:
            pool = [p for p in pairs[kind] if p[0] in open_a and p[1] in open_b]
            best = []
            for side in (0, 1):
                groups = defaultdict(list)
                for p in pool:
                    groups[p[side]].append(p)
                tops = (sorted(g, key=lambda p: (-p[3], p[0], p[1])) for g in groups.values())
                best.append({g[0] for g in tops if g[0][5] and (len(g) == 1 or g[0][3] - g[1][3] > margin)})
            new = best[0] & best[1]
            if not new:
                break
            for p in new:
                matched[p[0]] = (p[1], p[2], round(p[4], 4))
                open_a.remove(p[0])
                open_b.remove(p[1])
    unsure = {p[0] for kind in pairs for p in pairs[kind] if p[0] in open_a and p[1] in open_b}
    return matched, unsure, open_a - unsure


def sides(seed, n=70):
    rng = random.Random(seed)
    words = "the cat saw a dog and ran home over hills while rain fell on old stone walls near blue water".split()
    lines = [" ".join(rng.choices(words, k=rng.randrange(4, 9))) for _ in range(n)]
    out = []
    for side in "bt":
        rows = []
        for i, line in enumerate(lines):
            if rng.random() < 0.1:
                continue
            text = rng.choice([line, line, line, "...", "yes", line.replace("the", "that", 1), line + " now", None])
            place = i if rng.random() < 0.4 else 1000 * (side == "t") + 500 + i
            row = {"id": f"{side}{i:03}", "lineage": f"l{i}" if rng.random() < 0.08 else None, "locator": f"f:{place}", "source": text, "before": rng.choice([lines[i - 1], "...", None]), "after": rng.choice([lines[(i + 1) % n], None]), "speaker": rng.choice(["ann", "bob", None]), "mode": rng.choice(["say", "menu"])}
            row["content"] = f"{text}|{i}" if text and rng.random() < 0.3 else f"{side}{i}"
            rows.append(row)
        out.append(rows)
    return out


def test_reconcile(spark):
    kinds = Counter()
    for seed in range(3):
        base, target = sides(seed)
        got = R.reconcile(*(spark.createDataFrame([[r[c] for c in COLUMNS] for r in rows], SCHEMA) for rows in (base, target))).collect()
        matched, unsure, gone = brute(base, target)
        assert {r.base_id: (r.target_id, r.kind, r.confidence) for r in got if r.disposition == "matched"} == matched
        assert {r.base_id for r in got if r.disposition == "ambiguous"} == unsure
        assert {r.base_id for r in got if r.disposition == "deleted"} == gone
        assert sorted(r.target_id for r in got if r.target_id) == sorted(y["id"] for y in target)
        assert all(len(r.options) <= R.OPTIONS for r in got)
        kinds.update(k for _, k, _ in matched.values())
    assert set(kinds) == {*R.RANKS, "context_high_confidence"}


def test_similar_pairs_against_all_pairs(spark):
    """Short and long texts, swapped pieces, other scripts, empty and null ones; nothing that all pairs find is missed."""
    rng = random.Random(2)
    words = "the cat saw a dog and ran home over hills while rain fell on old stone walls near blue water 猫 が 好き だ été".split()
    lines = ["".join(rng.choices("ab", k=rng.randrange(1, 9))) for _ in range(60)] + [" ".join(rng.choices(words, k=rng.choice([2, 3, 5, 9, 40, 300]))) for _ in range(160)]
    sides = []
    for _ in range(2):
        side = []
        for t in lines:
            c = list(t)
            for _ in range(rng.randrange(0, 1 + len(c) // 6)):
                at = rng.randrange(len(c)) if c else 0
                c[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "e"])
            side.append("".join(c) if rng.random() < 0.8 else t[len(t) // 2 :] + t[: len(t) // 2])
        sides.append([*side, "", None])
    frames = [spark.createDataFrame([(f"{n}{i}", t) for i, t in enumerate(s)], "id string, source string") for n, s in zip("bt", sides, strict=True)]
    got = {(r.base_id, r.target_id): r.ratio for r in R.similar_pairs(*frames).collect()}
    want = {}
    for i, x in enumerate(sides[0]):
        for j, y in enumerate(sides[1]):
            if x and y and max(len(x), len(y)) >= 4 and 2 * min(len(x), len(y)) >= 0.82 * (len(x) + len(y)):
                ratio = SequenceMatcher(None, x, y, autojunk=False).ratio()
                if ratio >= 0.82:
                    want[f"b{i}", f"t{j}"] = ratio
    assert got == want and len(want) > 150


def test_packed_texts_count_as_single_ones():
    """Side by side in one number, and all of a block by one pass; a common part never runs into the next text."""
    rng = random.Random(4)
    texts = ["", "a", "aaaa", "ab" * 40, "猫が好き", "\0x", *["".join(rng.choices("abc 猫", k=rng.randrange(70))) for _ in range(60)], ""]
    packed = Packed(texts)
    for b in texts:
        assert packed.longest_common(b).tolist() == [longest_common(a, b) for a in texts]
    passes = []
    some, common = np.ones((len(texts), len(texts)), dtype=bool), np.full((len(texts), len(texts)), 9)
    single, R.longest_common = R.longest_common, lambda *a: passes.append(a)
    try:
        got = set(R._subsequences(texts, texts, some, common))
    finally:
        R.longest_common = single
    assert not passes and got == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if longest_common(a, b) >= 9}


def test_a_common_source_lists_no_pairs(spark):
    rows = lambda side: spark.range(3000).selectExpr(f"concat('{side}', id) AS id", "'...' AS source", f"concat('{side}', id) AS locator", "if(id < 3, concat('line ', id), 'same') AS before")
    got = R.reconcile(rows("b"), rows("t"), fuzzy=False)
    found = {(r.base_id, r.target_id, r.kind) for r in got.filter("disposition = 'matched'").collect()}
    assert found == {(f"b{i}", f"t{i}", "context_high_confidence") for i in range(3)}
    assert got.filter("disposition = 'ambiguous'").count() == 2997 and got.selectExpr("max(size(options))").first()[0] == R.OPTIONS


def test_empty_and_null_rows(spark):
    some = spark.createDataFrame([("x", None), ("y", "")], "id string, source string")
    assert sorted(r.disposition for r in R.reconcile(some, some.limit(0)).collect()) == ["deleted", "deleted"]
    assert sorted(r.disposition for r in R.reconcile(some, some).collect()) == ["added"] * 2 + ["deleted"] * 2


def test_packed_texts_reach_what_single_ones_reach():
    """With a least number, for all texts and for some, at both ends of the band and over several words."""
    rng = random.Random(6)
    for size in (5, 60, 130, 300):
        first = "".join(rng.choices("abc d猫", k=size))
        texts = ["", first, first[size // 3 :] + first[: size // 3]]
        for _ in range(60):
            c = list(first)
            for _ in range(rng.randrange(1 + size // 3)):
                at = rng.randrange(len(c))
                c[at : at + 1] = rng.choice(["", "x", "ab", c[at]])
            texts.append("".join(c) or "z")
        packed = Packed(texts)
        for b in (first, first[: size // 2] + "zz" + first[size // 2 :], ""):
            want = np.array([longest_common(a, b) for a in texts])
            least = np.ceil(0.41 * (packed.lengths + len(b)) - 1e-9)
            for at in (np.arange(len(texts)), np.arange(0, len(texts), 3)):
                got, true = packed.longest_common(b, least[at], at), want[at]
                assert ((got >= least[at]) == (true >= least[at])).all() and (got[true >= least[at]] == true[true >= least[at]]).all()


def test_matching_blocks_leave_out_far_pieces_only(monkeypatch):
    """What the common pieces rule out, SequenceMatcher does not match; with pieces that do not fit a list as well."""
    rng = random.Random(7)
    for turn in range(24):
        size, signs = rng.choice([6, 30, 90, 200]), rng.choice(["ab", "abcd ", "the rainon猫"])
        firsts = ["".join(rng.choices(signs, k=size)) for _ in range(3)]
        sides = []
        for n in (14, 15):
            side = []
            for _ in range(n):
                c = list(rng.choice(firsts))
                for _ in range(rng.randrange(1 + size // 3)):
                    at = rng.randrange(len(c) + 1)
                    c[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "ab"])
                t = "".join(c) or "z"
                side.append(t[size // 3 :] + t[: size // 3] if rng.random() < 0.2 else t)
            sides.append([t or "z" for t in side])
        both = np.array([[len(x) + len(y) for y in sides[1]] for x in sides[0]])
        common = np.ceil(R.MIN_RATIO / 2 * both - 1e-9)
        monkeypatch.setattr(R, "LISTED", (20, 2000, 1 << 19)[turn % 3])
        left = R._blocks(*sides, np.ones(both.shape, dtype=bool), common, (1, 8, 1000)[turn // 3 % 3])
        like = np.array([[SequenceMatcher(None, x, y, autojunk=False).ratio() >= R.MIN_RATIO for y in sides[1]] for x in sides[0]])
        assert not (like & ~left).any()
        assert not (like & ~((R._common_pieces(*sides, 1, 256) >= common) & (R._common_pieces(*sides, 2, 256) >= 3 * common - both - 1))).any()


def test_unlike_texts_of_few_syllables_are_not_compared(monkeypatch):
    """Random texts of the same syllables share most bigrams; few of their pairs may be read character by character."""
    rng = random.Random(8)
    side = lambda: ["".join(rng.choices(["th", "er", "on", "an", " the", " re", "in", "ed ", "ing "], k=200)) for _ in range(80)]
    xs, ys = side(), side()
    read = []
    one, many = R.longest_common, Packed.longest_common
    monkeypatch.setattr(R, "longest_common", lambda *a: read.append(1) or one(*a))
    monkeypatch.setattr(Packed, "longest_common", lambda self, b, least=None, at=None: read.extend([1] * (len(self.texts) if at is None else len(at))) or many(self, b, least, at))
    some, common = R._possible(xs, ys, R.MIN_RATIO, R.MIN_LENGTH)
    assert not list(R._subsequences(xs, ys, some, common)) and len(read) < len(xs) * len(ys) / 10


def test_matching_counts_as_sequence_matcher(monkeypatch):
    """Long blocks by their pieces, what is left by the library; ties go to the first in both texts."""
    rng = random.Random(9)
    monkeypatch.setattr(udfs, "_SHORT", 0)
    for turn in range(300):
        monkeypatch.setattr(udfs, "_PIECE", (2, 5, 16)[turn % 3])
        a = "".join(rng.choices(rng.choice(["ab", "abcdef ", "猫がab"]), k=rng.choice([0, 7, 40, 160])))
        c = list(a)
        for _ in range(rng.randrange(1 + len(a) // 4)):
            at = rng.randrange(len(c) + 1)
            c[at : at + rng.choice([0, 1, 9])] = rng.choice(["", "x", "ab", a[:20]])
        b = "".join(c)
        want = SequenceMatcher(None, a, b, autojunk=False)
        assert udfs.matching(a, b) == sum(m.size for m in want.get_matching_blocks()) and udfs.ratio_at(a, b, 0.0) == want.ratio()
    text = "a line of some words " * 300
    monkeypatch.undo()
    monkeypatch.setattr(udfs.difflib, "SequenceMatcher", None)
    assert udfs.ratio_at(text, text + "indeed", 0.82) == 2.0 * len(text) / (2 * len(text) + 6)
