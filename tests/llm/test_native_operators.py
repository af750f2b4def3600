"""Licence scans and quotation linking against plain re-computations."""

import math
import random
import re
import textwrap
from collections import Counter

from quern.llm import license_scan, queries, quotation


def brute_licences(rows, least=license_scan.MIN_COSINE):
    """rows: (path, text, is_file by name)."""
    n, share = max(len(rows), 1), license_scan.LEAST_SHARE
    vocab = {t for _, x in license_scan.TEMPLATES for t in license_scan.template_terms(x)}
    df = Counter(t for _, x, _ in rows for t in vocab & set(license_scan.template_terms(x or "")))
    idf = {t: -math.log(df[t] / n * (1 - share) + share) + 1 for t in vocab}
    vec = lambda x: {t: k * idf.get(t, license_scan.OTHER_WEIGHT) for t, k in license_scan.template_terms(x).items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))

    def best(unit):
        u, out = vec(unit), []
        for name, x in license_scan.TEMPLATES:
            t = vec(x)
            if u:
                c = round(sum(u.get(k, 0) * w for k, w in t.items()) / norm(u) / norm(t), 9)
                if c >= least:
                    out.append((-c, name))
        return min(out, default=None)

    own, files = [], []
    for path, text, is_file in rows:
        lines = (text or "").split("\n")
        bare = [re.sub(license_scan.COMMENT, "", x) for x in lines]
        line = min(filter(None, map(best, lines + re.split("\n[ \t\r]*\n", "\n".join(bare)))), default=None)
        whole = best("\n".join(bare))
        files.append(is_file or whole is not None)
        if whole and (line is None or whole[0] <= line[0]):
            own.append((*whole, "file"))
        else:
            own.append((*line, "header") if line else None)
    rows = [(path, text, f) for (path, text, _), f in zip(rows, files, strict=True)]
    out = []
    for (path, _, _), o in zip(rows, own, strict=True):
        if o or path is None:
            out.append((path, o and o[1], o and round(-o[0], 6), o and o[2], None))
            continue
        d = path.rpartition("/")[0]
        while True:
            lent = min(((o2[0], o2[1], p2) for (p2, _, f2), o2 in zip(rows, own, strict=True) if f2 and o2 and p2 is not None and p2.rpartition("/")[0] == d), default=None)
            if lent or not d:
                break
            d = d.rpartition("/")[0]
        out.append((path, lent and lent[1], lent and round(-lent[0], 6), "inherited" if lent else None, lent and lent[2]))
    return out


def test_headers_find_their_own_licence(spark):
    texts = dict(license_scan.TEXTS)
    wrap = lambda name, sign: "\n".join(f"{sign} {line}".rstrip() for block in texts[name].split("\n\n") for line in [*textwrap.wrap(block, 60), ""])
    rows = [(f"{name}/{k}", wrap(name, sign) + "\n\n" + "x = compute(y)\n" * 50) for name in texts for k, sign in enumerate(("#", "//", " *"))]
    rows += [("long/line", "this is prose that goes on for a while: Licensed under the Apache License, Version 2.0. And then it says more things of other kinds"), ("none/a", "words about a licence and software and nothing else"), ("none/b", "x " * 50_000)]
    for more in (0, 3_000):  # the answer does not depend on how many other files there are
        df = spark.createDataFrame(rows, "path string, text string").union(spark.range(more).selectExpr("concat('other/', id, '/f')", "concat('word', id, ' text')"))
        got = {r.path: r.licence for r in license_scan.scan_licences(df).collect()}
        assert {p: v for p, v in got.items() if "/" in p and p.split("/")[0] in texts and v != p.split("/")[0]} == {}
        assert got["none/a"] is None and got["none/b"] is None
    assert got["long/line"] == "Apache-2.0"


def brute_quotes(rows):
    """``{(conv, turn): (reply_to, n_linked)}``; rows (conv, turn, text), no repeats or nulls."""
    norm = lambda x: re.sub(r"[\x09-\x0D\x20]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in x)).strip(" ")
    sentences = lambda x: [s for line in x.split("\n") for s in re.split(quotation.SENTENCE, line)]
    parsed, out = {}, {}
    for c, t, text in rows:
        runs = []
        for line in text.split("\n"):
            sign = re.match(r"(?:[ \t]*>)+", line)
            level, body = (sign[0].count(">"), re.sub(r"^(?:[ \t]*>)+[ \t]?", "", line)) if sign else (0, line)
            if runs and runs[-1][0] == level:
                runs[-1][1].append(body)
            else:
                runs.append((level, [body]))
        deep = max(k for k, _ in runs)
        own = "\n".join(x for k, b in runs if k == 0 for x in b if not (deep and re.search(quotation.ATTRIBUTION, x)))
        if deep:
            own = re.sub(r"\n{3,}", "\n\n", own).strip(" ")
        parsed[c, t] = deep, [(k, b) for k, b in runs if k], {norm(p) for p in [own, *re.split(r"\n[ \t]*\n", own), *own.split("\n"), *sentences(own)]} - {""}
    for (c, t), (deep, runs, _) in parsed.items():
        before = sorted(u for d, u in parsed if d == c and u < t)
        top, linked = min((k for k, _ in runs), default=0), {}
        for k, body in runs:
            plain = "\n".join(x for x in body if not re.search(quotation.ATTRIBUTION, x))
            if not norm(plain) and k == deep:
                plain = "\n".join(body)
            if not norm(plain):
                continue
            units = list({(norm(s), norm(p)) for p in re.split(r"\n[ \t]*\n", plain) for s in sentences(p) if norm(s)})
            first = next((u for u in sorted(u for d, u in parsed if d == c) if norm(plain) in parsed[c, u][2]), None)
            source = first if first is not None and first < t else None
            if source is None and any(s != norm(plain) for s, _ in units):
                scores = [(sum(s in parsed[c, u][2] or p in parsed[c, u][2] for s, p in units), -u) for u in before]
                best = max((x for x in scores if 2 * x[0] > len(units)), default=None)
                source = best and -best[1]
            linked[k, norm(plain)] = source
        near = [s for (k, _), s in linked.items() if s is not None and k == top]
        far = [s for s in linked.values() if s is not None]
        out[c, t] = max(near, default=max(far, default=None)), len(far)
    return out


def test_quotes_against_brute_force(spark):
    rng = random.Random(14)
    lines = [f"{a} {b}{end}" for a in ("red", "old", "big") for b in ("cat", "dog", "house", "tree") for end in (".", "", "?")]
    rows, said = [], {}
    for c in range(12):
        for t in range(14):
            own = "\n".join(rng.choice([" ", "\n", ""]).join(rng.choices(lines, k=rng.randrange(1, 3))) for _ in range(rng.randrange(1, 5)))
            parts = [own]
            for _ in range(rng.randrange(0, 3) if t else 0):
                other = said[c, rng.randrange(t)].split("\n")
                i = rng.randrange(len(other))
                parts.insert(rng.randrange(len(parts) + 1), "\n".join([rng.choice(["On x, y wrote:", "so"]), *("> " + x for x in other[i : i + rng.randrange(1, 6)]), *rng.choice([[], ["> never said"]])]))
            said[c, t] = "\n".join(parts)
            rows.append((c, t, said[c, t]))
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    linked = quotation.link_quotes(df)
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_linked) for r in linked.collect()}
    assert got == brute_quotes(rows) and sum(v[0] is not None for v in got.values()) > 60
    talks = quotation.build_conversations(linked).collect()
    assert sum(len(r.messages) for r in talks) == len(rows)
    for r in talks:
        seen = set()
        for m in r.messages:
            assert ">" not in m.text and (m.reply_to is None or m.reply_to in seen)
            seen.add(m.turn)


def test_the_query_quotes_and_links(spark, small):
    rows = queries.op3_chat_quotes(spark, small).collect()
    assert sum(r.n_linked for r in rows) > 0.9 * sum(r.n_quotes > 0 for r in rows) > 10
    assert sum(r.depth == 2 for r in rows) > 3
    assert all(r.reply_to in (None, r.turn - 1) or r.reply_to < r.turn for r in rows)


def test_licences(spark):
    mit, apache = "Released under the MIT License.", "# Licensed under the Apache License, Version 2.0"
    rows = [
        ("LICENSE", "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
        ("a/b/c/x.py", "import os\nprint(1)"), ("a/b/LICENSE.txt", apache), ("a/b/y.py", mit + "\ncode"), ("a/b/c/d/z.py", None), ("a/q.py", ""), ("top.py", "hello"),
        (None, mit), (None, "nothing"), ("e/COPYING", "no licence words"), ("e/f.py", "license of mine"), ("a/b/c/x.py", "import os\nprint(1)"), ("long.txt", ("lorem ipsum\n" * 5000) + apache.upper()),
        ("g/licence-a", mit), ("g/licence-b", mit), ("g/h.py", "x"),
    ]
    df = spark.createDataFrame([(p, t, "clash", 1.5) for p, t in rows], "path string, text string, licence string, cosine double")
    got = [(r.path, r.licence, r.cosine and round(r.cosine, 6), r.how, r.licence_path) for r in license_scan.scan_licences(df).collect()]
    named = [(p, t, bool(p and re.match(license_scan.LICENCE_FILE, p.rpartition("/")[2]))) for p, t in rows]
    assert sorted(got, key=str) == sorted(brute_licences(named), key=str)
    by = {r[0]: r for r in got}
    assert by["a/b/c/d/z.py"][1:] == ("Apache-2.0", by["a/b/c/x.py"][2], "inherited", "a/b/LICENSE.txt") and by["top.py"][1] == "MIT"
    assert license_scan.scan_licences(df.limit(0)).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nIt has numbers."),
        (1, 1, "assistant", "Use sorted().\n\nIt returns a new list."),
        (1, 2, "user", "On Monday the assistant wrote:\n> Use   SORTED().\n>> How do I sort a list?\n>> It has numbers.\nThanks, and reversed?"),
        (1, 3, "assistant", "> > How do I sort a list?\nanswer to the first"),
        (1, 4, "user", "> It returns a new list.\n> Never said.\nfine"),
        (1, 5, "user", "no quotes, On x wrote:"),
        (1, 6, "user", "> Thanks, and reversed?\nyes"),
        (2, 0, "user", "> Use sorted().\nother conversation"),
        (2, 1, "user", None), (2, 2, "user", ""), (2, 3, "user", ">\n> \n>>"), (None, 0, "user", "> Use sorted()."), (3, None, "user", "> x"),
        (2, 4, "user", "> other conversation"), (2, 4, "user", "> other conversation"), (2, 5, "user", "> later line"), (2, 6, "user", "later line"),
        (4, 0, "user", "a > b\n" * 4000 + "x"), (4, 1, "user", "> a > b\n" * 4000 + "> x"),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, thread int")
    got = {}
    out = quotation.link_quotes(df).collect()
    assert len(out) == len(rows)
    for r in out:
        got[r.conv_id, r.turn] = r
    pick = lambda c, t: (got[c, t].reply_to, got[c, t].thread, got[c, t].n_quotes, got[c, t].n_linked, got[c, t].depth)
    assert pick(1, 0) == (None, 0, 0, 0, 0)
    assert pick(1, 2) == (1, 1, 2, 2, 2) and got[1, 2].text == "Thanks, and reversed?"
    assert pick(1, 3) == (0, 0, 1, 1, 2) and got[1, 3].text == "answer to the first"
    assert pick(1, 4)[:4] == (None, 4, 1, 0)  # a passage joins as a whole
    assert got[1, 5].text == "no quotes, On x wrote:"
    assert pick(1, 6)[:2] == (2, 1)  # two steps up the chain
    assert pick(2, 0)[:4] == (None, 0, 1, 0)
    assert got[2, 1].text is None and pick(2, 3)[3] == 0
    assert pick(2, 4)[:2] == (0, 0) and pick(2, 5)[0] is None
    assert pick(4, 1)[:4] == (0, 0, 1, 1)
    assert quotation.link_quotes(df.limit(0)).count() == 0


def test_quotes_of_parts(spark):
    rows = [
        (1, 0, "one a\ntwo b\nthree c\nfour d\nfive e"), (1, 1, "> two b\n> four d\ntwo of five lines"),
        (1, 2, "first par\nof two lines\n\nsecond par\n\nthird par"), (1, 3, "> first par of\n> two lines\n>\n> third par\ntwo of three paragraphs, wrapped anew"),
        (1, 4, "> two b\n> four d\n> unknown\nmore than half is known"), (1, 5, "> two b\n> unknown\nonly half is known"),
        (1, 6, "two b\nthird par"), (1, 7, "> two b\n> second par\n> third par\nmost are of 2"),
        (2, 0, "hello"), (2, 1, "Agreed.\n\nOn Sun, A wrote:\n> hello"), (2, 2, "Me too.\n\nOn Mon, B wrote:\n> Agreed.\n>\n> On Sun, A wrote:\n>> hello"),
        (2, 3, "On Tue, C wrote:"), (2, 4, "> On Tue, C wrote:\nso?"),
        (3, 0, "Hi,\nalpha"), (3, 1, "Hi,\nbeta\ngamma"), (3, 2, "> Hi,\n> gamma\nthe first holder of a line is not the one of most"), (3, 3, "Hi,\ngamma"), (3, 4, "> gamma\n> Hi,\nequal ones: the first"),
        (4, 0, "> later a\n> later b\nx"), (4, 1, "later a\n-\nlater b"), (4, 2, "a\nb\nc\nd"), (4, 3, "> a\n> c\n> d"), (4, 4, "a\nc\nd"), (4, 5, "> d\n> a\n> c\n> e"),
        (5, 0, "a\nb"), (5, 1, "> a\n> a"), (5, 2, "> b\n>\n> b"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.n_linked) for r in quotation.link_quotes(df).collect()}
    assert got[1, 1] == (0, 0, 1) and got[1, 3] == (2, 2, 1)
    assert got[1, 4] == (0, 0, 1) and got[1, 5] == (None, 5, 0)
    assert got[1, 7][0] == 2
    assert got[2, 1] == (0, 0, 1) and got[2, 2] == (1, 0, 2) and got[2, 4] == (3, 3, 1)
    assert got[3, 2] == (1, 1, 1) and got[3, 4] == (1, 1, 1)
    assert got[4, 0] == (None, 0, 0) and got[4, 3] == (2, 2, 1) and got[4, 5] == (2, 2, 1)
    assert got[5, 1] == (0, 0, 1) and got[5, 2] == (0, 0, 1)  # one line, said over and over
