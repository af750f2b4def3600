"""The per-text operators against plain re-computations, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quern.llm import common, decontaminate, language_id, mixing, queries, repetition, secrets, url_filter

TEXTS = [None, "", " ", "a", "a a a a a", "one two three four five " * 30, "Ünï cödé ſecret K \U0001f600 x", "line\nline\n\n \nline two", "x\u00a0y\u2003z", "\t\r\n mixed\x0bwhite\x0cspace ", "#*$%&|<>"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, None if i % 3 == 0 else f"s{i % 4}", "en", 5) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, size long")


# -- word hashes


def test_word_hashes_split_like_the_pattern():
    for t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = common.word_hashes((t or "").encode(), lower=False)
        assert len(h) == len(w)
        assert [x == y for x in w for y in w] == [bool(x == y) for x in h for y in h]


# -- 4


def brute_url(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in url_filter.RULES:
        site, rest = rule.split("/", 1)
        if (host == site or host.endswith("." + site)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1", "https://example.org", "https://example.org/", "http://a.example.org/en/12?x=://y", "http://x.com/fr/9#z", "http://com/de/", "http://notorg/", "http://é.org/\n/x?q", "a://b://c/d", "http://h?x/y", "http://casino-poker.bet.example.net/slots/1"]
    df = spark.createDataFrame([(i, u, "z", "z") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in url_filter.judge_urls(df, url_filter.train(url_filter.labelled_urls(spark))).collect()}
    for i, u in enumerate(urls):
        host, path, best = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[1]), u
        assert got[i].verdict == (best[0] if best else "block" if got[i].p_block >= 0.5 else "allow")
    assert got[len(urls) - 1].verdict == "block"


# -- 5


def test_url_classifier(spark):
    labelled = url_filter.labelled_urls(spark)
    right = url_filter.accuracy(spark)
    print(right)
    assert sum(right) / len(right) > 0.7
    model = url_filter.train(labelled)
    urls = [None, "", "x", "https://www.best-casino-poker.com/slots/jackpot", "https://library.university.example.org/research/notes", "https://library.university.example.org/research/notes", "http://a.com/" + "casino/" * 20_000]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [r.verdict for r in url_filter.judge_urls(pages, model).orderBy("page_id").collect()]
    assert got[3:] == ["block", "allow", "allow", "block"] and got[:3] == ["allow"] * 3
    assert url_filter.judge_urls(pages.limit(0), model).count() == 0
    assert url_filter.train(labelled.limit(0)) is None
    assert {r.verdict for r in url_filter.judge_urls(pages, None).collect()} == {"allow"}


def test_targets_and_seats():
    goal = mixing.targets([100, 10, 1, 0], [5, 2, 1, 5])
    assert sum(goal) == pytest.approx(111) and goal[1] == 30 and goal[2] == 3 and goal[3] == 0
    rng = random.Random(3)
    for _ in range(50):
        shares, house = [rng.choice([0, 1, 2.5, 7, 100]) for _ in range(6)], rng.randrange(40)
        if not any(shares):
            continue
        seats = [0] * 6
        for _ in range(house):
            i = max((i for i in range(6) if shares[i]), key=lambda i: (shares[i] / (2 * seats[i] + 1), -i))
            seats[i] += 1
        assert mixing.sainte_lague(shares, house, [house + 1] * 6) == seats


def test_shard_quotas_add_up():
    recipe = [mixing.Share("a", 1, 900, 700.0, 14, 11), mixing.Share("b", 1, 100, 250.0, 2, 4), mixing.Share(None, 1, 10, 30.0, 1, 1)]
    quotas = mixing.shard_quotas(recipe, 5)
    assert [sum(q[i] for q in quotas) for i in range(3)] == [11, 4, 1]
    assert all(n >= 0 for q in quotas for n in q) and max(map(sum, quotas)) - min(map(sum, quotas)) <= 1


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 400))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + [(400, None, "a"), (1, "again", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((i, len((t or "").split())) for i, t, _ in rows)
    by = Counter()
    for (i, t, s) in rows:
        by[s] += len((t or "").split())
    names = sorted(by, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([by[s] for s in names], [5, 2, 1, 5][: len(names)]), strict=True))
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        assert r.taken == sum((p["last"] - p["first"]) * p["times"] for p in r.passes)
        s = next(s for s in names if by[s] == r.source_size)
        taken[s] += r.taken
        assert r.target == pytest.approx(goal[s])
    assert all(abs(taken[s] - goal[s]) <= 100 for s in names)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r["size"], r.taken) for r in again) == sorted((r.doc_id, r["size"], r.taken) for r in got)


def brute_mix(rows, recipe, shards, seed=17):
    """``{id: (taken, by_shard)}`` by laying every source's tape out word by word."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def hashed(i):
        start = xxhash.xxh64(seed.to_bytes(4, "little"), seed=42).intdigest()
        return signed(xxhash.xxh64(i.to_bytes(8, "little", signed=True), seed=start).intdigest())

    quotas, out = mixing.shard_quotas(recipe, shards), {}
    for at, r in enumerate(recipe):
        mine = [(i, len((t or "").split())) for i, t, s in rows if s == r.source]
        segments = max(1, r.rows // mixing.SEGMENT_ROWS)
        mine.sort(key=lambda x: ((hashed(x[0]) >> 20) % segments, hashed(x[0]), x[0], x[1]))
        tape = [i for i, n in mine for _ in range(n)]
        cuts = [0]
        for j in range(r.blocks):
            cuts.append(cuts[-1] + r.size // r.blocks + (j < r.size % r.blocks))
        a, b = mixing._shuffle(r.blocks, seed, r.source)
        turn = sorted(range(r.blocks), key=lambda j: (a * j + b) % r.blocks)
        taken = [j for _ in range(r.seats // r.blocks) for j in range(r.blocks)] + turn[: r.seats % r.blocks]
        shard = [s for s in range(shards) for _ in range(quotas[s][at])]
        for i, _ in mine:
            out[i] = [0] * shards
        for j, s in zip(taken, shard, strict=True):
            for i in tape[cuts[j] : cuts[j + 1]]:
                out[i][s] += 1
    return out


@pytest.mark.parametrize("segment", [2_000, 20])
def test_mix_against_tapes_laid_out(spark, monkeypatch, segment):
    monkeypatch.setattr(mixing, "SEGMENT_ROWS", segment)
    rng = random.Random(6)
    rows = [(i - 40, " ".join("w" * rng.randrange(0, 500)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(1000, "", "none"), (1001, "x", "one"), (1002, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    recipe = mixing.make_recipe(df.select("source", mixing.words(df.text).alias("size")))
    got = {r.doc_id: list(r.by_shard) for r in mixing.mix(df, shards=3).withColumn("by_shard", mixing.by_shard("passes", 3)).collect()}
    assert got == brute_mix(rows, recipe, 3)


def test_mix_of_a_source_beyond_any_product(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (2, "d", "t")], "doc_id long, text string, source string")
    size = 3 * 10**14
    recipe = [mixing.Share("s", 2, size, size / 2, size // 64, size // 128), mixing.Share("t", 1, 1, 1.0, 1, 1)]
    assert {r.doc_id: r.source_size for r in mixing.mix(df, recipe).collect()} == {1: size, 2: 1}


def test_mix_shards(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 400))), rng.choice(["a", "a", "a", "a", "b", None])) for i in range(300)] + [(300, "one two three", "tiny"), (301, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    recipe = mixing.make_recipe(df.select("source", mixing.words(df.text).alias("size")))
    assert any(r.seats > r.blocks for r in recipe) and any(0 < r.seats < r.blocks for r in recipe)
    plain = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    for shards in (1, 5):
        got = mixing.mix(df, keep=("source",), shards=shards).withColumn("by_shard", mixing.by_shard("passes", shards)).collect()
        assert {r.doc_id: r.taken for r in got} == plain
        have = Counter()
        for r in got:
            assert sum(r.by_shard) == r.taken and len(r.by_shard) == shards
            for p in r.passes:
                have[r.source, p["shard"]] += (p["last"] - p["first"]) * p["times"]
        quotas = mixing.shard_quotas(recipe, shards)
        assert all(min(q) >= 0 for q in quotas) and max(map(sum, quotas)) - min(map(sum, quotas)) <= 1
        for s, quota in enumerate(quotas):  # blocks of a source differ by one word at most
            for r, n in zip(recipe, quota, strict=True):
                low = r.size // r.blocks
                assert n * low <= have[r.source, s] <= n * (low + 1)
                # A shard is at the mix itself: its seats are within a few of an equal share.
                assert abs(n - r.seats / shards) <= 2


# -- 6


def brute_phrases(text, train):
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) + 1 and text[at : at + k] in train:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_cross_parsing_counts_longest_matches():
    parser = language_id.Parser.train({"x": ["abracadabra abacus"]})
    train = "".join(map(chr, language_id.letters("abracadabra abacus"))) + "\0"
    for text in ("abracadabra", "zzz", "cadabz abac", "usabra"):
        folded = language_id.letters(text)
        assert parser.phrases([folded])[0, 0] == brute_phrases("".join(map(chr, folded)), train)


def test_languages(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, language_id.train(docs), keep=("doc_id", "lang")).withColumn("held_out", language_id.held_out()).toPandas()
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_every_label_and_every_letter_counts(spark):
    rng = random.Random(9)
    syllables = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2)) for _ in range(400)]
    lexicon = {f"l{k:02}": ["".join(rng.choices(syllables, k=3)) for _ in range(60)] for k in range(65)}
    rows = [(i, " ".join(rng.choices(lexicon[name], k=40)), name) for i, name in enumerate(list(lexicon) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parser = language_id.train(docs)
    assert parser.names == sorted(lexicon)
    got = language_id.identify(docs, parser, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    # A letter beyond U+30000 is a letter; scripts of many signs keep apart.
    signs = {name: ["".join(chr(rng.randrange(a, b)) for _ in range(3)) for _ in range(100)] for name, a, b in (("zh", 0x4E00, 0x9000), ("ja", 0x3041, 0x3090), ("ko", 0xAC00, 0xD700), ("old", 0x30000, 0x31000))}
    some = language_id.Parser.train({n: ["".join(rng.choices(c, k=200)) for _ in range(20)] for n, c in signs.items()})
    assert [some.predict(["".join(rng.choices(c, k=50))])[0][0] for c in signs.values()] == list(signs)


def test_long_texts_parse_in_blocks():
    rng = random.Random(4)
    train = "".join(rng.choices("abcd", k=400))
    parser = language_id.Parser.train({"x": [train]})
    text = "".join(rng.choices("abcde", k=1000))
    blocks = [text[i : i + language_id.BLOCK] for i in range(0, len(text), language_id.BLOCK)]
    assert parser.phrases([language_id.letters(text)])[0, 0] == sum(brute_phrases(b, train + "\0") for b in blocks)


def test_language_edges(spark):
    parser = language_id.Parser.train({"en": ["the cat and the dog"], "de": ["der hund und die katze"]})
    got = language_id.identify(frame(spark, [None, "", "123 !?", "the cat", "der hund"]), parser).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "de"]
    assert language_id.identify(frame(spark, ["a"]), language_id.Parser([], [], [])).first().lang_pred == "und"
    assert language_id.identify(frame(spark, ["a"]).limit(0), parser).count() == 0


def test_no_language_is_lost(spark):
    """Rows that share one id, rows that repeat, one row only; a sample no larger than its bound."""
    rng = random.Random(5)
    word = lambda a: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz"[a : a + 12], k=5))
    free = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(free[k % 5], " ".join(word(0) for _ in range(30)), "shared") for k in range(2000)]
    rows += [(free[7], "the same row of text again", "repeated")] * 1500 + [(free[8], "einzig hier", "single")]
    rows += [(i, " ".join(word(14) for _ in range(30)), f"many{i % 40:02}") for i in range(100, 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = language_id.sample(docs, train_docs=16).groupBy("lang").count().collect()
    sizes = {r.lang: r["count"] for r in taken}
    assert len(sizes) == 43 and max(sizes.values()) == 16
    assert (sizes["shared"], sizes["repeated"], sizes["single"]) == (16, 1, 1)
    parser = language_id.train(docs, train_docs=16)
    assert parser.names == sorted(sizes) and len(parser.tables) == 43
    alone = language_id.Parser.train({"x": ["abracadabra abacus cadabra"]})
    there = language_id.train(spark.createDataFrame([(free[0], "abracadabra abacus cadabra", "x")], "doc_id long, text string, lang string"))
    assert (alone.tables[0].owner == there.tables[0].owner).all() and (alone.tables[0].next == there.tables[0].next).all()


# -- 7


def test_decontaminate(spark):
    rng = random.Random(5)
    vocab = ["the", "of", "and", "été", "x1", "zz", "q"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 5, 9, 10, 11, 30])))) for i in range(100, 140)] + [(7, None), (None, "the of and"), (8, "...")]
    docs = [(i, ", ".join(rng.choice([*vocab, "other", "more", "words"]).upper() for _ in range(rng.choice([0, 3, 40, 300]))), 1) for i in range(60)] + [(90, None, 1), (91, "", 1), (92, items[7][1] + "! " + items[9][1], 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    plain = [(i, decontaminate.bench_words(t)) for i, t in items if i is not None]
    want = sorted((i, *decontaminate.brute_digest(decontaminate.bench_words(t), plain)) for i, t, _ in docs)
    assert sorted(map(tuple, decontaminate.digest(decontaminate.find_overlap(d, b)).collect())) == want
    assert sorted(map(tuple, decontaminate.digest(decontaminate.find_overlap(d, b, pass_windows=150)).collect())) == want
    assert [r.n_hit for r in decontaminate.digest(decontaminate.find_overlap(d, b.limit(0))).collect()] == [0] * len(docs)


def test_passes_find_what_one_pass_finds(spark):
    rng = random.Random(12)
    words = ["w%d" % i for i in range(12)]
    items = [(f"item-{k}", " ".join(rng.choices(words, k=rng.choice([0, 2, 4, 12, 30])))) for k in range(40)] + [("none", None), (None, "w1 w2")]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(80)] + [(3, None), (5, "w1 w2 w3")]
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in docs], "doc_id long, text string, items string, n_words double")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {}
    for most in (5, 100_000):
        found = decontaminate.find_overlap(df, bench, size=4, keep=("items",), pass_windows=most)
        assert found.columns == ["doc_id", "n_words", "spans", "items", "kept_items"]
        got[most] = sorted(tuple(r) for r in decontaminate.digest(found).collect())
    known = [(i, decontaminate.bench_words(t)) for i, t in items if i is not None]
    brute = sorted((i, *decontaminate.brute_digest(decontaminate.bench_words(t), known, 4)) for i, t in docs)
    assert got[5] == got[100_000] == brute and sum(r[-1] for r in brute) > 20


def test_bench_words_pattern():
    for t in [*TEXTS, "A-b_c'd É1\x7f2"]:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        assert decontaminate.bench_words(t) == [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


# -- 9


def brute_repetition(text, least=repetition.MIN_REPEAT):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    tri = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    hit = {i + k for i in range(n - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
    best = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    cover = {p for i in range(n) if best[i] >= least for p in range(i, i + best[i])}
    longest = max([b for b in best if b >= 3], default=0)
    maximal = set()
    for m in {b for b in best if b >= least}:
        for i in range(n - m + 1):
            w = tuple(words[i : i + m])
            at = [j for j in range(n - m + 1) if tuple(words[j : j + m]) == w]
            ends = {words[j + m] if j + m < n else j for j in at}
            fronts = {words[j - 1] if j else -1 for j in at}
            if len(at) > 1 and len(ends) > 1 and len(fronts) > 1:
                maximal.add(w)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), len(maximal) if len({b for b in best}) < 400 else None, len(cover), longest


def test_repetition(spark):
    rng = random.Random(9)
    more = [" ".join(rng.choice("abc") for _ in range(k)) for k in (3, 20, 60, 120)] + [" ".join(rng.choice(["w%d" % i for i in range(40)]) for _ in range(150)) for _ in range(4)]
    phrase = " ".join(f"p{i}" for i in range(25))
    more += [f"{phrase} mid {phrase} end {phrase[:60]}", "same line here\n" * 30, ("a b " * 40).strip()]
    got = repetition.judge_repetition(frame(spark, TEXTS + more)).orderBy("doc_id").collect()
    for r, t in zip(got, TEXTS + more, strict=True):
        want = brute_repetition(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[:5], t
        assert (r.covered, r.longest) == want[6:], t
        assert r.n_maximal >= want[5] if want[5] else r.n_maximal == 0, t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        limits = r.covered > repetition.MAX_COVERED * r.n_words or (r.longest > repetition.MAX_LONGEST and r.longest > repetition.MAX_LONGEST_PART * r.n_words)
        assert r.kept == (not r.base_failed and not limits)


def test_repetition_rejects_what_the_base_lets_pass(spark):
    """A third of the words in repeats of ten words or more; one repeat of over fifty words; texts with little of either."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    thirds = [f"{words('p', 26)} {words('a', 60 + k)} {words('p', 26)}" for k in range(5)]
    passage = [f"{words('q', 60)} {words('b', 140 + k)} {words('q', 60)}" for k in range(5)]
    fine = [f"{words('p', 9)} {words('a', 30)} " * 1 + f"{words('p', 9)} {words('c', 20 + k)}" for k in range(5)] + [f"{words('p', 40)} {words('a', 400)} {words('p', 40)}"]
    got = repetition.judge_repetition(frame(spark, thirds + passage + fine)).orderBy("doc_id").collect()
    assert not any(r.base_failed for r in got)
    assert [r.kept for r in got] == [False] * 10 + [True] * 6


# -- 10


def test_secrets(spark):
    texts = [*TEXTS, 'password = "abcdefgh1"', "PassWd:short", "api_key=12345678 apikey: 'ABCDEFGH.x'", "AKIAABCDEFGHIJKL AKIA123", "é" * 3 + " token = " + "ab12" * 10, "f" * 31 + " " + "0" * 32, "token : token=abcdefgh", "ſecret=abcdefghi", "the authorization was: 9fKx2LmQ8vTz4RwYb7Nc ok", "the signature of internationalization"]
    rows = secrets.digest(secrets.scan_secrets(frame(spark, texts))).orderBy("doc_id").collect()
    kinds = [("assign", r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]
    for r, t in zip(rows, texts, strict=True):
        t = t or ""
        found = [(m.start(), k, kind, m.end()) for k, (kind, p, g, n) in enumerate(kinds) for m in re.finditer(p, t, re.ASCII) if len(m[g]) >= n]
        base = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))
    assert "novel" in rows[-2].spans and rows[-1].spans == ""


def brute_novel(text, known, novelty):
    """Every hint and every token from it on, without a bound on the token's end; each line's tokens are measured against its rest."""
    met, done = [], -1
    for hint in secrets._SENSITIVE.finditer(text):
        for m in secrets._TOKEN.finditer(text, max(hint.end(), done)):
            if m.start() - hint.end() > secrets.CONTEXT:
                break
            if any(a < m.end() and m.start() < b for a, _, b in known):
                continue
            done = m.end()
            met.append((m.start(), m.end()))
    out, at = [], 0
    for line in text.split("\n"):
        here = [(i, j) for i, j in met if at <= i < at + len(line)]
        bare = "".join("\n" if any(k == i - at for i, _ in here) else c for k, c in enumerate(line) if not any(i - at < k < j - at for i, j in here)).replace("\n", " ")
        if here:
            out += [(i, 3, j) for (i, j), rate in zip(here, novelty.rates(bare, [text[i:j] for i, j in here]), strict=True) if rate >= secrets.MIN_NOVELTY]
        at += len(line) + 1
    return out


def test_novelty_does_not_depend_on_length_or_alphabet():
    rng, novelty = random.Random(3), secrets.Novelty()
    for signs in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
        for n in (16, 24, 64, 100, 200, 9000):
            for _ in range(10):
                key = signs[-1] + "".join(rng.choices(signs, k=n))
                text = f"a line before\nmy credential is {key} here"
                assert [(i, j) for i, _, j in secrets.novel_spans(text, [], novelty)] == [(31, 32 + n)]
    # Long words are cheap by the primer, in whatever case.
    for word in ("internationalization", "characteristically", "INTERNATIONALIZATION", "Misrepresentation", "telecommunications", "counterrevolutionary", "interdisciplinary"):
        assert not secrets.novel_spans(f"the token {word} of it", [], novelty), word
    for name in ("my_secret_key_identifier_name1", "xxxxxxxxxxxxxxxxxxxxxxx1", "abcdefghijklmnopqrstuvwxyz0123456789"):
        assert not secrets.novel_spans(f"the token {name} of it", [], novelty)
    # A token that its own line spells out is not new, however far away.
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=40)) + "7"
    assert not secrets.novel_spans(f"{key} {'word ' * 500} the secret {key}", [], novelty)


def test_kept_columns_with_the_names_of_new_ones(spark):
    df = frame(spark).selectExpr("doc_id", "text", "lang AS spans", "lang AS n_words", "lang AS score")
    assert secrets.scan_secrets(df, keep=("doc_id", "spans")).columns == ["doc_id", "kept_spans", "spans"]
    assert repetition.judge_repetition(df, keep=("doc_id", "n_words")).columns[:3] == ["doc_id", "kept_n_words", "n_words"]
    parser = language_id.Parser.train({"en": ["the cat"]})
    assert {r.kept_score for r in language_id.identify(df, parser, keep=("doc_id", "score")).collect()} == {"en"}


def test_empty_repeated_and_long_rows(spark):
    long = "the secret is k3JvQ9xLm2Pq8RtZ and more words " * 40_000
    rows = [(1, "one two three"), (1, "one two three"), (2, long), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parser = language_id.Parser.train({"en": ["the secret is and more words"]})
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    for run in (lambda d: secrets.digest(secrets.scan_secrets(d)), repetition.judge_repetition, lambda d: language_id.identify(d, parser), lambda d: decontaminate.digest(decontaminate.find_overlap(d, bench))):
        assert run(df.limit(0)).count() == 0
        got = [tuple(r) for r in run(df).orderBy("doc_id").collect()]
        assert len(got) == 4 and got[0] == got[1]


def test_long_secrets(spark):
    rng = random.Random(8)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = lambda n: "".join(rng.choice(chars) for _ in range(n))
    texts = [f"the private key is {key(n)} end" for n in (15, 16, 4000, 4096, 4200, 50_000)]
    texts += [f"credential{' ' * gap}{key(5000)}" for gap in (39, 40, 41)] + [f"bearer {key(20)} {key(9000)}", "auth " + "secret".join(key(1500) for _ in range(6))]
    rows = secrets.digest(secrets.scan_secrets(frame(spark, texts))).orderBy("doc_id").collect()
    assert [r.spans for r in rows[1:6]] == [f"novel:19:{len(t) - 4}" for t in texts[1:6]]
    assert [r.spans for r in rows[6:9]] == ["novel:49:5049", "novel:50:5050", ""]
    novelty = secrets.Novelty()
    pieces = lambda: rng.choice(["secret", "auth ", "token=", " ", "\n", "AKIA", "é", key(15), key(16), key(40), key(4300), "0" * 32, "words and "])
    for text in [*texts, *("".join(pieces() for _ in range(rng.randrange(2, 14))) for _ in range(300))]:
        known = secrets.base_spans(text)
        assert secrets.novel_spans(text, known, novelty) == brute_novel(text, known, novelty), text


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert {k.split("_")[0] for k in queries.QUERIES} <= {k.split("_")[0] for k in entry.queries()}
    assert math.isfinite(np.float64(1))


def test_mix_without_ids(spark):
    """Rows without an id or of one id spread over the tape by their texts, and reruns cut the same ones."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 5]), " ".join(f"w{rng.randrange(99)}" for _ in range(50)), rng.choice("ab")) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(((r.text, r.doc_id or -1, r.taken, str(r.passes)) for r in mixing.mix(d, keep=("text",)).collect())) for d in (df, df.repartition(5).orderBy("text")))
    assert one == two and len(one) == 300
