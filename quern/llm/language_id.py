"""Operator 6: language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built (a bounded
sample). A text is parsed against it into phrases, each the longest match that
the automaton holds; the language that needs the fewest phrases per symbol
wins. Texts are parsed many at a time: fixed-length blocks of their symbols
walk the automata in step, a phrase also ending at a block's end. An
automaton's rows lie interleaved in one array, so that it takes a few bytes
per transition, whatever the alphabet.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, keep_apart, slices

#: Documents of the sample, at most, for each language, and symbols kept of all of them.
TRAIN_DOCS, TRAIN_SYMBOLS = 128, 20_000
#: Every label is learned; more than this many, of about 1 MB each in each task, are refused.
MAX_LANGUAGES = 300
#: Symbols of one parsed block.
BLOCK = 256
#: Symbol classes: 0 is a run of non-letters, then frequent letters, then hashed rare ones.
FREQUENT, HASHED = 3000, 1000
#: Scores: how steeply a difference in phrases per symbol turns into certainty.
STEEP = 60.0


def _fold() -> np.ndarray:
    """Code point -> its lower-case code point; 0 for what is not a letter."""
    out = np.zeros(0x110000, dtype=np.int32)
    for cp in range(len(out)):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


_FOLD: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Lower-case letters of a text as code points, other runs as one 0, none at the ends."""
    if not _FOLD:
        _FOLD.append(_fold())
    folded = _FOLD[0][np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")]
    keep = folded > 0
    keep[1:] |= folded[:-1] > 0
    folded = folded[keep]
    start = int(len(folded) > 0 and folded[0] == 0)
    return folded[start : len(folded) - int(len(folded) > start and folded[-1] == 0)]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


class Automaton:
    """Transitions in one array: those of state ``p`` are at ``base[p] + symbol`` where ``owner`` says so."""

    def __init__(self, go: list[dict[int, int]], width: int):
        self.base = np.zeros(len(go), dtype=np.int32)
        slots = sum(map(len, go[1:])) * 2 + 2 * width
        self.owner, self.next = np.full(slots, -1, dtype=np.int32), np.zeros(slots, dtype=np.int32)
        # Where a phrase starts anew; a symbol that the language lacks is a phrase of its own.
        self.root = np.zeros(width, dtype=np.int32)
        self.root[list(go[0])] = list(go[0].values())
        used = np.zeros(slots + width, dtype=bool)
        sizes = np.fromiter(map(len, go), dtype=np.int64)
        sizes[0] = at = kind = 0
        for p in sorted(np.flatnonzero(sizes > 1).tolist(), key=lambda p: -sizes[p]):
            symbols = np.fromiter(go[p], dtype=np.int64)
            offsets = symbols - symbols[0]
            # States of as many transitions look on where the one before found its place.
            if kind != len(symbols):
                at, kind = width + int(np.argmin(used[width:])), len(symbols)
            while True:
                tries = at + np.flatnonzero(~used[at : at + 256])
                fits = tries[~used[tries[:, None] + offsets].any(axis=1)]
                if len(fits):
                    break
                at += 256
            at = int(fits[0])
            place = at + offsets
            used[place] = True
            self.base[p] = at - symbols[0]
            self.owner[place] = p
            self.next[place] = np.fromiter(go[p].values(), dtype=np.int64)
        # States with one transition, the most by far, fill what is free.
        ones = np.flatnonzero(sizes == 1)
        place = width + np.flatnonzero(~used[width : len(self.owner)])[: len(ones)]
        used[place] = True
        self.base[ones] = place - np.fromiter((next(iter(go[p])) for p in ones.tolist()), dtype=np.int64, count=len(ones))
        self.owner[place] = ones
        self.next[place] = np.fromiter((next(iter(go[p].values())) for p in ones.tolist()), dtype=np.int64, count=len(ones))
        last = int(np.flatnonzero(used)[-1]) + 1 if used.any() else 0
        self.owner, self.next = self.owner[: last + width], self.next[: last + width]

    @classmethod
    def of(cls, base: np.ndarray, owner: np.ndarray, next_: np.ndarray, root: np.ndarray) -> Automaton:
        """From arrays that another process made."""
        self = cls.__new__(cls)
        self.base, self.owner, self.next, self.root = base, owner, next_, root
        return self

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether the symbol starts a phrase."""
        at = self.base.take(state) + symbol
        inside = self.owner.take(at) == state
        return np.where(inside, self.next.take(at), self.root.take(symbol)), ~inside


class Parser:
    """The trained languages: a symbol table and one automaton each."""

    def __init__(self, names: list[str], alphabet: list[int], tables: list[Automaton]):
        self.names, self.alphabet, self.tables = names, alphabet, tables

    @classmethod
    def over(cls, texts: dict[str, list[str]], symbols: int = TRAIN_SYMBOLS) -> tuple[Parser, list[np.ndarray]]:
        """A parser without automata, and the symbols that each language's is built of: its texts, interleaved up to ``symbols`` in all."""
        coded = {name: [letters(t) for t in group] for name, group in sorted(texts.items())}
        count = Counter(c for group in coded.values() for t in group for c in t.tolist() if c)
        alphabet = [c for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]]
        self, joined = cls(list(coded), alphabet, []), []
        for group in coded.values():
            each = max(1, symbols // max(1, len(group)))
            joined.append(self.symbols(np.concatenate([np.concatenate([t[:each], [0]]) for t in group] or [np.zeros(0, dtype=np.int32)])))
        return self, joined

    @classmethod
    def train(cls, texts: dict[str, list[str]], symbols: int = TRAIN_SYMBOLS) -> Parser:
        """From labelled texts, in this process."""
        self, joined = cls.over(texts, symbols)
        self.tables = [Automaton(suffix_automaton(x.tolist()), 1 + FREQUENT + HASHED) for x in joined]
        return self

    def symbols(self, folded: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_lut"):
            lut = (np.arange(0x110000) % HASHED + 1 + FREQUENT).astype(np.int32)
            lut[0] = 0
            lut[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
            self._lut = lut
        return self._lut[folded]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text needs, one column per language."""
        sizes = np.array([len(t) for t in texts])
        parts = -(-sizes // BLOCK)
        owner, total = np.repeat(np.arange(len(texts)), parts), int(parts.sum())
        grid = np.zeros((total, BLOCK), dtype=np.int32)
        at = np.concatenate([[0], np.cumsum(parts)])
        flat = grid.reshape(-1)
        for i, t in enumerate(texts):
            flat[at[i] * BLOCK : at[i] * BLOCK + len(t)] = self.symbols(t)
        left = np.minimum(BLOCK, sizes[owner] - (np.arange(total) - at[:-1][owner]) * BLOCK)
        order = np.argsort(-left, kind="stable")
        steps = np.ascontiguousarray(grid[order].T)
        active = np.searchsorted(-left[order], -np.arange(BLOCK), side="left")  # blocks longer than j
        out = np.zeros((len(texts), len(self.tables)), dtype=np.int64)
        for k, table in enumerate(self.tables):
            state, count = np.zeros(total, dtype=np.int32), np.zeros(total, dtype=np.int64)
            for j in range(BLOCK):
                n = active[j]
                if not n:
                    break
                state[:n], fresh = table.step(state[:n], steps[j, :n])
                count[:n] += fresh
            count[order] = count.copy()
            np.add.at(out[:, k], owner, count)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score and phrases per symbol of each text."""
        folded = [letters(t) if t else np.zeros(0, dtype=np.int32) for t in texts]
        some = [i for i, t in enumerate(folded) if len(t)]
        out: list[tuple[str, float, float]] = [("und", 0.0, 0.0)] * len(texts)
        if some and self.tables:
            sizes = np.array([len(folded[i]) for i in some])
            rate = self.phrases([folded[i] for i in some]) / sizes[:, None]
            best = rate.argmin(axis=1)
            weight = np.exp(STEEP * (rate.min(axis=1)[:, None] - rate))
            score = 1.0 / weight.sum(axis=1)
            for i, b, s, r in zip(some, best.tolist(), score.tolist(), rate.min(axis=1).tolist(), strict=True):
                out[i] = (self.names[b], s, r)
        return out


def held_out(id_col: str = "doc_id") -> Column:
    """True for the documents that training never sees; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, symbols: int = TRAIN_SYMBOLS) -> DataFrame:
    """``(lang, drawn, text)``: the ``train_docs`` labelled passages of each language that are drawn first, all if there are fewer.

    Rows are drawn by a hash of id and text, and rows with both in common once,
    so that a language is in the sample however its rows repeat or share ids.
    """
    usable = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    span, share = 1 << 40, 2 * max(1, symbols // train_docs)
    key = F.xxhash64(F.lit(23), F.col(id_col), F.col(text_col))
    start = F.pmod(F.xxhash64(F.lit(29), F.col(id_col)), F.greatest(F.lit(1).cast("long"), F.length(text_col) - share + 1)).cast("int") + 1
    drawn = usable.select(F.col(lang_col).alias("lang"), F.pmod(key, F.lit(span)).alias("drawn"), F.col(text_col).alias("text"), start.alias("start"))
    sizes = {r.lang: r["n"] for r in drawn.groupBy("lang").agg(F.approx_count_distinct("drawn").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # Some four times as many as are wanted go on, so that no language's rows are sorted as a whole.
    most = F.lit(-1).cast("long")
    for name, n in sorted(sizes.items()):
        most = F.when(F.col("lang") == name, F.lit(span if n <= 8 * train_docs else span * 4 * train_docs // n)).otherwise(most)
    some = drawn.filter(F.col("drawn") < most).select("lang", "drawn", F.substring("text", F.col("start"), F.lit(share)).alias("text")).dropDuplicates(["lang", "drawn"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("drawn"))
    return some.withColumn("place", place).filter(F.col("place") <= train_docs).drop("place")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, symbols: int = TRAIN_SYMBOLS) -> Parser:
    """Fit on a bounded sample: at most ``train_docs`` labelled documents of each language (``sample``).

    Held-out rows and rows without id, text or language are not used. The
    sample's bounds are ``train_docs`` documents and ``symbols`` symbols a
    language; of each document it takes one passage, from a place drawn by its
    id, twice as long as its even share of the symbols (white space and digits
    fold). Rows that share an id are drawn by their texts; equal rows count
    once. Only the passages come to the driver, and the finished automata, some
    100 KB to 1 MB a language; each language's is built in a task of its own.
    """
    spark = docs.sparkSession
    texts: dict[str, list[str]] = {}
    for r in sorted(sample(docs, id_col, text_col, lang_col, train_docs, symbols).collect()):
        texts.setdefault(r.lang, []).append(r.text)
    if not texts:
        return Parser([], [], [])
    parser, joined = Parser.over(texts, symbols)
    parts = spark.createDataFrame([(k, bytearray(x.astype(np.int32).tobytes())) for k, x in enumerate(joined)], "k int, symbols binary")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, raw in zip(b.column("k").to_pylist(), b.column("symbols").to_pylist(), strict=True):
                table = Automaton(suffix_automaton(np.frombuffer(raw, dtype=np.int32).tolist()), 1 + FREQUENT + HASHED)
                yield pa.RecordBatch.from_arrays([pa.array([k], type=pa.int32()), *(pa.array([x.tobytes()], type=pa.binary()) for x in (table.base, table.owner, table.next, table.root))], names=["k", "base", "owner", "next", "root"])

    built = parts.repartitionByRange(len(joined), "k").mapInArrow(build, "k int, base binary, owner binary, next binary, root binary").collect()
    parser.tables = [Automaton.of(*(np.frombuffer(r[c], dtype=np.int32) for c in ("base", "owner", "next", "root"))) for r in sorted(built)]
    return parser


def identify(docs: DataFrame, parser: Parser, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``lang_pred``, ``score`` and ``phrase_rate`` of every row.

    Null texts and texts without letters are ``und`` with score 0, and so is
    every text if nothing was learned. Ties go to the first language by name.
    Rows that repeat are judged alike; an empty table gives an empty result.
    Texts of any length are parsed whole, in slices bounded by bytes. A kept
    column that has the name of a returned one comes back as ``kept_<name>``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(parser)
    slim = keep_apart(docs, keep, ("lang_pred", "score", "phrase_rate"), text_col)
    names = slim.columns[:-1]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, "__text"):
            said = model.predict(b.column("__text").to_pylist())
            new = [pa.array([x[k] for x in said], type=t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *new], names=[*names, "lang_pred", "score", "phrase_rate"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(judge, f"{fields + ', ' if fields else ''}lang_pred string, score double, phrase_rate double")
