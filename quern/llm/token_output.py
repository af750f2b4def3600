"""Operator 1: token ids as ORC, integer run-length encoded, with row indexes and Bloom filters.

``write_tokens`` range-partitions whole texts by document id, encodes each
partition in id order and writes one ORC file per range. ORC stores the id
lists with run-length encoding v2, keeps a row index per stride and a Bloom
filter on the id, so a reader splits a file by stripes and skips stripes and
strides by id. ``read_tokens`` reads them back and places each document in the
global id stream with two-level prefix sums (per file, then inside a file).
"""

from __future__ import annotations

import codecs
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, mix64, slices

#: What a worker remembers of pieces and their ids, and about what a piece takes beside its ids.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 48
#: Bytes of text that are encoded together.
TOGETHER = 2 << 20

# What the first byte of a character says about it: white space or unsure, visible, a Latin letter, a mark.
_UNSURE, _VISIBLE, _LETTER, _MARK = range(4)


def _byte_kinds() -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[33:127] = _MARK
    out[[39, *range(48, 58)]] = _VISIBLE
    out[[*range(65, 91), *range(97, 123)]] = _LETTER
    out[0xC3:0xCA] = _LETTER  # U+00C0 to U+027F
    out[[*range(0xCA, 0xE1), *range(0xE4, 0xEE)]] = _VISIBLE
    return out


def _byte_signs() -> str:
    """The sign that stands for each byte in a byte-level vocabulary; a line feed stays, as a delimiter."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    signs = [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]
    signs[10] = "\n"
    return "".join(signs)


BYTE_KINDS, BYTE_SIGNS = _byte_kinds(), _byte_signs()


def take_runs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, laid end to end."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


@dataclass(frozen=True)
class Pieces:
    """Texts cut where byte-level BPE never merges; ``led`` pieces follow a blank that is theirs."""

    first: np.ndarray
    last: np.ndarray
    led: np.ndarray
    #: Per text, the place of its first piece, and one more number for the end.
    of_text: np.ndarray
    #: Whether every byte belongs to a Latin letter.
    letters: np.ndarray
    #: Two independent 64-bit hashes, which together stand for the piece.
    key: np.ndarray
    check: np.ndarray


def cut_pieces(raw: np.ndarray, offsets: np.ndarray) -> Pieces:
    """Cut texts, laid end to end as UTF-8, at single blanks and line feeds between visible characters and before marks that follow letters."""
    n = len(raw)
    place = np.arange(n, dtype=np.int32)
    kind = BYTE_KINDS[raw[np.maximum.accumulate(np.where((raw & 0xC0) == 0x80, 0, place))]]
    signs = np.flatnonzero((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))  # multiplied, divided by
    kind[signs] = kind[signs + 1] = _VISIBLE
    inner = np.zeros(n, dtype=bool)
    inner[1:-1] = (kind[:-2] > 0) & (kind[2:] > 0)
    some = offsets[1:] > offsets[:-1]
    inner[offsets[:-1][some]] = inner[offsets[1:][some] - 1] = False
    blank = inner & (raw == 32)
    line = np.flatnonzero(inner & (raw == 10))
    begin = np.zeros(n, dtype=bool)
    begin[offsets[:-1][some]] = begin[line] = begin[line + 1] = begin[np.flatnonzero(blank) + 1] = True
    begin[1:] |= (kind[:-1] == _LETTER) & (kind[1:] == _MARK)
    first = np.flatnonzero(begin)
    last = np.append(first[1:], n)
    place -= np.repeat(first, last - first).astype(np.int32)
    last = last - blank[last - 1]
    led = (first > 0) & blank[first - 1]
    value = (raw.astype(np.uint64) + np.uint64(1)) * ~blank
    extra = mix64((last - first).astype(np.uint64) * np.uint64(2) + led)
    key, check = (mix64(np.add.reduceat(value * powers[place & (len(powers) - 1)], first) + extra) for powers in _POWERS)
    letters = np.logical_and.reduceat((kind == _LETTER) | blank, first)
    return Pieces(first, last, led, np.searchsorted(first, offsets), letters, key, check)


def _powers(base: int, n: int = 4096) -> np.ndarray:
    out = [1]
    while len(out) < n:
        out.append(out[-1] * base % (1 << 64))
    return np.array(out, dtype=np.uint64)


_POWERS = (_powers(0x9E3779B97F4A7C15), _powers(0xD1342543DE82EF95))

ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}


class PieceEncoder:
    """Encodes texts with a tokenizer, remembering the ids of frequent pieces.

    Byte-level BPE never merges across the cuts of ``cut_pieces``, so a text's
    ids are those of its pieces in order. Unseen pieces of Latin letters are
    one word each to the model, which takes them in one call; other pieces led
    by a blank are joined again and cut where a token starts with the space
    sign. Any other kind of tokenizer encodes whole texts.

    Pieces are known by 128 bits of hashes. The memory is bounded: when it
    holds more than ``cache_bytes``, the half that was used least goes.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_bytes = cache_bytes
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        cut = kind.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not kind.get("normalizer")
        self.by_piece = bool(plain and isinstance(self.tokenizer.model, models.BPE))
        self.added = [t["content"] for t in kind.get("added_tokens") or []]
        if not self.by_piece:
            return
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        vocab = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.leads[i] = token.startswith("Ġ")
        none = np.zeros(0, dtype=np.int64)
        # Per entry: the second hash, where its ids start, how many, uses; and the first hashes in order with their entries.
        self.check, self.starts, self.sizes, self.uses = none.astype(np.uint64), none, none, none
        self.keys, self.slots = none.astype(np.uint64), none
        self.values = none.astype(np.int32)

    def _ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        told = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in told for i in ids], dtype=np.int32), np.array([len(ids) for ids in told], dtype=np.int64)

    def _trim(self) -> None:
        if len(self.keys) * ENTRY_BYTES + self.values.nbytes > self.cache_bytes:
            stay = np.sort(np.argsort(-self.uses, kind="stable")[: len(self.uses) // 2])
            self.values = take_runs(self.values, self.starts[stay], self.sizes[stay])
            self.check, self.sizes, self.uses = self.check[stay], self.sizes[stay], self.uses[stay] // 2
            self.starts = np.cumsum(self.sizes) - self.sizes
            moved = np.full(len(self.slots), -1, dtype=np.int64)
            moved[stay] = np.arange(len(stay))
            here = moved[self.slots] >= 0
            self.keys, self.slots = self.keys[here], moved[self.slots[here]]

    def _learn(self, raw: np.ndarray, p: Pieces, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces ``which``, end to end in that order, and how many each has."""

        def joined(at: np.ndarray, before: bytes) -> bytes:
            """The pieces with ``before`` in front of each."""
            size = p.last[at] - p.first[at] + len(before)
            out = take_runs(raw, p.first[at] - len(before), size) if len(raw) else raw
            head = np.cumsum(size) - size
            for k, c in enumerate(before):
                out[head + k] = c
            return out.tobytes()

        plain = p.led[which] & p.letters[which]
        others = p.led[which] & ~plain
        parts = []
        if plain.any():
            # Two bytes stand before every led piece, but before the first of all.
            signs = codecs.charmap_decode(b"\n" + joined(which[plain], b" ").replace(b" ", b"\n ")[1:], "strict", BYTE_SIGNS)[0]
            ids = np.asarray(self.words.encode_batch_fast([signs], add_special_tokens=False)[0].ids, dtype=np.int32)
            parts.append((plain, ids, np.diff(np.append(np.flatnonzero(self.leads[ids]), len(ids)))))
        if others.any():
            ids, _ = self._ids_of([joined(which[others], b" ").decode()])
            cuts = np.flatnonzero(self.leads[ids])
            if len(cuts) == int(others.sum()) and cuts[0] == 0:
                parts.append((others, ids, np.diff(np.append(cuts, len(ids)))))
            else:  # a piece with a space-led token of its own
                parts.append((others, *self._ids_of([" " + raw[i:j].tobytes().decode() for i, j in zip(p.first[which[others]].tolist(), p.last[which[others]].tolist(), strict=True)])))
        tight = ~p.led[which]
        if tight.any():
            parts.append((tight, *self._ids_of([raw[i:j].tobytes().decode() for i, j in zip(p.first[which[tight]].tolist(), p.last[which[tight]].tolist(), strict=True)])))
        order = np.argsort(np.concatenate([np.flatnonzero(mask) for mask, _, _ in parts]), kind="stable")
        sizes = np.concatenate([size for _, _, size in parts])
        starts = np.cumsum(sizes) - sizes
        return take_runs(np.concatenate([ids for _, ids, _ in parts]), starts[order], sizes[order]), sizes[order]

    def _known(self, raw: np.ndarray, p: Pieces) -> np.ndarray | None:
        """The entry of each piece, or None where hashes clash."""
        coded = pa.array(p.key).dictionary_encode()
        code, keys = np.asarray(coded.indices), np.asarray(coded.dictionary)
        example = np.zeros(len(keys), dtype=np.int64)
        example[code[::-1]] = np.arange(len(code))[::-1]
        check = p.check[example]
        if (check[code] != p.check).any():
            return None
        order = np.argsort(keys)
        keys, example, check = keys[order], example[order], check[order]
        at = np.searchsorted(self.keys, keys)
        seen = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        seen[inside] = self.keys[at[inside]] == keys[inside]
        entry = np.full(len(keys), -1, dtype=np.int64)
        entry[seen] = self.slots[at[seen]]
        if (self.check[entry[seen]] != check[seen]).any():
            return None
        new = np.flatnonzero(~seen)
        if len(new):
            ids, sizes = self._learn(raw, p, example[new])
            entry[new] = len(self.sizes) + np.arange(len(new))
            self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(sizes) - sizes])
            self.values, self.sizes = np.concatenate([self.values, ids]), np.concatenate([self.sizes, sizes])
            self.check, self.uses = np.concatenate([self.check, check[new]]), np.concatenate([self.uses, np.zeros(len(new), dtype=np.int64)])
            self.keys, self.slots = np.insert(self.keys, at[new], keys[new]), np.insert(self.slots, at[new], entry[new])
        self.uses[entry] += 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return entry[back[code]]

    def encode_all(self, texts: pa.Array, end: tuple[int, ...] = ()) -> pa.ListArray:
        """The ids of each text (none is null), with ``end`` after them, as lists of 32-bit integers."""
        if not self.by_piece:
            return self._encode_whole(texts, end)
        texts = texts.cast(pa.large_string())
        # Added tokens may hold cuts: texts with one are encoded whole.
        odd = reduce(pc.or_, [pc.match_substring(texts, t) for t in self.added], pa.array(np.zeros(len(texts), dtype=bool)))
        if not pc.any(odd).as_py():
            return self._encode_pieces(texts, end)
        rest = pc.invert(odd)
        both = pa.concat_arrays([self._encode_whole(texts.filter(odd), end), self._encode_pieces(texts.filter(rest), end)])
        return both.take(pa.array(np.argsort(np.concatenate([np.flatnonzero(odd), np.flatnonzero(rest)]))))

    def _encode_whole(self, texts: pa.Array, end: tuple[int, ...]) -> pa.ListArray:
        told = [[*x.ids, *end] for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return pa.array(told, type=pa.list_(pa.int32()))

    def _encode_pieces(self, texts: pa.Array, end: tuple[int, ...]) -> pa.ListArray:
        self._trim()
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        if len(raw) < 3:
            return self._encode_whole(texts, end)
        p = cut_pieces(raw, offsets - offsets[0])
        order = self._known(raw, p)
        if order is None:
            return self._encode_whole(texts, end)
        # The end after each text's pieces.
        pool = np.append(self.values, np.array(end, dtype=np.int32))
        starts, sizes = np.append(self.starts, len(self.values)), np.append(self.sizes, len(end))
        order = np.insert(order, p.of_text[1:], len(self.sizes))
        ends = np.concatenate([[0], np.cumsum(sizes[order])])[p.of_text + np.arange(len(p.of_text))]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(take_runs(pool, starts[order], sizes[order])))


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``(doc_id, block, pos, n_tokens, ids)`` as ORC under ``path``, ascending by id.

    A null text counts as empty (its ids are just ``end_id``). Null ids come
    first; rows that share an id stay, ordered by a hash of their texts. An empty table writes
    files without rows. Other columns of ``docs`` are not read. ``block`` is
    the number of the range (and of its file), ``pos`` the row's place in it.
    Ranges are cut by id and hash, so that rows of one id spread over several.
    A text longer than a slice is encoded by itself, as a whole.
    """
    bound_batches(docs.sparkSession)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("spread", F.xxhash64("text")).repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread").drop("spread")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pos = _encoder(tokenizer), 0
        for b in slices(batches, "text", 1 << 20, TOGETHER):
            ids = coder.encode_all(b.column("text"), (end_id,))
            sizes = np.diff(np.asarray(ids.offsets)).astype(np.int64)
            at = pa.array(np.arange(pos, pos + b.num_rows, dtype=np.int64))
            pos += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("block"), at, pa.array(sizes), ids], names=["doc_id", "block", "pos", "n_tokens", "ids"])

    schema = "doc_id long, block int, pos long, n_tokens long, ids array<int>"
    ordered.withColumn("block", F.spark_partition_id()).mapInArrow(encode, schema).write.options(**ORC_OPTIONS).orc(path)


def lookup_tokens(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of a short list of documents.

    The ids go to the ORC reader, which skips the stripes and strides whose
    index or Bloom filter holds none of them.
    """
    return spark.read.schema("doc_id long, block int, pos long, n_tokens long, ids array<int>").orc(path).filter(F.col("doc_id").isin([int(i) for i in ids])).select("doc_id", "n_tokens", "ids")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the ORC files.

    ``start`` counts all ids before the document in ascending order. Only the
    per-file totals meet in one place.
    """
    stored = spark.read.schema("doc_id long, block int, pos long, n_tokens long, ids array<int>").orc(path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = b.column("ids")
            offsets, values = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4")
            crc = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "block", "pos", "n_tokens")), pa.array(crc, type=pa.int64())], names=["doc_id", "block", "pos", "n_tokens", "ids_crc32"])

    rows = stored.mapInArrow(digest, "doc_id long, block int, pos long, n_tokens long, ids_crc32 long")
    totals = stored.groupBy("block").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("block", (F.sum("total").over(Window.orderBy("block")) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "block").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
