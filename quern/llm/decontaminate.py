"""Operator 7: benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of consecutive item words. For one pattern length a
shift table tells, for the word block that ends at the scan position, how far
the scan may jump; where it says 0, the block's bucket lists the windows that
end with it, and comparing words confirms an occurrence. Windows of equal
length share tables, so that short items do not shorten the jumps of others.

A benchmark of more windows than one pass holds is searched for in passes,
each of which writes what it finds before the next one's tables replace its
own: neither the driver nor a task ever holds more than one pass.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bound_batches, materialize, salted_join, slices

#: Words of a window.
WINDOW = 10
#: Words of a shift block (of shorter windows: the whole window).
BLOCK = 3
#: Windows that one pass over the documents searches for; more make further passes.
PASS_WINDOWS = 100_000

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def bench_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_WORDS).split() if text else []


class Tables:
    """Shift and bucket tables of one set of windows, by window length."""

    def __init__(self, windows: dict[tuple[bytes, ...], set]):
        self.owners = {w: sorted(ids) for w, ids in windows.items()}
        by_length: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for w in windows:
            by_length[len(w)].append(w)
        self.lengths = []
        for m, group in sorted(by_length.items()):
            b, shift, buckets = min(BLOCK, m), {}, defaultdict(list)
            for w in group:
                for end in range(b, m + 1):
                    key = w[end - b : end]
                    shift[key] = min(shift.get(key, m), m - end)
                buckets[w[m - b :]].append(w)
            # Blocks of one word are looked up by the word itself.
            self.lengths.append((m, b, {k[0]: v for k, v in shift.items()} if b == 1 else shift, dict(buckets)))

    def search(self, words: list[bytes]) -> list[tuple[int, int, tuple[bytes, ...]]]:
        """Every occurrence as (first word, length, window)."""
        found = []
        for m, b, shift, buckets in self.lengths:
            if m > len(words):
                continue
            get, far, end, n = shift.get, m - b + 1, m, len(words)
            while end <= n:
                jump = get(words[end - 1], far) if b == 1 else get(tuple(words[end - b : end]), far)
                if jump:
                    end += jump
                    continue
                here = tuple(words[end - m : end])
                found += [(end - m, m, w) for w in buckets[here[m - b :]] if w == here]
                end += 1
        return found


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def merge_spans(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Spans in order; those that touch or overlap become one."""
    out: list[dict[str, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1]["last"]:
            out[-1]["last"] = max(out[-1]["last"], last)
        else:
            out.append({"first": first, "last": last})
    return out


def windows_of(items: list[tuple[object, list[bytes]]], size: int = WINDOW) -> dict[tuple[bytes, ...], set]:
    """Windows of each item; an item with fewer words than ``size``, but not none, is one window."""
    out: dict[tuple[bytes, ...], set] = defaultdict(set)
    for i, words in items:
        if words:
            m = min(size, len(words))
            for k in range(len(words) - m + 1):
                out[tuple(words[k : k + m])].add(i)
    return dict(out)


def _passes(bench: DataFrame, item_col: str, text_col: str, size: int, most: int) -> Iterator[dict]:
    """Windows of the benchmark, about ``most`` at a time; items are read as a stream. One empty pass where there are none."""
    items, held, some = [], 0, False
    rows = bench.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    for r in rows.toLocalIterator():
        words = bench_words(r.t)
        # A long item is cut where its windows overlap.
        for at in range(0, max(1, len(words) - size + 1), most):
            items.append((r.i, words[at : at + most + size - 1]))
            held += len(items[-1][1])
            if held >= most:
                some = True
                yield windows_of(items, size)
                items, held = [], 0
    if items or not some:
        yield windows_of(items, size)


def find_overlap(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, keep: tuple[str, ...] = (), pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """``(doc_id, n_words, spans, items, *keep)`` of every row of ``docs``.

    ``spans`` are the merged ``(first, last)`` word ranges, last exclusive,
    inside occurrences of benchmark windows, ``items`` the sorted ids of the
    items they come from, of whatever type. Null and empty texts have no words;
    items without id or words match nothing; rows that repeat are judged alike;
    empty tables are fine; texts of any length are searched whole, in slices
    bounded by bytes. A pass holds about ``pass_windows`` windows. A larger
    benchmark takes more passes over the texts, whose finds meet by the
    texts' SHA-256. A kept column with the name of a returned one comes back as
    ``kept_<name>``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    new = ("doc_id", "n_words", "spans", "items")
    names = {c: f"kept_{c}" if c in new else c for c in keep}
    item_type = dict(bench.select(F.col(item_col).alias("i")).dtypes)["i"]
    found_type = f"n_words long, spans array<struct<first: long, last: long>>, items array<{item_type}>"
    arrow_item = to_arrow_type(bench.schema[item_col].dataType)

    def search(rows: DataFrame, windows: dict, only_found: bool) -> tuple[DataFrame, Broadcast]:
        """The rows with ``n_words``, ``spans`` and ``items``, and the tables that all tasks hold meanwhile."""
        shared = spark.sparkContext.broadcast(Tables(windows))
        cols = [c for c in rows.columns if c != "__text"]

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = shared.value
            for b in slices(batches, "__text"):
                count, spans, items = [], [], []
                for text in b.column("__text").to_pylist():
                    words = bench_words(text)
                    met = tables.search(words)
                    count.append(len(words))
                    spans.append(merge_spans([(at, at + m) for at, m, _ in met]))
                    items.append(sorted({i for _, _, w in met for i in tables.owners[w]}))
                out = pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(count, type=pa.int64()), pa.array(spans, type=SPANS), pa.array(items, type=pa.list_(arrow_item))], names=[*cols, "n_words", "spans", "items"])
                yield out.filter(pa.array([bool(h) for h in spans])) if only_found else out

        fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != "__text")
        return rows.mapInArrow(go, fields + found_type), shared

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep])
    passes = _passes(bench, item_col, item_text, size, pass_windows)
    first = next(passes)
    found = search(slim.withColumn("__text_id", F.sha2(F.col("__text").cast("binary"), 256)) if (second := next(passes, None)) is not None else slim, first, False)[0]
    if second is not None:
        texts = slim.select(F.sha2(F.col("__text").cast("binary"), 256).alias("__text_id"), "__text").filter("__text IS NOT NULL")
        parts = []
        for windows in chain([second], passes):
            rows, shared = search(texts, windows, True)
            parts.append(materialize(rows, "overlap"))
            shared.destroy()  # its finds are written
        more = reduce(DataFrame.unionByName, parts).groupBy("__text_id").agg(F.flatten(F.collect_set("spans")).alias("more_spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("more_items"))
        found = salted_join(found, more, "__text_id", F.coalesce(F.xxhash64("doc_id"), F.lit(0)))
        both = [F.when(F.col(f"more_{c}").isNull(), F.col(c)).otherwise(F.array_sort(F.array_union(c, f"more_{c}"))).alias(c) for c in ("spans", "items")]
        found = found.select("doc_id", "n_words", *both, *[f"`keep_{c}`" for c in keep])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                spans = pa.array([merge_spans([(x["first"], x["last"]) for x in v]) for v in b.column("spans").to_pylist()], type=SPANS)
                yield b.set_column(b.schema.get_field_index("spans"), "spans", spans)

        found = found.mapInArrow(merge, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields))
    return found.select("doc_id", "n_words", "spans", "items", *[F.col(f"`keep_{c}`").alias(n) for c, n in names.items()])


def digest(found: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` from ``find_overlap``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def brute_digest(words: list[bytes], items: list[tuple[int, list[bytes]]], size: int = WINDOW) -> tuple[int, int, int, str, bool]:
    """The digest of one document by trying every window at every place."""
    hit, who = np.zeros(len(words), dtype=bool), set()
    for i, w in items:
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            for at in range(len(words) - m + 1):
                if words[at : at + m] == w[k : k + m]:
                    hit[at : at + m] = True
                    who.add(i)
    return len(words), int(hit.sum()), len(who), hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest(), bool(hit.any())
