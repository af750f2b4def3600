"""Operator 10: secret scans, patterns first, then dictionary-primed zstandard novelty.

Three fixed patterns find the usual forms. The method looks at every other
token-like string that follows a sensitive word closely: it compresses the
string, primed with dictionaries of long words and of identifiers and with the
rest of its line, and reports strings whose marginal cost in bytes is near what
random signs of their own alphabet cost: a random key cannot be predicted, a
name or a word can. Compression alone decides, whatever the letters' case.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, keep_apart, slices

#: Kinds in the order in which they are listed where spans start together.
KINDS = ("assign", "access", "hex", "novel")
#: The method looks at strings of this length or more,
MIN_LENGTH = 16
#: that a sensitive word precedes by this many characters at most,
CONTEXT = 40
#: and reports those whose marginal cost is this part, or more, of random signs' cost.
MIN_NOVELTY = 0.9
#: Level of compression.
LEVEL = 3

_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is the same match as a run, then its length
_HINT = re.compile(r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
_SENSITIVE = re.compile(r"(?i:passw|passphrase|secret|token|api.?key|credential|private.?key|access.?key|auth|bearer|signature)")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: Identifiers and words that usually stand near keys.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_id client_secret username user login "
    "authorization bearer basic header request response session cookie config settings environment variable default "
    "value string number true false null none import export return function class public private static const "
    "example.com https://www. http://localhost abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
    "xxxxxxxxxxxxxxxxxxxxxxxx ******************** changeme your_key_here placeholder created updated identifier "
)
#: Long words and parts of words, so that plain text of letters is cheap.
WORDS = (
    "administration administrator advertisement application appropriate architecture association authentication authorization automatically background "
    "broadcasting calculation certificate championship characteristic circumstances classification collaboration combination commission communication "
    "community comparison compatibility competition complement comprehensive concentration configuration confirmation congratulations connection "
    "consciousness consideration constitution construction consultation contemporary contribution controller conversation cooperation corporation "
    "correspondence cryptographic decentralization declaration definition demonstration department description destination determination development "
    "differentiation dimension disappointment discrimination distribution documentation electromagnetic employment encryption encyclopedia engineering "
    "entertainment environmental establishment evaluation examination exceptional experience experimental explanation expression extraordinary foundation "
    "fundamental generation government hypothetical identification illustration immediately implementation improvement independent individual industrial "
    "information infrastructure initialization inspiration installation institution instrumental intellectual intelligence interaction interdisciplinary "
    "international interpretation introduction investigation investment jurisdiction knowledgeable laboratory legislation liberation literature maintenance "
    "management manufacturer mathematical measurement microprocessor microscopic miscellaneous misunderstanding modernization motivation multidimensional "
    "multiplication nationality negotiation neighbourhood notification notwithstanding observation occupational opportunity optimization organization "
    "orientation overwhelming parameter parliamentary participation particularly performance permission personality perspective pharmaceutical philosophical "
    "photographic physiological politically population possibility predominantly preparation presentation presumably principally probability procedure "
    "processing production professional programmatically pronunciation proportional psychological publication qualification quantitative questionnaire "
    "radiotherapy rationalization realization recommendation reconstruction registration relationship reliability representative reproduction requirement "
    "resolution respectively responsibilities restoration revolutionary satisfaction scholarship scientifically sensitivity significance simultaneously "
    "situation socioeconomic sophisticated specification standardization statistical straightforward structure subsequently substantially superintendent "
    "sustainability synchronization systematically technological telecommunications temperature terminology themselves theoretical thermodynamic "
    "transcontinental transformation transmission transportation unbelievable understanding unfortunately university unprecedented unquestionably validation "
    "verification visualization vulnerability whatsoever counter inter under over hyper super trans micro macro multi pseudo ultra electro photo hydro "
    "ability ically fulness lessness ishment ologist ography ization ational itively ousness "
)


class Novelty:
    """Marginal compressed size of strings in their line."""

    def __init__(self, identifiers: str = WORDS + IDENTIFIERS):
        import zstandard

        self.zstd, self.identifiers = zstandard, identifiers.encode()

    def rates(self, line: str, strings: list[str]) -> list[float]:
        """Bytes that each string adds after the identifiers and the rest of its line, per byte that random signs would add."""
        primed = self.zstd.ZstdCompressionDict(self.identifiers + line.encode("utf-8", "replace"), dict_type=self.zstd.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        compress = self.zstd.ZstdCompressor(dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        bare = len(compress(b""))
        # Words in capitals cost what they cost in small letters.
        return [(min(len(compress(y.encode())) for y in {x, x.lower() if x.upper() == x or x.istitle() else x}) - bare) / random_cost(x) for x in strings]


def random_cost(token: str) -> float:
    """Bytes of as many random signs of the smallest usual alphabet that the token fits in: short ones stay as they are, longer ones cost their entropy and a code table."""
    signs = set(token)
    low, high, digits = signs & set("abcdefghijklmnopqrstuvwxyz"), signs & set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), signs & set("0123456789")
    size = 10 * bool(digits) + len(signs - low - high - digits)
    for letters in (low, high):
        size += (6 if letters <= set("abcdefABCDEF") else 26) if letters else 0
    return min(len(token), len(token) * math.log2(max(size, 2)) / 8 + 10 + size / 3)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' matches; ends exclusive."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, known: list[tuple[int, int, int]], novelty: Novelty, min_novelty: float = MIN_NOVELTY) -> list[tuple[int, int, int]]:
    """Strings that the method adds, in whole length; none that overlaps a known span."""
    starts = [a for a, _, _ in known]
    reach = list(accumulate((b for _, _, b in known), max))
    lines: dict[tuple[int, int], list[tuple[int, int]]] = {}
    line, done, run, end = (0, -1), -1, 0, 0  # the last token met; from any place inside it a match ends where it ends
    for hint in _SENSITIVE.finditer(text):
        at = max(hint.end(), done)
        # The first MIN_LENGTH characters tell where a token starts.
        while m := _TOKEN.search(text, at, hint.end() + CONTEXT + MIN_LENGTH):
            start = m.start()
            if not run <= start < end:
                run, end = start, _TOKEN.match(text, start).end()
            at = end
            before = bisect_left(starts, end)
            if before and reach[before - 1] > start:
                continue
            done, token = end, text[start:end]
            if start > line[1]:
                stop = text.find("\n", end)
                line = text.rfind("\n", 0, start) + 1, len(text) if stop < 0 else stop
            lines.setdefault(line, []).append((start, end))
    out = []
    for (first, last), spans in lines.items():
        edges = [first, *(x for span in spans for x in span), last]
        rest = " ".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
        out += [(i, 3, j) for (i, j), rate in zip(spans, novelty.rates(rest, [text[i:j] for i, j in spans]), strict=True) if rate >= min_novelty]
    return out


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), min_novelty: float = MIN_NOVELTY) -> DataFrame:
    """The ``keep`` columns and ``spans`` of every row.

    ``spans`` are ``(kind, first, last)``, in code points, last exclusive, by
    ``first`` and then in the order of ``KINDS``. A null text has none. Rows
    that repeat are judged alike; an empty table gives an empty result. Whole
    texts are searched, however long; a token costs its own length, a line with
    tokens its length once. A kept column named ``spans`` comes back as
    ``kept_spans``.
    """
    bound_batches(docs.sparkSession)
    slim = keep_apart(docs, keep, ("spans",), text_col)
    names = slim.columns[:-1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
        for b in slices(batches, "__text"):
            found = []
            for text in b.column("__text").to_pylist():
                text = text or ""
                base = base_spans(text)
                found.append([{"kind": KINDS[k], "first": i, "last": j} for i, k, j in sorted(base + novel_spans(text, base, novelty, min_novelty))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(found, type=kind)], names=[*names, "spans"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema.fields[:-1])
    return slim.mapInArrow(scan, fields + "spans array<struct<kind: string, first: long, last: long>>")


def digest(found: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` from ``scan_secrets``."""

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def join(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")

    base = join(F.filter("spans", lambda s: s["kind"] != "novel"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))
