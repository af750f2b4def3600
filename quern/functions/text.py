"""Text expressions, all built-in and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as Chinese characters, as a regex class.
CJK = r"[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
#: Fixed value: a Latin word beside Chinese text.
LATIN_TOKEN = r"[A-Za-z][A-Za-z0-9'’\-]*"


def compact(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def match_key(text: Column) -> Column:
    """Comparison key: compact and lower case (see ``udfs.casefold_key`` beyond ASCII)."""
    return F.lower(compact(text))


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three dots if cut; a limit of 3 or less cuts hard."""
    if limit <= 0:
        return F.lit("")
    if limit <= 3:
        return F.substring(text, 1, limit)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def english_like(text: Column) -> Column:
    """Has ASCII letters and no Chinese character."""
    return text.rlike("[A-Za-z]") & ~has_cjk(text)


def indexable(source: Column, translation: Column) -> Column:
    """Both there, and different once compacted."""
    return (compact(source) != "") & (compact(translation) != "") & (compact(source) != compact(translation))


def word_pattern(term: Column) -> Column:
    """A regex for a term as a whole ASCII word."""
    quoted = F.regexp_replace(term, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.concat(F.lit(r"(?<![A-Za-z0-9_'\-])"), quoted, F.lit(r"(?![A-Za-z0-9_'\-])"))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams; a shorter text is its own."""
    # Arrays of characters, as finding the i-th of a string takes i steps.
    chars = F.split(text, "")
    rest = lambda n: F.slice(chars, n, F.greatest(F.length(text) - n + 1, F.lit(0)))
    grams = F.array_compact(F.zip_with(F.zip_with(chars, rest(2), lambda a, b: F.concat(a, b)), rest(3), lambda a, b: F.concat(a, b)))
    return F.when(F.length(text) >= 3, F.array_distinct(grams)).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by underscores."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}]+", "_"), "^_+|_+$", ""))


def identity(path: Column, block: Column, occurrence: Column, index: Column, source: Column) -> Column:
    """Natural key of a unit: path, block with its occurrence if not the first, index, digest of the source."""
    named = F.when(occurrence > 1, F.concat_ws("#", block, occurrence.cast("string"))).otherwise(block)
    return F.concat_ws(":", path, named, index.cast("string"), F.substring(F.sha1(source), 1, 8))


def normalise_path(path: Column) -> Column:
    """Forward slashes, no ``./`` and no doubled slashes; a path that leaves its root is null."""
    p = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), "/{2,}", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"(?<=^|/)\./", ""), "^/|/$", "")
    return F.when(~p.rlike(r"(^|/)\.\.(/|$)"), p)


#: Endings of speaker ids that name a picture or a manner.
STYLE_SUFFIXES = (
    "alt", "angry", "annoyed", "big", "blank", "blush", "cg", "curious", "day", "extra", "happy", "mad", "neutral", "night", "open", "portrait",
    "sad", "shadow", "shock", "shout", "side", "small", "smile", "smiling", "sprite", "thinking", "tiny", "upset", "whisper", "worry", "worried",
)
STYLE_SUFFIX_GROUPS = ("no_side",)


def display_name(speaker: Column, suffixes: tuple[str, ...] = (*STYLE_SUFFIX_GROUPS, *STYLE_SUFFIXES)) -> Column:
    """A speaker id as a name: style suffixes off, words capitalised."""
    parts = F.filter(F.split(F.trim(speaker), "_"), lambda x: x != "")
    low = F.lower(F.array_join(parts, "_"))
    bare = F.regexp_replace(low, f"(_({'|'.join(suffixes)}))+$", "")
    return F.when(F.trim(speaker) != "", F.initcap(F.regexp_replace(bare, "_", " ")))


def plural_forms(term: Column) -> Column:
    """Other-number forms of a term's last word; none for words of two letters or less."""
    last = F.regexp_extract(term, r"([A-Za-z]+)$", 1)
    low = F.lower(last)
    plural = low.rlike("s$") & ~low.rlike("(ss|us|is)$") & (F.length(last) > 3)
    cut = lambda n: F.substring(term, F.lit(1), F.length(term) - n)
    single = F.when(low.rlike("ies$") & (F.length(last) > 3), F.concat(cut(3), F.lit("y"))).when(low.rlike("(ses|xes|zes|ches|shes)$"), cut(2)).when(plural, cut(1))
    many = F.when(low.rlike("[^aeiou]y$"), F.concat(cut(1), F.lit("ies"))).when(low.rlike("(s|x|z|ch|sh)$"), F.concat(term, F.lit("es"))).otherwise(F.concat(term, F.lit("s")))
    forms = F.array_compact(F.array(single, F.when(~plural, many)))
    return F.when(F.length(last) > 2, F.filter(forms, lambda x: F.lower(x) != F.lower(term))).otherwise(F.array().cast("array<string>"))


def replace_terms(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Plain replacements, one after the other."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


#: A tag and a field that hold no other.
TAG, FIELD = r"\{[^{}\r\n]*\}", r"\[[^\[\]\r\n]*\]"


def _until_same(text: Column, step) -> Column:
    """``step`` until no markup is left: as many rounds as markup lies in markup, each linear.

    Every round takes a sign that opens and one that closes, so that there are
    no more rounds than pairs of them; those after the last change cost nothing.
    """
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    pairs = F.least(count("{"), count("}")) + F.least(count("["), count("]"))
    # An array of one element names the new text, so that it is made once.
    once = lambda s: F.element_at(F.transform(F.array(step(s["t"])), lambda t: F.struct(t.alias("t"), (~t.rlike(f"{TAG}|{FIELD}")).alias("done"))), 1)
    start = F.struct(text.alias("t"), (~text.rlike(f"{TAG}|{FIELD}")).alias("done"))
    done = F.aggregate(F.sequence(F.lit(1), pairs), start, lambda s, _: F.when(s["done"], s).otherwise(once(s)))["t"]
    return F.when(pairs > 0, done).otherwise(text)


def strip_markup(text: Column) -> Column:
    """Tags in braces and fields in brackets out, however deep they lie in each other."""
    return _until_same(text, lambda t: F.regexp_replace(F.regexp_replace(t, TAG, ""), FIELD, ""))


def mask_markup(text: Column) -> Column:
    """Tags, then fields, however deep, as as many spaces: what is left stays in its place."""

    def blank(t: Column, pattern: str) -> Column:
        spaces = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.length(m)))
        gone = F.array_join(F.zip_with(F.split(t, pattern, -1), spaces, lambda rest, gap: F.concat(rest, F.coalesce(gap, F.lit("")))), "")
        return F.when(F.contains(t, F.lit(pattern[1])), gone).otherwise(t)

    # An array of one element names the text without tags, which is read several times.
    return _until_same(text, lambda t: F.element_at(F.transform(F.array(blank(t, TAG)), lambda u: blank(u, FIELD)), 1))


def token_estimate(chars: Column) -> Column:
    """A quarter of the characters, rounded up in all but exact cases."""
    return F.floor(chars / 4 + 0.999999).cast("long")


def clamp_confidence(x: Column) -> Column:
    """Into [0, 1]; NaN and null are 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0))))


#: Texts of a tag, of symbols, and of a file name, numeral, time format, identifier or row of letters.
NON_TRANSLATABLE = (
    r"^\{[^}]+\}$",
    r"^[^A-Za-z0-9\x{4e00}-\x{9fff}]+$",
    r"(?U)^[\w.-]+\.\w+$",
    r"(?i)^(?:[+-][IVXLCDM]+|[IVXLCDM]{2,})$",
    r"^(?:%[A-Za-z]|[%:\s,./\-0-9])+$",
    r"^[A-Za-z_][A-Za-z0-9_]*(?:_name|_label|_id)$",
    r"^(?:[A-Za-z]\.?)(?:\s+[A-Za-z]\.?)+$",
)


def non_translatable(text: Column, preserve: list[str] | None = None, repeated_letters: bool = False) -> Column:
    """Nothing to translate: empty, listed, markup, symbols, file names, numerals, formats, identifiers.

    ``repeated_letters`` also takes drawn-out sounds such as "Grrrr".
    """
    t = F.trim(text)
    tests = [t == "", *[t.rlike(pattern) for pattern in NON_TRANSLATABLE], F.trim(strip_markup(t)) == ""]
    if preserve:
        tests.append(t.isin(preserve))
    if repeated_letters:
        tests.append(t.rlike(r"(.)\1{2,}") & ~t.rlike(r"\s"))
    out = F.coalesce(text.isNull(), F.lit(True))
    for x in tests:
        out = out | F.coalesce(x, F.lit(False))
    return out
