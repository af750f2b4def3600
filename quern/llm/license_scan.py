"""Operator 2: license scans by sparse TF-IDF cosine to templates, then directory inheritance.

Every line of every file, every block of lines between blank ones (freed of
comment signs) and every whole file is a unit. Units that could reach the limit must hold one of the anchor terms: the rarest
of a template, without which the others weigh too little, so the filter loses
nothing.
Surviving units become sparse TF-IDF rows and are joined with the templates'
rows by term. A file without a licence of its own takes that of the licence
file in its nearest ancestor directory.

DataFrame functions only; the templates are held on the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted_join
from .license_texts import NOTICES, TEXTS

#: Cosine from which a unit carries a template's licence.
MIN_COSINE = 0.6
#: Terms that all templates may have together.
MAX_TERMS = 20_000
#: Names of licence files.
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$"

#: Weights are inverse shares of files, to this share; terms of no template weigh as common words do, however many files there are.
LEAST_SHARE, OTHER_WEIGHT = 1e-3, 1.0
#: Signs that open or close a line of a comment.
COMMENT = r"^[ \t]*(?:#+|//+|/?\*+/?|--+|;+|%+|<!--|dnl|rem)?[ \t]?|[ \t]*(?:\*+/|-->)?[ \t]*$"


def _templates() -> tuple[tuple[str, str], ...]:
    """Notices, whole texts, and the blocks of texts that no other licence has."""
    blocks = [(name, block) for name, text in TEXTS for block in dict.fromkeys([text, *text.split("\n\n")])]
    owners = {block: {n for n, b in blocks if b == block} for _, block in blocks}
    return tuple(dict.fromkeys([*NOTICES, *((n, b) for n, b in blocks if len(owners[b]) == 1 and len(template_terms(b)) > 3)]))


def terms(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda x: x != "")


def template_terms(text: str) -> Counter:
    return Counter(re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))


TEMPLATES = _templates()


class Model:
    """Weights of the templates under the corpus' shares of files that hold their terms."""

    def __init__(self, templates, found: dict[str, int], files: int):
        self.idf = {t: -math.log(found.get(t, 0) / max(files, 1) * (1 - LEAST_SHARE) + LEAST_SHARE) + 1 for _, text in templates for t in template_terms(text)}
        self.rows: list[tuple[int, str, str, float]] = []
        for i, (name, text) in enumerate(templates):
            vector = {t: n * self.idf[t] for t, n in template_terms(text).items()}
            norm = math.sqrt(sum(w * w for w in vector.values()))
            self.rows += [(i, name, t, w / norm) for t, w in sorted(vector.items())]

    def find_anchors(self, least: float) -> list[str]:
        """Terms of which a unit at ``least`` or more must hold one."""
        out: set[str] = set()
        for i in {r[0] for r in self.rows}:
            rest = 1.0
            # Rarest first: what is left may be common, and is too little.
            for _, t, w in sorted((-self.idf[r[2]], r[2], r[3]) for r in self.rows if r[0] == i):
                if rest < (least - 1e-9) ** 2:
                    break
                out.add(t)
                rest -= w * w
        return sorted(out)


def fit(files: DataFrame, templates=TEMPLATES, text_col: str = "text") -> Model:
    """Document frequencies of the templates' terms over all files."""
    vocabulary = sorted({t for _, text in templates for t in template_terms(text)})
    if len(vocabulary) > MAX_TERMS:
        raise ValueError(f"templates have more than {MAX_TERMS} terms")
    held = F.array_intersect(terms(F.col(text_col)), F.array(*map(F.lit, vocabulary)))
    marked = files.select(F.explode(F.array_append(held, F.lit(""))).alias("term"))
    counts = {r.term: r["n"] for r in marked.groupBy("term").agg(F.count("*").alias("n")).collect()}
    return Model(templates, counts, counts.get("", 0))


def scan_licences(files: DataFrame, templates=TEMPLATES, path_col: str = "path", text_col: str = "text", licence_file: Column | None = None, min_cosine: float = MIN_COSINE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(path, licence, cosine, how, licence_path, *keep)`` of every row.

    ``how`` is ``header`` (a line or block of the file), ``file`` (a licence
    file as a whole), ``inherited`` (``licence_path`` names the licence file in
    the nearest ancestor directory, its own included) or null. A licence file
    is one by its name, by the column ``licence_file``, or because its whole
    text is a licence. Of several the highest cosine wins, then the licence and
    the path in order. Rows with a null path inherit nothing and lend nothing;
    null and empty texts hold no licence; rows that repeat are judged alike; an
    empty table gives an empty result; texts of any length are read whole.
    Column names of ``files`` may clash with those returned; a kept column with
    such a name comes back as ``kept_<name>``.
    """
    spark = files.sparkSession
    model = fit(files, templates, text_col)
    anchors = F.array(*map(F.lit, model.find_anchors(min_cosine)))
    name = F.substring_index(F.col(path_col), "/", -1)
    is_file = F.coalesce(licence_file if licence_file is not None else name.rlike(LICENCE_FILE), F.lit(False))
    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"), is_file.alias("is_file"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep])
    rows = rows.withColumn("text_id", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))

    # A text's units do not depend on its path: equal texts are scored once. Few texts hold an anchor.
    some = materialize(rows.select("text_id", "text").filter(F.arrays_overlap(terms(F.col("text")), anchors)).dropDuplicates(["text_id"]), "anchored")
    lines = F.split("text", "\n")
    bare = F.transform(lines, lambda x: F.regexp_replace(x, COMMENT, ""))
    blocks = F.split(F.array_join(bare, "\n"), "\n[ \t\r]*\n")
    shaped = F.concat(F.transform(F.concat(lines, blocks), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit"))), F.array(F.struct(F.lit(True).alias("whole"), F.array_join(bare, "\n").alias("unit"))))
    units = some.select("text_id", F.explode(shaped).alias("u")).select("text_id", "u.whole", terms(F.col("u.unit")).alias("terms")).filter(F.arrays_overlap("terms", anchors))
    units = units.withColumn("unit_id", F.md5(F.array_join("terms", " ").cast("binary"))).dropDuplicates(["text_id", "whole", "unit_id"])
    units = materialize(units, "units")
    # Different texts share lines; one row per line is enough for its cosine.
    sparse = units.dropDuplicates(["unit_id"]).select("unit_id", F.explode("terms").alias("term")).groupBy("unit_id", "term").agg(F.count("*").alias("tf"))
    idf = spark.createDataFrame(sorted(model.idf.items()), "term string, idf double")
    weights = spark.createDataFrame(model.rows, "template int, licence string, term string, weight double")
    # Both tables have at most MAX_TERMS rows per template.
    sparse = sparse.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(OTHER_WEIGHT)))
    norms = sparse.groupBy("unit_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = sparse.join(F.broadcast(weights), "term").groupBy("unit_id", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "unit_id").select("unit_id", "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")).filter(F.col("cosine") >= min_cosine)
    pick = F.min(F.struct((-F.col("cosine")).alias("less"), F.col("licence").alias("licence"))).alias("best")
    # A common line meets its score in several tasks.
    by_text = salted_join(units.select("text_id", "whole", "unit_id"), scored.groupBy("unit_id").agg(pick), "unit_id", F.col("text_id"), "inner")
    by_text = by_text.groupBy("text_id").agg(F.min(F.when(~F.col("whole"), F.col("best"))).alias("line"), F.min(F.when(F.col("whole"), F.col("best"))).alias("file"))
    spread = F.coalesce(F.xxhash64("path"), F.lit(0))
    rows = salted_join(rows.drop("text"), by_text, "text_id", spread)
    of_file = F.col("file").isNotNull() & (F.col("line").isNull() | (F.col("file.less") <= F.col("line.less")))
    rows = rows.withColumn("is_file", F.col("is_file") | F.col("file").isNotNull())
    rows = rows.withColumn("own", F.when(of_file, F.col("file")).otherwise(F.col("line"))).withColumn("how", F.when(of_file, "file").when(F.col("line").isNotNull(), "header"))
    rows = rows.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), ""))
    rows = materialize(rows, "licences")

    lend = rows.filter("is_file AND own IS NOT NULL AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct("own.less", "own.licence", "path")).alias("lent"))
    parts = F.split("dir", "/")
    ways = rows.filter("own IS NULL AND dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(F.concat(F.array(F.lit(0)), F.when(F.col("dir") == "", F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(parts))))).alias("depth"))
    ways = ways.withColumn("up", F.when(F.col("depth") == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.col("depth"), F.lit(1))), "/")))
    near = ways.join(lend.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("lent", "depth").alias("lent"))
    rows = salted_join(rows, near, "dir", spread)
    lent = F.when(F.col("own").isNull(), F.col("lent"))
    return rows.select(
        "path",
        F.coalesce("own.licence", lent["licence"]).alias("licence"),
        F.coalesce(-F.col("own.less"), -lent["less"]).alias("cosine"),
        F.when(F.col("own").isNotNull(), F.col("how")).when(lent.isNotNull(), "inherited").alias("how"),
        lent["path"].alias("licence_path"),
        *[F.col(f"`keep_{c}`").alias(f"kept_{c}" if c in ("path", "licence", "cosine", "how", "licence_path") else c) for c in keep],
    )
