"""Readers and writers: trees of text files, JSON lines under three policies, tables, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_tree(spark: SparkSession, root: str, pattern: str = "*.rpy", include: list[str] | None = None, prefixes: list[str] | None = None, skip: tuple[str, ...] = ("tl", "cache", "saves")) -> DataFrame:
    """``(path, content, sha256, length)`` of the files below ``root``; paths are relative.

    ``include`` names files, ``prefixes`` folders; without either all files
    count. Folders named in ``skip`` are left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.substring_index("path", base + "/", -1), "^/+", "")
    rows = files.select(path.alias("path"), "content", F.sha2("content", 256).alias("sha256"), "length")
    if include or prefixes:
        rows = rows.filter(F.col("path").isin(include or []) | path_prefix(F.col("path"), prefixes or []))
    return rows.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, skip)))) if skip else rows


def path_prefix(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p.rstrip("/")) | path.startswith(p.rstrip("/") + "/")
    return out


def lines(files: DataFrame, text: Column | None = None) -> DataFrame:
    """``(path, line, text)`` of the files' lines, from 1."""
    t = text if text is not None else F.decode("content", "UTF-8")
    return files.select("path", F.posexplode(F.split(F.regexp_replace(t, "\r\n?", "\n"), "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def paragraphs(texts: DataFrame, key: str, text: str, least: int = 6) -> DataFrame:
    """``(key, ordinal, text)``: pieces between blank lines, wrapped lines joined, of ``least`` characters or more."""
    piece = texts.select(key, F.posexplode(F.split(F.col(text), r"\n\s*\n+")).alias("ordinal", "text"))
    return piece.withColumn("text", F.trim(F.regexp_replace("text", r"\s*\n\s*", " "))).filter(F.length("text") >= least)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, policy: str = "skip", key: str | None = None) -> DataFrame:
    """JSON lines. ``skip`` drops rows that do not parse, ``fail`` stops at them, ``keep`` marks them in ``_corrupt_record``.

    With ``key`` the last row of each key in its file's order stays.
    """
    s = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    raw = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("__ord"), F.col("_metadata.file_path").alias("__file"))
    raw = raw.filter(F.trim("value") != "")
    mode = "FAILFAST" if policy == "fail" else "PERMISSIVE"
    wide = StructType(s.fields).add("_corrupt_record", "string")
    rows = raw.select(F.from_json("value", wide if mode == "PERMISSIVE" else s, {"mode": mode, "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "__ord", "__file", "value")
    bad = F.col("r._corrupt_record").isNotNull() | ~F.trim("value").startswith("{") if mode == "PERMISSIVE" else F.lit(False)
    if policy == "skip":
        rows = rows.filter(~bad)
    out = rows.select("r.*", "__ord", "__file")
    if key:
        w = Window.partitionBy(key).orderBy(F.col("__file").desc(), F.col("__ord").desc())
        out = out.filter(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return out.drop("__ord", "__file", *(["_corrupt_record"] if policy == "skip" else []))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Not empty, and every line is a JSON object."""
    t = spark.read.text(path).filter(F.trim("value") != "")
    n, bad = t.agg(F.count("*"), F.count_if(F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{"))).first()
    return n > 0 and bad == 0


def write_versioned(df: DataFrame, root: str, fmt: str = "parquet") -> str:
    """Write a new version folder and return its path; readers of older versions are not disturbed."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.format(fmt).save(path)
    return path


def write_relations_csv(pairs: DataFrame, path: str) -> None:
    """Pair scores as CSV: the total with six decimals, components with three."""
    cols = [F.format_string("%.6f", c).alias(c) if c == "score" else F.format_string("%.3f", c).alias(c) if t == "double" else F.col(c) for c, t in pairs.dtypes]
    pairs.select(*cols).write.option("header", "true").csv(path)


def markdown_table(spark: SparkSession, path: str, most: int = 10_000) -> DataFrame:
    """Rows of the first pipe table of a document, columns by its header. A table over ``most`` lines is refused."""
    lines = spark.read.text(path).filter(F.trim("value").startswith("|")).limit(most + 1).collect()
    if len(lines) > most:
        raise ValueError(f"a table of more than {most} lines")
    rows = [[c.strip() for c in r.value.strip().strip("|").split("|")] for r in lines]
    body = [r for r in rows[1:] if not all(set(c) <= set("-: ") for c in r)]
    head = rows[0] if rows else ["empty"]
    return spark.createDataFrame([tuple((r + [""] * len(head))[: len(head)]) for r in body], ", ".join(f"`{h}` string" for h in head))
