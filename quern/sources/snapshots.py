"""Versions of several tables behind one pointer, and scans that notice changed files.

A version is written as plain folders that nobody reads yet, then listed with
the digest of each of its files, and last named by a pointer that is created
exclusively: of two writers one wins, and a writer that dies leaves folders
without a pointer, which ``recover`` deletes. All files are read and written by
Spark or through the cluster's file system, never by local paths.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.tables import cut

from .readers import file_tree

_NAME = re.compile(r"[0-9a-f]{32}")


class Conflict(RuntimeError):
    """Another writer named the version first."""


def _system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    at, fs = _system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def digests(spark: SparkSession, root: str) -> DataFrame:
    """``(file, length, sha256)`` of every file below ``root``, marks of the file system aside; paths are relative."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    return files.select(F.regexp_replace(F.substring_index("path", base + "/", -1), "^/+", "").alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """Numbers of the named versions and their folders; a pointer that was cut off while it was written names none."""
    out = {}
    for name in _names(spark, f"{root}/versions"):
        if name.isdigit():
            said = spark.read.text(f"{root}/versions/{name}").limit(2).collect()
            if len(said) == 1 and _NAME.fullmatch(said[0][0]):
                out[int(name)] = said[0][0]
    return out


def write(spark: SparkSession, root: str, tables: dict[str, DataFrame], expect: int | None = None) -> int:
    """Write all tables as one version and return its number; readers see all of them or none.

    With ``expect`` the newest version must still be that one (0: none), or
    ``Conflict`` is raised, as when another writer takes the number first.
    """
    newest = max(versions(spark, root), default=0)
    if expect is not None and newest != expect:
        raise Conflict(f"version {newest} is there, {expect} was expected")
    folder = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/data/{folder}/{name}")
    digests(spark, f"{root}/data/{folder}").write.json(f"{root}/manifests/{folder}")
    # A number whose pointer was cut off is not used again.
    taken = [int(n) for n in _names(spark, f"{root}/versions") if n.isdigit()]
    number = max([newest, *taken]) + 1
    at, fs = _system(spark, f"{root}/versions/{number}")
    try:
        out = fs.create(at, False)
    except Exception as e:  # the file system's own error, by way of the gateway
        if "Exist" in str(e):
            raise Conflict(f"version {number} was named by another writer") from e
        raise
    out.write(bytearray(f"{folder}\n".encode()))
    out.close()
    return number


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table of a version, the newest by default."""
    known = versions(spark, root)
    number = max(known, default=None) if version is None else version
    if number not in known:
        raise FileNotFoundError(f"no version {number} in {root}")
    return spark.read.parquet(f"{root}/data/{known[number]}/{table}")


def verify(spark: SparkSession, root: str, version: int) -> DataFrame:
    """``(file, problem)`` of the files that are not as they were written: ``changed``, ``missing`` or ``unknown``."""
    folder = versions(spark, root)[version]
    was = spark.read.schema("file string, length long, sha256 string").json(f"{root}/manifests/{folder}").select("file", F.col("sha256").alias("was"))
    now = digests(spark, f"{root}/data/{folder}").select("file", F.col("sha256").alias("now"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unknown").when(F.col("now") != F.col("was"), "changed")
    return was.join(now, "file", "full_outer").select("file", problem.alias("problem")).filter("problem IS NOT NULL")


def recover(spark: SparkSession, root: str) -> list[str]:
    """Delete the folders that no version names, and return their names. No writer may be at work meanwhile."""
    named, gone = set(versions(spark, root).values()), []
    for part in ("data", "manifests"):
        for name in _names(spark, f"{root}/{part}"):
            if name not in named:
                at, fs = _system(spark, f"{root}/{part}/{name}")
                fs.delete(at, True)
                gone.append(name)
    return sorted(set(gone))


def scan_checked(spark: SparkSession, root: str, scan: Callable[[DataFrame], DataFrame], pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """The rows of ``scan(files)``, written, and ``(file, problem)`` of files that changed meanwhile.

    Digests are taken before the scan and after it, and of the very bytes that
    were scanned (``files`` has them as ``sha256``); a file is ``added``,
    ``gone`` or ``changed`` if they differ, also if it was changed back.
    ``scan`` keeps ``path`` and ``sha256``.
    """
    listed = lambda name: cut(file_tree(spark, root, pattern, skip=()).select("path", F.col("sha256").alias(name)), "digests")
    before = listed("before")
    rows = cut(scan(file_tree(spark, root, pattern, skip=())), "scan")
    try:
        after = listed("after")
    except PySparkException:  # the folder itself is gone
        after = before.select("path", F.lit(None).cast("string").alias("after")).limit(0)
    scanned = rows.groupBy("path").agg(F.min("sha256").alias("low"), F.max("sha256").alias("high"))
    all_ = before.join(after, "path", "full_outer").join(scanned, "path", "full_outer")
    differs = (F.col("before") != F.col("after")) | (F.coalesce("low", "before") != F.col("before")) | (F.coalesce("high", "before") != F.col("before"))
    problem = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "gone").when(differs, "changed")
    return rows, all_.select(F.col("path").alias("file"), problem.alias("problem")).filter("problem IS NOT NULL")


#: Locators of revision items, which should be whole numbers.
LOCATORS = ("line", "start", "end", "line_number")


def revision_corpus(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a revision corpus, and ``(identity, field, value, code)`` of locators that are no numbers.

    ``items`` has ``path, position, identity, source, translation, speaker`` and
    the ``LOCATORS`` as strings; ``position`` orders a file's items. A locator
    that is no number counts as 0 and is reported, its row stays. Rows come with
    their ``ordinal`` in the file, a digest of source and translation, and the
    pairs before and after them.
    """
    w = Window.partitionBy("path").orderBy("position")
    number = {c: F.coalesce(F.expr(f"try_cast(trim(`{c}`) AS BIGINT)"), F.lit(0)) for c in LOCATORS}
    text = {c: F.coalesce(c, F.lit("")) for c in ("source", "translation", "speaker")}
    pair = F.struct("source", "translation")
    rows = items.withColumns(text)
    rows = rows.withColumns({"ordinal": F.row_number().over(w), "previous": F.lag(pair).over(w), "next": F.lead(pair).over(w)})
    out = rows.withColumns(number).withColumn("digest", F.sha2(F.concat_ws("\x00", "source", "translation").cast("binary"), 256))
    bad = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in LOCATORS]), lambda x: (F.trim(F.coalesce(x["value"], F.lit(""))) != "") & ~x["value"].rlike(r"^\s*[+-]?[0-9]+\s*$"))
    rejected = items.select("identity", F.explode(bad).alias("b")).select("identity", "b.field", "b.value", F.lit("LOCATOR_NON_NUMERIC").alias("code"))
    return out.select("path", "ordinal", "identity", *LOCATORS, "speaker", "source", "translation", "digest", "previous", "next"), rejected
