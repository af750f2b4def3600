"""Versions behind a pointer, killed writers, changed files, and sketches that add up."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.operators import reports as P
from quern.sources import snapshots as S


def test_versions_and_a_killed_writer(spark, tmp_path):
    root = str(tmp_path / "store")
    one = {"a": spark.range(5), "b": spark.range(2).selectExpr("id AS x")}
    assert S.versions(spark, root) == {} and S.write(spark, root, one) == 1
    assert S.write(spark, root, {"a": spark.range(7)}, expect=1) == 2
    assert (S.read(spark, root, "a").count(), S.read(spark, root, "a", 1).count(), S.read(spark, root, "b", 1).columns) == (7, 5, ["x"])
    with pytest.raises(S.Conflict):
        S.write(spark, root, one, expect=1)
    with pytest.raises(FileNotFoundError):
        S.read(spark, root, "a", 9)
    assert S.verify(spark, root, 1).count() == 0

    # A writer dies before its pointer: the second table fails, and another after its manifest.
    bad = spark.range(3).select(F.raise_error(F.lit("killed")).alias("x"))
    with pytest.raises(Exception, match="killed"):
        S.write(spark, root, {"a": spark.range(9), "b": bad})
    assert S.read(spark, root, "a").count() == 7 and max(S.versions(spark, root)) == 2
    # A pointer that was cut off names nothing, and its number is not used again.
    (Path(root) / "versions" / "3").write_text("abc")
    assert max(S.versions(spark, root)) == 2 and S.read(spark, root, "a").count() == 7
    assert len(list((Path(root) / "data").iterdir())) == 3
    assert len(S.recover(spark, root)) == 1 and len(list((Path(root) / "data").iterdir())) == 2
    assert S.write(spark, root, one) == 4 and S.read(spark, root, "b").count() == 2 and S.recover(spark, root) == []


def test_two_writers_of_one_number(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    for n in (1, 2):
        S.write(spark, root, {"a": spark.range(n)})
    # A writer that listed the versions before the second was named.
    monkeypatch.setattr(S, "_names", lambda s, folder, names=S._names: ["1"] if folder.endswith("versions") else names(s, folder))
    with pytest.raises(S.Conflict):
        S.write(spark, root, {"a": spark.range(9)})
    monkeypatch.undo()
    assert S.read(spark, root, "a").count() == 2 and S.verify(spark, root, 2).count() == 0 and len(S.recover(spark, root)) == 1


def test_changed_files_are_found(spark, tmp_path):
    root = tmp_path / "store"
    S.write(spark, str(root), {"a": spark.range(50).repartition(3)})
    parts = sorted((root / "data").glob("*/a/*.parquet"))
    parts[0].write_bytes(parts[0].read_bytes() + b"x")
    (parts[0].parent / f".{parts[0].name}.crc").unlink()
    parts[1].unlink()
    (parts[2].parent / "more.bin").write_bytes(b"new")
    assert sorted(r.problem for r in S.verify(spark, str(root), 1).collect()) == ["changed", "missing", "unknown"]


def test_a_file_that_changes_during_the_scan(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.rpy").write_text(f"text of {name}")
    rows, changes = S.scan_checked(spark, str(tmp_path), lambda files: files.select("path", "sha256"), "*.rpy")
    assert rows.count() == 3 and changes.count() == 0

    def scan(files):
        (tmp_path / "a.rpy").write_text("changed")
        (tmp_path / "b.rpy").unlink()
        (tmp_path / "d.rpy").write_text("new")
        return files.sparkSession.createDataFrame([("c.rpy", "read while it was another")], "path string, sha256 string")

    changes = {r.file: r.problem for r in S.scan_checked(spark, str(tmp_path), scan, "*.rpy")[1].collect()}
    assert changes == {"a.rpy": "changed", "b.rpy": "gone", "c.rpy": "changed", "d.rpy": "added"}


def test_merged_sketches_equal_the_whole(spark):
    rng = random.Random(4)
    values = [rng.choice([0.0, None, float("nan"), rng.lognormvariate(0, 4), -rng.random(), rng.random() * 1e12]) for _ in range(4000)]
    rows = spark.createDataFrame([(i % 7, i % 3, v) for i, v in enumerate(values)], "part int, g int, x double")
    parts, whole = (P.quantile_sketch(rows, by, "x") for by in (["part", "g"], ["g"]))
    levels = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    merged, once = ({r.g: tuple(r) for r in P.merge_quantiles(s, ["g"], levels).collect()} for s in (parts, whole))
    assert merged == once
    for g, row in merged.items():
        mine = sorted(v for i, v in enumerate(values) if i % 3 == g and v is not None and v == v)
        assert row[1] == len(mine)
        for q, said in zip(levels, row[2:], strict=True):
            true = mine[int(q * (len(mine) - 1))]
            assert abs(said - true) <= P.ACCURACY * abs(true) * 1.000001
    names = spark.range(60_000).selectExpr("id % 5 AS part", "id % 20000 AS v")
    near = [P.merge_distinct(P.distinct_sketch(names, by, "v"), []).first() for by in (["part"], [])]
    assert near[0] == near[1] and abs(near[0].n_distinct - 20_000) <= 5 * 1.04 / 2 ** (P.HLL_BITS / 2) * 20_000


def test_one_scan(spark, tmp_path):
    spark.range(20).selectExpr("id % 2 AS a", "id % 3 AS b", "if(id > 4, id, null) AS c").write.parquet(str(tmp_path / "t"))
    report = P.histograms(spark.read.parquet(str(tmp_path / "t")), [["a"], ["b"], ["a", "b"], []], n=F.count("*"), c=F.sum("c"))
    assert report._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r.report: 0 for r in report.collect()} == {"a": 0, "b": 0, "a,b": 0, "": 0} and report.filter("report = ''").first().n == 20
