"""Tables written on the way, so that what follows starts from a file."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the folder that driver and executors share and return a scan of it; cuts lineage.

    The folder is ``spark.checkpoint.dir``, or the context's checkpoint folder;
    where neither is set (tests, a laptop) a temporary one becomes it.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        base = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
