"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessella import settings

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application: for functions that run in Python there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="tessella-")) / "tessella_core.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, str(Path(package.name) / p.relative_to(package)))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder where a session on a single machine names none.  On a cluster that is an error: executors would not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="tessella-store-")
        base = "file://" + _OWN[app]
    return f"{base.rstrip('/')}/{app}"


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def many(df: DataFrame) -> DataFrame:
    """Rows that grow with the input, for a join: sorted and merged, never broadcast.  Spark's estimates leave out what explode adds and take compressed sizes of files."""
    return df.hint("merge")


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write and read back: a lost executor costs no lineage before this point."""
    to = path(df.sparkSession, name)
    df.write.option("compression", settings.get(df.sparkSession, "table_codec")).parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)
