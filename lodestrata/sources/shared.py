"""Intermediate tables in the folder that the driver and all executors share; they are deleted when the driver ends."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else one in the warehouse, which executors share as well."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/lodestrata/{uuid.uuid4().hex}/{name}"
    _written.append((spark, path.rsplit("/", 1)[0]))
    return path


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """This package to the executors' Python, once an application; they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lodestrata-")), "lodestrata_engine.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "lodestrata")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), top))
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _clean() -> None:
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001, S110  the JVM may have ended first
            pass
    _written.clear()


atexit.register(_clean)
