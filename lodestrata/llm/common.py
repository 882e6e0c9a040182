"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.shared import kept as materialise  # noqa: F401  used by the operators

#: ASCII white space as the contracts define it: space and \x09-\x0D.
SPACE = "[\\x20\\x09-\\x0D]"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Spark bring this package to Python workers, whose path need not have it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lodestrata-")), "lodestrata_llm.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "lodestrata")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), top))
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside: long texts stay within a task's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    if before is None or int(before) <= 0 or int(before) > rows:
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that nested lambdas do not evaluate its expression again per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that clashes with none of ``df``'s (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name
