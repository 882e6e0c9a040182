"""Writers: layered tables, JSON lines, request rows, grouped layouts, index lines, embeddings with a manifest, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A Parquet table; a job's files appear together when it commits."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def one_file(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def requests(df: DataFrame, custom_id: Column, body: Column) -> DataFrame:
    """Batch request rows: one JSON text each."""
    return df.select(F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), body.alias("body"))).alias("request"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new ones."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def index_lines(df: DataFrame, key: str, parts: list[tuple[Column, int]], last: Column) -> DataFrame:
    """Fixed-width lines, sorted by key: padded parts and a rest of any length, two blanks apart."""
    cells = [F.rpad(F.coalesce(c.cast("string"), F.lit("")), n, " ") for c, n in parts]
    return df.select(F.col(key), F.concat_ws("  ", *cells, F.coalesce(last.cast("string"), F.lit(""))).alias("line")).orderBy(key)


def grouped(df: DataFrame, path: str, cwe: str, modules: str) -> None:
    """A layout by class, and one by each module that a row names."""
    df.write.mode("overwrite").partitionBy(cwe).parquet(f"{path}/by_cwe")
    df.withColumn("module", F.explode(modules)).write.mode("overwrite").partitionBy("module").parquet(f"{path}/by_module")


def manifest(df: DataFrame, vector: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.max(F.size(vector)).alias("dim"), F.min(F.size(vector)).alias("least_dim"))


def both_sides(now: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Files of either version; the side that lacks one has the empty text."""
    a, b = now.select(*keys, F.col("content").alias("content")), parent.select(*keys, F.col("content").alias("parent_content"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("content", F.lit("")).alias("content"), F.coalesce("parent_content", F.lit("")).alias("parent_content"))


def truth_tables(instances: DataFrame, splits: DataFrame, path: str) -> None:
    """Ground truth by split and target."""
    instances.join(splits, "cve_id").write.mode("overwrite").partitionBy("split", "target").parquet(path)
