"""Chronological splits, shards, sampling and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.columns import md5_shard
from lodestrata.sources.shared import kept


def counts_before(df: DataFrame, by: str) -> DataFrame:
    """Distinct values of ``by`` (value, null first), how many rows have each (n) and how many rows stand before it (skip).

    Values are range-partitioned and written with the number of their range; ranges are summed to a row each, and only
    those rows, as many as there are partitions, pass through one ordered window. No task sees more than its range.
    """
    counts = df.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n"))
    ranged = kept(counts.repartitionByRange(F.col("value").asc_nulls_first()).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("range").agg(F.sum("n").alias("n_range")).select("range", F.coalesce(F.sum("n_range").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(ranges), "range").select("value", "n", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("skip"))


def global_rank(df: DataFrame, by: str, tie: list[str]) -> DataFrame:
    """Row numbers over the whole table ordered by ``by`` (blank first), then ``tie``; rows are numbered within their value."""
    offsets = counts_before(df, by).select(F.col("value").alias("by_"), F.col("skip").alias("skip_"))
    inside = Window.partitionBy(by).orderBy(*[F.col(t).asc() for t in tie])
    met = df.withColumn("nth_", F.row_number().over(inside)).join(offsets, df[by].eqNullSafe(offsets["by_"]))
    return met.withColumn("rank", F.col("nth_") + F.col("skip_")).drop("nth_", "skip_", "by_")


def chronological_split(df: DataFrame, by: str, tie: list[str], shares: tuple[float, float] = (0.7, 0.1)) -> DataFrame:
    """split: train, val, test at floor(n * share) of the rows in order."""
    n = df.count()
    a, b = int(n * shares[0]), int(n * shares[0]) + int(n * shares[1])
    return global_rank(df, by, tie).withColumn("split", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= b, "val").otherwise("test"))


def random_split(df: DataFrame, key: str, shares: tuple[float, float] = (0.7, 0.1), seed: int = 42) -> DataFrame:
    h = F.xxhash64(F.lit(seed), key)
    return chronological_split(df.withColumn("h_", h), "h_", [key], shares).drop("h_")


def shard(df: DataFrame, key: str, shards: int, index: int | None = None) -> DataFrame:
    out = df.withColumn("shard", md5_shard(F.col(key).cast("string"), shards))
    return out if index is None else out.where(F.col("shard") == index)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.select(*keys), keys, "left_anti")


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if not a.join(b, key, "left_semi").isEmpty():
        raise ValueError(f"{key} occurs on both sides")


def one_of(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A sample of one row that depends on the seed and the keys alone."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(1)


def failure_runs(log: DataFrame, scope: list[str], order: str, ok: Column, limit: int) -> DataFrame:
    """Rows up to where ``limit`` failures in a row stop the work; adds run, the failures in a row so far."""
    w = Window.partitionBy(*scope).orderBy(order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = log.withColumn("island_", F.sum(ok.cast("int")).over(up_to)).withColumn("ok_", ok)
    inside = Window.partitionBy(*scope, "island_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("run", F.sum((~F.col("ok_")).cast("int")).over(inside))
    broken = F.sum((F.col("run") >= limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("broken_", F.coalesce(broken, F.lit(0))).where("broken_ = 0").drop("island_", "ok_", "broken_")


def segments(lines: DataFrame, scope: list[str], order: str, header: Column) -> DataFrame:
    """Numbers blocks of lines; a header line begins one."""
    w = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.sum(header.cast("int")).over(w))


def prefix_to_last(rows: DataFrame, scope: list[str], order: str, flag: Column) -> DataFrame:
    """Rows up to the last one with the flag; all rows where none has it."""
    cut = rows.groupBy(*scope).agg(F.max(F.when(flag, F.col(order))).alias("cut_"))
    return rows.join(cut, scope).where(F.col("cut_").isNull() | (F.col(order) <= F.col("cut_"))).drop("cut_")
