"""De-duplication and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.columns import HEADER, IMPLEMENTATION, canonical_message, dirname, extension, qualified_name
from lodestrata.sources.shared import kept

__all__ = ["HEADER", "canonical_duplicates", "collapse_headers", "first_by", "mark_singletons", "net_state", "without_singletons"]


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order. Aggregated before the shuffle, so frequent keys do no harm."""
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("row_"))
    return best.select(*keys, *[F.col(f"row_.{c}").alias(c) for c in rest]).select(*df.columns)


def canonical_duplicates(commits: DataFrame, scope: list[str]) -> DataFrame:
    """Commits (id, commit_date, message, pos) by canonical message: the earliest stays, undated ones come last.

    Adds keeper (the id that stays) and is_kept.
    """
    keyed = commits.withColumn("digest", F.sha1(canonical_message(F.col("message"))))
    order = F.struct(F.coalesce(F.nullif("commit_date", F.lit("")), F.lit("￿")).alias("d"), F.col("pos"))
    best = keyed.groupBy(*scope, "digest").agg(F.min_by("id", order).alias("keeper"))
    return keyed.join(best, [*scope, "digest"]).withColumn("is_kept", F.col("id") == F.col("keeper"))


def collapse_headers(funcs: DataFrame, scope: list[str]) -> DataFrame:
    """Functions (file, sig, pos) of one folder and qualified name: the first in an implementation file, else the first."""
    keyed = funcs.withColumn("dir_", dirname(F.col("file"))).withColumn("name_", qualified_name(F.col("sig")))
    rest = [c for c in funcs.columns if c not in scope]
    rank = F.struct((~F.lower(extension(F.col("file"))).isin(IMPLEMENTATION)).alias("a"), F.col("pos"))
    best = keyed.groupBy(*scope, "dir_", "name_").agg(F.min_by(F.struct(*rest), rank).alias("row_"), F.min("pos").alias("order_"))
    return best.select(*scope, *[F.col(f"row_.{c}").alias(c) for c in rest], F.col("order_").alias("group_pos"))


def _counted(df: DataFrame, keys: list[str], owner: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(owner).alias("n_owners"))


def without_singletons(df: DataFrame, keys: list[str], owner: str, least: int = 2) -> DataFrame:
    """Rows whose key belongs to at least ``least`` owners."""
    return df.join(_counted(df, keys, owner).where(F.col("n_owners") >= least).drop("n_owners"), keys, "left_semi")


def mark_singletons(df: DataFrame, keys: list[str], owner: str, label: str, instead: str) -> DataFrame:
    """Rows whose key has one owner get another label; owners left without a label other than that go."""
    df = kept(df, "labelled")  # read for the counts, the labels and the owners that stay
    one = kept(df.groupBy(*keys).agg(F.coalesce(F.min(owner) == F.max(owner), F.lit(True)).alias("one_")), "owners")
    marked = df.join(one, keys).withColumn(label, F.when(F.col("one_"), instead).otherwise(F.col(label))).drop("one_")
    alive = marked.where(F.col(label) != instead).select(owner).distinct()
    return marked.join(alive, owner, "left_semi")


def net_state(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What a chain of events (category, code, code_after) did to each key.

    Keys that were added first are gone again or new, so they go; so do those whose last body equals the first.
    """
    e = F.struct(order, F.col("category"), F.when(F.col("category") != "added", F.col("code")).alias("before"), F.when(F.col("category") == "added", F.col("code")).when(F.col("category") == "modified", F.col("code_after")).alias("after"))
    ends = events.groupBy(*keys).agg(F.min_by(e, order).alias("first_"), F.max_by(e, order).alias("last_"))
    ends = ends.where("first_.category <> 'added'")
    same = (F.col("last_.category") != "removed") & F.coalesce(F.col("first_.before") == F.col("last_.after"), F.lit(False))
    return ends.where(~same).select(*keys, F.when(F.col("last_.category") == "removed", "removed").otherwise("modified").alias("last_action"), F.col("first_.before").alias("code"), F.col("last_.after").alias("code_after"))
