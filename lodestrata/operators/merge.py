"""Merging of sources, references and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.columns import filled, first_filled


def merge_sources(sources: dict[str, DataFrame], key: str, priority: dict[str, list[str]]) -> DataFrame:
    """Full outer merge of one-row-per-key sources; each field takes the first source of its list that fills it.

    The result also says which sources had the key (in_<source>).
    """
    out = None
    for name, df in sources.items():
        side = df.select(F.col(key), *[F.col(c).alias(f"{name}__{c}") for c in df.columns if c != key], F.lit(True).alias(f"in_{name}"))
        out = side if out is None else out.join(side, key, "full")
    fields = [first_filled(*[F.col(f"{s}__{f}") for s in order]).alias(f) for f, order in priority.items()]
    return out.select(key, *fields, *[F.coalesce(f"in_{s}", F.lit(False)).alias(f"in_{s}") for s in sources])


def overlap_counts(merged: DataFrame, sources: list[str]) -> DataFrame:
    """Keys that only one source has, and those that all have."""
    everywhere = F.lit(True)
    only = []
    for s in sources:
        alone = F.col(f"in_{s}")
        for o in sources:
            if o != s:
                alone = alone & ~F.col(f"in_{o}")
        only.append(F.count_if(alone).alias(f"only_{s}"))
        everywhere = everywhere & F.col(f"in_{s}")
    return merged.agg(F.count("*").alias("n_keys"), *only, F.count_if(everywhere).alias("in_all"))


def union_references(refs: DataFrame, key: str) -> DataFrame:
    """References (key, pos, url, source, tags) by URL: sorted distinct sources and tags, in order of first sight."""
    one = refs.groupBy(key, "url").agg(
        F.min("pos").alias("pos"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))))).alias("tags"),
    )
    return one.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "url", "sources", "tags"))).alias("refs_")).select(key, F.transform("refs_", lambda x: F.struct(x["url"].alias("url"), x["sources"].alias("sources"), F.when(F.size(x["tags"]) > 0, x["tags"]).alias("tags"))).alias("references"))


def backfill(df: DataFrame, lookup: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Blank fields take the lookup's value for the key."""
    side = lookup.select(F.col(key).alias("k_"), *[F.col(f).alias(f"new_{f}") for f in fields])
    met = df.join(side, df[key] == side["k_"], "left")
    return met.select(*[F.coalesce(filled(F.col(c)), F.col(f"new_{c}"), F.lit("")).alias(c) if c in fields else F.col(c) for c in df.columns])


def rewrite_elements(df: DataFrame, key: str, items: str, lookup: DataFrame, dead: str = "DEAD") -> DataFrame:
    """Array elements replaced by the lookup (old, new), kept where it has none, dropped where it says ``dead``; distinct, in order.

    Rows whose array is empty or null stay, with an empty array.
    """
    placed = df.select(key, F.posexplode(items).alias("pos_", "old"))
    new = placed.join(lookup, "old", "left").select(key, "pos_", F.coalesce("new", "old").alias("item_")).where(F.col("item_") != dead)
    again = new.groupBy(key).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos_", "item_"))), lambda x: x["item_"])).alias("items_"))
    return df.join(again, key, "left").withColumn(items, F.coalesce("items_", F.array().cast("array<string>"))).drop("items_")


def keep_elements(df: DataFrame, key: str, items: str, allowed: DataFrame) -> DataFrame:
    """Array elements that ``allowed`` (item) holds, in order; rows without any stay."""
    placed = df.select(key, F.posexplode(items).alias("pos_", "item"))
    kept = placed.join(allowed.select("item").distinct(), "item", "left_semi")
    again = kept.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos_", "item"))), lambda x: x["item"]).alias("items_"))
    return df.join(again, key, "left").withColumn(items, F.coalesce("items_", F.array().cast("array<string>"))).drop("items_")


def enrich_elements(df: DataFrame, key: str, items: str, details: DataFrame, element_key: str) -> DataFrame:
    """Array elements replaced by their detail rows (structs), in order, one each; those without details go."""
    fields = [c for c in details.columns if c != element_key]
    placed = df.select(key, F.posexplode(F.array_distinct(items)).alias("pos_", element_key))
    found = placed.join(details, element_key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos_", F.struct(element_key, *fields).alias("d_")))).alias("found_"))
    out = df.join(found, key, "left")
    return out.withColumn(f"{items}_details", F.transform("found_", lambda x: x["d_"])).drop("found_")


def union_elements(df: DataFrame, extra: DataFrame, key: str, items: str, extra_items: str) -> DataFrame:
    """The row's array, then what ``extra`` (key, array) has beyond it; each element once. Rows without either have none."""
    side = extra.select(key, F.col(extra_items).alias("extra_"))
    none = F.array().cast(df.schema[items].dataType)
    return df.join(side, key, "left").withColumn(items, F.array_union(F.coalesce(items, none), F.coalesce("extra_", none))).drop("extra_")


def overlay(plan: DataFrame, previous: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Fields of an earlier run win over the plan's where they are there."""
    side = previous.select(*keys, *[F.col(f).alias(f"p_{f}") for f in fields])
    met = plan.join(side, keys, "left")
    return met.select(*[F.coalesce(f"p_{c}", c).alias(c) if c in fields else F.col(c) for c in plan.columns])


def to_do(plan: DataFrame, status: DataFrame, keys: list[str], done: list[str], overwrite: bool = False) -> DataFrame:
    """The plan's rows that have no successful status; all of them if they are to be overwritten."""
    return plan if overwrite else plan.join(status.where(F.col("status").isin(done)), keys, "left_anti")


def hash_prefix_join(links: DataFrame, commits: DataFrame, n: int = 12, minimum: int = 7) -> DataFrame:
    """links (hash) with commits (id) of which one starts with the other; both at least ``minimum`` long.

    An equi-join on the shortest prefix finds candidates, so no pair is tried that cannot match.
    """
    short = lambda c: F.substring(F.lower(c), 1, minimum)
    a, b = links.withColumn("p_", short(F.col("hash"))), commits.withColumn("p_", short(F.col("id")))
    one, other = F.lower(F.col("hash")), F.lower(F.col("id"))
    fits = F.substring(other, F.lit(1), F.least(F.length(one), F.lit(n))) == F.substring(one, F.lit(1), F.least(F.length(one), F.lit(n)))
    return a.where(F.length("hash") >= minimum).join(b, "p_").where(fits).drop("p_")


def svn_join(revisions: DataFrame, commits: DataFrame) -> DataFrame:
    """svn revisions (path, revision) with git commits (svn_root, revision): same number, one path below the other."""
    return revisions.join(commits, "revision").where(F.startswith("svn_root", "path") | F.endswith("svn_root", "path"))


def pairs_of_versions(files: DataFrame, keys: list[str], path: str, parent_path: Column) -> DataFrame:
    """Each file with its parent version; both have to be there."""
    parents = files.where("is_parent").select(*keys, parent_path.alias("file_"), F.col("content").alias("parent_content"))
    now = files.where("not is_parent").withColumn("file_", F.col(path))
    return now.join(parents, [*keys, "file_"]).drop("file_", "is_parent")
