"""Commit histories and external results: cherry-picks, touches, siblings, blobs, links, fetched pages, job states."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.columns import cherry_sources, script_redirect
from lodestrata.operators.graph import chase, ends, in_scopes, keyed, kept
from lodestrata.operators.merge import hash_prefix_join

#: Characters that a cited hash has at least.
SHORTEST = 7


def _local_roots(t: pa.Table, number: np.ndarray) -> list[pa.Array]:
    ids = t["id"].combine_chunks()
    (own,) = keyed(number, ids)
    rows = pd.DataFrame({"n": number, "node": own, "id": pa.compute.utf8_lower(ids).to_pandas(), "hash": t["cited_"].to_pandas()})
    rows["pos"] = pa.compute.rank(t["pos"].combine_chunks(), tiebreaker="min").to_numpy()
    nodes, at, node = np.unique(own, return_index=True, return_inverse=True)
    cited = rows[rows["hash"].str.len() >= SHORTEST].assign(p=lambda x: x["hash"].str[:SHORTEST])
    side = rows[rows["id"].notna() & rows["n"].isin(cited["n"])].assign(p=lambda x: x["id"].str[:SHORTEST])
    met = cited.merge(side, on=["n", "p"], suffixes=("", "_to"))
    fits = np.array([b.startswith(h[:40]) and a != b for h, a, b in zip(met["hash"], met["id"], met["id_to"], strict=True)], dtype=bool)
    met = met[fits].assign(e=lambda x: (x["id_to"] != x["hash"]).astype(int)).sort_values(["node", "e", "pos_to"], kind="stable").drop_duplicates("node")
    following = np.full(len(nodes), -1)
    following[np.searchsorted(nodes, met["node"].to_numpy(np.int64))] = np.searchsorted(nodes, met["node_to"].to_numpy(np.int64))
    end, _ = ends(following)
    root = at[np.where(end >= 0, end, np.arange(len(nodes)))]
    return [ids.take(pa.array(root[node]))]


def cherry_roots(commits: DataFrame, scope: str, most: int | None = None) -> DataFrame:
    """Commits (scope, id, message, pos) with root: where the chain of cherry-picks that their messages cite begins.

    A cited hash may be a prefix; it names the first commit of the scope that it fits. A cycle's members stay.
    """
    cited = commits.withColumn("cited_", F.get(cherry_sources(F.col("message")), F.lit(0)))
    return in_scopes(cited, [scope], _local_roots, "root string", lambda c: _joined_roots(c.drop("cited_"), scope).withColumn("cited_", F.lit(None).cast("string")), most).drop("cited_")


def _joined_roots(commits: DataFrame, scope: str) -> DataFrame:
    """The same by a join on prefixes and pointer doubling, for scopes of any size."""
    commits = kept(commits, "commits")
    cited = commits.select(scope, F.col("id").alias("from"), F.get(cherry_sources(F.col("message")), F.lit(0)).alias("hash")).where("hash is not null")
    side = commits.select(F.col(scope).alias("scope_"), "id", "pos")
    fits = hash_prefix_join(cited, side, n=40).where((F.col(scope) == F.col("scope_")) & (F.lower("id") != F.lower("from")))
    exact = (F.lower("id") != F.col("hash")).cast("int")
    links = fits.groupBy(scope, "from").agg(F.min_by("id", F.struct(exact.alias("e"), F.col("pos"))).alias("to"))
    key = lambda c: F.concat_ws("\x01", F.col(scope).cast("string"), F.col(c))
    tops = chase(links.select(key("from").alias("node"), key("to").alias("next")))
    root = F.when(F.col("steps").isNotNull(), F.substring_index("root", "\x01", -1))
    met = commits.withColumn("node", key("id")).join(tops, "node", "left")
    return met.select(*commits.columns, F.coalesce(root, "id").alias("root"))


def expand_sources(seeds: DataFrame, messages: DataFrame) -> DataFrame:
    """All hashes that seeds' messages cite, those that their messages cite, and so on, as far as they exist.

    seeds (hash), messages (hash, message); returns hash and depth, each once, the seeds at depth 0.
    """
    cites = messages.select("hash", F.explode(F.array_distinct(cherry_sources(F.col("message")))).alias("source"))
    exists = messages.select(F.col("hash").alias("source")).distinct()
    cites = kept(cites.join(exists, "source", "left_semi"))
    found = seeds.select("hash").distinct().withColumn("depth", F.lit(0))
    new, depth = found, 0
    while True:
        depth += 1
        new = new.join(cites, "hash").select(F.col("source").alias("hash")).distinct().join(found, "hash", "left_anti").withColumn("depth", F.lit(depth))
        new = kept(new)
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        if depth % 8 == 0:  # the plan does not grow with the rounds
            found = kept(found)


def touches(changes: DataFrame, commits: DataFrame, keys: list[str]) -> DataFrame:
    """The messages of the commits that touched each key, in order: array<struct<pos,id,message>>."""
    met = changes.select(*keys, F.col("commit_id").alias("id")).distinct().join(commits.select("id", "pos", "message"), "id")
    return met.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "message"))).alias("touches"))


def siblings(funcs: DataFrame, scope: list[str], sig: str, most: int = 8) -> DataFrame:
    """For each function the others of its scope, ``most`` at most, and how many there are.

    The scope's functions are collected once, cut to one more than are shown, so no pair is made.
    """
    w = Window.partitionBy(*scope).orderBy("pos")
    numbered = funcs.withColumn("nth_", F.row_number().over(w))
    shown = numbered.where(F.col("nth_") <= most + 1).groupBy(*scope).agg(F.sort_array(F.collect_list(F.struct("pos", F.col(sig).alias("sig")))).alias("all_"))
    sizes = funcs.groupBy(*scope).agg(F.count("*").alias("n_"))
    others = F.slice(F.filter("all_", lambda x: x["pos"] != F.col("pos")), 1, most)
    return funcs.join(shown, scope).join(sizes, scope).select(*funcs.columns, F.transform(others, lambda x: x["sig"]).alias("siblings"), (F.col("n_") - 1).alias("n_siblings"))


def first_file(files: DataFrame, blob: str, file: str, order: list[Column]) -> DataFrame:
    """The first file that each blob was seen as."""
    return files.groupBy(blob).agg(F.min_by(file, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias(file))


def root_parent(instances: DataFrame, chains: DataFrame) -> DataFrame:
    """Instances (cve_id, commit_id) with the root parent of the chain that ends in the commit, else of the only chain."""
    leaf = chains.select("cve_id", F.col("leaf").alias("commit_id"), F.col("root_parent_id").alias("by_leaf"))
    leaf = leaf.groupBy("cve_id", "commit_id").agg(F.min("by_leaf").alias("by_leaf"))
    only = chains.groupBy("cve_id").agg(F.when(F.count("*") == 1, F.min("root_parent_id")).alias("by_chain"))
    return instances.join(leaf, ["cve_id", "commit_id"], "left").join(only, "cve_id", "left").select(*instances.columns, F.coalesce("by_leaf", "by_chain").alias("root_parent_id"))


def fill_links(records: DataFrame, key: str, links: str, resolved: DataFrame) -> DataFrame:
    """Array of (url, hash): links without a hash take the one that ``resolved`` (url, hash) has for their URL."""
    placed = records.select(key, F.posexplode(links).alias("pos_", "l"))
    known = resolved.select(F.col("url").alias("u_"), F.col("hash").alias("h_"))
    met = placed.join(known, F.col("l.url") == F.col("u_"), "left")
    one = F.struct(F.col("l.url").alias("url"), F.coalesce("l.hash", "h_").alias("hash"))
    again = met.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos_", one.alias("x")))), lambda a: a["x"]).alias("links_"))
    return records.join(again, key, "left").withColumn(links, F.coalesce("links_", F.array().cast("array<struct<url:string,hash:string>>"))).drop("links_")


def resolved_url(url: Column, status: Column, final: Column, body: Column, dead: str = "DEAD") -> Column:
    """Where a fetched URL ends: ``dead`` from status 400 on, else a script's redirect, else the final URL, else itself."""
    return F.when(status >= 400, dead).otherwise(F.coalesce(script_redirect(body), F.nullif(final, F.lit("")), url))


def existence(status: Column) -> Column:
    """True for 200, false for 404, null (not known) otherwise."""
    return F.when(status == 200, True).when(status == 404, False)


def job_state(exists: Column, dry: Column, exit_code: Column, seconds: Column, limit: float, size: Column) -> Column:
    """exists, dry_run, or how a job ended: processed, or failed with its reason."""
    return (
        F.when(exists, "exists")
        .when(dry, "dry_run")
        .when(seconds >= limit, "failed: timeout")
        .when(exit_code.isNull() | (exit_code != 0), F.concat(F.lit("failed: exit "), F.coalesce(exit_code.cast("string"), F.lit("?"))))
        .when(F.coalesce(size, F.lit(0)) == 0, "failed: empty output")
        .otherwise("processed")
    )
