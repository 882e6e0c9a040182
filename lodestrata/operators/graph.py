"""Graphs: hierarchy paths, representatives, pointer chasing, linear chains."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.sources.shared import kept, ship

#: Rows of whole scopes that a task follows in memory; a scope with more goes by joins.
MOST = 200_000


def root_paths(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """All upward paths from each start (node) over edges (child, parent): path array, ends where no unvisited parent is.

    One join a level; a path that would come back to a node of its own ends there, so cycles do no harm.
    """
    live = starts.select(F.col("node").alias("start"), F.array(F.col("node")).alias("path"))
    done = None
    while True:
        up = live.join(edges, F.element_at("path", -1) == F.col("child"), "left")
        up = up.withColumn("next", F.when(F.col("parent").isNotNull() & ~F.coalesce(F.array_contains("path", F.col("parent")), F.lit(False)), F.col("parent")))
        steps = up.groupBy("start", "path").agg(F.collect_set("next").alias("nexts"))
        steps = kept(steps)
        ended = steps.where(F.size("nexts") == 0).select("start", "path")
        done = ended if done is None else done.unionByName(ended)
        live = steps.select("start", F.explode("nexts").alias("n"), "path").select("start", F.concat("path", F.array("n")).alias("path"))
        if live.isEmpty():
            return done


def representatives(paths: DataFrame, roots: DataFrame, members: DataFrame, top: str = "1000", categories: str = "699") -> DataFrame:
    """start, rep, path: a path that ends in a root (or is the node alone) stands for its top; every node of a path also
    stands for each category (node, category) that holds it. A start with neither stands for itself.
    """
    last = F.element_at("path", -1)
    p = paths.join(roots.select(F.col("node").alias("root_")), last == F.col("root_"), "left")
    whole = p.where(F.col("root_").isNotNull() | (F.size("path") == 1)).select("start", last.alias("rep"), F.concat("path", F.array(F.lit(top))).alias("path"))
    placed = paths.select("start", "path", F.posexplode("path").alias("pos", "node")).join(members, "node")
    sub = placed.select("start", "node", F.col("category").alias("rep"), F.concat(F.slice("path", F.lit(1), F.col("pos") + 1), F.array(F.col("category"), F.lit(categories))).alias("path"))
    sub = sub.groupBy("start", "node", "rep").agg(F.min("path").alias("path")).select("start", "rep", "path")
    found = whole.unionByName(sub).distinct()
    alone = paths.select("start").distinct().join(found, "start", "left_anti").select("start", F.col("start").alias("rep"), F.array("start").alias("path"))
    return found.unionByName(alone)


def chase(links: DataFrame) -> DataFrame:
    """node, root, steps over links (node, next), at most one per node, by pointer doubling: log2(longest) rounds.

    A node on a cycle has no end to reach; the smallest node of its cycle stands for the root.
    """
    ends = links.select(F.col("next").alias("node")).distinct().join(links.select("node"), "node", "left_anti")
    at = links.select("node", F.col("next").alias("to"), F.lit(1).alias("steps"), F.least("node", "next").alias("low"))
    at = at.unionByName(ends.select("node", F.col("node").alias("to"), F.lit(0).alias("steps"), F.col("node").alias("low")))
    at = kept(at)
    final = ends.select(F.col("node").alias("to"), F.lit(True).alias("end"))
    most = at.count()
    reach = 1
    while True:
        open_ = at.join(final, "to", "left_anti")
        if reach > 2 * most or open_.isEmpty():
            break
        jump = at.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"), F.col("low").alias("low2"))
        at = kept(at.join(jump, "to").select("node", F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.least("low", "low2").alias("low")))
        reach *= 2
    out = at.join(final, "to", "left")
    return out.select("node", F.when(F.col("end"), F.col("to")).otherwise(F.col("low")).alias("root"), F.when(F.col("end"), F.col("steps")).alias("steps"))


def scope_numbers(t: pa.Table, scope: list[str]) -> np.ndarray:
    """A number for each run of rows of one scope; rows with a null in it are alone."""
    new = np.zeros(len(t), bool)
    new[:1] = True
    for c in scope:
        code = t[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        new[1:] |= (code[1:] != code[:-1]) | (code[1:] < 0)
    return np.cumsum(new) - 1


def in_scopes(df: DataFrame, scope: list[str], local: Callable[[pa.Table, np.ndarray], list[pa.Array]], added: str, joined: Callable[[DataFrame], DataFrame], most: int | None = None) -> DataFrame:
    """``df`` with the columns ``added`` (name type, ...), which depend on the rows of one scope only.

    Scopes meet whole in a task by one shuffle, and ``local`` gets some 200,000 rows of whole scopes at once, with the
    scope's number for each; scopes of more rows than ``most`` are left to ``joined``, which returns the same columns.
    """
    ship(df.sparkSession)
    most = most or MOST
    names = [*df.columns, *[a.strip().split(" ")[0] for a in added.split(",")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from pa.Table.from_arrays([*t.columns, *local(t, scope_numbers(t, scope))], names).combine_chunks().to_batches(max_chunksize=20_000)

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= most:
                t = pa.Table.from_batches(held)
                number = scope_numbers(t, scope)
                cut = int(np.searchsorted(number, number[-1]))
                if cut:
                    yield from done(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    def by_scope(some: DataFrame) -> DataFrame:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return some.repartition(*scope).sortWithinPartitions(*scope).mapInArrow(run, f"{kinds}, {added}")

    # no more than a row for each ``most`` rows
    large = [r.asDict() for r in df.groupBy(*scope).agg(F.count("*").alias("n_")).where(F.col("n_") > most).drop("n_").na.drop().collect()]
    if not large:
        return by_scope(df)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in scope)
    large = F.broadcast(df.sparkSession.createDataFrame([tuple(r[c] for c in scope) for r in large], kinds))
    return by_scope(df.join(large, scope, "left_anti").select(*df.columns)).unionByName(joined(df.join(large, scope, "left_semi").select(*df.columns)).select(*names))


def keyed(number: np.ndarray, *columns: pa.Array) -> list[np.ndarray]:
    """Columns of one kind as numbers, equal where scope and value are; -1 for null."""
    code = pa.concat_arrays(columns).dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64)
    width = int(code.max(initial=0)) + 1
    return [np.where(c < 0, -1, number * width + c) for c in np.split(code, len(columns))]


def ends(following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node the end of its way over ``following`` (-1: none) and the steps to it; -1 and 0 where it runs in a cycle."""
    linked = following >= 0
    to, steps = np.where(linked, following, np.arange(len(following))), linked.astype(np.int64)
    for _ in range(len(following).bit_length()):
        far = to[to]
        if (far == to).all():
            break
        steps, to = steps + steps[to], far
    return np.where(linked[to], -1, to), np.where(linked[to], 0, steps)


def _local_chains(t: pa.Table, number: np.ndarray) -> list[pa.Array]:
    text = t["id_"].combine_chunks()
    own, parent = keyed(number, text, t["parent_"].combine_chunks())
    nodes, at, node = np.unique(own, return_index=True, return_inverse=True)
    up = np.searchsorted(nodes, parent)
    up = np.where((parent >= 0) & (nodes[np.minimum(up, len(nodes) - 1)] == parent), np.minimum(up, len(nodes) - 1), -1)
    inside = np.zeros(len(nodes), bool)
    inside[node[up >= 0]] = True
    rows = np.flatnonzero(up >= 0)
    place = pa.compute.rank(t["pos"].combine_chunks(), tiebreaker="min").to_numpy().astype(np.int64)
    rows = rows[np.lexsort((place[rows], up[rows]))]
    rows = rows[np.r_[True, up[rows][1:] != up[rows][:-1]]] if len(rows) else rows
    following = np.full(len(nodes), -1)
    following[node[rows]] = up[rows]
    end, steps = ends(following)
    good = (end >= 0) & ~inside[end]
    root = text.take(pa.array(at[end], mask=~good))
    return [root.take(pa.array(node)), pa.array(steps.astype(np.int32), mask=~good).take(pa.array(node))]


def linear_chains(commits: DataFrame, scope: list[str], most: int | None = None) -> DataFrame:
    """Chains of commits (id, parent_id, pos): from each commit without a parent in its scope, along first children.

    Returns every commit with chain_root and depth; commits on other branches of a fork have no chain (null).
    """
    text = commits.withColumns({"id_": F.col("id").cast("string"), "parent_": F.col("parent_id").cast("string")})
    return in_scopes(text, scope, _local_chains, "chain_root string, depth int", lambda c: _joined_chains(c, scope), most).drop("id_", "parent_")


def _joined_chains(commits: DataFrame, scope: list[str]) -> DataFrame:
    """The same by joins and pointer doubling, for scopes of any size."""
    commits = kept(commits, "commits")
    ids = commits.select(*scope, F.col("id").alias("parent_id")).distinct()
    inside = commits.join(ids, [*scope, "parent_id"], "left_semi")
    first = inside.groupBy(*scope, "parent_id").agg(F.min_by("id", "pos").alias("id"))
    key = F.concat_ws("\x01", *[F.col(c).cast("string") for c in scope], F.col("id").cast("string"))
    links = first.select(key.alias("node"), F.concat_ws("\x01", *[F.col(c).cast("string") for c in scope], F.col("parent_id").cast("string")).alias("next"))
    tops = chase(links)
    roots = commits.join(inside.select(*scope, "id"), [*scope, "id"], "left_anti").select(key.alias("root_"))
    out = commits.withColumn("node", key).join(tops, "node", "left")
    out = out.withColumn("top_", F.coalesce("root", "node")).join(roots.distinct(), F.col("top_") == F.col("root_"), "left")
    return out.select(*commits.columns, F.when(F.col("root_").isNotNull(), F.element_at(F.split("top_", "\x01"), -1)).alias("chain_root"), F.when(F.col("root_").isNotNull(), F.coalesce("steps", F.lit(0))).alias("depth"))


def topology(chains: DataFrame) -> DataFrame:
    """Distribution of shapes over keys (n_chains, longest, absorbed): count and share."""
    shape = F.when(F.col("n_chains") == 0, "none").when((F.col("n_chains") == 1) & (F.col("longest") == 1), "single").when(F.col("n_chains") == 1, "linear").when(F.col("longest") == 1, "parallel").otherwise("mixed")
    counted = chains.withColumn("shape", F.when(F.col("absorbed") > 0, F.concat(shape, F.lit("+absorbed"))).otherwise(shape)).groupBy("shape").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over a row for each shape
    return counted.select("shape", "n", F.round(F.col("n") / total, 6).alias("share"))
