"""Queries over all their rows, and operators without a bound on rounds, size or query set."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestrata.operators import graph, history, retrieval
from lodestrata.plans import catalog

D = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


def run(spark, name):
    return entry.queries()[name](spark, D)


@tables
@pytest.mark.parametrize("name", ["dense_topk", "hard_negatives", "rank_metrics"])
def test_every_hundredth_vector_is_searched_for(spark, name):
    e = spark.read.parquet(f"{D}/embeddings.parquet")
    want = {r[0] for r in e.where("vec_id % 100 = 0").select("vec_id").collect()}
    got = {r[0] for r in run(spark, name).select("query").distinct().collect()}
    assert got == want if name != "hard_negatives" else got and got <= want


def test_blocks_of_queries_give_the_same_scores(spark):
    v = spark.range(60).select(F.col("id").alias("doc"), F.array(*[F.sin(F.col("id") * k) for k in (1, 2, 3)]).alias("v"))
    q = v.select(F.col("doc").alias("query"), F.col("v").alias("q"))
    one, many = (retrieval.dense_scores(q, v, [], block) for block in (1000, 7))
    assert sorted(one.collect()) == sorted(many.collect()) and many.count() == 3600
    assert many._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 9


@tables
def test_singletons_are_counted_over_all_owners(spark):
    f = spark.read.parquet(f"{D}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity").collect()
    rows = {(r[0], f"ns::f{r[1] % 6}", "root" if r[2] > 30 else "other") for r in f}
    owners = {}
    for k, name, label in rows:
        owners.setdefault((name, label), set()).add(k)
    marked = [(k, name, label if len(owners[name, label]) > 1 else "other") for k, name, label in rows]
    alive = {k for k, _, label in marked if label != "other"}
    got = [tuple(r) for r in run(spark, "singleton_relabel").select("k", "name", "label").collect()]
    assert sorted(got) == sorted(m for m in marked if m[0] in alive)
    assert any(k % 40 for k, _, _ in got)


@tables
def test_functions_of_every_part_are_compared(spark):
    odd = {r[0] for r in spark.read.parquet(f"{D}/part.parquet").where("p_partkey % 2 = 1").select("p_partkey").collect()}
    assert {r["file"] for r in run(spark, "code_functions").collect()} == odd and max(odd) > 50


@tables
def test_all_orders_and_customers_take_part(spark):
    assert run(spark, "cherry_roots").count() == spark.read.parquet(f"{D}/orders.parquet").count()
    links = {r["link"] for r in run(spark, "prefix_join").collect()}
    assert links == {r[0] for r in spark.read.parquet(f"{D}/customer.parquet").select("c_custkey").collect()}


def test_long_chains_and_paths_have_no_last_round(spark):
    h = [f"{i:040x}" for i in range(54)]
    m = spark.createDataFrame([(x, f"(cherry picked from commit {y})") for x, y in zip(h, h[1:])] + [(h[-1], "x")], "hash string, message string").coalesce(1)
    got = {r["hash"]: r["depth"] for r in history.expand_sources(m.where(F.col("hash") == h[0]), m).collect()}
    assert got == {x: i for i, x in enumerate(h)}
    e = spark.createDataFrame([(i, i + 1) for i in range(63)], "child int, parent int").coalesce(1)
    assert [r["path"] for r in graph.root_paths(spark.createDataFrame([(0,)], "node int"), e).collect()] == [list(range(64))]


def test_a_tree_for_each_label(spark):
    train = spark.createDataFrame([(i, ["left", "word"] if i % 3 == 0 else ["right", "word"] if i % 3 == 1 else ["up", "word"], "abc"[i % 3]) for i in range(30)], "doc long, tokens array<string>, label string")
    test = spark.createDataFrame([(100, ["left", "right"]), (101, ["the"])], "doc long, tokens array<string>")
    got = {}
    for r in retrieval.tree_ranking(train, test).collect():
        got.setdefault(r["doc"], {})[r["label"]] = r["predicted"]
    assert got[100] == {"a": True, "b": True, "c": False}
    deep = spark.createDataFrame([(i, [f"t{i:02d}", "same"], "xy"[i % 2]) for i in range(24)], "doc long, tokens array<string>, label string")
    best = {r["doc"]: r["label"] for r in retrieval.tree_ranking(deep, deep.drop("label")).where("rank = 1").collect()}
    assert best == {i: "xy"[i % 2] for i in range(24)}


@tables
def test_votes_over_five_thousand_terms(spark):
    whole, few = (sorted(map(tuple, x.collect())) for x in (run(spark, "tfidf_knn_vote"), catalog._votes(spark, D, 2000)))
    assert whole != few and whole == sorted(map(tuple, catalog._votes(spark, D, 5000).collect()))
