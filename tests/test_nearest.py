"""Searches that keep the best of each task, and chains that are followed inside their scope."""

import math
from collections import Counter

from pyspark.sql import functions as F

from lodestrata.operators import graph, history, nearest, retrieval


def test_bm25_has_no_row_for_each_pair(spark):
    words = [" ".join(f"w{(i * j) % 7}" for j in range(1, 5 + i % 3)) for i in range(400)]
    rows = [(i, "ab"[i % 2], t) for i, t in enumerate(words)] + [(3, "b", words[3]), (5, "b", "w1 w1")]
    docs = spark.createDataFrame(rows, "doc long, lang string, text string").repartition(3)
    queries = spark.createDataFrame([(q, lang, f"w{q} w1 w1") for q in range(5) for lang in "ab"], "query long, lang string, text string")
    got = retrieval.bm25_top(queries, docs, ["lang"], "doc", F.split("text", " "), F.split("text", " "), [(1.5, 0.75), (2.0, 0.5)], 4)
    want = {}
    p = Counter((lang, doc, len(t.split()), w) for doc, lang, t in rows for w in t.split())
    for q in range(5):
        for k1, b in ((1.5, 0.75), (2.0, 0.5)):
            s = Counter()
            for (lang, doc, dl, w), tf in p.items():
                of = [t.split() for _, x, t in rows if x == lang]
                df, avg = sum(k[0] == lang and k[3] == w for k in p), sum(map(len, of)) / len(of)
                s[lang, doc] += math.log((len(of) - df + 0.5) / (df + 0.5) + 1) * [f"w{q}", "w1", "w1"].count(w) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg))
            best = sorted(((-round(x, 6), doc) for (_, doc), x in s.items() if x))[:4]
            want |= {(q, k1, b, i + 1): (doc, -x) for i, (x, doc) in enumerate(best)}
    assert {(r["query"], r["k1"], r["b"], r["rank"]): (r["doc"], round(r["score"], 6)) for r in got.collect()} == want


def test_best_keeps_few_rows_of_many_equal_ones(spark):
    v = spark.range(3000).repartition(3).select(F.col("id").alias("doc"), F.when(F.col("id") % 500 != 7, F.array(F.lit(1.0), F.lit(2.0), (F.col("id") % 3).cast("double"))).alias("v"))
    q = v.where("doc % 300 = 0 or doc = 7")
    kept = nearest.dense_best(q, v, 4, block=3, rows=100)
    assert kept.count() < 11 * 4 * 4 * 4  # queries, best, tasks, scores of one rank; all pairs are 33,000
    old = retrieval.dense_scores(q.select(F.col("doc").alias("query"), F.col("v").alias("q")), v, []).where("query <> doc")
    old = retrieval.top_k(old, ["query"], "score", ["doc"], 4).select("query", "doc", "score", "rank")
    assert sorted(map(str, retrieval.neighbours(v, q, 4).select("query", "doc", "score", "rank").collect())) == sorted(map(str, old.collect()))


def test_rare_and_frequent_terms_give_one_similarity(spark):
    docs = spark.range(300).select(F.col("id").alias("doc"), (F.col("id") % 2).alias("g"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda j: F.concat(F.lit("t"), ((F.col("id") * j) % 40).cast("string"))).alias("words"))
    v = retrieval.tfidf_vectors(docs, ["g"], "doc", F.col("words")).localCheckpoint()
    a, b = ({(r[0], r[1]): round(r[2], 6) for r in nearest.tfidf_best(v, F.col("doc") % 10 == 0, ["g"], 3, dense, block).collect()} for dense, block in ((1024, 2000), (5, 4)))
    full = {r["doc"]: (r["g"], dict(zip(r["t"], r["w"], strict=True))) for r in v.collect()}
    for q, (g, w) in full.items():
        sims = sorted((-round(sum(x * y[t] for t, x in w.items() if t in y), 6), d) for d, (h, y) in full.items() if h == g and d % 10 and q % 10 == 0)[:3]
        assert all(a.get((q, d)) == b.get((q, d)) == -s for s, d in sims if s < 0)


def _sorted(df):
    return sorted(map(str, df.collect()))


def test_chains_in_memory_and_by_joins_are_the_same(spark):
    rows = [(s, i, i - 1 if i % 9 else None, i) for s in (1, 2, 3) for i in range(40)] + [(3, 100, 17, 0), (4, 1, 2, 0), (4, 2, 1, 1), (4, 3, 99, 2)] + [(None, 1, None, 0)]
    c = spark.createDataFrame(rows, "s long, id long, parent_id long, pos long")
    small, large = graph.linear_chains(c, ["s"]), graph.linear_chains(c, ["s"], most=3)
    assert _sorted(small) == _sorted(large) and {r["depth"] for r in small.collect()} > {None, 0, 8}
    assert small._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0  # no table for each round


def test_cherry_picks_in_memory_and_by_joins_are_the_same(spark):
    h = lambda i: f"{i:08x}" * 5
    note = lambda i, n: f"x\n(cherry picked from commit {h(i)[:n]})"
    rows = [(s, i, h(i * 77_777_777 % 2**32 if i < 20 else i), "Fix") for s in (1, 2) for i in range(25)]
    rows += [(1, 50 + i, h(10**9 + i), f"(cherry picked from commit {h(10**9 + i - 1)[: 10 + i]})" if i else "Fix") for i in range(12)]
    rows += [(2, 90, h(5), note(6, 40)), (2, 91, h(6), note(5, 40)), (2, 92, h(7), note(7, 40)), (2, 93, h(8), note(9, 6))]
    c = spark.createDataFrame(rows, "s long, pos long, id string, message string")
    small, large = history.cherry_roots(c, "s"), history.cherry_roots(c, "s", most=3)
    assert _sorted(small.select("s", "pos", "id", "root")) == _sorted(large.select("s", "pos", "id", "root"))
    assert {r["root"] for r in small.where("pos between 50 and 61").collect()} == {h(10**9)}
    assert small._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
