"""Work that is done once a row or item, not once for each use."""

from pyspark.sql import functions as F

from lodestrata.functions import columns as C
from lodestrata.operators import code, dedup, enrich


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_code_is_scanned_once_for_all_kinds_of_change(spark):
    t = spark.createDataFrame([(1, "int F(int a) { return 1; }", "int F(int a) { return 2; }")] * 1 + [(2, "", "void G() {}")], "file long, old string, new string")
    out = code.function_diff(code.function_table(t, ["file"], "old"), code.function_table(t, ["file"], "new"), ["file"])
    assert sorted((r["file"], r["category"]) for r in out.collect()) == [(1, "modified"), (2, "added")]
    assert "MapInPandas" not in _plan(out)


def test_singletons_need_no_distinct_count(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 1, "x"), ("c", 3, "x"), ("d", None, "x")], "name string, k long, label string")
    out = dedup.mark_singletons(df, ["name"], "k", "label", "other")
    assert sorted(map(tuple, out.select("name", "k", "label").collect())) == [("a", 1, "x"), ("a", 2, "x"), ("b", 1, "other"), ("b", 1, "other")]
    assert "Aggregate" not in _plan(out).replace("Aggregate [k", "")


def test_keys_of_items_match_as_pairs_do(spark):
    files = ["", "src/a/f.cc", "./a/f.h", "x\\a\\f.cpp", "f", "a/f.py", "other/g.cc", "../f.cc", "a/", " f.cc "]
    sigs = ["ns::C::f(int)", "other.C.f:void(int)", "g()", ""]
    df = spark.createDataFrame([(a, s, b, t) for a in files for s in sigs for b in [*files, None] for t in sigs], "a string, s string, b string, t string")
    pair = C.same_file(F.col("a"), F.col("b")) & C.same_function(F.col("s"), F.col("t"))
    keys = C.same_keys(C.match_keys(F.col("a"), F.col("s")), C.match_keys(F.col("b"), F.col("t")))
    assert df.where(~pair.eqNullSafe(keys)).collect() == []


def test_fields_of_an_answer_are_read_once(spark):
    df = spark.createDataFrame([('{"has_leakage": true, "sanitized_desc": "in <FILE>", "replacements": [{"type": "path", "original": "a.cc"}]}',), ("x",)], "a string")
    out = df.select(enrich.mask_answer(F.col("a"), F.lit("o")).alias("m")).select("m.*")
    assert [r["problem"] for r in out.collect()] == [None, "no JSON"]
    one = df.select(enrich.mask_answer(F.col("a"), F.lit("o")).alias("m"))
    assert one._jdf.queryExecution().analyzed().toString().count("try_variant_get(") < 8
