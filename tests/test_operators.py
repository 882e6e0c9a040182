import pytest
from pyspark.sql import functions as F

from lodestrata.operators import code, dedup, enrich, graph, instances, merge, metrics, split
from lodestrata.sources import readers, sinks
from lodestrata.streaming import incremental

PAIRS = "id int, predicted array<struct<file:string,sig:string>>, known array<struct<file:string,sig:string>>"


def scores(spark, predicted, known):
    df = spark.createDataFrame([(1, predicted, known)], PAIRS)
    return metrics.instance_metrics(df).first()


def test_greedy_and_alone(spark):
    m = scores(spark, [(None, "f"), (None, "f")], [("a.cc", "f:int()"), ("b.cc", "f:int()")])
    assert (m["recall_3"], m["map"], m["mrr"], m["hit_1"], m["recall_1"]) == (1.0, 0.5, 1.0, 1.0, 0.5)


def test_precision_counts_against_the_cut(spark):
    m = scores(spark, [("a.cc", "g"), ("a.cc", "f")], [("a.cc", "f")])
    assert (m["precision_10"], m["iou_10"], m["mrr"], m["hit_1"]) == (0.1, 0.5, 0.5, 0.0)
    assert m["f1_10"] == pytest.approx(2 * 0.1 / 1.1)


def test_no_truth_scores_nothing(spark):
    m = scores(spark, [("a.cc", "f")], [])
    assert all(v == 0.0 for k, v in m.asDict().items() if k != "id")


def test_file_rank_counts_distinct_files(spark):
    m = scores(spark, [("a.cc", "x"), ("a.h", "y"), ("b.cc", "z")], [("b.h", "q")])
    assert (m["mrr_file"], m["hit_file_1"], m["hit_file_3"], m["map_file"]) == (0.5, 0.0, 1.0, 0.5)


def test_metrics_have_all_columns(spark):
    m = scores(spark, [("a.cc", "f")], [("a.cc", "f")])
    assert len(m) == 1 + 52
    loose = metrics.loose_metrics(spark.createDataFrame([(1, [("a", "f")], [("a", "f"), ("b", "g")])], "id int, predicted array<struct<file_stem:string,name:string>>, known array<struct<file_stem:string,name:string>>")).first()
    assert len(loose) == 1 + 78 and loose["recall_tuple_1"] == 0.5 and loose["map_file"] == 0.5


def test_macro_over_micro(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", 0.5), ("b", 1.0)], "cve string, m double")
    assert metrics.overall(df, "cve", ["m"]).first()["m"] == 0.75


def test_chains_forks_and_cycles(spark):
    c = spark.createDataFrame([("c1", None, 1), ("c2", "c1", 2), ("c3", "c2", 3), ("c4", "c2", 4), ("c5", "c4", 5), ("d", "gone", 6)], "id string, parent_id string, pos int").withColumn("cve", F.lit(1))
    got = {r["id"]: (r["chain_root"], r["depth"]) for r in graph.linear_chains(c, ["cve"]).collect()}
    assert got == {"c1": ("c1", 0), "c2": ("c1", 1), "c3": ("c1", 2), "c4": (None, None), "c5": (None, None), "d": ("d", 0)}
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", "y"), ("y", "z")], "node string, next string")
    got = {r["node"]: (r["root"], r["steps"]) for r in graph.chase(links).collect()}
    assert got == {"a": ("a", None), "b": ("a", None), "x": ("z", 2), "y": ("z", 1), "z": ("z", 0)}


def test_cycle_gives_one_path_and_itself(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string")
    p = graph.root_paths(spark.createDataFrame([("a",)], "node string"), e)
    assert [r["path"] for r in p.collect()] == [["a", "b", "c"]]
    none = spark.createDataFrame([], "node string")
    out = graph.representatives(p, none, spark.createDataFrame([], "node string, category string")).collect()
    assert [(r["rep"], r["path"]) for r in out] == [("a", ["a"])]


def test_net_state(spark):
    rows = [("k1", 1, "added", "x", None), ("k1", 2, "modified", "x", "y"), ("k2", 1, "modified", "x", "y"), ("k2", 2, "modified", "y", "x"), ("k3", 1, "modified", "x", "y"), ("k3", 2, "removed", "y", None), ("k4", 1, "modified", "x", "y")]
    df = spark.createDataFrame(rows, "k string, pos int, category string, code string, code_after string")
    got = {r["k"]: (r["last_action"], r["code"], r["code_after"]) for r in dedup.net_state(df, ["k"], "pos").collect()}
    assert got == {"k3": ("removed", "x", None), "k4": ("modified", "x", "y")}


def test_header_collapse_and_duplicates(spark):
    f = spark.createDataFrame([(1, "d/foo.h", "A.f:int()", 1), (1, "d/foo.cc", "A.f:int()", 2), (1, "e/foo.h", "A.f:int()", 3)], "cve int, file string, sig string, pos int")
    assert sorted(r["file"] for r in dedup.collapse_headers(f, ["cve"]).collect()) == ["d/foo.cc", "e/foo.h"]
    c = spark.createDataFrame([("a", "2020", "Fix\nChange-Id: 1", 1), ("b", "2019", "Fix\nChange-Id: 2", 2), ("c", "", "Fix", 3)], "id string, commit_date string, message string, pos int").withColumn("cve", F.lit(1))
    assert {r["keeper"] for r in dedup.canonical_duplicates(c, ["cve"]).collect()} == {"b"}


def test_rewrites_keep_empty_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, []), (3, None)], "k int, items array<string>")
    lookup = spark.createDataFrame([("a", "DEAD"), ("b", "b"), ("d", "c")], "old string, new string")
    assert {r["k"]: r["items"] for r in merge.rewrite_elements(df, "k", "items", lookup).collect()} == {1: ["b", "c"], 2: [], 3: []}


def test_split_of_ten(spark):
    df = spark.createDataFrame([(i, "" if i == 9 else f"2020-0{i % 3}") for i in range(10)], "id int, date string")
    got = split.chronological_split(df, "date", ["id"]).orderBy("rank").collect()
    assert [r["split"] for r in got] == ["train"] * 7 + ["val"] + ["test"] * 2 and got[0]["id"] == 9
    with pytest.raises(ValueError, match="both sides"):
        split.assert_disjoint(df, df, "id")


def test_client_cache_and_errors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, p string")
    cache = spark.createDataFrame([(1, "old")], "k int, answer string")

    def client(key, prompt):
        if prompt == "c":
            raise RuntimeError("no")
        return prompt.upper()

    out, new = enrich.cached_call(df, "k", "p", cache, client, retries=2)
    assert {r["k"]: (r["answer"], r["status"], r["attempts"]) for r in out.collect()} == {1: ("old", "cached", 0), 2: ("B", "ok", 1), 3: (None, "error", 2)}
    assert [r["k"] for r in new.collect()] == [2]
    assert {r["status"] for r in enrich.call(df, "k", "p", None).collect()} == {"skipped"}


def test_two_stages_and_empty_issue(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string")
    out = {r["k"]: (r["stage2"], r["label"]) for r in enrich.two_stages(df, "k", F.when(F.col("t") == "x", "incidental").otherwise("related"), F.lit("root"), ["related"]).collect()}
    assert out == {1: (None, "incidental"), 2: ("root", "root")}
    e = spark.createDataFrame([(" ", ["", " "]), ("", ["x"]), (None, None)], "d string, c array<string>")
    assert [r[0] for r in e.select(enrich.empty_issue(F.col("d"), F.col("c"))).collect()] == [True, False, True]


CPP = """// c
namespace a { namespace {
class Foo : public Bar<int> {
 public:
  Foo(int x, const std::string& s = "{") : x_(x), s_(s) { y(); }
  ~Foo() {}
  template <typename T> static T* Get(std::vector<int> v, T *p) const { if (x) { return p; } }
  virtual void None() = 0;
};
}
int Foo::Bar(void) { const char* q = "}"; /* } */ return 1; }
TEST_F(FooTest, Works) { EXPECT(1); }
}
static void free_fn(unsigned int n[3]) {
#if X
  a();
#else
  b(); {
#endif
}
int arr[] = {1, 2};
"""


def test_function_scanner():
    got = [f[0] for f in code.functions(CPP)]
    assert got == ["a.__anon__.Foo.Foo:(int,const std::string&)", "a.__anon__.Foo.~Foo:()", "a.__anon__.Foo.Get:T*(std::vector<int>,T*)", "a.Foo.Bar:int()", "free_fn:void(unsigned int [3])"]
    assert code.functions("") == [] and code.functions("int f( {{{") == []


def test_comments_and_branches():
    assert code.strip_comments('a//b\n"//c"/*d\n*/e') == 'a \n"//c" \ne'
    assert code.first_branches("#if A\nx\n#else\ny\n#endif\nz") == "// #if A\nx\n// #else\n// y\n// #endif\nz"


def test_function_diff(spark):
    rows = lambda x: spark.createDataFrame([(1, s, b) for s, b in x], "file int, sig string, body string")
    old = rows([("f:int()", "1"), ("g:int()", "2"), ("h:int(int)", "3"), ("k:int()", "4")])
    new = rows([("f:int()", "1 "), ("g:int()", "9"), ("h:int(long)", "5"), ("m:int()", "6")])
    got = sorted((r["category"], r["sig"], r["new_sig"]) for r in code.function_diff(old, new, ["file"]).collect())
    assert got == [("added", "m:int()", "m:int()"), ("modified", "g:int()", "g:int()"), ("modified", "h:int(int)", "h:int(long)"), ("removed", "k:int()", None)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\n{bad\n{"id": "y"}\n')
    good, bad = readers.split_rejects(readers.jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n int").cache())
    assert sorted(r["id"] for r in good.collect()) == ["x", "y"] and bad.count() == 1
    (tmp_path / "t/2020").mkdir(parents=True)
    (tmp_path / "t/2020/1.json").write_text('{\n "vulnerabilities": [{"cve": {"id": "A"}}, {"cve": {"id": "B"}}], "cves": {"k": {"cve_id": "C"}}}')
    (tmp_path / "t/2020/2.json").write_text("{oops")
    assert sorted(r["cve"]["id"] for r in readers.wrapped(spark, str(tmp_path / "t"), "vulnerabilities", "cve: struct<id: string>").collect()) == ["A", "B"]
    assert [r["cve_id"] for r in readers.map_values(spark, str(tmp_path / "t"), "cves", "cve_id: string").collect()] == ["C"]
    (tmp_path / "ids.txt").write_text("a b\n\nc a")
    assert sorted(r["id"] for r in readers.ids(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b", "c"]


def test_xml_catalog(spark, tmp_path):
    (tmp_path / "c.xml").write_text(
        '<C xmlns="http://cwe.mitre.org/cwe-7"><Weaknesses><Weakness ID="79" Name="X"><Description>a\n  b</Description><Related_Weaknesses>'
        '<Related_Weakness Nature="ChildOf" CWE_ID="74" View_ID="1000"/><Related_Weakness Nature="PeerOf" CWE_ID="1" View_ID="1000"/></Related_Weaknesses></Weakness>'
        '<Weakness ID="74" Name="Y"><Description>c</Description></Weakness></Weaknesses>'
        '<Categories><Category ID="137" Name="Z"><Relationships><Has_Member CWE_ID="79" View_ID="699"/><Has_Member CWE_ID="74" View_ID="1"/></Relationships></Category></Categories></C>'
    )
    c = readers.weakness_catalog(spark, str(tmp_path / "c.xml"))
    e = readers.weakness_edges(c)
    assert [tuple(r) for r in e.collect()] == [("79", "74")]
    assert {r["id"]: r["desc"] for r in c.collect()} == {"79": "a b", "74": "c"}
    assert [r["node"] for r in readers.catalog_roots(c, e).collect()] == ["74"]
    assert [tuple(r) for r in readers.category_members(spark, str(tmp_path / "c.xml")).collect()] == [("79", "137")]


def test_logs_and_pages(spark):
    h = "a" * 40
    lines = spark.createDataFrame([("r", 1, "noise"), ("r", 2, f"{h}\tFix"), ("r", 3, "git-svn-id: svn://x@7 u"), ("r", 4, f"{'b' * 40}\tMore")], "scope string, line int, value string")
    got = {r["hash"]: r["body"] for r in readers.log_blocks(lines).collect()}
    assert got == {h: "Fix\ngit-svn-id: svn://x@7 u", "b" * 40: "More"}
    pages = spark.createDataFrame([(2020, 1, 1, ["b", "a"]), (2020, 1, 2, ["c"]), (2020, 1, 3, []), (2020, 1, 4, ["z"]), (2020, 2, 1, ["q"]), (2020, 2, 2, ["q"])], "year int, month int, page int, links array<string>")
    assert {r["month"]: (r["links"], r["complete"]) for r in readers.month_links(pages).collect()} == {1: (["a", "b", "c"], True), 2: (["q"], True)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", ["m", "n"]), (2, "b", ["m"])], "id int, cwe string, modules array<string>")
    sinks.grouped(df, str(tmp_path), "cwe", "modules")
    assert spark.read.parquet(f"{tmp_path}/by_module").where("module = 'm'").count() == 2
    new = spark.createDataFrame([(2, "B", ["x"]), (3, "c", [])], "id int, cwe string, modules array<string>")
    assert sorted((r["id"], r["cwe"]) for r in sinks.upsert(df, new, ["id"]).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert sinks.requests(df, F.col("id").cast("string"), F.struct("cwe")).first()["request"] == '{"custom_id":"1","method":"POST","body":{"cwe":"a"}}'
    sinks.json_lines(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    m = sinks.manifest(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), "v").first()
    assert tuple(m) == (1, 2, 2)


def test_incremental(spark, tmp_path):
    src, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    src.mkdir()
    run = lambda: incremental.append_new(spark, str(src), "k int, v string", sink, state, ["k"], lambda d: d.withColumn("u", F.upper("v"))).awaitTermination()
    (src / "1.json").write_text('{"k": 1, "v": "a"}\n{"k": 1, "v": "a"}\n')
    run()
    (src / "2.json").write_text('{"k": 1, "v": "again"}\n{"k": 2, "v": "b"}\n')
    run()
    assert sorted((r["k"], r["u"]) for r in spark.read.parquet(sink).collect()) == [(1, "A"), (2, "B")]


def test_instances_and_reasons(spark):
    f = "array<struct<sig:string,code:string,classification:string>>"
    chains = spark.createDataFrame([("c", 0, [("a.h", ([("f:int()", "x", "root_cause_vulnerable")], [])), ("a.cc", ([("f:int()", "x", "root_cause_vulnerable"), ("t:int()", "x", None)], [("g:int()", "x", "supporting_fix")]))], ["l1", "l2"], "p")], f"cve_id string, chain_id int, diffs array<struct<filename:string,diff_funcs:struct<modified:{f},removed:{f}>>>, commit_ids array<string>, root_parent_id string")
    commits = spark.createDataFrame([("c", "l2", "2020")], "cve_id string, id string, commit_date string")
    one = instances.instances(chains, commits).first()
    assert (one["commit_id"], one["commit_date"], [tuple(x) for x in one["vuln_funcs"]]) == ("l2", "2020", [("a.cc", "f:int()")])
    assert len(instances.instances(chains, commits, "related", collapse=False).first()["vuln_funcs"]) == 3
    df = spark.createDataFrame([(1, 1), (None, 1), (1, 0)], "a int, b int")
    got = {r["reason"]: r["n"] for r in instances.reasons(df.withColumn("why", instances.first_failure([("a", F.col("a") == 1), ("b", F.col("b") == 1)])), "why").collect()}
    assert got == {"kept": 1, "a": 1, "b": 1}


def test_enclosing_and_greedy(spark):
    points = spark.createDataFrame([(1, 5), (1, 99)], "file int, line int")
    spans = spark.createDataFrame([(1, "outer", 1, 20), (1, "inner", 4, 6)], "file int, sig string, line_start int, line_end int")
    assert [(r["line"], r["sig"]) for r in code.enclosing(points, spans, ["file"]).collect()] == [(5, "inner")]
    pairs = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.85), (1, "b", "y", 0.5), (1, "c", "z", 0.1)], "file int, a string, b string, score double")
    assert sorted((r["a"], r["b"]) for r in code.greedy_matches(pairs, ["file"], 0.4).collect()) == [("a", "x"), ("b", "y")]
