import pytest
from pyspark.sql import functions as F

from lodestrata.functions import columns as C


def value(spark, column, **row):
    names = list(row)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {'array<string>' if isinstance(row[n], list) else 'string'}" for n in names))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "out"), [("12.5%", 0.125), ("", None), ("abc%", None), (None, None)])
def test_percent(spark, text, out):
    assert value(spark, C.percent(F.col("a")), a=text) == out


@pytest.mark.parametrize(("sig", "qualified", "bare", "last"), [("A.B:void(int)", "A.B", "B", "B"), ("a::b(x)", "a::b", "b", "b"), ("ns.operator():(int)", "ns.operator()", "operator", "operator()"), ("f", "f", "f", "f"), ("a::b::c:int(std::string)", "a::b::c", "c", "c")])
def test_signatures(spark, sig, qualified, bare, last):
    assert value(spark, C.qualified_name(F.col("a")), a=sig) == qualified
    assert value(spark, C.bare_name(F.col("a")), a=sig) == bare
    assert value(spark, C.name_parts(F.col("a")), a=sig)[-1] == last


@pytest.mark.parametrize(("p", "g", "out"), [("./src/a.cc", "x/src/a.h", True), (None, "a", True), ("", "a", True), ("a.cc", "b.cc", False), ("x/a.cc", "y/a.cc", True), ("a.py", "a.cc", False), ("src\\b.cc", "src/b.cc", True), ("a.cc", "ba.cc", False)])
def test_same_file(spark, p, g, out):
    assert value(spark, C.same_file(F.col("p"), F.col("g")), p=p, g=g) is out


def test_tokens(spark):
    got = value(spark, C.identifier_tokens(F.col("a")), a="HTMLParserFoo2Bar ABC1DEF a snake_case x1 getURLNow")
    assert got == ["html", "parser", "foo2", "bar", "abc1def", "snake", "case", "x1", "get", "url", "now"]


@pytest.mark.parametrize(("path", "out"), [("a/./b/../c.cc", "a/c.cc"), ("/etc/x", None), ("../x", None), ("a/../../x", None), ("a\\b//c", "a/b/c"), ("C:\\x", None), ("", None)])
def test_safe_path(spark, path, out):
    assert value(spark, C.safe_path(F.col("a")), a=path) == out


@pytest.mark.parametrize(("path", "ext", "stem", "parent"), [("a/b.cc", ".cc", "a/b", "a/b_parent.cc"), ("a.b/c", "", "a.b/c", "a.b/c_parent"), (".bashrc", "", ".bashrc", ".bashrc_parent"), ("x.tar.gz", ".gz", "x.tar", "x.tar_parent.gz")])
def test_paths(spark, path, ext, stem, parent):
    assert value(spark, C.extension(F.col("a")), a=path) == ext
    assert value(spark, C.stem(F.col("a")), a=path) == stem
    assert value(spark, C.as_parent(F.col("a")), a=path) == parent
    assert value(spark, C.without_parent(C.as_parent(F.col("a"))), a=path) == path


def test_canonical_message(spark):
    a = "Fix it\n\nChange-Id: I1\nBug: 7\n(cherry picked from commit 0123456789ab)\nmore"
    assert value(spark, C.canonical_message(F.col("a")), a=a) == "Fix it more"
    assert value(spark, C.cherry_sources(F.col("a")), a=a) == ["0123456789ab"]


def test_shard_is_md5_modulo(spark):
    import hashlib

    for key in ("a", "CVE-2020-1", ""):
        assert value(spark, C.md5_shard(F.col("a"), 13), a=key) == int(hashlib.md5(key.encode()).hexdigest(), 16) % 13


def test_json(spark):
    assert value(spark, C.json_in_answer(F.col("a")), a='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert value(spark, C.json_in_answer(F.col("a")), a="nothing") is None
    assert value(spark, C.last_json(F.col("a")), a='{"a": 1} and {"b": {"c": 2}} {bad') == '{"b": {"c": 2}}'


@pytest.mark.parametrize(("a", "b", "out"), [("", "", 0.6), ("", "x", 0.5), ("x", "x", 1.0), ("xyz", "y", 0.9), ("abcd", "abxd", 0.75)])
def test_label_similarity(spark, a, b, out):
    assert value(spark, C.label_similarity(F.col("a"), F.col("b")), a=a, b=b) == out


def test_jaccard(spark):
    assert value(spark, C.multiset_jaccard(F.col("a"), F.col("b")), a=["x", "x", "y"], b=["x", "z"]) == 0.25
    assert value(spark, C.set_jaccard(F.col("a"), F.col("b")), a=["x", "x", "y"], b=["x", "z"]) == pytest.approx(1 / 3)


def test_year_filter(spark):
    assert value(spark, C.year_between(F.col("a"), 2000, 0), a="CVE-2021-1") is True
    assert value(spark, C.year_between(F.col("a"), None, 2020), a="CVE-2021-1") is False
    assert value(spark, C.year_between(F.col("a"), None, None), a="nope") is False


def test_records_and_lists(spark):
    assert value(spark, C.is_expected(F.col("a"), F.col("b")), a=" cve-1 ", b="CVE-1") is True
    assert value(spark, C.record_key(F.lit(3), F.col("a"), F.col("b")), a=" ", b="") == "line:3"
    assert value(spark, C.issue_key(F.col("a"), F.col("b"), F.lit(3)), a="", b="https://x/issues/42/") == "42"
    got = value(spark, C.function_list(F.col("a")), a='["f:int()", {"sig": "g:int()", "code": "x"}, {"sig": ""}, ""]')
    assert [tuple(x) for x in got] == [("f:int()", None), ("g:int()", "x")]
    assert value(spark, C.without_repeats(F.col("a")), a=["x", "x", "y", "x"]) == ["x", "y", "x"]
    assert value(spark, C.without_endings(F.col("a"), ["Edit", "(optional)"]), a="P1 (optional) Edit") == "P1"
    assert value(spark, C.template("Hi {x}, {y}!", x=F.col("a"), y=F.col("b")), a="A", b=None) == "Hi A, !"
    assert value(spark, C.for_each(F.col("a"), lambda x, i: F.concat(i.cast("string"), F.lit(". "), x)), a=["p", "q"]) == "1. p\n2. q"


def test_test_signatures_and_macros(spark):
    assert value(spark, C.is_test_signature(F.col("a")), a="ns.FooTest_Works_Test::TestBody()") is True
    assert value(spark, C.is_test_signature(F.col("a")), a="ns::Foo::SetUp()") is True
    assert value(spark, C.is_test_signature(F.col("a")), a="TEST_F(A,B)") is True
    assert value(spark, C.is_test_signature(F.col("a")), a="ns.Latest:int()") is False
    assert value(spark, C.without_class_macros(F.col("a")), a="class NET_EXPORT Foo { void f() LOCKS_EXCLUDED(x) { } };") == "class Foo { void f() { } };"


@pytest.mark.parametrize(("name", "ratio", "cover", "out"), [(0.9, 0.3, 0.35, True), (0.1, 0.3, 0.55, True), (0.7, 0.5, 0.4, True), (0.5, 0.5, 0.5, False), (1.0, 0.1, 0.4, True)])
def test_mapping_rules(spark, name, ratio, cover, out):
    assert spark.range(1).select(C.keeps_mapping(F.lit(name), F.lit(ratio), F.lit(cover))).first()[0] is out
