"""Named queries of sources, sinks, record fields and instance metrics.

Readers and writers go through the shared folder: a query writes rows of its tables in a source's format and reads them
back, so that its SQL is one over the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import columns as C
from lodestrata.operators import code, dedup, enrich, history, merge, metrics, retrieval, split
from lodestrata.plans.catalog import _r, _t, query
from lodestrata.sources import readers, sinks
from lodestrata.sources.shared import new_folder


def _text(c):
    return c.cast("string")


def _lines(df, line, path, by=None):
    rows = df.select(*([by] if by else []), line.alias("value"))
    (rows.write.partitionBy(by) if by else rows.write).text(path)


# --- sources -------------------------------------------------------------------------------------------------------


@query("""
select s_suppkey as key, case when s_suppkey % 7 = 0 then '' else s_name end as name, case when s_suppkey % 7 = 0 then '{"key": ' || s_suppkey || ', bad' else '' end as reject from supplier""")
def jsonl_rejects(spark, d):
    """SRC-1, SNK-8: JSON lines with blank and broken ones; the broken ones come out on a branch of their own."""
    s, path = _t(spark, d, "supplier"), new_folder(spark, "lines")
    good = F.to_json(F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))
    bad = F.concat(F.lit('{"key": '), _text(F.col("s_suppkey")), F.lit(", bad"))
    _lines(s, F.concat(F.when(F.col("s_suppkey") % 7 == 0, bad).otherwise(good), F.when(F.col("s_suppkey") % 5 == 0, "\n").otherwise("")), path)
    rows, rejects = readers.split_rejects(readers.jsonl(spark, path, "key long, name string"))
    key = F.regexp_extract(readers.BAD, r"(\d+)", 1).cast("long")
    return rows.select("key", "name", F.lit("").alias("reject")).unionByName(rejects.select(key.alias("key"), F.lit("").alias("name"), F.col(readers.BAD).alias("reject")))


@query("""
select 'file' as reader, r_regionkey as region, r_name as name from region where r_regionkey <> 3
union all select 'array', n_regionkey, n_name from nation where n_regionkey <> 3
union all select 'map', n_regionkey, upper(n_name) from nation where n_regionkey <> 3""")
def json_trees(spark, d):
    """SRC-2 to SRC-4: a document a file in folders, elements of wrapped arrays, values of maps; a broken file is left out."""
    r, n, path = _t(spark, d, "region"), _t(spark, d, "nation"), new_folder(spark, "tree")
    of = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(
        F.collect_list(F.struct(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"))).alias("nations"),
        F.map_from_entries(F.collect_list(F.struct(_text(F.col("n_nationkey")), F.struct(F.col("n_regionkey").alias("region"), F.upper("n_name").alias("name"))))).alias("by_key"),
    )
    doc = F.to_json(F.struct(F.col("r_regionkey").alias("region"), F.col("r_name").alias("name"), "nations", "by_key"))
    docs = r.join(of, "r_regionkey").withColumn("folder", F.concat(F.lit("y"), _text(F.col("r_regionkey"))))
    _lines(docs, F.when(F.col("r_regionkey") == 3, F.lit("{broken")).otherwise(F.concat(F.lit("\n  "), doc)), path, "folder")
    whole = readers.json_files(spark, path, "region int, name string", "*.txt")
    array = readers.wrapped(spark, path, "nations", "region: int, name: string", "*.txt")
    values = readers.map_values(spark, path, "by_key", "region: int, name: string", "*.txt")
    out = None
    for name, df in (("file", whole), ("array", array), ("map", values)):
        part = df.select(F.lit(name).alias("reader"), "region", "name")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
select 'name' as what, n_nationkey::varchar as a, n_name || ' of ' || n_regionkey as b from nation
union all select 'edge', n_nationkey::varchar, (n_nationkey // 3)::varchar from nation where n_nationkey % 3 > 0
union all select 'member', n_nationkey::varchar, (100 + n_regionkey)::varchar from nation
union all select 'root', n_nationkey::varchar, '' from nation where n_nationkey % 3 = 0""")
def xml_catalog(spark, d):
    """SRC-5, SRC-6: names, parents, members of categories and roots of an XML catalog, its white space made single."""
    n, path = _t(spark, d, "nation"), new_folder(spark, "catalog.xml")
    key = _text(F.col("n_nationkey"))
    text = F.concat(F.col("n_name"), F.lit("\n      of  "), _text(F.col("n_regionkey")))
    parent = F.when(F.col("n_nationkey") % 3 > 0, F.format_string('<Related_Weakness Nature="ChildOf" CWE_ID="%d" View_ID="1000"/>', F.floor(F.col("n_nationkey") / 3))).otherwise("")
    other = F.concat(F.lit('<Related_Weakness Nature="ChildOf" CWE_ID="99" View_ID="1003"/><Related_Weakness Nature="PeerOf" CWE_ID="98" View_ID="1000"/>'), parent)
    weakness = F.concat(F.lit('<Weakness ID="'), key, F.lit('" Name="w"><Description> '), text, F.lit(" </Description><Related_Weaknesses>"), other, F.lit("</Related_Weaknesses></Weakness>"))
    category = n.groupBy("n_regionkey").agg(F.array_join(F.collect_list(F.format_string('<Has_Member CWE_ID="%d" View_ID="699"/><Has_Member CWE_ID="97" View_ID="1"/>', "n_nationkey")), "").alias("m"))
    category = category.select(F.concat(F.lit('<Category ID="'), _text(F.col("n_regionkey") + 100), F.lit('" Name="c"><Relationships>'), "m", F.lit("</Relationships></Category>")).alias("value"))
    parts = n.select(weakness.alias("value")).unionByName(category)  # one document, as catalogs are: a file of 25 nations and 5 regions
    parts.agg(F.concat(F.lit("<Catalog>\n"), F.array_join(F.collect_list("value"), "\n"), F.lit("\n</Catalog>")).alias("value")).write.text(path)
    w = readers.weakness_catalog(spark, path)
    edges = readers.weakness_edges(w)
    rows = [
        w.select(F.lit("name").alias("what"), F.col("id").alias("a"), F.col("desc").alias("b")),
        edges.select(F.lit("edge").alias("what"), F.col("child").alias("a"), F.col("parent").alias("b")),
        readers.category_members(spark, path).select(F.lit("member").alias("what"), F.col("node").alias("a"), F.col("category").alias("b")),
        readers.catalog_roots(w, edges).select(F.lit("root").alias("what"), F.col("node").alias("a"), F.lit("").alias("b")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("""
select 'train' as split, 'c' || c_custkey as id from customer where c_custkey % 5 < 4 union all select 'test', 'c' || c_custkey from customer where c_custkey % 5 = 4""")
def split_id_files(spark, d):
    """SNK-7, SRC-20, J-32, U-10: ids written by split and read again; a split without a file has none, and none is in two."""
    c, path = _t(spark, d, "customer"), new_folder(spark, "splits")
    rows = c.select(F.when(F.col("c_custkey") % 5 == 4, "test").otherwise("train").alias("split"), F.concat(F.lit("c"), _text(F.col("c_custkey"))).alias("id"))
    _lines(rows, F.concat(F.lit(" "), F.col("id"), F.lit("\t"), F.col("id")), path, "split")
    parts = {s: readers.ids(spark, f"{path}/split={s}") for s in ("train", "test", "val")}
    split.assert_disjoint(parts["train"], parts["test"], "id")
    out = parts["val"].withColumn("split", F.lit("val"))
    for s in ("train", "test"):
        out = out.unionByName(parts[s].withColumn("split", F.lit(s)))
    return out.select("split", "id")


@query("""
select p_partkey % 50 as chain, 'f' || p_partkey as file, case when p_partkey % 3 = 0 then 'missing' when p_partkey % 9 = 1 then 'error' else 'found' end as status,
  case when p_partkey % 3 <> 0 and p_partkey % 9 <> 1 then p_size::bigint end as value from part""")
def sidecars(spark, d):
    """SRC-21, J-11, SNK-8: files of chains with their sidecar's status."""
    p = _t(spark, d, "part").select((F.col("p_partkey") % 50).alias("chain"), F.concat(F.lit("f"), _text(F.col("p_partkey"))).alias("file"), "p_partkey", "p_size")
    side = p.where("p_partkey % 3 > 0").select("chain", "file", F.when(F.col("p_partkey") % 9 == 1, "{oops").otherwise(F.to_json(F.struct(F.col("p_size").alias("value")))).alias("json"))
    out = readers.sidecar_status(p, side, ["chain", "file"], "json")
    return out.select("chain", "file", "status", F.try_variant_get(F.try_parse_json("json"), "$.value", "long").alias("value"))


@query("""
select 'CVE-' || c_custkey as cve_id, 'f' || c_nationkey || '.cc' as file, 's' || (c_custkey % 7) as sig from customer where c_custkey % 4 <> 3""")
def sibling_predictions(spark, d):
    """SRC-22: predictions of runs of one name, found by a glob; lines that do not parse are left out."""
    c, path = _t(spark, d, "customer"), new_folder(spark, "runs")
    item = F.struct(F.concat(F.lit("f"), _text(F.col("c_nationkey")), F.lit(".cc")).alias("file"), F.concat(F.lit("s"), _text(F.col("c_custkey") % 7)).alias("sig"))
    good = F.to_json(F.struct(F.concat(F.lit("CVE-"), _text(F.col("c_custkey"))).alias("cve_id"), F.array(item).alias("predicted_functions")))
    rows = c.withColumn("run", F.concat(F.lit("m"), _text(F.col("c_custkey") % 2)))
    _lines(rows, F.when(F.col("c_custkey") % 4 == 3, F.substring(good, 1, 20)).otherwise(good), path, "run")
    return readers.prediction_files(spark, f"{path}/run=m*").select("cve_id", F.explode("predicted_functions").alias("p")).select("cve_id", "p.file", "p.sig")


@query("""
with p as (select s_nationkey as year, 1 + s_suppkey % 3 as month, 1 + (s_suppkey // 3) % 4 as page, list_sort(list(distinct 'u' || (s_suppkey % 40))) as links from supplier group by all),
e as (select year, month, page, case when (year + page) % 5 = 0 then [] else links end as links from p),
f as (select e.*, x.links as first from e left join e x on x.page = 1 and x.year = e.year and x.month = e.month),
s as (select year, month, min(case when len(links) = 0 or (page > 1 and links = first) then page end) as stop from f group by all),
k as (select e.year, e.month, unnest(e.links) as link, s.stop from e join s on s.year = e.year and s.month = e.month where s.stop is null or e.page < s.stop)
select year, month, array_to_string(list_sort(list(distinct link)), ',') as links, bool_or(stop is not null) as complete from k group by year, month""")
def listing_pages(spark, d):
    """SRC-8: distinct links of paginated listings, as far as pages go on."""
    s = _t(spark, d, "supplier")
    pages = s.groupBy(F.col("s_nationkey").alias("year"), (1 + F.col("s_suppkey") % 3).alias("month"), (1 + F.floor(F.col("s_suppkey") / 3) % 4).alias("page")).agg(F.sort_array(F.collect_set(F.concat(F.lit("u"), _text(F.col("s_suppkey") % 40)))).alias("links"))
    pages = pages.withColumn("links", F.when((F.col("year") + F.col("page")) % 5 == 0, F.array().cast("array<string>")).otherwise(F.col("links")))
    out = readers.month_links(pages).where(F.size("links") > 0)
    return out.select("year", "month", F.array_join("links", ",").alias("links"), "complete")


# --- sinks ---------------------------------------------------------------------------------------------------------


@query("""
select p_partkey as k, case when p_partkey % 3 = 0 then upper(p_name) else p_name end as name, case when p_partkey % 3 = 0 then 2 else 1 end as run from part where p_partkey % 2 = 0 or p_partkey % 3 = 0""")
def upserted_table(spark, d):
    """SNK-1, SNK-2, SNK-4: a table that is rewritten, one that is appended to, and rows that replace those of their key."""
    p, one, other = _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")), new_folder(spark, "rewritten"), new_folder(spark, "appended")
    sinks.json_lines(p.limit(3), one)
    sinks.json_lines(p.where("k % 2 = 0").withColumn("run", F.lit(1)), one)
    sinks.table(p.where("k % 6 = 0").select("k", F.upper("name").alias("name"), F.lit(2).alias("run")), other)
    sinks.table(p.where("k % 6 = 3").select("k", F.upper("name").alias("name"), F.lit(2).alias("run")), other, mode="append")
    return sinks.upsert(spark.read.schema("k long, name string, run int").json(one), spark.read.parquet(other), ["k"])


@query("""
select 'class' as layout, p_brand as part, count(*) as n, sum(p_partkey)::bigint as keys from part group by p_brand
union all select 'module', m, count(*), sum(p_partkey)::bigint from (select p_partkey, unnest(['m' || (p_size % 4), 'n' || (p_size % 3)]) as m from part) group by m
union all select 'truth', s || '/' || t, count(*), sum(p_partkey)::bigint from (select p_partkey, case when p_partkey % 10 = 0 then 'test' else 'train' end as s, case when p_size % 2 = 0 then 'leaf' else 'root' end as t from part) group by s, t""")
def grouped_layouts(spark, d):
    """SNK-5, SNK-14: layouts by class, by module and by split and target, as their folders show them."""
    p = _t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("cwe"), F.array(F.concat(F.lit("m"), _text(F.col("p_size") % 4)), F.concat(F.lit("n"), _text(F.col("p_size") % 3))).alias("modules"), F.when(F.col("p_size") % 2 == 0, "leaf").otherwise("root").alias("target"), F.col("p_partkey").alias("cve_id"))
    path = new_folder(spark, "layouts")
    sinks.grouped(p, path, "cwe", "modules")
    sinks.truth_tables(p.select("cve_id", "p_partkey", "target"), p.select("cve_id", F.when(F.col("cve_id") % 10 == 0, "test").otherwise("train").alias("split")), f"{path}/truth")
    out = None
    for layout, folder, part in (("class", "by_cwe", F.col("cwe")), ("module", "by_module", F.col("module")), ("truth", "truth", F.concat_ws("/", "split", "target"))):
        df = spark.read.parquet(f"{path}/{folder}").groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))
        df = df.select(F.lit(layout).alias("layout"), "part", "n", "keys")
        out = df if out is None else out.unionByName(df)
    return out


@query("""
select count(*) as n_rows, max(len(embedding))::int as dim, min(len(embedding))::int as least_dim, count(distinct vec_id % 4) as n_shards from embeddings""")
def embedding_shards(spark, d):
    """SNK-9: vectors written in shards, one append each, and the manifest of all."""
    e, path = _t(spark, d, "embeddings").select((F.col("vec_id") % 4).alias("shard"), "vec_id", F.col("embedding").alias("v")), new_folder(spark, "shards")
    for i in range(4):
        sinks.table(e.where(F.col("shard") == i), path, by=["shard"], mode="append")
    merged = spark.read.parquet(path)
    return sinks.manifest(merged, "v").join(merged.agg(F.count_distinct("shard").alias("n_shards")), F.lit(True))


@query("""
select '{"custom_id":"doc-' || p_partkey || '","method":"POST","body":{"model":"m","input":"' || p_brand || ' ' || p_size || '"}}' as request from part""")
def request_rows(spark, d):
    """SNK-11, L-6: requests of a batch interface, one JSON text each."""
    p = _t(spark, d, "part")
    return sinks.requests(p, F.concat(F.lit("doc-"), _text(F.col("p_partkey"))), F.struct(F.lit("m").alias("model"), F.concat_ws(" ", "p_brand", _text(F.col("p_size"))).alias("input")))


@query("""
select c_mktsegment as name, count(*) as n, round(avg(c_acctbal), 4) as mean from customer group by c_mktsegment""")
def small_report(spark, d):
    """SNK-3: a small result as one JSON file."""
    path = new_folder(spark, "report")
    sinks.one_file(_t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"), _r(F.avg("c_acctbal"), 4).alias("mean")), path)
    return spark.read.schema("name string, n long, mean double").json(path)


# --- fields of records ---------------------------------------------------------------------------------------------


@query("""
with i as (select l_orderkey as k, list({'lang': case when l_partkey % 3 = 0 then 'en' else 'de' end, 'value': 'd' || l_partkey} order by l_linenumber, l_partkey, l_suppkey, l_quantity) as ds,
  list({'type': case when l_suppkey % 2 = 0 then 'Primary' else 'Secondary' end, 'score': l_quantity} order by l_linenumber, l_partkey, l_suppkey, l_quantity) as ms,
  list({'vendor': 'Vendor ' || (l_partkey % 5), 'product': 'The Product ' || (l_suppkey % 3)} order by l_linenumber, l_partkey, l_suppkey, l_quantity) as ps from lineitem group by l_orderkey)
select o_orderkey, coalesce(list_filter(ds, lambda x: x.lang = 'en')[1].value, ds[1].value, '') as description, coalesce(list_filter(ms, lambda x: x.type = 'Primary')[1].score, ms[1].score) as score,
  coalesce(len(list_filter(ps, lambda x: contains(lower(x.vendor), 'vendor 1') and contains(lower(x.product), 'product 2'))) > 0, false) as has_product,
  coalesce(len(list_filter(ds, lambda x: contains(x.value, '7'))) = 0, true) as without_seven
from orders left join i on k = o_orderkey""")
def nested_records(spark, d):
    """P-1 to P-3, P-9, P-13: the text in a language, the primary score, any product of a vendor, no element of a kind."""
    li = _t(spark, d, "lineitem")
    desc = F.struct(F.when(F.col("l_partkey") % 3 == 0, "en").otherwise("de").alias("lang"), F.concat(F.lit("d"), _text(F.col("l_partkey"))).alias("value"))
    score = F.struct(F.when(F.col("l_suppkey") % 2 == 0, "Primary").otherwise("Secondary").alias("type"), F.col("l_quantity").alias("score"))
    product = F.struct(F.concat(F.lit("Vendor "), _text(F.col("l_partkey") % 5)).alias("vendor"), F.concat(F.lit("The Product "), _text(F.col("l_suppkey") % 3)).alias("product"))
    all_ = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", desc.alias("d"), score.alias("s"), product.alias("p")))).alias("all"))
    o = _t(spark, d, "orders").select("o_orderkey").join(all_, "o_orderkey", "left")
    of = lambda f: F.transform("all", lambda x: x[f])
    return o.select(
        "o_orderkey",
        C.description_in(of("d")).alias("description"),
        C.primary(of("s"))["score"].alias("score"),
        C.any_product(of("p"), "vendor 1", "product 2").alias("has_product"),
        C.none_contains(F.transform(of("d"), lambda x: x["value"]), "7").alias("without_seven"),
    )


@query("""
with n as (select l_orderkey as k, l_partkey % 4 as a, l_suppkey % 3 as b, 'cpe:' || (l_partkey % 30) as c from lineitem)
select k, bool_or(c = 'cpe:7') as is_affected from n group by k""")
def nested_criteria(spark, d):
    """P-10: any criterion at the third level of nesting."""
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 4).alias("a"), (F.col("l_suppkey") % 3).alias("b"), F.concat(F.lit("cpe:"), _text(F.col("l_partkey") % 30), F.lit(":")).alias("c"))
    m = li.groupBy("k", "a", "b").agg(F.collect_list(F.struct(F.col("c").alias("criteria"))).alias("cpeMatch"))
    nodes = m.groupBy("k", "a").agg(F.collect_list(F.struct("cpeMatch")).alias("nodes"))
    whole = nodes.groupBy("k").agg(F.collect_list(F.struct("nodes")).alias("configurations"))
    return whole.select("k", C.any_criteria(F.col("configurations"), "cpe:7:").alias("is_affected"))


_STRINGS = [
    "the GetLoadTimes function in renderer/loadtimes.cc in Chrome before 47.0.2526.73",
    "FrameView::update on Windows",
    "git log -p | head",
    "echo git grep x; cd a && git cherry-pick b",
    "Nothing to see here",
    "ns.FooTest::SetUp()",
    "TEST_F(Foo, Bar)",
    "Latest::TestBodyX()",
    "unistr.cpp and v8",
    "Works on version 12.x.3 only",
    "",
    "  Chrome OS  ",
]
_LEAK_SQL = C.LEAKS.replace("'", "''")


@query(f"""
with s as (select p_partkey as k, ({_STRINGS!r})[1 + (p_partkey % {len(_STRINGS)})::int] as t, p_size from part)
select k, regexp_matches(t, '{_LEAK_SQL}') as leaks, regexp_matches(t, '{C.TEST_SIGNATURE}') as is_test, regexp_matches(t, '{C.HISTORY_COMMAND}') as is_forbidden,
  trim(t) = '' and k % 3 = 0 as is_empty, sha256(t || chr(10) || k) as key, sha1(t) as sha1, md5(t) as md5,
  case when trim(t) <> '' then upper(trim(t)) = upper(trim(case when k % 2 = 0 then lower(t) else 'other' end)) else false end as expected,
  case when trim(t) <> '' then trim(t) when k % 2 = 0 then 'id' || k else 'line:' || k end as record_key,
  case when k % 4 = 0 then 'i' || k when k % 4 = 1 then 'x' || k else k::varchar end as issue_key,
  round(greatest(0.40, least(0.70, 0.60 - 0.05 * ln(greatest(p_size, 1)) - 0.02 * least(k % 20, 16))), 6)::double as threshold,
  case when k % 3 = 0 then t when k % 3 = 1 then coalesce(nullif(t, ''), 'cve') || chr(10) || chr(10) || 'issue' else 'issue' end as content,
  'a/f.cc ' || left(case when t = '' then 'sig' else t end, 9) as doc_text, array_to_string(list_filter([t, case when k % 2 = 0 then '' else 'cwe' end, 'desc'], lambda x: x <> ''), ' ') as feature_text,
  case k % 3 when 0 then 'full' when 1 then 'short' else 'other' end as variant from s""")
def text_fields(spark, d):
    """P-22, P-24, P-25, P-28, P-30 to P-32, P-37, X-18, X-28, X-35, X-39, X-40, N-5: what a text says about its record."""
    pick = F.array(*map(F.lit, _STRINGS))[(F.col("p_partkey") % len(_STRINGS)).cast("int")]
    s = _t(spark, d, "part").select(F.col("p_partkey").alias("k"), pick.alias("t"), "p_size")
    k, t = F.col("k"), F.col("t")
    comments = F.when(k % 3 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit(""), F.lit("said")))
    content = F.when(k % 3 == 0, C.content_variant("cve", t, t, t)).when(k % 3 == 1, C.content_variant("both", F.lit("cve"), t, F.lit("issue"))).otherwise(C.content_variant("issue", t, t, F.lit("issue")))
    link = F.when(k % 4 == 1, F.concat(F.lit("http://h/p/x"), _text(k), F.lit("/"))).otherwise("")
    return s.select(
        "k",
        C.maybe_leaks(t).alias("leaks"),
        C.is_test_signature(t).alias("is_test"),
        enrich.forbidden(t).alias("is_forbidden"),
        enrich.empty_issue(t, comments).alias("is_empty"),
        C.content_key(t, _text(k)).alias("key"),
        F.sha1(t).alias("sha1"),
        F.md5(t).alias("md5"),
        C.is_expected(t, F.when(k % 2 == 0, F.lower(t)).otherwise("other")).alias("expected"),
        C.record_key(k, t, F.when(k % 2 == 0, F.concat(F.lit("id"), _text(k)))).alias("record_key"),
        C.issue_key(F.when(k % 4 == 0, F.concat(F.lit("i"), _text(k))).otherwise(" "), link, k).alias("issue_key"),
        _r(C.match_threshold(F.col("p_size"), k % 20)).alias("threshold"),
        content.alias("content"),
        C.document_text(F.lit("a/f.cc"), t, F.lit("sig"), 9).alias("doc_text"),
        C.joined_text(t, F.when(k % 2 == 0, "").otherwise("cwe"), F.lit("desc")).alias("feature_text"),
        C.remapped(F.when(k % 3 == 0, "f").when(k % 3 == 1, "s").otherwise("other"), {"f": "full", "s": "short"}).alias("variant"),
    )


@query("""
with s as (select p_partkey as k, p_brand as b, p_size from part)
select k, case k % 6 when 0 then 'src/f' || k || '.cc' when 1 then 'f' || k || '.cc' when 2 then 'a/b.h' else null end as path,
  case k % 3 when 0 then 'class Foo { };' when 1 then 'void f() { }' else 'struct A { int X_Y; };' end as code,
  case k % 3 when 0 then 'v' || k when 1 then '' else 'name' end as cleaned, 'ns.' || b || '.f' as unrepeated,
  'Task ' || b || ':' || chr(10) || '1. a' || k || chr(10) || '2. b' || chr(10) || 'end' as prompt, case when k % 2 = 0 then 'g1,g3' else 'g1,g2,g3' end as only_modified,
  case k % 3 when 0 then 's' || k || '|' when 1 then 's' || k || '|code' else '' end as functions, k % 4 in (1, 2, 3) as is_test_file from s""")
def code_texts(spark, d):
    """P-16, P-38, X-30, X-32, X-34, U-12, U-13, SRC-23: paths, code, scraped values, prompts and lists put in order."""
    s = _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("b"))
    k, n = F.col("k"), _text(F.col("k"))
    raw = F.when(k % 6 == 0, F.concat(F.lit("src\\x\\..\\f"), n, F.lit(".cc"))).when(k % 6 == 1, F.concat(F.lit("./f"), n, F.lit(".cc"))).when(k % 6 == 2, "a//./b.h").when(k % 6 == 3, "/etc/passwd").when(k % 6 == 4, "a/../../b").otherwise("C:/x.cc")
    code = F.when(k % 3 == 0, "class BASE_EXPORT Foo { };").when(k % 3 == 1, "void f() LOCKS_EXCLUDED(m) { }").otherwise("struct A { int X_Y; };")
    scraped = F.when(k % 3 == 0, F.concat(F.lit(" v"), n, F.lit("  Add comment"))).when(k % 3 == 1, " -- ").otherwise("nameEdit")
    names = F.split(F.concat_ws(".", F.lit("ns"), F.lit("ns"), "b", "b", F.lit("f")), r"\.")
    items = F.array(F.concat(F.lit("a"), n), F.lit("b"))
    changed, removed = F.array(F.lit("g1"), F.lit("g2"), F.lit("g3")), F.when(k % 2 == 0, F.array(F.lit("g2"))).otherwise(F.array().cast("array<string>"))
    listed = F.when(k % 3 == 0, F.to_json(F.array(F.concat(F.lit("s"), n), F.lit("")))).when(k % 3 == 1, F.to_json(F.array(F.struct(F.concat(F.lit("s"), n).alias("sig"), F.lit("code").alias("code"))))).otherwise("no json")
    path = F.when(k % 4 == 0, "src/latest/contest.cc").when(k % 4 == 1, "src/Tests/a.cc").when(k % 4 == 2, "a/b_unittest.cc").otherwise("gtest/x.h")
    return s.select(
        "k",
        C.safe_path(raw).alias("path"),
        C.without_class_macros(code).alias("code"),
        C.without_endings(scraped, ["Add comment", "Edit"]).alias("cleaned"),
        F.array_join(C.without_repeats(names), ".").alias("unrepeated"),
        C.template("Task {b}:\n{lines}\nend", b=F.col("b"), lines=C.for_each(items, lambda x, i: F.concat(_text(i), F.lit(". "), x))).alias("prompt"),
        F.array_join(F.array_except(changed, removed), ",").alias("only_modified"),
        F.array_join(F.transform(C.function_list(listed), lambda x: F.concat(x["sig"], F.lit("|"), F.coalesce(x["code"], F.lit("")))), ";").alias("functions"),
        C.is_test_path(path).alias("is_test_file"),
    )


# --- elements of lists ---------------------------------------------------------------------------------------------


@query("""
with o as (select o_custkey as k, list('l' || (o_orderkey % 20) order by o_orderkey) as a from orders group by 1), t as (select c_custkey as k, ['l' || (c_custkey % 20), 't' || c_custkey] as b from customer where c_custkey % 3 = 0),
j as (select c_custkey as k, coalesce(a, []) as a, coalesce(b, []) as b from customer left join o on o.k = c_custkey left join t on t.k = c_custkey),
u as (select k, a || b as ab from j), w as (select k, unnest(ab) as x, unnest(range(len(ab))) as i from u), f as (select k, x, min(i) as i from w group by all)
select u.k, coalesce(string_agg(x, ',' order by i), '') as links from u left join f using (k) group by u.k""")
def tracker_links(spark, d):
    """J-4, U-3: links of a tracker joined by key and merged into the record's own, each once, in order."""
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.concat(F.lit("l"), _text(F.col("o_orderkey") % 20)).alias("l")))).alias("a"))
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    t = c.where("k % 3 = 0").select("k", F.array(F.concat(F.lit("l"), _text(F.col("k") % 20)), F.concat(F.lit("t"), _text(F.col("k")))).alias("found"))
    own = c.join(o, "k", "left").select("k", F.transform("a", lambda x: x["l"]).alias("links"))
    return merge.union_elements(own, t, "k", "links", "found").select("k", F.array_join("links", ",").alias("links"))


@query("""
with o as (select o_custkey as k, o_orderkey % 500 as h, min(o_orderkey) as pos from orders group by all),
e as (select k, string_agg(h || ':' || p_brand, ',' order by pos) as ds from o join part on p_partkey = h where p_partkey % 2 = 0 group by k)
select c_custkey as k, coalesce(ds, '') as details from customer left join e on e.k = c_custkey""")
def commit_details(spark, d):
    """J-8: elements replaced by their details, each hash once, those without details dropped."""
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 500).alias("h")))).alias("a"))
    own = _t(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(o, "k", "left").select("k", F.transform("a", lambda x: x["h"]).alias("hashes"))
    details = _t(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("h"), F.col("p_brand").alias("brand"))
    out = merge.enrich_elements(own, "k", "hashes", details, "h")
    return out.select("k", F.coalesce(F.array_join(F.transform("hashes_details", lambda x: F.concat_ws(":", x["h"], x["brand"])), ","), F.lit("")).alias("details"))


# --- metrics of predicted functions --------------------------------------------------------------------------------

_SAME_FILE = """(coalesce(pf, '') = '' or p = g or ends_with(g, '/' || p) or ends_with(p, '/' || g) or regexp_extract(p, '[^/]*$') = regexp_extract(g, '[^/]*$')
  or ps = gs or ends_with(gs, '/' || ps) or ends_with(ps, '/' || gs) or regexp_extract(ps, '[^/]*$') = regexp_extract(gs, '[^/]*$'))"""
_STEM = r"regexp_replace({}, '(?i)([^/])\.(cc|cpp|cxx|cu|c|m|mm|h|hpp|hxx|cuh|inc)$', '\1')"
_INSTANCES = rf"""
with li as (select *, 'd' || (l_partkey % 3) || '/f' || (l_partkey % 4) as base, 'fn' || (l_suppkey % 3) as fn from lineitem),
truth as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as j, 'src/' || base || '.cc' as gf, fn as gn from li where l_linenumber <= 3),
pred as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey, l_suppkey) as i,
  case l_linenumber % 6 when 0 then '' when 1 then 'src/' || base || '.cc' when 2 then './' || base || '.h' when 3 then 'other/f' || (l_partkey % 4) || '.cpp' when 4 then 'src\' || replace(base, '/', '\') || '.cc' else 'x/' || base end as pf, fn as pn from li),
paths as (select k, i, j, pf, pn, gn, ltrim(replace(pf, '\', '/'), './') as p, gf as g from pred join truth using (k)),
stems as (select *, {_STEM.format("p")} as ps, {_STEM.format("g")} as gs from paths),
met as (select k, i, list(j order by j) filter (where pn = gn and {_SAME_FILE}) as js from stems group by k, i),
lists as (select pred.k, list(coalesce(js, []) order by pred.i) as ms, count(*) as m from pred left join met on met.k = pred.k and met.i = pred.i group by pred.k),
known as (select k, count(*) as n from truth group by k),
taken as (select lists.*, coalesce(n, 0) as n, list_transform([1, 3, 5, 10], lambda c: len(list_reduce(list_prepend([]::bigint[], list_slice(ms, 1, c)), lambda a, x: list_concat(a, list_slice(list_filter(x, lambda y: not list_contains(a, y)), 1, 1))))) as hits,
  list_transform(ms, lambda x: x[1]) as firsts from lists left join known using (k)),
gains as (select k, unnest(range(1, len(firsts) + 1)) as r, unnest(firsts) as f from taken),
news as (select k, r, f, row_number() over (partition by k, f order by r) as nth from gains where f is not null),
ranks as (select k, min(r) as best, sum(c / r::double) as s from (select k, r, row_number() over (partition by k order by r) as c from news where nth = 1) group by k),
one as (select taken.k, (hits[1] > 0)::int::double as hit_1, hits[2] / 3.0::double as precision_3, coalesce(hits[3] / nullif(n, 0)::double, 0) as recall_5,
  coalesce(hits[3] / nullif(least(m, 5) + n - hits[3], 0)::double, 0) as iou_5, (n > 0 and hits[4] = n)::int::double as subset_acc_10, coalesce(1.0 / best, 0)::double as mrr, coalesce(s / nullif(n, 0), 0)::double as map
  from taken left join ranks using (k))"""


def _instances(spark, d):
    li = _t(spark, d, "lineitem")
    base = F.concat(F.lit("d"), _text(F.col("l_partkey") % 3), F.lit("/f"), _text(F.col("l_partkey") % 4))
    li = li.withColumn("base", base).withColumn("fn", F.concat(F.lit("fn"), _text(F.col("l_suppkey") % 3)))
    v = F.col("l_linenumber") % 6
    file = (
        F.when(v == 0, "")
        .when(v == 1, F.concat(F.lit("src/"), "base", F.lit(".cc")))
        .when(v == 2, F.concat(F.lit("./"), "base", F.lit(".h")))
        .when(v == 3, F.concat(F.lit("other/f"), _text(F.col("l_partkey") % 4), F.lit(".cpp")))
        .when(v == 4, F.concat(F.lit("src\\"), F.replace("base", F.lit("/"), F.lit("\\")), F.lit(".cc")))
        .otherwise(F.concat(F.lit("x/"), "base"))
    )
    sig = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("ns::C::"), "fn", F.lit("(int)"))).otherwise(F.concat(F.lit("other.C."), "fn", F.lit(":void(int)")))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), "l_linenumber", "l_partkey", "l_suppkey", F.struct(file.alias("file"), sig.alias("sig")).alias("f"))))
    predicted = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(rows, lambda x: x["f"]).alias("predicted"))
    gt = F.struct(F.concat(F.lit("src/"), "base", F.lit(".cc")).alias("file"), F.concat(F.lit("C::"), "fn", F.lit("()")).alias("sig"))
    truth = li.where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", gt.alias("g")))), lambda x: x["g"]).alias("known"))
    return metrics.attach_truth(predicted, truth.withColumn("pos", F.lit(1)), ["k"])


_METRICS = ["hit_1", "precision_3", "recall_5", "iou_5", "subset_acc_10", "mrr", "map"]


@query(_INSTANCES + f" select k, {', '.join(f'round({m}, 6) as {m}' for m in _METRICS)} from one")
def fuzzy_metrics(spark, d):
    """M-1, M-5, J-25, J-26, X-20, X-21, W-4: predicted functions take known ones one to one, matched by path and name."""
    return metrics.instance_metrics(_instances(spark, d)).select("k", *[_r(F.col(m)).alias(m) for m in _METRICS])


_MEANS = ", ".join(f"avg({m}) as {m}" for m in _METRICS)


@query(
    _INSTANCES
    + f""",
byk as (select o_custkey as c, {_MEANS} from one join orders on o_orderkey = k group by 1),
cls as (select c, case when c % 7 = 0 then 'unknown' else 'seg' || (c % 5) end as name from byk), seg as (select name, {_MEANS}, count(*) as n_keys from byk join cls using (c) group by name)
select 'overall' as level, '' as name, {', '.join(f'round(avg({m}), 6) as {m}' for m in _METRICS)} from byk
union all select 'class', name, {', '.join(f'round({m}, 6)' for m in _METRICS)} from seg
union all select 'macro', '', {', '.join(f'round(avg({m}), 6)' for m in _METRICS)} from seg"""
)
def metric_means(spark, d):
    """M-4, A-18, A-19, V-2: means over instances, then keys; by class, and over classes."""
    one = metrics.instance_metrics(_instances(spark, d)).select("k", *_METRICS)
    rows = one.join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")), "k")
    per = metrics.mean_by(rows, ["c"], _METRICS)
    classes = per.where("c % 7 <> 0").select("c", F.concat(F.lit("seg"), _text(F.col("c") % 5)).alias("name"))
    by_class = metrics.by_class(per, classes, "c", "name", _METRICS)
    parts = [("overall", metrics.overall(rows, "c", _METRICS).withColumn("name", F.lit(""))), ("class", by_class), ("macro", metrics.macro(by_class, _METRICS).withColumn("name", F.lit("")))]
    out = None
    for level, df in parts:
        df = df.select(F.lit(level).alias("level"), "name", *[_r(F.col(m)).alias(m) for m in _METRICS])
        out = df if out is None else out.unionByName(df)
    return out


@query("""
with s as (select l_orderkey as k, list(distinct l_partkey % 6) as p, list(distinct l_suppkey % 6) as g from lineitem group by 1),
n as (select k, len(p) as np, len(g) as ng, len(list_intersect(p, g)) as n from s)
select round(avg(n / np::double), 6) as precision, round(avg(n / ng::double), 6) as recall, round(avg(case when n = 0 then 0 else 2.0 * n / (np + ng) end), 6)::double as f1, round(avg(n / (np + ng - n)::double), 6) as iou,
  round(avg((np = ng and n = np)::int), 6)::double as subset_acc, count(*) as n_rows from n""")
def classifier_means(spark, d):
    """M-3, I-4, U-9, A-20: set metrics of a classifier's labels, and their means."""
    s = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.col("l_partkey") % 6).alias("p"), F.collect_list(F.col("l_suppkey") % 6).alias("g"))
    names = ["precision", "recall", "f1", "iou", "subset_acc"]
    m = metrics.mean_by(s.select(*metrics.classifier_metrics(F.col("p"), F.col("g"))), [], names, "n_rows")
    return m.select(*[_r(F.col(c)).alias(c) for c in names], "n_rows")


@query("""
with p as (select l_orderkey as k, list('s' || (l_partkey % 5) order by l_quantity desc, l_linenumber, l_partkey, l_suppkey) as ps from lineitem group by 1),
g as (select l_orderkey as k, list(distinct 's' || (l_suppkey % 5)) as gs from lineitem group by 1), j as (select * from p join g using (k)),
e as (select k, unnest(ps) as x, unnest(range(1, len(ps) + 1)) as r, gs from j), h as (select k, min(r) as best from e where list_contains(gs, x) group by k)
select k, (len(list_intersect(list_distinct(ps[1:3]), gs)) > 0)::int::double as hit_3, round(len(list_intersect(list_distinct(ps[1:3]), gs)) / 3.0, 6)::double as precision_3,
  round(len(list_intersect(list_distinct(ps[1:5]), gs)) / len(gs)::double, 6) as recall_5, round(coalesce(1.0 / best, 0), 6)::double as mrr from j left join h using (k)""")
def loose_metrics(spark, d):
    """M-2: exact metrics by name, file and both; names may repeat."""
    li = _t(spark, d, "lineitem")
    pair = lambda c: F.struct(F.lit("d/f").alias("file_stem"), F.concat(F.lit("s"), _text(c)).alias("name"))
    rows = li.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), "l_linenumber", "l_partkey", "l_suppkey", pair(F.col("l_partkey") % 5).alias("f")))), lambda x: x["f"]).alias("predicted"),
        F.collect_list(pair(F.col("l_suppkey") % 5)).alias("known"),
    )
    return metrics.loose_metrics(rows).select("k", *[_r(F.col(c)).alias(c) for c in ("hit_3", "precision_3", "recall_5", "mrr")])


# --- histories, spans, negatives -----------------------------------------------------------------------------------


@query("""
with t as (select distinct l_partkey % 300 as f, l_orderkey as id from lineitem where l_linenumber <= 2)
select f, string_agg(id || ':' || o_orderpriority, ',' order by o_orderkey) as touches from t join orders on o_orderkey = id where o_orderkey % 3 <> 0 group by f""")
def touch_lists(spark, d):
    """J-13: the commits that touched a function, in order, with their messages."""
    li = _t(spark, d, "lineitem").where("l_linenumber <= 2").select((F.col("l_partkey") % 300).alias("f"), F.col("l_orderkey").alias("commit_id"))
    commits = _t(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("message"))
    out = history.touches(li, commits, ["f"])
    return out.select("f", F.array_join(F.transform("touches", lambda x: F.concat_ws(":", x["id"], x["message"])), ",").alias("touches"))


@query("""
with l as (select o_custkey as k, o_orderkey as pos, 'u' || (o_orderkey % 400) as url, case when o_orderkey % 3 = 0 then 'h' || o_orderkey end as hash from orders), r as (select 'u' || p_partkey as url, 'r' || p_partkey as hash from part where p_partkey % 2 = 0 and p_partkey < 400),
g as (select k, string_agg(l.url || '=' || coalesce(l.hash, r.hash, '?'), ',' order by pos) as links from l left join r using (url) group by k)
select c_custkey as k, coalesce(links, '') as links from customer left join g on k = c_custkey""")
def review_links(spark, d):
    """J-34: links without a hash take what was resolved for their URL, in place."""
    o = _t(spark, d, "orders")
    one = F.struct(F.concat(F.lit("u"), _text(F.col("o_orderkey") % 400)).alias("url"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("h"), _text(F.col("o_orderkey")))).alias("hash"))
    links = o.groupBy(F.col("o_custkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", one.alias("l")))), lambda x: x["l"]).alias("links"))
    records = _t(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(links, "k", "left")
    resolved = _t(spark, d, "part").where("p_partkey % 2 = 0 and p_partkey < 400").select(F.concat(F.lit("u"), _text(F.col("p_partkey"))).alias("url"), F.concat(F.lit("r"), _text(F.col("p_partkey"))).alias("hash"))
    out = history.fill_links(records, "k", "links", resolved)
    return out.select("k", F.array_join(F.transform("links", lambda x: F.concat_ws("=", x["url"], F.coalesce(x["hash"], F.lit("?")))), ",").alias("links"))


@query("""
with r as (select o_custkey as k, o_orderkey as pos, 'u' || (o_orderkey % 3) as url, case when o_orderkey % 2 = 0 then 'H' else 'h' end || (o_orderkey % 5) as hash from orders),
a as (select * from r qualify row_number() over (partition by k, url, hash order by pos) = 1)
select k, pos, url, hash from a qualify row_number() over (partition by k, lower(hash) order by pos) = 1""")
def link_dedup(spark, d):
    """U-5, U-8: links once by URL and hash, then by hash whatever its case."""
    r = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("u"), _text(F.col("o_orderkey") % 3)).alias("url"), F.concat(F.when(F.col("o_orderkey") % 2 == 0, "H").otherwise("h"), _text(F.col("o_orderkey") % 5)).alias("hash"))
    once = dedup.first_by(r, ["k", "url", "hash"], [F.col("pos")])
    return dedup.first_by(once.withColumn("low", F.lower("hash")), ["k", "low"], [F.col("pos")]).select("k", "pos", "url", "hash")


@query("""
with s as (select p_partkey % 100 as f, 's' || p_partkey as sig, p_size as a, p_size + 3 * (1 + p_partkey % 7) as b from part),
l as (select distinct s_suppkey % 100 as f, 1 + s_suppkey % 45 as line from supplier)
select f, line, arg_min(sig, (b - a, a, sig)) as sig from l join s using (f) where line between a and b group by f, line""")
def enclosing_spans(spark, d):
    """T-10: the smallest span of a file that holds a line."""
    key = F.col("p_partkey")
    spans = _t(spark, d, "part").select((key % 100).alias("f"), F.concat(F.lit("s"), _text(key)).alias("sig"), F.col("p_size").cast("long").alias("line_start"), (F.col("p_size") + 3 * (1 + key % 7)).alias("line_end"))
    points = _t(spark, d, "supplier").select((F.col("s_suppkey") % 100).alias("f"), (1 + F.col("s_suppkey") % 45).alias("line")).distinct()
    return code.enclosing(points, spans, ["f"]).select("f", "line", "sig")


@query("""
with t as (select distinct l_orderkey as q, l_partkey % 20 as file, l_suppkey % 8 as sig from lineitem where l_linenumber <= 2),
f as (select distinct p_partkey % 20 as file, p_size % 8 as sig from part), n as (select vec_id, label from embeddings),
pool as (select q, 'same_file' as pool, f.file, f.sig, 0::double as ord from (select distinct q, file from t) x join f using (file)
  union all select l_orderkey, 'ranked', l_partkey % 20, l_suppkey % 8, -max(l_quantity) as ord from lineitem where l_quantity > 20 group by 1, 3, 4)
select q, pool, row_number() over (partition by q, pool order by ord, file, sig)::int as nth, file, sig from pool anti join t using (q, file, sig) qualify nth <= case pool when 'ranked' then 2 else 3 end""")
def mined_negatives(spark, d):
    """I-9, J-21: functions of the same file and ranked ones, without what the record knows, each within its budget."""
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_partkey") % 20).alias("file"), (F.col("l_suppkey") % 8).alias("sig"), "l_linenumber", "l_quantity")
    truth = li.where("l_linenumber <= 2").select("q", "file", "sig").distinct()
    funcs = _t(spark, d, "part").select((F.col("p_partkey") % 20).alias("file"), (F.col("p_size") % 8).cast("long").alias("sig")).distinct()
    same = truth.select("q", "file").distinct().join(funcs, "file").withColumn("at", F.lit(0.0))
    ranked = li.where("l_quantity > 20").groupBy("q", "file", "sig").agg((-F.max("l_quantity")).alias("at"))  # above the least similarity
    return retrieval.mixed_negatives({"same_file": (same, 3), "ranked": (ranked, 2)}, truth, ["q"], ["file", "sig"]).select("q", "pool", "nth", "file", "sig")


@query("""
select w.l_orderkey as k, w.l_linenumber as n, e.vec_id, round(e.embedding[1]::double, 6) as first from (select distinct l_orderkey, l_linenumber, l_partkey % 5000 as oid from lineitem) w join embeddings e on e.vec_id = w.oid""")
def vector_lookup(spark, d):
    """J-24: vectors by their key; rows without one go."""
    w = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 5000).alias("vec_id")).distinct()
    return w.join(_t(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("first")), "vec_id").select("k", "n", "vec_id", _r(F.col("first")).alias("first"))


@query("""
select p_partkey as k, p_name as name from part where p_brand in ('Brand#11', 'Brand#12', 'Brand#1', 'Brand#2') order by p_partkey limit 20""")
def work_subset(spark, d):
    """P-26: named instances alone, the first twenty of them: the limit is the feature."""
    return _t(spark, d, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#1", "Brand#2")).orderBy("p_partkey").limit(20).select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
