"""Further named queries: prefix joins, versions of files, nested instances, extraction, filters, work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import columns as C
from lodestrata.operators import dedup, enrich, history, instances, merge
from lodestrata.plans.catalog import _r, _t, query
from lodestrata.sources import readers, sinks


@query("""
with c as (select c_custkey, md5(c_name) as id from customer), l as (select c_custkey as link, upper(left(md5(c_name), 7 + (c_custkey % 9)::int)) as hash from customer)
select link, c_custkey, id from l join c on left(id, least(length(hash), 12)) = left(lower(hash), least(length(hash), 12))""")
def prefix_join(spark, d):
    """J-12, J-15: hashes that begin commit ids; an equi-join on the shortest prefix finds them."""
    return _prefixes(spark, d)


def _prefixes(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.md5("c_name").alias("id"))
    links = c.select(F.col("c_custkey").alias("link"), F.upper(F.expr("left(id, 7 + cast(c_custkey % 9 as int))")).alias("hash"))
    return merge.hash_prefix_join(links, c).select("link", "c_custkey", "id")


@query("""
select p_partkey % 50 as dir, 'p' || p_partkey || '.cc' as file, p_brand as content, p_type as parent_content from part where p_partkey % 3 <> 0 and p_partkey % 4 <> 0""")
def version_pairs(spark, d):
    """J-9, J-10, X-12, SRC-18: a file and its parent version; both have to be there."""
    p = _t(spark, d, "part")
    now = p.where("p_partkey % 3 <> 0").select((F.col("p_partkey") % 50).alias("dir"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".cc")).alias("file"), F.col("p_brand").alias("content"))
    old = p.where("p_partkey % 4 <> 0").select((F.col("p_partkey") % 50).alias("dir"), C.as_parent(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".cc"))).alias("file"), F.col("p_type").alias("content"))
    files = now.withColumn("is_parent", F.lit(False)).unionByName(old.withColumn("is_parent", F.lit(True)))
    return merge.pairs_of_versions(files, ["dir"], "file", C.without_parent(F.col("file"))).select("dir", "file", "content", "parent_content")


@query("""
with k as (select p_partkey from part where p_partkey % 3 <> 0), o as (select p_partkey from part where p_partkey % 4 <> 0)
select p_partkey, case when k.p_partkey is null then '' else 'now' end as content, case when o.p_partkey is null then '' else 'old' end as parent_content from k full join o using (p_partkey)""")
def both_sides(spark, d):
    """SNK-12: a file that one side lacks is empty there."""
    p = _t(spark, d, "part").select("p_partkey")
    return sinks.both_sides(p.where("p_partkey % 3 <> 0").withColumn("content", F.lit("now")), p.where("p_partkey % 4 <> 0").withColumn("content", F.lit("old")), ["p_partkey"])


@query("""
with g as (select o_orderkey as h, 'svn://host/chrome/' || (case when o_custkey % 2 = 0 then 'trunk/src' else 'branches/' || o_custkey % 9 end) as root, o_orderkey % 3000 as rev from orders),
r as (select n_nationkey as n, 'svn://host/chrome/trunk' as path, n_nationkey * 100 + 6 as rev from nation)
select n, h from r join g using (rev) where starts_with(root, path)""")
def svn_revisions(spark, d):
    """J-6, SRC-14, X-2: revisions to commits by number, then by path."""
    o = _t(spark, d, "orders")
    root = F.concat(F.lit("svn://host/chrome/"), F.when(F.col("o_custkey") % 2 == 0, "trunk/src").otherwise(F.concat(F.lit("branches/"), (F.col("o_custkey") % 9).cast("string"))))
    message = F.concat(F.lit("Fix.\n\ngit-svn-id: "), root, F.lit("@"), (F.col("o_orderkey") % 3000).cast("string"), F.lit(" 0039d316"))
    commits = o.select(F.col("o_orderkey").alias("h"), C.git_svn_id(message).alias("s")).select("h", "s.svn_root", "s.revision")
    revisions = _t(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.lit("svn://host/chrome/trunk").alias("path"), (F.col("n_nationkey") * 100 + 6).cast("long").alias("revision"))
    return merge.svn_join(revisions, commits).select("n", "h")


def _chains(spark, d):
    """Orders as chains, return flags as files, line items as changed functions."""
    li = _t(spark, d, "lineitem")
    label = F.when(F.col("l_quantity") > 30, "root_cause_vulnerable").when(F.col("l_quantity") > 15, "supporting_fix").when(F.col("l_quantity") > 5, "incidental_or_unrelated")
    func = F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("ns::f"), (F.col("l_partkey") % 6).cast("string"), F.lit(":void(int)")).alias("sig"), F.lit("x").alias("code"), label.alias("classification"))
    file = F.concat(F.lit("src/"), F.lower("l_returnflag"), F.when(F.col("l_suppkey") % 2 == 0, ".cc").otherwise(".h"))
    rows = li.select("l_orderkey", file.alias("filename"), F.when(F.col("l_linestatus") == "O", "modified").otherwise("removed").alias("cat"), func.alias("f"))
    rows = rows.repartition("l_orderkey")  # both levels are gathered where an order is
    of = lambda c: F.sort_array(F.collect_list(F.when(F.col("cat") == c, F.col("f")))).alias(c)
    files = rows.groupBy("l_orderkey", "filename").agg(of("modified"), of("removed"))
    diff = F.struct("filename", F.struct("modified", "removed").alias("diff_funcs"))
    ids = F.array(F.concat(F.lit("a"), F.col("l_orderkey").cast("string")), F.concat(F.lit("b"), F.col("l_orderkey").cast("string")))
    chains = files.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(diff)).alias("diffs"))
    return chains.select(F.col("l_orderkey").alias("cve_id"), F.lit(0).alias("chain_id"), "diffs", ids.alias("commit_ids"), F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("root_parent_id"))


_CHANGED = """
with f as (select l_orderkey as k, 'src/' || lower(l_returnflag) || case when l_suppkey % 2 = 0 then '.cc' else '.h' end as file, 'ns::f' || l_partkey % 6 as name, case when l_linestatus = 'O' then 0 else 1 end as cat, l_linenumber as n, l_quantity as q from lineitem)"""


@query(
    _CHANGED
    + """,
w as (select * from f where q > 15), u as (select k, file, name, min((cat, n, name)) as pos from w group by all),
o as (select *, row_number() over (partition by k order by file, pos) as p from u),
c as (select k, name, arg_min(file, (case when file like '%.cc' then 0 else 1 end, p)) as file, min(p) as p from o group by k, name)
select k as cve_id, 'b' || k as commit_id, coalesce(case when k % 2 = 0 then 'd' || k end, '') as commit_date, 'p' || k as parent_id, string_agg(file || ' ' || name || ':void(int)', ';' order by p) as funcs from c group by k"""
)
def nested_instances(spark, d):
    """P-33, P-34, P-18, U-4, U-7: instances from nested chains, one function a header and implementation pair."""
    commits = _t(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("cve_id"), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("commit_date"))
    out = instances.instances(_chains(spark, d), commits, "related")
    return out.select("cve_id", "commit_id", "commit_date", "parent_id", F.array_join(F.transform("vuln_funcs", lambda x: F.concat_ws(" ", x["file"], x["sig"])), ";").alias("funcs"))


@query(_CHANGED + " select distinct k as cve_id, regexp_replace(file, '[.][a-z]+$', '') as file_stem, replace(name, 'ns::', '') as name from f where q > 30")
def name_pairs(spark, d):
    """P-35, P-19, X-10, X-14: distinct pairs of file stem and bare name."""
    return instances.name_pairs(_chains(spark, d), "root_cause_vulnerable")


def _relabel(chains):
    f = instances.changed_functions(chains)
    rows = f.select(F.col("cve_id").alias("k"), F.substring_index("sig", ":void", 1).alias("name"), F.when(F.col("classification") == "root_cause_vulnerable", "root").otherwise("other").alias("label")).distinct()
    rows = rows.withColumn("kind", F.col("label"))
    return dedup.mark_singletons(rows, ["name", "kind"], "k", "label", "other").select("k", "name", "label")


@query(
    _CHANGED
    + """,
l as (select distinct k, name, case when q > 30 then 'root' else 'other' end as label from f),
c as (select name, label, count(distinct k) as c from l group by name, label),
m as (select k, name, case when c < 2 then 'other' else label end as label from l join c using (name, label))
select k, name, label from m where k in (select k from m where label <> 'other')"""
)
def singleton_relabel(spark, d):
    """A-11: keys of one owner lose their label, owners without any go."""
    return _relabel(_chains(spark, d))


@query("""
with p as (select p_partkey, p_brand || ' ' || p_name as a, lead(p_brand || ' ' || p_name) over (order by p_partkey) as b from part qualify b is not null)
select p_partkey, round(case when a = b then 1 when contains(a, b) or contains(b, a) then 0.9 else 1 - levenshtein(a, b) / greatest(length(a), length(b))::double end, 6) as label_similarity,
  round(len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))::double, 6) as jaccard from p""")
def label_likeness(spark, d):
    """X-25 to X-27: likeness of labels and token sets of neighbours by key."""
    p = _t(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("a"))
    # the next key, by an equi-join: keys are dense
    following = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    both = p.join(following, "p_partkey")
    return both.select("p_partkey", _r(C.label_similarity(F.col("a"), F.col("b"))).alias("label_similarity"), _r(C.set_jaccard(F.split("a", " "), F.split("b", " "))).alias("jaccard"))


@query("""
with o as (select o_orderkey as k, md5(o_orderkey::varchar) || '01234567' as h from orders)
select k, case k % 4 when 0 then h when 1 then (k % 100000)::varchar when 2 then h else '' end as hash,
  case k % 4 when 0 then 'git' when 1 then 'svn' when 2 then 'raw' else 'review' end as tag, case when k % 4 = 3 then (k % 1000)::varchar end as change from o""")
def commit_extraction(spark, d):
    """X-3, X-4, X-7, SRC-13, A-4: commits that texts name behind their marks."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.md5(F.col("o_orderkey").cast("string")), F.lit("01234567")).alias("h"))
    k = F.col("k")
    git = F.concat(F.lit(f"x {C.REVISION_MARK}\n  https://chromium.googlesource.com/chromium/src.git/+/"), F.col("h"), F.lit(" done"))
    svn = F.concat(F.lit(f"{C.REVISION_MARK} http://src.chromium.org/viewvc/chrome?view=rev&revision="), (k % 100000).cast("string"))
    raw = F.concat(F.lit("Project: chromium/src\ncommit "), F.col("h"), F.lit("\nLink: https://x-review.example.com/1"))
    review = F.concat(F.lit("Project: chromium/src\nLink: https://chromium-review.example.com/c/chromium/src/+/"), (k % 1000).cast("string"))
    t = o.withColumn("text", F.when(k % 4 == 0, git).when(k % 4 == 1, svn).when(k % 4 == 2, raw).otherwise(review))
    a, b = F.get(C.marked_links(F.col("text")), F.lit(0)), F.get(C.project_blocks(F.col("text")), F.lit(0))
    out = t.select("k", a.alias("a"), b.alias("b"))
    return out.select("k", F.coalesce("a.hash", "b.hash", F.lit("")).alias("hash"), F.coalesce("a.tag", "b.tag").alias("tag"), C.change_number(F.col("b.url")).alias("change"))


@query("""
select o_orderkey, case when o_orderkey % 10 = 9 then 'no JSON' when o_orderkey % 10 = 8 then 'no placeholder' when o_orderkey % 10 = 7 then 'missing keys: replacements' when o_orderkey % 10 = 6 then 'a replacement''s type is unknown' when o_orderkey % 10 = 5 then 'no replacement is left' end as problem,
  case when o_orderkey % 10 < 4 then true when o_orderkey % 10 = 4 then false end as has_leakage, case when o_orderkey % 10 < 4 then 'in <FILE> of ' || o_custkey when o_orderkey % 10 = 4 then 'text ' || o_orderkey end as sanitized,
  case when o_orderkey % 10 < 4 then 'FILE=f' || o_orderkey || '.cc' when o_orderkey % 10 = 4 then '' end as replaced from orders""")
def json_answers(spark, d):
    """X-15, X-16, L-2: JSON out of a model's answer, checked and put in order, or why it is no good."""
    k = F.col("o_orderkey") % 10
    item = lambda type_, original: F.struct(F.lit(type_).alias("type"), original.alias("original"))
    file = F.concat(F.lit(" f"), F.col("o_orderkey").cast("string"), F.lit(".cc"))
    body = F.struct(
        (k != 4).alias("has_leakage"),
        F.when(k == 8, "plain").when(k == 4, F.lit(None)).otherwise(F.concat(F.lit(" in <FILE> of "), F.col("o_custkey").cast("string"))).alias("sanitized_desc"),
        F.when(k == 7, F.lit(None)).when(k == 6, F.array(item("place", file))).when(k == 5, F.array(item("Method", file))).when(k == 4, F.array_except(F.array(item("path", file)), F.array(item("path", file)))).otherwise(F.array(item("path", file), item("func", file), item("FILE", file))).alias("replacements"),
    )
    json = F.when(k == 7, F.to_json(body, {"ignoreNullFields": "true"})).otherwise(F.to_json(body, {"ignoreNullFields": "false"}))
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here you are: "), json, F.lit(" Bye."))).when(k == 9, "I cannot {do} that").otherwise(json)
    o = _t(spark, d, "orders").select("o_orderkey", enrich.mask_answer(answer, F.concat(F.lit("text "), F.col("o_orderkey").cast("string"))).alias("m"))
    return o.select("o_orderkey", "m.problem", "m.has_leakage", F.col("m.sanitized_desc").alias("sanitized"), F.array_join(F.transform("m.replacements", lambda x: F.concat_ws("=", x["type"], x["original"])), ";").alias("replaced"))


@query("""
select c_custkey, case when c_custkey % 4 = 3 then '' else 'f' || c_nationkey || '.cc' end as file, 'ns.f' || (c_custkey % 10) as sig from customer where c_custkey % 4 <> 2""")
def transcript_answers(spark, d):
    """X-17, X-38, V-1: the last JSON of a transcript that has the answer's key, its fields by any of their names."""
    c = _t(spark, d, "customer")
    k, sig = F.col("c_custkey") % 4, F.concat(F.lit("ns.f"), (F.col("c_custkey") % 10).cast("string"))
    one = F.struct(F.when(k != 3, F.concat(F.lit("f"), F.col("c_nationkey").cast("string"), F.lit(".cc"))).alias("file"), F.when(k == 0, sig).when(k == 1, F.lit("")).alias("function_name"), F.when(k == 1, sig).alias("func_name"), F.when(k == 3, sig).alias("name"))
    blank = F.struct(F.lit("x").alias("file"), F.lit("").alias("function_name"), F.lit(None).cast("string").alias("func_name"), F.lit(None).cast("string").alias("name"))
    good = F.to_json(F.struct(F.array(one, blank).alias("vulnerable_functions")))
    fenced = F.concat(F.lit('I think {"vulnerable_functions": []}\n```json\n'), good, F.lit('\n```\nand ```json\n{"other": 1}\n``` end'))
    text = F.when(k == 0, fenced).when(k == 1, F.concat(F.lit('first {"vulnerable_functions": []} then '), good, F.lit(' {"a": 1}'))).when(k == 3, good).otherwise('nothing {here} {"functions": [{"name": "n"}]}')
    out = enrich.transcript_predictions(c.select("c_custkey", text.alias("text")), "text")
    return out.select("c_custkey", F.explode("predicted").alias("p")).select("c_custkey", "p.file", "p.sig")


@query(r"""
with u as (select page_id, regexp_replace(url, '^https?://[^/]+/', '') as raw, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') as p from pages),
v as (select page_id, p || case page_id % 4 when 0 then '.CC' when 1 then '.h' when 2 then '.py' else '' end as path from u),
w as (select *, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^[.]*[^.].*?([.][^.]*)$', 1) as ext from v)
select page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, regexp_extract(path, '([^/]*)$', 1) as base, ext, case when lower(ext) in ('.cc', '.h') then 'cpp' else '' end as lang,
  array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '')[1:2], '/') as module, lower(ext) in ('.cc', '.h') as is_source from w where not contains(lower(path), 'test')""")
def file_paths(spark, d):
    """P-14, P-15, P-19, X-10, X-11, X-13: parts of paths."""
    p = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    k = F.col("page_id") % 4
    v = _t(spark, d, "pages").select("page_id", F.concat(p, F.when(k == 0, ".CC").when(k == 1, ".h").when(k == 2, ".py").otherwise("")).alias("path")).where(~C.mentions_test(F.col("path")))
    path = F.col("path")
    return v.select("page_id", C.dirname(path).alias("dir"), C.basename(path).alias("base"), C.extension(path).alias("ext"), C.language(path).alias("lang"), C.module(path).alias("module"), F.lower(C.extension(path)).isin(C.SOURCE).alias("is_source"))


@query("""
with r as (select c_custkey as k, 'CVE-' || (2010 + c_custkey % 15) || '-' || c_custkey as id, (c_custkey % 1000) / 10.0 as pct, c_custkey % 3 as s from customer)
select id, round(pct / 100, 6)::double as epss, case s when 0 then 'Published' when 1 then 'Rejected' else 'Awaiting Analysis' end as status, 'Name ' || k as name, k % 4 = 0 as is_issue from r where 2010 + k % 15 between 2012 and 2020""")
def record_fields(spark, d):
    """P-2 to P-6, P-8, P-12: fields out of records."""
    c = _t(spark, d, "customer").withColumn("k", F.col("c_custkey"))
    k = F.col("k")
    s = c.select("k", F.concat_ws("-", F.lit("CVE"), (2010 + k % 15).cast("string"), k.cast("string")).alias("id"), F.concat(((k % 1000) / 10.0).cast("decimal(10,1)").cast("string"), F.lit("%")).alias("pct"), F.when(k % 3 == 0, "PUBLISHED").when(k % 3 == 1, "REJECTED").otherwise("AWAITING ANALYSIS").alias("st"), F.concat(F.lit("CWE-79 Name "), k.cast("string")).alias("nm"), F.when(k % 4 == 0, F.array(F.lit("Issue Tracking"))).otherwise(F.array(F.lit("Patch"))).alias("tags"))
    s = s.where(C.year_between(F.col("id"), 2012, 2020))
    return s.select("id", C.percent(F.col("pct")).alias("epss"), C.status_name(F.col("st")).alias("status"), C.after_first_blank(F.col("nm")).alias("name"), C.tagged_or_url(F.col("tags"), ["Issue Tracking"], F.lit("http://x"), "(?i)bug").alias("is_issue"))


@query("""
with s as (select c_custkey, case when c_custkey % 4 = 0 then 'processed' when c_custkey % 4 = 1 then 'failed' end as status, c_custkey % 7 as seen from customer)
select c_custkey, coalesce(case when status is not null then seen end, -1) as attempts from s where coalesce(status, '') <> 'processed'""")
def work_list(spark, d):
    """J-29, J-30, J-33, SNK-4, SRC-26: what is still to be done, with what is known of earlier runs."""
    c = _t(spark, d, "customer").select("c_custkey", F.lit(-1).cast("long").alias("attempts"))
    k = F.col("c_custkey") % 4
    status = c.where("c_custkey % 4 < 2").select("c_custkey", F.when(k == 0, "processed").otherwise("failed").alias("status"), (F.col("c_custkey") % 7).alias("attempts"))
    plan = merge.overlay(c, status, ["c_custkey"], ["attempts"])
    return merge.to_do(plan, status, ["c_custkey"], ["processed"])


@query("""
with n as (select user_id, unnest([event_type, 'v' || (floor(value)::bigint % 3)]) as tag from events)
select tag, count(*) as n, count(distinct user_id) as n_users, round(avg(case when user_id % 2 = 0 then 1.0 else 0.0 end), 6)::double as even_share from n group by tag""")
def tag_counts(spark, d):
    """A-4 to A-6, A-23: counts, distinct counts and rates over nested tags."""
    e = _t(spark, d, "events").select("user_id", F.explode(F.array("event_type", F.concat(F.lit("v"), (F.floor("value") % 3).cast("string")))).alias("tag"))
    return e.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), _r(F.avg(F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(0.0))).alias("even_share"))


@query("""
with l as (select n_nationkey, n_regionkey, '100644 blob ' || md5(n_name) || chr(9) || case when n_nationkey % 4 = 0 then 'third_party/' else 'base/' end || lower(replace(n_name, ' ', '_')) || case n_nationkey % 3 when 0 then '.cc' when 1 then '.c' else '.txt' end as v from nation)
select n_regionkey::varchar as commit_id, split_part(v, chr(9), 2) as file, split_part(split_part(v, ' ', 3), chr(9), 1) as blob_oid, case when v like '%.cc' then 'cpp' else 'c' end as lang from l where v not like '%.txt' and v not like '%' || chr(9) || 'third_party/%'""")
def tree_listing(spark, d):
    """SRC-16, P-15, X-13: files of commits from a listing."""
    k = F.col("n_nationkey")
    path = F.concat(F.when(k % 4 == 0, "third_party/").otherwise("base/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.when(k % 3 == 0, ".cc").when(k % 3 == 1, ".c").otherwise(".txt"))
    lines = _t(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("commit_id"), F.concat(F.lit("100644 blob "), F.md5("n_name"), F.lit("\t"), path).alias("value"))
    return readers.tree_listing(lines, [".cc", ".c", ".h"], ["third_party/"])


_CHERRY = """
with c as (select o_custkey as s, o_orderkey as k, md5(o_orderkey::varchar) || '89abcdef' as id, lag(md5(o_orderkey::varchar) || '89abcdef') over (partition by o_custkey order by o_orderkey) as prev from orders),
l as (select s, k, id, case when k % 2 = 0 then prev end as src from c)"""


def _cherry(spark, d):
    from pyspark.sql.window import Window

    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("s"), F.col("o_orderkey").alias("pos"), F.concat(F.md5(F.col("o_orderkey").cast("string")), F.lit("89abcdef")).alias("id"))
    prev = F.lag("id").over(Window.partitionBy("s").orderBy("pos"))
    return o.withColumn("prev", prev).select("s", "pos", "id", F.when((F.col("pos") % 2 == 0) & F.col("prev").isNotNull(), F.concat(F.lit("Merge\n(cherry picked from commit "), F.expr("left(prev, 10 + cast(pos % 31 as int))"), F.lit(")"))).otherwise("Fix").alias("message"))


@query(
    _CHERRY
    + """,
g as (select s, k, id, sum(case when src is null then 1 else 0 end) over (partition by s order by k rows unbounded preceding) as run from l)
select s, k as pos, first_value(id) over (partition by s, run order by k) as root from g"""
)
def cherry_roots(spark, d):
    """G-3, J-15, X-5: cherry-picks, cited by prefix, back to where they come from."""
    return history.cherry_roots(_cherry(spark, d), "s").select("s", "pos", "root")


@query("""
with recursive c as (select p_partkey as k, md5(p_partkey::varchar) || '89abcdef' as hash, case when p_partkey % 5 <> 0 then md5((p_partkey // 2)::varchar) || '89abcdef' end as src from part),
f(hash, depth) as (select hash, 0 from c where k % 97 = 0 union select c.src, depth + 1 from f join c using (hash) where src in (select hash from c) and depth < 30)
select hash, min(depth)::int as depth from f group by hash""")
def expand_sources(spark, d):
    """G-4: what commits cite, transitively, as far as it exists."""
    h = lambda c: F.concat(F.md5(c.cast("string")), F.lit("89abcdef"))
    k = F.col("p_partkey")
    m = _t(spark, d, "part").select("p_partkey", h(k).alias("hash"), F.when(k % 5 != 0, F.concat(F.lit("(cherry picked from commit "), h(F.floor(k / 2)), F.lit(")"))).otherwise("x").alias("message"))
    return history.expand_sources(m.where("p_partkey % 97 = 0"), m.select("hash", "message"))


@query("""
with n as (select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos, count(*) over (partition by l_orderkey) as n from lineitem)
select a.l_orderkey, a.pos, coalesce((select string_agg('f' || b.l_partkey, ',' order by b.pos) from n b where b.l_orderkey = a.l_orderkey and b.pos <> a.pos and b.pos <= case when a.pos <= 3 then 4 else 3 end), '') as siblings, a.n - 1 as n_siblings from n a""")
def chain_siblings(spark, d):
    """J-14, X-36: the other functions of a chain, some of them shown."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    f = _t(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("sig"), F.row_number().over(w).cast("long").alias("pos"))
    return history.siblings(f, ["l_orderkey"], "sig", 3).select("l_orderkey", "pos", F.array_join("siblings", ",").alias("siblings"), "n_siblings")


@query("""
select l_partkey as blob, arg_min('o' || l_orderkey, (l_orderkey, l_linenumber)) as file from lineitem group by l_partkey""")
def first_file_of_blob(spark, d):
    """J-20, J-22: the first file that a blob was seen as."""
    li = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("blob"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file"), "l_orderkey", "l_linenumber")
    return history.first_file(li, "blob", "file", [F.col("l_orderkey"), F.col("l_linenumber")])


@query("""
with c as (select o_custkey as cve_id, 'l' || o_orderkey as leaf, 'p' || o_orderkey as root from orders), i as (select c_custkey as cve_id, case when c_custkey % 2 = 0 then (select min('l' || o_orderkey) from orders where o_custkey = c_custkey) else 'unknown' end as commit_id from customer),
lone as (select cve_id, min(root) as root from c group by cve_id having count(*) = 1)
select i.cve_id, i.commit_id, coalesce(c.root, lone.root) as root_parent_id from i left join c on c.cve_id = i.cve_id and c.leaf = i.commit_id left join lone on lone.cve_id = i.cve_id where i.commit_id is not null""")
def root_parents(spark, d):
    """J-23: the root parent by leaf, else of the only chain."""
    chains = _t(spark, d, "orders").select(F.col("o_custkey").alias("cve_id"), F.concat(F.lit("l"), F.col("o_orderkey").cast("string")).alias("leaf"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("root_parent_id"))
    low = chains.groupBy("cve_id").agg(F.min("leaf").alias("low"))
    i = _t(spark, d, "customer").select(F.col("c_custkey").alias("cve_id")).join(low, "cve_id", "left").select("cve_id", F.when(F.col("cve_id") % 2 == 0, F.col("low")).otherwise("unknown").alias("commit_id")).where("commit_id is not null")
    return history.root_parent(i, chains)


@query("""
select page_id, case page_id % 5 when 0 then 'DEAD' when 1 then 'https://to/' || page_id when 2 then 'https://final/' || page_id else url end as resolved, case page_id % 5 when 0 then 'no' when 3 then 'unknown' else 'yes' end as known,
  case page_id % 6 when 0 then 'exists' when 1 then 'failed: timeout' when 2 then 'failed: exit 3' when 3 then 'failed: empty output' when 4 then 'dry_run' else 'processed' end as state from pages""")
def external_states(spark, d):
    """SRC-24 to SRC-26: what fetched URLs, existence checks and jobs came to."""
    k = F.col("page_id")
    p = _t(spark, d, "pages").select("page_id", "url", F.when(k % 5 == 0, 404).when(k % 5 == 3, 403).otherwise(200).alias("status"), F.when(k % 5 == 2, F.concat(F.lit("https://final/"), k.cast("string"))).otherwise("").alias("final"), F.when(k % 5 == 1, F.concat(F.lit('<script>const url = "https://to/'), k.cast("string"), F.lit('";</script>'))).otherwise("<p>").alias("body"))
    ok = history.existence(F.col("status"))
    url = history.resolved_url(F.col("url"), F.when(F.col("status") == 403, 200).otherwise(F.col("status")), F.col("final"), F.col("body"))
    state = history.job_state(k % 6 == 0, k % 6 == 4, F.when(k % 6 == 2, 3).otherwise(0), F.when(k % 6 == 1, 120.0).otherwise(1.0), 120.0, F.when(k % 6 == 3, 0).otherwise(9))
    return p.select("page_id", url.alias("resolved"), F.when(ok, "yes").when(~ok, "no").otherwise("unknown").alias("known"), state.alias("state"))
