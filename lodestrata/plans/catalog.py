"""Named queries of the engine's own operators over the driver's tables, and equivalent SQL.

The tables hold no vulnerability records, so each operator runs on an analogous shape: customers as keys of several
sources, orders and line items as nested records, events as commit histories, documents and benchmark passages as
corpus and queries, embeddings as dense vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import columns as C
from lodestrata.operators import code, dedup, enrich, graph, instances, merge, metrics, retrieval, split
from lodestrata.sources import readers, sinks
from lodestrata.sources.shared import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, digits: int = 6):
    return F.round(c, digits)


# --- sources, references, nested predicates -----------------------------------------------------------------------


@query("""
with a as (select c_custkey as k, case when c_custkey % 5 = 0 then '' else c_name end as name, c_mktsegment as seg from customer where c_custkey % 3 <> 0),
b as (select c_custkey as k, upper(c_name) as name, case when c_custkey % 7 = 0 then '' else lower(c_mktsegment) end as seg from customer where c_custkey % 2 = 0),
c as (select c_custkey as k, 'third' as name from customer where c_custkey % 4 = 1)
select k, coalesce(nullif(b.name, ''), nullif(a.name, ''), nullif(c.name, ''), '') as name, coalesce(nullif(a.seg, ''), nullif(b.seg, ''), '') as seg,
  a.k is not null as in_a, b.k is not null as in_b, c.k is not null as in_c
from a full join b using (k) full join c using (k)""")
def source_priority_merge(spark, d):
    """J-1, P-7, U-1: full outer merge, each field from the first source that fills it."""
    cust = _t(spark, d, "customer").withColumn("k", F.col("c_custkey"))
    a = cust.where("k % 3 <> 0").select("k", F.when(F.col("k") % 5 == 0, "").otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("seg"))
    b = cust.where("k % 2 = 0").select("k", F.upper("c_name").alias("name"), F.when(F.col("k") % 7 == 0, "").otherwise(F.lower("c_mktsegment")).alias("seg"))
    c = cust.where("k % 4 = 1").select("k", F.lit("third").alias("name"))
    return merge.merge_sources({"a": a, "b": b, "c": c}, "k", {"name": ["b", "a", "c"], "seg": ["a", "b"]})


@query("""
with m as (select c_custkey % 3 <> 0 as a, c_custkey % 2 = 0 as b, c_custkey % 4 = 1 as c from customer)
select count(*) as n_keys, count_if(a and not b and not c)::bigint as only_a, count_if(b and not a and not c)::bigint as only_b, count_if(c and not a and not b)::bigint as only_c, count_if(a and b and c)::bigint as in_all
from m where a or b or c""")
def source_overlap(spark, d):
    """A-2, A-3: keys of one source alone and of all."""
    return merge.overlap_counts(source_priority_merge(spark, d), ["a", "b", "c"])


@query("""
with r as (select l_orderkey as k, l_linenumber as pos, 'u' || (l_partkey % 5) as url, l_returnflag as source, case when l_linestatus = 'O' then [l_linestatus, l_returnflag] else [] end as tags from lineitem),
u as (select k, url, min(pos) as pos, list_sort(list(distinct source)) as s, list_sort(list_distinct(flatten(list(tags)))) as t from r group by k, url)
select k, string_agg(url || '|' || array_to_string(s, '+') || '|' || array_to_string(t, '+'), ';' order by pos, url) as refs from u group by k""")
def reference_union(spark, d):
    """A-1, U-2: references by URL with the union of sources and tags, in order of first sight."""
    li = _t(spark, d, "lineitem")
    tags = F.when(F.col("l_linestatus") == "O", F.array("l_linestatus", "l_returnflag")).otherwise(F.array().cast("array<string>"))
    refs = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("u"), (F.col("l_partkey") % 5).cast("string")).alias("url"), F.col("l_returnflag").alias("source"), tags.alias("tags"))
    out = merge.union_references(refs, "k")
    one = lambda x: F.concat_ws("|", x["url"], F.array_join(x["sources"], "+"), F.coalesce(F.array_join(x["tags"], "+"), F.lit("")))
    return out.select("k", F.array_join(F.transform("references", one), ";").alias("refs"))


@query("""
with n as (select l_orderkey, bool_or(l_returnflag = 'R' and l_shipmode_like) as a, bool_or(l_quantity > 45) as b from (select *, l_linestatus = 'F' as l_shipmode_like from lineitem) group by 1),
o as (select o_orderkey, coalesce(a, false) as a, coalesce(b, false) as b from orders left join n on l_orderkey = o_orderkey)
select count(*) as n, count_if(a)::bigint as n_a, count_if(b)::bigint as n_b, count_if(a and b)::bigint as n_both, count_if(a or b)::bigint as n_either from o""")
def nested_exists_filter(spark, d):
    """P-9, P-10, P-11: any-nested conjunction, or filter, overlap counters."""
    li = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_returnflag", "l_linestatus", "l_quantity")).alias("items"))
    o = _t(spark, d, "orders").select("o_orderkey").join(li, "o_orderkey", "left")
    a = F.coalesce(F.exists("items", lambda x: (x["l_returnflag"] == "R") & (x["l_linestatus"] == "F")), F.lit(False))
    b = F.coalesce(F.exists("items", lambda x: x["l_quantity"] > 45), F.lit(False))
    o = o.select(a.alias("a"), b.alias("b"))
    return o.agg(F.count("*").alias("n"), F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count_if(F.col("a") | F.col("b")).alias("n_either"))


@query("""
select p_partkey, coalesce(nullif(case when p_partkey % 4 = 0 then '' else p_brand end, ''), n_name, '') as brand, coalesce(nullif(case when p_partkey % 6 = 0 then null else p_type end, ''), 'region ' || n_regionkey, '') as kind
from part left join nation on n_nationkey = p_partkey % 30""")
def backfill_left(spark, d):
    """J-2, P-21: blanks take the lookup's value."""
    p = _t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 30).cast("int").alias("key"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(F.col("p_brand")).alias("brand"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_type")).alias("kind"))
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("brand"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("kind"))
    return merge.backfill(p, n, "key", ["brand", "kind"]).drop("key")


@query("""
with j as (select d.*, l.quality, l.toxic from documents d left join labels l using (doc_id)),
r as (select case when text is null or trim(text) = '' then 'no text' when n_chars < 300 then 'short' when quality is null then 'not labelled' when quality = 0 then 'bad' when toxic = 1 then 'toxic' else 'kept' end as reason from j)
select reason, count(*) as n from r group by reason""")
def quality_cascade(spark, d):
    """P-17, P-18, A-3: the first rule that a record fails, and counts of reasons."""
    j = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    rules = [("no text", F.trim("text") != ""), ("short", F.col("n_chars") >= 300), ("not labelled", F.col("quality").isNotNull()), ("bad", F.col("quality") > 0), ("toxic", F.col("toxic") == 0)]
    return instances.reasons(j.withColumn("why", instances.first_failure(rules)), "why")


@query(r"""
select doc_id, regexp_extract(text, '\b([0-9a-f]{40})\b', 1) as hash, len(regexp_extract_all(text, '\b([0-9a-f]{40})\b', 1))::int as n_hashes,
  regexp_extract(text, '([a-zA-Z0-9._]+@[a-z0-9.]+)', 1) as mail, regexp_extract(text, '(https?://[^\s<>"]+)', 1) as url
from documents where regexp_matches(text, '[0-9a-f]{40}|@|https?://')""")
def regex_extract_hash(spark, d):
    """X-2, X-5: first and all matches."""
    docs = _t(spark, d, "documents").where(F.col("text").rlike("[0-9a-f]{40}|@|https?://"))
    e = lambda p: F.regexp_extract("text", p, 1)
    return docs.select("doc_id", e(C.HASH40).alias("hash"), F.size(C.all_matches(F.col("text"), C.HASH40)).alias("n_hashes"), e(r"([a-zA-Z0-9._]+@[a-z0-9.]+)").alias("mail"), e(r"(https?://[^\s<>\"]+)").alias("url"))


@query(r"""
with k as (select doc_id, lang, case when doc_id % 3 = 0 then '' else lpad((doc_id * 7919 % 100000)::varchar, 5, '0') end as dt, trim(regexp_replace(text, '\s+', ' ', 'g')) as m from documents),
g as (select *, first_value(doc_id) over (partition by lang, m order by case when dt = '' then '~' else dt end, doc_id) as keeper from k)
select doc_id, keeper, doc_id = keeper as is_kept from g""")
def canonical_dedup(spark, d):
    """U-6, W-5, X-6: the earliest of equal canonical messages stays, undated ones last."""
    docs = _t(spark, d, "documents")
    date = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.lpad((F.col("doc_id") * 7919 % 100000).cast("string"), 5, "0"))
    c = docs.select("lang", F.col("doc_id").alias("id"), date.alias("commit_date"), F.col("text").alias("message"), F.col("doc_id").alias("pos"))
    return dedup.canonical_duplicates(c, ["lang"]).select(F.col("id").alias("doc_id"), "keeper", "is_kept")


# --- arrays of records ---------------------------------------------------------------------------------------------


@query("""
with e as (select conv_id, turn, role || (turn % 3) as item from conversations),
m as (select conv_id, turn, case when item = 'user0' then 'first' when item = 'assistant1' then 'DEAD' when item = 'user1' then 'assistant2' else item end as item from e),
f as (select conv_id, item, min(turn) as t from m where item <> 'DEAD' group by all)
select c.conv_id, coalesce(string_agg(item, ',' order by t), '') as items from (select distinct conv_id from conversations) c left join f using (conv_id) group by c.conv_id""")
def ordered_union_rewrite(spark, d):
    """J-3, J-4, U-3: array elements through a lookup, dead ones dropped, distinct in order."""
    c = _t(spark, d, "conversations").select("conv_id", "turn", F.concat("role", (F.col("turn") % 3).cast("string")).alias("item"))
    arrays = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "item"))), lambda x: x["item"]).alias("items"))
    lookup = spark.createDataFrame([("user0", "first"), ("assistant1", "DEAD"), ("user1", "assistant2")], "old string, new string")
    return merge.rewrite_elements(arrays, "conv_id", "items", lookup).select("conv_id", F.array_join("items", ",").alias("items"))


@query("""
with e as (select conv_id, turn, length(text) % 40 as item from conversations), v as (select distinct length(text) % 40 as item from conversations where role = 'system')
select c.conv_id, coalesce(string_agg(item::varchar, ',' order by turn), '') as items from (select distinct conv_id from conversations) c left join (select * from e where item in (select item from v)) using (conv_id) group by c.conv_id""")
def valid_elements(spark, d):
    """J-5, J-7, J-8: semi-join inside arrays; rows whose array empties stay."""
    c = _t(spark, d, "conversations").withColumn("item", (F.length("text") % 40).cast("string"))
    arrays = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "item"))), lambda x: x["item"]).alias("items"))
    return merge.keep_elements(arrays, "conv_id", "items", c.where("role = 'system'")).select("conv_id", F.array_join("items", ",").alias("items"))


@query("""
with last as (select conv_id, max(turn) filter (where role = 'assistant') as cut from conversations group by conv_id)
select conv_id, count(*) as n, string_agg(role || ':' || left(text, 20), ' / ' order by turn) as shown from conversations join last using (conv_id) where cut is null or turn <= cut group by conv_id""")
def comment_cutoff(spark, d):
    """W-7, X-29, P-29: rows up to the last flagged one, then a prompt."""
    kept = split.prefix_to_last(_t(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "assistant")
    line = F.struct("turn", F.concat_ws(":", "role", C.shorten(F.col("text"), 20)).alias("s"))
    return kept.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["s"]), " / ").alias("shown"))


@query("""
with t as (select conv_id, coalesce(arg_min(text, turn) filter (where role = 'system' and trim(text) <> ''), '') as a, coalesce(arg_min(text, turn) filter (where role = 'user' and trim(text) <> ''), '') as b from conversations group by conv_id)
select conv_id, a as issue_summary, case when b <> '' then b else a end as issue_description from t""")
def first_nonempty_text(spark, d):
    """P-27: the text that a record is found by."""
    of = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(of("system").alias("s"), of("user").alias("u"))
    text = lambda k: instances.input_text(k, F.col("s"), F.col("u"), F.lit("")).alias(k)
    return c.select("conv_id", text("issue_summary"), text("issue_description"))


# --- splits, shards, order -----------------------------------------------------------------------------------------


@query("""
with r as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as rank, count(*) over () as n from orders)
select o_orderkey, rank, case when rank <= floor(n * 0.7) then 'train' when rank <= floor(n * 0.7) + floor(n * 0.1) then 'val' else 'test' end as split from r""")
def chron_split(spark, d):
    """W-1, A-25, J-16: 70/10/20 in order of date."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return split.chronological_split(o, "o_orderdate", ["o_orderkey"]).select("o_orderkey", F.col("rank").cast("bigint").alias("rank"), "split")


@query("""
with h as (select c_custkey, md5(c_name) as m from customer)
select c_custkey, list_reduce(list_prepend(0::bigint, list_transform(range(1, 33), lambda i: (instr('0123456789abcdef', m[i]) - 1)::bigint)), lambda a, x: (a * 16 + x) % 7) as shard
from h where c_custkey not in (select o_custkey from orders where o_orderkey % 11 = 0)""")
def hash_shard(spark, d):
    """X-19, J-29, V-2: shard of work that is not done yet."""
    left = split.pending(_t(spark, d, "customer").select("c_custkey", "c_name"), _t(spark, d, "orders").where("o_orderkey % 11 = 0").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
    return split.shard(left, "c_name", 7).select("c_custkey", "shard")


@query("""
with e as (select user_id, event_id, ts, event_type = 'error' or value < 20 as bad, row_number() over (partition by user_id order by ts, event_id) as rn from events),
i as (select *, sum(case when bad then 0 else 1 end) over (partition by user_id order by rn rows unbounded preceding) as island from e),
r as (select *, sum(case when bad then 1 else 0 end) over (partition by user_id, island order by rn rows unbounded preceding)::bigint as run from i),
b as (select *, coalesce(sum(case when run >= 3 then 1 else 0 end) over (partition by user_id order by rn rows between unbounded preceding and 1 preceding), 0) as broken from r)
select user_id, event_id, run from b where broken = 0""")
def failure_breaker(spark, d):
    """W-10: work up to three failures in a row."""
    e = _t(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return split.failure_runs(e, ["user_id"], "at", ~((F.col("event_type") == "error") | (F.col("value") < 20)), 3).select("user_id", "event_id", "run")


@query("""
with b as (select user_id, event_id, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as block from events)
select user_id, block, count(*) as n, min(event_id) as first_id from b group by all""")
def log_segments(spark, d):
    """W-8, SRC-14: a header line begins a block."""
    e = _t(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    out = split.segments(e, ["user_id"], "at", F.col("event_type") == "purchase")
    return out.groupBy("user_id", "block").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


# --- graphs and chains ---------------------------------------------------------------------------------------------

_EVENT_LINKS = """
with o as (select user_id, event_id, ts, lag(event_id) over w as prev, lag(ts) over w as prev_ts from events window w as (partition by user_id order by ts, event_id)),
p as (select user_id, event_id, ts, case when ts - prev_ts <= interval 12 hour then prev end as parent from o)"""


@query(
    _EVENT_LINKS
    + """,
g as (select *, sum(case when parent is null then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as c from p)
select user_id, event_id, first_value(event_id) over (partition by user_id, c order by ts, event_id)::varchar as chain_root, (row_number() over (partition by user_id, c order by ts, event_id) - 1)::int as depth from g"""
)
def event_chains(spark, d):
    """G-3, G-5: linear chains from parent pointers, by pointer doubling."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 12 hours")
    e = _t(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.when(near, F.lag("event_id").over(w)).alias("parent_id"), F.col("event_id").alias("pos"))
    out = graph.linear_chains(e, ["user_id"])
    return out.select("user_id", F.col("id").alias("event_id"), "chain_root", F.col("depth").cast("int").alias("depth"))


@query(
    _EVENT_LINKS
    + """,
g as (select *, sum(case when parent is null then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as c from p),
l as (select user_id, c, count(*) as n from g group by all), u as (select user_id, count(*) as n_chains, max(n) as longest from l group by user_id),
s as (select case when n_chains = 1 and longest = 1 then 'single' when n_chains = 1 then 'linear' when longest = 1 then 'parallel' else 'mixed' end || case when user_id % 5 = 0 then '+absorbed' else '' end as shape from u)
select shape, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from s group by shape"""
)
def chain_topology(spark, d):
    """G-6, A-7: shapes of histories and their shares."""
    c = event_chains(spark, d).groupBy("user_id", "chain_root").agg(F.count("*").alias("n"))
    u = c.groupBy("user_id").agg(F.count("*").alias("n_chains"), F.max("n").alias("longest"), F.max(F.when(F.col("user_id") % 5 == 0, 1).otherwise(0)).alias("absorbed"))
    return graph.topology(u)


@query("""
with e as (select user_id, event_type as sig, row_number() over (partition by user_id, event_type order by ts, event_id) as rn, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rv,
  case event_id % 5 when 0 then 'added' when 1 then 'removed' else 'modified' end as category, 'b' || (event_id % 4) as code, 'b' || (event_id % 3) as code_after from events),
f as (select * from e where rn = 1), l as (select * from e where rv = 1)
select f.user_id, f.sig, case when l.category = 'removed' then 'removed' else 'modified' end as last_action, f.code as code,
  case l.category when 'added' then l.code when 'modified' then l.code_after end as code_after
from f join l using (user_id, sig) where f.category <> 'added' and not (l.category <> 'removed' and coalesce(f.code = case l.category when 'added' then l.code else l.code_after end, false))""")
def net_state(spark, d):
    """W-6, A-27, U-11: what a chain did to each function in the end."""
    k = F.col("event_id") % 5
    e = _t(spark, d, "events").select("user_id", F.col("event_type").alias("sig"), F.struct("ts", "event_id").alias("at"), F.when(k == 0, "added").when(k == 1, "removed").otherwise("modified").alias("category"), F.concat(F.lit("b"), (F.col("event_id") % 4).cast("string")).alias("code"), F.concat(F.lit("b"), (F.col("event_id") % 3).cast("string")).alias("code_after"))
    return dedup.net_state(e, ["user_id", "sig"], "at")


@query("""
with l as (select user_id, case event_id % 4 when 0 then 'root_cause_vulnerable' when 1 then 'supporting_fix' when 2 then 'incidental_or_unrelated' end as c from events),
p as (select user_id, c, case c when 'root_cause_vulnerable' then 3 when 'supporting_fix' then 2 else 1 end as w from l where c is not null)
select user_id, arg_max(c, w) as classification from p group by user_id""")
def best_label(spark, d):
    """A-26: the weightiest label."""
    k = F.col("event_id") % 4
    l = _t(spark, d, "events").select("user_id", F.when(k == 0, "root_cause_vulnerable").when(k == 1, "supporting_fix").when(k == 2, "incidental_or_unrelated").alias("classification"), F.lit("").alias("reasoning"))
    return instances.best_label(l, ["user_id"]).select("user_id", "classification")


_DAG = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "z"), ("z", "x"), ("q", "a")]
_EDGES = """e as (select * from (values ('a','b'), ('a','c'), ('b','d'), ('c','d'), ('d','e'), ('x','y'), ('y','z'), ('z','x'), ('q','a')) t(child, parent)
  union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'r' || r_regionkey, 'world' from region),
s as (select distinct child as node from e),
w(start, path) as (select node, [node] from s union all select start, list_append(path, parent) from w join e on child = path[len(path)] where not list_contains(path, parent)),
ends as (select start, path from w where not exists (select 1 from e where child = path[len(path)] and not list_contains(path, parent)))"""


def _edges(spark, d):
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = _t(spark, d, "nation").select(text("n", "n_nationkey").alias("child"), text("r", "n_regionkey").alias("parent"))
    r = _t(spark, d, "region").select(text("r", "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    return spark.createDataFrame(_DAG, "child string, parent string").union(n).union(r)


@query(f"with recursive {_EDGES} select start, array_to_string(path, '>') as path from ends")
def hierarchy_paths(spark, d):
    """G-1: all upward paths, cycles guarded."""
    e = _edges(spark, d)
    return graph.root_paths(e.select(F.col("child").alias("node")).distinct(), e).select("start", F.array_join("path", ">").alias("path"))


@query(f"""with recursive {_EDGES},
roots as (select distinct parent as node from e where parent not in (select child from e)),
m as (select * from (values ('b', 'k1'), ('d', 'k1'), ('d', 'k2'), ('r1', 'k3'), ('n3', 'k3')) t(node, category)),
whole as (select start, path[len(path)] as rep, list_append(path, '1000') as path from ends where path[len(path)] in (select node from roots) or len(path) = 1),
sub as (select start, node, category as rep, min(list_append(list_append(path[1:i], category), '699')) as path from (select start, path, unnest(range(1, len(path) + 1)) as i, unnest(path) as node from ends) join m using (node) group by start, node, category),
found as (select distinct start, rep, path from (select * from whole union all select start, rep, path from sub))
select start, rep, array_to_string(path, '>') as path from found
union all select distinct start, start, start from ends where start not in (select start from found)""")
def hierarchy_representatives(spark, d):
    """G-2, A-8: representatives of a node in both views."""
    e = _edges(spark, d)
    paths = graph.root_paths(e.select(F.col("child").alias("node")).distinct(), e)
    roots = e.select(F.col("parent").alias("node")).distinct().join(e.select(F.col("child").alias("node")), "node", "left_anti")
    members = spark.createDataFrame([("b", "k1"), ("d", "k1"), ("d", "k2"), ("r1", "k3"), ("n3", "k3")], "node string, category string")
    return graph.representatives(paths, roots, members).select("start", "rep", F.array_join("path", ">").alias("path"))


# --- ranking -------------------------------------------------------------------------------------------------------

_PAIRS = """
with p as (select distinct c_custkey as owner, c_mktsegment as class, p_brand || '/' || p_type as item from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey),
kept as (select * from p where item in (select item from p group by item having count(distinct owner) >= 2)),
n as (select class, item, count(*) as score from kept where owner % 5 <> 0 group by all),
top as (select *, row_number() over (partition by class order by score desc, item) as rank from n qualify rank <= 10)"""


def _pairs(spark, d):
    li, o, c, p = (_t(spark, d, x) for x in ("lineitem", "orders", "customer", "part"))
    full = li.select("l_orderkey", "l_partkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(p.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    pairs = full.select(F.col("c_custkey").alias("owner"), F.col("c_mktsegment").alias("class"), F.concat_ws("/", "p_brand", "p_type").alias("item")).distinct()
    return dedup.without_singletons(pairs, ["item"], "owner")


@query(f"{_PAIRS} select class, item, score, rank::int as rank from top")
def freq_ranking(spark, d):
    """I-1, A-9, A-10, A-12, A-13, T-2: items of a class by how many training owners have them."""
    pairs = _pairs(spark, d).where("owner % 5 <> 0")
    classes = pairs.select(F.col("class").alias("query"), "class").distinct()
    return retrieval.frequency_ranking(pairs, classes).select(F.col("query").alias("class"), "item", "score", "rank")


@query(f"""{_PAIRS},
gt as (select owner, class, item from kept where owner % 5 = 0), ng as (select owner, class, count(*) as n from gt group by all),
h as (select ng.owner, ng.class, ng.n, t.rank, case when g.item is not null then 1 else 0 end as hit from ng join top t on t.class = ng.class left join gt g on g.owner = ng.owner and g.item = t.item),
c as (select *, sum(hit) over (partition by owner order by rank) as so_far from h),
m as (select owner, class, max(case when rank <= 10 then hit end)::double as hit_10, sum(hit) / 10.0::double as precision_10, sum(hit) / max(n)::double as recall_10, coalesce(1.0 / min(case when hit = 1 then rank end), 0.0)::double as mrr, sum(case when hit = 1 then so_far / rank::double else 0 end) / max(n) as map from c group by owner, class)
select class, count(*) as n_keys, round(avg(hit_10), 6) as hit_10, round(avg(precision_10), 6) as precision_10, round(avg(recall_10), 6) as recall_10, round(avg(mrr), 6) as mrr, round(avg(map), 6) as map from m group by class""")
def freq_recommender(spark, d):
    """I-1, M-2, M-4, A-17 to A-19, J-25, J-27: frequency recommendations scored per owner and averaged by class."""
    pairs = _pairs(spark, d)
    top = retrieval.frequency_ranking(pairs.where("owner % 5 <> 0"), pairs.select(F.col("class").alias("query"), "class").distinct())
    ranked = top.groupBy(F.col("query").alias("class")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("ranked"))
    truth = pairs.where("owner % 5 = 0").groupBy("owner", "class").agg(F.collect_set("item").alias("known"))
    scored = truth.join(F.broadcast(ranked), "class").select("owner", "class", *metrics.set_metrics(F.col("ranked"), F.col("known")))
    names = ["hit_10", "precision_10", "recall_10", "mrr", "map"]
    out = metrics.by_class(scored.drop("class"), truth.select("owner", "class"), "owner", "class", names)
    return out.select("class", "n_keys", *[_r(F.col(n)).alias(n) for n in names])


_BM25 = r"""
with dt as (select doc_id, lang, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]*'), lambda x: length(x) > 1) as ts from documents),
st as (select lang, count(*)::double as n, avg(len(ts)) as avgdl from dt group by lang),
p as (select doc_id, lang, len(ts)::double as dl, term, count(*)::double as tf from (select doc_id, lang, ts, unnest(ts) as term from dt) group by doc_id, lang, dl, term),
qt as (select item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]*'), lambda x: length(x) > 1)) as term from benchmark),
q as (select item_id, term, count(*)::double as qtf from qt group by all),
f as (select lang, term, count(*)::double as df from p group by all),
s as (select q.item_id, p.lang, p.doc_id, g.k1, g.b, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * qtf * tf * (g.k1 + 1) / (tf + g.k1 * (1 - g.b + g.b * dl / avgdl))), 6) as score
  from q join p using (term) join f using (term, lang) join st using (lang) cross join (select * from (values {grid}) v(k1, b)) g group by q.item_id, p.lang, p.doc_id, g.k1, g.b)"""


def _bm25(spark, d, grid, k):
    docs, bench = _t(spark, d, "documents"), _t(spark, d, "benchmark")
    tokens = C.identifier_tokens(F.lower("text"))
    langs = docs.select("lang").distinct()
    queries = bench.select(F.col("item_id").alias("query"), "text").join(F.broadcast(langs), F.lit(True))  # a handful of languages
    return retrieval.bm25_top(queries, docs.select("doc_id", "lang", "text"), ["lang"], "doc_id", tokens, tokens, grid, k)


@query(_BM25.format(grid="(1.5, 0.75)") + " select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from s qualify rank <= 10")
def bm25_topk(spark, d):
    """I-5, X-8, A-15, A-16, T-5: passages against documents by language, ten best."""
    s = _bm25(spark, d, [(1.5, 0.75)], 10).withColumnRenamed("query", "item_id")
    return s.where("score > 0").select("item_id", "doc_id", "score", "rank")


_GRID = [(k1, b) for k1 in (1.2, 1.5, 2.0) for b in (0.5, 0.75, 0.9)]


@query(
    _BM25.format(grid=", ".join(f"({k}, {b})" for k, b in _GRID))
    + """,
t as (select *, row_number() over (partition by item_id, k1, b order by score desc, doc_id) as rank from s qualify rank <= 10),
rel as (select item_id, doc_id from benchmark x join documents y on contains(y.text, x.text)),
m as (select item_id, k1, b, min(rank) as r from t join rel using (item_id, doc_id) group by all),
v as (select k1, b, round(sum(1.0 / r) / (select count(distinct item_id) from rel), 6) as mrr from m group by k1, b)
select k1::double as k1, b::double as b, mrr from v order by mrr desc, k1, b limit 1"""
)
def bm25_grid_best(spark, d):
    """I-6, A-31: the grid's best point by mean reciprocal rank of the documents that hold the passage."""
    top = _bm25(spark, d, _GRID, 10)
    # the passages are a small, stated query set; each document is searched for all of them at once
    passages = _t(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("passage"))
    rel = _t(spark, d, "documents").select("doc_id", "text").join(F.broadcast(passages), F.contains("text", "passage")).select("query", "doc_id")
    rel = kept(rel, "relevant")  # counted and joined
    first = top.join(rel, ["query", "doc_id"]).groupBy("query", "k1", "b").agg(F.min("rank").alias("r"))
    n = rel.select("query").distinct().count()
    v = first.groupBy("k1", "b").agg(_r(F.sum(1.0 / F.col("r")) / n).alias("mrr"))
    return retrieval.best_point(v.withColumn("pos", F.struct("k1", "b")), "mrr").select("k1", "b", "mrr")


@query(r"""
with dt as (select doc_id, lang, doc_id % 20 = 0 as test, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]*'), lambda x: length(x) > 1) as ts from documents join labels using (doc_id)),
p as (select doc_id, lang, test, term, count(*)::double as tf from (select doc_id, lang, test, unnest(ts) as term from dt) group by all),
v0 as (select lang, term, count(*)::double as df, sum(tf) as cf from p group by lang, term),
v as (select * from v0 qualify row_number() over (partition by lang order by cf desc, term) <= 5000),
n as (select lang, count(*)::double as n from dt group by lang),
w as (select doc_id, p.lang, test, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) as w from p join v using (lang, term) join n on n.lang = p.lang),
u as (select w.*, w / sqrt(sum(w * w) over (partition by doc_id)) as x from w),
s as (select a.doc_id as query, b.doc_id as doc, round(sum(a.x * b.x), 6) as sim from u a join u b on a.lang = b.lang and a.term = b.term where a.test and not b.test group by all),
k as (select *, row_number() over (partition by query order by sim desc, doc) as rank from s qualify rank <= 5),
t as (select query, 'q' || quality || 't' || toxic as item, round(sum(sim / rank), 6) as score from k join labels on doc_id = doc group by all)
select query, item, score, row_number() over (partition by query order by score desc, item)::int as rank from t""")
def tfidf_knn_vote(spark, d):
    """I-2, A-14, T-3, X-23: neighbours by TF-IDF in each group vote for items."""
    return _votes(spark, d, 5000)


def _votes(spark, d, terms):
    labels = _t(spark, d, "labels").withColumn("item", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")))
    docs = _t(spark, d, "documents").join(labels, "doc_id").select(F.col("doc_id").alias("doc"), "lang", "text")
    v = retrieval.tfidf_vectors(docs, ["lang"], "doc", C.identifier_tokens(F.lower("text")), terms)
    v = kept(v, "vectors")  # read as neighbours and as queries
    items = labels.select(F.col("doc_id").alias("doc"), "item")
    return retrieval.knn_vote(v, F.col("doc") % 20 == 0, ["lang"], items).select("query", "item", "score", "rank")


@query()
def decision_tree_rank(spark, d):
    """I-3, A-20, A-30, T-4: labels ranked by a tree's probabilities."""
    labels = _t(spark, d, "labels").select(F.col("doc_id").alias("doc"), F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("label"))
    docs = _t(spark, d, "documents").join(labels, F.col("doc_id") == F.col("doc")).select("doc", "label", C.word_tokens(F.col("text")).alias("tokens"))
    return retrieval.tree_ranking(docs.where("doc % 5 <> 0"), docs.where("doc % 5 = 0").select("doc", "tokens"))


_DENSE = """
with q as (select vec_id as query, embedding as e from embeddings where vec_id % 100 = 0),
s as (select query, vec_id as doc, label, round(list_dot_product(list_transform(e, lambda x: x::double), list_transform(embedding, lambda x: x::double)), 6) as score from embeddings join q on true),
t as (select *, row_number() over (partition by query order by score desc, doc) as rank from s where doc <> query qualify rank <= 10)"""


def _dense(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    return retrieval.neighbours(v, v.where("doc % 100 = 0"), 10)


@query(_DENSE + " select query, doc, score, rank::int as rank from t where score > 0")
def dense_topk(spark, d):
    """I-8, I-11, X-24, T-6, T-12: nearest vectors of every hundredth vector, without themselves."""
    return _dense(spark, d).where("score > 0").select("query", "doc", "score", "rank")


@query(
    _DENSE
    + """,
l as (select vec_id, label from embeddings), m as (select t.*, ql.label as qlabel from t join l ql on ql.vec_id = t.query),
g as (select *, row_number() over (partition by query order by (label = qlabel), rank, doc) as nth from m)
select query, doc, nth::int as nth from g where nth <= 4 and label <> qlabel"""
)
def hard_negatives(spark, d):
    """I-9, J-21, J-31: near vectors of another label within a budget."""
    return _negatives(spark, d, _dense(spark, d))


def _negatives(spark, d, near):
    labels = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "label")
    none = spark.createDataFrame([], "query long, doc long")
    return retrieval.hard_negatives(near, labels, none, 4).select("query", "doc", "nth")


@query(
    _DENSE
    + """,
h as (select t.query, rank, (t.label = ql.label)::int as hit from t join embeddings ql on ql.vec_id = t.query),
n as (select q.vec_id as query, count(*) - 1 as n from embeddings q join embeddings o on o.label = q.label where q.vec_id % 100 = 0 group by q.vec_id),
c as (select h.*, n.n, sum(hit) over (partition by h.query order by rank) as so_far from h join n using (query))
select query, max(case when rank <= 1 then hit end)::double as hit_1, max(hit)::double as hit_10, sum(case when rank <= 5 then hit else 0 end) / 5.0::double as precision_5, round(sum(hit) / max(n)::double, 6) as recall_10,
  round(sum(hit) / (10 + max(n) - sum(hit))::double, 6) as iou_10, round(coalesce(1.0 / min(case when hit = 1 then rank end), 0.0)::double, 6) as mrr, round(sum(case when hit = 1 then so_far / rank::double else 0 end) / max(n), 6) as map
from c group by query"""
)
def rank_metrics(spark, d):
    """M-1, M-3, X-22, W-2, W-3: metrics of a ranking against the vectors of the same label."""
    return _metrics(spark, d, _dense(spark, d), "vec_id % 100 = 0")


def _metrics(spark, d, near, some):
    e = _t(spark, d, "embeddings").select("vec_id", "label")
    q = e.where(some).select(F.col("vec_id").alias("query"), F.col("label").alias("query_label")).distinct()
    # of the vectors of a label only those that are ranked are listed; the others are a number
    sizes = e.groupBy(F.col("label").alias("query_label")).agg(F.count_distinct("vec_id").alias("n")).where("n > 1")
    hit = F.when(F.col("label") == F.col("query_label"), F.col("doc"))
    met = near.join(e.select(F.col("vec_id").alias("doc"), "label"), "doc").join(q, "query").join(sizes, "query_label")
    m = met.groupBy("query", "n").agg(F.transform(F.sort_array(F.collect_set(F.struct("rank", "doc"))), lambda x: x["doc"]).alias("ranked"), F.collect_set(hit).alias("known"))
    m = m.select("query", *metrics.set_metrics(F.col("ranked"), F.col("known"), size=F.col("n") - 1))
    return m.select("query", "hit_1", "hit_10", "precision_5", *[_r(F.col(c)).alias(c) for c in ("recall_10", "iou_10", "mrr", "map")])


@query("""
with r as (select o_orderkey, o_totalprice as a, count(*)::double as b from orders join lineitem on l_orderkey = o_orderkey group by all),
k as (select a, b, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from r)
select count(*) as n, round(corr(ra, rb), 6) as rho, round(avg(a - b), 4) as mean_gap from k""")
def spearman(spark, d):
    """A-21, J-28, M-6: rank correlation with ties averaged."""
    o = _t(spark, d, "orders").join(_t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("b")), "o_orderkey")
    return metrics.spearman(o.select(F.col("o_totalprice").alias("a"), "b"), "a", "b").select("n", _r(F.col("rho")).alias("rho"), _r(F.col("mean_gap"), 4).alias("mean_gap"))


# --- matching, code, text ------------------------------------------------------------------------------------------

_URLS = r"""
with u as (select page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') as p from pages),
a as (select page_id, p, regexp_extract(p, '([^/]*)$', 1) as base from u)"""


@query(
    _URLS
    + """
select x.page_id as one, y.page_id as other from a x join a y on x.page_id < y.page_id and x.base = y.base where x.base <> ''"""
)
def fuzzy_match(spark, d):
    """J-26, X-20, X-10: files that match by path; candidates meet by base name, so no pair is tried in vain."""
    p = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    a = _t(spark, d, "pages").select("page_id", p.alias("p")).withColumn("base", C.basename(F.col("p"))).where("base <> ''")
    x, y = a.select(F.col("page_id").alias("one"), F.col("p").alias("p1"), "base"), a.select(F.col("page_id").alias("other"), F.col("p").alias("p2"), "base")
    return x.join(y, "base").where("one < other").where(C.same_file(F.col("p1"), F.col("p2"))).select("one", "other")


@query("""
with g as (select left(p_name, 1) as m, p_brand, count(*) as n, list_sort(list(p_partkey::varchar)) as ks from part group by all)
select p_brand as brand, m as module, n, rpad(p_brand, 12, ' ') || '  ' || rpad(m, 3, ' ') || '  ' || lpad(n::varchar, 4, ' ') || '  ' || array_to_string(ks[1:3], ',') || case when len(ks) > 3 then ' (+' || (len(ks) - 3) || ' more)' else '' end as line from g""")
def index_lines(spark, d):
    """SNK-6, X-11, X-36, A-28: fixed-width index lines."""
    g = _t(spark, d, "part").groupBy(F.substring("p_name", 1, 1).alias("module"), F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.col("p_partkey").cast("string"))).alias("ks"))
    rest = F.concat_ws("  ", F.lpad(F.col("n").cast("string"), 4, " "), C.sampled_list(F.col("ks"), 3, ","))
    lines = sinks.index_lines(g.withColumn("k", F.struct("brand", "module", "n")), "k", [(F.col("brand"), 12), (F.col("module"), 3)], rest)
    return lines.select("k.brand", "k.module", "k.n", "line")


@query(r"""
select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) as title,
  len(regexp_extract_all(html, '<a\b[^>]*?href="([^"]*)"', 1))::int as n_links, coalesce(regexp_extract_all(html, '<a\b[^>]*?href="([^"]*)"', 1)[1], '') as first_link from pages""")
def html_fields(spark, d):
    """SRC-7, X-1, X-37: fields of a page."""
    p = _t(spark, d, "pages").select("page_id", readers.html_fields(F.col("html")).alias("f"))
    return p.select("page_id", "f.title", F.size("f.links").alias("n_links"), F.coalesce(F.get("f.links", F.lit(0)), F.lit("")).alias("first_link"))


@query(r"""
with m as (select doc_id, text, regexp_matches(text, '\b[0-9]+(?:\.[0-9]+){1,3}\b') as leaks from documents)
select doc_id, case when leaks then 'restate' else 'copy' end as stage1, case when leaks then case when length(text) > 1000 then 'long' else 'brief' end end as stage2,
  coalesce(case when leaks then case when length(text) > 1000 then 'long' else 'brief' end end, 'copy') as label from m""")
def two_stage_label(spark, d):
    """L-4, P-20: a second verdict for what the first calls related."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    one = F.when(F.col("text").rlike(r"\b[0-9]+(?:\.[0-9]+){1,3}\b"), "restate").otherwise("copy")
    return enrich.two_stages(docs, "doc_id", one, F.when(F.length("text") > 1000, "long").otherwise("brief"), ["restate"]).select("doc_id", "stage1", "stage2", "label")


_MASK_SQL = r"""
with p as (select p_partkey, p_name || case p_partkey % 5 when 0 then ' before 47.0.2526.73 and 12.x.1' when 1 then ' in ns::Foo::bar() of src/a.cc, b.hpp' when 2 then ' in version 4.0' when 3 then ' on Windows' else '' end as t from part),
m as (select *, regexp_matches(t, '{leaks}') as leaks from p),
f as (select *, regexp_replace(t, '\b[\w./-]+\.(?:cc|cpp|cxx|c|hpp|hh|hxx|h|mm|m|java|js|ts|py|go|rs)\b', '<FILE>', 'g') as a from m),
g as (select *, regexp_replace(regexp_replace(a, '\w+(?:::\w+)+(?:\(\))?', '<FUNC>', 'g'), '\b[0-9]+(?:\.(?:x|[0-9]+)){{1,4}}\b', '<SOFTWARE_VERSION>', 'g') as b from f)
select p_partkey, leaks, case when leaks then replace(replace(replace(b, '<FILE>', 'a source file'), '<FUNC>', 'a function'), '<SOFTWARE_VERSION>', 'an affected version') else t end as restated from g"""


@query(_MASK_SQL.format(leaks=C.LEAKS.replace("'", "''")))
def mask_restate(spark, d):
    """L-3, X-15, P-22, P-23: masked by rules, placeholders then put in words."""
    k = F.col("p_partkey") % 5
    tail = F.when(k == 0, " before 47.0.2526.73 and 12.x.1").when(k == 1, " in ns::Foo::bar() of src/a.cc, b.hpp").when(k == 2, " in version 4.0").when(k == 3, " on Windows").otherwise("")
    m = enrich.masked(_t(spark, d, "part").select("p_partkey", F.concat("p_name", tail).alias("text")), "text")
    return m.select("p_partkey", F.col("has_leakage").alias("leaks"), F.when(enrich.needs_call(F.col("has_leakage"), F.col("text_masked")), enrich.restated(F.col("text_masked"))).otherwise(F.col("text")).alias("restated"))


@query("""
with f as (select distinct o_orderkey as commit_id, (l_partkey % 400) as blob from orders join lineitem on l_orderkey = o_orderkey), b as (select p_partkey % 400 as blob, count(*) as n_funcs from part where p_partkey % 400 < 350 group by 1)
select count(distinct f.commit_id) as n_commits, count(*) as n_files, count(distinct f.blob) as n_blobs, coalesce(sum(n_funcs), 0)::bigint as n_funcs, count(distinct case when b.blob is null then f.blob end) as n_pending, round(count(*) / count(distinct f.blob)::double, 6) as dedup_ratio
from f left join b using (blob)""")
def corpus_totals(spark, d):
    """A-22, J-17 to J-19, U-14: corpus statistics over files and blobs, and what is still to be parsed."""
    li, p = _t(spark, d, "lineitem"), _t(spark, d, "part")
    f = li.select(F.col("l_orderkey").alias("commit_id"), (F.col("l_partkey") % 400).alias("blob")).distinct()
    b = p.select((F.col("p_partkey") % 400).alias("blob")).where("blob < 350").groupBy("blob").agg(F.count("*").alias("n_funcs"))
    m = f.join(b, "blob", "left")
    return m.agg(F.count_distinct("commit_id").alias("n_commits"), F.count("*").alias("n_files"), F.count_distinct("blob").alias("n_blobs"), F.coalesce(F.sum("n_funcs"), F.lit(0)).alias("n_funcs"), F.count_distinct(F.when(F.col("n_funcs").isNull(), F.col("blob"))).alias("n_pending"), _r(F.count("*") / F.count_distinct("blob")).alias("dedup_ratio"))


@query("""
with c as (select p_partkey, p_brand as d, split_part(p_type, ' ', 1) as name, p_size % 2 = 0 as impl, p_retailprice from part), g as (select *, row_number() over (partition by d, name order by (not impl), p_partkey) as rn from c)
select d as dir, name, p_partkey from g where rn = 1""")
def header_collapse(spark, d):
    """U-7, U-4, X-14: one function of a header and implementation pair."""
    p = _t(spark, d, "part")
    name = F.substring_index("p_type", " ", 1)
    ext = F.when(F.col("p_size") % 2 == 0, ".cc").otherwise(".h")
    f = p.select(F.lit(1).alias("one"), F.concat(F.col("p_brand"), F.lit("/f"), ext).alias("file"), F.concat(name, F.lit(":void(int)")).alias("sig"), F.col("p_partkey").alias("pos"))
    out = dedup.collapse_headers(f, ["one"])
    return out.select(C.dirname(F.col("file")).alias("dir"), C.qualified_name(F.col("sig")).alias("name"), F.col("pos").alias("p_partkey"))


@query("""
with w as (select doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 14)) as m from documents), n as (select doc_id, m, count(*) as n from w group by all)
select doc_id, arg_max(m, (n, length(m), m)) as mention, arg_max(n, (n, length(m), m)) as n from n group by doc_id""")
def most_mentioned(spark, d):
    """A-29, T-11: the most mentioned match, longer first."""
    docs = _t(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return enrich.mentions(docs, "doc_id", "text", r"(?<![a-z])([a-z]{15,})(?![a-z])")


_CPP = """
namespace net {
class Socket {
 public:
  explicit Socket(int fd) : fd_(fd) {}
  // reads
  int Read(char* buf, size_t n) { if (n > %d) { return -1; } return n; }
};
}
#if A
static void Log(const std::string& s) { puts("}"); }
#else
static void Log(const std::string& s) {
#endif
"""


@query()
def code_functions(spark, d):
    """N-1 to N-3, SRC-23, X-31, X-33: functions of two versions of a file and what changed, one file for each part."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("file"), F.format_string(_CPP.replace("{", "{"), F.col("p_size")).alias("old"), F.format_string(_CPP, F.col("p_size") + (F.col("p_partkey") % 2).cast("int")).alias("new"))
    return code.function_diff(code.function_table(p, ["file"], "old"), code.function_table(p, ["file"], "new"), ["file"])


FLAGSHIP = freq_recommender
