"""Instances: what a record's commit chains say should be found, and the quality cascade over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.columns import LABEL_PRIORITY, bare_name, filled, mentions_test, stem
from lodestrata.operators.dedup import collapse_headers, first_by

TARGETS = {"root_cause_vulnerable": ["root_cause_vulnerable"], "related": ["root_cause_vulnerable", "supporting_fix"], "all": None}


def wanted(label: Column, target: str) -> Column:
    names = TARGETS[target]
    return label.isNotNull() if names is None else F.coalesce(label.isin(names), F.lit(False))


def changed_functions(chains: DataFrame) -> DataFrame:
    """Chains (cve_id, chain_id, diffs array<struct<filename, diff_funcs>>) as rows of modified and removed functions."""
    files = chains.select("cve_id", "chain_id", F.posexplode("diffs").alias("f_", "d"))
    one = lambda cat: F.transform(F.coalesce(F.col(f"d.diff_funcs.{cat}"), F.array()), lambda x, i: F.struct(F.lit(cat).alias("category"), i.alias("i"), x["sig"].alias("sig"), x["code"].alias("code"), x["classification"].alias("classification")))
    funcs = files.select("cve_id", "chain_id", "f_", F.coalesce(F.col("d.filename"), F.lit("")).alias("file"), F.explode(F.concat(one("modified"), one("removed"))).alias("x"))
    pos = F.col("f_") * F.lit(1_000_000) + F.when(F.col("x.category") == "removed", 500_000).otherwise(0) + F.col("x.i")
    return funcs.select("cve_id", "chain_id", "file", "x.sig", "x.code", "x.classification", "x.category", pos.cast("long").alias("pos"))


def instances(chains: DataFrame, commits: DataFrame, target: str = "root_cause_vulnerable", collapse: bool = True) -> DataFrame:
    """cve_id, commit_id (the chain's leaf), commit_date, parent_id and the functions to be found, first ones first."""
    f = changed_functions(chains).where(wanted(F.col("classification"), target) & (F.coalesce("sig", F.lit("")) != ""))
    f = first_by(f.select("cve_id", "chain_id", "file", "sig", "pos"), ["cve_id", "chain_id", "file", "sig"], [F.col("pos")])
    if collapse:
        f = collapse_headers(f, ["cve_id", "chain_id"]).withColumn("pos", F.col("group_pos"))
    listed = f.groupBy("cve_id", "chain_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "file", "sig"))), lambda x: F.struct(x["file"].alias("file"), x["sig"].alias("sig"))).alias("vuln_funcs"))
    leaf = F.coalesce(F.get("commit_ids", F.size("commit_ids") - 1), F.lit(""))
    ends = chains.select("cve_id", "chain_id", leaf.alias("commit_id"), F.coalesce("root_parent_id", F.lit("")).alias("parent_id"))
    dates = commits.select("cve_id", F.col("id").alias("commit_id"), "commit_date")
    out = listed.join(ends, ["cve_id", "chain_id"]).join(dates, ["cve_id", "commit_id"], "left")
    return out.select("cve_id", "chain_id", "commit_id", F.coalesce("commit_date", F.lit("")).alias("commit_date"), "parent_id", "vuln_funcs")


def name_pairs(chains: DataFrame, target: str = "related") -> DataFrame:
    """Distinct (cve_id, file_stem, name) of the changed functions, tests left out."""
    f = changed_functions(chains).where(wanted(F.col("classification"), target) & ~mentions_test(F.col("file")))
    return f.select("cve_id", stem(F.col("file")).alias("file_stem"), bare_name(F.col("sig")).alias("name")).where("name <> ''").distinct()


def best_label(labels: DataFrame, keys: list[str]) -> DataFrame:
    """The weightiest label (classification, reasoning) of each key; none where there is no known one."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABEL_PRIORITY.items() for x in kv]), F.col("classification")), F.lit(0))
    return labels.where(F.col("classification").isNotNull()).groupBy(*keys).agg(F.max_by(F.struct("classification", "reasoning"), weight).alias("b")).select(*keys, "b.classification", "b.reasoning")


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row fails, null if it passes all."""
    out = None
    for name, ok in rules:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return F.lit(None).cast("string") if out is None else out


def reasons(df: DataFrame, reason: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def input_text(choice: str, summaries: Column, descriptions: Column, other: Column) -> Column:
    """The text that a record is found by: first filled summary, first filled description else summary, or a column."""
    first = lambda a: F.get(F.filter(a, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), F.lit(0))
    if choice == "issue_summary":
        return F.coalesce(first(summaries), F.lit(""))
    if choice == "issue_description":
        return F.coalesce(first(descriptions), first(summaries), F.lit(""))
    return F.coalesce(filled(other), F.lit(""))
