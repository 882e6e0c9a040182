"""Ranking metrics: per instance from ordered arrays, then means over keys and classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.columns import filled, let, match_keys, same_keys, stem
from lodestrata.operators.split import counts_before

CUTS = (1, 3, 5, 10)


def _at(hits: Column, returned: Column, known: Column, k: int, suffix: str) -> list[Column]:
    """Set metrics at a cut: precision counts against k, IoU against what was returned."""
    n, m, g = hits.cast("double"), returned.cast("double"), known.cast("double")
    p, r = n / k, F.coalesce(F.try_divide(n, g), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        F.when(hits > 0, 1.0).otherwise(0.0).alias(f"hit{suffix}_{k}"),
        p.alias(f"precision{suffix}_{k}"),
        r.alias(f"recall{suffix}_{k}"),
        zero(F.try_divide(2 * p * r, p + r)).alias(f"f1{suffix}_{k}"),
        zero(F.try_divide(n, m + g - n)).alias(f"iou{suffix}_{k}"),
        F.when((known > 0) & (hits == known), 1.0).otherwise(0.0).alias(f"subset_acc{suffix}_{k}"),
    ]


def _first_rank(flags: Column) -> Column:
    """1 / rank of the first true flag, else 0."""
    at = F.array_position(flags, True)
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def _average_precision(gains: Column, known: Column) -> Column:
    """Sum over ranks with a gain of (gains so far / rank), over how many are known."""
    total = F.aggregate(
        F.transform(gains, lambda g, i: F.struct(g.alias("g"), (i + 1).alias("rank"))),
        F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s")),
        lambda a, x: F.when(x["g"], F.struct((a["n"] + 1).alias("n"), (a["s"] + (a["n"] + 1) / x["rank"]).alias("s"))).otherwise(a),
        lambda a: a["s"],
    )
    return F.coalesce(F.try_divide(total, known.cast("double")), F.lit(0.0))


def _new(found: Column) -> Column:
    """Which elements are there for the first time; nulls never are."""
    return F.transform(found, lambda x, i: x.isNotNull() & ~F.coalesce(F.array_contains(F.slice(found, 1, i), x), F.lit(False)))


def set_metrics(ranked: Column, known: Column, suffix: str = "", cuts=CUTS, size: Column | None = None) -> list[Column]:
    """Exact-match metrics of an ordered array against a set; repeated predictions count as returned once each.

    Of a set that is too large to carry, ``known`` need hold no more than what is ranked, if ``size`` is the whole set's.
    """
    out: list[Column] = []
    n = F.size(known) if size is None else size
    for k in cuts:
        top = F.slice(ranked, 1, k)
        out += _at(F.size(F.array_intersect(top, known)), F.size(top), n, k, suffix)
    inside = F.transform(ranked, lambda x: F.array_contains(known, x))
    gains = F.zip_with(_new(ranked), inside, lambda a, b: a & b)
    return [*out, _first_rank(inside).alias(f"mrr{suffix}"), _average_precision(gains, n).alias(f"map{suffix}")]


def file_keys(items: Column) -> Column:
    """Distinct file keys in order of their first item."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: filled(stem(x["file"]))), lambda x: x.isNotNull()))


def instance_metrics(df: DataFrame, predicted: str = "predicted", known: str = "known", cuts=CUTS) -> DataFrame:
    """Fuzzy metrics of function lists, arrays of (file, sig), plus file-level ones.

    At a cut, predictions take known functions one to one in rank order. For the reciprocal rank and the mean
    precision each prediction counts alone for the first known function that it matches.
    """
    keys = [c for c in df.columns if c not in (predicted, known)]
    p = F.coalesce(F.col(predicted), F.array().cast("array<struct<file:string,sig:string>>"))
    g = F.coalesce(F.col(known), F.array().cast("array<struct<file:string,sig:string>>"))
    forms = lambda c: F.transform(c, lambda x: match_keys(x["file"], x["sig"]))  # noqa: E731  once an item, not once a pair
    matches = let(forms(g), lambda ys: F.transform(forms(p), lambda x: F.filter(F.transform(ys, lambda y, i: F.when(same_keys(x, y), i)), lambda i: i.isNotNull())))
    m = df.select(*keys, matches.alias("matches_"), F.size(p).alias("returned_"), F.size(g).alias("known_"), file_keys(p).alias("files_"), file_keys(g).alias("gt_files_"))

    def taken(rows: Column) -> Column:
        step = lambda a, c: F.concat(a, F.slice(F.array_except(c, a), 1, 1))
        return F.size(F.aggregate(rows, F.array().cast("array<int>"), step))

    n = F.col("known_")
    out: list[Column] = []
    for k in cuts:
        out += _at(taken(F.slice("matches_", 1, k)), F.least(F.col("returned_"), F.lit(k)), n, k, "")
    firsts = F.transform("matches_", lambda c: F.get(c, F.lit(0)))
    alone = let(firsts, lambda f: _average_precision(_new(f), n))
    out += [_first_rank(F.transform("matches_", lambda c: F.size(c) > 0)).alias("mrr"), alone.alias("map")]
    none = lambda c: F.when(n > 0, c).otherwise(0.0)
    names = [f"{x}_file_{k}" for k in cuts for x in ("hit", "precision", "recall", "f1", "iou", "subset_acc")] + ["mrr_file", "map_file"]
    files = [none(c).alias(a) for c, a in zip(set_metrics(F.col("files_"), F.col("gt_files_"), "_file", cuts), names, strict=True)]
    return m.select(*keys, *out, *files)


def loose_metrics(df: DataFrame, predicted: str = "predicted", known: str = "known", cuts=CUTS) -> DataFrame:
    """Exact metrics of (file_stem, name) pairs, by name, by file and by both."""
    keys = [c for c in df.columns if c not in (predicted, known)]
    p, g = F.col(predicted), F.col(known)
    some = lambda c: c.isNotNull() & (c != "")
    name = lambda a: F.transform(a, lambda x: x["name"])
    file = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: x["file_stem"]), some))
    both = lambda a, strict: F.transform(F.filter(a, lambda x: some(x["file_stem"]) & (some(x["name"]) | F.lit(not strict))), lambda x: F.concat_ws("\x01", x["file_stem"], x["name"]))
    m = df.select(*keys, name(p).alias("pn_"), F.array_distinct(F.filter(name(g), some)).alias("gn_"), file(p).alias("pf_"), file(g).alias("gf_"), both(p, False).alias("pt_"), F.array_distinct(both(g, True)).alias("gt_"))
    return m.select(*keys, *set_metrics(F.col("pn_"), F.col("gn_"), "", cuts), *set_metrics(F.col("pf_"), F.col("gf_"), "_file", cuts), *set_metrics(F.col("pt_"), F.col("gt_"), "_tuple", cuts))


def classifier_metrics(predicted: Column, known: Column, suffix: str = "") -> list[Column]:
    """Precision, recall, F1, IoU and exact equality of two sets."""
    p, g = F.array_distinct(predicted), F.array_distinct(known)
    n = F.size(F.array_intersect(p, g)).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    pr, rc = zero(F.try_divide(n, F.size(p).cast("double"))), zero(F.try_divide(n, F.size(g).cast("double")))
    return [
        pr.alias(f"precision{suffix}"),
        rc.alias(f"recall{suffix}"),
        zero(F.try_divide(2 * pr * rc, pr + rc)).alias(f"f1{suffix}"),
        zero(F.try_divide(n, F.size(F.array_union(p, g)).cast("double"))).alias(f"iou{suffix}"),
        F.when((F.size(g) > 0) & (F.size(p) == F.size(g)) & (n == F.size(g)), 1.0).otherwise(0.0).alias(f"subset_acc{suffix}"),
    ]


def mean_by(df: DataFrame, keys: list[str], metrics: list[str], count: str | None = None) -> DataFrame:
    means = [F.avg(m).alias(m) for m in metrics]
    return df.groupBy(*keys).agg(*means, *([F.count("*").alias(count)] if count else []))


def overall(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Mean over keys of the means over their instances."""
    return mean_by(mean_by(df, [key], metrics), [], metrics)


def by_class(per_key: DataFrame, classes: DataFrame, key: str, name: str, metrics: list[str]) -> DataFrame:
    """Means over the keys of each class; keys without one are 'unknown', keys with several count in each."""
    met = per_key.join(classes.select(key, name), key, "left").withColumn(name, F.coalesce(F.col(name), F.lit("unknown")))
    return mean_by(met, [name], metrics, "n_keys")


def macro(per_class: DataFrame, metrics: list[str]) -> DataFrame:
    return mean_by(per_class, [], metrics)


def attach_truth(predictions: DataFrame, truth: DataFrame, keys: list[str], known: str = "known") -> DataFrame:
    """Each prediction with its ground truth, an empty array where there is none; of repeated truth keys the last counts."""
    last = Window.partitionBy(*keys).orderBy(F.col("pos").desc())
    one = truth.withColumn("rn_", F.row_number().over(last)).where("rn_ = 1").select(*keys, known)
    return predictions.join(one, keys, "left").withColumn(known, F.coalesce(F.col(known), F.array()))


def _average_rank(df: DataFrame, c: str) -> DataFrame:
    """Ranks with ties averaged, from counts of distinct values."""
    ranks = counts_before(df, c).select(F.col("value").alias("v_"), (F.col("skip") + (F.col("n") + 1) / 2).alias(f"{c}_rank"))
    return df.join(ranks, df[c] == ranks["v_"]).drop("v_")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns and their mean difference."""
    ranked = reduce(_average_rank, (a, b), df.where(F.col(a).isNotNull() & F.col(b).isNotNull()))
    return ranked.agg(F.count("*").alias("n"), F.corr(f"{a}_rank", f"{b}_rank").alias("rho"), F.avg(F.col(a) - F.col(b)).alias("mean_gap"))
