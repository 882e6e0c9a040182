"""Quality rules: a learned decision list of threshold conjunctions, applied as ordered Spark conditional expressions.

Words are runs of characters other than space and \\x09-\\x0D. All measures of a text are computed inside its own
row by built-in functions, so the pass over the documents has no shuffle and no Python.

Defined results: a null text has no words, no lines with a word and no symbols, and fails the base rules; an empty
text likewise. Repeated rows are judged alike, each on its own. A label row with a null id or a null label is
ignored; the lowest label counts where a document has several. Without any usable label the list is empty and the
base rules alone decide. Extra columns are kept unless they are named as one of the columns added here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, fresh, let

#: Labelled rows that the list is learned from, at most: those with the smallest hash of doc_id.
TRAIN_ROWS = 20_000
#: Quantiles of either class whose values are candidate thresholds.
QUANTILES = [0.001, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97, 0.99, 0.999]
SYMBOLS = "[#*$%&|<>]"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbol_share", "repeat_share", "dup_line_share", "upper_share", "digit_share", "mark_share", "mean_word"]


def _repeated(words: Column) -> Column:
    """Words inside a 3-word window that the text has at least twice."""

    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"]))
            starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return F.aggregate(
                starts,
                F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
                lambda a: a["n"],
            )

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, of_sorted))

    def of_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, of_hashes))

    return let(words, of_words)


def _raw(t: Column) -> Column:
    words = F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE))
    return F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).cast("long").alias("repeated"))).alias("w"),
        F.length(F.regexp_replace(t, f"{SPACE}+", "")).cast("long").alias("chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        F.regexp_count(t, F.lit("[A-Z]")).alias("upper"),
        F.regexp_count(t, F.lit("[0-9]")).alias("digits"),
        F.regexp_count(t, F.lit("[!?|]")).alias("marks"),
    )


def measured(text: Column) -> Column:
    """A struct of the base measures (long) and the shares that rules test (double)."""

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def named(r: Column) -> Column:
        values = [
            *(r["w"]["n"], r["chars"], r["symbols"], r["l"]["dup"], r["w"]["repeated"]),
            *(share(r["symbols"], r["chars"]), share(r["w"]["repeated"], r["w"]["n"]), share(r["l"]["dup"], r["l"]["n"])),
            *(share(r["upper"], r["chars"]), share(r["digits"], r["chars"]), share(r["marks"], r["chars"]), share(r["chars"], r["w"]["n"])),
        ]
        return F.struct(*[v.alias(name) for v, name in zip(values, BASE + FEATURES, strict=True)])

    return let(_raw(F.coalesce(text, F.lit(""))), named)


def _spread(docs: DataFrame, struct: Column, names: list[str]) -> DataFrame:
    kept = [c for c in docs.columns if c not in names]
    m = fresh(docs, "m")
    return docs.select(*kept, struct.alias(m)).select(*kept, *[F.col(f"{m}.{n}").alias(n) for n in names])


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all measures of a text, in one pass."""
    return _spread(docs, measured(F.col(text)), BASE + FEATURES)


@dataclass(frozen=True)
class Rule:
    """Rejects a text that meets every (feature, above, threshold)."""

    conditions: tuple[tuple[str, bool, float], ...]
    good: int = 0
    bad: int = 0

    def column(self, of: Callable[[str], Column] = F.col) -> Column:
        out = F.lit(True)
        for name, above, at in self.conditions:
            out = out & (of(name) > at if above else of(name) <= at)
        return out


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def verdict(self, of: Callable[[str], Column] = F.col) -> Column:
        """The number of the first rule met, from 1; 0 where none is."""
        out = None
        for i, r in enumerate(self.rules, 1):
            out = F.when(r.column(of), F.lit(i)) if out is None else out.when(r.column(of), F.lit(i))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))


def _base_failed(of: Callable[[str], Column] = F.col) -> Column:
    return (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words"))


def statistics(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[tuple], dict[str, list[float]]]:
    """Counts of good and bad labelled texts by cell of the threshold grid, halved into a growing and a pruning part.

    At most ``train_rows`` labelled documents take part, so at most as many cells reach the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(some), "doc_id")
    # kept before it is filtered: a filter on measures would be moved below the join and judge every document
    kept = measures(texts).select("doc_id", "quality", "n_words", "n_repeat_words", *FEATURES).persist()
    m = kept.where(~_base_failed()).withColumn("grow", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(3)) > 0)
    try:
        q = m.groupBy((F.col("quality") > 0).alias("good")).agg(*[F.percentile_approx(c, QUANTILES, 10_000).alias(c) for c in FEATURES]).collect()
        grid = {c: sorted({round(float(v), 4) for r in q for v in (r[c] or [])}) for c in FEATURES}
        cells = [sum((F.when(F.col(c) > t, 1).otherwise(0) for t in grid[c]), F.lit(0)).alias(c) for c in FEATURES]
        n = lambda good, grow: F.sum(F.when((F.col("quality") > 0).eqNullSafe(F.lit(good)) & (F.col("grow") == F.lit(grow)), 1).otherwise(0))
        counted = m.select(*cells, "quality", "grow").groupBy(*FEATURES).agg(n(True, True), n(False, True), n(True, False), n(False, False))
        return sorted(tuple(r) for r in counted.collect()), grid
    finally:
        kept.unpersist()


def learn(cells: list[tuple], grid: dict[str, list[float]], max_rules: int = 12, max_conditions: int = 3, precision: float = 0.97, support: int = 5) -> DecisionList:
    """Sequential covering over counted cells: grow by information gain, prune from the end, keep precise rules."""
    import math

    width = len(FEATURES)
    left = list(cells)
    rules: list[Rule] = []

    def covers(cell: tuple, conditions) -> bool:
        return all((cell[f] > k) == above for f, above, k in conditions)

    def count(rows, conditions, at: int) -> tuple[int, int]:
        met = [c for c in rows if covers(c, conditions)]
        return sum(c[width + at] for c in met), sum(c[width + at + 1] for c in met)

    while len(rules) < max_rules:
        grown: list[tuple[int, bool, int]] = []
        at: dict[tuple, float] = {}
        rows = left
        for _ in range(max_conditions):
            good, bad = sum(c[width] for c in rows), sum(c[width + 1] for c in rows)
            if not bad or not good and grown:
                break
            was = math.log2(bad / (bad + good))
            best = None
            for f, name in enumerate(FEATURES):
                size = len(grid[name]) + 1
                by_good, by_bad = [0] * size, [0] * size
                for c in rows:
                    by_good[c[f]] += c[width]
                    by_bad[c[f]] += c[width + 1]
                low_good = low_bad = 0
                for k in range(size - 1):
                    low_good, low_bad = low_good + by_good[k], low_bad + by_bad[k]
                    for above, g, b in ((True, good - low_good, bad - low_bad), (False, low_good, low_bad)):
                        if b:
                            gain = b * (math.log2(b / (b + g)) - was)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, (f, above, k), k)
                            elif best and best[1][:2] == (f, above) and abs(gain - best[0]) <= 1e-9:
                                best = (*best[:2], k)
            if best is None:
                break
            grown.append(best[1])
            # Thresholds that cover the same cells are one choice: the middle leaves a margin on both sides.
            steps = grid[FEATURES[best[1][0]]]
            at[best[1]] = round((steps[best[1][2]] + steps[best[2]]) / 2, 4)
            rows = [c for c in rows if covers(c, grown[-1:])]
        if not grown:
            break

        def worth(conditions) -> float:
            g, b = count(left, conditions, 2)
            return (b - g) / (b + g) if b + g else -1.0

        tries = [grown[:k] for k in range(1, len(grown) + 1)]
        pruned = max(tries, key=lambda c: (worth(c), -len(c)))
        good, bad = (x + y for x, y in zip(count(left, pruned, 0), count(left, pruned, 2), strict=True))
        if bad < support or bad < precision * (good + bad):
            pruned = grown
            good, bad = (x + y for x, y in zip(count(left, pruned, 0), count(left, pruned, 2), strict=True))
            if bad < support or bad < precision * (good + bad):
                break
        rules.append(Rule(tuple((FEATURES[c[0]], c[1], at[c]) for c in pruned), good, bad))
        left = [c for c in left if not covers(c, pruned)]
    return DecisionList(rules)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DecisionList:
    return learn(*statistics(docs, labels, train_rows))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``docs`` with measures, base_failed, rule (number of the first rule met, else 0) and kept.

    The verdict is inside one expression, so that a filter on it measures each text once.
    """

    def verdict(m: Column) -> Column:
        of = lambda name: m[name]
        failed, rule = _base_failed(of), rules.verdict(of)
        return F.struct(*[m[c].alias(c) for c in BASE + FEATURES], failed.alias("base_failed"), rule.alias("rule"), (~failed & (rule == 0)).alias("kept"))

    return _spread(docs, let(measured(F.col("text")), verdict), [*BASE, *FEATURES, "base_failed", "rule", "kept"])


def quality_rules(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Learn the list from ``labels`` (doc_id, quality) and judge every row of ``docs`` (doc_id, text)."""
    return judge(docs, fit(docs, labels, train_rows))
