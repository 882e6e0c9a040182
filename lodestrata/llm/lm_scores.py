"""LM scoring: stupid-backoff scores of whole documents from n-gram counts of all documents, computed relationally.

Words are runs without space and \\x09-\\x0D. A word's score after the word before it is c(v w) / c(v) where the pair
occurs at least ``MIN_PAIRS`` times in the corpus, else ``ALPHA`` c(w) / N; a text's first word has c(w) / N. The
document's score is the sum of natural logarithms.

Documents are dealt to batches of about ``BATCH_CHARS`` characters by a hash. Their n-grams are exploded into rows and
counted within their batch, which is the partial sum before the exchange and the salt of frequent n-grams: one has at
most a row for each batch. These rows are partitioned by n-gram hash, where the counts of all batches are summed; counts
of one are implied and go no further. The counts that a batch has n-grams for are partitioned by batch, where its
exploded n-grams already are, so that the join to them moves no n-gram, and sums by document stay in the task. Rows
exchanged grow with the corpus: the texts twice, and distinct n-grams of batches, twice at most.

Counts of pairs are kept as a table before they are joined, and what a job has exchanged goes when it ends, so that the
pairs of batches and the counts that return to them are never on disk together. Texts are dealt anew for each of the two
jobs, so ``docs`` has to give the same rows each time that it is read.

Defined results: a null, empty or blank text has no words, score 0.0 and mean score null. Repeated rows, rows that share
a doc_id and rows with a null one count and are scored each. There are no ties to break: sums do not depend on order but
for the last digits of a double. A very long text is one row of its batch. An empty table gives no rows. N-grams are told
apart by 64-bit hashes. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, materialise

ALPHA = 0.4
MIN_PAIRS = 2
#: Characters of text in a batch, about.
BATCH_CHARS = 36_000_000


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """For what runs inside: tables partitioned by some of the join's keys are joined without another exchange, and
    files of an exchange are deleted when the job ends."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _totals(each: DataFrame, key: str, least: int, n_tables: int) -> DataFrame:
    """batch, ``key`` and total: the corpus' counts, from ``least`` on, of the n-grams that each batch has."""
    counted = each.groupBy("batch", key).agg(F.count("*").alias("n")).repartition(n_tables, key)
    totals = counted.withColumn("total", F.sum("n").over(Window.partitionBy(key))).where(F.col("total") >= least)
    return totals.select("batch", key, "total")


def lm_scores(docs: DataFrame, alpha: float = ALPHA, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """doc_id, n_words, n_backoff, log_score and mean_log_score of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    with _settings(spark):
        return _scores(spark, docs, alpha, min_pairs)


def _scores(spark: SparkSession, docs: DataFrame, alpha: float, min_pairs: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_batches = max(spark.sparkContext.defaultParallelism, (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // BATCH_CHARS + 1)
    n_tables = max(n_batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the id stands before its text in one column, and rows without words are no filter, so that all uses of the dealt
    # texts in a job are one exchange
    line = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), "text").alias("line")
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches)).cast("int").alias("batch")
    dealt = rows.select(batch, line).repartitionById(n_batches, "batch")
    # of a blank text, one empty word
    words = F.split(F.btrim(F.expr("substr(line, instr(line, '\n') + 1)"), F.lit(" \t\n\x0b\f\r")), f"{SPACE}+").alias("words")

    befores, afters = F.slice("words", 1, F.size("words") - 1).alias("v"), F.slice("words", 2, F.size("words")).alias("w")
    pairs = dealt.select("batch", words).select("batch", F.inline(F.arrays_zip(befores, afters)))
    twos = materialise(_totals(pairs.select("batch", F.xxhash64("v", "w").alias("h")), "h", min_pairs, n_tables), "lm_pairs")
    twos = twos.withColumnRenamed("total", "both").repartitionById(n_batches, "batch")
    ones = dealt.select("batch", F.explode(words).alias("w")).where("w <> ''")
    ones = _totals(ones.select("batch", F.xxhash64("w").alias("u")), "u", 2, n_tables).repartitionById(n_batches, "batch")

    # each word w with the one before it, v, which is null for the first; a row behind the last word has no w
    numbered = dealt.select("batch", F.monotonically_increasing_id().alias("row"), F.substring_index("line", "\n", 1).try_cast("long").alias("doc_id"), words)
    grams = numbered.select("batch", "row", "doc_id", F.inline(F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), "words").alias("v"), F.col("words").alias("w"))))
    is_word, is_pair = F.coalesce(F.col("w") != "", F.lit(False)), F.col("v").isNotNull() & F.col("w").isNotNull()
    grams = grams.select("batch", "row", "doc_id", is_word.alias("is_word"), is_pair.alias("is_pair"), F.xxhash64("v", "w").alias("h"), F.xxhash64("v").alias("hv"), F.xxhash64("w").alias("hw"))
    met = grams.join(twos.hint("shuffle_hash"), ["batch", "h"], "left")
    seen = F.col("both").isNotNull() & F.col("is_pair")
    met = met.select("batch", "row", "doc_id", "is_word", "is_pair", F.when(seen, F.col("both")).alias("both"), F.when(seen, F.col("hv")).otherwise(F.col("hw")).alias("u"))
    met = met.join(ones.hint("shuffle_hash"), ["batch", "u"], "left")
    one = F.log(F.coalesce(F.col("total"), F.lit(1)).cast("double"))
    part = F.when(F.col("both").isNotNull(), F.log(F.col("both").cast("double")) - one).when(F.col("is_pair"), F.log(F.lit(float(alpha))) + one).otherwise(one)
    summed = met.groupBy("batch", "row", "doc_id").agg(
        F.count_if("is_word").alias("n_words"),
        F.count_if(F.col("is_pair") & F.col("both").isNull()).alias("n_backoff"),
        F.coalesce(F.sum(F.when(F.col("is_word"), part)), F.lit(0.0)).alias("part"),
    )
    summed = materialise(summed.select("doc_id", "n_words", "n_backoff", "part"), "lm_scores")
    # ln N is taken off once for the first word and once for each that backs off
    n_words = max(summed.agg(F.sum("n_words")).first()[0] or 0, 1)
    log_score = F.col("part") - (F.col("n_backoff") + (F.col("n_words") > 0).cast("long")) * F.log(F.lit(float(n_words)))
    out = summed.select("doc_id", "n_words", "n_backoff", log_score.alias("log_score"))
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
