"""Line dedup: repeated long lines stay only in the largest document that holds them.

Line hashes are range-partitioned and sorted by hash, document (largest first) and position, so each run of one key
is streamed once; its first row names the keeper. What an operator returns are run-length compressed keep bitmaps
per document, not text: ``apply_bitmaps`` turns them into text where that is wanted.

A key's rows are spread over slices by document, so a key that holds a third of all lines still falls into many range
partitions; slices meet again as one counted row each, and lines find their keeper slice by slice. There are ``SLICES``
slices, or as many as keep about ``SLICE_LINES`` of all lines in each. Keys are compared by two 64-bit hashes.

Defined results: a null or empty text is one empty line. Rows with the same doc_id count as one document; each
row's own lines are judged by its own positions. A null doc_id counts as one document, smaller than every other.
Ties: a key's largest doc_id keeps all its lines with that key. Very long texts are split whole, in the row that holds
them. An empty table gives no rows. Extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, let, materialise

MIN_CHARS = 40
MIN_DOCS = 5
#: A key's lines are dealt to so many slices by document, at least.
SLICES = 64
SLICE_LINES = 1_000_000
#: Characters that a key loses at both ends.
EDGE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Stripped at both ends, A-Z lower-cased; other letters keep their case."""
    trimmed = F.trim(line, F.lit(EDGE))
    return F.when(F.octet_length(trimmed) == F.length(trimmed), F.lower(trimmed)).otherwise(F.translate(trimmed, UPPER, LOWER))


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each long line: row (a digest of the text), doc_id, pos, and the key's hashes h1, h2."""
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = docs.select("doc_id", F.xxhash64(text).alias("row"), F.split(text, "\n").alias("lines"))
    rows = whole.select("doc_id", "row", F.posexplode("lines").alias("pos", "line"))
    keyed = rows.where(F.length("line") >= min_chars).select("doc_id", "row", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def slice_of(slices: int) -> Column:
    return F.pmod(F.hash("doc_id"), F.lit(slices))


def repeated_keys(lines: DataFrame, min_docs: int = MIN_DOCS, slices: int = SLICES) -> DataFrame:
    """Slices of the keys of at least ``min_docs`` documents, with the key's keeper: h1, h2, slice, keeper."""
    sliced = lines.select("h1", "h2", slice_of(slices).alias("slice"), "doc_id", "pos")
    ranged = sliced.repartitionByRange("h1", "h2", "slice")
    run = Window.partitionBy("h1", "h2", "slice").orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    again = (F.row_number().over(run) > 1) & F.col("doc_id").eqNullSafe(F.lag("doc_id").over(run))
    streamed = ranged.select("h1", "h2", "slice", "doc_id", (~again).cast("long").alias("first_of_doc"))
    by_slice = streamed.groupBy("h1", "h2", "slice").agg(F.sum("first_of_doc").alias("n"), F.max("doc_id").alias("top"))
    # a key has at most as many rows here as there are slices
    whole = by_slice.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("keeper"), F.collect_list("slice").alias("slices"))
    return whole.where(F.col("n") >= min_docs).select("h1", "h2", F.explode("slices").alias("slice"), "keeper")


def drop_runs(positions: Column) -> Column:
    """Sorted positions as runs: the compressed form of a keep bitmap, (start, length) of each run of dropped lines."""

    def runs(p: Column) -> Column:
        starts = F.filter(p, lambda x, i: ~(x - 1).eqNullSafe(F.get(p, i - 1)))
        ends = F.filter(p, lambda x, i: ~(x + 1).eqNullSafe(F.get(p, i + 1)))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))

    return let(positions, runs)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, row (xxhash64 of the text), drops array<struct<start,length>> for each document that loses lines."""
    lines = materialise(lines_of(docs, min_chars), "line_hashes")  # sampled for ranges, counted and joined: texts are split once
    slices = max(SLICES, lines.count() // SLICE_LINES)  # counted from the table's footers
    keys = materialise(repeated_keys(lines, min_docs, slices), "line_keys")
    lost = lines.withColumn("slice", slice_of(slices)).join(keys, ["h1", "h2", "slice"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "row").agg(drop_runs(F.sort_array(F.collect_set("pos"))).alias("drops"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text; each row of ``docs`` comes back once."""
    doc, row, drops = (fresh(docs, x) for x in ("b_doc", "b_row", "b_drops"))
    b = bitmaps.select(F.col("doc_id").alias(doc), F.col("row").alias(row), F.col("drops").alias(drops))
    text = F.coalesce(docs["text"], F.lit(""))
    joined = docs.join(b, docs["doc_id"].eqNullSafe(b[doc]) & (F.xxhash64(text) == b[row]), "left")
    text = F.coalesce(F.col("text"), F.lit(""))

    def kept(lines: Column) -> Column:
        def between(d: Column) -> Column:
            edge = lambda i: F.coalesce(F.get(d, i - 1)["start"] + F.get(d, i - 1)["length"], F.lit(0))
            parts = F.transform(d, lambda x, i: F.slice(lines, edge(i) + 1, x["start"] - edge(i)))
            rest = F.slice(lines, edge(F.size(d)) + 1, F.size(lines) - edge(F.size(d)))
            return F.flatten(F.concat(parts, F.array(rest)))

        return let(F.col(drops), between)

    split = F.split(text, "\n")
    out = {
        "n_lines": F.size(split).cast("long"),
        "n_dropped": F.coalesce(F.aggregate(drops, F.lit(0), lambda a, r: a + r["length"]), F.lit(0)).cast("long"),
        "kept_text": F.when(F.col(drops).isNull(), text).otherwise(F.array_join(let(split, kept), "\n")),
    }
    return joined.select(*[c for c in docs.columns if c not in out], *[v.alias(k) for k, v in out.items()])


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
