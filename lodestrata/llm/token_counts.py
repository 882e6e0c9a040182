"""Token counts that follow edits: a segment tree of pre-tokens per document, kept as a table.

A document's pre-tokens (a run of white space with the run of other characters behind it; the tokenizer's own pre-tokens
never cross their borders) are cut into leaves of ``LEAF``; a tree above them sums characters and tokens. ``build_trees``
makes the trees: a row for each document with its text and the sums as two arrays in heap order, to be written and kept.
``apply_edits`` reads them and returns them edited: an edit descends to the leaf of the character before it and to the
leaf of its last character, and takes in what follows as far as no pre-token ends at the next leaf's begin. Only leaves
that edits touched are encoded again, and their sums are carried up. Insertions that are long for their leaf become
leaves of their own; sums above are added up anew, the other leaves' counts stay.

Border characters decide by themselves (``byte_bpe.BORDER``), so one character of context on either side is enough. A
text without white space or ideographic stops is one pre-token and one leaf; a very long text is a row of its own length.

Defined results: a null text is an empty one with no tokens. Edits apply in order, each to the text that the one before
left; a start beyond the text is its end, a length beyond it reaches its end, negative numbers are 0, a null insertion
is empty; edits with equal seq are ordered by start, length and insertion. Rows are independent, repeated ones alike, and
rows that share a doc_id all take its edits; edits whose doc_id no document has are not used; a null doc_id has no edits.
An empty table gives no rows. Extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe, chunks, load
from .common import fresh, ship, small_batches

LEAF = 32


def _heap(leaves: np.ndarray) -> np.ndarray:
    """Sums over leaves in heap order: the root at 1, node i over 2 i and 2 i + 1, leaves from the half on."""
    size = 1 << max(len(leaves) - 1, 0).bit_length()
    out = np.zeros(2 * size, np.int64)
    out[size : size + len(leaves)] = leaves
    while size > 1:
        half = size // 2
        out[half:size] = out[size : 2 * size].reshape(-1, 2).sum(1)
        size = half
    return out


class Tree:
    """A document's text and sums; ``touched`` holds leaves whose tokens are not counted yet."""

    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        self.text, self.chars, self.tokens, self.size = text, chars, tokens, len(chars) // 2
        self.touched: set[int] = set()

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one with text, beyond the end) and where it begins."""
        node, begin = 1, 0
        at = min(at, max(self.chars[1] - 1, 0))
        while node < self.size:
            node *= 2
            if at - begin >= self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.size, begin

    def put(self, sums: list[int], leaf: int, value: int) -> None:
        node = leaf + self.size
        change = value - sums[node]
        while node and change:
            sums[node] += change
            node //= 2

    def begin(self, leaf: int) -> int:
        """Characters before a leaf."""
        node, n = leaf + self.size, 0
        while node > 1:
            if node & 1:
                n += self.chars[node - 1]
            node //= 2
        return n

    def edit(self, start: int, length: int, insert: str, bpe: ByteBpe) -> None:
        start = min(max(start, 0), len(self.text))
        end = min(start + max(length, 0), len(self.text))
        first, begin = self.find(max(start - 1, 0))
        last, last_begin = self.find(max(end - 1, start - 1, 0))
        stop = last_begin + self.chars[self.size + last]
        self.text = self.text[:start] + insert + self.text[end:]
        stop += len(insert) - (end - start)
        # leaves behind are taken in as far as no pre-token ends where they begin
        while stop < len(self.text) and not (stop > begin and bpe.border(self.text[stop - 1], self.text[stop])):
            last += 1
            stop += self.chars[self.size + last]
        pieces = bpe.cut(self.text[begin:stop])
        if len(pieces) > 4 * LEAF * (last - first + 1):
            self.spread(first, last, [sum(map(len, pieces[i : i + LEAF])) for i in range(0, len(pieces), LEAF)])
            return
        self.put(self.chars, first, stop - begin)
        self.touched.add(first)
        for leaf in range(first + 1, last + 1):
            self.put(self.chars, leaf, 0)
            self.put(self.tokens, leaf, 0)
            self.touched.discard(leaf)

    def spread(self, first: int, last: int, sizes: list[int]) -> None:
        """New leaves of ``sizes`` characters in place of leaves first to last; others keep their counts."""
        moved = len(sizes) - (last - first + 1)
        chars, tokens = self.chars[self.size :], self.tokens[self.size :]
        self.touched = {i if i < first else i + moved for i in self.touched if not first <= i <= last} | set(range(first, first + len(sizes)))
        self.chars = _heap(np.array([*chars[:first], *sizes, *chars[last + 1 :]])).tolist()
        self.tokens = _heap(np.array([*tokens[:first], *[0] * len(sizes), *tokens[last + 1 :]])).tolist()
        self.size = len(self.chars) // 2


def grow(texts: pa.Array, bpe: ByteBpe) -> list[tuple[str, list[int], list[int], int]]:
    """Text, sums of characters, sums of tokens and number of pre-tokens of each text."""
    out = []
    for chunk in chunks(pc.fill_null(texts, "")):
        slots, sizes = bpe.segment_slots(chunk)
        ends = np.cumsum(sizes)
        leaves = -(-sizes // LEAF)
        at = np.repeat(ends - sizes - LEAF * (np.cumsum(leaves) - leaves), leaves) + LEAF * np.arange(int(leaves.sum()))
        chars, tokens = np.add.reduceat(bpe.chars[slots].astype(np.int64), at), np.add.reduceat(bpe.count[slots].astype(np.int64), at)
        to = 0
        for text, n, m in zip(chunk.to_pylist(), leaves.tolist(), sizes.tolist(), strict=True):
            begin, to = to, to + n
            out.append((text, _heap(chars[begin:to]).tolist(), _heap(tokens[begin:to]).tolist(), m))
        bpe.trim()
    return out


def recount(trees: list[Tree], bpe: ByteBpe) -> list[int]:
    """Counts the touched leaves of all trees and carries their tokens up; returns pre-tokens encoded again by tree."""
    where, texts = [], []
    for i, t in enumerate(trees):
        for leaf in sorted(t.touched):
            begin = t.begin(leaf)
            where.append((i, leaf))
            texts.append(t.text[begin : begin + t.chars[t.size + leaf]])
        t.touched = set()
    again, k = [0] * len(trees), 0
    for chunk in chunks(pa.array(texts, pa.string())):
        slots, sizes = bpe.segment_slots(chunk)
        total = np.concatenate([[0], np.cumsum(bpe.count[slots], dtype=np.int64)])
        ends = np.cumsum(sizes)
        for tokens, n in zip((total[ends] - total[ends - sizes]).tolist(), sizes.tolist(), strict=True):
            i, leaf = where[k]
            trees[i].put(trees[i].tokens, leaf, tokens)
            again[i] += n
            k += 1
        bpe.trim()
    return again


_TREE = pa.schema([("text", pa.string()), ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32())), ("n_pretokens", pa.int64())])
_TREE_TYPE = "doc_id long, text string, chars array<int>, tokens array<int>, n_pretokens long"
_EDITS = "array<struct<start:long,length:long,insert:string>>"


def _build(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            columns = list(zip(*grow(batch.column(1), bpe), strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, _TREE, strict=True))], names=["doc_id", *_TREE.names])

    return run


def build_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text, chars, tokens, n_pretokens: the tree of each row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_build(tokenizer), _TREE_TYPE)


def _edit(path: str, with_trees: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            doc_id, text, chars, tokens, pretokens, edits = batch.columns
            trees = [Tree(*x) for x in zip(text.to_pylist(), chars.to_pylist(), tokens.to_pylist(), strict=True)]
            before = [t.tokens[1] for t in trees]
            for t, todo in zip(trees, edits.to_pylist(), strict=True):
                for e in todo or ():
                    if e:
                        t.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "", bpe)
            again = recount(trees, bpe)
            columns = {"doc_id": doc_id}
            if with_trees:
                columns |= {"text": pa.array([t.text for t in trees], pa.string())}
                columns |= {k: pa.array([getattr(t, k) for t in trees], pa.list_(pa.int32())) for k in ("chars", "tokens")}
            columns |= {"n_tokens": before, "edited_tokens": [t.tokens[1] for t in trees], "edited_chars": [t.chars[1] for t in trees], "n_pretokens": pretokens, "n_reencoded": again}
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for v in columns.values()], names=list(columns))

    return run


_COUNTS = "n_tokens long, edited_tokens long, edited_chars long, n_pretokens long, n_reencoded long"


def apply_edits(trees: DataFrame, tokenizer: str, edits: Column, with_trees: bool = True) -> DataFrame:
    """Trees after ``edits``, an array<struct<start,length,insert>> column of ``trees``, with token counts before and after.

    Without ``with_trees`` only doc_id and the counts come back.
    """
    ship(trees.sparkSession)
    rows = trees.select("doc_id", "text", "chars", "tokens", "n_pretokens", edits.cast(_EDITS).alias("edits"))
    kept = "text string, chars array<int>, tokens array<int>, " if with_trees else ""
    return rows.mapInArrow(_edit(tokenizer, with_trees), f"doc_id long, {kept}{_COUNTS}")


def edit_lists(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with a column ``edits`` from a table (doc_id, seq, start, length, insert), in order of seq."""
    doc = fresh(trees, "edited_doc")
    e = F.struct("seq", "start", "length", "insert")
    by_doc = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias(doc)).agg(F.sort_array(F.collect_list(e)).alias("edits"))
    by_doc = by_doc.select(doc, F.transform("edits", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["insert"].alias("insert"))).alias("edits"))
    return trees.join(by_doc, trees["doc_id"] == by_doc[doc], "left").drop(doc)


def token_counts(docs: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and token counts of ``docs`` before and after a table of edits, by trees that are not kept."""
    met = edit_lists(build_trees(docs, tokenizer), edits)
    return apply_edits(met, tokenizer, F.col("edits"), with_trees=False)


def standard_edits(text: Column) -> Column:
    """Three edits for any text: a deletion at a third, an insertion of its own first words at a half, a replacement at two thirds."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t).cast("long")
    one = lambda start, length, insert: F.struct(start.alias("start"), F.lit(length).cast("long").alias("length"), insert.alias("insert"))
    return F.array(one(F.floor(n / 3), 7, F.lit("")), one(F.floor(n / 2), 0, F.substring(t, 1, 24)), one(F.floor(2 * n / 3), 5, F.lit(" edited, ")))


def edited_counts(docs: DataFrame, tokenizer: str, keep) -> DataFrame:
    """The trees of ``docs``, kept by ``keep`` (DataFrame -> DataFrame), then the counts before and after ``standard_edits``."""
    with small_batches(docs.sparkSession):
        trees = keep(build_trees(docs, tokenizer))
    return apply_edits(trees, tokenizer, standard_edits(F.col("text")), with_trees=False)
