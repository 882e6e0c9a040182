"""MinHash near-dedup by Order MinHash: several minimum occurrence-labelled k-mers, kept in text order.

A k-mer is five words (runs without space and \\x09-\\x0D) together with how often it came before in the text. Each of
``SKETCHES`` hash functions takes the ``PER_SKETCH`` smallest k-mers of a text and keeps them in text order; texts that
share a sketch are candidates. Candidates are verified by banded alignment of their words: the edit distance is computed
inside the band that the threshold leaves around the diagonal, and the similarity is 1 - distance / words of the longer
text. Links are pairs of 0.8 or more. A pair whose common k-mers, chained in order inside the band, have a Jaccard
similarity of 0.8 or more is a link as well, though scattered insertions may cost its edit similarity a little.

Equal texts are one class and take part once. Within a bucket every member is first verified against the smallest id;
groups are formed, and only members that stayed outside the smallest id's group are then compared with the bucket's
members of other groups, in cells of alike length and blocks of bounded size that return links alone. So no candidate
pair between different groups goes unverified, and no group of copies is ever expanded into all pairs. Heads with many
members are sliced where texts and labels are joined to them.

Defined results: a null text is an empty one; texts without words form one group. A text of fewer than five words has
one k-mer, all its words, and meets only texts of the same words. A row with a null doc_id takes the class of its text,
which is null if no row with that text has an id. Rows that share a doc_id are one document: its texts are one group, and
its smallest text is the one that is compared. Ties in a hash are k-mers of equal hash and thus of equal words. Very long texts are
compared whole. An empty table gives no rows. Extra columns do not matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, materialise, ship, small_batches

WORDS = 5
THRESHOLD = 0.8
SKETCHES = 20
PER_SKETCH = 3
#: Words of a cell's members in one comparison block, about.
BLOCK_WORDS = 200_000
#: A key's rows are joined in slices of so many rows, or of as many as keep the sliced keys fewer than HOT_KEYS.
SLICE_PAIRS = 500
HOT_KEYS = 10_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX2
    return h ^ (h >> np.uint64(31))


def kmers(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers of a text's word hashes, in text order."""
    w = words.view(np.uint64)
    if len(w) < k:
        w = np.concatenate([w, np.full(k - len(w), np.uint64(1))])
    n = len(w) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = _mix(h * _MIX + w[i : i + n])
    order = np.argsort(h, kind="stable")
    s = h[order]
    again = s[1:] == s[:-1]
    if again.any():
        at = np.arange(n)
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~again]), at, 0))
        nth = np.empty(n, np.uint64)
        nth[order] = (at - begin).astype(np.uint64)
        h = np.where(nth > 0, _mix(h + nth * _MIX), h)
    return h


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(20_240_607).integers(1, 2**63, (2, n), dtype=np.uint64) | np.uint64(1)


def sketch(labelled: np.ndarray, sketches: int = SKETCHES, per: int = PER_SKETCH) -> np.ndarray:
    """One key for each hash function: its smallest k-mers, combined in text order."""
    a, b = _seeds(sketches)
    v = (labelled[None, :] ^ b[:, None]) * a[:, None]
    v ^= v >> np.uint64(32)
    v *= _MIX2
    if len(labelled) > per:
        least = np.sort(np.argpartition(v, per - 1, axis=1)[:, :per], axis=1)
    else:
        least = np.tile(np.arange(len(labelled)), (sketches, 1))
    key = np.arange(1, sketches + 1).astype(np.uint64)
    for j in range(least.shape[1]):
        key = _mix(key * _MIX + labelled[least[:, j]])
    return key


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity by banded alignment; 0.0 where it is sure to be under ``threshold``."""
    n, m = len(a), len(b)
    if min(n, m) < threshold * max(n, m):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    needed = threshold * (n + m) / (1 + threshold)
    if len(i) < needed - 1e-9:
        return 0.0
    band = n + m - 2 * needed  # k-mers left out of an alignment that still reaches the threshold
    near = np.abs(i - j) <= band + 1e-9
    i, j = i[near], j[near]
    chain: list[int] = []
    for x in j[np.argsort(i)].tolist():
        k = bisect_left(chain, x)
        if k == len(chain):
            chain.append(x)
        else:
            chain[k] = x
    s = len(chain) / (n + m - len(chain))
    return s if s >= threshold - 1e-12 else 0.0


def within(a: list[int], b: list[int], most: int) -> bool:
    """Whether the edit distance of two sequences is at most ``most``: bit-parallel columns inside a band of the diagonal."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return False
    if most >= n:
        return True
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    width = 2 * most + 2
    full, diagonal, row = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    up, down = full ^ ((1 << (width - most - 1)) - 1), 0  # vertical steps of +1 and -1 in the band
    distance, at, limit = most, most + 1 - width, 2 * most + m - n
    for j, x in enumerate(b):
        hit = places.get(x, 0)
        hit = (hit >> at if at >= 0 else hit << -at) & full
        zero = (((hit & up) + up) ^ up) & full | hit | down
        right, left = down | (full & ~(zero | up)), zero & up
        if j < n - most:  # along the band's lower edge, then along the last row
            distance += not zero & diagonal
            if distance > limit:
                return False
        else:
            distance += bool(right & row) - bool(left & row)
            row >>= 1
        zero >>= 1
        up, down, at = left | (full & ~(zero | right)), zero & right, at + 1
    return distance <= most


def linked(a: np.ndarray, b: np.ndarray, k: int = WORDS, threshold: float = THRESHOLD) -> bool:
    """Whether two texts (word hashes) are near copies."""
    most = max(len(a), len(b))
    if not most or np.array_equal(a, b):
        return True
    # both similarities need so many words in common
    if min(len(a), len(b)) < threshold * most - 1e-9 or len(np.intersect1d(kmers(a, 1), kmers(b, 1), assume_unique=True)) < threshold * most - 1e-9:
        return False
    return within(a.tolist(), b.tolist(), int((1 - threshold) * most + 1e-9)) or aligned(kmers(a, k), kmers(b, k), threshold) > 0


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), f"{SPACE}+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    for i in range(len(at) - 1):
        yield flat[at[i] : at[i + 1]]


def _sketches(k: int, sketches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sizes = [], []
            for words in _lists(batch.column(3)):
                labelled = kmers(words, k)
                keys.append(sketch(labelled, sketches))
                sizes.append(len(words))
            flat = pa.array(np.concatenate(keys).view(np.int64))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, sketches), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int32()), keys], ["doc_id", "h1", "h2", "n", "keys"])

    return run


def _verify(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([linked(x, y, k, threshold) for x, y in zip(_lists(batch.column(2)), _lists(batch.column(3)), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return run


def _block(k: int, threshold: float):
    """Links between groups: unresolved members of one block against the members of another, one link for two groups."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        left, right = g[g["is_left"]].drop_duplicates("cls"), g[~g["is_left"]].drop_duplicates("cls")
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            band = int(g["band"].iloc[0])
            texts = [np.asarray(w, np.int64) for w in right["words"]]
            rw = [kmers(w, 1) if len(w) else np.zeros(0, np.uint64) for w in texts]
            sizes = np.array([len(x) for x in rw])
            flat, owner = np.concatenate(rw), np.repeat(np.arange(len(rw)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            groups, keys = right["grp"].to_numpy(), np.stack(right["keys"].to_list())
            for grp, own, words in zip(left["grp"], left["keys"], left["words"], strict=True):
                words = np.asarray(words, np.int64)
                longer = np.maximum(sizes, len(words))
                near = (np.minimum(sizes, len(words)) >= threshold * longer - 1e-9) & (groups != grp)
                near &= ~(keys[:, :band] == np.asarray(own)[None, :band]).any(axis=1)  # an earlier bucket has that pair
                if near.any():
                    a = kmers(words, 1)
                    low = np.searchsorted(flat, a, "left")
                    n = np.searchsorted(flat, a, "right") - low
                    hits = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    near &= np.bincount(owner[hits], minlength=len(rw)) >= threshold * longer - 1e-9
                    joined: set[int] = set()
                    for j in np.flatnonzero(near):
                        if groups[j] not in joined and linked(words, texts[j], k, threshold):
                            joined.add(groups[j])
                    out.extend((int(grp), int(x)) for x in joined)
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype="int64")

    return run


def _least(rows: int) -> int:
    """Rows of one key in a slice, about: no more than HOT_KEYS keys can have more than this of ``rows``."""
    return max(SLICE_PAIRS, rows // HOT_KEYS)


def _slices(rows: DataFrame, key: list[str], counted: Column | None = None) -> DataFrame:
    """key, slices: the keys with too many rows for one task, fewer than HOT_KEYS, and how many slices they take.

    ``rows`` is a written table; with ``counted`` it has a row for each key and that many rows stand behind it.
    """
    total = rows.count() if counted is None else rows.agg(F.coalesce(F.sum(counted), F.lit(0))).first()[0]
    n = rows.groupBy(*key).agg(F.count("*").alias("n_")) if counted is None else rows.select(*key, counted.alias("n_"))
    return materialise(n.where(F.col("n_") > _least(total)).select(*key, F.ceil(F.col("n_") / _least(total)).cast("int").alias("slices")), "slices")


def _copies(rows: DataFrame, key: list[str], slices: DataFrame) -> DataFrame:
    """``rows``, those of sliced keys once for each slice."""
    met = rows.join(F.broadcast(slices), key, "left")  # fewer than HOT_KEYS rows
    return met.withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")


def _sliced(rows: DataFrame, key: list[str], by: str, slices: DataFrame) -> DataFrame:
    """``rows`` with the slice that each belongs to."""
    met = rows.join(F.broadcast(slices), key, "left")  # fewer than HOT_KEYS rows
    return met.withColumn("slice", F.pmod(F.xxhash64(by), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")


def _sliced_join(rows: DataFrame, table: DataFrame, key: list[str], by: str, slices: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` with what ``table`` (a row for each key) has for their key; keys with many rows meet it slice by slice."""
    return _sliced(rows, key, by, slices).join(_copies(table, key, slices), [*key, "slice"], how).drop("slice")


def components(links: DataFrame) -> DataFrame:
    """node, grp (smallest node of its connected component) for each node of ``links`` (a, b)."""
    edges = materialise(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    busy = _slices(edges, ["b"])  # the label of a node with many edges is looked up in slices
    label = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("grp")), "labels")
    while True:
        ends = label.select(F.col("node").alias("b"), "grp")
        of_next = _sliced_join(edges, ends, ["b"], "a", busy, "inner").groupBy("a").agg(F.min("grp").alias("low"))
        hooked = label.join(of_next.withColumnRenamed("a", "node"), "node").select("node", F.col("grp").alias("old"), F.least("grp", "low").alias("grp"))
        hooked = materialise(hooked, "hooked")
        roots = label.select(F.col("node").alias("grp"), F.col("grp").alias("root"))
        moved = _sliced_join(hooked, roots, ["grp"], "node", _slices(hooked, ["grp"]))
        moved = materialise(moved.select("node", "old", F.least("grp", F.coalesce("root", "grp")).alias("grp")), "labels")
        label = moved.select("node", "grp")
        if moved.where("old <> grp").isEmpty():
            return label


def near_groups(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, sketches: int = SKETCHES) -> DataFrame:
    """doc_id, text_class (smallest id with that text) and class_id (smallest id of its near-duplicate group) by row."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    hashed = own.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), word_hashes(F.col("text")).alias("words"))
    with small_batches(docs.sparkSession):
        rows = materialise(hashed.mapInArrow(_sketches(words, sketches), "doc_id long, h1 long, h2 long, n int, keys array<long>"), "sketches")
    classes = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("cls"), F.min("n").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("rows"))
    classes = materialise(classes, "classes")
    usable = classes.where("cls is not null")

    members = usable.select("cls", "n", F.posexplode("keys").alias("band", "key"))
    least = members.groupBy("band", "key").agg(F.min(F.struct("cls", "n")).alias("head"), F.count("*").alias("m")).where("m > 1")
    least = materialise(least.select("band", "key", "m", F.col("head.cls").alias("head"), F.col("head.n").alias("head_n")), "heads")
    full = _slices(least, ["band", "key"], F.col("m"))  # buckets of many texts are joined in slices
    buckets = materialise(_sliced_join(members, least, ["band", "key"], "cls", full, "inner"), "buckets")
    star = buckets.where(F.col("cls") != F.col("head")).where(F.least("n", "head_n") >= threshold * F.greatest("n", "head_n"))
    pairs = materialise(star.select(F.col("cls").alias("a"), F.col("head").alias("b")).distinct(), "pairs")

    involved = buckets.select("cls").distinct()
    texts = own.join(involved, own["doc_id"] == involved["cls"]).groupBy("cls").agg(F.min("text").alias("text"))
    texts = materialise(texts, "texts")
    head_texts = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")).join(pairs.select("b").distinct(), "b", "left_semi")
    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    both = _sliced_join(both, head_texts, ["b"], "a", _slices(pairs, ["b"]), "inner")
    both = both.select("a", "b", word_hashes(F.col("text_a")).alias("x"), word_hashes(F.col("text_b")).alias("y"))
    with small_batches(docs.sparkSession):
        links = materialise(both.mapInArrow(_verify(words, threshold), "a long, b long"), "links")

    groups = components(links)
    grouped = buckets.where("m > 2").join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    head_groups = groups.select(F.col("node").alias("head"), F.col("grp").alias("head_grp"))
    grouped = _sliced_join(grouped, head_groups, ["head"], "cls", _slices(buckets, ["head"])).withColumn("head_grp", F.coalesce("head_grp", "head"))
    grouped = materialise(grouped.withColumn("out", F.col("grp") != F.col("head_grp")), "grouped")
    # lengths further apart than the threshold never link: members meet in cells of alike length
    cell = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.log(F.lit(1 / (threshold - 0.01)))).cast("int")
    grouped = grouped.select("band", "key", "cls", "grp", "out", "n", cell.alias("own_cell"))
    open_ = grouped.where("out").select("band", "key").distinct()
    again = _sliced_join(grouped, open_, ["band", "key"], "cls", full, "inner")  # the head as well: its cell may hold members of other groups
    right = again.withColumn("cell", F.col("own_cell"))
    left = again.where("out").withColumn("cell", F.explode(F.array(F.col("own_cell") - 1, F.col("own_cell"), F.col("own_cell") + 1)))
    both_sides = materialise(left.withColumn("is_left", F.lit(True)).unionByName(right.withColumn("is_left", F.lit(False))).drop("own_cell"), "cells")
    size = lambda c: F.sum(F.when(c, F.greatest("n", F.lit(1))))
    cells = both_sides.groupBy("band", "key", "cell").agg(size(F.col("is_left")).alias("u"), size(~F.col("is_left")).alias("all"), F.min("grp").alias("g0"), F.max("grp").alias("g1"))
    cells = cells.where("u > 0 and `all` > 0 and g0 < g1").select("band", "key", "cell", F.ceil(F.col("u") / BLOCK_WORDS).cast("int").alias("left_blocks"), F.ceil(F.col("all") / BLOCK_WORDS).cast("int").alias("blocks"))
    cells = materialise(cells, "open_cells")
    if not cells.isEmpty():
        met = _sliced_join(both_sides, cells, ["band", "key", "cell"], "cls", _slices(both_sides, ["band", "key", "cell"]), "inner")
        mine = lambda n: F.pmod(F.xxhash64("cls", "band"), F.col(n)).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        met = met.withColumn("lb", F.explode(F.when(F.col("is_left"), F.array(mine("left_blocks"))).otherwise(every("left_blocks"))))
        met = met.withColumn("rb", F.explode(F.when(F.col("is_left"), every("blocks")).otherwise(F.array(mine("blocks")))))
        met = met.select("band", "key", "cell", "lb", "rb", "cls", "grp", "is_left").join(usable.select("cls", "keys"), "cls").join(texts, "cls")
        met = met.withColumn("words", word_hashes(F.col("text"))).drop("text")
        found = met.groupBy("band", "key", "cell", "lb", "rb").applyInPandas(_block(words, threshold), "a long, b long")
        merged = components(found).select(F.col("node").alias("grp"), F.col("grp").alias("whole"))
    else:
        merged = None

    by_text = classes.join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    by_text = by_text.select("h1", "h2", "cls", "rows", "grp")
    if merged is not None:
        by_text = materialise(by_text, "by_text")
        by_text = _sliced_join(by_text, merged, ["grp"], "cls", _slices(by_text, ["grp"])).withColumn("grp", F.coalesce("whole", "grp"))
    by_text = by_text.select("h1", "h2", F.col("cls").alias("text_class"), F.col("grp").alias("class_id"))
    copies = _slices(classes, ["h1", "h2"], F.col("rows"))  # a text with many copies meets its class in slices
    return _sliced_join(rows.select("doc_id", "h1", "h2"), by_text, ["h1", "h2"], "doc_id", copies).select("doc_id", "text_class", "class_id")


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id.

    Rows that share a doc_id stay or go together; rows without an id stay.
    """
    gone = near_groups(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias(fresh(docs, "gone"))).distinct()
    return docs.join(gone, docs["doc_id"] == gone[0], "left_anti")
