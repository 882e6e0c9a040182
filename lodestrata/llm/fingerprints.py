"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (its lines, cut further after sentence ends) become 64-bit digests, labelled by how often the same
paragraph came before. Each digest is added to one cell in each of three subtables; a cell holds a count, a sum of
digests and a sum of checks. Two sketches subtract cell by cell; cells that hold one digest are peeled until nothing is
left, which recovers the digests of either side that the other lacks. If peeling fails, both sketches are built again,
larger, until it succeeds. The fingerprint is the sketch of the base size, the same for equal texts.

Documents are dealt by ranges of doc_id between bounds, each range with the first document of the next one, so a
document meets the next one (ascending doc_id) inside one partition and no partition holds more than its range. There
are so many ranges that each has about ``SPAN_CHARS`` characters of text, and each is a task of its own.

Defined results: a null or empty text is one empty paragraph. A null doc_id sorts first; rows that share a doc_id (ties,
repeated rows) are ordered by text. The last row's next is the first row; a single row is its own next. A very long text
is handled whole, with few others beside it. An empty table gives no rows. Extra columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Cells of a subtable in a fingerprint.
CELLS = 8
TABLES = 3
#: Characters of text that are handled at a time.
CHUNK_CHARS = 1_500_000
#: Characters of text in a range, about; smaller tables have two ranges for each shuffle partition.
SPAN_CHARS = 128_000_000
_CUT = re.compile(r"\n|(?<=[.!?]) ")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

_STEP = [np.uint64((j + 1) * int(_A) % 2**64) for j in range(TABLES)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    return h ^ (h >> np.uint64(31))


def paragraphs(text: str) -> list[str]:
    return _CUT.split(text)


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Labelled paragraph digests of all ``texts``, and how many each text has."""
    per = [[xxhash.xxh3_64_intdigest(p) for p in paragraphs(t)] for t in texts]
    sizes = np.array([len(p) for p in per], np.int64)
    flat = np.array([h for p in per for h in p], np.uint64)
    of = np.repeat(np.arange(len(texts)), sizes)
    order = np.lexsort((flat, of))
    f, o = flat[order], of[order]
    fresh = np.concatenate([[True], (f[1:] != f[:-1]) | (o[1:] != o[:-1])]) if len(f) else np.zeros(0, bool)
    at = np.arange(len(f))
    nth = np.empty(len(f), np.uint64)
    nth[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    return np.where(nth > 0, _mix(flat + nth * _A), flat), sizes


class Sketches:
    """Cells of many sketches, one after another; sketch i has TABLES subtables of size[i] cells."""

    def __init__(self, size: np.ndarray):
        self.size = size
        self.begin = np.concatenate([[0], np.cumsum(TABLES * size)]).astype(np.int64)
        n = int(self.begin[-1])
        self.count, self.keys, self.checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    @staticmethod
    def check(keys: np.ndarray) -> np.ndarray:
        return _mix(keys * _A + np.uint64(77)) & np.uint64(0xFFFFFFFF)

    def add(self, keys: np.ndarray, of: np.ndarray, sign: np.ndarray) -> None:
        """Add (sign 1) or take away (sign -1) each key in sketch ``of``."""
        s = sign.astype(np.uint64)  # -1 is 2**64 - 1, so products are signed modulo 2**64
        signed, checks = keys * s, self.check(keys) * s
        for j in range(TABLES):
            at = self.begin[of] + j * self.size[of] + ((_mix(keys + _STEP[j]) >> np.uint64(32)) % self.size[of].astype(np.uint64)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, signed)
            np.add.at(self.checks, at, checks)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each sketch: keys recovered with sign 1, with sign -1, and whether nothing is left. Empties the cells."""
        n = len(self.size)
        owner = np.repeat(np.arange(n), TABLES * self.size)
        plus, minus = np.zeros(n, np.int64), np.zeros(n, np.int64)
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            sign = self.count[look]
            keys = self.keys[look] * sign.astype(np.uint64)
            pure = (np.abs(sign) == 1) & (self.check(keys) == self.checks[look] * sign.astype(np.uint64))
            keys, sign, of = keys[pure], sign[pure], owner[look[pure]]
            _, once = np.unique(_mix(keys + of.astype(np.uint64) * _A), return_index=True)
            if not len(once):
                break
            keys, sign, of = keys[once], sign[once], of[once]
            plus += np.bincount(of[sign > 0], minlength=n)
            minus += np.bincount(of[sign < 0], minlength=n)
            self.add(keys, of, -sign)
            look = np.flatnonzero(np.abs(self.count) == 1)
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        return plus, minus, np.add.reduceat(left, self.begin[:-1]) == 0


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], first: Sketches | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many digests of each a[i] b[i] lacks, and the other way; ``first`` holds subtracted fingerprints to try first."""
    n = len(a[1])
    only_a, only_b, open_ = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    begin = [np.concatenate([[0], np.cumsum(x[1])]).astype(np.int64) for x in (a, b)]
    size = np.full(n, CELLS, np.int64)
    sketches = first
    while len(open_):
        if sketches is None:
            sketches = Sketches(size[open_])
            for (keys, sizes), start, sign in ((a, begin[0], 1), (b, begin[1], -1)):
                m = sizes[open_]
                of = np.repeat(np.arange(len(open_)), m)
                take = np.repeat(start[:-1][open_] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(int(m.sum()))
                sketches.add(keys[take], of, np.full(len(take), sign, np.int64))
        plus, minus, done = sketches.peel()
        only_a[open_[done]], only_b[open_[done]] = plus[done], minus[done]
        open_ = open_[~done]
        # larger: room for all digests of both texts, and twice as much each time that this fails
        size = np.maximum(2 * size, (a[1] + b[1]) // 2 + CELLS)
        sketches = None
    return only_a, only_b


def likeness(a, b, first: Sketches | None = None) -> np.ndarray:
    only_a, only_b = difference(a, b, first)
    common = a[1] - only_a
    return common / (common + only_a + only_b)


def base_sketches(keys: np.ndarray, sizes: np.ndarray) -> Sketches:
    s = Sketches(np.full(len(sizes), CELLS, np.int64))
    s.add(keys, np.repeat(np.arange(len(sizes)), sizes), np.ones(len(keys), np.int64))
    return s


def minus(a: Sketches, i: np.ndarray, b: Sketches, j: np.ndarray) -> Sketches:
    """Sketches a[i] - b[j], cell by cell; all of the base size."""
    out, cells = Sketches(np.full(len(i), CELLS, np.int64)), TABLES * CELLS
    for name in ("count", "keys", "checks"):
        setattr(out, name, (getattr(a, name).reshape(-1, cells)[i] - getattr(b, name).reshape(-1, cells)[j]).ravel())
    return out


def strings(s: Sketches, sizes: np.ndarray) -> list[str]:
    cells = TABLES * CELLS
    packed = np.zeros(len(sizes), np.dtype([("n", "<u4"), ("count", "<i4", cells), ("keys", "<u8", cells), ("checks", "<u8", cells)]))
    packed["n"] = sizes
    for name in ("count", "keys", "checks"):
        packed[name] = getattr(s, name).reshape(-1, cells)
    return [base64.b64encode(x.tobytes()).decode() for x in packed]


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the beginning of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _flush(rows: list[tuple[int | None, str]], after: str) -> pa.RecordBatch:
    """Fingerprints of ``rows``, in order; ``after`` is the text that follows the last one."""
    texts = [t for _, t in rows] + [after]
    changed = [edited(t, u) for t, u in zip(texts[:-1], texts[1:], strict=True)]
    n = len(rows)
    own, new = digests(texts), digests(changed)
    base, base_new = base_sketches(*own), base_sketches(*new)
    at = np.arange(n)
    mine = (own[0][: int(own[1][:n].sum())], own[1][:n])
    following = (own[0][int(own[1][0]) :], own[1][1:])
    near_edited = likeness(mine, new, minus(base, at, base_new, at))
    near_next = likeness(mine, following, minus(base, at, base, at + 1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(strings(base, own[1])[:n]),
            pa.array(strings(base_new, new[1])),
            pa.array(near_edited),
            pa.array(near_next),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range and, inside a range, in order; its last row is the guard, the first row of the next range."""
    rows: list[tuple[int | None, str]] = []
    now, closed, chars = None, False, 0
    for batch in batches:
        for span, guard, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if span != now:
                rows, now, closed, chars = [], span, False, 0
            if closed:
                continue  # further rows with the guard's doc_id
            if guard:
                closed = True
            if rows and (guard or chars > CHUNK_CHARS):
                yield _flush(rows, text)
                rows, chars = [], 0
            rows.append((doc_id, text))
            chars += len(text)


def _below(bounds: list[int], x: Column) -> Column:
    """How many of the sorted ``bounds`` are less than ``x``; about twice the square root of their number is compared."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]])
    whole = F.size(F.filter(every, lambda b: b < x)) * step
    part = F.slice(F.array(*[F.lit(b) for b in bounds]), whole + 1, step)
    return whole + F.size(F.filter(part, lambda b: b < x))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row's text and edited text, and how near the edited and the next text are (0 to 1)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_spans = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), chars // SPAN_CHARS)
    shares = [i / n_spans for i in range(1, n_spans)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 10 * n_spans)).first()[0] or []))
    span = _below(bounds, F.col("doc_id"))
    spanned = rows.withColumn("span", F.coalesce(span, F.lit(0)))
    # a row for each range
    found = spanned.groupBy("span").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("unknown")).orderBy("span").collect()
    firsts = [(r["span"], None if r["unknown"] else r["least"]) for r in found]
    guards = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    table = spark.createDataFrame(guards, "first long, before int")
    met = spanned.join(F.broadcast(table), spanned["doc_id"].eqNullSafe(table["first"]), "left")
    places = F.array_compact(F.array(F.struct("span", F.lit(False).alias("guard")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("span"), F.lit(True).alias("guard")))))
    dealt = met.select("doc_id", "text", F.explode(places).alias("p")).select("p.span", "p.guard", "doc_id", "text")
    dealt = dealt.repartitionById(n_spans, F.col("span").cast("int")).sortWithinPartitions("span", "guard", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_run, _COLUMNS)
