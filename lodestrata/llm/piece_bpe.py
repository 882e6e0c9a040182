"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with an identity normaliser.

A segment's characters start as symbols; an agenda ordered by piece score (ties: leftmost) holds the adjacent pairs
whose concatenation is a piece, and the best pair is merged until none is left. Characters that no piece covers fall
back to bytes. Segments that cannot share a piece are encoded on their own and cached, up to ``CACHED`` of them.
In each Arrow batch the library encodes every segment that was not met before, and a whole text of each chunk; where
the two differ the library's ids count and ``agrees`` is false. The library decodes every text. For a model with another
normaliser than the identity, or other white space rules, every text's ids are the library's and ``agrees`` is false.

Defined results: a null text is an empty one, whose ids are begin and end alone. Rows are independent, so repeated
rows, null ids and ties need no rule; a very long text is encoded whole, in a chunk of its own; an empty table gives no
rows. Extra columns are not returned.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece as spm
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

CACHED = 600_000
#: Characters that are encoded and checked at a time, so that lists of ids stay small.
CHUNK_CHARS = 400_000
MARK = "▁"
_BREAKS = "\n\r\t"


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message: numbers for varints, bytes for all else."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = message[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at : at + size]
        at += size


def keeps_text(model: bytes) -> bool:
    """Whether a model's normaliser is the identity but for marks: no character map, a prefix mark, all white space kept.

    Field numbers are those of the published model format: 2 and 3 hold the trainer's and the normaliser's settings.
    """
    spec = dict(_fields(model))
    trainer, normaliser = (dict(_fields(spec.get(k, b""))) for k in (2, 3))
    prefix, fewer, escape = (normaliser.get(k, 1) for k in (3, 4, 5))
    return not normaliser.get(2) and bool(prefix) and not fewer and bool(escape) and not trainer.get(24, 0)


class PieceBpe:
    def __init__(self, path: str):
        self.library = sp = spm.SentencePieceProcessor(model_file=path)
        self.own = keeps_text(sp.serialized_model_proto())
        n = sp.get_piece_size()
        usual = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if any(sp.is_unused(i) for i in usual) or not any(sp.is_byte(i) for i in range(n)):
            raise ValueError("a merge-type vocabulary with byte fallback and no unused pieces is asked for")
        self.id = {sp.id_to_piece(i): i for i in usual}
        self.rank = {p: k for k, p in enumerate(sorted(self.id, key=lambda p: (-sp.get_score(self.id[p]), self.id[p])))}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        joined = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id)
        breaks = "".join(c for c in _BREAKS if not any(c in p for p in self.id))
        self.segments = re.compile(f"[{breaks}]|{MARK}*[^{MARK}{breaks}]+|{MARK}+" if breaks else f"{MARK}*[^{MARK}]+|{MARK}+") if not joined else re.compile("(?s).+")
        self.breaks = "" if joined else breaks
        self.cache: dict[str, bytes] = {}
        self.differ: set[str] = set()

    def agenda(self, segment: str) -> list[int]:
        """Ids of one segment: the best-scored adjacent pair is merged first, the leftmost of equals."""
        symbols, rank = list(segment), self.rank.get
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(symbols[i] + symbols[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if j >= n or not symbols[i] or rank(pair := symbols[i] + symbols[j]) != r:
                continue  # merged meanwhile
            symbols[i], symbols[j] = pair, ""
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (r := rank(pair + symbols[j])) is not None:
                    heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] + pair)) is not None:
                heappush(heap, (r, h))
        out: list[int] = []
        for s in symbols:
            if s:
                known = self.id.get(s)
                out.extend([known] if known is not None else [self.byte[b] for b in s.encode()])
        return out

    def learn(self, segments: set[str]) -> list[str]:
        """Encode segments that are new, check them against the library; returns those to be dropped after use."""
        new = list(segments.difference(self.cache))
        own = [self.agenda(s) for s in new]
        if self.breaks:
            head = self.library.encode("\n")  # the prefix mark and the line end, which no piece spans
            theirs = self.library.encode(["\n" + s.replace(MARK, " ") for s in new], num_threads=1)
            for i, t in enumerate(theirs):
                if t[len(head) :] != own[i]:
                    self.differ.add(new[i])
                    own[i] = t[len(head) :]
        room = max(0, CACHED - len(self.cache))
        self.cache.update(zip(new, (struct.pack(f"<{len(x)}I", *x) for x in own), strict=True))
        return new[room:]

    def encode_many(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text without begin and end, little-endian unsigned 32-bit, and whether own and library agree."""
        if not self.own:
            return [np.array(x, "<u4").tobytes() for x in self.library.encode(texts, num_threads=1)], [False] * len(texts)
        pieces = [self.segments.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        extra = self.learn(set().union(*pieces))
        of, differ = self.cache.__getitem__, self.differ
        ids = [b"".join(map(of, p)) for p in pieces]
        agrees = [not differ or differ.isdisjoint(p) for p in pieces]
        whole = range(len(texts)) if not self.breaks else range(min(1, len(texts)))
        for i in whole:  # a whole text of each chunk, to check that segments are apart
            their = np.array(self.library.encode(texts[i]), "<u4").tobytes()
            ids[i], agrees[i] = their, agrees[i] and ids[i] == their
        for s in extra:
            del self.cache[s]
        return ids, agrees


_loaded: dict[str, PieceBpe] = {}


def load(path: str) -> PieceBpe:
    if path not in _loaded:
        _loaded[path] = PieceBpe(path)
    return _loaded[path]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string()), ("agrees", pa.bool_())])


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= CHUNK_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _run(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (bpe.bos, bpe.eos))
        for batch in batches:
            doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                ids, agrees = bpe.encode_many(texts[a:b])
                ids = [begin + x + end for x in ids]
                decoded = [bpe.library.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digest:
                    columns = [doc_ids.slice(a, b - a), n, pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]), pa.array(agrees)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])
                else:
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), n, pa.array(ids, pa.binary()), pa.array(decoded), pa.array(agrees)], schema=_OUT)

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded, agrees for each row of ``docs``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_run(model, False), "doc_id long, n_tokens long, ids binary, decoded string, agrees boolean")


def encode_digests(docs: DataFrame, model: str) -> DataFrame:
    """As ``encode``, with SHA-256 digests in place of ids and text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_run(model, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")
