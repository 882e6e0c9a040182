"""Byte-level BPE ids by segment, with a bounded cache; shared by packing and token counts.

A segment is a run of white space with the run of other characters behind it. The library's own pre-tokens never cross
from other characters into white space, so every segment is encoded by itself. Texts of an Arrow batch are cut and
dictionary-encoded by Arrow; each distinct segment is looked up once, new ones are merged side by side in numpy, and ids
are gathered by position. What the numpy path does not cover (characters on whose class pattern engines may differ,
long segments, texts with special tokens, other kinds of models) takes the library's path.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Letters and numbers (Unicode L and N) among the characters of ``UNSURE``'s complement; fixed values.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼½¾"
#: The published pre-token pattern of this kind of byte-level BPE (a fixed value), with its classes written out.
PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+")
#: Any other character than these: a segment with one takes the library's path.
UNSURE = re.compile(r"[^\x09-\x0d\x20-\x7e¡-ɏ‐-‧]")
#: What numpy cuts into pre-tokens by itself: at most one space or line end, then characters that contractions need not.
_SIMPLE = re.compile(r"[ \n]?[!-&(-~¡-ɏ‐-‧]+")
#: Where segments begin: white space behind a character that no engine takes for white space, and an ideographic full
#: stop or comma behind a letter of its scripts, where the library's pre-tokens end as well.
_BLANK = "\\s\u180e\u200b\u2060\ufeff"
BORDER = re.compile(f"(?<=[^{_BLANK}])(?=[ \\t-\\r])|(?<=[ぁ-ゖァ-ヺ一-鿿가-힣])(?=[、。，！？])")
#: Texts without these are cut by Arrow at single spaces and before line ends, which comes to the same.
_ODD = "[\\x00\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{2060}\\x{3000}\\x{feff}]|  | \n|\n | \\z|[ぁ-ゖァ-ヺ一-鿿가-힣][、。，！？]"
CACHED = 500_000
#: Longer segments are not cached, and not merged in numpy.
LONG = 48
#: Characters whose segments are encoded at a time, about.
CHUNK_CHARS = 2_000_000


def segments(text: str) -> list[str]:
    """The text cut at every border; joined they are the text."""
    at = [0, *(m.start() for m in BORDER.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


class Merges:
    """Merging by rank for many byte strings at once: each round merges the first pair of least rank in every string."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; fixed values
        hidden = [b for b in range(256) if b not in shown]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.first = np.array([vocab[letter[b]] for b in range(256)], np.int32)
        self.bits = max(16, (8 * len(merges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks, self.made = np.full(1 << self.bits, len(merges), np.int32), np.zeros(1 << self.bits, np.int32)
        self.none = len(merges)
        pair = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        rank, slot, self.probes = np.arange(len(merges)), self._slot(pair), 0
        while len(pair):  # open addressing: of those that want a slot the least rank has it, the others move on
            self.probes += 1
            free = self.keys[slot] < 0
            _, one = np.unique(slot[free], return_index=True)
            mine = np.flatnonzero(free)[one]
            self.keys[slot[mine]], self.ranks[slot[mine]], self.made[slot[mine]] = pair[mine], rank[mine], made[mine]
            rest = np.ones(len(pair), bool)
            rest[mine] = False
            pair, made, rank, slot = pair[rest], made[rest], rank[rest], (slot[rest] + 1) & (len(self.keys) - 1)
        two = np.arange(1 << 16)
        self.byte_rank, self.byte_slot = self.look(self.first[two >> 8], self.first[two & 255])

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int32)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``none`` where there is no merge) and its slot."""
        pair = (a.astype(np.int64) << 32) | b
        slot = self._slot(pair)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != pair) & (found >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            open_ = open_[(found != pair[open_]) & (found >= 0)]
        return np.where(self.keys[slot] == pair, self.ranks[slot], self.none), slot

    def encode(self, raw: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``n`` byte strings, one after another, and how many each has; ``owner`` tells each byte's string."""
        symbol, owner = self.first[raw], owner.astype(np.int32)
        rank = np.full(len(symbol), self.none, np.int32)  # of the pair of each symbol and the next one
        slot = np.zeros(len(symbol), np.int32)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        two = (raw[inner].astype(np.int32) << 8) | raw[inner + 1]
        rank[inner], slot[inner] = self.byte_rank[two], self.byte_slot[two]
        done_symbol, done_owner = [symbol[:0]], [owner[:0]]
        while len(symbol):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(symbol)))
            over = least == self.none
            if over.any():
                ended = np.repeat(over, size)
                done_symbol.append(symbol[ended])
                done_owner.append(owner[ended])
                keep = ~ended
                symbol, owner, rank, slot = symbol[keep], owner[keep], rank[keep], slot[keep]
                least, size = least[~over], size[~over]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]  # the first in each string
            symbol[hit] = self.made[slot[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            rank[hit] = self.none
            at = hit - np.arange(len(hit))
            symbol, owner, rank, slot = symbol[keep], owner[keep], rank[keep], slot[keep]
            for i in (at, at - 1):  # the new symbol's pairs with the next one and with the one before
                i = i[(i >= 0) & (i + 1 < len(symbol))]
                i = i[owner[i] == owner[i + 1]]
                rank[i], slot[i] = self.look(symbol[i], symbol[i + 1])
        symbol, owner = np.concatenate(done_symbol), np.concatenate(done_owner)
        return symbol[np.argsort(owner, kind="stable")].astype(np.uint32), np.bincount(owner, minlength=n)


def _merges(path: str) -> Merges | None:
    """For models of the kind that ``Merges`` covers; None for others."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    if not plain or not usual:
        return None
    return Merges(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])


def _classes() -> np.ndarray:
    """Class of each code point up to U+2027: 1 letter, 2 number, 3 other, 0 space and line end."""
    out = np.full(0x2028, 3, np.int8)
    out[[32, 10]] = 0
    every = "".join(map(chr, range(0x250)))
    for k, names in ((1, _LETTERS), (2, _NUMBERS)):
        out[[ord(c) for c in re.findall(f"[{names}]", every)]] = k
    return out


class ByteBpe:
    """Ids exactly as ``tokenizers`` gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        # a special token without white space lies within one segment, which the library then encodes
        usual = not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added)
        self.merges = _merges(path) if usual else None
        self.classes = _classes()
        #: Bytes that hold any id.
        self.id_bytes = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.odd = "|".join([_ODD, *map(re.escape, self.special)])
        self.slots: dict[str, int] = {}
        self.begin, self.count, self.chars = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(4096, np.uint32), 0

    def whole(self, text: str) -> bytes:
        """The library's own path."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def cut(self, text: str) -> list[str]:
        """Segments of a text; the text itself where they may not be encoded one by one."""
        return [text] if self.merges is None else segments(text)

    def border(self, before: str, after: str) -> bool:
        """Whether segments end between two characters."""
        m = BORDER.search(before + after) if self.merges is not None else None
        return m is not None and m.start() == 1

    def _encode(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, one after another, and how many each has."""
        simple = np.fromiter((len(s) <= LONG and _SIMPLE.fullmatch(s) is not None for s in new), bool, len(new))
        if self.merges is None:
            simple[:] = False
        for special in self.special:
            simple &= np.fromiter((special not in s for s in new), bool, len(new))
        counts, parts = np.zeros(len(new), np.int64), [None] * 2
        easy = [s for s, ok in zip(new, simple, strict=True) if ok]
        if easy:
            text = "".join(easy)
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            sizes = np.fromiter(map(len, easy), np.int64, len(easy))
            begins = np.cumsum(sizes) - sizes
            kind = self.classes[points]
            start = np.zeros(len(points), bool)
            start[1:] = (kind[1:] != kind[:-1]) & (points[:-1] != 32)  # the space belongs to what follows
            start[begins] = True
            token = np.cumsum(start) - 1
            wide = 1 + (points >= 0x80) + (points >= 0x800)
            ids, n = self.merges.encode(np.frombuffer(text.encode(), np.uint8), np.repeat(token, wide), int(token[-1]) + 1)
            counts[simple] = np.add.reduceat(n, token[begins])
            parts[0] = ids
        hard = [s for s, ok in zip(new, simple, strict=True) if not ok]
        if hard:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(hard, add_special_tokens=False)]
            counts[~simple] = [len(x) for x in got]
            parts[1] = np.array([i for x in got for i in x], np.uint32)
        if parts[0] is None or parts[1] is None:
            return (parts[0] if parts[1] is None else parts[1]), counts
        out = np.empty(int(counts.sum()), np.uint32)
        of = np.repeat(simple, counts)
        out[of], out[~of] = parts
        return out, counts

    def look(self, distinct: list[str]) -> np.ndarray:
        """Slots of distinct segments; those that are not cached are gone with the next ``trim``."""
        slots = self.slots
        found = list(map(slots.get, distinct))
        missing = [i for i, x in enumerate(found) if x is None]
        out = np.array([-1 if x is None else x for x in found], np.int64)
        if not missing:
            return out
        new = [distinct[i] for i in missing]
        ids, counts = self._encode(new)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        # cached ones stand before all others, so there is room only while no others stand there
        room = max(0, CACHED - len(slots)) if self.used == len(slots) else 0
        cached = np.flatnonzero(sizes <= LONG)[:room]
        order = np.concatenate([cached, np.setdiff1d(np.arange(len(new)), cached)])
        n, end = self.used, int(self.begin[self.used - 1] + self.count[self.used - 1]) if self.used else 0
        self._room(n + len(new), end + len(ids))
        source, counts = (np.cumsum(counts) - counts)[order], counts[order]
        self.count[n : n + len(new)], self.chars[n : n + len(new)] = counts, sizes[order]
        self.begin[n : n + len(new)] = end + np.cumsum(counts) - counts
        self.flat[end : end + len(ids)] = ids[_ragged(source, counts)]
        out[np.array(missing)[order]] = np.arange(n, n + len(new))
        self.used = n + len(new)
        slots.update(zip((new[i] for i in cached.tolist()), range(n, n + len(cached)), strict=True))
        return out

    def trim(self) -> None:
        """Forget segments that are not cached."""
        self.used = len(self.slots)

    def _room(self, slots: int, ids: int) -> None:
        if slots > len(self.begin):
            grow = max(slots, len(self.begin) * 3 // 2)
            for name in ("begin", "count", "chars"):
                setattr(self, name, np.resize(getattr(self, name), grow))
        if ids > len(self.flat):
            self.flat = np.resize(self.flat, max(ids, len(self.flat) * 3 // 2))

    def segment_slots(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Slots of all segments of ``texts`` (no nulls), and how many segments each text has."""
        odd = np.ones(len(texts), bool) if self.merges is None else pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        kept = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        marked = pc.replace_substring(kept, " ", "\x00 ")
        if pc.any(pc.match_substring(kept, "\n\n")).as_py():
            marked = pc.replace_substring_regex(marked, "\n+", "\x00\\0")
        else:
            marked = pc.replace_substring(marked, "\n", "\x00\n")
        lists = pc.split_pattern(marked, "\x00")
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        coded = lists.flatten().dictionary_encode()
        sizes = np.diff(lists.offsets.to_numpy())
        slots = self.look(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        if odd.any():
            per = np.split(slots, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(odd).tolist():
                pieces = self.cut(texts[i].as_py())
                names = dict.fromkeys(pieces)
                at = dict(zip(names, self.look(list(names)).tolist(), strict=True))
                per[i] = np.fromiter((at[p] for p in pieces), np.int64, len(pieces))
                sizes[i] = len(pieces)
            slots = np.concatenate(per)
        return slots, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (nulls are empty), one after another, and how many each has."""
        texts = pc.fill_null(texts, "")
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for chunk in chunks(texts):
            slots, sizes = self.segment_slots(chunk)
            n = self.count[slots]
            ids.append(self.flat[_ragged(self.begin[slots], n)])
            total = np.concatenate([[0], np.cumsum(n)])
            ends = np.cumsum(sizes)
            counts.append(total[ends] - total[ends - sizes])
            self.trim()
        return np.concatenate(ids), np.concatenate(counts)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.encode(pa.array(texts, pa.string()))
        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(4 * counts).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def chunks(texts: pa.Array, chars: int = CHUNK_CHARS):
    """Slices of about ``chars`` bytes of text each, at least one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars)))
        yield texts.slice(at, to - at)
        at = to


def _ragged(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions begin[i], begin[i] + 1, ... of counts[i] each, one after another."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.repeat(begin - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """One encoder for each worker process."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
