"""HTML extraction: a linear-chain conditional random field labels the leaf blocks of a page's DOM.

Each block has features of its ancestors' tags and names and of its text. The field's weights are fitted on labelled
pages by maximum likelihood (forward-backward gradients, Adam, L2) and blocks are decoded by Viterbi. The main text
is the blocks labelled main, in page order, joined by one space.

Defined results: a null or empty page, or one without main blocks, has the empty text. Elements that never hold text
for readers (script, style and the like), comments and the head are left out before labelling; what stands in a script is
no markup, one that is never closed loses its tag alone, and a comment that is never closed ends at its next >. Rows are
independent, repeated ones alike, and keep null ids. Equal scores of two labellings (ties) take the rest's label. A very
long page is decoded whole, in time and memory linear in its blocks; batches are small. An empty table gives no rows.
Extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .html_blocks import Block, blocks, features
from .html_pages import MAIN, REST, labelled_pages

#: Labelled pages that the field is fitted on, and their seed.
TRAIN_PAGES = 1_800
TRAIN_SEED = 7


class Model:
    """Weights of main (against the rest) by feature; start and transition scores by label (0 rest, 1 main)."""

    def __init__(self, weights: dict[str, float], start: list[float], moves: list[list[float]]):
        self.weights, self.start, self.moves = weights, start, moves

    def emission(self, b: Block) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(b))

    def decode(self, bs: list[Block]) -> list[int]:
        """Viterbi: the best sequence of labels."""
        if not bs:
            return []
        (rr, rm), (mr, mm) = self.moves
        r, m = self.start[0], self.start[1] + self.emission(bs[0])
        back: list[tuple[int, int]] = []
        for b in bs[1:]:
            e = self.emission(b)
            to_r, to_m = (0, r + rr) if r + rr >= m + mr else (1, m + mr), (0, r + rm) if r + rm > m + mm else (1, m + mm)
            back.append((to_r[0], to_m[0]))
            r, m = to_r[1], to_m[1] + e
        label = int(m > r)
        out = [label]
        for k in reversed(back):
            label = k[label]
            out.append(label)
        return out[::-1]


def _is_head(b: Block) -> bool:
    f = b.context.features
    return "t=head" in f or ("t=title" in f and "t=svg" not in f)


def readable(page: str) -> list[Block]:
    return [b for b in blocks(page) if not _is_head(b)]


def labelled(page: str) -> tuple[list[Block], list[int]]:
    bs, labels = readable(page), []
    for b in bs:
        labels.append(int(b.text.count(MAIN) > b.text.count(REST)))
        b.text = b.text.replace(MAIN, "").replace(REST, "") or "-"
    return bs, labels


def fit(pages: list[str], steps: int = 160, rate: float = 0.15, l2: float = 0.02) -> Model:
    """Maximum likelihood by full-batch Adam; all pages' forward and backward passes run side by side."""
    data = [x for x in map(labelled, pages) if x[0]]
    names: dict[str, int] = {}
    n, longest = len(data), max(len(x[0]) for x in data)
    mask, gold = np.zeros((n, longest), bool), np.zeros((n, longest), int)
    at, feats = [], []
    for i, (bs, labels) in enumerate(data):
        mask[i, : len(bs)], gold[i, : len(bs)] = True, labels
        for j, b in enumerate(bs):
            ids = [names.setdefault(f, len(names)) for f in sorted(set(features(b)))]
            at.extend([i * longest + j] * len(ids))
            feats.extend(ids)
    at, feats = np.array(at), np.array(feats)
    w = np.zeros(len(names) + 6)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    k = len(names)
    for step in range(1, steps + 1):
        start, moves = w[k : k + 2], w[k + 2 :].reshape(2, 2)
        e = np.zeros((n, longest, 2))
        e[..., 1] = np.bincount(at, w[feats], n * longest).reshape(n, longest)
        alpha, beta = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        alpha[0] = start + e[:, 0]
        for t in range(1, longest):
            a = np.logaddexp(alpha[t - 1, :, 0, None] + moves[0], alpha[t - 1, :, 1, None] + moves[1]) + e[:, t]
            alpha[t] = np.where(mask[:, t, None], a, alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = e[:, t + 1] + beta[t + 1]
            b = np.logaddexp(moves[:, 0] + nxt[:, 0, None], moves[:, 1] + nxt[:, 1, None])
            beta[t] = np.where(mask[:, t + 1, None], b, 0.0)
        z = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
        p = np.exp(alpha.transpose(1, 0, 2) + beta.transpose(1, 0, 2) - z[:, None, None]) * mask[..., None]
        g = np.zeros_like(w)
        wrong = np.where(mask, gold - p[..., 1], 0.0).ravel()
        g[:k] = np.bincount(feats, wrong[at], k)
        g[k] = ((gold[:, 0] == 0) - p[:, 0, 0]).sum()
        g[k + 1] = ((gold[:, 0] == 1) - p[:, 0, 1]).sum()
        both = mask[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                pair = np.exp(alpha.transpose(1, 0, 2)[:, :-1, a] + moves[a, b] + e[:, 1:, b] + beta.transpose(1, 0, 2)[:, 1:, b] - z[:, None])
                g[k + 2 + 2 * a + b] = (((gold[:, :-1] == a) & (gold[:, 1:] == b)) * both - pair * both).sum()
        g = (g - l2 * w) / n
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w = w + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Model({f: round(float(w[i]), 5) for f, i in names.items()}, w[k : k + 2].tolist(), w[k + 2 :].reshape(2, 2).tolist())


@lru_cache(maxsize=2)
def default_model(pages: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> Model:
    return fit(labelled_pages(pages, seed))


def extract(page: str, model: Model) -> str:
    bs = readable(page)
    return " ".join(b.text for b, main in zip(bs, model.decode(bs), strict=True) if main)


def _run(weights: dict, start: list, moves: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights, start, moves)
        for batch in batches:
            texts = [extract(p or "", model) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def html_extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""
    ship(pages.sparkSession)
    m = model or default_model()
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_run(m.weights, m.start, m.moves), "page_id long, url string, text string, n_chars long")
