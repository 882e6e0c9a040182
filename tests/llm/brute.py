"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
EDGE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def line_dedup(rows):
    """rows: (doc_id, text) -> {doc_id: (n_lines, n_dropped, kept text)}"""
    where = defaultdict(set)
    key = lambda line: line.strip(EDGE).translate(LOWER)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                where[key(line)].add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(where.get(key(x), ())) >= 5 and max(where[key(x)]) != d)]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def measures(t):
    w = WORD.findall(t or "")
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), dup, len(covered)


def labelled(t):
    w = WORD.findall(t or "") or [""]
    seen, out = Counter(), []
    for k in (tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))):
        out.append((k, seen[k]))
        seen[k] += 1
    return out


def similarity(a, b):
    at, chain = {k: i for i, k in enumerate(b)}, []
    for k in a:
        if k in at:
            x = bisect_left(chain, at[k])
            chain[x : x + 1] = [at[k]]
    return len(chain) / (len(a) + len(b) - len(chain))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def near_copies(a, b, threshold=0.8):
    """Edit similarity of the words, or the ordered Jaccard similarity of labelled 5-word k-mers."""
    x, y = WORD.findall(a or ""), WORD.findall(b or "")
    n = max(len(x), len(y))
    if n and min(len(x), len(y)) < threshold * n - 1e-9:
        return False
    return similarity(labelled(a), labelled(b)) >= threshold - 1e-12 or not n or distance(x, y) <= (1 - threshold) * n + 1e-9


def near_groups(rows, threshold=0.8, met=lambda a, b: True):
    """Components of the links among pairs of ids that ``met`` lets through."""
    of, parent = dict(rows), {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(of)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if met(a, b) and near_copies(of[a], of[b], threshold):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}
