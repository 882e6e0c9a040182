import itertools
import json
import random
import re
import struct
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import xxhash

pytest.importorskip("lodestrata.llm")
import public_tokenizers  # noqa: E402

from lodestrata.llm import byte_bpe, chat_format, fingerprints, html_blocks, html_extract, html_pages, line_dedup, lm_scores, near_dedup, packing, piece_bpe, quality_rules, token_counts  # noqa: E402

from . import brute  # noqa: E402

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, row long, keeper string, b_drops_ string"


def corpus(n=60, seed=5):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 8))) for _ in range(400)]
    common = [" ".join(r.choice(words) for _ in range(12)) for _ in range(4)]
    rows = []
    for i in range(n):
        lines = [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 9))]
        if r.random() < 0.5:
            lines.insert(r.randint(0, len(lines)), r.choice(["", " ", "\t"]) + r.choice(common).upper())
        if rows and r.random() < 0.3:
            w = r.choice(rows)[1].split(" ")
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            lines = [" ".join(w)]
        rows.append((i, "\n".join(lines)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, rows[0][1]), (n + 4, "one two"), (n + 5, "x " * 30_000)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows):
    """Documents with extra columns whose names clash with what operators use inside."""
    return spark.createDataFrame([(d, t, "en", 1, "k", "b") for d, t in rows], SCHEMA)


def test_line_dedup(spark, rows):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == brute.line_dedup(rows)
    assert sum(x[1] for x in got.values()) > 5


def test_line_dedup_repeated_and_null_ids(spark):
    line = "The same long line of more than forty characters, again."
    rows = [(i, line) for i in range(5)] + [(4, line), (None, line), (None, line + "\nother")]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["kept_text"]) for r in line_dedup.line_dedup(frame(spark, rows)).collect())
    assert got == [(-1, ""), (-1, "other"), (0, ""), (1, ""), (2, ""), (3, ""), (4, line), (4, line)]


def test_quality_measures(spark, rows):
    extra = [(100, "a b c a b c a b c d"), (101, "a b c a b c"), (102, "a a a a a"), (103, "# $ | x\n# $ | x\n\n# $ | x ")]
    for r in quality_rules.measures(frame(spark, rows + extra)).select("doc_id", *quality_rules.BASE).collect():
        assert tuple(r)[1:] == brute.measures(dict(rows + extra)[r["doc_id"]])


def test_quality_rules_learn(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    text = lambda bad: " ".join(word() + ("###" if bad and r.random() < 0.8 else "") for _ in range(80))
    docs = [(i, text(i % 5 == 0)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x["kept"] for x in quality_rules.quality_rules(frame(spark, docs), labels).collect()}
    assert sum(out[i] == (i % 5 > 0) for i, _ in docs) >= 396
    none = quality_rules.quality_rules(frame(spark, docs[:6]), labels.where("1 = 0"))
    assert all(x["kept"] for x in none.collect())


def test_quality_verdict_against_brute_force(spark, rows):
    """The emitted expression is the learned list, read in plain Python over brute-force measures."""
    r = random.Random(31)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    kinds = [lambda w: w, lambda w: w[3:] + "###"[: len(w)], lambda w: w + w + w + w]
    docs = [(i, "\n".join(" ".join(kinds[i % 7 % 3 if i % 7 < 3 else 0](r.choice(words)) for _ in range(30)) for _ in range(r.randint(2, 4)))) for i in range(300)]
    docs += [(1000 + d, t) for d, t in rows] + [(5, docs[5][1]), (None, docs[6][1])]
    labels = spark.createDataFrame([(i, int(i % 7 % 3 == 0 or i % 7 > 2), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    learned = quality_rules.fit(frame(spark, docs), labels)
    assert len({c[0] for x in learned.rules for c in x.conditions}) > 1
    got = quality_rules.judge(frame(spark, docs), learned).collect()
    assert len(got) == len(docs)
    for x in got:
        failed = x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]
        rule = next((i for i, y in enumerate(learned.rules, 1) if all((x[f] > at) == above for f, above, at in y.conditions)), 0)
        assert (x["base_failed"], x["rule"], x["kept"]) == (failed, rule, not failed and not rule)
    base = sorted((x["doc_id"] or -1, x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) for x in got)
    assert base == sorted((d or -1, *brute.measures(t)) for d, t in docs)


def test_decision_list_prefers_first_rule():
    grid = {c: [0.0, 1.0] for c in quality_rules.FEATURES}
    cell = lambda k, *n: (k, 0, 0, 0, 0, 0, 0, *n)
    rules = quality_rules.learn([cell(0, 90, 0, 45, 0), cell(2, 0, 40, 0, 20)], grid).rules
    assert [x.conditions for x in rules] == [(("symbol_share", True, 0.5),)]


def sketches(text):
    words = np.array([xxhash.xxh64_intdigest(w.encode(), seed=42) for w in brute.WORD.findall(text or "")], np.uint64)
    return set(near_dedup.sketch(near_dedup.kmers(words.view(np.int64))).tolist())


def check_groups(rows, got):
    """Exactly the components of verified candidates; and none of the pairs of k-mer similarity 0.8 or more is lost."""
    of = {d: sketches(t) for d, t in rows}
    assert got == brute.near_groups(rows, met=lambda a, b: bool(of[a] & of[b]))
    grams = {d: brute.labelled(t) for d, t in rows}
    for a, b in itertools.combinations(grams, 2):
        if 0.8 * len(grams[a]) <= len(grams[b]) <= 1.25 * len(grams[a]) and brute.similarity(grams[a], grams[b]) >= 0.8:
            assert got[a] == got[b]


def test_near_groups(spark, rows):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(frame(spark, rows)).collect()}
    check_groups(rows, got)
    assert len(set(got.values())) < len(got) - 5


def test_near_groups_chain_and_large_bucket(spark, monkeypatch):
    """Members far from the smallest id are still linked to each other, over blocks and slices."""
    r = random.Random(8)
    base = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 30)):
            w[r.randrange(120)] = f"e{r.random()}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dedup, "BLOCK_WORDS", 2000)
    monkeypatch.setattr(near_dedup, "SLICE_PAIRS", 7)
    check_groups(rows, {x["doc_id"]: x["class_id"] for x in near_dedup.near_groups(frame(spark, rows)).collect()})


def test_near_groups_of_shared_passages(spark):
    """Texts that share a passage and little else, of many lengths, stay apart; copies among them are found."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, f"{passage} " + " ".join(word() for _ in range(r.randint(30, 120)))) for i in range(60)]
    rows += [(60 + i, rows[3 * i][1].replace("a", "e", 2)) for i in range(15)]
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_groups(frame(spark, rows)).collect()}
    check_groups(rows, got)
    assert len(set(got.values())) == 60


def test_near_groups_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text + " more"), (3, "other words of another text here"), (3, text + " and"), (None, text), (None, "nobody has this one")]
    got = sorted((x["doc_id"] or -1, x["class_id"] or -1) for x in near_dedup.near_groups(frame(spark, rows)).collect())
    assert got == [(-1, -1), (-1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (3, 3)]


def test_banded_distance():
    r = random.Random(9)
    for _ in range(4000):
        a = [r.randint(0, r.choice([2, 9])) for _ in range(r.randint(0, 40))]
        b = list(a) if r.random() < 0.7 else [r.randint(0, 9) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 9)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 2)] = [r.randint(0, 9)] * r.randint(0, 2)
        for most in (0, 1, 2, 5, 9, 50):
            assert near_dedup.within(a, b, most) == (brute.distance(a, b) <= most), (a, b, most)


def test_near_dedup_keeps_one(spark, rows):
    of = {d: sketches(t) for d, t in rows}
    kept = {r["doc_id"] for r in near_dedup.near_dedup(frame(spark, [*rows, (None, "some text")])).collect()}
    assert kept == {*brute.near_groups(rows, met=lambda a, b: bool(of[a] & of[b])).values(), None}


def test_aligned_keeps_order():
    import numpy as np

    a = near_dedup.kmers(np.arange(100, dtype=np.int64))
    assert near_dedup.aligned(a, a) == 1.0
    assert near_dedup.aligned(a, np.concatenate([a[48:], a[:48]])) == 0.0
    assert near_dedup.aligned(a, a[:77]) == 0.8020833333333334


def test_byte_bpe_matches_library(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHED", 200)
    r = random.Random(2)
    texts = ["".join(r.choice("ab 's're\n\t  é²1.!#ŁªIt漢'\xa0") for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["", "a<|endoftext|> b"]
    b = byte_bpe.ByteBpe(BYTE)
    assert b.encode_many(texts) == [b.whole(t) for t in texts]


def test_packing(spark, rows):
    b = byte_bpe.ByteBpe(BYTE)
    ids = {d: b.whole(t or "") + b"\0\0\0\0" for d, t in rows}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in packing.packing(frame(spark, rows), BYTE).collect():
        piece = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert (zlib.crc32(piece), len(ids[r["doc_id"]]) // 4) == (r["ids_crc32"], r["doc_tokens"])
        docs[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {d: sum(n for _, n in p) for d, p in docs.items()} == {d: len(x) // 4 for d, x in ids.items()}
    for group in (*docs.values(), *sequences.values()):
        at = 0
        for start, n in sorted(group):
            assert start == at
            at += n
    used = [sum(n for _, n in s) for s in sequences.values()]
    assert all(n <= 1024 and n & (n - 1) == 0 for n in used)


def test_packing_repeated_and_null_ids(spark):
    b = byte_bpe.ByteBpe(BYTE)
    rows = [(1, "a b c"), (1, "a b c"), (1, "other words"), (None, "no id"), (None, None), (2, "long text " * 3000)]
    got = packing.packing(frame(spark, rows), BYTE).collect()
    want = defaultdict(int)
    for d, t in rows:
        want[d] += len(b.whole(t or "")) // 4 + 1
    sums = defaultdict(int)
    for r in got:
        sums[r["doc_id"]] += r["length"]
    assert sums == want
    whole = [zlib.crc32(b.whole(t or "") + b"\0\0\0\0") for d, t in rows if d != 2]
    cut = [r["ids_crc32"] for r in got if r["doc_id"] != 2 and r["length"] == r["doc_tokens"]]
    assert set(cut) <= set(whole)


def test_packing_plan_is_within_the_histogram():
    r = random.Random(1)
    h = [0] + [r.randint(0, 30) for _ in range(1023)]
    used, offsets = [0] * 1024, defaultdict(int)
    for length, lo, hi, seq, offset in packing.plan(h):
        assert lo == used[length]
        used[length] = hi
        for s in range(seq, seq + hi - lo):
            offsets[s] += length
            assert offset < 1024
    assert all(u <= n for u, n in zip(used, h, strict=True)) and set(offsets.values()) == {1024}
    assert sum(used) > 0.8 * sum(h)


def test_sentencepiece(spark, rows):
    library = piece_bpe.load(PIECE).library
    got = {r["doc_id"]: r for r in piece_bpe.encode(frame(spark, rows), PIECE).collect()}
    for d, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert (got[d]["n_tokens"], bytes(got[d]["ids"]), got[d]["decoded"]) == (len(ids), struct.pack(f"<{len(ids)}I", *ids), library.decode(ids))
        assert got[d]["agrees"]


def test_sentencepiece_odd_texts(monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHED", 100)
    r = random.Random(1)
    b = piece_bpe.PieceBpe(PIECE)
    texts = ["".join(r.choice("ab e\n\t\r  ▁é漢😀\x00\x07<s></s>123 the ing　\xa0") for _ in range(r.randint(0, 40))) for _ in range(2000)]
    ids, agrees = b.encode_many(texts)
    assert ids == [struct.pack(f"<{len(x)}I", *x) for x in b.library.encode(texts)] and all(agrees) and not b.differ


def test_sentencepiece_repeated_null_ids_and_long_texts(spark):
    library = piece_bpe.load(PIECE).library
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "x y"), (None, None), (2, "long text\n" * 60_000), (3, "x" * 20_000)]
    got = sorted((x["doc_id"] or -1, x["n_tokens"], x["decoded"]) for x in piece_bpe.encode(frame(spark, rows), PIECE).collect())
    assert got == sorted((d or -1, len(library.encode(t or "", add_bos=True, add_eos=True)), library.decode(library.encode(t or ""))) for d, t in rows)


def test_sentencepiece_other_normalisers(monkeypatch):
    """A model whose normaliser changes text is told from its settings; its ids are the library's."""
    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    spec = lambda **x: field(2, b"") + field(3, field(1, b"nmt") + b"".join(bytes([int(k[1:]) << 3, v]) for k, v in x.items()))
    assert piece_bpe.keeps_text(spec(f3=1, f4=0)) and not piece_bpe.keeps_text(spec()) and not piece_bpe.keeps_text(spec(f3=0, f4=0))
    assert not piece_bpe.keeps_text(field(3, field(2, b"map") + bytes([4 << 3, 0])))
    b = piece_bpe.PieceBpe(PIECE)
    assert b.own
    monkeypatch.setattr(b, "own", False)
    ids, agrees = b.encode_many(["a b", ""])
    assert ids[0] == struct.pack(f"<{len(b.library.encode('a b'))}I", *b.library.encode("a b")) and ids[1] == b"" and agrees == [False, False]


def edited(text, edits):
    for start, length, insert in edits:
        start = min(max(start, 0), len(text))
        text = text[:start] + (insert or "") + text[start + max(length, 0) :]
    return text


def check_trees(trees, texts, b):
    for t, text in zip(trees, texts, strict=True):
        assert (t.text, t.chars[1], t.tokens[1]) == (text, len(text), len(b.whole(text)) // 4)
        assert all(x[i] == x[2 * i] + x[2 * i + 1] for x in (t.chars, t.tokens) for i in range(1, t.size))
        at = 0
        for leaf in range(t.size):  # every leaf counts its own text
            n = t.chars[t.size + leaf]
            assert t.tokens[t.size + leaf] == len(b.whole(text[at : at + n])) // 4
            at += n


def test_segment_trees_follow_edits():
    b = byte_bpe.ByteBpe(BYTE)
    r = random.Random(3)
    bits = ["ab", "'", "s", "re", " ", "  ", "\n", "\n\n", "12", ".", "é", "word ", "Жук ", "日本", "。", "😀", "\xa0", "<|endoftext|>", "<|endof"]
    some = lambda k: "".join(r.choice(bits) for _ in range(r.randint(0, k)))
    texts = [some(r.choice([5, 50, 600])) for _ in range(600)]
    trees = [token_counts.Tree(*x[:3]) for x in token_counts.grow(pa.array(texts), b)]
    check_trees(trees, texts, b)
    for _ in range(2):  # a tree that was edited is edited again
        for i, tree in enumerate(trees):
            for _ in range(3):
                e = (r.randint(0, len(texts[i]) + 5), r.randint(0, r.choice([3, 100])), some(r.choice([3, 400])))
                tree.edit(*e, b)
                texts[i] = edited(texts[i], [e])
        token_counts.recount(trees, b)
        check_trees(trees, texts, b)


def test_token_counts(spark, rows):
    b = byte_bpe.ByteBpe(BYTE)
    edits = spark.createDataFrame([(0, 2, 3, 4, "x"), (0, 1, 10**9, 5, " end"), (7, 1, -3, -1, None), (-9, 1, 0, 0, "no"), (None, 1, 0, 0, "no")], "doc_id long, seq int, start long, length long, insert string")
    got = {x["doc_id"]: x for x in token_counts.token_counts(frame(spark, rows), edits, BYTE).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        after = edited(t or "", {0: [(10**9, 5, " end"), (3, 4, "x")]}.get(d, []))
        assert (got[d]["n_tokens"], got[d]["edited_tokens"]) == (len(b.whole(t or "")) // 4, len(b.whole(after)) // 4)
    assert got[0]["n_reencoded"] < got[0]["n_pretokens"] + 70
    assert all(got[d]["n_reencoded"] == 0 for d, _ in rows if d not in (0, 7))


def test_kept_trees(spark, rows, tmp_path):
    """Trees are written, edited from the table, and edited again; repeated rows and rows without an id are trees of their own."""
    b = byte_bpe.ByteBpe(BYTE)
    some = [*rows[:20], (3, rows[3][1]), (3, "other"), (None, "no id"), (None, "no id")]
    token_counts.build_trees(frame(spark, some), BYTE).write.parquet(f"{tmp_path}/trees")
    texts = [t or "" for _, t in some]
    for k in range(2):
        trees = spark.read.parquet(f"{tmp_path}/trees{k or ''}")
        out = token_counts.apply_edits(trees, BYTE, token_counts.standard_edits(trees["text"]))
        out.withColumn("n_pretokens", out["n_pretokens"]).write.parquet(f"{tmp_path}/trees{k + 1}")
        texts = [edited(t, [(len(t) // 3, 7, ""), (len(t) // 2, 0, t[:24]), (2 * len(t) // 3, 5, " edited, ")]) for t in texts]
        got = sorted((x["text"], x["edited_tokens"], x["tokens"][1]) for x in spark.read.parquet(f"{tmp_path}/trees{k + 1}").collect())
        assert got == sorted((t, len(b.whole(t)) // 4, len(b.whole(t)) // 4) for t in texts)


def test_fingerprints(spark, rows):
    from collections import Counter

    got = {r["doc_id"]: r for r in fingerprints.fingerprints(frame(spark, rows)).collect()}
    texts = [t or "" for _, t in rows]

    def like(a, b):
        x, y = Counter(fingerprints.paragraphs(a)), Counter(fingerprints.paragraphs(b))
        m = sum((x & y).values())
        return m / (sum(x.values()) + sum(y.values()) - m)

    for i, (d, _) in enumerate(rows):
        t, following = texts[i], texts[(i + 1) % len(texts)]
        e = fingerprints.edited(t, following)
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(t), brute.sha(e))
        assert got[d]["near_next"] == pytest.approx(like(t, following)) and got[d]["near_edited"] == pytest.approx(like(t, e))
    assert len({got[d]["fingerprint"] for d, _ in rows}) == len(set(texts))


def test_fingerprints_ties_and_single_row(spark):
    one = fingerprints.fingerprints(frame(spark, [(3, "abcd")])).collect()[0]
    assert one["edited_sha256"] == brute.sha("abab") and one["near_next"] == 1.0
    got = fingerprints.fingerprints(frame(spark, [(1, "b2"), (1, "a1"), (None, "n"), (None, None)])).collect()
    assert sorted(r["edited_sha256"] for r in got) == sorted(map(brute.sha, ["", "n", "ab", "b"]))  # None, n, a1, b2, and again None


def test_lm_scores(spark, rows):
    from collections import Counter
    from math import log

    words = {d: brute.WORD.findall(t or "") for d, t in rows}
    one, two = Counter(w for x in words.values() for w in x), Counter(p for x in words.values() for p in zip(x, x[1:]))
    n = sum(one.values())
    for r in lm_scores.lm_scores(frame(spark, rows)).collect():
        x, s = words[r["doc_id"]], 0.0
        for i, w in enumerate(x):
            c = two[x[i - 1], w] if i else 0
            s += log(one[w] / n) if not i else log(c / one[x[i - 1]]) if c >= 2 else log(0.4 * one[w] / n)
        assert r["n_words"] == len(x) and r["log_score"] == pytest.approx(s) and (r["mean_log_score"] is None) == (not x)


def test_lm_scores_of_repeated_rows_null_ids_and_one_hot_pair(spark):
    from collections import Counter
    from math import log

    texts = ["a b c", None, "", " \n\t ", "x\ny x\x0by", "7\n8 9", "hot pair " * 3000, "a b"]
    rows = [(i if i % 3 else None, t) for i, t in enumerate(texts)] + [(5, "7\n8 9"), (5, "7\n8 9"), (5, "other"), (None, "a b c")]
    words = [brute.WORD.findall(t or "") for _, t in rows]
    one, two = Counter(w for x in words for w in x), Counter(p for x in words for p in zip(x, x[1:]))
    n = sum(one.values())
    for least in (1, 2, 3):
        want = []
        for (d, _), x in zip(rows, words, strict=True):
            c = [two[p] for p in zip(x, x[1:])]
            s = sum(log(k / one[v]) if k >= least else log(0.4 * one[w] / n) for k, v, w in zip(c, x, x[1:]))
            want.append((str(d), len(x), sum(k < least for k in c), round(s + (log(one[x[0]] / n) if x else 0.0), 6)))
        got = lm_scores.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), min_pairs=least).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_backoff"], round(r["log_score"], 6)) for r in got) == sorted(want)


def test_lm_scores_deletes_what_each_job_exchanged(spark, monkeypatch):
    from time import sleep

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def exchanged():
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_") and n.endswith(".data")}

    before, keep, left = exchanged(), lm_scores.materialise, []

    def kept(df, name):
        out = keep(df, name)
        for _ in range(100):
            if not exchanged() - before:
                break
            sleep(0.1)
        left.append((name, len(exchanged() - before)))
        return out

    monkeypatch.setattr(lm_scores, "materialise", kept)
    got = lm_scores.lm_scores(frame(spark, [(1, "\x0b\x0cf a f\r"), (2, "f a\tf"), (3, "\x0b"), (4, None)])).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_backoff"]) for r in got) == [(1, 3, 0), (2, 3, 0), (3, 0, 0), (4, 0, 0)]
    assert left == [("lm_pairs", 0), ("lm_scores", 0)]


def test_html_model_on_held_out_pages():
    model, wrong, total = html_extract.default_model(), 0, 0
    for page in html_pages.labelled_pages(150, 99):
        bs, labels = html_extract.labelled(page)
        wrong += sum(a != b for a, b in zip(labels, model.decode(bs), strict=True))
        total += len(labels)
    assert wrong < 0.01 * total


def test_viterbi_finds_the_best_labels():
    from itertools import product

    from lodestrata.llm.html_blocks import ROOT, Block

    r = random.Random(4)
    for _ in range(50):
        m = html_extract.Model({"bias": r.uniform(-2, 2), "stop": r.uniform(-3, 3), "words=1": r.uniform(-3, 3)}, [0.1, -0.2], [[r.uniform(-1, 1) for _ in range(2)] for _ in range(2)])
        bs = [Block(ROOT, text=r.choice(["a.", "a b c", "x"])) for _ in range(6)]
        score = lambda ys: m.start[ys[0]] + sum(m.emission(b) for b, y in zip(bs, ys, strict=True) if y) + sum(m.moves[a][b] for a, b in zip(ys, ys[1:]))  # noqa: B023, E731
        assert score(m.decode(bs)) == pytest.approx(max(map(score, product((0, 1), repeat=6))))


def test_html_extract(spark):
    page = '<html><head><title>T</title><script>x="</p>"</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy now.</div><article><h1>A &amp; B</h1><p>First<br>line <b>bo</b>ld,\n  and more words of the text.<p>Second &copy; one is here, too, with words.</article><section class="comments"><h2>Comments</h2><p>I like this very much.</p></section><footer>&copy; me</footer>'
    rows = spark.createDataFrame([(1, "u", page, 0), (2, None, None, 0), (3, "v", "", 0), (1, "u", page, 0)], "page_id long, url string, html string, text int")
    got = sorted(html_extract.html_extract(rows).collect())
    assert [r["text"] for r in got] == ["A & B First line bold, and more words of the text. Second © one is here, too, with words."] * 2 + ["", ""]
    assert got[0]["n_chars"] == len(got[0]["text"])


@pytest.mark.parametrize("body", ["<body>", ""])
def test_html_head_without_end_tag(body):
    article = "<article><h1>A</h1><p>First line of words, and more words of the text.<p>Second one is here, too, with words.</article>"
    whole, model = f"<html><head><title>T</title></head>{body}{article}", html_extract.default_model()
    assert html_extract.extract(whole, model) != ""
    assert html_extract.extract(whole.replace("</head>", ""), model) == html_extract.extract(whole, model)
    assert [b.text for b in html_extract.readable("<head><title>a <b> c</title>plain words<p>more")] == ["plain words", "more"]


def test_html_keeps_text_of_math_svg_and_canvas():
    page = "<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><svg><title>Plot</title><text>axis</text></svg> <canvas>no picture</canvas></article>"
    assert " ".join(b.text for b in html_extract.readable(page)) == "so x=2 holds Plot axis no picture"


MESSY = [
    "<script>for(var i=0;i<n;i++){x(i)}</script>",
    "<script>if (a<b && c>d) { s = 'it\\'s'; }</script>",
    "<script>s = '<!-- not closed';</script>",
    "<script type=x>t = \"<p>no text</p><script\"</script >",
    "<style>a>b::before{content:'<'} p{}</style>",
    "<script src='a.js'>",
    "<!-- open <b>",
    "<!---->",
    "<!-- a --!>",
    "<SCRIPT>document.write('<article>')</SCRIPT>",
    "<noscript><img src=x></noscript>",
    "<template><p>not shown</p></template>",
    "<p class=it's></p>",
    "<br title='a > b'/>",
    "<?php if (1) ?>",
]


@pytest.mark.parametrize("messy", MESSY)
def test_html_messy_markup_loses_no_text(messy):
    article = "<article><h1>A title</h1><p>First line of words, and more words of the text.<p>Second one is here, too, with words.</article>"
    whole = f"<html><head><title>T</title></head><body>{article}<footer>&copy; me</footer></body></html>"
    model, want = html_extract.default_model(), ["A title", "First line of words, and more words of the text.", "Second one is here, too, with words.", "© me"]
    for page in (whole.replace("<body>", "<body>" + messy), whole.replace("<p>Second", messy + "<p>Second")):
        assert [b.text for b in html_extract.readable(page)] == want
        assert html_extract.extract(page, model) == " ".join(want[:3])


class Walk(HTMLParser):
    """A plain walk over a page's nodes, by the standard library's parser: text between block borders."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.off = [], [], 0

    def cut(self):
        text = " ".join("".join(self.now).split())
        self.out += [text] if text else []
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now.append(" ")
        if tag in html_blocks.BLOCK or tag in ("head", "body"):
            self.cut()
        self.off += tag in ("head", "script", "style", "template", "iframe")

    def handle_endtag(self, tag):
        if tag in html_blocks.BLOCK or tag in ("head", "body"):
            self.cut()
        self.off -= tag in ("head", "script", "style", "template", "iframe")

    def handle_data(self, data):
        if not self.off:
            self.now.append(data)


def test_html_blocks_against_a_plain_walk():
    r = random.Random(6)
    clean = [m for m in MESSY if m not in ("<script src='a.js'>", "<!-- open <b>", "<!-- a --!>")]
    for page in html_pages.labelled_pages(200, 41):
        for _ in range(3):
            at = page.find("</p>", r.randint(0, len(page)))
            if at > 0:
                page = page[: at + 4] + r.choice(clean) + page[at + 4 :]
        walk = Walk()
        walk.feed(page)
        walk.close()
        walk.cut()
        assert [b.text for b in html_extract.readable(page)] == walk.out


def test_html_main_text_of_made_pages():
    """Whole pages of known main text, messy ones among them, through the default model."""
    model, exact, pages = html_extract.default_model(), 0, html_pages.labelled_pages(200, 77)
    for i, page in enumerate(pages):
        bs, labels = html_extract.labelled(page)
        want = " ".join(b.text for b, y in zip(bs, labels, strict=True) if y)
        plain = page.replace(html_pages.MAIN, "").replace(html_pages.REST, "")
        at = plain.find("<body")
        at = plain.find(">", at) + 1 if at >= 0 else 0
        exact += html_extract.extract(plain[:at] + MESSY[i % 6] + plain[at:] if i % 2 else plain, model) == want
    assert exact >= 190


def test_html_very_long_page_and_ids(spark):
    paragraph = "<p>Words of a very long article, line after line of it.</p>"
    page = f"<body><nav><a href=x>Home</a></nav><article>{paragraph * 20_000}</article>"
    rows = spark.createDataFrame([(None, "u", page), (None, "u", page), (7, None, "<p")], "page_id long, url string, html string")
    got = sorted(html_extract.html_extract(rows).collect(), key=lambda x: -x["n_chars"])
    assert [x["n_chars"] for x in got[:2]] == [20_000 * (len(paragraph) - 6) - 1] * 2 and got[2]["page_id"] == 7


CHAT = "conv_id long, turn long, kind string, role string, text string, call_id string, name string, arguments string, after array<string>, place string"


def chat(spark, rows, schemas):
    return {r["conv_id"]: r for r in chat_format.format_chats(spark.createDataFrame([(*r, "x") for r in rows], CHAT), schemas).collect()}


def test_chat_linking(spark):
    import json

    schema = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"enum": ["x", "y"]}}}}
    rows = [
        (1, 0, "message", "user", 'hé "q"\n', None, None, None, None),
        (1, 1, "result", "tool", "4", "c1", None, None, None),  # before its call
        (1, 2, "call", "assistant", None, "c1", "add", '{"b": "x",  "a": 1}', None),
        (1, 3, "call", "assistant", None, "c2", "add", '{"a": -1}', ["c3"]),  # needs a later call
        (1, 4, "call", "assistant", None, "c3", "other", '{"z": {"k": 1, "b": [1, 2]}}', []),
        (1, 5, "result", "tool", "r", "c3", None, None, None),
        (1, 6, "call", "assistant", None, "c1", "add", "no json", None),  # duplicate id
        (1, 7, "result", "tool", "lost", "c9", None, None, None),
        (2, 0, "call", "assistant", None, "a", "x", "{}", ["b"]),
        (2, 1, "call", "assistant", None, "b", "x", "{}", ["a"]),
        (None, None, None, None, None, None, None, None, None),
    ]
    got = chat(spark, rows, schema)
    out = json.loads(got[1]["chat"])
    assert [(m["turn"], m.get("id")) for m in out] == [(0, None), (2, "c1"), (1, "c1"), (4, "c3"), (5, "c3"), (3, "c2"), (6, "c1"), (7, "c9")]
    assert got[1]["chat"].startswith('[{"content":"hé \\"q\\"\\n","role":"user","turn":0},{"arguments":{"a":1,"b":"x"},"id":"c1","name":"add","role":"assistant","turn":2}')
    assert out[3]["arguments"] == {"z": {"b": [1, 2], "k": 1}} and out[6]["arguments"] == "no json"
    faults = ["n_messages", "n_linked", "n_unanswered", "n_orphans", "n_duplicates", "n_invalid", "n_cyclic"]
    assert [got[1][c] for c in faults] == [8, 2, 1, 1, 1, 2, 0]
    assert [got[2][c] for c in faults] == [2, 0, 2, 0, 0, 0, 2]
    assert got[None]["chat"] == '[{"content":"","role":"","turn":-1}]'


def plain_order(rows):
    """Positions by a plain walk: (place, depth) of each row, cyclic ones at their turns; rows of one conversation."""
    first = {}
    for i, x in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        if x[2] == "call":
            first.setdefault(x[5], i)
    needs = defaultdict(set)
    for i, x in enumerate(rows):
        if x[2] == "result" and x[5] in first:
            needs[i].add(first[x[5]])
        if x[2] == "call":
            for c in set(x[8] or ()) & set(first):
                needs[i].add(first[c])
                needs[i].update(j for j, y in enumerate(rows) if y[2] == "result" and y[5] == c)
    at = {}
    while True:
        new = [i for i in range(len(rows)) if i not in at and all(j in at for j in needs[i])]
        if not new:
            break
        settled = {}
        for i in new:
            last = max((at[j] for j in needs[i]), default=(-9, 0))
            place = max(rows[i][1], last[0])
            settled[i] = (place, last[1] + 1 if place == last[0] else 0)
        at |= settled
    return [at.get(i, (x[1], 0)) for i, x in enumerate(rows)], len(rows) - len(at)


def test_chat_order_of_random_graphs(spark):
    r = random.Random(12)
    rows = []
    for conv in range(60):
        n, straight = r.randint(1, 14), r.random() < 0.3
        for turn in range(n):
            name = f"c{turn if straight else r.randint(0, n)}"
            kind = r.choice(["call", "call", "result", "message"])
            after = [f"c{r.randint(0, max(0, turn - 1) if straight else n)}" for _ in range(r.randint(0, 2))]
            rows.append((conv, turn, kind, "x", f"t{turn}", name, "f", "{}", after))
    got = chat(spark, rows, {})
    moved = cyclic = 0
    for conv in range(60):
        mine = [x for x in rows if x[0] == conv]
        at, n_cyclic = plain_order(mine)
        order = sorted(range(len(mine)), key=lambda i: (*at[i], mine[i][1]))
        assert [m["turn"] for m in json.loads(got[conv]["chat"])] == [mine[i][1] for i in order]
        assert got[conv]["n_cyclic"] == n_cyclic
        moved += order != list(range(len(mine)))
        cyclic += n_cyclic > 0
    assert moved > 10 and cyclic > 3


def test_chat_long_chain_and_text_ids(spark):
    """A thousand dependent calls in turn order need no rounds; ids of conversations may be texts."""
    rows = [("a", i, "call", "x", "", f"c{i}", "f", "{}", [f"c{i - 1}"], "p") for i in range(1000)] + [("b", 0, "message", "x", "long " * 100_000, None, None, None, None, "p")] * 2
    schema = CHAT.replace("conv_id long", "conv_id string")
    got = {x["conv_id"]: x for x in chat_format.format_chats(spark.createDataFrame(rows, schema), {}).collect()}
    assert [m["turn"] for m in json.loads(got["a"]["chat"])] == list(range(1000)) and got["a"]["n_cyclic"] == 0
    assert got["b"]["n_messages"] == 2 and len(got["b"]["chat"]) > 1_000_000


def meets(v, schema):
    """JSON Schema in plain Python, for the keywords that are supported."""
    if isinstance(schema, bool):
        return schema
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    is_a = {"string": isinstance(v, str), "number": number, "integer": number and v == int(v), "boolean": isinstance(v, bool), "object": isinstance(v, dict), "array": isinstance(v, list), "null": v is None}
    same = lambda a, b: a == b and isinstance(a, bool) == isinstance(b, bool) and (a is None) == (b is None)
    s, t = schema, schema.get("type")
    ok = t is None or any(is_a[x] for x in (t if isinstance(t, list) else [t]))
    ok = ok and ("enum" not in s or any(same(v, x) for x in s["enum"])) and ("const" not in s or same(v, s["const"]))
    if isinstance(v, str):
        ok = ok and s.get("minLength", 0) <= len(v) <= s.get("maxLength", 10**9) and ("pattern" not in s or re.search(s["pattern"], v))
    if number:
        ok = ok and s.get("minimum", v) <= v <= s.get("maximum", v) and s.get("exclusiveMinimum", v - 1) < v < s.get("exclusiveMaximum", v + 1)
    if isinstance(v, list):
        ok = ok and s.get("minItems", 0) <= len(v) <= s.get("maxItems", 10**9) and all(meets(x, s.get("items", True)) for x in v)
    if isinstance(v, dict):
        ok = ok and set(s.get("required", ())) <= set(v) and s.get("minProperties", 0) <= len(v) <= s.get("maxProperties", 10**9)
        ok = ok and all(meets(x, s["properties"][k] if k in s.get("properties", {}) else s.get("additionalProperties", True)) for k, x in v.items())
    ok = ok and all(meets(v, x) for x in s.get("allOf", ())) and ("anyOf" not in s or any(meets(v, x) for x in s["anyOf"]))
    return bool(ok and ("oneOf" not in s or sum(meets(v, x) for x in s["oneOf"]) == 1) and ("not" not in s or not meets(v, s["not"])))


SCHEMAS = [
    {"properties": {"s": {"enum": [True, 1.5, "1", None, [1, {"b": 2, "a": 1}]]}}},
    {"properties": {"s": {"enum": [1]}, "n": {"const": False}}},
    {"properties": {"n": {"type": "integer", "exclusiveMinimum": 0, "maximum": 10**20}}},
    {"properties": {'q"k': {"type": "string", "pattern": "^a+$"}, "a.b[0]": {"type": ["null", "number"]}}, "additionalProperties": False},
    {"properties": {"o": {"type": "object", "required": ["x"], "properties": {"x": {"type": "array", "items": {"type": "object", "properties": {"y": {"minimum": 2}}}, "minItems": 1, "maxItems": 2}}}}},
    {"additionalProperties": {"anyOf": [{"type": "string", "minLength": 2}, {"type": "boolean"}]}, "minProperties": 1},
    {"properties": {"s": {"oneOf": [{"type": "number"}, {"exclusiveMaximum": 3, "type": "integer"}]}, "n": {"not": {"type": "null"}, "allOf": [{"maxLength": 3}]}}},
]
VALUES = [True, False, 1, 1.0, 1.5, "1", "", "aa", "ab", None, [1, {"a": 1, "b": 2}], [], [{"y": 2}, {"y": 1}], {"x": [{"y": 3}]}, {"x": []}, {"x": [{"z": 0}, {"y": 2.5}, 1]}, {}, 10**20, 10**25, -1, 0, 2]


def test_schemas_against_plain_validation(spark):
    from pyspark.sql import functions as F

    objects = [{}] + [{k: v} for k in ("s", "n", 'q"k', "a.b[0]", "o") for v in VALUES] + [{"s": 1, "n": "abcd"}, {"s": "zz", "z": True}]
    df = spark.createDataFrame([(json.dumps(o),) for o in objects], "a string")
    got = df.select("a", *[chat_format.valid(F.col("a"), s).alias(f"v{i}") for i, s in enumerate(SCHEMAS)]).collect()
    want = {json.dumps(o): [meets(o, s) for s in SCHEMAS] for o in objects}
    assert {x["a"]: list(x[1:]) for x in got} == want
    with pytest.raises(ValueError, match="multipleOf"):
        chat_format.valid(F.col("a"), {"properties": {"n": {"multipleOf": 2}}})


@pytest.mark.parametrize(("arguments", "ok"), [('{"s": "x"}', True), ('{"s": 1}', False), ("{}", False), ('{"s": "x", "t": 1}', True), ('{"s": ""}', False), ("[1]", False), ("nope", False), (None, False), ('{"s": "x", "n": 1.5}', True), ('{"s": "x", "n": true}', False), ('{"s": null}', False)])
def test_schema_checks(spark, arguments, ok):
    schema = {"required": ["s"], "properties": {"s": {"type": "string", "minLength": 1}, "n": {"type": "number"}}}
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(arguments,)], "a string").select(chat_format.valid(F.col("a"), schema)).first()[0] is ok


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        line_dedup.line_dedup(none),
        quality_rules.quality_rules(none, labels),
        near_dedup.near_groups(none),
        packing.packing(none, BYTE),
        piece_bpe.encode_digests(none, PIECE),
        token_counts.edited_counts(none, BYTE, lambda trees: trees),
        fingerprints.fingerprints(none),
        lm_scores.lm_scores(none),
        html_extract.html_extract(pages),
        chat_format.format_chats(chat_format.from_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")), {}),
    ):
        assert out.collect() == []
