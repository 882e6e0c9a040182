import random

import pytest

pytest.importorskip("lodestrata.llm")
import public_tokenizers  # noqa: E402

import corpus_pipeline  # noqa: E402
from lodestrata.llm import byte_bpe  # noqa: E402

from . import brute  # noqa: E402


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 8)))
    shared = " ".join(word() for _ in range(10))
    rows = []
    for i in range(160):
        lines = [" ".join(word() + ("***" if i % 8 == 0 else "") for _ in range(40)) for _ in range(2)]
        if i % 3 == 0:
            lines.append(shared)
        if i % 10 == 9:
            lines = [rows[-5][1].replace("a", "b", 1)]
        rows.append((i, "\n".join(lines)))
    rows += [(160, "too short"), (161, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d % 8 > 0), 0) for d, _ in rows[:120] if d % 10 != 9], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    kept = [(d, t) for d, t in rows if brute.measures(t)[0] >= 50 and "***" not in t]
    lines = brute.line_dedup(kept)
    kept = [(d, lines[d][2]) for d, _ in kept]
    groups = brute.near_groups(kept)
    kept = {d: t for d, t in kept if groups[d] == d}
    b = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"]: x["doc_tokens"] for x in got} == {d: len(b.whole(t)) // 4 + 1 for d, t in kept.items()}
    assert sum(x["length"] for x in got) == sum(len(b.whole(t)) // 4 + 1 for t in kept.values())
    assert 100 < len(kept) < 135
