"""Findings of the first review against brute force."""

import random

import numpy as np

from palimpsest.llm import neardup


def test_edited_copies_of_a_common_text_meet(spark):
    rng = random.Random(31)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = text(400)
    rows = [(i, " ".join(base)) for i in range(100)] + [(1000 + i, " ".join(text(400))) for i in range(140)]
    for i in range(60):
        w = list(base)
        for at in rng.sample(range(400), 4 + i % 4):
            w[at] = f"edit{rng.randrange(10**6)}"
        rows.append((2000 + i, " ".join(w)))
    words = neardup.Words()
    sh = [neardup.shingles(t, words) for _, t in rows]
    table = np.zeros(neardup.TABLE, np.int64)
    for h, _ in sh:
        table[h & np.uint32(neardup.TABLE - 1)] += 1
    idf = neardup.frequencies(table, len(sh))
    weight = [idf[h & np.uint32(neardup.TABLE - 1)] * c for h, c in sh]
    linked = {d for (d, _), s, w in zip(rows, sh, weight) if neardup.similarity(sh[0], s, weight[0], w) >= 0.8}
    assert len([d for d in linked if d >= 2000]) >= 40
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert linked <= set(got.loc[got["class_id"] == 0, "doc_id"])
