"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import variants


def counted(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def neighbours(n):
    by = {}
    for w in n:  # words at one edit share a word with one deletion, or are one
        for x in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by.setdefault(x, set()).add(w)
    near = {w: set() for w in n}
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if b not in near[a] and one_edit(a, b)}
    return near


def expected(n):
    near = neighbours(n)
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def result(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def made(seed, words, docs=60):
    """Texts of few letters, with words that stand often and edits of them that stand seldom."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab\u00e9") for _ in range(rng.randint(7, 11))) for _ in range(words)]
    texts = []
    for d in range(docs):
        out = []
        for w in base:
            out += [w] * rng.choice([0, 1, 1, 12])
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(w))
                out.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abc") + w[i:], w[:i] + "d" + w[i + 1 :]]))
        texts.append((d, " ".join(out)))
    return [*texts, *((docs + k, "chainabc " * 2 + "chainabd " * 30 + "chainxbd " * 400) for k in range(3))]


@pytest.mark.parametrize("block", [8, 64, 16384])
def test_equals_all_pairs(spark, block):
    docs = made(block, 60)
    got = result(variants.variants(spark.createDataFrame(docs, "doc_id long, text string"), block=block))
    assert got == expected(counted(docs)) and any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


ODD = [(1, "Letters letters LETTERS lettersx letterss"), (2, None), (3, ""), (4, "lettersx letterss aaaaaaaa aaaaaaaaa aaaaaaaaa aaaaaaaa"), (4, "letters " * 40), (4, "letters " * 40), (None, "letters lettres lettres"), (5, "\u00c9t\u00e9\u00e9t\u00e9\u00d7 \u00c9t\u00e9\u00e9t\u00e9\u00d7 \u0130stanbul"), (6, ("x" * 30000 + " ") * 3), (7, ("x" * 29999 + " ") * 40), (8, "short run of a b c")]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(1), "form": F.lit(2), "block": F.lit(3)})
    assert result(variants.variants(docs)) == expected(counted(ODD))


def test_empty_table(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = result(variants.variants(docs, block=500))
    assert got == expected(counted([(r.doc_id, r.text) for r in docs.collect()])) and len(got) > 500


def test_crowded_blocks_are_parted(spark):
    """All words share what precedes the split: askers of one block go to several tasks."""
    words = sorted({f"aaaaaaa{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"})
    n = {w: 2 + 30 * (k % 50 == 0) for k, w in enumerate(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {(r.word, r.n_near, r.form_n, r.form) for r in variants.near(df, 8).collect()}
    near = neighbours(n)
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    assert got == {(w, len(near[w]), n[b], b) for w, b in best.items()}


def test_wavelet_tree():
    rng = np.random.default_rng(2)
    for size in (1, 2, 7, 64, 100):
        values = rng.permutation(size)
        tree = variants.WaveletTree(values)
        q = [sorted(rng.integers(0, size + 1, 2)) + sorted(rng.integers(0, size + 1, 2)) for _ in range(50)]
        got = set(zip(*(x.tolist() for x in tree.report(*(np.array(c) for c in zip(*q))))))
        assert got == {(i, int(v)) for i, (a, b, c, d) in enumerate(q) for v in values[a:b] if c <= v < d}
