"""Ranked lexical search against a plain scoring of every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import lexical


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            if b:
                m = 25 + 75 * b.total() * n_docs // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
                if s > 0:
                    scored.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def result(df):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


ODD = [(1, "The cat, the CAT sat"), (2, None), (3, ""), (4, "the cat sat"), (4, "the cat sat"), (None, "the cat sat"), (5, "--- ..."), (6, "\u00c9t\u00e9 \u4e2d\u6587x9 \u0130"), (7, "cat " * 30000), (8, " ".join(f"w{i % 700}" for i in range(9000)))]
ITEMS = [(1, "the cat"), (1, "the cat"), (2, None), (3, "zebra"), (None, "W7 w7 W8"), (5, "\u00c9t\u00e9 \u4e2d\u6587X9"), (6, "")]


@pytest.mark.parametrize("shard_docs", [1, 3, 100])
def test_odd_rows(spark, shard_docs):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"score": F.lit(1), "term": F.lit("x"), "query": F.lit(2), "shard": F.lit(3)})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({"rank": F.lit(1), "block": F.lit("x")})
    assert result(lexical.search(docs, items, 3, shard_docs)) == brute(ODD, ITEMS, 3)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical.search(docs, spark.createDataFrame([(1, "a")], items.schema)).count() == 0
    assert lexical.search(some, items).count() == 0


def test_documents(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = result(lexical.search(docs, items, 10, 64))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_packed_integers_come_back():
    values = np.random.default_rng(5).integers(0, 1 << np.random.default_rng(6).integers(1, 31, 5000), 5000)
    raw, stops = lexical.packed(values)
    assert (lexical.unpacked(raw) == values).all() and len(raw) == stops[-1]


def test_blocks_below_the_threshold_stay_compressed():
    rng = np.random.default_rng(1)
    texts = [b"rare rare rare common" if 3000 <= i < 3010 else b"common " * int(rng.integers(1, 3)) + b"x" * (i % 50) for i in range(6000)]
    rows = [r for b in lexical.shard_rows(0, list(range(6000)), texts, 6000, 20000) for r in b.to_pylist()]
    docs = np.frombuffer(rows[0]["payload"], lexical.DOC)
    lists = {r["term"]: lexical.Postings(r["bounds"], r["payload"], r["df"], docs["m"]) for r in rows[1:]}
    best = lexical.Best(10)
    lexical.search_shard(docs, [(5000, 10**6, lists[b"rare"])], best, 0)
    lexical.search_shard(docs, [(5000, 10**6, lists[b"rare"]), (1, 10**6, lists[b"common"])], best, 1)
    assert {r[2] for r in best.rows} == set(range(3000, 3010)) and lists[b"common"].open.sum() <= 2 < len(lists[b"common"].open)
