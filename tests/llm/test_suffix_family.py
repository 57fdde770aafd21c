"""Removal of repeated passages: small batches, split k-grams, a kept index."""

import random

import numpy as np
import pytest

from palimpsest.llm import suffix


def brute(rows, length=100):
    """n_removed of (doc_id, bytes) in order, by a set of all strings so far."""
    seen, out = set(), {}
    for doc, raw in rows:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(raw[i : i + length])
        out[doc] = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return out


def made(seed, n=150):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    text = lambda k: " ".join(word() for _ in range(k))
    line, passage, whole = text(8), text(40), text(90)
    out = []
    for i in range(n):
        kind = i % 5
        out.append(text(20) + " " + line + " " + text(20) if kind < 2 else text(10) + passage + text(i % 7) if kind == 2 else whole if kind == 3 else "\0" * (90 + i) + "é" * (i % 9) + text(5))
    return out


@pytest.mark.parametrize("hot", [suffix.HOT, 2, -1])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix, "BATCH_BYTES", 9000)
    rows = list(enumerate(made(1))) + [(1000, "ab" * 5000), (1001, "x" + "ab" * 3000)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == brute([(i, t.encode()) for i, t in rows])


def test_later_batches_go_on_from_the_index(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(suffix, "BATCH_BYTES", 9000)
    rows = list(enumerate(made(1) + made(2, 50) + made(1, 60)))
    want = brute([(i, t.encode()) for i, t in rows])
    for part in (rows[:100], rows[100:180], rows[180:]):
        got = suffix.remove_repeats(spark.createDataFrame(part, "doc_id long, text string"), index=str(tmp_path / "index")).collect()
        assert {r.doc_id: bytes(r.kept) for r in got} == {i: want[i] for i, _ in part}
    levels = spark.read.parquet(str(tmp_path / "index" / "version=2")).groupBy("part").count()
    assert levels.agg({"count": "max"}).first()[0] <= 8


def test_null_and_repeated_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (3, None), (3, text), (4, "")]
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, slot int, seq string")
    got = suffix.remove_repeats(docs).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 0, len(text), len(text)]
    assert [r.n_removed for r in got if r.doc_id == 3 and r.n_bytes] == [len(text)]
