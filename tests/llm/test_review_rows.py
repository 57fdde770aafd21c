"""The pipeline's stages on null and repeated doc_ids against brute force."""

import random

import corpus_pipeline

from palimpsest.llm import neardup

STAGES = dict(corpus_pipeline.STAGES)


def order(row):
    return (row[0] is not None, row[0] or 0, row[1])


def brute_exact(rows):
    return [max((r for r in rows if r[1].lower() == t), key=order) for t in {r[1].lower() for r in rows}]


def brute_near(rows):
    words, left = neardup.Words(), []
    sets = [set(neardup.shingles(r[1], words)[0].tolist()) for r in rows]
    like = lambda i, j: len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])  # noqa: E731  (near copies here are over 0.9, others share little)
    for i in sorted(range(len(rows)), key=lambda i: order(rows[i])):
        if not any(like(i, j) for j in left):
            left.append(i)
    return [rows[i] for i in left]


def brute_cut(rows, length=100):
    seen, out = set(), []
    for doc, text in sorted(rows, key=order):
        raw, gone = text.encode(), set()
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone |= set(range(i, i + length))
            seen.add(raw[i : i + length])
        out.append((doc, bytes(c for i, c in enumerate(raw) if i not in gone).decode()))
    return out


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{i}", len(t)) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def made():
    rng = random.Random(32)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, d, e, f, g = (text(120) for _ in range(7))
    near, passage = d.replace(d.split()[60], "edit"), text(30)
    return [(None, a), (None, b), (None, b), (1, c), (1, d), (2, c.upper()), (3, e), (3, e), (5, near), (6, f), (7, g + " " + passage), (7, passage + " " + text(100)), (None, passage + " " + text(90))]


def told(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=order)


def test_stages_keep_and_cut_rows_not_ids(spark, sf):
    rows = made()
    for name, brute in (("exact_dedup", brute_exact), ("near_dedup", brute_near), ("suffix_dedup", brute_cut)):
        got = STAGES[name](spark, table(spark, rows), sf)
        assert told(got) == sorted(brute(rows), key=order), name
        assert all(r.n_chars == len(r.text) for r in got.collect()), name


def test_pipeline_on_null_and_repeated_ids(spark, sf):
    rows = made()
    docs = corpus_pipeline.written(table(spark, rows), "rows")
    docs = corpus_pipeline.written(STAGES["toxicity"](spark, docs, sf), "toxicity")
    assert told(docs) == sorted(rows, key=order)
    for name, brute in (("exact_dedup", brute_exact), ("near_dedup", brute_near), ("suffix_dedup", brute_cut)):
        docs, rows = corpus_pipeline.written(STAGES[name](spark, docs, sf), name), brute(rows)
        assert told(docs) == sorted(rows, key=order), name
    packed = STAGES["packing"](spark, docs, sf).toPandas()
    assert (packed["start"] == 0).sum() == len(rows)
