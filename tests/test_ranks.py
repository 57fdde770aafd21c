"""Ranks and progress of groups, against plain Python over the same rows."""

import math
import random

from palimpsest.operators import benchmarks, jobs, ranks


def plain(values, weights, goal):
    reached = 0
    for v, w in sorted(zip(values, weights)):
        reached += w
        if reached >= goal:
            # equal values count together
            return v
    return None


def test_ranks_of_small_and_large_groups(spark):
    rnd = random.Random(3)
    groups = {"one": [5.0], "ties": [2.0] * 50 + [1.0] * 50, "many": [rnd.gauss(0, 1) for _ in range(3000)], None: [float(i) for i in range(7)], "none": [None, None]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("many", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p, r.q) for r in ranks.at_ranks(df, ["g"], "v", {"p": ranks.nearest_rank(0.95), "q": ranks.rounded_index(0.5)}).collect()}
    want = {}
    for g, vs in groups.items():
        vs = sorted(v for v in vs if v is not None)
        if vs:
            want[g] = (vs[max(1, math.ceil(len(vs) * 0.95)) - 1], vs[round((len(vs) - 1) * 0.5)])
    assert got == want
    whole = {r.g: (r.median, r.n) for r in benchmarks.confidence(df, ["g"], "v").collect()}
    assert whole["none"] == (None, 0) and whole[None] == (3.0, 7)


def test_ranks_of_an_empty_table_and_of_no_keys(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert ranks.at_rank(df, ["g"], "v", ranks.nearest_rank(0.5), "p").count() == 0
    df = spark.createDataFrame([(float(i),) for i in range(1, 201)], "v double")
    assert ranks.at_rank(df, [], "v", ranks.nearest_rank(0.95), "p").first().p == 190


def test_weighted_median(spark):
    rnd = random.Random(5)
    rows = [(g, rnd.randrange(500), rnd.randrange(4)) for g in ("a", "b") for _ in range(2000)] + [("zero", 3, 0), ("zero", 1, 0), ("null", 2, None)]
    got = {r.g: r.weighted_median for r in benchmarks.weighted_median(spark.createDataFrame(rows, "g string, v long, w long"), ["g"], "v", "w").collect()}
    for g in ("a", "b", "zero", "null"):
        vs, ws = [v for k, v, _ in rows if k == g], [w or 0 for k, _, w in rows if k == g]
        assert got[g] == plain(vs, ws, sum(ws) / 2), g


def test_progress_of_many_keys(spark):
    rnd = random.Random(7)
    rows = [(k, t, rnd.choice([None, float("nan"), 0.0, 1.0, rnd.random()])) for k in ["a", "b", None, ""] for t in [*range(400), None]]
    rnd.shuffle(rows)
    got = jobs.changed(spark.createDataFrame(rows, "k string, t int, v double"), "k", "t", "v", 0.25)
    assert got.dtypes == [("k", "string"), ("t", "bigint"), ("v", "double")]
    want = []
    for k in ["a", "b", None, ""]:
        last = None
        for _, t, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0)):
            v = None if v is None or math.isnan(v) else v
            if last is None or (v is not None and v != last and (v in (0.0, 1.0) or abs(v - last) >= 0.25)):
                want.append((k, t, v))
                last = v
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
