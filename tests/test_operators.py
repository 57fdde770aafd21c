"""Operators against plain restatements of their rules on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import geometry, text
from palimpsest.operators import benchmarks, jobs, layout, pages, spatial


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_lines_follow_the_running_mean(spark):
    rng = random.Random(1)
    rows = [(p, i, rng.randrange(100), rng.randrange(60), 5) for p in range(12) for i in range(25)]
    got = {(r.page, r.word): r.line for r in layout.lines(spark.createDataFrame(rows, "page long, word long, x long, y long, w long"), ["page"]).collect()}
    for p in range(12):
        line, ys = -1, []
        for _, i, x, y, _ in sorted((r for r in rows if r[0] == p), key=lambda r: (r[3], r[2], r[1])):
            if ys and abs(y - sum(ys) / len(ys)) <= 5:
                ys.append(y)
            else:
                line, ys = line + 1, [y]
            assert got[p, i] == line


def test_matching_is_greedy_and_one_to_one(spark):
    rng = random.Random(2)
    rows = list({(p, rng.randrange(6), rng.randrange(6)): rng.randrange(1, 20) / 20 for p in range(20) for _ in range(15)}.items())
    got = {(r.page, r.a_id, r.b_id) for r in spatial.matched(spark.createDataFrame([(*k, v) for k, v in rows], "page long, a_id long, b_id long, iou double"), ["page"], 0.3).collect()}
    want, used = set(), set()
    for (p, a, b), v in sorted(rows, key=lambda x: (x[0][0], -x[1], x[0][1], x[0][2])):
        if v >= 0.3 and not {(p, "a", a), (p, "b", b)} & used:
            used |= {(p, "a", a), (p, "b", b)}
            want.add((p, a, b))
    assert got == want


def test_overlaps_come_once(spark):
    rng = random.Random(3)
    rows = [(i % 3, i, x, y, x + rng.randrange(1, 400), y + rng.randrange(1, 400)) for i in range(60) for x, y in [(rng.randrange(600), rng.randrange(600))]]
    df = spark.createDataFrame(rows, "page long, id long, x0 long, y0 long, x1 long, y1 long")
    got = sorted((r.a_id, r.b_id) for r in spatial.overlapping(df, df, ["page"]).collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3]))
    assert got == want


def test_size_split_and_deletion(spark):
    rows = [(1, i + 1, s) for i, s in enumerate([50, 60, 10, 200, 5, 5])]
    df = spark.createDataFrame(rows, "doc long, pos long, size long")
    assert [r.part for r in pages.size_parts(df, "size", 100).orderBy("pos").collect()] == [0, 1, 1, 2, 3, 3]
    assert pages.deleted(df, df.filter("pos < 6")).select("pos", "size").first() == (1, 5)
    assert pages.deleted(df, df).count() == 6


def test_progress_is_told_from_the_last_told(spark):
    rows = [("k", i, v) for i, v in enumerate([0.0, 0.05, 0.09, 0.12, 0.13, 1.0, 1.0])]
    got = jobs.changed(spark.createDataFrame(rows, "key string, t long, v double"), "key", "t", "v", 0.1)
    assert [r.t for r in got.orderBy("t").collect()] == [0, 3, 5]


@pytest.mark.parametrize("a,b,want", [("", " ", 1), ("über", "über", 0), ("ab\n", "", 3), ("né", "ne", 1), ("😀b", "b😀", 2), ("x" * 40, "x" * 37, 3)])
def test_edit_distance(spark, a, b, want):
    assert one(spark, F.levenshtein(F.lit(a), F.lit(b))) == want


def test_text_scalars(spark):
    assert one(spark, text.human_size(F.lit(1536))) == "1.5 KB"
    assert one(spark, text.elapsed(F.lit(3725))) == "1h 2m 5s"
    assert one(spark, text.size_bytes(F.lit("1.5M"))) == 1572864
    assert one(spark, text.size_bytes(F.lit("x"))) is None
    assert one(spark, text.key_value(F.lit("Total: 12"))) is True
    assert one(spark, text.markdown(F.lit("# a*b"))) == "\\# a\\*b"
    assert one(spark, text.glyph_loss(F.lit("ab???"))) == pytest.approx(0.6)
    assert one(spark, text.hits(F.lit("aAa b"), F.lit("a"))) == 3
    assert one(spark, pages.page_list(F.lit("1-3, 7,2"))) == [1, 2, 3, 7]


def test_percentiles_differ(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 21)], "v double")
    assert df.agg(benchmarks.nearest_rank("v", 0.95)).first()[0] == 19
    assert df.agg(benchmarks.round_index(F.col("v"), 0.95)).first()[0] == 19
    assert df.agg(benchmarks.nearest_rank("v", 0.1)).first()[0] == 2


def test_boxes(spark):
    quad = F.expr("array(array(1.0, 2.0), array(5.0, 2.0), array(5.0, 9.0), array(1.0, 9.0))")
    assert tuple(one(spark, geometry.quad_box(quad))) == (1.0, 2.0, 5.0, 9.0)
    assert one(spark, geometry.quad_box(F.expr("array(array(1.0))"))) is None
    assert one(spark, geometry.budgeted_dpi(F.lit(612), F.lit(792), F.lit(300), F.lit(4))) == 206
