"""What the fourth review found: queries against plain restatements."""

import hashlib
import random

from palimpsest.operators import blocks, contract, records, regions
from palimpsest.plans import comparisons
from palimpsest.plans import documents as documents_plans
from palimpsest.plans import queries as plans
from pyspark.sql import functions as F


def test_sorted_lines_keep_digits_and_null_is_empty(spark, tmp_path):
    texts = ["0997 a\n121\n  b \n\n  c　", "10\n010\n20", "a \r\nb", "", None, "\n \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.form for r in plans.queries()["sorted_line_form"](spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        lines = sorted(x for x in (line.strip("  　") for line in (text or "").split("\n")) if x)
        assert got[k] == hashlib.md5("\n".join(lines).encode()).hexdigest(), text
    assert spark.range(1).select(blocks.reflowed(F.lit(" 0 a\n1 b")).alias("x")).first().x == "0 a\n1 b"


def test_file_sizes_of_large_keys(spark, tmp_path):
    rows = [(k, k % 7) for k in (1, 49, 50, 20_000, 30_549, 30_551, 120_003, 1_199_999, 1_200_004)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.p_partkey: r["size"] for r in documents_plans.queries()["file_sizes"](spark, str(tmp_path)).collect()}
    for k, size in rows:
        n = -k if k % 50 == 0 else k * k * (1, 37, 40_000, 12_345_678, 9_876_543_210)[size % 5]
        power = next((p for p in range(4) if n < 1024 ** (p + 1)), 4)
        x = n / 1024**power
        want = "0 B" if n <= 0 else f"{f'{int(x)}' if power == 0 or x >= 100 else f'{x:.1f}' if x >= 10 else f'{x:.2f}'} {['B', 'KB', 'MB', 'GB', 'TB'][power]}"
        assert got[k] == want


def test_equal_descriptions_are_judged_once(spark, monkeypatch):
    other = comparisons.TEMPLATE.replace('"dpi":300', '"dpi":"300"'), comparisons.TEMPLATE.replace('"python":"3.13"', '"python":"3.12"')
    texts = [comparisons.TEMPLATE, *other, "{}", "[1]", None]
    rows = [(str(k), texts[k % 6], texts[k // 6 % 6]) for k in range(40)]
    x = spark.createDataFrame(rows, "id string, a string, b string").select(
        F.lit("p").alias("benchmark_profile"), F.lit("d").alias("dataset"), "id", F.lit(0).alias("page_index"), "a", "b",
        *(F.lit(0.5).alias(c) for c in records.NUMBERS), F.lit(True).alias("text_layer_ok"), F.lit(1).alias("ocr_box_count"), F.lit(0).alias("pages_with_zero_boxes"),
    )
    runs = [x.filter("id <> 7").withColumn("contract", F.col("a")).drop("a", "b"), x.filter("id <> 9").withColumn("contract", F.col("b")).drop("a", "b")]
    told = lambda pair: {r.id: r.asDict() for r in records.compared(*pair, contract="contract").collect()}
    want = told([r.withColumn("contract", F.parse_json("contract")) for r in runs])
    assert told(runs) == want
    found = []
    described = contract.described
    monkeypatch.setattr(contract, "described", lambda r, *a: found.append(r.count()) or described(r, *a))
    monkeypatch.setattr(contract, "MOST_LOCAL", 2)
    assert told(runs) == want and found == [6]


def test_words_of_pages_are_not_dealt_again(spark, sf):
    for name in ("page_elements", "page_tables"):
        plan = documents_plans.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan, name


def test_regions_of_pages_are_not_dealt_again(spark, sf):
    for name in ("region_grids", "baseline_lines"):
        plan = documents_plans.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan, name


def test_grids_of_pages_are_those_of_lines(spark):
    rng = random.Random(9)
    said = "a bb ccc dddd".split()
    rows = [(1, p, k, 20.0 + rng.choice([0, 5, 110, 225, 340]), y := 5.0 + 12 * rng.randint(0, 9), 0.0, y + rng.choice([10, 12]), rng.choice(said)) for p in range(40) for k in range(25)]
    x = spark.createDataFrame(rows, "doc long, page int, region long, x0 double, y0 double, x1 double, y1 double, text string").withColumn("x1", F.col("x0") + 6 * F.length("text"))
    g = regions.grids(regions.with_tables(regions.visual_lines(x).withColumn("page_width", F.lit(600.0))))
    g = g.select("doc", "page", "table", "first", F.posexplode("rows").alias("row", "cells"))
    want = g.select("doc", "page", "table", "first", "row", F.posexplode("cells").alias("column", "text"))
    got = regions.page_grids(x.withColumn("page_width", F.lit(600.0)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 500
