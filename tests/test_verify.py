"""Native text on recognised lines, image pairing, blocks."""

from pyspark.sql import functions as F

from palimpsest.operators import blocks, verify

BOX = "page long, id long, text string, x0 long, y0 long, x1 long, y1 long"


def test_native_text_replaces_what_it_resembles(spark):
    lines = spark.createDataFrame([(1, 1, "Hel1a natve text", 40, 42, 210, 64), (1, 2, "other words here", 40, 100, 210, 120), (1, 3, "alone", 400, 400, 450, 420)], BOX)
    spans = spark.createDataFrame([(1, 1, "native text", 100, 43, 208, 63), (1, 2, "Hella", 41, 43, 98, 63), (1, 3, "zzz", 40, 101, 200, 119)], BOX)
    got = {r.id: (r.text, r.source, r.rejected) for r in verify.verified_lines(lines, spans).collect()}
    assert got == {1: ("Hella native text", "pdf", False), 2: ("other words here", "ocr", True), 3: ("alone", "ocr", False)}


def test_pairing_prefers_objects_then_dimensions_then_size(spark):
    positions = spark.createDataFrame([(1, 1, 7, 10, 10), (1, 2, 7, 10, 10), (1, 3, 0, 20, 20), (1, 4, 0, 20, 20), (1, 5, 0, 99, 99), (1, 6, 0, 98, 98)], "page long, pos long, object_id long, w long, h long")
    images = spark.createDataFrame([(1, 1, 7, 10, 10, 5), (1, 2, 8, 20, 20, 5), (1, 3, 9, 30, 30, 50)], "page long, idx long, object_id long, w long, h long, size long")
    got = {r.pos: (r.idx, r.how) for r in verify.paired(positions, images).collect()}
    assert got == {1: (1, "object"), 2: (1, "object"), 3: (2, "dimensions"), 4: (3, "size"), 5: (None, None), 6: (None, None)}


def test_blocks(spark):
    groups = spark.createDataFrame([(1, 0, 10), (1, 20, 30), (1, 40, 50), (2, 0, 10), (2, 120, 130), (3, 0, 10), (3, 300, 310), (4, 0, 10)], "line long, x0 long, x1 long")
    assert {r.line: r.is_table for r in blocks.table_lines(groups, ["line"]).collect()} == {1: True, 2: True, 3: False, 4: False}
    lines = spark.createDataFrame([(1, 0, 0, 10, "a"), (1, 1, 12, 10, "b"), (1, 2, 40, 10, "c")], "page long, line long, y long, h long, text string")
    assert [r.text for r in blocks.paragraphs(lines, ["page"]).orderBy("paragraph").collect()] == ["a b", "c"]
    assert spark.range(1).select(blocks.reflowed(F.lit("exam-\nple goes\non. New\nLine")).alias("x")).first().x == "example goes on. New\nLine"
