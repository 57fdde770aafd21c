"""The rules for documents, columns, records, exports and sessions: against their SQL,
and against plain restatements on small rows."""

import random
import re
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import TABLES, same

from palimpsest.functions import document as D
from palimpsest.operators import columns, export, records, sessions
from palimpsest.plans import documents as plans


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, sf, oracle, name):
    got = plans.queries()[name](spark, sf).toPandas()
    assert len(got)
    if sql := plans.oracle_sql().get(name):
        same(got, oracle.sql(sql).df())


def told(spark, expression, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def test_scalars(spark):
    assert told(spark, lambda t: D.file_size(t.cast("long")), "0", "-5", "1023", "1024", "1152", "10240", "153600", str(1 << 40), str(5000 << 40)) == ["0 B", "0 B", "1023 B", "1.00 KB", "1.12 KB", "10.0 KB", "150 KB", "1.00 TB", "5000 TB"]
    assert told(spark, D.heading_kind, "1.2. Scope of it", "QUALITY MANUAL", "A1 - annex", "plain words", "AB", "ÉTÉ AU NORD", "X" * 130, "12 34") == ["heading1", "heading2", "heading3", None, None, "heading2", None, None]
    assert told(spark, D.plausible_heading, "Page 3", "Total: 4", "Summary:", "XKCD", "A1 B2", "", "QUALITY") == [False, False, True, False, False, False, True]
    assert told(spark, D.preformatted, "│ a │ b │", "if (x) { y; }", "{;", "a | b") == [True, True, False, False]
    assert told(spark, lambda t: D.paragraph_kind(t, F.lit(False)), "Name: Ana", "A1 - x: y", "some text") == ["kv", "paragraph", "paragraph"]
    assert told(spark, D.markdown_text, "#tag a_b", "- x", "1. x", "1.5 million", "a\n# b", "> q") == ["\\#tag a\\_b", "\\- x", "\\1. x", "1.5 million", "a\n# b", "\\> q"]
    assert told(spark, D.markdown_field, " key_a: v:1 ", "no key") == ["**key\\_a:** v:1", "no key"]
    assert told(spark, D.yaml_scalar, 'a"b\\c\nd') == ['a\\"b\\\\cd']
    assert told(spark, lambda t: D.layer_reason(t, F.lit(100000.0)), "\n\t ", "short", "x" * 30 + "�", "abc\x01" * 10, "what???" * 5, "y" * 2000, "a plain text") == ["empty", "too_few_chars", "fffd_ratio", "nonprint_ratio", "suspicious_glyph_loss", "implausible_text_density", None]
    assert told(spark, D.structural, "1.2 Scope", "- item", "CAPITALS", "A1 - HEADINGS: and more", "B. lower case", "A- PARTS OF IT", "plain") == [True, True, True, True, False, True, False]
    assert told(spark, lambda t: D.joined_line(F.lit("exam-"), t), "ple one", "Ple") == ["example one", None]
    assert told(spark, lambda t: D.proportional_spaces(t.cast("double"), F.lit(10.0)), "5", "25", "35", "500") == [1, 2, 4, 8]
    assert told(spark, lambda t: D.fill_threshold(F.from_json(t, "array<double>")), "[]", "[0.05, 1.0, 0.9]", "[0.2]") == [0.75, pytest.approx(0.88), 0.55]
    assert told(spark, lambda t: D.better_reading(F.lit("old"), F.lit(0.5), t, F.lit(0.55))["text"], "new", "  ") == ["new", "old"]
    assert told(spark, lambda t: D.retry_reason(t.cast("int"), F.lit(0.7), F.lit(True)), "0", "3") == ["no_boxes", "low_confidence"]


def normal(text):
    text = re.sub(r"[ \t]+", " ", unicodedata.normalize("NFC", text).replace(" ", " "))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates(spark, tmp_path):
    texts = ["résumé\nà la carte", "à la carte\nresume", "b a\r\nc", "c\na\nb", "", None, "one two  three", "one three\n\n\n\nfour  "]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: (r.cer, r.wer, r.likeness, r.sorted_cer) for r in plans.error_rates(spark, str(tmp_path)).collect()}
    pairs = [(normal(a or ""), normal(b or "")) for a, b in zip(texts, texts[1:])]
    order = lambda t: normal("\n".join(sorted(t.splitlines())))
    for i, (a, b) in enumerate(pairs):
        cer = lambda x, y: distance(x, y) / max(len(y), 1)
        want = (cer(a, b), distance(a.split(), b.split()) / max(len(b.split()), 1), 1 - distance(a, b) / max(len(a), len(b), 1), cer(order(a), order(b)))
        assert got[i] == pytest.approx(want, abs=1e-6), i
    micro = plans.micro_error(spark, str(tmp_path)).first().micro_cer
    assert micro == pytest.approx(sum(distance(a, b) for a, b in pairs) / sum(len(b) for _, b in pairs), abs=1e-6)


def test_an_empty_gutter_parts_columns(spark):
    rows = [(1, x, 40) for x in (0, 50, 100, 300, 350, 400) for _ in range(5)] + [(2, x, 40) for x in range(0, 440, 15)] + [(3, 0, 500)] * 30
    got = columns.page_columns(spark.createDataFrame(rows, "page long, x long, w long"), ["page"]).collect()
    assert [(r.page, r.page_left, r.split_x, r.page_right) for r in got] == [(1, 0.0, 225.0, 440.0)]


def test_text_lines(spark):
    rows = [(1, 0, 10, 5, 30, "a"), (1, 1, 45, 6, 20, "b"), (1, 2, 200, 5, 20, "c"), (1, 3, 700, 4, 10, "far"), (1, 4, 0, 40, 9, "next")]
    got = columns.text_lines(spark.createDataFrame(rows, "page long, word long, x long, y long, w long, text string"), ["page"]).orderBy("line", "part").collect()
    assert [(r.text, r.min_x, r.max_x, r.n_words, r.y) for r in got] == [("a b  c", 10, 220, 3, 5.0), ("far", 700, 710, 1, 5.0), ("next", 0, 9, 1, 40.0)]


ELEMENTS = "doc long, page int, seq int, kind string, text string, raw_lines array<string>, cells array<array<string>>, indent int"


def test_text_and_markdown(spark):
    rows = [
        (1, 0, 0, "heading2", "QUALITY #1", [], [], 0),
        (1, 0, 1, "kv", "Name: Ana_B", [], [], 0),
        (1, 0, 2, "kv", "Age: 4", [], [], 0),
        (1, 0, 3, "table", "", [], [["a", "long"], ["x|y"]], 0),
        (1, 0, 4, "preformatted", "{a;}", [], [], 0),
        (1, 0, 5, "preformatted", "", ["─│─ ", "x"], [], 0),
        (1, 0, 6, "paragraph", "one two,", ["one ", "two,"], [], 0),
        (1, 1, 0, "paragraph", " three", [], [], 2),
        (1, 1, 1, "paragraph_indent", "Four", [], [], 2),
        (2, 5, 0, "heading1", "Page 3", [], [], 0),
    ]
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 4), (2, 5), (2, 6), (3, 0), (3, 1)], "doc long, page int")
    df = export.across_pages(spark.createDataFrame(rows, ELEMENTS), pages)
    text = {r.doc: r.text for r in export.as_text(df, pages).collect()}
    assert text[1] == "--- Page 1 ---\n\nQUALITY #1\n\n\nName: Ana_B\nAge: 4\n\na   | long\n----+-----\nx|y |     \n\n{a;}\n\n─│─ \nx\n\none \ntwo,\nthree\n\n\n\n\n\n--- Page 2 ---\n\n  Four\n"
    gap = "\n" * 6
    assert text[2] == f"--- Page 1 ---\n{gap}--- Page 2 ---\n\nPage 3\n{gap}--- Page 3 ---\n" and text[3] == f"--- Page 1 ---\n{gap}--- Page 2 ---\n"
    marked = {r.doc: r.text for r in export.as_markdown(df, pages).collect()}
    assert marked[1] == "QUALITY #1\n\n**Name:** Ana\\_B\n\n**Age:** 4\n\n| a | long |\n|---|---|\n| x\\|y |   |\n\n```\n{a;}\n─│─\nx\n```\n\none  \ntwo,  \nthree\n\n---\n\nFour\n"
    assert marked[2] == "---\n\nPage 3\n\n---\n" and marked[3] == "---\n"


def across(spark, pages):
    """Texts of the pages' paragraphs after those that go on were joined; a page is a list of them."""
    rows = [(1, p, k, "paragraph", t, [], [], 0) for p, page in enumerate(pages) for k, t in enumerate(page)]
    known = spark.createDataFrame([(1, p) for p in range(len(pages))], "doc long, page int")
    return [r.text for r in export.across_pages(spark.createDataFrame(rows, ELEMENTS), known).orderBy("page", "seq").collect()]


def test_paragraphs_across_pages_come_in_pairs(spark):
    assert across(spark, [["a,"], ["b,"], ["c,"], ["d -"], ["E"]]) == ["a, b,", "c, d -", "E"]
    assert across(spark, [["a,"], [], ["b"]]) == ["a,", "b"]  # a blank page parts them
    assert across(spark, [["x", "a,"], ["b", "c,"], ["d,"], ["e"]]) == ["x", "a, b", "c, d,", "e"]
    rng = random.Random(8)
    for _ in range(12):
        pages = [["".join(rng.choice(["a,", "b", "C,", "d -"])) for _ in range(rng.choice([0, 1, 1, 2]))] for _ in range(8)]
        want = [list(p) for p in pages]
        for i in range(len(want) - 1):
            if want[i] and want[i + 1] and want[i][-1][-1] in ",-" and want[i + 1][0][0].islower():
                want[i][-1] += " " + want[i + 1].pop(0)
        assert across(spark, pages) == [t for p in want for t in p], pages


def test_front_matter(spark):
    x = spark.range(1).select(export.front_matter(F.lit('a "b"'), F.lit("/x/y.pdf"), F.lit(3), F.to_date(F.lit("2026-01-02")), "palimpsest").alias("x")).first().x
    assert x == ["---", 'title: "a \\"b\\""', 'source: "/x/y.pdf"', "pages: 3", "date: 2026-01-02", 'generator: "palimpsest"', "---", ""]


def test_ranks(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([None, rng.randrange(8) / 4])) for g in range(6) for _ in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: (r.p, r.q, r.m) for r in records.at_rank(df, ["g"], "v", records.nearest_rank(0.95), "p").join(records.at_rank(df, ["g"], "v", records.rounded_index(0.95), "q"), "g").join(records.median(df, ["g"], "v", "m"), "g").collect()}
    for g in range(6):
        v = sorted(x for k, x in rows if k == g and x is not None)
        if v:
            m = (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
            assert got[g] == (v[max(1, -(-95 * len(v) // 100)) - 1], v[round((len(v) - 1) * 0.95)], m)


def test_refused_records(spark):
    schema = "benchmark_profile string, dataset string, id string, page_index int, run_index int"
    rows = [("p", "d", "a", 0, None), (" p", "d", "a", 0, 0), ("p", " ", "b", 0, 0), ("p", "d", "c", -1, 0), ("p", "d", "e", 0, -1), ("p", "d", "f", 0, 1)]
    assert {(r.problem, r.n) for r in records.refused(spark.createDataFrame(rows, schema)).collect()} == {("dataset", 1), ("page_index", 1), ("run_index", 1), ("duplicate", 1)}


def test_sessions(spark):
    queued = [(s, f) for s in (1, 2, 3) for f in "ab"]
    events = [(1, "a", 1, "complete", "out"), (1, None, 2, "close", ""), (1, "b", 3, "fail", "bad"), (1, "c", 4, "complete", "x"), (1, None, 5, "close", ""), (1, "b", 6, "complete", "late"), (2, "a", 1, "fail", "e"), (2, "a", 2, "complete", "o"), (3, "a", 1, "complete", "o"), (3, None, 2, "discard", "")]
    q, e = spark.createDataFrame(queued, "session int, file string"), spark.createDataFrame(events, "session int, file string, at int, event string, detail string")
    assert {tuple(r) for r in sessions.final_states(q, e).collect()} == {(1, "a", "completed", "out", None), (1, "b", "failed", None, "bad"), (2, "a", "completed", "o", None), (2, "b", "pending", None, None)}
    assert {tuple(r) for r in sessions.session_states(q, e).collect()} == {(1, 2, 1, 1, 0, True), (2, 2, 1, 0, 1, False)}


def test_key_values_over_line_ends(spark):
    texts = ["Sum: 12", "Sum: 1\r2", "Sum: 1\x852", "Sum: 12\n", "Sum: 1\n2", "Sum: 12\r", "To: 1", "a:b: c", "Sum:\n12"]
    x = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(D.key_value(F.col("t")))
    assert [r[0] for r in x.collect()] == [True, True, True, True, False, True, False, False, True]
