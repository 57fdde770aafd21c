"""Positioned markup, native text on lines, spreads; all of their queries against SQL."""

import random
import re
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import layout, pages, verify
from palimpsest.plans import comparisons, sources
from palimpsest.sources import bound, markup, readers
from test_queries import TABLES, same


@pytest.mark.parametrize("name", sorted(sources.queries()) + sorted(comparisons.queries()))
def test_query(spark, sf, name):
    part = sources if name in sources.queries() else comparisons
    got = part.queries()[name](spark, sf).toPandas()
    assert len(got)
    if name in part.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        same(got, con.sql(part.oracle_sql()[name]).df())


def words_of(spark, text):
    x = markup.markup_words(spark.createDataFrame([(7, text)], "doc long, markup string"))
    return [(r.page, r.line, r.word, r.text, r.x0, r.y0, r.x1, r.y1) for r in x.orderBy("page", "line", "word").collect()]


def test_markup_of_odd_forms(spark):
    text = """<doc><page width=300 height='150'><!-- <line><word xMin="1">gone</word></line> -->
      <word xMin="9">outside</word>
      <line><word xMin="5">cut off</word><line xMin="1"><word YMAX='9' xmin=1.5 yMin="two" xMax="8">a &amp;<b> b&nbsp;</b>\n c</word>
      <WORD xMin="2" title="x > y">&eacute;&#x41;</WORD><word xMin="3"> </word><word xMin="4">unended</line></page>
      <page width="0" height="10"><line><word>no size</word></line></page>
      <page width="10" height="10"><line><word>never ended</word>
      <page width="10" height="10"><line></line><line><word>last</word></line>"""
    assert words_of(spark, text) == [(0, 1, 0, "a & b c", 1.5, 0.0, 8.0, 9.0), (0, 1, 1, "éA", 2.0, 0.0, 0.0, 0.0), (3, 1, 0, "last", 0.0, 0.0, 0.0, 0.0)]
    assert words_of(spark, None) == [] and words_of(spark, "") == [] and words_of(spark, "plain & text") == []


def test_markup_of_long_pages(spark):
    many = "".join(f'<line><word xMin="{k}">{"w" * 50}{k}</word></line>' for k in range(20000))
    got = words_of(spark, f'<page width="1" height="1">{many}</page>')
    assert len(got) == 20000 and got[-1][1] == 19999 and got[-1][3].endswith("w19999")


def test_spans_are_clipped_to_what_the_image_shows(spark):
    words = spark.createDataFrame([(1, 0, "over", -10.0, 40.0, 25.0, 70.0), (1, 1, "in", 30.0, 60.0, 40.0, 80.0), (1, 2, "edge", 60.0, 60.0, 90.0, 80.0), (1, 3, "above", 30.0, 10.0, 40.0, 50.0), (2, 0, "all", 30.0, 60.0, 40.0, 80.0), (3, 0, "none", 1.0, 1.0, 2.0, 2.0)], "page long, word long, text string, x0 double, y0 double, x1 double, y1 double")
    words = words.selectExpr("*", "100D AS page_width", "200D AS page_height")
    images = spark.createDataFrame([(1, 80, 50, 20.0, 50.0, 40.0, 100.0), (2, 100, 100, None, None, None, None), (3, 9, 9, 0.0, 0.0, 0.0, 10.0)], "page long, width int, height int, left double, bottom double, rect_width double, rect_height double")
    got = {r.text: (r.x0, r.y0, r.x1, r.y1) for r in markup.native_spans(words, images, ["page"]).collect()}
    assert got == {"over": (0.0, 0.0, 10.0, 10.0), "in": (20.0, 5.0, 40.0, 15.0), "all": (30.0, 30.0, 40.0, 40.0)}


def test_form_feeds(spark):
    x = spark.createDataFrame([(1, " a\n\f\f \n\fb"), (2, ""), (3, None)], "doc long, text string")
    assert [tuple(r) for r in markup.text_pages(x).orderBy("doc", "page").collect()] == [(1, 1, "a"), (1, 4, "b")]


def share(a, b):
    """Common area over the smaller one."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0
    return w * h / min(max((k[2] - k[0]) * (k[3] - k[1]), 1) for k in (a, b))


def replaces(seen, there):
    """Whether native text may stand in for what was seen."""
    bare = lambda t: "".join(c for c in t if c.isalnum() or c == "_").casefold()
    if not any(c.isalnum() for c in there):
        return False
    lost = sum(c in "�□" for c in there) + 3 * len(re.findall(r"\?\?\?", there))
    if lost / len(there) > 0.03 or sum(ord(c) < 32 for c in there) / len(there) > 0.02:
        return False
    if seen and min(len(seen), len(there)) / max(len(seen), len(there)) < 0.45:
        return False
    return SequenceMatcher(None, bare(seen), bare(there)).ratio() >= 0.45


def test_verified_lines_by_brute_force(spark):
    rng = random.Random(5)
    letters = ["a", "b", "ß", "É", "x", "1", "_", " ", " ", "\t", "?", "???", "�", "\x01", "-"]
    weights = [9, 9, 5, 5, 9, 4, 2, 6, 1, 1, 1, 0.3, 0.2, 0.2, 2]
    text = lambda n: "".join(rng.choices(letters, weights, k=rng.randrange(n)))
    box = lambda w, h: (x := rng.randrange(200), y := rng.randrange(200), x + rng.randrange(w), y + rng.randrange(h))
    lines = [(p, i, None if i == 3 else text(12), *box(150, 30)) for p in range(30) for i in range(12)]
    lines += [(99, 0, "a" * 150 + "b" * 150, 0, 0, 300, 10)]  # long texts: frequent letters are left out of the comparison
    spans = [(p, i, text(8), *box(60, 20)) for p in range(30) for i in range(40)] + [(99, 0, "a" * 150 + "b" * 160, 0, 0, 300, 10)]
    spec = "page long, id long, text string, x0 long, y0 long, x1 long, y1 long"
    got = {(r.page, r.id): r for r in verify.verified_lines(spark.createDataFrame(lines, spec), spark.createDataFrame(spans, spec)).collect()}
    assert len(got) == len(lines)
    taken = 0
    for p, i, t, *b in lines:
        on = sorted((s for s in spans if s[0] == p and share(b, s[3:]) >= 0.2), key=lambda s: (s[4], s[3], s[1]))
        there = " ".join(" ".join(s[2] for s in on).split())
        r = got[p, i]
        if on and replaces(" ".join((t or "").split()), there):
            taken += 1
            union = (min(s[3] for s in on), min(s[4] for s in on), max(s[5] for s in on), max(s[6] for s in on))
            assert (r.text, r.source, (r.x0, r.y0, r.x1, r.y1), r.rejected) == (there, "pdf", union, False)
            assert [tuple(w) for w in r.words] == [(w, *s[3:]) for s in on for w in s[2].split()]
        else:
            assert (r.text, r.source, [r.x0, r.y0, r.x1, r.y1], r.words, r.rejected) == (t, "ocr", b, None, bool(on))
    assert 20 < taken < len(lines) - 100


def test_spread_boxes(spark):
    rows = [(1, 1, k, x, w, float(9 - k), f"t{k}") for k, (x, w) in enumerate([(0.0, 10.0), (20.0, 25.0), (55.0, 20.0), (60.0, 40.0)])]
    rows += [(1, 2, k, 10.0 * k, 10.0, 0.0, f"u{k}") for k in range(9)]  # boxes that touch: no gap
    rows += [(1, 4, k, x, 5.0, 0.0, "v") for k, x in enumerate([0.0, 5.0, 90.0])]  # too few
    boxes = spark.createDataFrame(rows, "doc long, page long, id long, x double, width double, y double, text string")
    out = layout.spread_boxes(boxes)
    got = {(r.page, r.id): (r.logical, round(r.x, 6), round(r.width, 6)) for r in out.collect()}
    assert got[1, 0] == (1, 0.0, 20.0) and got[1, 1] == (1, 40.0, 50.0) and got[1, 2] == (2, 10.0, 40.0) and got[1, 3] == (2, 20.0, 80.0)
    assert got[2, 5] == (3, 50.0, 10.0) and got[4, 2] == (4, 90.0, 5.0)
    assert layout.spread_text(out).first().text == "t1\nt0\n\nt3\nt2\n\n" + "\n".join(f"u{k}" for k in range(9)) + "\n\nv\nv\nv"
    assert layout.spread_boxes(boxes.limit(0)).count() == 0


def test_bound_documents(spark):
    import hashlib
    import json

    data = b"bytes"
    sha = hashlib.sha256(data).hexdigest()
    page = lambda n, **more: {"page_index": n, "width_px": 10, "height_px": 10, "dpi": 72} | more
    whole = lambda **more: {"version": 2, "pdf": {"sha256": sha, "size_bytes": 5}, "state": "document", "document": {"pages": [page(1), page(2)]}} | more
    cases = [
        ("whole", whole(), ("document", None, True)),
        ("pages in another order", whole(document={"pages": [page(2), page(1)]}), ("document", None, True)),
        ("page twice", whole(document={"pages": [page(1), page(1)]}), ("document", None, False)),
        ("no pages", whole(document={"pages": None}), ("document", None, False)),
        ("pages no array", whole(document={"pages": 3}), ("refused", "page", None)),
        ("page without dpi", whole(document={"pages": [{"page_index": 1, "width_px": 1, "height_px": 1}]}), ("refused", "page", None)),
        ("version in a text", whole(version="2"), ("refused", "version", None)),
        ("version true", whole(version=True), ("refused", "version", None)),
        ("pdf missing", whole(pdf=None), ("refused", "pdf", None)),
        ("size below 0", whole(pdf={"sha256": sha, "size_bytes": -1}), ("refused", "size", None)),
        ("size in a text", whole(pdf={"sha256": sha, "size_bytes": "5"}), ("refused", "size", None)),
        ("other size", whole(pdf={"sha256": sha, "size_bytes": 6}), ("stale", "size", None)),
        ("other hash", whole(pdf={"sha256": "0" * 64, "size_bytes": 5}), ("stale", "hash", None)),
        ("digest with a line end", whole(pdf={"sha256": sha + "\n", "size_bytes": 5}), ("refused", "fingerprint", None)),
        ("why not", whole(state="unavailable", reason="why not"), ("unavailable", "why not", None)),
        ("no reason", whole(state="unavailable", reason=""), ("refused", "unavailable", None)),
        ("state", whole(state=None), ("refused", "state", None)),
        ("document", whole(document=[]), ("refused", "document", None)),
        ("legacy", {"version": 1, "document": {"pages": []}}, ("legacy", None, None)),
        ("file missing", whole(), ("stale", "file", None)),
        ("array", [1], ("refused", "json", None)),
    ]
    rows = [(n, json.dumps(c)) for n, c, _ in cases] + [("null", None), ("empty", ""), ("cut", '{"version":2')]
    side = spark.createDataFrame(rows, "name string, payload string")
    files = spark.createDataFrame([(n, sha, 5, 2) for n, _ in rows if n != "file missing"], "name string, sha256 string, size long, n_pages int")
    got = {r.name: (r.state, r.reason, r.covers) for r in bound.bound_documents(side, files, "name").collect()}
    assert got == {n: want for n, _, want in cases} | {n: ("refused", "json", None) for n in ("null", "empty", "cut")}
    assert bound.bound_documents(side.filter("name = 'legacy'"), files, "name", legacy=True).first().state == "document"
    texts = [page(1, native_text="native", lines=[{"text": "a"}]), page(2, lines=[{"text": "b"}, {}, {"text": "c"}]), page(3, native_text=" "), page(4, text_results=[{"text": "d", "box": [[0, 0]], "confidence": 1}])]
    one = bound.bound_documents(spark.createDataFrame([("whole", json.dumps(whole(document={"pages": texts})))], side.schema), files, "name")
    assert one.select(bound.document_text(F.col("pages"))).first()[0] == "native\n\nb\n\nc\n\nd"


def test_words_and_regions_are_refused_when_malformed(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    good = "5\t1\t0\t0\t0\t0\t1.5\t2\t3\t4\t90\t%s\n"
    (tmp_path / "w.tsv").write_text(head + good % '"quoted' + good % "\xa0 " + "5\t1\t0\t0\t0\t0\t1\t2\tx\t4\t90\twidth\n" + "5\t1\t0\t0\t0\t0\t1\t2\t3\t\t90\theight\n" + "4\t1\t0\t0\t0\t0\t1\t2\t3\t4\t90\tlevel\n" + "5\tp\t0\t0\t0\t0\t1\t2\t3\t4\t90\tpage\n")
    assert [r.text for r in readers.words_tsv(spark, str(tmp_path / "w.tsv")).collect()] == ['"quoted']
    raw = spark.createDataFrame([(1, [[1], [2]], ["a", "b"], [0.5, 0.6]), (2, [[1]], ["a", "b"], [0.5]), (3, [[1]], None, [0.5]), (4, None, ["a"], None), (5, None, None, None), (6, [], [], []), (7, [], None, [])], "page long, boxes array<array<int>>, txts array<string>, scores array<double>")
    assert [(r.page, r.idx, r.text) for r in readers.regions(raw).orderBy("page", "idx").collect()] == [(1, 0, "a"), (1, 1, "b")]
    assert {r.page: r.problem for r in readers.refused_regions(raw).collect()} == {2: "different lengths", 3: "missing arrays", 4: "unexpected values", 7: "missing arrays"}


def test_deletions(spark):
    at = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (5, 1)], "doc long, pos long")
    gone = spark.createDataFrame([(1, 1), (1, 1), (1, 9), (2, 1), (2, 2), (3, 4), (4, 1)], "doc long, pos long")
    assert {tuple(r) for r in pages.deletions(at, gone).collect()} == {(1, True, None, 1, 1), (2, False, "all pages", 0, 1), (3, False, "no valid pages", 0, 1), (4, False, "no valid pages", 0, 0)}
