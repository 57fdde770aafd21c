"""Words of random pages to elements, against a plain walk over each page."""

import random
import re
from statistics import mean

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import elements, export

WORDS = "doc long, page int, word long, x double, y double, w double, h double, text string"


# --- a plain statement of the rules, one page at a time ---


class Line:
    def __init__(self, boxes, y):
        self.boxes, self.y = sorted(boxes, key=lambda b: b[0]), y
        self.min_x, self.max_x, self.h = self.boxes[0][0], max(b[0] + b[2] for b in self.boxes), self.boxes[0][3]
        text = self.boxes[0][4]
        for a, b in zip(self.boxes, self.boxes[1:]):
            text += ("  " if b[0] - a[0] - a[2] > 2 * a[2] else " ") + b[4]
        self.text = text.strip()

    def groups(self, gap=15):
        out = [[self.boxes[0]]]
        for a, b in zip(self.boxes, self.boxes[1:]):
            if b[0] - a[0] - a[2] > gap:
                out.append([])
            out[-1].append(b)
        return out

    def is_row(self):
        g = self.groups()
        gaps = [b[0][0] - a[-1][0] - a[-1][2] for a, b in zip(g, g[1:])]
        return bool(gaps) and max(gaps) <= 200 and (len(g) > 2 or gaps[0] >= 100)


def lines_of(boxes):
    out, now = [], []
    for b in sorted(boxes, key=lambda b: b[1::-1]):
        if now and abs(b[1] - mean(x[1] for x in now)) > 5:
            out.append(now)
            now = []
        now.append(b)
    lines = []
    for group in [*out, now]:
        y, group = mean(b[1] for b in group), sorted(group, key=lambda b: b[0])
        cuts = [0, *(i for i in range(1, len(group)) if group[i][0] - group[i - 1][0] - group[i - 1][2] > 300), len(group)]
        lines += [Line(group[a:b], y) for a, b in zip(cuts, cuts[1:])]
    return sorted(lines, key=lambda x: x.y)


def pieces(group, bounds):
    a, z = group[0][0], group[-1][0] + group[-1][2]
    crossed = [b for b in bounds if a < b < z]
    if len(group) < 2 or not crossed:
        return [group]
    gaps = [(abs((p[0] + p[2] + q[0]) / 2 - crossed[0]), i) for i, (p, q) in enumerate(zip(group, group[1:]), 1) if q[0] - p[0] - p[2] > 2]
    if not gaps:
        return [group]
    at = min(gaps)[1]
    return pieces(group[:at], bounds) + pieces(group[at:], bounds)


def spread(parts, centres):
    row = [[] for _ in centres]
    for p in parts:
        row[min(range(len(centres)), key=lambda j: (abs(p[0][0] - centres[j]), j))].append(" ".join(b[4] for b in p))
    return [" ".join(c) for c in row]


def table_at(lines, i):
    """None, or where the table that begins with line i ends, its headers and its rows."""
    run = i
    while run < len(lines) and lines[run].is_row():
        run += 1
    own = list(range(i, run))
    if len(own) < 2:
        return None
    limit = sorted(lines[k].min_x for k in own)[len(own) // 2] + 100
    own = [k for k in own if lines[k].min_x <= limit]
    if len(own) < 2:
        return None
    most = max(len(lines[k].groups()) for k in own)
    middles = sorted((g[0][0] + g[-1][0] + g[-1][2]) / 2 for k in own if len(lines[k].groups()) == most for g in lines[k].groups())
    bunches = [[middles[0]]]
    for m in middles[1:]:
        if m - bunches[-1][-1] > 30:
            bunches.append([])
        bunches[-1].append(m)
    centres = [sum(b) / len(b) for b in bunches]
    if len(centres) < 2:
        return None
    bounds = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    rows = [spread([p for g in lines[k].groups() for p in pieces(g, bounds)], centres) for k in own]
    sizes = sorted(len(c) for r in rows for c in r if c)
    if sizes and sizes[len(sizes) // 2] > 14:
        return None
    heads, least = [], min(lines[k].min_x for k in own) + 50
    for k in range(i - 1, max(i - 4, -1), -1):
        head = lines[k].groups(8)
        row = spread(head, centres)
        if lines[k + 1].y - lines[k].y > 25 or lines[k].min_x < least or len(head) < 2 or sum(map(bool, row)) < 2:
            break
        heads.insert(0, row)
    if heads:
        head = [" ".join(filter(None, column)) for column in zip(*heads)]
        if not all(head) and any(rows[0]) and not any(re.fullmatch(r"\d+[.,]?\d*", c.strip()) for c in rows[0]):
            rows[0] = [" ".join(filter(None, c)) for c in zip(head, rows[0])]
        else:
            rows.insert(0, head)
    return own[-1] + 1, len(heads), rows


def heading(s):
    if not 3 <= len(s) <= 120 or sum(c.isalpha() for c in s) < 2:
        return None
    if re.match(r"\d+(\.\d+)*[.)]\s+\S", s) and len(s) < 80:
        kind = "heading1"
    elif sum(c.isalpha() for c in s) >= 5 and s.isupper() and len(s) < 60 and len(s.split()) < 6:
        kind = "heading2"
    elif re.match(r"[A-Z]\d+\s*[-–—.]\s*\w", s) and len(s) < 60:
        kind = "heading3"
    else:
        return None
    digits, letters = sum(c.isdigit() for c in s), sum(c.isalpha() for c in s)
    bad = re.match(r"(?i)page\s+\d", s) or ":" in s[:-1] and not s.endswith(":") or digits and digits / (digits + letters) >= 0.1 or len(s.split()) == 1 and not re.search("(?i)[aeiouy]", s)
    return None if bad else kind


def is_code(s):
    return sum(c in "┌│─" for c in s) >= 3 or all(c in s for c in "{;}")


def is_field(s):
    return bool(re.match(r"[^:]{3,40}:\s+.+$", s)) and len(s) < 120


def is_section(s):
    return bool(re.match(r"[A-Z]\d*(\.\d+)*\s*[-–—.]", s))


def walk(boxes):
    lines = lines_of(boxes)
    long = sorted(x.min_x for x in lines if len(x.text) > 20)
    margin = long[len(long) // 4] if len(long) > 2 else None
    left, right = min(x.min_x for x in lines), max(x.max_x for x in lines)
    wide = (right - left) / 90 if right > left else 6.0
    indent = lambda x: max(0, round((x.min_x - left) / wide))
    out, held, deep, i = [], [], [False], 0

    def close():
        if held:
            text = re.sub(r"\s{2,}", " ", " ".join(lines[k].text for k in held)).strip()
            kind = "preformatted" if is_code(text) else heading(text) or ("kv" if is_field(text) and not is_section(text) else "paragraph_indent" if deep[0] else "paragraph")
            out.append((kind, text, [" " * indent(lines[k]) + lines[k].text for k in held], [], indent(lines[held[0]])))
        held.clear()
        deep[0] = False

    while i < len(lines):
        x, s = lines[i], lines[i].text
        shift = None if margin is None else x.min_x - margin
        if x.is_row():
            if found := table_at(lines, i):
                held[:] = [k for k in held if k < i - found[1]]
                close()
                out.append(("table", "", [], found[2], 0))
                i = found[0]
                continue
            close()
            held.append(i)
            i += 1
            continue
        if is_section(s):
            close()
        kind = "preformatted" if is_code(s) else heading(s)
        if not kind and not held:
            if is_field(s) and not is_section(s):
                kind = "kv"
            elif shift is not None and shift > 60:
                kind = "paragraph_right" if x.min_x + x.max_x > margin + right else "paragraph_center"
        if kind:
            close()
            out.append((kind, s, [" " * indent(x) + s], [], indent(x)))
        else:
            if shift is not None and 20 < shift < 60:
                close()
                deep[0] = True
            held.append(i)
            if i + 1 < len(lines) and lines[i + 1].y - x.y > 2 * x.h:
                close()
        i += 1
    close()
    return out


# --- random pages ---

SAID = "one two three four five six seven ALPHA BETA 12 3,5 x y ana bee cat dog {;} │││ A1 - 2. B2. name: tot: ends, of".split()


def random_page(rng):
    boxes, y = [], 0.0
    while y < 500:
        style = rng.choice(["text", "text", "text", "row", "row", "two", "head", "field", "short", "section", "code"])
        for _ in range(rng.choice([1, 1, 2, 3])):
            x = float(rng.choice([0, 0, 0, 30, 45, 70, 130]))
            if style == "row":
                x = rng.choice([0.0, 0.0, 10.0, 130.0])
                for c in range(rng.choice([3, 3, 4])):
                    at = x + c * rng.choice([90, 90, 100])
                    for _ in range(rng.choice([1, 1, 2])):
                        t = rng.choice(SAID)
                        boxes.append((at, y + rng.choice([0, 0, 1, 2]), len(t) * 5.0, 9.0, t))
                        at += len(t) * 5 + rng.choice([1, 4, 16])
            elif style == "two":
                for at in (x, x + rng.choice([120, 160, 260, 420])):
                    t = rng.choice(SAID)
                    boxes.append((at, y, len(t) * 5.0, 10.0, t))
            else:
                n = {"text": rng.randint(4, 9), "head": 1, "field": 3, "short": 2, "section": 4, "code": 2}[style]
                said = [rng.choice(SAID) for _ in range(n)]
                if style == "field":
                    said[0] = rng.choice(["name:", "total:"])
                if style == "section":
                    said[0] = rng.choice(["A1.", "B.2 -", "3.1."])
                if style == "head":
                    said = ["GRAND TITLE"]
                for t in said:
                    boxes.append((x, y + rng.choice([0, 0, 3]), len(t) * 5.0, 10.0, t))
                    x += len(t) * 5 + rng.choice([4, 4, 9, 14])
            y += rng.choice([12, 14, 22, 40])
    return boxes


def of_spark(df):
    out = {}
    for r in df.orderBy("doc", "page", "seq").collect():
        out.setdefault(r.page, []).append((r.kind, r.text, r.raw_lines, r.cells, r.indent))
    return out


def test_random_pages(spark):
    rng = random.Random(11)
    pages = {p: random_page(rng) for p in range(200)}
    rows = [(1, p, k, *b) for p, boxes in pages.items() for k, b in enumerate(boxes)]
    rng.shuffle(rows)
    # one column: pages on which two would be found are left to the next test
    found = {r.page for r in elements.page_columns(spark.createDataFrame(rows, WORDS), elements.PAGE).collect()}
    got = of_spark(elements.page_elements(spark.createDataFrame([r for r in rows if r[1] not in found], WORDS)))
    want = {p: walk(b) for p, b in pages.items() if p not in found}
    assert len(want) > 150 and {k for p in want.values() for k, *_ in p} == {"table", "paragraph", "paragraph_indent", "paragraph_right", "paragraph_center", "kv", "heading1", "heading2", "heading3", "preformatted"}
    for p in want:
        assert got[p] == want[p], p


def test_two_columns_are_read_one_after_the_other(spark):
    rows = [(1, 0, 100 * c + k, c * 400.0 + 40 * (k % 4), 20.0 * (k // 4), 30.0, 10.0, f"{'lr'[c]}{k}") for c in (0, 1) for k in range(24)]
    got = of_spark(elements.page_elements(spark.createDataFrame(rows, WORDS)))[0]
    assert [t[:2] for _, t, *_ in got] == ["l0", "r0"] and all(k == "paragraph" and len(raw) == 6 for k, _, raw, *_ in got)


def test_header_lines_leave_the_open_paragraph(spark):
    rows = [(0, "one", 0), (0, "two", 30), (14, "Item", 60), (14, "Price", 150), (28, "a", 0), (28, "b", 60), (28, "7", 150), (42, "c", 0), (42, "d", 60), (42, "9", 150)]
    boxes = [(float(x), float(y), 5.0 * len(t), 10.0, t) for y, t, x in rows]
    got = of_spark(elements.page_elements(spark.createDataFrame([(1, 0, k, *b) for k, b in enumerate(boxes)], WORDS)))[0]
    assert got == walk(boxes) and got[-1][3][0] == ["", "Item", "Price"] and got[0][1] == "one two"


def test_a_group_is_parted_at_several_boundaries(spark):
    words = [(0.0, 20.0, "a"), (30.0, 20.0, "b"), (55.0, 20.0, "c"), (76.0, 20.0, "d"), (110.0, 30.0, "e")]
    item = F.array(*(F.struct(F.lit(x).alias("x0"), F.lit(x + w).alias("x1"), F.lit(t).alias("text")) for x, w, t in words))
    for bounds in ([25.0, 100.0], [50.0], [75.5], [200.0], [], [10.0, 40.0, 60.0, 105.0, 120.0]):
        own = F.array(*map(F.lit, bounds)).cast("array<double>")
        got = spark.range(1).select(F.transform(elements.parted(item, own), lambda p: F.transform(p, lambda v: v["text"])).alias("x")).first().x
        assert got == [[b[4] for b in p] for p in pieces([(x, 0, w, 0, t) for x, w, t in words], bounds)], bounds


def test_odd_rows(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 1.0, 5.0, "|||"), (1, 1, 0, 0.0, 0.0, 1.0, 5.0, "a longer one"), (2, 0, 0, 5.0, 5.0, 9.0, 5.0, None), (2, 0, 1, 20.0, 5.0, 9.0, 5.0, "x"), (None, 0, 0, 0.0, 0.0, 9.0, 9.0, "n")]
    got = elements.page_elements(spark.createDataFrame(rows, WORDS).withColumns({"line": F.lit(7), "column": F.lit(8), "cells": F.lit("c"), "nth": F.lit(1)}))
    assert {(r.doc, r.page, r.text) for r in got.collect()} == {(1, 1, "a longer one"), (2, 0, "x")}
    assert elements.page_elements(spark.createDataFrame([], WORDS)).count() == 0


def test_words_to_markdown(spark):
    said = {0: ["ONE HEADING", "some words that go on,"], 1: [], 2: ["name: Ana", "and more words"]}
    rows = [(1, p, k, 0.0, 40.0 * k, 100.0, 10.0, t) for p, texts in said.items() for k, t in enumerate(texts)]
    pages = spark.createDataFrame([(1, p) for p in said], "doc long, page int")
    made = export.across_pages(elements.page_elements(spark.createDataFrame(rows, WORDS)), pages)
    assert export.as_markdown(made, pages).first().text == "## ONE HEADING\n\nsome words that go on,\n\n---\n\n---\n\n**name:** Ana\n\nand more words\n"


@pytest.mark.parametrize("name", ["page_elements", "page_tables"])
def test_queries(spark, sf, name):
    from palimpsest.plans import documents

    rows = documents.queries()[name](spark, sf).collect()
    assert len(rows) > 100
    if name == "page_elements":
        boxes = {}
        for r in documents.text_words(spark, sf).filter("doc in (0, 1, 2, 3, 4, 5, 11)").orderBy("word").collect():
            boxes.setdefault((r.doc, r.page), []).append((r.x, r.y, r.w, r.h, r.text))
        got = {}
        for r in sorted(rows, key=lambda r: (r.doc, r.page, r.seq)):
            got.setdefault((r.doc, r.page), []).append((r.kind, r.text, r.raw_lines, r.cells, r.indent))
        plain = {k: walk(b) for k, b in boxes.items() if k[0] % 10}
        assert len(plain) > 4 and sum(got[k] == v for k, v in plain.items()) == len(plain)
