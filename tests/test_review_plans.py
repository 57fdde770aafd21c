"""Queries over whole tables and whole texts."""

import re
import unicodedata

from palimpsest.plans import queries as plans


def test_merge_takes_every_conversation(spark, tmp_path):
    rows = [(c, t, "user", f"{c}-{t}") for c in [*range(45), None] for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = plans.queries()["page_merge_all"](spark, str(tmp_path)).collect()
    want = {}
    for c, _, _, text in rows:
        want.setdefault(None if c is None else c // 2, []).append(text)
    mine = {}
    for r in sorted(got, key=lambda r: r.pos):
        mine.setdefault(r.doc, []).append(r.text)
    assert mine == want


def normal(text: str) -> str:
    text = re.sub(r"[ \t]+", " ", unicodedata.normalize("NFC", text).replace("\u00a0", " "))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rate_counts_every_character(spark, tmp_path):
    texts = ["résumé\nà la carte", "resume\ta la carte", "Ünïcödé 中文 🙂", "Unicode 中国 🙃", "", None, "plain\r\nascii", "e\u0301  \u00e9\u00a0x\n\n\n\ny"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: (r.distance, r.cer) for r in plans.queries()["cer_whole_texts"](spark, str(tmp_path)).collect()}
    pairs = [(normal(a or ""), normal(b or "")) for a, b in zip(texts, texts[1:])]
    assert got == {i: (distance(a, b), round(distance(a, b) / max(len(b), 1), 6)) for i, (a, b) in enumerate(pairs)}
