"""Chat formatting: round trips, and the tree against a plain trie."""

import hashlib
import random
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import chat, queries

BYTE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string"
ODD = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "bye"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "hello"),
    (4, 0, "user", "hi"), (4, 1, "assistant", "hullo"), (4, 1, "assistant", "hullo"),
    (5, 0, "tool[TEXT]", "[TEXT] <s>"), (5, None, None, None), (5, 7, "system", "</s>[INST] <\\/s> <\\\\/s> [/INST]<|endoftext|>"),
    (None, 0, "user", "hi"), (None, 1, "assistant", ""),
    (6, 0, "assistant", "\u00e9 \u4e2d\u6587 \U0001f642 \r\n " + "x" * 20000), (7, 0, "", ""), (8, 0, "assistant", "[\\"), (8, 1, "user", "<"),
]


def expected(rows):
    """conv_id, n_turns, digests and counts; rows in the order of the table."""
    groups = defaultdict(list)
    for k, (c, turn, role, text) in enumerate(rows):
        groups[(c, k if c is None else None)].append((turn is not None, turn or 0, k, role or "", text or ""))
    out = []
    for (c, _), turns in groups.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{t}\n" for *_, r, t in turns), "".join(t for *_, r, t in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect())


def tree_of(rows):
    """All distinct beginnings of conversations."""
    groups = defaultdict(list)
    for k, (c, turn, role, text) in enumerate(rows):
        groups[(c, k if c is None else None)].append((turn is not None, turn or 0, k, role or "", text or ""))
    return {tuple((r, t) for *_, r, t in sorted(x)[:n]) for x in groups.values() for n in range(1, len(x) + 1)}


def shape(stream):
    """Checks places, positions and intervals against the paths they give, and returns the paths."""
    library = Tokenizer.from_file(BYTE)
    trees = defaultdict(list)
    for r in stream.filter("not again").orderBy("nth").collect():
        trees[r.tree].append(r)
    paths = set()
    for nodes in trees.values():
        at, text = 0, {}
        for r in nodes:  # depth first, without gaps
            assert r.start == at and r.length == len(r.ids) // 4
            at += r.length
            spans = [(x.start, x.stop) for x in r.ancestors]
            assert spans == sorted(spans) and all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
            assert sum(b - a for a, b in spans) == r.position and (not spans or spans[-1][1] <= r.start)
            above = [s for s in text if any(a <= s < b for a, b in spans)]
            assert len(above) == r.depth
            text[r.start] = chat.parsed(library.decode(array("I", r.ids).tolist(), skip_special_tokens=False))
            path = tuple(text[s] for s in sorted(above)) + (text[r.start],)
            assert path not in paths  # each node once
            paths.add(path)
    return paths


@pytest.mark.parametrize("ranges", [1, 3, 1000])
def test_odd_rows(spark, ranges):
    rows = spark.createDataFrame(ODD, SCHEMA).coalesce(1).withColumns({"path": F.lit("p"), "n": F.lit(1), "row": F.lit(2), "range": F.lit(3)})
    stream, members = chat.format_chats(rows, BYTE, ranges)
    assert result(chat.read_back(stream, members, BYTE)) == expected(ODD)
    assert shape(stream) == tree_of(ODD)


def test_random_trees_in_many_ranges(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]) if t > 2 else "user", rng.choice("ab") * rng.choice([1, 40])) for c in range(300) for t in range(rng.randint(1, 9))]
    stream, members = chat.format_chats(spark.createDataFrame(rows, SCHEMA).coalesce(1), BYTE, 20)
    assert stream.select("range").distinct().count() > 5
    assert result(chat.read_back(stream, members, BYTE)) == expected(rows) and shape(stream) == tree_of(rows)


def test_escapes_come_back():
    import re

    for text in ("</s>", "<\\/s>", "[INST] ok [/INST]", "[\\\\TEXT]", "<|endoftext|>", "<<s>>", "[[INST]", "a\\b", "[s>", ""):
        inside = re.sub(chat.CONTROL, r"\1\2\\\3", text)
        assert chat.plain(inside) == text and not any(x in inside for x in ("</s>", "<s>", "[INST]", "[/INST]", "[TEXT]", "<|endoftext|>"))


def test_empty_table(spark):
    stream, members = chat.format_chats(spark.createDataFrame([], SCHEMA), BYTE)
    assert stream.count() == 0 and chat.read_back(stream, members, BYTE).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    more = [(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))]
    assert result(queries.op12_chat_format(spark, sf)) == expected(rows + more)
