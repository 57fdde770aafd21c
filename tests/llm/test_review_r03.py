"""Scratch files and the encoders, as the third review asked."""

from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

from palimpsest.llm import bpe, common, components, exact, neardup, tokens

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def library(path, texts):
    return [b"".join(i.to_bytes(4, "little") for i in x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_scratch_files_stand_alone(spark):
    """No checksum file beside a scratch file of a local disk: each would cost a process of its own."""
    table = common.written(spark.range(1000), "alone")
    folder = Path(table.inputFiles()[0].removeprefix("file:")).parent
    assert table.count() == 1000 and not [f for f in folder.iterdir() if f.suffix == ".crc"]


def test_small_tables_in_few_files(spark, monkeypatch):
    """Tables of near-duplicate rounds have no more files than what they read asks for, also in the
    first round, which knows no links yet; those of links have a file for each core at most."""
    files, real = {}, common.written

    def counted(df, name, *more):
        table = real(df, name, *more)
        files.setdefault(name, []).append(len(table.inputFiles()))
        return table

    for part in (neardup, components):
        monkeypatch.setattr(part, "written", counted)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*words[:40], f"x{i}", *words[40:]])) for i in range(12)] + [(i, " ".join(f"{w}{i}" for w in words)) for i in range(12, 300)]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    conf = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    with exact.settings(spark, conf):
        found = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
        assert {r.doc_id for r in found.filter("kept").collect()} == {0, *range(12, 300)}
    assert spark.conf.get("spark.sql.shuffle.partitions") == parts
    cores = spark.sparkContext.defaultParallelism
    assert max(x for n in files.values() for x in n) <= common.CORE_PARTS * cores
    assert max(files["edges"] + files["large"] + files["roots"]) <= cores


def test_state_files_stand_alone(spark):
    """No checksum file beside a file of the keyed state."""
    before = set(Path(common.shared_dir(spark).removeprefix("file:")).glob("state-*"))
    assert exact.exact_dedup(spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")).filter("kept").count() == 2
    (state,) = set(Path(common.shared_dir(spark).removeprefix("file:")).glob("state-*")) - before
    names = [f.name for f in (state / "state").rglob("*") if f.is_file()]
    assert any(n.endswith(".changelog") for n in names) and not [n for n in names if n.endswith(".crc")]


def test_heaps_are_returned(spark):
    """What the session has left in the heap is collected when a step asks for it."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    spark.range(4_000_000).selectExpr("id", "cast(id as string) as s").orderBy("s").write.format("noop").mode("overwrite").save()
    held = runtime.totalMemory() - runtime.freeMemory()
    common.heaps_returned(spark)
    assert runtime.totalMemory() - runtime.freeMemory() < held


def test_plain_words_need_no_library():
    """Words of letters are encoded together by ranks; every word of the vocabulary, alone and
    before another, gets the library's ids, and only other cuts go to the library."""
    x = tokens.Encoder(WORD)
    words = sorted({w.removesuffix("</w>") for w in x.tokenizer.get_vocab() if w.removesuffix("</w>").isalpha() and w.isascii()})
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)] + [f"{a}{b}" for a, b in zip(words, words[7::3])] + ["Odd, é 12 don't\n\nx  y"]
    assert list(x.encode(texts)) == library(WORD, texts)

    class Refusing:
        def encode_batch_fast(self, cuts, add_special_tokens):
            assert not cuts
            return []

    x.tokenizer, want = Refusing(), library(WORD, ["The cat sat\non the mat"])
    assert list(x.encode(["The cat sat\non the mat"])) == want


def test_shared_prefixes_are_walked_once():
    """Pieces that begin alike share the states of their prefixes."""
    x = bpe.PrefixCodec(BYTE)
    pieces = [" " + "thentionedly" * 8 + a + b for a in "abcdefgh" for b in "stuvwxyz"]
    want = dict(zip(pieces, library(BYTE, pieces)))

    class Counting(dict):
        asked = 0

        def get(self, key):
            Counting.asked += 1
            return dict.get(self, key)

    x.automaton.goto = Counting(x.automaton.goto)
    assert x.encode_pieces(pieces) == want
    assert Counting.asked < 20 * len(pieces)  # of 99 bytes each
