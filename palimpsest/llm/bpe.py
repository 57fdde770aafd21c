"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece there is one token with which its encoding ends. An
automaton over the vocabulary yields the tokens that are suffixes of each prefix;
the one that is compatible with the last token of what stands before it is stored,
and back-pointers from the end of the piece give the exact ids. Two tokens are
compatible if no merge across their border comes before the merges that made them.
The merges come from the tokenizer's file; nothing is trained.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import on_workers, text_of
from palimpsest.llm.tokens import LETTERS, MARKS, NOTHING, SPACE, Encoder, both, byte_chars, slices

#: Fixed value: the pre-tokenizer's pattern of byte_bpe_50k.json, with Unicode's white space written out.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

_codecs: dict[str, "PrefixCodec"] = {}


class Suffixes:
    """An automaton over tokens' bytes. From the state of a prefix one byte leads to
    the state of the longer one; ends: size and id of the tokens that are suffixes of a
    state's prefix, longest first. States may be kept and gone on from."""

    def __init__(self, tokens: Iterable[tuple[bytes, int]]) -> None:
        self.goto: dict[int, int] = {}  # state * 256 + byte
        goto, own, depth = self.goto, [()], [0]
        for raw, token in tokens:
            at = 0
            for byte in raw:
                key = at << 8 | byte
                if key not in goto:
                    goto[key] = len(own)
                    own.append(())
                    depth.append(depth[at] + 1)
                at = goto[key]
            own[at] = ((len(raw), token),)
        self.fail, self.ends = [0] * len(own), own
        for key in sorted(goto, key=lambda k: depth[k >> 8]):
            state, at, byte = goto[key], self.fail[key >> 8], key & 255
            if key >> 8:
                while at and at << 8 | byte not in goto:
                    at = self.fail[at]
                self.fail[state] = goto.get(at << 8 | byte, 0)
            if more := self.ends[self.fail[state]]:
                own[state] = own[state] + more if own[state] else more
        for byte in range(256):
            goto.setdefault(byte, 0)


class PrefixCodec(Encoder):
    """Parts texts as Encoder does; the ids of cuts are those of their pieces, which come
    from encode_pieces() and stay in a bounded table."""

    def __init__(self, path: str, most: int = 200_000) -> None:
        import regex

        self.most, self.worded = most, False
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        byte = byte_chars()
        vocab = file["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in file.get("added_tokens", [])}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for x, i in vocab.items():
            self.bytes_of[i] = bytes(byte[c] for c in x if c in byte)
        for x, i in self.special.items():
            self.bytes_of[i] = x.encode()
        #: rank and result of each merge; rank and halves of each merged token
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, t) in self.merge.items():
            if t not in self.halves:
                self.halves[t] = rank, a, b
        single = {self.bytes_of[i]: i for x, i in vocab.items() if len(x) == 1}
        self.single = [single[bytes([b])] for b in range(256)]
        self.automaton = Suffixes((self.bytes_of[i], i) for i in vocab.values() if i in self.halves or len(self.bytes_of[i]) == 1)
        self.bytes_table = pa.array(self.bytes_of, pa.large_binary())
        self.piece = regex.compile(PIECES).findall
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces: dict[str | int, bytes] = {}
        self.tested: dict[tuple[int, int], bool] = {}
        self.sound: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' bytes gives these two tokens again.

        The later merge of the two is undone first; before each step the tokens at
        the border must not have had a merge that came earlier. At equal rank the
        merge further left comes first.
        """
        a, b, limit = left, right, (len(self.merge), 0)
        while True:
            across = self.merge.get((a, b))
            if across and (across[0], 1) < limit:
                return False
            # merges of equal rank: in a (0) before the border (1) before b (2)
            undo_a, undo_b = self.halves.get(a), self.halves.get(b)
            if not undo_a and not undo_b:
                return True
            if undo_a and (not undo_b or undo_a[0] > undo_b[0]):
                limit, a = (undo_a[0], 0), undo_a[2]
            else:
                limit, b = (undo_b[0], 2), undo_b[1]

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it: its halves do, and no merge
        at their border comes before its own."""
        if (known := self.sound.get(token)) is None:
            made = self.halves.get(token)
            known = self.sound[token] = not made or self.merged(self.bytes_of[token]) == [token]
        return known

    def merged(self, raw: bytes) -> list[int]:
        """Merge by merge, lowest rank and leftmost first; for tokens, once each."""
        ids = [self.single[b] for b in raw]
        while len(ids) > 1:
            best = min((self.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge) if any(p in self.merge for p in zip(ids, ids[1:])) else None
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merge[ids[i], ids[i + 1]][1]]
        return ids

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids of pieces. In their order neighbours begin alike, and what is stored
        for the prefixes of one stays for those that the next one shares with it."""
        out, tested, before = {}, self.tested, b""
        goto, fail, ends = self.automaton.goto, self.automaton.fail, self.automaton.ends
        states, last = [0], [(0, 0)]  # of each prefix: the state, and its last token with its start
        for raw, piece in sorted((x.encode(), x) for x in pieces):
            same, most = 0, min(len(raw), len(before))
            while same < most and raw[same] == before[same]:
                same += 1
            del states[same + 1 :], last[same + 1 :]
            before, state = raw, states[same]
            for end in range(same + 1, len(raw) + 1):
                byte = raw[end - 1]
                while (then := goto.get(state << 8 | byte)) is None:
                    state = fail[state]
                state = then
                states.append(state)
                for size, token in ends[state]:
                    start = end - size
                    if start:
                        pair = last[start][0], token
                        fits = tested.get(pair)
                        if fits is None:
                            if len(tested) >= self.most:
                                tested.clear()
                            fits = tested[pair] = self.compatible(*pair)
                    else:
                        fits = self.whole(token)
                    if fits:  # the one token of this prefix
                        last.append((token, start))
                        break
                else:
                    raise ValueError(f"no token ends {raw[:end]!r}")
            ids, end = [], len(raw)
            while end:
                token, end = last[end]
                ids.append(token)
            out[piece] = array("I", ids[::-1]).tobytes()
        return out

    def pieces_of(self, key: str) -> list[str | int]:
        """A key's pieces, and the ids of special tokens in it."""
        cut = key[1:] if key[:1] == "\0" else key if key[:1] == "\n" else " " + key
        if not self.marks or "<" not in cut:
            return self.piece(cut)
        out, at = [], 0
        for m in self.marks.finditer(cut):
            out += *self.piece(cut[at : m.start()]), self.special[m[0]]
            at = m.end()
        return out + self.piece(cut[at:])

    def ids_of(self, keys: pa.Array) -> pa.Array:
        plain, cuts = self.plain(keys)
        words = pc.utf8_rtrim(cuts, MARKS).dictionary_encode()
        marks = pc.utf8_ltrim(cuts, LETTERS).dictionary_encode()
        parts = [(x[0], x[1:]) if x[0] == "\n" else (x,) for x in words.dictionary.to_pylist()]
        parts += [(x,) if x else () for x in marks.dictionary.to_pylist()]
        parts += map(self.pieces_of, keys.filter(pc.invert(plain)).to_pylist())
        known = self.pieces
        new = {x for p in parts for x in p if x not in known}
        if len(known) + len(new) > self.most:
            known.clear()
            new = {x for p in parts for x in p}
        numbers = {x for x in new if isinstance(x, int)}
        known.update({x: array("I", [x]).tobytes() for x in numbers}, **self.encode_pieces(new - numbers))
        ids = pa.array([known[p[0]] if len(p) == 1 else b"".join([known[x] for x in p]) for p in parts], pa.large_binary())
        for x in new - numbers:
            if len(x) > 64:
                del known[x]
        n, m = len(words.dictionary), len(marks.dictionary)
        found = pc.binary_join_element_wise(ids[:n].take(words.indices), ids[n : n + m].take(marks.indices), NOTHING.cast(pa.large_binary()))
        return both(plain, found, ids[n + m :])

    def decode_all(self, some: list[bytes]) -> list[str]:
        """The texts that the ids of many documents stand for."""
        ids = np.frombuffer(b"".join(some), "<u4")
        raw = slices(self.bytes_table.take(pa.array(ids)), np.array([len(x) // 4 for x in some], np.int64))
        return [x.decode("utf-8", "replace") for x in raw]


def codec(path: str) -> PrefixCodec:
    if path not in _codecs:
        _codecs[path] = PrefixCodec(path)
    return _codecs[path]


def parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker holds few texts and ids at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, tokenizer: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of every document; if
    asked for, text as decoded from those ids in the same pass.

    A null text is empty and has no ids; special tokens' strings in a text become
    those tokens; equal rows are encoded one by one, and a null doc_id stays null.
    """
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = codec(tokenizer)
        for batch in parts(batches):
            ids = list(x.encode(batch.column("text").to_pylist()))
            columns = [batch.column("doc_id"), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(x.decode_all(ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])

    schema = "doc_id long, ids binary" + ", text string" * decoded
    return text_of(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the text that the ids stand for; null ids give null."""
    on_workers(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = codec(tokenizer)
        for batch in parts(batches):
            raw = batch.column("ids").to_pylist()
            texts = [None if ids is None else t for ids, t in zip(raw, x.decode_all([ids or b"" for ids in raw]))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
