"""Whole-text encoding for the packing and the binary writer.

A text is cut before white space that follows another character. No piece of the
pre-tokenizers of byte_bpe_50k.json and word_bpe_49k.json crosses such a place,
so that the ids of a text are those of its cuts in turn. Words go to tiktoken, by
the same merges; other cuts to the library.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from palimpsest.llm.common import KEPT

#: Unicode White_Space without the four separators U+001C-1F that only Python counts.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CUTS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: A text with one of these is cut by CUTS; others at their spaces and line ends, which is faster.
ODD = ("  ", " \n", "\n ", "\n\n\n", "\t", "\r", "\x00", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "<|")


def byte_chars() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write for it:
    printable Latin-1 for itself, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Marks that may follow the letters of a plain cut, what else is in it, and the keys of plain cuts, which nearly all are.
MARKS, LETTERS = ".,;:!?#$%&*", f" \n{string.ascii_letters}{''.join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))}"
PLAIN_KEY = "^(\\x00[ \n]?|\n?)[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?#$%&*]*$"
NOTHING = pa.scalar("", pa.large_string())
#: Characters of texts whose cuts are told apart at once.
CHUNK = 4 << 20


def slices(values: pa.Array, counts: np.ndarray) -> list[bytes]:
    """Runs of so many values of a large binary array, each as one string of bytes."""
    at = np.frombuffer(values.buffers()[1], "<i8")[values.offset :][np.r_[0, np.cumsum(counts)]].tolist()
    raw = memoryview(values.buffers()[2] or b"")
    return [raw[a:b].tobytes() for a, b in zip(at, at[1:])]


def binaries(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A large binary array; each value has so many of the ids, in turn."""
    at = np.r_[0, 4 * np.cumsum(sizes)].astype("<i8")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(ids.astype("<u4"))])


def both(mask: pa.Array, yes: pa.Array, no: pa.Array) -> pa.Array:
    """The values of `yes` and `no`, each in turn, where the mask is true and false."""
    told = mask.to_numpy(zero_copy_only=False)
    at = np.empty(len(told), np.int64)
    at[told], at[~told] = np.arange(len(yes)), len(yes) + np.arange(len(no))
    return pa.concat_arrays([yes, no]).take(pa.array(at))


class Encoder:
    """Ids of texts by those of their cuts, as little-endian unsigned 32-bit integers.

    Equal cuts of some megabytes of text are found at once, and each distinct one is
    encoded once. A key that begins with NUL stands for the rest of it, one that begins with a
    line end for itself, another for itself after a space. Cuts that only the library
    encodes stay in a table of `most` entries: a full one is emptied, which only costs time.
    """

    def __init__(self, path: str, most: int = 100_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.most, self.tokenizer, self.known = most, Tokenizer.from_file(path), {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        with open(path, encoding="utf-8") as f:
            merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in json.load(f)["model"]["merges"]]
        self.worded = any(x.endswith("</w>") for x in vocab)  # a token that ends a word says so; case and white space are dropped
        self.ranks = self._of_words(vocab, merges) if self.worded else self._by_rank(vocab, merges)

    def _by_rank(self, vocab: dict[str, int], merges: list[str]):
        """The same merges for tiktoken, which takes a word with less ado; None
        unless ids follow the merges' order, which that library asks for."""
        made = [vocab[x] for x in merges]
        if made != sorted(made) or len(made) != len(set(made)) or len(vocab) != 256 + len(made):
            return None
        import tiktoken

        byte = byte_chars()
        ranks = {bytes(byte[c] for c in x): i for x, i in vocab.items()}
        self.id_of = np.arange(max(ranks.values()) + 1, dtype="<u4")
        self.stop = ranks[b"\0"]
        return tiktoken.Encoding("plain", pat_str=r" ?\p{L}+|[^\s\p{L}\x00]+|\s|\x00", mergeable_ranks=ranks, special_tokens={})

    def _of_words(self, vocab: dict[str, int], merges: list[str]):
        """The merges within words of a to z for tiktoken, where a capital stands for
        the letter that ends a word; None if two merges make one token."""
        import tiktoken

        def written(x: str) -> bytes | None:
            word = x.removesuffix("</w>")
            if not re.fullmatch("[a-z]+", word):
                return None
            return (word if word == x else word[:-1] + word[-1].upper()).encode()

        single = [x for c in string.ascii_lowercase for x in (c, f"{c}</w>")]
        order = [x for x in [*single, *merges] if written(x)]
        if len(order) != len(set(order)) or not vocab.keys() >= set(order):
            return None
        self.id_of, self.stop = np.array([*(vocab[x] for x in order), 0], "<u4"), len(order)
        return tiktoken.Encoding("words", pat_str=r"[A-Za-z]+|\x00", mergeable_ranks={written(x): i for i, x in enumerate(order)} | {b"\0": len(order)}, special_tokens={})

    def _ranked(self, cuts: pa.Array) -> pa.Array:
        """The ids of many plain cuts in one call, which part at a NUL after each."""
        if not len(cuts):
            return pa.array([], pa.large_binary())
        ids = self.ranks.encode_to_numpy("\0".join(cuts.to_pylist()) + "\0").astype(np.int64)
        stops = np.flatnonzero(ids == self.stop)
        return binaries(self.id_of[ids[ids != self.stop]], np.diff(np.r_[-1, stops]) - 1)

    def _by_library(self, keys: list[str]) -> list[bytes]:
        known = self.known
        new = [k for k in keys if k not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = keys
        cuts = [k[1:] if k[:1] == "\0" else k if k[:1] == "\n" or self.worded else " " + k for k in new]
        for k, e in zip(new, self.tokenizer.encode_batch_fast(cuts, add_special_tokens=False)):
            known[k] = array("I", e.ids).tobytes()
        return [known[k] for k in keys]

    def ids_of(self, keys: pa.Array) -> pa.Array:
        """The ids of distinct keys."""
        if not self.ranks:
            return pa.array(self._by_library(keys.to_pylist()), pa.large_binary())
        if self.worded:  # a word of letters is one piece, and so is a run of marks
            words = pc.utf8_rtrim(keys, MARKS)
            plain = pc.match_substring_regex(words, "^[a-z]+$")
            words, whole = words.filter(plain), keys.filter(plain)
            each = words.dictionary_encode()
            ends = pc.binary_join_element_wise(pc.utf8_slice_codeunits(each.dictionary, 0, -1), pc.utf8_upper(pc.utf8_slice_codeunits(each.dictionary, -1)), NOTHING)
            marks = pc.utf8_ltrim(whole, string.ascii_lowercase).dictionary_encode()
            mark_ids = pa.array(self._by_library(marks.dictionary.to_pylist()), pa.large_binary())
            found = pc.binary_join_element_wise(self._ranked(ends).take(each.indices), mark_ids.take(marks.indices), NOTHING.cast(pa.large_binary()))
        else:
            plain, cuts = self.plain(keys)
            found = self._ranked(cuts)
        rest = pa.array(self._by_library(keys.filter(pc.invert(plain)).to_pylist()), pa.large_binary())
        return both(plain, found, rest)

    @staticmethod
    def plain(keys: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Which keys are plain, and the cuts that those stand for."""
        plain = pc.match_substring_regex(keys, PLAIN_KEY)
        some = keys.filter(plain)
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), some, NOTHING)
        return plain, pc.utf8_ltrim(pc.if_else(pc.match_substring_regex(some, "^[\\x00\n]"), some, spaced), "\0")

    def simple(self, text: str) -> bool:
        """Whether the text is cut at its spaces and line ends."""
        if not text or any(x in text for x in ODD) or text.endswith("\n\n"):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:  # perhaps with other white space
            return False
        return True

    def _chunk(self, texts: list[str]) -> list[bytes]:
        is_simple = np.array([self.simple(x) for x in texts], bool)
        order = np.r_[np.flatnonzero(is_simple), np.flatnonzero(~is_simple)].tolist()
        some, rest = (order[: (n := int(is_simple.sum()))], order[n:])
        if self.worded:
            cut = pc.utf8_lower(pa.array([texts[i].replace("\n", " ") for i in some], pa.large_string()))
        else:
            cut = pa.array(["\0" + texts[i].replace("\n", " \n") for i in some], pa.large_string())
        cut = pc.split_pattern(cut, " ")
        odd = [["\0" + x for x in CUTS.findall(texts[i])] for i in rest]
        counts = np.r_[pc.list_value_length(cut).to_numpy(zero_copy_only=False), [len(x) for x in odd]].astype(np.int64)
        each = pa.concat_arrays([cut.flatten().cast(pa.large_string()), pa.array([k for x in odd for k in x], pa.large_string())]).dictionary_encode()
        out: list[bytes] = [b""] * len(texts)
        for i, x in zip(order, slices(self.ids_of(each.dictionary).take(each.indices), counts)):
            out[i] = x
        return out

    def encode(self, texts: list[str], size: int = CHUNK) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            stop, n = at, 0
            while stop < len(texts) and n < size:
                n += len(texts[stop])
                stop += 1
            yield from self._chunk(texts[at:stop])
            at = stop


def encoder(path: str) -> Encoder:
    """One for each file in a Python worker; workers are reused by later tasks."""
    if path not in KEPT:
        KEPT[path] = Encoder(path)
    return KEPT[path]


def byte_table(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; an added token stands for its text."""
    name = f"{path} bytes"
    if name not in KEPT:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        byte, vocab = byte_chars(), whole["model"]["vocab"]
        added = {x["id"]: x["content"].encode() for x in whole.get("added_tokens", [])}
        KEPT[name] = [b""] * (max([*vocab.values(), *added]) + 1)
        for x, i in vocab.items():
            KEPT[name][i] = added.get(i) or bytes(byte[c] for c in x)
        for i, x in added.items():
            KEPT[name][i] = x
    return KEPT[name]
