"""Spelling variants: words at one edit from each other, by range reporting in two dimensions.

In a block of words of one length, a word is a point: its rank in forward order and its
rank in the order of the reversed words. For each edit position, the words that share
what stands before it are an interval of the first rank, those that share what stands
after it an interval of the second, and a wavelet tree over the points reports the
words in both. With a word's own length these differ by one replaced code point, with
the next length by one inserted one.

Words are dealt to blocks of bounded size twice, by ranges of forward and of reversed
order. A word asks the forward blocks for edits behind a split point of its own and the
reversed blocks for edits before it, and the split is chosen so that it has to ask few.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import joined_evenly, lean, on_workers, written

#: Code points of a word, its occurrences, and how many times those of a word its form has, all at least.
LEAST_LENGTH, LEAST_N, TIMES = 7, 2, 10
#: One in so many (document, run) pairs loses a code point.
EVERY = 31
#: Words in a block, the most blocks of an order, and the samples for each that give the boundaries.
BLOCK, MOST_BLOCKS, SAMPLES = 16_384, 4096, 32
#: A boundary is so much of a word: any string will do as one.
BOUNDARY = 64
#: Words that a task counts before it passes the counts on.
HELD = 300_000
LAST = chr(0x10FFFF)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_n: int = LEAST_N) -> DataFrame:
    """word, n: the runs of letters of all texts, where one in 31 pairs of a document and
    a run has lost a code point; counts meet in each task before they are shuffled."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")  # deletion only shortens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, times in Counter(runs.findall(text.as_py().lower().decode())).items():  # bytes.lower() changes A-Z only
                    h = zlib.crc32(word.encode(), begun)
                    if h % EVERY == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] += times
            if len(counts) > HELD:
                yield told()
        yield told()

    on_workers(docs.sparkSession)
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return x.mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


class WaveletTree:
    """A permutation of 0 .. n - 1, level by level from the highest bit."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for level in reversed(range(self.bits)):
            one = values >> level & 1 == 1
            self.zeros.append(np.r_[0, np.cumsum(~one)])
            values = np.r_[values[~one], values[one]]

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [c, d) at places in [a, b); all queries go down together."""
        query, value = np.arange(len(a)), np.zeros(len(a), np.int64)
        for k, zeros in enumerate(self.zeros):
            size = 1 << self.bits - 1 - k
            left_a, left_b = zeros[a], zeros[b]
            right_a, right_b = a - left_a + zeros[-1], b - left_b + zeros[-1]
            left = (left_a < left_b) & (value + size > c[query]) & (value < d[query])
            right = (right_a < right_b) & (value + 2 * size > c[query]) & (value + size < d[query])
            a, b = np.r_[left_a[left], right_a[right]], np.r_[left_b[left], right_b[right]]
            value = np.r_[value[left], value[right] + size]
            query = np.r_[query[left], query[right]]
        return query, value


class Order:
    """The sorted order of words (rows of code points) and the intervals of members that
    share a beginning."""

    def __init__(self, matrix: np.ndarray, member: np.ndarray) -> None:
        n, width = matrix.shape
        whole = np.ascontiguousarray(matrix.astype(matrix.dtype.newbyteorder(">"))).view(f"V{matrix.itemsize * width}").ravel()  # bytes in the order of code points
        self.order = np.argsort(whole.view(f"S{matrix.itemsize * width}"), kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)
        m = matrix[self.order]
        unlike = m[1:] != m[:-1]
        self.common = np.r_[0, np.where(unlike.any(1), unlike.argmax(1), width)] if n > 1 else np.zeros(n, np.int64)
        self.members = np.r_[0, np.cumsum(member[self.order])]
        self.longest = np.maximum(self.common, np.r_[self.common[1:], 0])[self.rank]  # shared with any other word

    def interval(self, rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks among the members of those that share `depth` code points with the rows."""
        edge = np.flatnonzero(np.r_[True, self.common[1:] < depth])
        of = np.searchsorted(edge, self.rank[rows], "right") - 1
        return self.members[edge[of]], self.members[np.r_[edge, len(self.rank)][of + 1]]


def pairs(words: list[str], member: np.ndarray, first: np.ndarray, length: int, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """(asking, found) indices of words at one edit. words: distinct, of `length` or one
    less; member: may be found (of `length`); first: for each word the first edit position
    that it asks for, above all others where it doesn't ask. Words and positions are
    reversed where `backward`."""
    try:
        matrix = np.array([w.encode("latin-1") for w in words], f"S{length}").view(np.uint8).reshape(-1, length)
    except UnicodeEncodeError:
        matrix = np.array(words, f"U{length}").view(np.uint32).reshape(-1, length)
    sizes = np.array([len(w) for w in words])
    turned = matrix[:, ::-1].copy()
    turned[sizes < length] = np.roll(turned[sizes < length], -1, axis=1)  # the empty place goes last again
    ahead, behind = Order(matrix, member), Order(turned, member)
    members = ahead.order[member[ahead.order]]  # by forward rank
    if not len(members):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.empty(len(words), np.int64)
    back = behind.order[member[behind.order]]
    at[back] = np.arange(len(back))
    tree = WaveletTree(at[members])
    low, high = np.maximum(first, length - 1 - behind.longest), np.minimum(length - 1, ahead.longest)
    asking, found = [], []
    able = low <= high
    for p in range(int(low[able].min(initial=0)), int(high[able].max(initial=-1)) + 1):
        rows = np.flatnonzero((low <= p) & (p <= high))
        if not len(rows):
            continue
        a, b = ahead.interval(rows, p)
        c, d = behind.interval(rows, length - 1 - p)
        some = (a < b) & (c < d)
        rows = rows[some]
        query, value = tree.report(a[some], b[some], c[some], d[some])
        q, v = rows[query], back[value]
        # an inserted code point in a run of the same one counts at the last place of the run
        last = matrix[v, p] != (matrix[q, p - 1] if backward else matrix[q, p]) if p or not backward else np.ones(len(q), bool)
        keep = np.where(sizes[q] == length, q != v, last)
        asking.append(q[keep])
        found.append(v[keep])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(asking or none), np.concatenate(found or none)


def near_in_block(table: pa.Table) -> pa.Table:
    """What the members of one block are to its askers: word, n_near, form_n, form."""
    backward = table.column("backward")[0].as_py()
    rows: dict[str, list] = {}
    for word, n, member, split in zip(*(table.column(c).to_pylist() for c in ("word", "n", "member", "split"))):
        row = rows.setdefault(word, [n, False, None])
        if member:
            row[1] = True
        else:
            row[2] = split
    words = sorted(rows)
    n = np.array([rows[w][0] for w in words], np.int64)
    member = np.array([rows[w][1] for w in words], bool)
    split = np.array([-1 if rows[w][2] is None else rows[w][2] for w in words], np.int64)
    sizes = np.array([len(w) for w in words])
    to, of = [], []
    for m in sorted(set(sizes[member].tolist())):
        some = np.flatnonzero((sizes == m) & (member | (split >= 0)) | (sizes == m - 1) & (split >= 0))
        if len(some) < 2:
            continue
        own, ends = sizes[some], split[some]
        first = np.where(ends < 0, m, m - ends if backward else ends)
        turned = [words[i][::-1] if backward else words[i] for i in some]
        q, v = pairs(turned, member[some] & (own == m), first, m, backward)
        q, v = some[q], some[v]
        inserted = sizes[q] < m
        to += q, v[inserted]
        of += v, q[inserted]
    to, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (to, of))
    best = np.lexsort((of, -n[of], to))  # words are sorted: the smaller index is the smaller word
    head = best[np.r_[True, to[best][1:] != to[best][:-1]]] if len(best) else best
    near = np.bincount(to, minlength=len(words))[to[head]]
    pick = lambda i: pa.array([words[k] for k in i.tolist()], pa.string())
    return pa.table({"word": pick(to[head]), "n_near": pa.array(near, pa.int64()), "form_n": pa.array(n[of[head]], pa.int64()), "form": pick(of[head])})


def routed(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, backward, block, member, split: where each word stands in either order,
    and the blocks that it asks."""
    total = words.count()
    blocks = max(1, min(MOST_BLOCKS, -(-total // block)))
    every = max(1, total // (blocks * SAMPLES))
    drawn = words.filter(F.pmod(F.xxhash64("word"), F.lit(every)) == 0) if blocks > 1 else words.limit(0)
    size = F.length("word").alias("size")
    drawn = drawn.select(size, F.substring("word", 1, BOUNDARY).alias("ahead"), F.substring(F.reverse("word"), 1, BOUNDARY).alias("back")).collect()  # at most about blocks * SAMPLES short strings
    cuts = [sorted((r.size, x) for r, x in ((r, getattr(r, c)) for r in drawn))[SAMPLES - 1 :: SAMPLES] for c in ("ahead", "back")]

    def asked(cut: list, size: int, shared: str) -> set[int]:
        return {b for m in (size, size + 1) for b in range(bisect_right(cut, (m, shared)), bisect_right(cut, (m, shared + LAST)) + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                out = []
                for word, n in zip(*(batch.slice(at, 5000).column(c).to_pylist() for c in ("word", "n"))):
                    size, back = len(word), word[::-1]
                    choices = []
                    for split in dict.fromkeys((size // 2, size // 3, 2 * size // 3, size // 4, 3 * size // 4)):
                        sides = asked(cuts[0], size, word[:split]), asked(cuts[1], size, back[: size - split])
                        choices.append((sum(map(len, sides)), len(choices), split, sides))
                        if choices[-1][0] <= 4:
                            break
                    _, _, split, sides = min(choices, key=lambda x: x[:2])
                    for backward, key in enumerate((word, back)):
                        out.append((word, n, backward == 1, bisect_right(cuts[backward], (size, key)), True, None))
                        out += [(word, n, backward == 1, b, False, split) for b in sides[backward]]
                columns = zip(*out) if out else [()] * 6
                kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n", "backward", "block", "member", "split"])

    return written(words.select("word", "n").mapInArrow(lean(run), "word string, n long, backward boolean, block long, member boolean, split long"), "routed")


def near(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, form_n, form: for each word that has near ones, how many, and the
    one with the largest n. Askers of a block go to several tasks where they are many."""
    rows = routed(words, block)
    crowd = rows.filter("not member").groupBy("backward", "block").count().filter(F.col("count") > 4 * block).collect()  # at most a row for each block
    parts = F.lit(1)
    for r in crowd:
        parts = F.when((F.col("backward") == r.backward) & (F.col("block") == r.block), -(-r["count"] // (4 * block))).otherwise(parts)
    if crowd:
        rows = rows.withColumn("_parts", parts).withColumn("part", F.explode(F.when(F.col("member"), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int")))))
    else:
        rows = rows.withColumn("part", F.lit(0))
    found = rows.groupBy("backward", "block", "part").applyInArrow(lean(near_in_block), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words with a form: forms followed to the last. Each has ten
    times the occurrences of the one before, so that there are few rounds."""
    parents = written(forms.select(F.col("word").alias("root"), F.col("form").alias("next")), "parents")
    now, told, k = written(forms.select("word", F.col("form").alias("root")), "roots"), [], 0
    while not now.isEmpty():
        told.append(now.withColumn("k", F.lit(k)))
        now, k = written(joined_evenly(now, parents, "root").select("word", F.col("next").alias("root")), "roots"), k + 1
    out = told[0] if told else now.withColumn("k", F.lit(0))
    for x in told[1:]:
        out = out.unionByName(x)
    return out.groupBy("word").agg(F.max_by("root", "k").alias("root"))


def variants(docs: DataFrame, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least 7 code points and 2
    occurrences.

    A null text has no words; a null doc_id is written as nothing when a code point is
    to be deleted; rows that repeat a doc_id count each. Of near words with equal n the
    smallest in code-point order is the form. Other columns are ignored; an empty table
    gives no rows. A word of any length is one row of a block.
    """
    words = written(word_counts(docs), "words")
    found = near(words, block).withColumn("n", F.lit(None).cast("long"))
    base = words.select("word", "n", *(F.lit(None).cast(t).alias(c) for c, t in (("n_near", "long"), ("form_n", "long"), ("form", "string"))))
    both = base.unionByName(found).groupBy("word").agg(*(F.max(c).alias(c) for c in ("n", "n_near", "form_n", "form")))  # one row of each at most
    held = F.col("form_n") >= times * F.col("n")
    out = written(both.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(held, F.col("form_n")).alias("form_n"), F.when(held, F.col("form")).alias("form")), "forms")
    root = roots(out.filter("form is not null"))
    return out.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
