"""Toxicity by a linear-chain conditional random field over a text's words.

Two states, clean and toxic. Labels are of documents, so that token labels are
derived first: a greedy cover picks the words and word beginnings that explain
toxic documents and hardly occur in clean ones; their tokens in toxic documents
are the labelled toxic tokens. The field's emission and transition weights are
then fitted to the labelled tokens' likelihood. Scoring runs forward and backward
over whole texts; words without a learnt feature are neutral, and a run of neutral
words is one power of a 2 x 2 matrix, so that the pass is exact and short. The
marginals of a document's words become its score and its offending offsets.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import lean, on_workers

#: Labelled documents of each class that the model is fitted on, at most.
TRAIN_DOCS = 2000
#: Features at most, and the lengths of word beginnings.
FEATURES, PREFIXES = 2000, (4, 5, 6, 7, 8)
THRESHOLD = 0.3
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
WORD = re.compile(r"\S+")
REACH, WINDOW = 5, 24


def features(word: str) -> list[str]:
    """Of a word in lower case: itself and its beginnings, without marks at its edges."""
    word = EDGES.sub("", word)
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)] if word else []


@dataclass
class Field:
    """emission[f]: weight of feature f in the toxic state; bias: of that state;
    moves[i][j]: weight of going from state i to state j. Texts start clean."""

    emission: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    moves: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def __post_init__(self) -> None:
        m = np.exp(np.array(self.moves, float))
        self.step = m * np.array([1.0, np.exp(self.bias)])
        values, vectors = np.linalg.eig(self.step)
        order = np.argsort(-values)
        self.values, self.left = values[order], vectors[:, order]
        self.right = np.linalg.inv(self.left)
        #: marginal of a word in a long neutral run
        self.neutral = float(self.left[1, 0] * self.right[0, 1])

    def power(self, n: int) -> np.ndarray:
        """The n-th power of a neutral word's matrix, scaled to stay in range."""
        return (self.left * np.array([1.0, (self.values[1] / self.values[0]) ** n])) @ self.right

    def weight(self, word: str) -> float:
        """What a word adds to the neutral emission; 0.0 for most."""
        return sum(self.emission.get(f, 0.0) for f in features(word))

    def marginals(self, n: int, at: list[int], weights: list[float]) -> list[float]:
        """P(toxic) of the words at these places (ascending) among n."""
        ahead, before, last = [], np.array([1.0, 0.0]), -1
        for i, w in zip(at, weights):
            before = before @ self.power(i - last - 1) @ self.step * np.array([1.0, np.exp(w)])
            before, last = before / before.sum(), i
            ahead.append(before)
        behind, last, out = np.array([1.0, 1.0]), n, []
        for i, w, a in zip(reversed(at), reversed(weights), reversed(ahead)):
            behind = self.power(last - i - 1) @ behind
            behind = behind / behind.sum()
            p = a * behind
            out.append(float(p[1] / p.sum()))
            behind, last = self.step @ (np.array([1.0, np.exp(w)]) * behind), i
        return out[::-1]


    def tagged(self, weights: "Weights", text: str) -> tuple[list[int], list[float]]:
        """Positions of the words that have a learnt feature, and their marginals."""
        w = list(map(weights.__getitem__, text.lower().split()))
        if not any(w):
            return [], []
        at = [i for i, x in enumerate(w) if x]
        return at, self.marginals(len(w), at, [w[i] for i in at])

    def total(self, marginals: list[float]) -> float:
        """A document's score: that a word with a learnt feature, or one neutral
        word, is toxic."""
        clean = 1.0 - self.neutral
        for p in marginals:
            clean *= 1.0 - p
        return min(1.0, max(0.0, 1.0 - clean))

    def score(self, weights: "Weights", text: str) -> float:
        return self.total(self.tagged(weights, text)[1])


class Weights(dict):
    """Caches Field.weight for words; emptied when full."""

    def __init__(self, model: Field, most: int = 500_000) -> None:
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        w = self[word] = self.model.weight(word)
        return w


def families(texts: list[str]) -> list[int]:
    """Positions of one text of each family: those that share any of 24 minimal
    hashes of five-word shingles with an earlier one are near copies of it."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, text in enumerate(texts):
        words = text.split()
        grams = {" ".join(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
        hashes = np.array([zlib.crc32(g.encode()) for g in grams], np.uint64)
        keys = {(k, int((hashes * np.uint64(2 * 0x9E3779B1 * k + 0x85EBCA6B) % np.uint64(4294967311)).min())) for k in range(24)}
        if seen.isdisjoint(keys):
            out.append(i)
        seen |= keys
    return out


def cues(toxic: list[list[str]], clean: list[list[str]], known, most: int = FEATURES) -> list[str]:
    """Greedy cover over documents' words: the feature that explains most toxic
    documents which none explains yet, less those clean ones that hold it; then those
    that are as telling by themselves. known(word): the word's features."""
    of = lambda doc: {f for w in set(doc) for f in known(w)}
    in_toxic, in_clean = Counter(), Counter()
    for doc in toxic:
        in_toxic.update(of(doc))
    least = max(2, len(toxic) // 400)
    often = {f for f, n in in_toxic.items() if n >= least}
    for doc in clean:
        in_clean.update(of(doc) & often)
    scale = len(toxic) / max(1, len(clean))
    price = lambda f: 5 * scale * in_clean[f]
    often = {f for f in often if in_toxic[f] - price(f) >= least and in_toxic[f] >= 10 * scale * in_clean[f]}
    where: dict[str, set[int]] = defaultdict(set)
    for i, doc in enumerate(toxic):
        for f in of(doc) & often:
            where[f].add(i)
    left, open_, found = dict(where), set(range(len(toxic))), []
    while left and len(found) < most:
        gain, f = max((len(docs & open_) - price(f), f) for f, docs in left.items())
        if gain < least:
            break
        found.append(f)
        open_ -= left.pop(f)
        left = {g: docs for g, docs in left.items() if len(docs & open_) - price(g) >= least}
    chosen = set(found)
    telling = [f for f, docs in where.items() if f not in chosen and len(docs) >= 5 * least and in_clean[f] * scale * 50 <= len(docs)]
    return found + sorted(telling, key=lambda f: (-len(where[f]), f))[: most - len(found)]


def fit(toxic: list[str], clean: list[str], rounds: int = 150) -> Field:
    """Fit the field on labelled texts; without toxic ones, all words are neutral."""
    shared: dict[str, str] = {}
    split = lambda texts: [[shared.setdefault(w, w) for w in x.lower().split()] for x in texts]
    toxic_words, clean_words = split([toxic[i] for i in families(toxic)]), split(clean)
    names = {f: i for i, f in enumerate(cues(toxic_words, clean_words, features))}
    if not names:
        return Field()
    cache: dict[str, list[int]] = {}

    def of_word(word: str) -> list[int]:
        if (x := cache.get(word)) is None:
            x = cache[word] = [names[f] for f in features(word) if f in names]
        return x

    windows: list[tuple[list[list[int]], list[int]]] = []
    for label, side in ((1, toxic_words), (0, clean_words)):
        for number, doc in enumerate(side):
            known = [of_word(w) for w in doc]
            hits = [i for i, k in enumerate(known) if k]
            at = 0
            for i in hits + ([] if number % 4 else [len(doc) // 2]):
                if i >= at:  # a window from some words before to the place where it is full
                    a, at = max(at, i - REACH), max(at, i - REACH) + WINDOW
                    windows.append((known[a:at], [label if k else 0 for k in known[a:at]]))
    n = len(windows)
    y, mask = np.zeros((n, WINDOW), int), np.zeros((n, WINDOW), bool)
    rows, cols = [], []
    for i, (known, labels) in enumerate(windows):
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
        for t, k in enumerate(known):
            rows += [i * WINDOW + t] * len(k)
            cols += k
    rows, cols = np.array(rows), np.array(cols)
    weights = np.zeros(len(names) + 5)  # features, bias, moves
    seen, moment, speed = np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(weights)
    path = np.concatenate([np.zeros((n, 1), int), y], 1)
    seen[:-5] = np.bincount(cols, y.ravel()[rows], len(names))
    seen[-5] = (y * mask).sum()
    seen[-4:] = np.bincount((2 * path[:, :-1] + path[:, 1:])[mask], minlength=4)
    for step in range(1, rounds + 1):
        e = (np.bincount(rows, weights[cols], n * WINDOW) + weights[-5]).reshape(n, WINDOW)
        moves = weights[-4:].reshape(2, 2)
        toll, pair = expected(e, moves, mask)
        got = np.concatenate([np.bincount(cols, toll.ravel()[rows], len(names)), [toll.sum()], pair.ravel()])
        slope = (seen - got) / n - 1e-4 * weights
        moment, speed = 0.9 * moment + 0.1 * slope, 0.99 * speed + 0.01 * slope**2
        weights += 0.15 * moment / (1 - 0.9**step) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-6)
    return Field({f: float(weights[i]) for f, i in names.items()}, float(weights[-5]), tuple(map(tuple, weights[-4:].reshape(2, 2).tolist())))


def expected(e: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over windows side by side: P(toxic) of each word, and the
    expected number of each move."""
    n, length = e.shape
    m = np.exp(moves)
    out = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], 2)
    ahead = np.zeros((n, length + 1, 2))
    ahead[:, 0, 0] = 1
    for t in range(length):
        x = ahead[:, t] @ m * out[:, t]
        ahead[:, t + 1] = np.where(mask[:, t, None], x / x.sum(1, keepdims=True), ahead[:, t])
    behind = np.ones((n, length + 1, 2))
    for t in range(length - 1, -1, -1):
        x = (out[:, t] * behind[:, t + 1]) @ m.T
        behind[:, t] = np.where(mask[:, t, None], x / x.sum(1, keepdims=True), behind[:, t + 1])
    one = ahead[:, 1:] * behind[:, 1:]
    toll = np.where(mask, one[:, :, 1] / one.sum(2), 0)
    both = ahead[:, :-1, :, None] * m * (out * behind[:, 1:])[:, :, None, :]
    both = both / both.sum((2, 3), keepdims=True) * mask[:, :, None, None]
    return toll, both.sum((0, 1))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """Fit on at most train_docs labelled documents of each class, chosen by a hash
    of their ids; rows whose crc32(doc_id as text) mod 4 is 2 are never used. Null ids
    and null texts are not fitted on; empty tables give a field without features."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    known = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.filter(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs) for x in (1, 0)]
    # at most 2 * train_docs ids, and one text of each: of rows that repeat an id, the least
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").isNotNull()).join(F.broadcast(some[0].unionByName(some[1])), "doc_id")
    rows = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic == 0])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and spans (start, end, p) of the offending words,
    offsets in characters. A null or empty text has the score of a neutral word and
    no spans; equal rows are scored one by one; other columns are ignored.
    """
    spark = docs.sparkSession
    on_workers(spark)
    told = spark.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = told.value
        cache = Weights(field)
        kind = pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "p": pa.float64()}))
        for batch in batches:
            points, spans = [], []
            for text in batch.column("text").to_pylist():
                at, p = field.tagged(cache, text)
                points.append(field.total(p))
                bad = {i: x for i, x in zip(at, p) if x >= 0.5}
                spans.append([{"start": m.start(), "end": m.end(), "p": bad[i]} for i, m in enumerate(WORD.finditer(text)) if i in bad] if bad else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(points, pa.float64()), pa.array([int(x >= threshold) for x in points], pa.int32()), pa.array(spans, kind)], ["doc_id", "score", "predicted", "spans"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return x.mapInArrow(lean(run), "doc_id long, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


def keep(docs: DataFrame, model: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below threshold;
    scored in the pass that reads them."""
    names = docs.columns
    on_workers(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Weights(told.value)
        for batch in batches:
            points = [told.value.score(cache, x or "") for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([p < threshold for p in points], pa.bool_()))

    return docs.select(*names).mapInArrow(lean(run), docs.schema)
