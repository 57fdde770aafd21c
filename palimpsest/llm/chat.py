"""Chat formatting over a prefix tree of conversations.

A conversation is its turns in order. Conversations that begin with the same turns
share them: the distinct ones are sorted by their turns, so that each emits only the
turns beyond what it shares with the one before it. This is the tree in depth-first
order, every node once. A node's row holds the ids of its turn, the place in its
tree's stream, the position id of its first token (the tokens of its ancestors) and
the intervals of the stream that it attends to besides itself.

Sorted conversations are dealt to ranges. What a range begins with, the path of the
last conversation before it, is folded from one summary of each range, so that no node
is emitted twice and no tree has to stay in one task.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import joined_evenly, lean, merged, on_workers, written
from palimpsest.llm.tokens import byte_table, encoder

#: The marks around a turn's text by role; other roles stand between [ROLE] and [TEXT].
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
#: What a text must not hold as it is: a control string, or one that has been escaped already. Escaping puts one more backslash after its first character.
BODY = r"(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|TEXT\]|\|endoftext\|>)"
CONTROL, ESCAPED = rf"([<\[])(\\*){BODY}", rf"([<\[])\\(\\*){BODY}"
#: Distinct conversations in a range, and the most ranges: one summary of each reaches the driver.
RANGE_ROWS, MOST_RANGES = 20_000, 4096


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def plain(text: str, undo=re.compile(ESCAPED)) -> str:
    return undo.sub(r"\1\2\3", text)


def parsed(turn: str, other=re.compile(r"\[ROLE\](.*?)\[TEXT\](.*)\[/ROLE\]", re.S)) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    for role, (head, tail) in MARKS.items():
        if turn.startswith(head):
            return role, plain(turn[len(head) : -len(tail)])
    role, text = other.fullmatch(turn).groups()
    return plain(role), plain(text)


def turns_of(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """One row for each turn, formatted and encoded: row, conv_id, lone (the row itself
    where conv_id is null), turn, digest, learnt, ids, and the ids of head and body."""
    role = F.coalesce("role", F.lit(""))
    head, tail = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (a, b) in MARKS.items():
        head, tail = F.when(role == name, a).otherwise(head), F.when(role == name, b).otherwise(tail)
    x = conversations.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        (role == "assistant").alias("learnt"),
        head.alias("head"),
        escaped(F.coalesce("text", F.lit(""))).alias("body"),
        tail.alias("tail"),
    ).withColumn("digest", F.sha2(F.concat("head", "body", "tail").cast("binary"), 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                parts = [list(ids.encode(batch.column(c).to_pylist())) for c in ("head", "body", "tail")]
                sizes = [pa.array([len(x) // 4 for x in p], pa.int64()) for p in parts[:2]]
                kept = ["row", "conv_id", "turn", "learnt", "digest"]
                yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *sizes, pa.array(map(b"".join, zip(*parts)), pa.binary())], [*kept, "n_head", "n_body", "ids"])

    on_workers(conversations.sparkSession)
    x = x.mapInArrow(run, "row long, conv_id long, turn long, learnt boolean, digest string, n_head long, n_body long, ids binary")
    return written(x.withColumns({"lone": F.when(F.col("conv_id").isNull(), F.col("row")), "n": F.floor(F.octet_length("ids") / 4).cast("long")}), "turns")


def shared(a: list, b: list) -> int:
    """How many first items two lists share."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def in_order(rows: DataFrame) -> DataFrame:
    """Each range whole and in order in a task."""
    return rows.repartition("range").sortWithinPartitions("range", "nth")


def streamed(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[int, Iterator[dict]]]:
    """The ranges of a task, and their rows one after another."""
    return groupby((r for b in batches for at in range(0, b.num_rows, rows) for r in b.slice(at, rows).to_pylist()), lambda r: r["range"])


def summaries(paths: DataFrame) -> dict[int, tuple[int, int, list]]:
    """What each range begins with: the place of its first new token, the turns that its
    first conversation shares with the one before, and those (digest, row, n, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in streamed(batches):
            first, last, starts, low, total = None, [], [], 0, 0
            for row in rows:
                turns = row["turns"]
                keys = [t["digest"] for t in turns]
                common = shared([t["digest"] for t in last], keys)
                low = len(turns) if first is None else min(low, common)
                first, last, starts = first or turns, turns, starts[:common]
                for t in turns[common:]:
                    starts.append(total)
                    total += t["n"]
            yield pa.RecordBatch.from_pylist([{"range": at, "low": low, "total": total, "first": first, "last": last, "starts": starts}], schema)

    some = pa.list_(pa.struct([("digest", pa.string()), ("row", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("range", pa.int64()), ("low", pa.int64()), ("total", pa.int64()), ("first", some), ("last", some), ("starts", pa.list_(pa.int64()))])
    turn = "array<struct<digest string, row long, n long>>"
    found = in_order(paths).mapInArrow(lean(run), f"range long, low long, total long, first {turn}, last {turn}, starts array<long>").collect()
    out, before, at = {}, [], 0
    for r in sorted(found, key=lambda r: r["range"]):
        common = shared([x[0] for x in before], [t.digest for t in r.first])
        skip = sum(t.n for t in r.first[:common])
        out[r["range"]] = at, common, before[:common]
        low = min(common, r.low)
        before = before[:low] + [(t.digest, t.row, t.n, at - skip + s) for t, s in zip(r["last"][low:], r.starts[low:])]
        at += r.total - skip
    return out


def nodes_of(paths: DataFrame) -> DataFrame:
    """The tree's nodes: row of the turn, range, tree (where its root begins in the
    stream of all trees), start, position, depth, ancestors, path (of the conversations
    that end here), again (a node of an earlier range, told once more to its reader)."""
    begins = summaries(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema)

        for at, rows in streamed(batches):
            offset, common, before = begins[at]
            stack: list[tuple] = []  # digest, start, tokens up to its end, intervals up to its end
            out: list[dict] = []

            def push(digest: str, row: int, n: int, start: int, again: bool) -> None:
                tree, position, spans = (stack[0][1], stack[-1][2], stack[-1][3]) if stack else (start, 0, ())
                inside = [{"start": a - tree, "stop": b - tree} for a, b in spans]
                out.append({"row": row, "range": at, "tree": tree, "start": start, "position": position, "depth": len(stack), "ancestors": inside, "path": None, "again": again})
                grown = (*spans[:-1], (spans[-1][0], start + n)) if spans and spans[-1][1] == start else (*spans, (start, start + n))
                stack.append((digest, start, position + n, grown))

            for digest, row, n, start in before:
                push(digest, row, n, start, True)
            for row in rows:
                common = shared([x[0] for x in stack], [t["digest"] for t in row["turns"]])
                del stack[common:]
                for t in row["turns"][common:]:
                    push(t["digest"], t["row"], t["n"], offset, False)
                    offset += t["n"]
                out[-1]["path"] = row["path"]
                if len(out) >= 5000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = pa.schema([("row", pa.int64()), ("range", pa.int64()), ("tree", pa.int64()), ("start", pa.int64()), ("position", pa.int64()), ("depth", pa.int64()), ("ancestors", span), ("path", pa.string()), ("again", pa.bool_())])
    return in_order(paths).mapInArrow(lean(run), "row long, range long, tree long, start long, position long, depth long, ancestors array<struct<start long, stop long>>, path string, again boolean")


def format_chats(conversations: DataFrame, tokenizer: str, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The stream of nodes and each conversation's path (conv_id, path).

    A row of the stream: tree, start (in the stream of the tree), length, position (the
    position id of its first token), depth, ancestors (intervals of the tree's stream),
    ids (little-endian unsigned 32-bit), loss_start and loss_stop (tokens of the row that
    are learnt: an assistant's text; else null), path (of conversations that end there),
    range, nth (order in all), again. Rows with `again` repeat what a reader of one range
    needs of earlier ones: leave them out of training.

    Null texts and roles are empty; turns go by `turn`, a null one first, repeated ones
    by the row. Rows with a null conv_id are conversations of one turn. Other columns
    are ignored; an empty table gives no rows. A conversation's digests (not its texts)
    are one row.
    """
    turns = turns_of(conversations, tokenizer)
    each = turns.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list(F.struct("turn", "row", "digest", "n"))).alias("turns"))
    digests = F.transform("turns", lambda t: t["digest"])
    each = written(each.withColumns({"path": F.sha2(F.array_join(digests, "").cast("binary"), 256), "turns": F.transform("turns", lambda t: F.struct(*(t[c].alias(c) for c in ("digest", "row", "n"))))}), "conversations")
    one = each.groupBy("path").agg(F.min_by("turns", F.struct("conv_id", "lone")).alias("turns")).withColumn("key", digests)
    ranges = max(1, min(MOST_RANGES, -(-each.count() // range_rows)))
    paths = one.repartitionByRange(ranges, "key").sortWithinPartitions("key").select("path", "turns", F.monotonically_increasing_id().alias("nth"))
    paths = written(paths.withColumn("range", F.shiftright("nth", 33)), "paths")
    placed = nodes_of(paths).join(turns.select("row", "n", "n_head", "n_body", "learnt", "ids"), "row")
    stream = placed.select(
        "tree",
        (F.col("start") - F.col("tree")).alias("start"),
        F.col("n").alias("length"),
        "position",
        "depth",
        "ancestors",
        "ids",
        F.when(F.col("learnt"), F.col("n_head")).alias("loss_start"),
        F.when(F.col("learnt"), F.col("n_head") + F.col("n_body")).alias("loss_stop"),
        "path",
        "range",
        F.col("start").alias("nth"),
        "again",
    )
    return written(stream, "stream"), each.select("conv_id", "path")


def read_back(stream: DataFrame, members: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each
    conversation, from the stream's ids and masks alone, read once in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = byte_table(tokenizer)
        decoded = lambda ids: b"".join(map(raw.__getitem__, array("I", ids))).decode()
        for _, rows in streamed(batches):
            stack, out = [], []
            for r in rows:
                del stack[r["depth"] :]
                turns, loss, chars, learnt = stack[-1] if stack else (hashlib.sha256(), hashlib.sha256(), 0, 0)
                turns, loss, text = turns.copy(), loss.copy(), decoded(r["ids"])
                for x in parsed(text):
                    turns.update(f"{x}\n".encode())
                if r["loss_start"] is not None:
                    part = plain(decoded(r["ids"][4 * r["loss_start"] : 4 * r["loss_stop"]]))
                    loss.update(part.encode())
                    learnt += len(part)
                stack.append((turns, loss, chars + len(text), learnt))
                if r["path"] is not None:
                    out.append((r["path"], len(stack), turns.hexdigest(), learnt, loss.hexdigest(), chars + len(text)))
                if len(out) == 2000:
                    yield result(out)
                    out = []
            yield result(out)

    def result(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * 6, kinds)], ["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    read = in_order(stream.select("range", "nth", "depth", "ids", "loss_start", "loss_stop", "path")).mapInArrow(run, "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return merged(joined_evenly(members, written(read, "read-back"), "path").drop("path"))
