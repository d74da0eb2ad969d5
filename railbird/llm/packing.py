"""Packing of token sequences by a linear grouping scheme.

Piece lengths have at most ``capacity`` distinct values, so a histogram of them, however
many documents there are, is small: the plan is made from it on the driver, and says of
each length which ranks go into which run of equal sequences.  Large lengths, in falling
order, are cut into groups of equal cardinality and rounded up to their group's largest.
For these few sizes a linear programme over configurations is solved by column
generation.  Actual pieces then take the places of the rounded ones, and small pieces go,
best fit, where room is left.  Ranks and places are worked out on the executors.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railbird.llm.stage import materialize

CAPACITY, END = 2048, 0
SMALL = 4  # a length is small below capacity / SMALL
GROUPS = 160
CACHE_CHUNKS = 400_000
_SPACES = re.compile(r"\s (?:\s|\Z)")  # white space that a pre-token may join across a space
Runs = list[tuple[int, tuple[int, ...]]]  # how many sequences, and the lengths in each


class _Chunks(dict):
    """Bytes of token ids by a space and what follows it up to the next."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encoding.encode_ordinary(chunk)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= 64:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = out
        return out


def contents(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Byte-level BPE of a ``tokenizers`` file whose pre-tokens never reach over the space before a visible character.

    The ids are those of ``tokenizers``; the ranks for ``tiktoken``, which is faster, are the
    file's own merges.  A text is encoded in chunks, each a space and what follows, since no
    pre-token crosses their borders; one that has more white space on both sides of a space, as
    a whole.  The file's added tokens inside a text are one id each, as ``tokenizers`` has it;
    without ``special`` they are ordinary text (its ``encode_special_tokens``).
    """

    def __init__(self, source: str | bytes, special: bool = True):
        """``source``: the file's place, or what is in it."""
        import json

        import tiktoken

        file = json.loads(source if isinstance(source, bytes) else contents(source))
        model = file["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token) and not token.startswith("<|")}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.chunks = _Chunks(self.encoding)
        added = file["added_tokens"] if special else []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in what is beside them are not known")
        self.added = {t["content"]: struct.pack("<I", t["id"]) for t in added}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if self.between and len(parts := self.between.split(text)) > 1:
            return b"".join(self.added[x] if k % 2 else self._ordinary(x) for k, x in enumerate(parts))
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if _SPACES.search(text):
            ids = self.encoding.encode_ordinary(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        first, *more = text.split(" ")
        get = self.chunks.__getitem__
        return b"".join([get(first), *map(get, [" " + x for x in more])]) if text else b""


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which has the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, special: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, deal): each text's ids and the end id, cut to ``capacity``.

    A null text counts as empty and has the end id alone.  ``deal`` numbers the rows, so that
    equal ones can be told apart once the table is written.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    sent = docs.sparkSession.sparkContext.broadcast(contents(tokenizer_path))  # the file is on the driver's machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, deal = Encoder(sent.value, special), struct.pack("<I", END), TaskContext.get().partitionId() << 36
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1)):
                ids = encode(t.as_py() or "") + end
                for k, (a, n) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(i)
                    rows.append((k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], k) for k in (pa.int32(), pa.int64(), pa.int64(), pa.int64())]
            numbers = pa.array(range(deal, deal + len(rows)), pa.int64())
            deal += len(rows)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns, numbers], ["id", "piece", "start", "length", "ids_crc32", "deal"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long, deal long"
    )


def _best_configuration(value: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is taken, for the most value within ``capacity`` (unbounded knapsack)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for k in np.argsort(-value / sizes, kind="stable"):
        s, v = int(sizes[k]), value[k]
        if v <= 0:
            continue
        for _ in range(capacity // s):
            moved = best[:-s] + v
            better = moved > best[s:] + 1e-12
            if not better.any():
                break
            best[s:][better] = moved[better]
            choice[s:][better] = k
    counts, at = np.zeros(len(sizes)), capacity
    at = int(np.argmax(best))
    while at > 0 and choice[at] >= 0:
        counts[choice[at]] += 1
        at -= int(sizes[choice[at]])
    return counts


def solve_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[float, np.ndarray]]:
    """A basic solution of the configuration programme: (how often, count of each size)."""
    k = len(sizes)
    basis = np.diag(np.floor(capacity / sizes))
    inverse, x = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    for _ in range(30 * k):
        prices = inverse.sum(axis=0)
        column = _best_configuration(prices, sizes, capacity)
        if prices @ column <= 1 + 1e-7:
            break
        change = inverse @ column
        rows = np.flatnonzero(change > 1e-9)
        out = rows[np.argmin(x[rows] / change[rows])]
        step = x[out] / change[out]
        x -= step * change
        x[out] = step
        inverse[out] /= change[out]
        others = np.arange(k) != out
        inverse[others] -= np.outer(change[others], inverse[out])
        basis[:, out] = column
    return [(max(0.0, n), basis[:, i]) for i, n in enumerate(x)]


def best_fit(counts: dict[int, int], runs: Runs, capacity: int) -> Runs:
    """Puts lengths, longest first, where least room is left; equal sequences stay together."""
    rooms: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for m, lengths in runs:
        if m:
            rooms[capacity - sum(lengths)].append((m, lengths))
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left > 0:
            room = min((r for r, v in rooms.items() if r >= size and v), default=None)
            if room is None:
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    rooms[capacity - each * size].append((full, (size,) * each))
                if rest:
                    rooms[capacity - rest * size].append((1, (size,) * rest))
                left = 0
                continue
            m, lengths = rooms[room].pop()
            each = room // size
            full = min(m, left // each)
            if full:
                rooms[room - each * size].append((full, lengths + (size,) * each))
                left -= full * each
            if m > full and left and left < each:
                rooms[room - left * size].append((1, lengths + (size,) * left))
                full, left = full + 1, 0
            if m > full:
                rooms[room].append((m - full, lengths))
    return [x for v in rooms.values() for x in v]


def _grouped(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) in falling order -> runs of (length, count) of nearly equal cardinality."""
    total, out, at, k = sum(n for _, n in large), [[]], 0, 1
    for size, n in large:
        while n:
            room = -(-total * k // groups) - at
            take = min(n, room)
            if take:
                out[-1].append((size, take))
            at, n = at + take, n - take
            if n:
                out.append([])
                k += 1
    return [g for g in out if g]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Runs:
    """Runs of sequences that use each length as often as ``histogram`` has it."""
    done: Runs = [(histogram[capacity], (capacity,))] if histogram.get(capacity) else []
    small = {n: c for n, c in histogram.items() if n * SMALL < capacity and c}
    large = sorted(((n, c) for n, c in histogram.items() if n * SMALL >= capacity and n < capacity and c), reverse=True)
    members = _grouped(large, min(groups, sum(c for _, c in large))) if large else []
    used: Runs = []
    if members:
        # Groups with one largest length are one size.
        merged: dict[int, list[tuple[int, int]]] = {}
        for g in members:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = np.array(list(merged))
        queues = [deque(v) for v in merged.values()]
        for often, column in solve_configurations(sizes, np.array([sum(c for _, c in q) for q in queues], float), capacity):
            slots = [k for k, n in enumerate(column.astype(int)) for _ in range(n)]
            m = int(often + 1e-9)
            for k in set(slots):
                m = min(m, sum(c for _, c in queues[k]) // slots.count(k))
            if not m:
                continue
            parts = []
            for k in slots:
                need, got = m, []
                while need:
                    size, c = queues[k].popleft()
                    got.append([size, min(c, need)])
                    if c > need:
                        queues[k].appendleft((size, c - need))
                    need -= min(c, need)
                parts.append(deque(got))
            while m:
                step = min(p[0][1] for p in parts)
                used.append((step, tuple(p[0][0] for p in parts)))
                m -= step
                for p in parts:
                    p[0][1] -= step
                    if not p[0][1]:
                        p.popleft()
        rest: dict[int, int] = defaultdict(int)
        for q in queues:
            for size, c in q:
                rest[size] += c
        used = best_fit(rest, used, capacity)
    return done + best_fit(small, used, capacity)


def _slots(runs: Runs) -> dict[str, np.ndarray]:
    """For each length the ranks from which a slot of a run is filled: key, sequence and offset there."""
    rank, rows, sequence = defaultdict(int), [], 0
    for m, lengths in runs:
        offset = 0
        for n in lengths:
            rows.append((n << 44 | rank[n], sequence, offset))
            rank[n] += m
            offset += n
        sequence += m
    key, first, offset = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.empty(0, np.int64),) * 3
    return {"key": key, "first": first, "offset": offset}


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, special: bool = True) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences are filled from 0 without gaps.  Null and empty texts have a piece of one id;
    very long ones are cut, nothing else is; repeated rows and null ids are pieces of their own;
    other columns are left out, so none can clash; an empty table gives an empty result.
    Only the histogram of lengths, ``capacity`` rows at most, comes to the driver.
    """
    spark = docs.sparkSession
    cut_up = materialize(pieces(docs, tokenizer_path, id_col, text_col, capacity, special), "pieces")
    histogram = {r.length: r["count"] for r in cut_up.groupBy("length").count().collect()}
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, capacity)))
    buckets = max(256, sum(histogram.values()) // 50_000)
    dealt = cut_up.withColumn("bucket", F.pmod(F.xxhash64("deal"), F.lit(buckets)))
    before = dealt.groupBy("length", "bucket").count().select(
        "length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before")
    )
    # The order decides which of several pieces takes which place, never how many sequences there are.
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("deal")) - 1
    ranked = dealt.withColumn("own", own).join(before, ["length", "bucket"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).alias("rank"))
    kind, names = docs.schema[id_col].dataType.simpleString(), [*ranked.columns[:5], "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        for b in batches:
            if not b.num_rows:
                continue
            key = (b.column(3).to_numpy() << 44) | b.column(5).to_numpy()
            at = np.searchsorted(s["key"], key, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(s["first"][at] + key - s["key"][at]), pa.array(s["offset"][at])], names)

    return ranked.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
