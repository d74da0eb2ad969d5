"""Jaccard join of shingle sets: rare-first prefixes, then length, positional and suffix filters.

Sets of similarity t have at least t of the larger one in common, so with any order of shingles the
first n - ceil(t n) + 1 of each hold one in common.  The order puts rare ones first.  How frequent a
shingle is, is counted over all documents in ``SLOTS`` slots by hash, which keeps what goes to the tasks
at a megabyte for any corpus; a slot's count only orders, it decides nothing.

Sets meet at a shingle of both prefixes.  At the first one in common, what comes after it must
reach the needed overlap (positional filter); elsewhere this may fail, so a pair stays if it holds
at one shingle.  The bound of the suffix filter is the difference of two sets' counts in 64
ranges of hashes, which no two sets with the needed overlap exceed.  Pairs are made distinct and
verified once, by exact intersection.

A group of thousands of near copies isn't compared pair by pair: at each shingle all sets are first
compared with one, that with the most frequent shingles (of copies with edits, the text without them);
what links is one component, and only sets of different components are compared after that, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.llm.components import connected_components
from railbird.llm.similar import text_key
from railbird.llm.stage import materialize, typed, unused

SHINGLE, PERCENT = 3, 90
SLOT_BITS, CHUNK = 20, 1024
RANGES = 64
BLOCK = 512  # sets of a shingle that are compared with one another in one piece
FEW = 500_000  # keys of 16 bytes that are sent to all tasks
CHUNK_BYTES = 1 << 18
_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LETTER = np.random.default_rng(13).integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_PLACES = np.random.default_rng(11).integers(0, 1 << 63, 64, np.int64).astype(np.uint64) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@cache
def _chunk_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(CHUNK_BYTES + 4096)


def _word_hashes(data: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of the words in some bytes: differences of one running sum, moved to where a word would start at 0."""
    gap = np.concatenate([[True], _SPACE[data], [True]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(data) > len(powers[0]):
        powers = _powers(len(data))  # a word longer than a chunk
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * powers[0][: len(data)], dtype=np.uint64)])
    h = (total[ends] - total[starts]) * powers[1][starts]
    return h ^ (h >> np.uint64(32)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, one after the other, and the place of each text's first one (and of the end).  Letters A-Z count as small ones."""
    whole = b" ".join(texts)
    data, powers = np.frombuffer(whole, np.uint8), _chunk_powers()
    hashes, firsts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        while end < len(data) and not _SPACE[data[end]]:  # a chunk ends with a word
            more = np.flatnonzero(_SPACE[data[end : end + 4096]])
            end = end + int(more[0]) if len(more) else min(len(data), end + 4096)
        h, starts = _word_hashes(data[at:end], powers)
        hashes.append(h)
        firsts.append(starts + at)
        at = end
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(edges), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(firsts), edges)


def shingles_of(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The set of each text's shingles, as sorted hashes; a shorter text is one shingle, an empty one has none."""
    h, cuts = word_hashes(texts)

    def windows(h: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for k in range(size):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)] * _PLACES[k]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))

    every, sets = windows(h, size), []
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        s = np.sort(every[a : z - size + 1] if z - a >= size else windows(h[a:z], z - a) if z > a else h[:0])
        sets.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
    return sets


def pieces(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts): a column's texts in pieces of about ``most_bytes``; null is empty."""
    at, held, size = 0, [], 0
    for i, t in enumerate(column):
        held.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
        size += len(held[-1])
        if size >= most_bytes:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def prefix_length(n, percent: int = PERCENT):
    return n + -n * percent // 100 + 1


def slot_levels(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """(chunk, levels): how often shingles of each slot occur in all texts, as eight steps for each doubling."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            for _, texts in pieces(b.column(0), 4 << 20):
                slots = np.concatenate(shingles_of(texts, size)) >> np.uint64(64 - SLOT_BITS)
                total += np.bincount(slots.astype(np.int64), minlength=len(total))
        if total.any():
            parts = total.astype(np.int32).reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(list(parts), pa.list_(pa.int32()))], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[chunk] = total.get(chunk, 0) + counts.values.to_numpy().astype(np.int64)
        levels = [np.minimum(255, np.rint(8 * np.log2(1 + c))).astype(np.uint8).tobytes() for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["chunk", "levels"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "chunk int, counts array<int>")
    return counted.repartition("chunk").mapInArrow(add, "chunk int, levels binary")


def prefixes(docs: DataFrame, levels: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """A row per document: (id, text_key, key, n, common, ranges, prefix).

    ``key`` stands for the set (null: empty), ``common`` is the mean level of its shingles, ``ranges`` has the counts
    modulo 256 of its hashes by range, ``prefix`` the shingles that a similar set must share one of, rare ones first.
    """
    table = bytearray(1 << SLOT_BITS)
    for chunk, part in levels.collect():  # 1024 rows of a kilobyte
        table[chunk * CHUNK : (chunk + 1) * CHUNK] = part
    sent = docs.sparkSession.sparkContext.broadcast(bytes(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            for at, texts in pieces(b.column(2)):
                keys, ns, common, ranges, firsts = [], [], [], [], []
                for s in shingles_of(texts, size):
                    n = len(s)
                    ns.append(n)
                    if not n:
                        keys.append(None), common.append(0), ranges.append([]), firsts.append([])
                        continue
                    rank = level[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    common.append(int(rank.sum(dtype=np.int64)) * 256 // n)
                    ranges.append((np.bincount((s & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES) & 255).astype(np.int16))
                    firsts.append(s[np.argsort(rank, kind="stable")[: prefix_length(n, percent)]].view(np.int64))
                part = b.slice(at, len(texts))
                arrays = [pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(common, pa.int32()), pa.array(ranges, pa.list_(pa.int16())), pa.array(firsts, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *arrays], ["id", "text_key", "key", "n", "common", "ranges", "prefix"])

    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{typed(rows, 'id')}, text_key binary, key binary, n long, common int, ranges array<short>, prefix array<long>")


def may_link(n_u: Column, n_v: Column, percent: int) -> Column:
    """Length filter."""
    return 100 * F.least(n_u, n_v) >= percent * F.greatest(n_u, n_v)


def needed(n_u, n_v, percent: int):
    """The least intersection of two sets that link: 100 i >= percent (n_u + n_v - i)."""
    return -(-percent * (n_u + n_v) // (100 + percent))


def needed_column(n_u: Column, n_v: Column, percent: int) -> Column:
    """The same as a column."""
    return F.ceil(percent * (n_u + n_v) / F.lit(100 + percent)).cast("long")


def block_pairs(percent: int):
    """Rows (token, lo, hi, id, component, n, pos), sorted by the first three -> pairs (u, v) of a block that pass the filters."""

    def compare(rows: list[np.ndarray]) -> pa.RecordBatch:
        ids, root, n, pos = rows
        us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        rest = n - pos - 1
        for i in range(len(ids) - 1):
            m = n[i + 1 :]
            ok = (root[i + 1 :] != root[i]) & (1 + np.minimum(rest[i], rest[i + 1 :]) >= needed(n[i], m, percent))
            ok &= 100 * np.minimum(m, n[i]) >= percent * np.maximum(m, n[i])
            other = ids[i + 1 :][ok]
            us.append(np.minimum(other, ids[i]))
            vs.append(np.maximum(other, ids[i]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 7
        for b in batches:
            now = [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, b.columns, strict=True)]
            if not len(now[0]):
                continue
            edges = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0) | (np.diff(now[2]) != 0)) + 1
            for a, z in zip(np.append(0, edges), edges, strict=False):
                yield compare([c[a:z] for c in now[3:]])
            held = [c[edges[-1] if len(edges) else 0 :] for c in now]
        if len(held[0]):
            yield compare(held[3:])

    return run


def texts_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(node, text) for ``wanted`` (node, text_key), a written table: texts that stand for a set are read again.

    Up to ``FEW`` keys, whose number is counted first, go to the texts; beyond that texts and keys are shuffled.
    """
    keys = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    texts = docs.select(text_key(text_col).alias("text_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(keys, "text_key").groupBy("node").agg(F.first("text").alias("text"))


def compared(size: int, percent: int):
    """Rows (u, v, text_u, text_v) -> (u, v) of similar sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, np.uint64)
        for b in batches:
            us, vs = [], []
            u_of, v_of = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at, texts in pieces(b.column(3)):
                for i, other in enumerate(shingles_of(texts, size), at):
                    if u_of[i] != last:
                        last, (held,) = u_of[i], shingles_of([b.column(2)[i].as_buffer().to_pybytes()], size)
                    both = len(np.intersect1d(held, other, assume_unique=True))
                    if 100 * both >= percent * (len(held) + len(other) - both):
                        us.append(u_of[i])
                        vs.append(v_of[i])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, text_col: str, size: int, percent: int) -> DataFrame:
    """Of distinct ``pairs`` (u, v) of nodes those whose sets are similar: the suffix filter, then the exact comparison."""
    apart = F.aggregate(F.zip_with("ranges_u", "ranges_v", lambda a, b: F.least(F.abs(a - b), 256 - F.abs(a - b)).cast("long")), F.lit(0).cast("long"), lambda s, d: s + d)
    told = nodes.select("node", "n", "ranges")
    room = F.col("n_u") + F.col("n_v") - 2 * needed_column(F.col("n_u"), F.col("n_v"), percent)
    near = pairs.join(told.toDF("u", "n_u", "ranges_u"), "u").join(told.toDF("v", "n_v", "ranges_v"), "v").where(apart <= room).select("u", "v")
    left = materialize(near, "candidates")
    ends = left.select(F.col("u").alias("node")).union(left.select("v")).distinct()
    wanted = materialize(nodes.select("node", "text_key").join(ends, "node", "left_semi"), "wanted")
    texts = materialize(texts_of(docs, wanted, text_col), "texts")
    both = left.join(texts.toDF("u", "text_u"), "u").join(texts.toDF("v", "text_v"), "v").select("u", "v", "text_u", "text_v")
    return materialize(both.mapInArrow(compared(size, percent), "u long, v long"), "links")


def similar_pairs(docs: DataFrame, nodes: DataFrame, text_col: str, size: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect all similar ``nodes`` (node, text_key, n, common, ranges, prefix), directly or over others."""
    spread = nodes.select("node", F.posexplode("prefix").alias("pos", "token"))
    shared = spread.groupBy("token").count().where("count > 1").select("token")
    members = spread.join(shared, "token", "left_semi").join(nodes.select("node", "n", "common"), "node")
    members = materialize(members, "postings")

    pivot = members.groupBy("token").agg(F.max(F.struct("common", "node", "n", "pos")).alias("pivot"))
    most = F.least(F.col("pivot.n") - F.col("pivot.pos"), F.col("n") - F.col("pos"))  # this shingle and what comes after it
    near = may_link(F.col("pivot.n"), F.col("n"), percent) & (most >= needed_column(F.col("pivot.n"), F.col("n"), percent))
    first = members.join(pivot, "token").where((F.col("pivot.node") != F.col("node")) & near).select(F.col("pivot.node").alias("u"), F.col("node").alias("v")).distinct()
    linked = verified(docs, first, nodes, text_col, size, percent)

    group = F.coalesce("root", "node").alias("component")
    placed = materialize(members.join(connected_components(linked).toDF("node", "root"), "node", "left").select("token", "node", "n", "pos", group), "placed")
    mixed = placed.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("z"), F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("a < z")
    cut = (
        placed.join(mixed.select("token", "blocks"), "token")
        .withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "component", "n", "pos")
    )
    order = ["token", "lo", "hi"]
    found = cut.repartition(*order).sortWithinPartitions(*order).mapInArrow(block_pairs(percent), "u long, v long").distinct()
    return linked.union(verified(docs, found, nodes, text_col, size, percent))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id.

    component_id is the least id that can be reached over links of sets with a Jaccard
    similarity of ``percent`` / 100 or more.  Texts with equal sets are one node, so that copies aren't paired.
    Null and empty texts have no shingles, link with nothing and are their own component; null ids
    get a row and are never a component_id unless a component has no other; rows with one id and
    different texts are different documents; repeated rows each return a row.  Whole texts are read.  Other
    columns are left out, so none can clash.  An empty table gives an empty result.
    """
    rows = materialize(prefixes(docs, slot_levels(docs, text_col, size), id_col, text_col, size, percent), "prefixes")
    one = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least_id"), F.min(F.struct("text_key", "n", "common", "ranges", "prefix")).alias("s"))
    nodes = materialize(one.select(F.monotonically_increasing_id().alias("node"), "key", "least_id", "s.*"), "nodes")
    roots = connected_components(similar_pairs(docs, nodes, text_col, size, percent)).toDF("node", "root")
    placed = nodes.select("node", "key", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = materialize(placed.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")
    by_key = placed.join(least, "root").select("key", "component_id")
    (out,) = unused(docs.select(F.lit(0).alias("n_shingles")), "id")
    told = rows.join(by_key, "key", "left").select(F.col("id").alias(out), F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return told.withColumnRenamed(out, id_col)
