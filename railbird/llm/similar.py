"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints of such texts differ in up to a fifth of their bits, too many for anchors.
Candidates are texts with an equal MinHash band: of ``BANDS`` bands of ``ROWS`` minima, two
texts of similarity s share one with probability 1 - (1 - s^ROWS)^BANDS, which is 0.99997 for
0.8.  Candidates are verified by the exact similarity.  First each bucket's texts are
compared with one of them; only if that leaves some unlinked are all compared, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.stage import materialize

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
BLOCK, BLOCK_HASHES = 256, 500_000  # texts, and shingles of all of them, that a block has at most (one text may be longer)
CACHE_WORDS = 400_000
_ODD = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS), np.int64).astype(np.uint64) | np.uint64(1)
_PLACES = np.random.default_rng(7).integers(0, 1 << 63, SHINGLE, np.int64).astype(np.uint64) | np.uint64(1)


class Words(dict):
    """Hashes of words, with a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def text_key(text_col: str):
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: list[bytes], known: Words) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes; a shorter text is one shingle, an empty one has none."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = _mixed(out + h[k : k + n] * _PLACES[k])
    return np.unique(out)


def signature(shingles: np.ndarray) -> list[int]:
    """A key per band; none for a text without words."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):  # a bounded piece of a long text at a time
        part = shingles[at : at + 4096, None] * _ODD[0] + _ODD[1]
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mixed(key + least[r::ROWS])
    return key.view(np.int64).tolist()


def shingle_sets(docs: DataFrame, keys: DataFrame, text_col: str) -> DataFrame:
    """(key, n, shingles) of the texts in ``keys`` (key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingle_hashes((t.as_py() or "").encode().lower().split(), known).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "n", "shingles"])

    texts = docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    once = texts.join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return once.mapInArrow(run, "key binary, n long, shingles array<long>")


def block_links(similarity: float):
    """Rows (band, bucket, lo, hi, root, n, shingles), sorted by the first four -> links (u, v) of roots inside each block."""

    def compare(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        top = {r[0]: r[0] for r in rows}

        def find(x):
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        rows.sort(key=lambda r: r[1])
        for i, (root, n, own) in enumerate(rows):
            for other, m, shingles in rows[i + 1 :]:
                if n < similarity * m:
                    break
                a, b = find(root), find(other)
                if a != b:
                    both = len(np.intersect1d(own, shingles, assume_unique=True))
                    if both >= similarity * (n + m - both):
                        top[a] = b
                        yield root, other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []

        def out():
            pairs = list(compare(rows))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

        for b in batches:
            for *group, root, n, shingles in zip(*b.columns, strict=True):
                group = tuple(g.as_py() for g in group)
                if group != last and rows:
                    yield out()
                    rows = []
                last = group
                rows.append((root.as_py(), n.as_py(), shingles.values.to_numpy()))
        if rows:
            yield out()

    return run


def similar_links(docs: DataFrame, rows: DataFrame, roots: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between different roots that connect all texts of ``docs`` with ``similarity`` or more.

    ``rows`` has (key, fp, bands) of the texts, ``roots`` (fp, root) groups that are linked
    already; nothing is compared inside these.  Written tables meet in the joins, so that
    Spark can split a hot bucket.
    """
    texts = rows.select("key", "fp", "bands").distinct().join(roots, "fp").select("key", "root", "bands")
    spread = materialize(texts.select("key", "root", F.posexplode("bands").alias("band", "bucket")), "bands")
    mixed = spread.groupBy("band", "bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "bucket")
    members = materialize(spread.join(mixed, ["band", "bucket"], "left_semi"), "members")
    first = members.groupBy("band", "bucket").agg(F.min(F.struct("root", "key")).alias("first"))
    pairs = materialize(
        members.join(first, ["band", "bucket"]).where("first.root < root").select("band", "bucket", F.col("first.key").alias("key_u"), F.col("first.root").alias("u"), "key", F.col("root").alias("v")),
        "pairs",
    )
    sets = materialize(shingle_sets(docs, members.select("key").distinct(), text_col), "shingles")
    both = F.size(F.array_intersect("shingles_u", "shingles"))
    checked = materialize(
        pairs.select("key_u", "u", "key", "v")
        .distinct()
        .join(sets.select(F.col("key").alias("key_u"), F.col("n").alias("n_u"), F.col("shingles").alias("shingles_u")), "key_u")
        .join(sets, "key")
        .select("key_u", "u", "key", "v", (both >= similarity * (F.col("n") + F.col("n_u") - both)).alias("alike")),
        "checked",
    )
    apart = pairs.join(checked.where(~F.col("alike")), ["key_u", "key"], "left_semi").select("band", "bucket").distinct()
    left = members.join(apart, ["band", "bucket"], "left_semi").join(sets, "key")
    sizes = left.groupBy("band", "bucket").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_HASHES)).cast("int").alias("blocks"))
    cut = (
        left.join(sizes, ["band", "bucket"])
        .withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "root", "n", "shingles")
    )
    order = ["band", "bucket", "lo", "hi"]
    inside = cut.repartition(*order).sortWithinPartitions(*order).mapInArrow(block_links(similarity), "u long, v long")
    return checked.where("alike").select("u", "v").union(inside).distinct()
