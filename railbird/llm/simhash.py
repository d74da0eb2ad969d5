"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits, cut into segments of 23, 23 and 18 bits.  Of two
fingerprints that differ in at most four bits, some two segments together differ
in at most two: the three pairs of segments count each bit twice, eight in all.
On each segment the perfect binary Golay code of length 23 (the short segment
padded with zeros) gives the anchors; its covering radius is 3.  A pair of
segments at distance two or less has a midpoint one step from either end, whose
anchor is therefore within covering radius plus half the threshold of both.
Every fingerprint is replicated to all anchors of that reach, about 30, and
fingerprints are compared within an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.components import connected_components
from railbird.llm.similar import Words, shingle_hashes, signature, similar_links, text_key
from railbird.llm.stage import materialize, unused

GOLAY = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
LENGTH, RADIUS = 23, 3
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
THRESHOLD = 4
BLOCK = 512  # members of an anchor that are compared with one another in one piece


def simhash64(text: str | None, shingle: int = 4) -> int:
    """The fingerprint as an unsigned number; no words: zero."""
    return simhash_of((text or "").encode().lower().split(), shingle)  # bytes: ASCII letters and white space only


def simhash_of(words: list[bytes], shingle: int = 4) -> int:
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(whole, 42)]
    else:
        at = list(accumulate((len(w) + 1 for w in words), initial=0))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a : b - 1], 42) for a, b in zip(at, at[shingle:], strict=False)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): a row per input row, ``fp`` the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash64(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def row_mark(docs: DataFrame):
    """A hash of a row's columns, but for those that Spark can't hash."""
    return F.xxhash64(*(docs[f.name] for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))))


def marked(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: bool) -> DataFrame:
    """(id, key, mark, fp, bands): a row per input row; with ``bands`` the MinHash bands of its five-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            fps, signed = [], []
            for t in b.column(3):
                words = (t.as_py() or "").encode().lower().split()
                fps.append(simhash_of(words, shingle))
                signed.append(signature(shingle_hashes(words, known)) if bands else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(signed, pa.list_(pa.int64()))], ["id", "key", "mark", "fp", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), row_mark(docs).alias("mark"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, key binary, mark long, fp long, bands array<long>"
    )


def _syndromes(v: np.ndarray) -> np.ndarray:
    """Remainders of the 23-bit words by the generator polynomial."""
    v = v.copy()
    for bit in range(LENGTH - 1, 10, -1):
        v = np.where((v >> bit) & 1, v ^ (GOLAY << (bit - 11)), v)
    return v


def anchor_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the one error word of weight up to 3, and those of weight 4 (filled up with -1)."""
    leader, further = np.zeros(2048, np.int64), [[] for _ in range(2048)]
    for weight in range(RADIUS + 2):
        words = np.array([sum(1 << i for i in c) for c in combinations(range(LENGTH), weight)], np.int64)
        for s, w in zip(_syndromes(words), words, strict=True):
            if weight <= RADIUS:
                leader[s] = w
            else:
                further[s].append(w)
    width = max(map(len, further))
    return leader, np.array([x + [-1] * (width - len(x)) for x in further], np.int64)


def anchors(fp: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All (row, key): the anchors within reach of each fingerprint, in each pair of segments."""
    leader, further = tables
    home, more, there = [], [], []
    for first, bits in SEGMENTS:
        part = ((fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        s = _syndromes(part)
        home.append((part ^ leader[s]) >> 11)
        there.append(further[s] >= 0)
        more.append((part[:, None] ^ further[s]) >> 11)
    rows, keys, every = [], [], np.arange(len(fp))
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        rows.append(every)
        keys.append((k << 24) | (home[i] << 12) | home[j])
        r, c = np.nonzero(there[i])
        rows.append(r)
        keys.append((k << 24) | (more[i][r, c] << 12) | home[j][r])
        r, c = np.nonzero(there[j])
        rows.append(r)
        keys.append((k << 24) | (home[i][r] << 12) | more[j][r, c])
    return np.concatenate(rows), np.concatenate(keys).astype(np.int32)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = anchor_tables()
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 20_000):
            part = fp[at : at + 20_000]
            rows, keys = anchors(part.view(np.uint64), tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["anchor", "fp"])


def local_stars(group: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal ``group``, as (node, least node linked to it here)."""
    us, vs = [], []
    idx, d = np.arange(len(fp)), 1
    while True:
        idx = idx[idx + d < len(fp)]
        idx = idx[group[idx] == group[idx + d]]
        if not len(idx):
            break
        near = idx[np.bitwise_count((fp[idx] ^ fp[idx + d]).view(np.uint64)) <= threshold]
        us.append(fp[near])
        vs.append(fp[near + d])
        d += 1
    if not us:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nodes, ends = np.unique(np.concatenate(us + vs), return_inverse=True)
    a, b = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if np.array_equal(least, label):
            break
        label = least
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 4  # anchor, blocks and fingerprints of the group that may go on in the next batch

        def out(group, fp):
            u, v = local_stars(group, fp, threshold)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            now = [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, b.columns, strict=True)]
            if not len(now[0]):
                continue
            group = np.append(0, np.cumsum((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0) | (np.diff(now[2]) != 0)))
            cut = int(np.argmax(group == group[-1]))
            held = [c[cut:] for c in now]
            if cut:
                yield out(group[:cut], now[3][:cut])
        if len(held[0]):
            yield out(np.zeros(len(held[0]), np.int64), held[3])

    return run


def near_links(fps: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints ``fps`` (fp long) -> links (u, v) that connect all that differ in
    ``threshold`` bits or fewer, directly or over others.  An anchor with many members is
    cut into blocks of about ``block`` and each two blocks are compared apart, so that no
    task gathers it; others are one block.  Only a spanning set of the links found together
    is passed on."""
    if threshold > THRESHOLD:
        raise ValueError(f"the anchors cover {THRESHOLD} differing bits")
    spread = materialize(fps.select("fp").mapInArrow(_replicas, "anchor int, fp long"), "replicas")
    large = spread.groupBy("anchor").count().where(F.col("count") > block)
    cut = (
        spread.join(large, "anchor", "left")
        .withColumn("blocks", F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("anchor", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    dealt = cut.repartition("anchor", "lo", "hi").sortWithinPartitions("anchor", "lo", "hi")
    return dealt.mapInArrow(_links(threshold), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    component_id is the least id whose fingerprint can be reached over links of
    ``threshold`` or fewer differing bits.  Null or empty texts have fingerprint zero and
    link like any other; null ids get a row and are never a component_id unless a
    component has no other.  Repeated rows each return a row.  Equal fingerprints are
    one node, so that copies aren't paired.  Whole texts are read, very long ones too.  Other
    columns are left out, so none can clash.  An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least_id")), "nodes")
    roots = connected_components(near_links(nodes, threshold)).toDF("fp", "root")
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Written, so that a large component's rows meet it in a join that can be split.
    component = materialize(placed.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")
    by_fp = placed.join(component, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, threshold: int = THRESHOLD, similarity: float | None = None
) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates.

    Fingerprints of ``threshold`` or fewer differing bits are linked; with ``similarity`` so are
    texts whose sets of five-word shingles are at least as similar (Jaccard), see
    ``similar``.  A group is what links connect.  The row with the least id stays; of a
    group without ids, and of several texts with that id, the one whose text's digest is
    least; of rows with that id and text, the one with the least hash of all columns.  Null texts
    count as empty and are near-duplicates of each other; rows with one id and different texts
    are different documents.  Names of other columns can't clash; an empty table stays empty.
    """
    rows = materialize(marked(docs, id_col, text_col, shingle, similarity is not None), "fingerprints")
    nodes = materialize(rows.select("fp").distinct(), "nodes")
    roots = materialize(nodes.join(connected_components(near_links(nodes, threshold)).toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    if similarity is not None:
        more = connected_components(similar_links(docs, rows, roots, text_col, similarity)).toDF("root", "top")
        roots = materialize(roots.join(more, "root", "left").select("fp", F.coalesce("top", "root").alias("root")), "roots")
    # A null id comes after all others.
    alike = rows.groupBy("fp", "id", "key", "mark").agg(F.count("*").alias("n")).withColumn("bare", F.col("id").isNull())
    best = alike.join(roots, "fp").groupBy("root").agg(F.min(F.struct("bare", "id", "key", "mark", "n")).alias("best"))
    i, k, m, again = unused(docs, "best_id", "best_key", "best_mark", "again")
    kept = materialize(best.select(F.col("best.id").alias(i), F.col("best.key").alias(k), F.col("best.mark").alias(m), (F.col("best.n") > 1).alias(again)), "kept")
    same = docs[id_col].eqNullSafe(kept[i]) & (text_key(text_col) == kept[k]) & (row_mark(docs) == kept[m])
    if kept.where(kept[again]).isEmpty():
        return docs.join(kept, same, "left_semi")
    once = docs.join(kept.where(~kept[again]), same, "left_semi")
    again = docs.join(kept.where(kept[again]), same, "left_semi")
    return once.union(again.dropDuplicates([id_col, text_col]))  # only rows that are the same in all columns
