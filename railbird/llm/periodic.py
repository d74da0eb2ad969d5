"""Runs: stretches of words that repeat with some period at least ``TIMES`` times.

A word place i matches at period p if the words i and i + p are equal; a run of period p is a
longest interval of such places.  Periods are taken by octaves [P, 2P), P a power of two.
A document's words are cut into tiles, longer ones and with wider margins for higher octaves,
and each tile is a row that is solved by itself: boundaries lie P apart, and a run that is long
enough covers all P places after some boundary.  So for every boundary and every period of
the octave the codes of P words are compared, which is linear in the tile, and from the
boundaries that match, Z-values (how far the words at the boundary go on like those a
period later, to the left and to the right) give the run's ends inside the tile.  What tiles
found is shuffled by document and period, and fragments that touch are stitched.

Codes stand for P words by 64 bits; they are made by doubling from the words' numbers in the
document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railbird.llm.stage import materialize, typed, unused

TIMES, LEAST = 4, 6  # a run has as many periods, and as many words
CORE = 8192  # places that a tile answers for, at least
SHARED = 10  # octaves from 0 on that read the same tile
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Numbers(dict):
    """Words numbered in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def planted(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """The words, of every tenth document by its id's checksum with a repeated end; without an id as they are."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(doc_id.encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _LEFT
    return h ^ (h >> np.uint64(32))


def numbers_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(Numbers().__getitem__, words), np.int32, len(words))


def may_run(ids: np.ndarray) -> bool:
    """False only where there is no run: in each the first ``LEAST`` - 1 words come again, one period later."""
    k = LEAST - 1
    if len(ids) < LEAST:
        return False
    h = np.zeros(len(ids) - k + 1, np.uint64)
    for at in range(k):
        h = _mixed(h * _RIGHT + ids[at : at + len(h)].astype(np.uint64) + np.uint64(1))
    return len(np.unique(h)) < len(h)


def tiles_of(ids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(least octave, first place of the core, place of the first word, words); each has its octaves' margins on both sides."""
    n, octave = len(ids), 0
    while max(LEAST, TIMES << octave) <= n:
        top = SHARED - 1 if octave == 0 else octave
        reach = 1 << top
        core = max(CORE, 4 * reach)
        for start in range(0, n, core):
            first = max(0, start - reach)
            yield octave, start, first, ids[first : start + core + 3 * reach]
        octave = top + 1


def least_factors(upto: int) -> np.ndarray:
    out = np.arange(upto)
    for f in range(2, int(upto**0.5) + 1):
        if out[f] == f:
            part = out[f * f :: f]
            part[part == np.arange(f * f, upto, f)] = f
    return out


def solve(octave: int, start: int, first: int, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(periods, first places, ends) of a tile's fragments, an octave at a time."""
    top = SHARED - 1 if octave == 0 else octave
    core = max(CORE, 4 << top)
    n, lo = len(ids), start - first  # places below are the tile's own
    codes = [ids.astype(np.uint64) + np.uint64(1)]
    for k in range(top + 1):
        size = 1 << k
        if k >= octave:
            found = _octave(codes, k, lo, min(core, n - lo))
            if found is not None:
                p, s, e = found
                yield p, s + first, e + first
        if len(codes[k]) <= size:
            return
        codes.append(_mixed(codes[k][:-size] * _RIGHT + codes[k][size:]))


def _octave(codes: list[np.ndarray], k: int, lo: int, core: int):
    size, code = 1 << k, codes[k]
    rows = -(-core // size)
    there = code[lo + size : lo + size + rows * size]  # row b: the codes of all periods after boundary b
    here = code[lo : lo + rows * size : size]
    rows = min(len(here), -(-len(there) // size))
    if not rows:
        return None
    later = np.zeros(rows * size, np.uint64)  # no code is 0 in effect; places past the end are told apart below
    later[: min(len(there), rows * size)] = there[: rows * size]
    b, c = np.nonzero(later.reshape(rows, size) == here[:rows, None])
    keep = b * size + c < len(there)
    b, c = b[keep], c[keep]
    if not len(b):
        return None
    order = np.lexsort((b, c))
    b, c = b[order], c[order]
    cut = np.flatnonzero((np.diff(c) != 0) | (np.diff(b) != 1)) + 1
    head, tail = np.append(0, cut), np.append(cut, len(b)) - 1
    p = c[head] + size
    s, e = lo + b[head] * size, lo + b[tail] * size + size
    for j in range(k - 1, -1, -1):  # Z-values, halving: less than a code's length is left on either side
        step, at = 1 << j, codes[j]
        back = s - step
        ok = back >= 0
        ok[ok] = at[back[ok]] == at[back[ok] + p[ok]]
        s = np.where(ok, back, s)
        ok = e + p + step <= len(codes[0])
        ok[ok] = at[e[ok]] == at[e[ok] + p[ok]]
        e = np.where(ok, e + step, e)
    # Closed fragments that are too short go, and those whose words have a period that divides p.
    whole = (s < lo) | (e > lo + core) | ((b[head] == 0) & (lo > 0)) | (e >= lo + core)
    keep = whole | (e - s + p >= np.maximum(LEAST, TIMES * p))
    p, s, e = p[keep], s[keep], e[keep]
    factors, rest, own = least_factors(2 * size + 1), p.copy(), np.ones(len(p), bool)
    while (rest > 1).any():
        f = factors[rest]
        q = np.where(f > 1, p // f, 0)
        test = q > 0
        i, d, z = s[test], q[test], p[test] - size
        own[test] &= ~((code[i] == code[i + d]) & (code[i + z] == code[i + z + d]))
        rest = np.where(f > 1, rest // np.maximum(f, 1), 1)
    return p[own], s[own], e[own]


def opened(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, words, collapsed): ``words`` only of a document that may have runs, ``collapsed`` only of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ns, kept, shas = [], [], []
                for i, t in zip(part.column(2), part.column(3), strict=True):
                    words = planted(i.as_py(), (t.as_py() or "").encode().split())
                    ns.append(len(words))
                    maybe = may_run(numbers_of(words))
                    joined = b" ".join(words)
                    kept.append(joined if maybe else None)
                    shas.append(None if maybe else hashlib.sha256(joined).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ns, pa.int64()), pa.array(kept, pa.binary()), pa.array(shas, pa.string())], ["row", "id", "n", "words", "collapsed"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"row long, {typed(rows, 'id')}, n long, words binary, collapsed string")


def _together(pieces: Iterator[tuple], names: list[str], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Lists of arrays, one for each column, as batches of about ``most`` bytes."""
    held, size = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names)

    for piece in pieces:
        held.append(piece)
        size += sum(c.nbytes for c in piece)
        if size > most:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def tiles(rows: DataFrame) -> DataFrame:
    """A row per tile: (row, octave, start, first, ids)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for row, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for octave, start, first, ids in tiles_of(numbers_of(words.as_py().split())):
                    yield tuple(pa.array([v], t) for v, t in ((row, pa.int64()), (octave, pa.int32()), (start, pa.int64()), (first, pa.int64()), (ids.tobytes(), pa.binary())))

    return rows.where("words IS NOT NULL").select("row", "words").mapInArrow(
        lambda batches: _together(pieces(batches), ["row", "octave", "start", "first", "ids"]), "row long, octave int, start long, first long, ids binary"
    )


def fragments(tiled: DataFrame) -> DataFrame:
    """(row, period, s, e): places s to e - 1 of a document match at a period."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for row, octave, start, first, ids in zip(*b.columns, strict=True):
                for p, s, e in solve(octave.as_py(), start.as_py(), first.as_py(), np.frombuffer(ids.as_py(), np.int32)):
                    yield tuple(pa.array(x.astype(np.int64)) for x in (np.full(len(p), row.as_py()), p, s, e))

    return tiled.mapInArrow(lambda batches: _together(pieces(batches), ["row", "period", "s", "e"]), "row long, period long, s long, e long")


def stitched(found: DataFrame) -> DataFrame:
    """Fragments of one document and period that touch -> (row, start, length, period) of whole runs."""
    by = Window.partitionBy("row", "period").orderBy("s", "e")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("s") <= before, 0).otherwise(1)).over(by)
    one = found.select("*", island.alias("island")).groupBy("row", "period", "island").agg(F.min("s").alias("start"), F.max("e").alias("e"))
    length = F.col("e") - F.col("start") + F.col("period")
    return one.select("row", "start", length.alias("length"), "period").where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those that a run has after its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    return [w for w, g in zip(words, gone, strict=True) if not g]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, runs): a row per document with its words, see ``opened``, and (row, start, length, period) of all runs."""
    rows = materialize(opened(docs, id_col, text_col), "opened")
    spread = tiles(rows).repartition("row", "octave", "start")  # a long document's tiles go to many tasks
    return rows, stitched(fragments(spread))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_runs, the run of greatest length / period (start, length, period,
    exponent_milli; nulls without a run), runs_sha256 and collapsed_sha256.

    Every tenth document, by its id, ends in a repetition that ``planted`` makes; rows without an id don't.
    Null and empty texts have no word and no run.  Rows are kept apart by a number of their own, so
    repeated rows and repeated ids each return a row.  Very long texts are solved in tiles.  Other columns are
    left out, so none can clash.  An empty table gives an empty result.
    """
    rows, runs = find_runs(docs, id_col, text_col)
    per_row = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    shape = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64())])
    columns = ["n_runs", *shape.names, "runs_sha256", "collapsed_sha256"]
    (out_id,) = unused(docs.select(F.lit(0).alias("n_runs")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for words, done, found in zip(b.column(1), b.column(2), b.column(3), strict=True):
                every = [(r["start"], r["length"], r["period"]) for r in found.as_py() or []]
                best = None
                for r in every:
                    if best is None or r[1] * best[2] > best[1] * r[2]:
                        best = r
                told = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in every).encode()).hexdigest()
                sha = done.as_py() or hashlib.sha256(b" ".join(collapse(words.as_py().split(), every))).hexdigest()
                out.append((len(every), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, told, sha))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], [out_id, *columns])

    joined = rows.join(per_row, "row", "left").select(F.col("id").alias(out_id), "words", "collapsed", "runs")
    kept = joined.mapInArrow(run, f"{typed(joined, out_id)}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    return kept.withColumnRenamed(out_id, id_col)
