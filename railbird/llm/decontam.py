"""Benchmark decontamination by a prefix-filtered containment join.

An item's windows are its runs of ten consecutive words, each a set of three-word shingles.
A document has a window only if it has all its shingles, so with shingles in order of
rarity the prefix that both sides must share is one shingle: the window's rarest in the
documents.  Shingles are counted and joined in Spark.  Where a document has a prefix
shingle, the window's place there must lie inside the document (positional and length
bounds), and the words are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.llm.stage import bound_batches, materialize, typed, unused

WINDOW, SHINGLE = 10, 3
FILTER_BITS = 1 << 25  # of a filter of shingles: four megabytes at most, whatever the benchmark's size
CACHE_WORDS = 400_000
#: Digits, ASCII letters (lower-cased) and all bytes from 0x80 on are parts of words.
_FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class _Hashes(dict):
    """Hashes of words, with a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each place on."""
    n = len(hashes) - size + 1
    out = np.full(max(n, 0), size, np.uint64)
    for k in range(size if n > 0 else 0):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _hashed(text: list[bytes], known: _Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, text), np.uint64, len(text))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item, window, size, tokens): a row per run of ``size`` words, of a shorter item the whole; tokens are its shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            for item, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = words(t.as_py())
                n = min(size, len(text))
                width = min(SHINGLE, n)
                every = shingles(_hashed(text, known), width).view(np.int64) if n else []
                last = len(text) - n + 1 if n else 0
                for at in range(0, last, 2000):
                    starts = range(at, min(at + 2000, last))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([item] * len(starts), pa.string()),
                            pa.array([b" ".join(text[i : i + n]).decode() for i in starts], pa.string()),
                            pa.array([n] * len(starts), pa.int32()),
                            pa.array([every[i : i + n - width + 1] for i in starts], pa.list_(pa.int64())),
                        ],
                        ["item", "window", "size", "tokens"],
                    )

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, window string, size int, tokens array<long>")


def _filter(tokens: DataFrame):
    """A broadcast filter that holds the column ``token`` (long): as many bits as FILTER_BITS at most, folded in Spark."""
    n = tokens.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    slot = F.pmod("token", F.lit(bits))
    held = tokens.groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(pmod(token, 64))))").alias("bits")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[held["at"].to_numpy()] = held["bits"].to_numpy()
    return tokens.sparkSession.sparkContext.broadcast(table)


def _holds(table: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Places of the tokens that the filter holds."""
    slot = tokens & np.uint64((len(table) << 6) - 1)
    return np.flatnonzero((table[slot >> np.uint64(6)].view(np.uint64) >> (slot & np.uint64(63))) & np.uint64(1))


def _portions(texts: pa.Array, known: _Hashes, most_words: int = 50_000) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most_words`` together: their words, where each text starts, and all words' hashes."""
    held, n = [], 0
    for t in texts:
        held.append(words(t.as_py()))
        n += len(held[-1])
        if n >= most_words:
            yield held, *_joined(held, known)
            held, n = [], 0
    if held:
        yield held, *_joined(held, known)


def _joined(held: list[list[bytes]], known: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(h) for h in held])
    starts = np.append(0, np.cumsum(lengths))
    return starts, np.fromiter((h for text in held for h in map(known.__getitem__, text)), np.uint64, starts[-1])


def _found(starts: np.ndarray, hashes: np.ndarray, width: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, token) of the shingles that the filter holds and that lie in one text."""
    s = shingles(hashes, width)
    at = _holds(table, s)
    text = np.searchsorted(starts, at, side="right") - 1
    inside = at + width <= starts[text + 1]
    return text[inside], (at - starts[text])[inside], s[at[inside]].view(np.int64)


def _frequencies(docs: DataFrame, tokens: DataFrame, widths: list[int]) -> DataFrame:
    """(token, n): how often documents have at least the shingles in ``tokens``."""
    sent = _filter(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = _Hashes(), sent.value
        for b in batches:
            found = [np.empty(0, np.int64)]
            for _, starts, hashes in _portions(b.column(0), known):
                found += [_found(starts, hashes, w, table)[2] for w in widths]
            token, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n, pa.int64())], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


PLACES = "array<struct<token:long,at:int,before:int,near:array<string>>>"
_PLACES_ARROW = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("near", pa.list_(pa.string()))]))


def _candidates(docs: DataFrame, prefixes: DataFrame, widths: list[int], size: int) -> DataFrame:
    """(id, text_sha, n_words, places): where a text has a shingle of ``prefixes`` (token), with the words around it."""
    sent = _filter(prefixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = _Hashes(), sent.value
        for b in batches:
            n_words, places = [], []
            for held, starts, hashes in _portions(b.column(2), known):
                mine: list[list[dict]] = [[] for _ in held]
                for w in widths:
                    for i, at, token in zip(*(x.tolist() for x in _found(starts, hashes, w, table)), strict=True):
                        first = max(0, at - size + 1)
                        mine[i].append({"token": token, "at": at, "before": at - first, "near": [x.decode() for x in held[i][first : at + size]]})
                n_words += map(len, held)
                places += mine
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(places, _PLACES_ARROW)], ["id", "text_sha", "n_words", "places"])

    marked = docs.select("id", F.unhex(F.sha2("text", 256)).alias("text_sha"), "text")
    return marked.mapInArrow(run, f"{typed(docs, 'id')}, text_sha binary, n_words long, places {PLACES}")


def _covered(spans: Column) -> Column:
    """How many words lie in spans (start, size), sorted by start."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(s: Column, x: Column) -> Column:
        end = x["start"] + x["size"]
        return F.struct((s["n"] + F.greatest(F.lit(0), end - F.greatest(x["start"], s["end"]))).alias("n"), F.greatest(s["end"], end).alias("end"))

    return F.aggregate(spans, start, add, lambda s: s["n"])


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
) -> DataFrame:
    """Per row of ``docs``: id, text_sha (of the text, null counts as empty), n_words, n_hit, n_items, items.

    ``items`` are the sorted ids, as strings, of the items of which a window occurs (a null
    item id counts as an empty string).  Null and empty texts have no words and hit nothing;
    whole texts are read, very long ones too.  Repeated rows each return a row.  Other columns
    are left out, so none can clash.  An empty benchmark hits nothing, an empty table of
    documents gives an empty result.
    """
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    said = materialize(item_windows(benchmark, item_col, item_text_col, size), "windows")
    windows = materialize(said.select("window", "size", "tokens").distinct(), "different-windows")
    tokens = windows.select("window", "size", F.posexplode("tokens").alias("place", "token"))
    widths = sorted(r.w for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("w")).distinct().collect())  # three at most
    seen = _frequencies(plain, tokens.select("token").distinct(), widths)
    # A window with a shingle that no document has is in none: the inner side is its rarest one, with a count.
    rarest = tokens.join(seen, "token", "left").groupBy("window", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place")).alias("r"))
    prefixes = materialize(rarest.where("r.n > 0").select("window", "size", "r.token", "r.place"), "prefixes")
    rows = materialize(_candidates(plain, prefixes.select("token").distinct(), widths, size), "candidates")
    places = rows.where(F.size("places") > 0).select("id", "text_sha", F.explode("places").alias("p")).select("id", "text_sha", "p.*")
    fits = (F.col("before") >= F.col("place")) & (F.size("near") - F.col("before") + F.col("place") >= F.col("size"))
    hits = materialize(
        places.join(prefixes, "token")
        .where(fits & (F.array_join(F.slice("near", F.col("before") - F.col("place") + 1, F.col("size")), " ") == F.col("window")))
        .select("id", "text_sha", "window", (F.col("at") - F.col("place")).alias("start"), "size")
        .distinct(),
        "hits",
    )
    spans = hits.groupBy("id", "text_sha").agg(_covered(F.array_sort(F.collect_set(F.struct("start", "size")))).alias("n_hit"))
    items = (
        hits.select("id", "text_sha", "window").distinct().join(said.select("window", "item").distinct(), "window").groupBy("id", "text_sha").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    # Written: the texts that hit, once each, so that rows with equal ids and texts meet a table in a join that can be split.
    found = materialize(spans.join(items, spans.id.eqNullSafe(items.id) & (spans.text_sha == items.text_sha)).select(spans.id.alias("hit_id"), spans.text_sha.alias("hit_sha"), "n_hit", "items"), "found")
    mine = rows.select("id", "text_sha", "n_words").join(found, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_sha") == F.col("hit_sha")), "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return mine.select(F.col("id").alias(id_col), "text_sha", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; cases as in ``contamination``."""
    return contamination(docs, benchmark, **options).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that have a hit; rows are matched by id (null ids too) and text.

    Null and empty texts stay; repeated rows stay or go together; names of other columns can't
    clash; an empty table stays empty, an empty benchmark drops nothing.
    """
    i, s = unused(docs, "hit_id", "hit_sha")
    bad = contamination(docs, benchmark, id_col, text_col, **options).where("n_hit > 0").select(F.col(id_col).alias(i), F.col("text_sha").alias(s)).distinct()
    sha = F.unhex(F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256))
    return docs.join(bad, docs[id_col].eqNullSafe(bad[i]) & (sha == bad[s]), "left_anti")
