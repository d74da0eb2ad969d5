"""Document quality by hierarchical empirical Bayes.

A logistic model on hashed words and shapes gives each document's evidence.  Documents of
a host, and of a path within it, share a site's share of good documents; site posteriors
are Beta: a path shrinks toward its host and a host toward the global prior, the more so
the fewer documents it has.  The strength of each prior follows from the spread between
sites (method of moments).  A document's odds are the evidence's likelihood ratio times the
prior odds of its site, from which its own vote is taken out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.stage import materialize, unused

HASHED = 1 << 18
BINS = 8
SHAPES = 128  # slots before those of words: BINS for each shape
LEAST_DOCS, LEAST_CHI2 = 5, 15.0  # a word counts if it has this many documents and this much association with a head
SAMPLE_ROWS = 12_000  # labelled rows that the model is fitted on, at most
HEADS = ("quality", "toxic")
CACHE_WORDS = 400_000
EPOCHS, RATE, L2 = 300, 1.0, 1e-5
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        slot = self[word] = SHAPES + zlib.crc32(word.encode()) % (HASHED - SHAPES)
        return slot


def _shapes(text: str, tokens: list[str]) -> list[float]:
    """Bounded shares: how repetitive, loud, short or cut up a text is."""
    words, n = text.split(), max(1, len(text))
    k = max(1, len(words))
    alpha = sum(map(str.isalpha, tokens))
    lines = text.split("\n")
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / k
    return [
        len(set(words)) / k,
        repeats,
        sum(w.isupper() for w in words) / k,
        1 - alpha / max(1, len(tokens)),
        len(set(lines)) / max(1, len(lines)),
        min(1.0, len(words) / 20),
        min(1.0, len(words) / 200),
        text.count("|") / k if text.count("|") < k else 1.0,
        text.count("!") / n * 4 if text.count("!") * 4 < n else 1.0,
        sum(c in text for c in "#$%&*") / 5,
        min(1.0, len(text) / k / 12),
    ]


def features(text: str, slots: dict[str, int]) -> np.ndarray:
    """Slots that a text fills: one bin of each shape, and each different word or run of marks."""
    tokens = _TOKEN.findall(text.lower())
    shapes = [BINS * i + min(BINS - 1, int(x * BINS)) for i, x in enumerate(_shapes(text, tokens))]
    return np.array([*shapes, *sorted({slots[t] for t in set(tokens)})], np.int32)


def associated(docs: np.ndarray, yes: np.ndarray, share: float) -> np.ndarray:
    """Which slots, found in ``docs`` rows of which ``yes`` are positive, tell positives (``share`` of all) from others."""
    chi2 = (yes - docs * share) ** 2 / np.maximum(docs * share * (1 - share), 1e-9)
    return (docs >= LEAST_DOCS) & (chi2 >= LEAST_CHI2)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights (HASHED) of a logistic model on shapes and associated words, by Adagrad over the whole sample."""
    weights = np.zeros(HASHED)
    if not len(rows) or labels.min() == labels.max():
        return weights
    at = np.repeat(np.arange(len(rows)), list(map(len, rows)))
    slot = np.concatenate(rows)
    share = labels.mean()
    docs = np.bincount(slot, minlength=HASHED)
    yes = np.bincount(slot, labels[at], HASHED)
    kept = associated(docs, yes, share)
    kept[:SHAPES] = True
    at, slot = at[kept[slot]], slot[kept[slot]]
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))  # both classes weigh alike: the prior comes from the sites
    total = np.full(HASHED, 1e-8)
    for _ in range(EPOCHS):
        score = np.bincount(at, weights[slot], len(rows))
        error = weight * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels)
        slope = np.bincount(slot, error[at], HASHED) / len(rows) + L2 * weights
        total += slope * slope
        weights -= RATE * slope / np.sqrt(total)
    return weights


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, rate of positives) by head, from at most ``sample_rows`` labels, chosen by a hash of their ids, with one text each (of several under one id that of the least digest).

    Words are weighed by counts made in Spark; only those that tell something come to the driver, by row.
    """
    chosen = labels.select(F.col(id_col).alias("id"), *(F.col(h).cast("int").alias(h) for h in HEADS)).dropna().orderBy(F.xxhash64("id"), "id", *HEADS).limit(sample_rows)
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    # One text for each label, however many rows have its id: at most sample_rows.
    sample = told.groupBy("id", *HEADS).agg(F.min_by("text", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text")).select("id", "text", *HEADS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for b in batches:
            made = [features(t.as_py() or "", slots) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(made, pa.list_(pa.int32()))], ["id", *HEADS, "slots"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = materialize(sample.mapInArrow(run, f"id {kind}, quality int, toxic int, slots array<int>"), "sample")
    counts = made.select(F.explode("slots").alias("slot"), *HEADS).groupBy("slot").agg(F.count("*").alias("docs"), *(F.sum(h).alias(h) for h in HEADS))
    held = counts.toArrow()  # HASHED rows at most
    n, positive = made.count(), made.agg(*(F.sum(h) for h in HEADS)).first()
    if not n:
        return np.zeros((len(HEADS), HASHED)), np.full(len(HEADS), 0.5)
    slot, docs_n = held["slot"].to_numpy(), held["docs"].to_numpy()
    kept = np.zeros(HASHED, bool)
    for h, k in zip(HEADS, positive, strict=True):
        kept[slot[associated(docs_n, held[h].to_numpy(), k / n)]] = True
    kept[:SHAPES] = True
    sent = docs.sparkSession.sparkContext.broadcast(kept)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = [np.asarray(s.values, np.int32) for s in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([s[sent.value[s]].tobytes() for s in slots], pa.binary())], ["id", *HEADS, "slots"])

    rows = made.mapInArrow(thin, f"id {kind}, quality int, toxic int, slots binary").toArrow()
    rows = rows.sort_by([("id", "ascending"), *((h, "ascending") for h in HEADS), ("slots", "ascending")])
    kept_slots = [np.frombuffer(s.as_py(), np.int32) for s in rows["slots"]]
    each = [rows[h].to_numpy() for h in HEADS]
    return np.array([fit(kept_slots, y) for y in each]), np.array([y.mean() for y in each])


def evidence(docs: DataFrame, weights: np.ndarray, columns: dict[str, str], text_col: str = "text") -> DataFrame:
    """The ``columns`` (new name -> name), mark (hash of the text) and log likelihood ratios llr_<head>."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    kinds = ", ".join(f"{new} {docs.schema[old].dataType.simpleString()}" for new, old in columns.items())
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, w = _Slots(), sent.value
        for b in batches:
            scores = []
            for t in b.column(k + 1):
                scores.append(w[:, features(t.as_py(), slots)].sum(axis=1))
            scores = np.clip(np.array(scores, np.float64).reshape(-1, len(HEADS)), -30, 30)
            yield pa.RecordBatch.from_arrays([*b.columns[: k + 1], *(pa.array(scores[:, i]) for i in range(len(HEADS)))], [*columns, "mark", *(f"llr_{h}" for h in HEADS)])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*(F.col(old).alias(new) for new, old in columns.items()), F.xxhash64(text).alias("mark"), text.alias("text")).mapInArrow(
        run, f"{kinds}, mark long, {', '.join(f'llr_{h} double' for h in HEADS)}"
    )


def _odds(p):
    return F.log(p / (1 - p))


def _moments(level: str, head: str) -> list:
    """Sums over sites of more than one document, from which their spread follows."""
    n, p = F.col("n"), F.col(f"sum_{head}") / F.col("n")
    several = F.col("n") > 1
    return [
        F.sum(F.when(several, n)).alias(f"{level}_{head}_n"), F.count(F.when(several, 1)).alias(f"{level}_{head}_k"),
        F.sum(F.when(several, n * p)).alias(f"{level}_{head}_m"), F.sum(F.when(several, n * p * p)).alias(f"{level}_{head}_q"),
    ]


def strength(n: float | None, k: int, total: float | None, q: float | None) -> float:
    """Weight of the prior, in documents, from the spread of ``k`` sites' shares (method of moments), between 1 and 1000.

    ``n`` documents, ``total`` the sum of their shares, ``q`` the sum of n p^2 over sites.
    """
    if not n or k < 2 or not 0 < total / n < 1:
        return 10.0
    m = total / n
    between = max(1e-9, (q - n * m**2 - (k - 1) * m * (1 - m)) / n)
    return float(min(1000.0, max(1.0, m * (1 - m) / between - 1)))


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Per row: id, host, path, mark, p_quality, p_toxic, site_quality, site_toxic, keep.

    keep: better than even odds of quality, and less than even odds of toxicity.  Null texts
    count as empty; whole texts are read, very long ones too; null hosts and paths are sites of
    their own (an empty name); repeated rows each count and return a row.  Without labels of
    both kinds evidence is neutral; rows of ``labels`` with a null are left out, and so are
    labels of ids that aren't there.  Other columns are left out, so none can clash.  An empty
    table gives an empty result.
    """
    weights, rates = train(docs, labels, id_col, text_col, sample_rows)
    rates = np.clip(rates, 0.01, 0.99)
    raw = evidence(docs, weights, {"id": id_col, "host": host_col, "path": path_col}, text_col).withColumns(
        {"host": F.coalesce(F.col("host").cast("string"), F.lit("")), "path": F.coalesce(F.col("path").cast("string"), F.lit(""))}
    )
    for h, r in zip(HEADS, rates, strict=True):
        raw = raw.withColumn(f"own_{h}", 1 / (1 + F.exp(-(F.col(f"llr_{h}") + float(np.log(r / (1 - r)))))))
    rows = materialize(raw, "evidence")
    sums = [F.count("*").alias("n"), *(F.sum(f"own_{h}").alias(f"sum_{h}") for h in HEADS)]
    paths = materialize(rows.groupBy("host", "path").agg(*sums), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(f"sum_{h}").alias(f"sum_{h}") for h in HEADS)), "hosts")
    path_level = paths.agg(*(x for h in HEADS for x in _moments("path", h))).first()
    whole = hosts.agg(F.sum("n").alias("n"), *(F.sum(f"sum_{h}").alias(h) for h in HEADS), *(x for h in HEADS for x in _moments("host", h))).first()
    host_side = hosts.select("host", F.col("n").alias("host_n"), *(F.col(f"sum_{h}").alias(f"host_{h}") for h in HEADS))
    path_side = paths.select("host", "path", F.col("n").alias("path_n"), *(F.col(f"sum_{h}").alias(f"path_{h}") for h in HEADS)).join(host_side, "host")
    path_side = materialize(path_side, "sites")  # of known size: broadcast if small, else joined with hot sites split
    out = rows.join(path_side, ["host", "path"])
    for h in HEADS:
        prior = float(min(0.999, max(0.001, whole[h] / whole.n))) if whole.n else 0.5
        a, b = (strength(*(r[f"{level}_{h}_{x}"] for x in "nkmq")) for level, r in (("host", whole), ("path", path_level)))
        own = F.col(f"own_{h}")
        # A site's share without the document itself, shrunk to the level above.
        host = (F.col(f"host_{h}") - own + a * prior) / (F.col("host_n") - 1 + a)
        site = (F.col(f"path_{h}") - own + b * host) / (F.col("path_n") - 1 + b)
        site = F.greatest(F.lit(0.001), F.least(F.lit(0.999), site))
        out = out.withColumn(f"site_{h}", site).withColumn(f"p_{h}", 1 / (1 + F.exp(-(F.col(f"llr_{h}") + _odds(F.col(f"site_{h}"))))))
    return out.select(
        F.col("id").alias(id_col), "host", "path", "mark", "p_quality", "p_toxic", "site_quality", "site_toxic", ((F.col("p_quality") >= 0.5) & (F.col("p_toxic") < 0.5)).alias("keep")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; rows are matched by id (null ids too) and text.

    Cases as in ``score``; repeated rows that differ in host or path alone go if one of them is
    rejected; names of other columns can't clash.
    """
    i, m = unused(docs, "bad_id", "bad_mark")
    bad = score(docs, labels, id_col, text_col, **options).where(~F.col("keep")).select(F.col(id_col).alias(i), F.col("mark").alias(m)).distinct()
    mark = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(bad, docs[id_col].eqNullSafe(bad[i]) & (mark == bad[m]), "left_anti")
