"""Personal data: patterns, and information-theoretic sanitisation around them.

Base kinds are found by pattern.  Each mention of an entity (an address, a number) has a
window of words beside it.  Over the whole corpus, the distinct texts with a word in a
window of an entity, against all distinct texts with the word, estimate p(entity | word).
The lower end of its confidence interval (Wilson's) is taken, with as many observations as
there are different windows, so that copies prove nothing and one mention proves little.
The entity's uncertainty that is left once the word is known is -log2 of it, that is, the
entity's information less their pointwise mutual information.  A word that leaves at most
``remove_bits`` discloses the entity and is removed; one that leaves at most
``generalise_bits`` is generalised to its class, by its shape where it stands (name,
acronym or word) and its frequency: wherever it stands, in any text, since the entity
itself is masked everywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.llm.stage import materialize, unused

KINDS = ("email", "ip", "card", "phone")
MARKS = {k: f"[{k.upper()}]" for k in KINDS} | {"term": "[REDACTED]"}
#: Generalised words by how many different texts have them: up to 10, up to 1000, more.
BANDS = {"rare": 10, "uncommon": 1000, "common": None}
SIDE_WORDS, SIDE_CHARS = 8, 160
CONFIDENCE, REMOVE_BITS, GENERALISE_BITS = 1.96, 1.0, 3.0  # the first in standard deviations: 95 %
FILTER_BITS = 1 << 23

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# The look-behind only saves trying each digit of a run: from inside it nothing else can match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
_NOT_DIGITS = re.compile(r"[^0-9]+")

MENTIONS = "array<struct<kind:string,entity:string,context:long,words:array<struct<word:string,start:int,end:int>>>>"
_MENTIONS_ARROW = pa.list_(
    pa.struct(
        [
            ("kind", pa.string()),
            ("entity", pa.string()),
            ("context", pa.int64()),
            ("words", pa.list_(pa.struct([("word", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
        ]
    )
)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each @ takes the longest run of local characters before it that no match has used."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; positions count code points."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mentions(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Each base span with its entity, a hash of its window's words, and these words with their places."""
    out = []
    taken = sorted((a, b) for _, a, b in spans)
    for kind, a, b in spans:
        entity = text[a:b].lower() if kind == "email" else text[a:b] if kind == "ip" else _NOT_DIGITS.sub("", text[a:b])
        found = []
        low, high = max(0, a - SIDE_CHARS), min(len(text), b + SIDE_CHARS)
        before = [m for m in _WORD.finditer(text, low, a) if m.start() > low or low == 0][-SIDE_WORDS:]
        after = [m for m in _WORD.finditer(text, b, high) if m.end() < high or high == len(text)][:SIDE_WORDS]
        for m in (*before, *after):
            if not any(x < m.end() and m.start() < y for x, y in taken):
                found.append({"word": m[0].lower(), "start": m.start(), "end": m.end()})
        context = xxhash.xxh64_intdigest(" ".join(w["word"] for w in found)) - (1 << 63)
        out.append({"kind": kind, "entity": entity, "context": context, "words": found})
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, mark (hash of the text, null counts as empty), n_<kind>, base (spans) and mentions."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "mark", *(f"n_{k}" for k in KINDS), "base", "mentions"]
        for b in batches:
            counts, base, around = [], [], []
            for t in b.column(2):
                text = t.as_py()
                spans = base_spans(text)
                n = Counter(k for k, *_ in spans)
                counts.append([n[k] for k in KINDS])
                base.append(joined(spans))
                around.append(mentions(text, spans))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))), pa.array(base, pa.string()), pa.array(around, _MENTIONS_ARROW)], names
            )

    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("mark"), "text")
    return plain.mapInArrow(run, f"id {kind}, mark long, {', '.join(f'n_{k} long' for k in KINDS)}, base string, mentions {MENTIONS}")


def _hash(word: str) -> int:
    """As Spark's xxhash64 has it."""
    return xxhash.xxh64_intdigest(word.encode(), 42) % FILTER_BITS


def _sent(wanted: DataFrame, column: str):
    """A broadcast filter of fixed size, one megabyte whatever the input, that holds the hashes of ``column``; folded in Spark."""
    slot = F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(FILTER_BITS))
    folded = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(slot % 64)))").alias("bits"))
    held = folded.toArrow()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    bits[held["at"].to_numpy()] = held["bits"].to_numpy()
    return wanted.sparkSession.sparkContext.broadcast(bits)


class _Filter(dict):
    """Whether the filter holds a word, with a bounded memory of answers."""

    def __init__(self, sent):
        self.held = np.unpackbits(sent.value.view(np.uint8), bitorder="little").astype(bool)

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = bool(self.held[_hash(word)])
        return out


def _marked(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*more, F.xxhash64(text).alias("mark"), text.alias("text"))


def word_counts(docs: DataFrame, scanned: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): distinct texts with the word, of at least the words in ``wanted`` (word).

    Filters keep most other words out of the shuffle, and only texts that may have copies
    pass their words with the text's mark.  A row goes out per text and word; Spark counts
    them, on the map side first.
    """
    copied = scanned.groupBy("mark").count().where("count > 1").select("mark")
    words, marks = _sent(wanted, "word"), _sent(copied, "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, twice = _Filter(words), _Filter(marks)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                seen, own = [], []
                for mark, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    mine = [w for w in {w.lower() for w in set(_WORD.findall(t.as_py()))} if known[w]]
                    seen += mine
                    own += [mark if twice[str(mark)] else None] * len(mine)
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(own, pa.int64())], ["word", "mark"])

    once = _marked(docs, text_col).mapInArrow(run, "word string, mark long").groupBy("word", "mark").agg(F.count("*").alias("n"))
    return once.groupBy("word").agg(F.sum(F.when(F.col("mark").isNull(), F.col("n")).otherwise(1)).alias("n"))


def lower_bound(share: Column, n: Column, z: float) -> Column:
    """The lower end of Wilson's interval of a share seen in ``n`` observations."""
    return (share + z * z / 2 / n - z * F.sqrt(share * (1 - share) / n + z * z / 4 / n / n)) / (1 + z * z / n)


def band(n: Column) -> Column:
    out = F.when(n <= BANDS["rare"], "rare").when(n <= BANDS["uncommon"], "uncommon")
    return out.otherwise("common")


def disclosures(docs: DataFrame, scanned: DataFrame, text_col: str = "text", confidence: float = CONFIDENCE, remove_bits: float = REMOVE_BITS, generalise_bits: float = GENERALISE_BITS) -> DataFrame:
    """(kind, entity, word, bits, action): the words that disclose an entity; action is term (removed) or the band of its frequency."""
    seen = scanned.select("mark", F.explode("mentions").alias("m")).select("mark", "m.kind", "m.entity", "m.context", F.explode("m.words.word").alias("word"))
    pairs = materialize(seen.groupBy("kind", "entity", "word").agg(F.count_distinct("mark").alias("both"), F.count_distinct("context").alias("contexts")), "pairs")
    counts = word_counts(docs, scanned, pairs.select("word").distinct(), text_col)
    share = F.col("both") / F.greatest("n", "both")
    bits = F.greatest(F.lit(0.0), -F.log2(lower_bound(share, F.least("contexts", "both") / share, confidence)))
    return (
        pairs.join(counts, "word")
        .withColumn("bits", bits)
        .where(F.col("bits") <= generalise_bits)
        .select("kind", "entity", "word", "bits", F.when(F.col("bits") <= remove_bits, "term").otherwise(band(F.col("n"))).alias("action"))
    )


def words_outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """The words of ``text`` between its base spans."""
    at = 0
    for a, b in (*sorted((a, b) for _, a, b in spans), (len(text), len(text))):
        if a > at:
            yield from _WORD.finditer(text, at, a)
        at = max(at, b)


def occurrences(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, word, places): where, outside base spans, texts have at least the words in ``wanted`` (word)."""
    words, kind = _sent(wanted, "word"), docs.schema[id_col].dataType.simpleString()
    places = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Filter(words)
        for b in batches:
            at, found, where = [], [], []
            for i, t in enumerate(b.column(2)):
                text, mine = t.as_py(), {}
                if not any(known[w] for w in {w.lower() for w in set(_WORD.findall(text))}):
                    continue
                for m in words_outside(text, base_spans(text)):
                    if known[w := m[0].lower()]:
                        mine.setdefault(w, []).append({"start": m.start(), "end": m.end()})
                at += [i] * len(mine)
                found += mine
                where += mine.values()
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(found, pa.string()), pa.array(where, places)], ["id", "mark", "word", "places"])

    return _marked(docs, text_col, F.col(id_col).alias("id")).mapInArrow(run, f"id {kind}, mark long, word string, places array<struct<start:int,end:int>>")


def _strictest(action: str) -> Column:
    """Removal comes before generalisation; of one word there is one band."""
    return F.max_by(action, F.col(action) == "term").alias("action")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """Per row of ``docs``: id, mark, n_<kind>, base (spans joined), spans (base ones, then added ones).

    Null texts count as empty; whole texts are read, very long ones too; repeated rows each
    return a row; null ids are matched to themselves.  Other columns are left out, so none can
    clash.  An empty table gives an empty result.
    """
    scanned = materialize(scan(docs, id_col, text_col), "pii")
    # Written, so that a frequent word meets it in a join that can be split.
    known = materialize(disclosures(docs, scanned, text_col, **thresholds).groupBy("word").agg(_strictest("action")), "disclosing")
    added = (
        occurrences(docs, known, id_col, text_col)
        .join(known, "word")
        .select("id", "mark", "action", F.explode("places").alias("p"))
        .groupBy("id", "mark", F.col("p.start").alias("start"), F.col("p.end").alias("end"))
        .agg(_strictest("action"))
        .groupBy("id", "mark")
        .agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("action") == "term", 0).otherwise(1).alias("order"), "start", "end", "action"))).alias("added"))
        .select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.transform("added", lambda x: F.concat_ws(":", x["action"], x["start"], x["end"])).alias("added"))
    )
    all_spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join("added", ","))
    return scanned.join(added, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select(
        F.col("id").alias(id_col), "mark", *(f"n_{k}" for k in KINDS), "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(all_spans).alias("spans")
    )


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_<kind>, base_sha256, spans; cases as in ``find_spans``."""
    return find_spans(docs, **options).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def mark_of(kind: str, found: str) -> str:
    """What stands in place of ``found``; generalised words by shape and band."""
    if kind not in BANDS:
        return MARKS[kind]
    shape = "ACRONYM" if found.isupper() else "NAME" if found[:1].isupper() else "WORD"
    return f"[{kind.upper()} {shape}]"


def redact(text: str, spans: str) -> str:
    """``text`` with each span replaced by its mark; of overlapping spans, the earlier and longer."""
    cuts = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b, k in cuts:
        if a >= at:
            out += [text[at:a], mark_of(k, text[a:-b])]
        elif -b > at:  # what overlaps the last span and goes on goes with it
            at = -b
            continue
        at = max(at, -b)
    return "".join([*out, text[at:]])


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **thresholds) -> DataFrame:
    """``docs`` with personal data and disclosing words in ``text_col`` replaced; ``length_col``, if there is one, is set anew.

    Rows keep their number and other columns, whose names can't clash; null texts stay null;
    repeated rows have one text; an empty table stays empty.
    """
    i, m, found = unused(docs, "span_id", "span_mark", "found")
    spans = find_spans(docs, id_col, text_col, **thresholds).where("spans != ''").select(F.col(id_col).alias(i), F.col("mark").alias(m), F.col("spans").alias(found)).distinct()
    both = docs.join(spans, docs[id_col].eqNullSafe(spans[i]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == spans[m]), "left")

    @F.pandas_udf("string")
    def clean(text, found):  # noqa: ANN001
        return text.combine(found, lambda t, s: redact(t, s) if s and t is not None else t)

    changed = both.withColumn(text_col, F.when(F.col(found).isNull(), F.col(text_col)).otherwise(clean(text_col, found)))
    if length_col and length_col in docs.columns:
        changed = changed.withColumn(length_col, F.when(F.col(found).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return changed.drop(i, m, found)
