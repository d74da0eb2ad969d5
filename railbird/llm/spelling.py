"""Words that differ by one edit, by permuterm rotations.

A word with an end mark, ``xcy$``, has the rotation ``y$xc`` that ends in the character c.  Without it,
``y$x`` is the range of all words that have any one character there, or none: the word ``xy``,
whose own rotation it is.  So all rotations are sorted by what they are without their last character, words
beside their whole rotations, and each range is scanned.  A range has at most one word for each letter
of the alphabet and one more, whatever the number of words.  A deletion inside equal letters lies
in several ranges; it counts in the one where it skips the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railbird.llm.stage import materialize

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONG = 512  # rotations of more characters are told by two hashes, so that a word of a million letters takes no square of them
_FIELD, _BASES = (1 << 61) - 1, (1_000_003, 998_244_353)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, drop_every: int = 97) -> DataFrame:
    """(word, n): words of enough code points and occurrences.

    A document's word whose checksum with the id is divisible by ``drop_every`` loses a
    letter first.  A null id counts as an empty one; null texts have no words.
    """
    run = F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(LETTERS), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), run.alias("_run"))
    words = runs.select("_id", F.translate("_run", UPPER, LOWER).alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = (F.col("_h") % F.length("_run")).cast("int")
    less = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    said = words.select("_run", h.alias("_h")).select(F.when(F.col("_h") % drop_every == 0, less).otherwise(F.col("_run")).alias("word"))
    return said.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _hashes(word: str) -> list[tuple[list[int], list[int]]]:
    """For each base the hashes of all prefixes, and the base's powers."""
    out = []
    for base in _BASES:
        h, power = [0], [1]
        for c in word:
            h.append((h[-1] * base + ord(c)) % _FIELD)
            power.append(power[-1] * base % _FIELD)
        out.append((h, [*power, power[-1] * base % _FIELD]))
    return out


def rotations(word: str) -> Iterator[tuple[str, str, str]]:
    """(rotation without its last character, that character or '' for the whole one, character before it)."""
    n = len(word)
    hashed = _hashes(word) if n >= LONG else None

    def key(i: int, skip: int) -> str:
        """``word[i + skip:] + '$' + word[:i]``, or what stands for it."""
        if n - skip + 1 <= LONG:
            return f"{word[i + skip :]}${word[:i]}"
        parts = []
        for base, (h, power) in zip(_BASES, hashed, strict=True):
            tail = (h[n] - h[i + skip] * power[n - i - skip]) % _FIELD
            parts.append(((tail * base + 36) * power[i] + h[i]) % _FIELD)
        return f"${n - skip}:{parts[0]}:{parts[1]}"

    for i in range(n + 1):
        before = word[i - 1] if i else "$"
        yield key(i, 0), "", before
        if i < n:
            yield key(i, 1), word[i], before


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.string()] * 4 + [pa.int64()])], ["key", "skipped", "before", "word", "n"])

    for b in batches:
        rows, held = [], 0
        for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for r in rotations(word):
                rows.append((*r, word, n))
                held += len(word)
                if held > 1 << 22:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n) distinct -> (word, n, n_near, best): the number of words one edit away, and (-n, word) of the most frequent of them."""
    spread = words.select("word", "n").mapInArrow(_spread, "key string, skipped string, before string, word string, n long")
    scan = Window.partitionBy("key").orderBy(F.desc("n"), "word")
    whole = scan.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.struct((-F.col("n")).alias("n"), "word")
    at = spread.select(
        "word", "n", "skipped", (F.col("skipped") == F.col("before")).alias("again"),
        F.row_number().over(scan).alias("place"), (F.count("*").over(whole) - 1).alias("others"),
        F.max((F.col("skipped") == "").cast("int")).over(whole).alias("bare"),
        F.max((F.col("skipped") == F.col("before")).cast("int")).over(whole).alias("repeats"),
        F.first(other).over(whole).alias("top"), F.nth_value(other, 2).over(whole).alias("next"),
    )
    near = F.col("others") - F.when(F.col("skipped") == "", F.col("repeats")).when(F.col("again"), F.col("bare")).otherwise(0)
    best = F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top"))
    return at.groupBy("word", "n").agg(F.sum(near).alias("n_near"), F.min(best).alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): where the forms lead.  Frequencies at least double from form to form, so a way has at most 63 steps, and each round doubles what is known of it."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    ``form`` is the most frequent word one edit away (ties: the least in code-point order) if it is
    at least twice as frequent, else null; ``root`` is where forms lead, the word itself without one.
    Null and empty texts have no words; repeated rows count again; words of any length are
    taken.  Other columns are left out, so none can clash.  An empty table gives an empty result.
    """
    words = materialize(vocabulary(docs, id_col, text_col), "vocabulary")
    near = near_words(words)
    taken = -F.col("best.n") >= 2 * F.col("n")
    told = materialize(near.select("word", "n", "n_near", F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.n")).alias("form_n")), "near")
    roots = follow(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
