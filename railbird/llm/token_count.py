"""Word-piece counts by a linear longest-match automaton.

A trie holds the vocabulary.  Every node has a failure link, to the node of what is left
after popping the pieces that greedy longest match would take from its string, and the
number of tokens popped on the way.  Going over a word visits each character once and adds
the numbers; no piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.stage import bound_batches

MARK = "▁"  # stands before each word
CACHE_WORDS = 500_000  # word lengths that a task keeps before it starts anew


class Automaton:
    """Characters that no piece covers count as their UTF-8 bytes, as with byte fallback."""

    def __init__(self, pieces: Iterable[str]):
        pieces = {p for p in pieces if p}
        weight = {c: len(c.encode()) for p in pieces for c in p} | dict.fromkeys(pieces, 1)
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.popped, depth, parent, mark, own = [0], [0], [0], [0], [""], [0]
        for piece, tokens in weight.items():
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.popped.append(0)
                    depth.append(depth[node] + 1)
                    parent.append(node)
                    mark.append(c)
                    own.append(0)
                node = self.next[node][c]
            own[node] = tokens
        for node in sorted(range(1, len(self.next)), key=depth.__getitem__):
            if own[node]:
                self.popped[node] = own[node]
                continue
            c, z = mark[node], self.fail[parent[node]]
            n = self.popped[parent[node]]
            while c not in self.next[z]:  # ends at the root: each character of a piece starts a branch there
                n += self.popped[z]
                z = self.fail[z]
            self.popped[node], self.fail[node] = n, self.next[z][c]

    def count(self, word: str) -> int:
        goto, fail, popped, node, n = self.next, self.fail, self.popped, 0, 0
        for c in word:
            while c not in goto[node]:
                if not node:
                    n += len(c.encode())
                    break
                n += popped[node]
                node = fail[node]
            else:
                node = goto[node][c]
        while node:
            n += popped[node]
            node = fail[node]
        return n


class _Lengths(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self.automaton.count(MARK + word)
        if len(word) <= 100:
            self[word] = n
        return n


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model file."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


@lru_cache(1)
def automaton(vocabulary: tuple[str, ...]) -> Automaton:
    """Made once for the tasks that one worker runs."""
    return Automaton(list(vocabulary))


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars (code points), n_words, n_tokens.

    Words are what white space parts; each is split greedily, longest piece first.  Null and
    empty texts have none; whole texts are read, very long ones too.  Repeated rows and null ids
    return rows like any other.  Other columns are left out, so none can clash.  An empty table
    gives an empty result.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(tuple(sentencepiece_vocabulary(vocabulary_path)))  # the file is on the driver's machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _Lengths(automaton(sent.value))
        for b in batches:
            chars, words, tokens = [], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                parts = text.split()
                chars.append(len(text))
                words.append(len(parts))
                tokens.append(sum(map(lengths.__getitem__, parts)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (chars, words, tokens))], ["id", "n_chars", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, n_chars long, n_words long, n_tokens long"
    ).withColumnRenamed("id", id_col)
