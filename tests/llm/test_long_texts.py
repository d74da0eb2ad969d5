"""Texts and pages of some megabytes go through whole."""

import hashlib
import random
import zlib

import pytest

from railbird.llm import jaccard, licenses, media, pii, quality, simhash, spelling, token_count, warc
from railbird.llm.queries import tokenizer
from tests.llm.test_operators import docs_of

SIZE = 500_000  # words


@pytest.fixture(scope="module")
def long_text():
    rnd = random.Random(9)
    return " ".join(f"{rnd.choice('abcdefgh')}{rnd.choice(['rdon', 'lim', 'stera'])}{rnd.randrange(3000)}" for _ in range(SIZE))


@pytest.fixture(scope="module")
def docs(spark, long_text):
    last = long_text.split(" ")[-1]
    near = long_text[: -len(last)] + "changed at the very end"
    return docs_of(spark, [(1, long_text), (2, near), (3, "short"), (4, long_text + " me@example.org")]).cache()


def test_pii_at_the_end(docs, long_text):
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    a = len(long_text) + 1
    assert [got[i].n_email for i in (1, 2, 3, 4)] == [0, 0, 0, 1] and f"email:{a}:{a + 14}" in got[4].spans


def test_tokens_quality_and_media(spark, docs, long_text):
    counted = {r.doc_id: r for r in token_count.count_tokens(docs, tokenizer("piece_bpe_32k.model")).collect()}
    assert counted[1].n_words == SIZE and counted[1].n_chars == len(long_text) and counted[2].n_words == SIZE + 4
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, labels).count() == 4
    stored = {r.doc_id: r for r in media.roundtrip(docs).collect()}
    payload = long_text.encode() + b"\0" * (-len(long_text.encode()) % 64)
    assert stored[1].payload_sha256 == hashlib.sha256(payload).hexdigest() and stored[1].tail_crc32 == zlib.crc32(payload[-64:])


def test_links_of_long_texts(docs):
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert {r.doc_id: r.component_id for r in jaccard.components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_words_and_licenses_of_long_texts(spark, long_text):
    assert spelling.variants(docs_of(spark, [(1, long_text)])).count() > 0
    words = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    assert licenses.scan(docs_of(spark, [(1, long_text + "\n" + words), (2, long_text)])).count() >= 0


def test_archive_of_a_long_page(spark, long_text):
    pages = spark.createDataFrame([(1, "u", long_text), (2, "v", long_text), (3, "w", None)], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(pages).collect()}
    n = len(long_text.encode())
    assert got == {1: (n, "response", None), 2: (n, "revisit", 1), 3: (0, "response", None)}
