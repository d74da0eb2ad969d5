"""Binary columns stored in bundles, and the stored PCM."""

import hashlib
import random
from pathlib import Path

from railbird.llm import bundles, media, stage


def test_bundles_give_every_byte_back(spark, monkeypatch):
    monkeypatch.setattr(bundles, "BUNDLE_BYTES", 500)
    some = random.Random(6)
    rows = [(i, None if i % 11 == 5 else some.randbytes(i * 7 % 1300), ["a", "b", None][i % 3], [i]) for i in range(120)]
    df = spark.createDataFrame(rows, "n int, b binary, kind string, more array<int>").repartition(3)
    packed = bundles.pack(df, "b", "kind", ("b",))
    assert {r.zstd for r in packed.collect()} == {True, False}
    for back in (bundles.unpack(packed, "b", df.schema), stage.materialize(df, "bundled", bundled=("b", "kind", ("b",)))):
        assert back.columns == df.columns
        assert sorted((r.n, None if r.b is None else bytes(r.b), r.kind, r.more) for r in back.collect()) == rows
    empty = stage.materialize(df.where("n < 0"), "bundled", bundled=("b", "kind", ()))
    assert empty.collect() == []


def test_stored_pcm_is_small_and_whole(spark, monkeypatch):
    """Files and PCM of the given texts take less than 0.95 bytes for a byte of text; row after row they took 27 MB for 25.4 MB on sf0.1."""
    written, plain = {}, media.materialize

    def kept(df, label, **options):
        out, at = plain(df, label, **options), stage._made()[-1]
        written[label] = sum(f.stat().st_size for f in Path(at.removeprefix("file:")).glob("*.parquet")), at, df.schema
        return out

    monkeypatch.setattr(media, "materialize", kept)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    media.roundtrip(docs).collect()
    want = {r.id: hashlib.sha256(r.pcm).digest() for r in media.decode_media(media.encode_texts(docs)).select("id", "pcm").collect()}
    _, at, schema = written["pcm"]
    stored = bundles.unpack(spark.read.parquet(at), "pcm", schema)
    assert {r.id: hashlib.sha256(r.pcm).digest() for r in stored.select("id", "pcm").collect()} == want
    text = sum(len((r.text or "").encode()) for r in docs.select("text").collect())
    assert sum(n for n, *_ in written.values()) < 0.95 * text
