"""Web archives in seekable Zstandard bundles.

A bundle is a WARC file of independent Zstandard frames, each with some records, and after
them a seek table in a skippable frame.  An index maps each record's identifier to bundle,
frame and offset in the frame, so that one record costs the footer and one frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.llm.stage import materialize

FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
DEDUP_BYTES = 100
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # magic numbers of the seekable format
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:railbird:page")
INDEX = "array<struct<record_id:string,frame:int,offset:int,length:int>>"
_INDEX_ARROW = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def record_id(page_id) -> str:
    """A name that follows from the page's id, the same in every run."""
    return f"urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}"


def record_name(page: Column) -> Column:
    """``record_id`` of a column of ids."""
    h = F.sha1(F.concat(F.lit(_SPACE.bytes), page.cast("string").cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: (compressed, plain) bytes of each frame."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed, plain) of each frame, from the bundle's last bytes."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for size, plain in struct.iter_unpack("<II", bundle[-9 - 8 * n : -9]):
        out.append((at, size, plain))
        at += size
    return out


def read_frame(bundle: bytes, frame: tuple[int, int, int]) -> bytes:
    start, size, plain = frame
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + size], max_output_size=plain)


def write_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> tuple[str, bytes]:
    """Record id and bytes.  A revisit has no payload, but its length and digest."""
    name = record_id(page_id)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if page_id is not None:
        fields.append(("X-Page-ID", quote(str(page_id), safe="")))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_id(refers_to)}>"), ("X-Refers-To-Page-ID", quote(str(refers_to), safe=""))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload))]
    block = _HTTP.format(len(payload)).encode() + (payload if refers_to is None else b"")
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return name, b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    fields |= {k: unquote(v) for k, v in fields.items() if k in ("X-Page-ID", "X-Refers-To-Page-ID")}
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dedup_bytes: int = DEDUP_BYTES) -> DataFrame:
    """(id, url, payload, digest, refers_to): refers_to is the least id with an equal payload, for all others of it."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    alike = rows.where(F.octet_length("payload") >= dedup_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    first = alike.where("n > 1").select("digest", "first")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "digest", "left").select("id", "url", "payload", "digest", refers.alias("refers_to"))


def write_bundles(marked: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Rows of ``mark_revisits`` -> a row per bundle: bundle_id, data (the file's bytes), index.

    A frame ends with the record that fills ``frame_bytes``, a bundle with the frame that fills
    ``bundle_bytes``; a task holds one bundle at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        data, frames, index, open_, start = bytearray(), [], [], [], 0

        def close_frame():
            nonlocal open_, start
            plain = b"".join(open_)
            if plain:
                packed = press.compress(plain)
                data.extend(packed)
                frames.append((len(packed), len(plain)))
            open_, start = [], 0

        def close_bundle():
            nonlocal data, frames, index
            whole = bytes(data) + seek_table(frames)
            out = pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(whole).hexdigest()]), pa.array([whole], pa.binary()), pa.array([index], _INDEX_ARROW)], ["bundle_id", "data", "index"])
            data, frames, index = bytearray(), [], []
            return out

        for b in batches:
            for i in range(b.num_rows):
                page, url, payload, digest, refers = (c[i].as_py() for c in b.columns)
                name, record = write_record(page, url, payload, digest, refers)
                index.append({"record_id": name, "frame": len(frames), "offset": start, "length": len(record)})
                open_.append(record)
                start += len(record)
                if start >= frame_bytes:
                    close_frame()
                    if len(data) >= bundle_bytes:
                        yield close_bundle()
        close_frame()
        if index:
            yield close_bundle()

    return marked.select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, f"bundle_id string, data binary, index {INDEX}")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record by way of index and seek table: record_id, page_id, payload_bytes, payload_digest, record_type, refers_to (strings for ids).

    The digest of a response is computed from the bytes read; it must equal the recorded one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, index in zip(b.column(0), b.column(1), strict=True):
                bundle, rows, last, plain = data.as_py(), [], None, b""
                table = read_seek_table(bundle)
                for e in index.as_py():
                    if e["frame"] != last:
                        last, plain = e["frame"], read_frame(bundle, table[e["frame"]])
                    fields, payload = read_record(plain[e["offset"] : e["offset"] + e["length"]])
                    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (n, digest):
                        raise ValueError(f"{e['record_id']}: payload and digest differ")
                    rows.append((e["record_id"], fields.get("X-Page-ID"), n, digest, fields["WARC-Type"], fields.get("X-Refers-To-Page-ID")))
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.select("data", "index").mapInArrow(run, "record_id string, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def fetch(bundles: DataFrame, ids: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(record_id, record): the records of the pages in ``ids``, each frame read once for all of its records."""
    wanted = ids.select(record_name(F.col(id_col)).alias("record_id")).distinct()
    places = bundles.select("bundle_id", F.explode("index").alias("e")).select("bundle_id", "e.*").join(wanted, "record_id")
    asked = places.groupBy("bundle_id").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, wants in zip(b.column(0), b.column(1), strict=True):
                bundle = data.as_py()
                table = read_seek_table(bundle)
                got, last, plain = [], None, b""
                for e in sorted(wants.as_py(), key=lambda e: (e["frame"], e["offset"])):
                    if e["frame"] != last:
                        last, plain = e["frame"], read_frame(bundle, table[e["frame"]])
                    got.append((e["record_id"], plain[e["offset"] : e["offset"] + e["length"]]))
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.binary())], ["record_id", "record"])

    return bundles.select("bundle_id", "data").join(asked, "bundle_id").select("data", "asked").mapInArrow(run, "record_id string, record binary")


def resolve_revisits(read: DataFrame) -> DataFrame:
    """Rows of ``read_bundles``, in which length and digest of a revisit are those of the response that it refers to.

    A revisit without a response of its digest is an error.
    """
    found = read.where("record_type = 'response'").select(F.col("page_id").alias("response"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("n")).distinct()
    revisits = read.where("record_type = 'revisit'").join(found, (F.col("refers_to") == F.col("response")) & (F.col("payload_digest") == F.col("digest")), "left")
    n = F.coalesce("n", F.raise_error(F.concat(F.lit("no response to revisit "), F.col("record_id"))).cast("long"))
    others = [c for c in read.columns if c not in ("payload_bytes", "payload_digest")]
    checked = revisits.select(*others, n.alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    return read.where("record_type = 'response'").unionByName(checked)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages to bundles in the shared folder and reads them back.

    Per row: id, payload_bytes, payload_digest, record_type, refers_to.  Null html is an empty
    payload; a very long page is a frame, and a bundle, of its own.  Of repeated rows with the
    least id all are responses; a null id refers to the least id with its payload, if there is
    one.  Ids may be any text.  Other columns are left out, so none can clash.  An empty table
    gives an empty result.
    """
    kind = pages.schema[id_col].dataType
    bundles = materialize(write_bundles(mark_revisits(pages, id_col, url_col, html_col)), "warc", "none")
    read = resolve_revisits(materialize(read_bundles(bundles), "warc-read"))
    return read.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
