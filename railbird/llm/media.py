"""Telephony audio: mu-law, A-law and IMA ADPCM columns, stored as RIFF files and decoded to PCM.

Mu-law and A-law bytes are expanded by tables of 256 values.  ADPCM blocks carry their own
start, so all blocks of a file are decoded together: numpy goes over the places in a block,
with one lane per block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.stage import materialize, typed

FORMATS = {"mulaw": 7, "alaw": 6, "adpcm": 17}  # codes of the RIFF registry
RATE, OUT_RATE, UNIT = 8000, 16000, 64
GROUP_BYTES = 16 << 20  # of a row group of files or PCM, so that a reader doesn't hold thousands of long ones
PAGE_BYTES, LEVEL = 4 << 20, 10  # what Zstandard sees at once, and its level, for files


def mulaw_table() -> np.ndarray:
    """ITU-T G.711 mu-law: complemented byte, sign, 3 bits of exponent, 4 of mantissa, bias 132."""
    u = ~np.arange(256) & 0xFF
    size = (((u & 15) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """ITU-T G.711 A-law: even bits inverted, a set sign bit is positive."""
    a = np.arange(256) ^ 0x55
    e, size = (a >> 4) & 7, ((a & 15) << 4) + 8
    size = np.where(e > 0, (size + 256) << np.maximum(e - 1, 0), size)
    return np.where(a & 128, size, -size).astype(np.int16)


def step_table() -> np.ndarray:
    """The 89 IMA step sizes, each a tenth above the last, starting at 7."""
    # Fixed values of the IMA ADPCM specification.
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209,
         230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749,
         3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
         27086, 29794, 32767], np.int32)


_MULAW, _ALAW, _STEPS = mulaw_table(), alaw_table(), step_table()
_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def decode_adpcm(data: bytes, block: int = UNIT) -> np.ndarray:
    """IMA blocks: first sample (16 bits), step index, a byte, then two samples a byte, low half first."""
    b = np.frombuffer(data, np.uint8).reshape(-1, block)
    value = np.ascontiguousarray(b[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(b[:, 2], 88).astype(np.int32)
    codes = np.empty((block * 2 - 8, len(b)), np.int32)
    codes[0::2], codes[1::2] = (b[:, 4:] & 15).T, (b[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(b)), np.int16)
    out[0] = value
    for i, code in enumerate(codes):
        step = _STEPS[index]
        size = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
        value = np.clip(value + np.where(code & 8, -size, size), -32768, 32767)
        index = np.clip(index + _MOVES[code & 7], 0, 88)
        out[i + 1] = value
    return out.T.reshape(-1)


def decode(codec: str, data: bytes) -> np.ndarray:
    if codec == "adpcm":
        return decode_adpcm(data)
    return (_MULAW if codec == "mulaw" else _ALAW)[np.frombuffer(data, np.uint8)]


def decode_all(files: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """``decode`` of several (codec, samples): the ADPCM blocks of all of them go through numpy together."""
    blocks = decode_adpcm(b"".join(data for codec, data in files if codec == "adpcm"))
    out, at = [], 0
    for codec, data in files:
        if codec == "adpcm":
            n = len(data) // UNIT * (UNIT * 2 - 7)
            out.append(blocks[at : at + n])
            at += n
        else:
            out.append(decode(codec, data))
    return out


def _portions(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, files) of runs of rows with about ``most_bytes`` together."""
    first, held, size = 0, [], 0
    for m in column:
        held.append(m.as_py())
        size += len(held[-1] or b"")
        if size >= most_bytes:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def resample(pcm: np.ndarray, rate: int = RATE, to: int = OUT_RATE) -> np.ndarray:
    """Linear interpolation; the last sample is held."""
    n = len(pcm) * to // rate
    if to == 2 * rate:
        wide = pcm.astype(np.int32)
        out = np.empty(n, np.int16)
        out[0::2], out[1::2] = wide, (wide + np.append(wide[1:], wide[-1:])) >> 1
        return out
    return np.rint(np.interp(np.arange(n) * rate / to, np.arange(len(pcm)), pcm)).astype(np.int16)


def pack_pcm(pcm: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(head, places, differences) of 16-bit samples, for archives of one's own (``roundtrip`` stores whole samples): without what follows from the others; any samples come back from ``unpack_pcm`` as they were.

    Every second sample goes where it is the mean of its neighbours, as ``resample`` makes it.
    What stays are places in the head's list of values if these are 256 at most (mu-law and
    A-law), else differences.  The three are columns of their own, as unlike bytes compress badly together.
    """
    halved = len(pcm) % 2 == 0 and np.array_equal(resample(pcm[0::2]), pcm)
    kept = np.ascontiguousarray(pcm[0::2]) if halved else pcm
    seen = np.zeros(1 << 16, bool)
    codes = kept.view(np.uint16)
    seen[codes] = True
    values = np.flatnonzero(seen)
    if len(values) > 256:
        return bytes([halved]), b"", np.diff(kept, prepend=np.int16(0)).astype("<i2").tobytes()
    place = np.zeros(1 << 16, np.uint8)
    place[values] = np.arange(len(values))
    return bytes([halved]) + values.astype("<u2").tobytes(), place[codes].tobytes(), b""


def unpack_pcm(head: bytes, places: bytes, differences: bytes) -> np.ndarray:
    if differences:
        kept = np.cumsum(np.frombuffer(differences, "<i2"), dtype=np.int16)
    else:
        kept = np.frombuffer(head, "<u2", offset=1).astype(np.uint16).view(np.int16)[np.frombuffer(places, np.uint8)]
    return resample(kept) if head[0] else kept


def write_wav(codec: str, data: bytes, rate: int = RATE) -> bytes:
    """``data`` as the samples (for ADPCM: blocks of 64 bytes) of a mono RIFF file."""
    adpcm = codec == "adpcm"
    per_block = UNIT * 2 - 7
    form = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, rate * UNIT // per_block if adpcm else rate, UNIT if adpcm else 1, 4 if adpcm else 8)
    form += struct.pack("<HH", 2, per_block) if adpcm else struct.pack("<H", 0)
    samples = len(data) // UNIT * per_block if adpcm else len(data)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body) + len(data) % 2) + body + b"\0" * (len(data) % 2)


def read_wav(media: bytes) -> tuple[str, int, bytes]:
    """codec, rate, samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(media):
        name, (n,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if name == b"fmt ":
            code, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next(k for k, v in FORMATS.items() if v == code)
        elif name == b"data":
            return codec, rate, media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def feature(codec: str, pcm: np.ndarray) -> str:
    """codec, samples, mean energy, sign changes and CRC-32 of resampled PCM."""
    wide = pcm.astype(np.int64)
    energy = int((wide * wide).sum()) // max(1, len(pcm))
    return f"{codec}:{len(pcm)}:{energy}:{int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))}:{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 form, and it with zeros up to the next multiple of 64, 64 at least."""
    data = (text or "").encode()
    return len(data), data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's bytes as samples of a RIFF file; the codec follows from the length."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = list(FORMATS)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                made = [payload_of(t.as_py()) for t in part.column(1)]
                media = [write_wav(codecs[n % 3], data) for n, data in made]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def decode_media(media: DataFrame, column: str = "media") -> DataFrame:
    """Adds codec, rate and pcm (binary, 16-bit little-endian at 16 kHz).  A null file has null fields."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    at, names = media.columns.index(column), [*media.columns, "codec", "pcm_rate", "pcm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, files in _portions(b.column(at)):
                part = b.slice(first, len(files))
                read = [read_wav(m) for m in files if m is not None]
                pcm = iter(zip(read, decode_all([(codec, data) for codec, _, data in read]), strict=True))
                rows = []
                for m in files:
                    if m is None:
                        rows.append((None, None, None))
                        continue
                    (codec, rate, _), samples = next(pcm)
                    rows.append((codec, OUT_RATE, resample(samples, rate).astype("<i2").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                    names,
                )

    return media.mapInArrow(run, f"{kinds}, codec string, pcm_rate int, pcm binary")


def roundtrip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text's bytes as telephony audio, reads the files back, stores their whole resampled PCM (16-bit samples at 16 kHz) and reads that back too.

    All samples are stored, those of files of one codec compressed together: bzip2, for ADPCM Zstandard, whose samples it sorts slowly.

    Per row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature.  The first ones are of the files as read, the feature of the PCM as
    read.  Null texts count as empty; whole texts are stored, very long ones too; equal texts
    give equal values; repeated rows each return a row.  Other columns are left out, so none
    can clash.  An empty table gives an empty result.
    """
    stored = materialize(encode_texts(docs, id_col, text_col), "media", level=LEVEL, group_bytes=GROUP_BYTES, page_bytes=PAGE_BYTES)
    digests = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    before = f"{typed(stored, 'id')}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", *digests, "codec", "pcm"]
        for b in batches:
            for first, files in _portions(b.column(2)):
                part = b.slice(first, len(files))
                read = [read_wav(m) for m in files]
                rows = []
                for media, (codec, rate, data), samples in zip(files, read, decode_all([(codec, data) for codec, _, data in read]), strict=True):
                    pcm = resample(samples, rate).astype("<i2").tobytes()
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), codec, pcm))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [feature(codec.as_py(), np.frombuffer(pcm.as_buffer(), "<i2")) for codec, pcm in zip(*b.columns[7:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(made, pa.string())], ["id", "n_bytes", *digests, "feature"])

    decoded = stored.mapInArrow(digest, f"{before}, codec string, pcm binary")
    made = materialize(decoded, "pcm", group_bytes=GROUP_BYTES, bundled=("pcm", "codec", ("adpcm",)), then=(featured, f"{before}, feature string"))
    return made.withColumnRenamed("id", id_col)
