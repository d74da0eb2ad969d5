"""Binary columns stored in bundles of many rows, so that a compressor sees more than one of them.

bzip2 sorts a block by what follows, which suits samples whose bytes follow from one another;
Zstandard is quicker where that doesn't help.  Both are general: every byte comes back, whatever
it is.
"""

from __future__ import annotations

import bz2
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BUNDLE_BYTES = 5_950_000  # ten blocks, before compression; a longer value is a bundle by itself
BLOCKS = 6  # hundreds of thousands of bytes that bzip2 sorts at once
QUICK = zstandard.ZstdCompressionParameters.from_level(12, window_log=23, chain_log=22, hash_log=22, search_log=6, min_match=6)  # as small as level 12 on samples, in two thirds of the time


def press(data: bytes, zstd: bool) -> bytes:
    return zstandard.ZstdCompressor(compression_params=QUICK).compress(data) if zstd else bz2.compress(data, BLOCKS)


def loosen(data: bytes, zstd: bool) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if zstd else bz2.decompress(data)


def pack(df: DataFrame, column: str, kind: str, quick: tuple[str, ...] = ()) -> DataFrame:
    """(rows, sizes, zstd, data): rows of one task with equal ``kind``, their other columns and their values of ``column`` end to end.  Kinds in ``quick`` go through Zstandard."""
    others = [f for f in df.schema.fields if f.name != column]
    names = [f.name for f in others]
    schema = T.StructType([T.StructField("rows", T.ArrayType(T.StructType(others))), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("zstd", T.BooleanType()), T.StructField("data", T.BinaryType())])

    def bundle(parts: list[pa.RecordBatch], values: list[bytes | None], zstd: bool) -> pa.RecordBatch:
        fields = [parts[0].schema.field(n) for n in names]
        rows = pa.StructArray.from_arrays([pa.concat_arrays([p.column(i) for p in parts]) for i in range(len(names))], fields=fields)
        sizes = pa.array([None if v is None else len(v) for v in values], pa.int64())
        once = pa.array([0, len(values)], pa.int32())
        data = press(b"".join(v for v in values if v is not None), zstd)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(once, rows), pa.ListArray.from_arrays(once, sizes), pa.array([zstd]), pa.array([data], pa.binary())], ["rows", "sizes", "zstd", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[list[pa.RecordBatch], list[bytes | None]]] = {}
        length: dict[str | None, int] = {}
        for b in batches:
            kinds = b.column(b.schema.get_field_index(kind)).to_pylist()
            rest, values = b.select(names), b.column(b.schema.get_field_index(column))
            for k in dict.fromkeys(kinds):
                places = [i for i, x in enumerate(kinds) if x == k]
                own, first = rest.take(pa.array(places, pa.int64())), 0
                for n, i in enumerate(places, 1):
                    parts, filled = held.setdefault(k, ([], []))
                    filled.append(values[i].as_py())
                    length[k] = length.get(k, 0) + len(filled[-1] or b"")
                    if length[k] >= BUNDLE_BYTES:
                        yield bundle([*parts, own.slice(first, n - first)], filled, k in quick)
                        del held[k], length[k]
                        first = n
                if first < len(places):
                    held[k][0].append(own.slice(first))
        for k, (parts, filled) in held.items():
            yield bundle(parts, filled, k in quick)

    return df.mapInArrow(run, schema)


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def unpack(packed: DataFrame, column: str, schema: T.StructType, then: tuple[Step, str] | None = None) -> DataFrame:
    """The rows that ``pack`` took, with the columns of ``schema``; ``then`` (a function as for mapInArrow, its schema) goes over them where they are unpacked, so that long values don't leave the Python worker."""
    names = schema.fieldNames()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, sizes, zstd, data in zip(*b.columns, strict=True):
                lengths, plain = sizes.values, loosen(data.as_py(), zstd.as_py())
                ends = np.append(0, np.cumsum(lengths.fill_null(0).to_numpy())).astype(np.int32)
                # The values stay where they were unpacked: copies would add up in a worker's memory.
                buffers = [lengths.is_valid().buffers()[1], pa.py_buffer(ends), pa.py_buffer(plain)]
                made = dict(zip((n for n in names if n != column), rows.values.flatten(), strict=True))
                made[column] = pa.Array.from_buffers(pa.binary(), len(lengths), buffers)
                yield pa.RecordBatch.from_arrays([made[n] for n in names], names)

    if not then:
        return packed.mapInArrow(rows_of, schema)
    step, made_schema = then
    return packed.mapInArrow(lambda batches: step(rows_of(batches)), made_schema)
