"""Decoding and encoding of messages as steps of a plan (see ``wire`` for the format).

Each is one pass over Arrow batches: all fields of a message are read at once, by its type.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ..plans.storage import importable
from . import wire
from .wire import ADD, BAD_LENGTH, BAD_TYPE, CANCEL, EXECUTE, OUT_OF_RANGE, REPLACE, SIZES, TRUNCATED

__all__ = ["ADD", "BAD_LENGTH", "BAD_TYPE", "CANCEL", "EXECUTE", "OUT_OF_RANGE", "REPLACE", "SIZES", "TRUNCATED", "decode", "encode", "encode_error"]

DECODED = T.StructType([T.StructField("decode_error", T.StringType()), T.StructField("msg_type", T.IntegerType()), *(T.StructField(name, from_arrow_type(kind)) for name, kind in wire.FIELDS.items())])


def decode(packets: DataFrame, raw: str = "raw") -> DataFrame:
    """The other columns, decode_error, msg_type and the fields (null where a type has none); bytes after a message are ignored.

    Lost packets (null) should be filtered out first; a null decodes as truncated.
    """
    importable(packets.sparkSession)
    others = [c for c in packets.columns if c != raw]
    schema = T.StructType([packets.schema[c] for c in others] + DECODED.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = wire.unpack(batch.column(raw))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *(read[c] for c in DECODED.names)], names=schema.names)

    return packets.select(*others, raw).mapInArrow(run, schema)


def encode(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds the wire form of each message; null where msg_type is none of the four."""
    importable(messages.sparkSession)
    schema = T.StructType([f for f in messages.schema.fields if f.name != raw] + [T.StructField(raw, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = wire.pack_columns({c: batch.column(c) for c in ("msg_type", *wire.FIELDS)})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), made], names=schema.names)

    return messages.mapInArrow(run, schema)


def encode_error(size: int, kind: int) -> str | None:
    """What the wire form of a message type would not fit: a buffer of so many bytes."""
    return "BufferTooSmall" if size < SIZES[kind] else None
