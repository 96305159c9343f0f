"""Packet encodings of message values: JSON envelopes and fixed-width binary records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ips import ip_key
from ..functions.schemas import PACKET_DEFAULTS, WIRE_PACKET

# Envelope version and schema id, and the big-endian record layout.
SCHEMA_VERSION, SCHEMA_ID, MAGIC = 1, 1, 0xDD05
RECORD = np.dtype([
    ("magic", ">u2"), ("version", "u1"), ("schema_id", ">u4"),
    ("timestamp", ">f8"), ("src", ">u4"), ("dst", ">u4"), ("src_port", ">u2"), ("dst_port", ">u2"),
    ("protocol", "u1"), ("packet_size", ">u4"), ("ttl", "u1"), ("flags", ">u4"), ("payload_size", ">u4"),
    ("fragment_offset", ">u4"), ("sequence_number", ">u8"), ("ack_number", ">u8"),
    ("window_size", ">u4"), ("checksum", ">u4"),
])
_NUMBERS = [f.name for f in WIRE_PACKET.fields if not isinstance(f.dataType, T.StringType)]


def _wire(packets: DataFrame) -> DataFrame:
    seconds = F.unix_micros("ts") / 1_000_000
    return packets.select(*[
        seconds.alias("timestamp") if f.name == "timestamp"
        else F.coalesce(F.col(f.name), F.lit(PACKET_DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name)
        for f in WIRE_PACKET.fields])


def encode_json_packets(packets: DataFrame) -> DataFrame:
    """Packets as UTF-8 JSON envelopes in column ``value``, keyed by source address."""
    body = F.struct(*[F.col(f.name) for f in WIRE_PACKET.fields])
    return _wire(packets).select(F.col("src_ip").cast("binary").alias("key"), F.to_json(F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(SCHEMA_ID).alias("schema_id"),
        body.alias("data"))).cast("binary").alias("value"))


def decode_json_packets(messages: DataFrame) -> DataFrame:
    """Packet columns from JSON envelopes; unreadable values keep their text in ``_corrupt``."""
    envelope = T.StructType([T.StructField("data", WIRE_PACKET)])
    text = F.col("value").cast("string")
    rows = messages.withColumn("_e", F.from_json(text, envelope))
    return rows.select("_e.data.*", F.when(F.col("_e.data").isNull(), text).alias("_corrupt"))


def encode_binary_packets(packets: DataFrame) -> DataFrame:
    """Packets as 69-byte records in ``value``. The layout is IPv4-only: other rows get a null value
    and their addresses in ``_corrupt``."""
    rows = _wire(packets)

    def number(name: str):
        key = ip_key(F.col(name))
        return F.when(key.startswith("4"), F.conv(F.substring(key, 2, 8), 16, 10).cast("bigint"))

    rows = rows.withColumns({"src": number("src_ip"), "dst": number("dst_ip")})
    usable = F.col("src").isNotNull() & F.col("dst").isNotNull()
    rows = rows.select("src", "dst", *_NUMBERS, F.when(
        ~usable, F.concat_ws(" ", "src_ip", "dst_ip")).alias("_corrupt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            out = np.zeros(n, dtype=RECORD)
            out["magic"], out["version"], out["schema_id"] = MAGIC, SCHEMA_VERSION, SCHEMA_ID
            for name in ("src", "dst", *_NUMBERS):
                out[name] = batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.arange(0, (n + 1) * RECORD.itemsize, RECORD.itemsize, dtype=np.int32)
            good = batch.column("_corrupt").is_null()
            mask = np.packbits(good.to_numpy(zero_copy_only=False), bitorder="little")
            value = pa.Array.from_buffers(
                pa.binary(), n, [pa.py_buffer(mask), pa.py_buffer(offsets), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([value, batch.column("_corrupt")], ["value", "_corrupt"])

    return rows.mapInArrow(run, "value binary, _corrupt string")


def decode_binary_packets(messages: DataFrame) -> DataFrame:
    """Packet columns from binary records; wrong length or magic keeps the bytes in ``_corrupt``."""
    good = (F.octet_length("value") == RECORD.itemsize) & (
        F.hex(F.substring("value", 1, 2)) == f"{MAGIC:04X}")
    rows = messages.select(F.when(good, F.col("value")).alias("value"),
                           F.when(~F.coalesce(good, F.lit(False)), F.col("value")).alias("_corrupt"))
    fields = [f for f in WIRE_PACKET.fields if f.name not in ("src_ip", "dst_ip")]
    schema = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()),
                           *fields, T.StructField("_corrupt", T.BinaryType())])
    kinds = {"timestamp": np.float64, "src": np.int64, "dst": np.int64, "sequence_number": np.int64,
             "ack_number": np.int64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields[:-1]]
        for batch in batches:
            value = batch.column("value")
            missing = value.is_null().to_numpy(zero_copy_only=False)
            whole = np.frombuffer(b"".join(value.drop_null().to_pylist()), dtype=RECORD)
            records = np.zeros(batch.num_rows, dtype=RECORD)
            records[~missing] = whole
            columns = [pa.array(records[n].astype(kinds.get(n, np.int32)), mask=missing) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, batch.column("_corrupt").cast(pa.binary())], [*names, "_corrupt"])

    decoded = rows.mapInArrow(run, schema)

    def dotted(name: str):
        octets = [F.shiftright(F.col(name), s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
        return F.when(F.col(name).isNotNull(), F.concat_ws(".", *octets))

    return decoded.withColumns({"src_ip": dotted("src"), "dst_ip": dotted("dst")}).select(
        *[f.name for f in WIRE_PACKET.fields], "_corrupt")
