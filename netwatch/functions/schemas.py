"""Row types shared by sources and operators."""

from __future__ import annotations

from pyspark.sql import types as T

PACKET = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("protocol", T.IntegerType()),
    T.StructField("packet_size", T.IntegerType()),
    T.StructField("ttl", T.IntegerType()),
    T.StructField("flags", T.IntegerType()),
    T.StructField("payload_size", T.IntegerType()),
    T.StructField("fragment_offset", T.IntegerType()),
    T.StructField("sequence_number", T.LongType()),
    T.StructField("ack_number", T.LongType()),
    T.StructField("window_size", T.IntegerType()),
    T.StructField("checksum", T.IntegerType()),
    T.StructField("sensor_id", T.StringType()),
])

# The wire form carries epoch seconds instead of a timestamp and has no sensor.
WIRE_PACKET = T.StructType(
    [T.StructField("timestamp", T.DoubleType())]
    + [f for f in PACKET.fields if f.name not in ("ts", "sensor_id")]
)

# Defaults of optional packet columns.
PACKET_DEFAULTS = {
    "payload_size": 0, "fragment_offset": 0, "sequence_number": 0, "ack_number": 0,
    "window_size": 65535, "checksum": 0, "sensor_id": "default",
}
