"""Packet sources: tables of packets and tab-separated field dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import FIELD_DUMP_COLUMNS, MAX_RECORDS_PER_TRIGGER, TOPICS
from ..functions.schemas import PACKET, PACKET_DEFAULTS, WIRE_PACKET


def to_packets(rows: DataFrame) -> DataFrame:
    """Bring rows to the packet schema: epoch seconds become ``ts``, missing columns get defaults."""
    have = set(rows.columns)
    out = []
    for field in PACKET.fields:
        if field.name == "ts" and "ts" not in have:
            col = F.timestamp_micros((F.col("timestamp") * 1_000_000).cast("long"))
        elif field.name in have:
            col = F.col(field.name)
        else:
            col = F.lit(None)
        if field.name in PACKET_DEFAULTS:
            col = F.coalesce(col, F.lit(PACKET_DEFAULTS[field.name]))
        out.append(col.cast(field.dataType).alias(field.name))
    return rows.select(*out)


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False,
                 **options) -> DataFrame:
    """Packets from parquet, ORC, JSON or CSV, batch or streaming. No schema inference pass."""
    reader = spark.readStream if streaming else spark.read
    if fmt in ("json", "csv"):
        wire = WIRE_PACKET.add("sensor_id", "string") if "sensor_id" not in WIRE_PACKET.names else WIRE_PACKET
        reader = reader.schema(wire)
        options.setdefault("header", "true") if fmt == "csv" else None
    elif streaming:
        reader = reader.schema(PACKET)
    if streaming:
        options.setdefault("maxFilesPerTrigger", 200)
    return to_packets(reader.options(**options).format(fmt).load(path))


def _int(text: Column) -> Column:
    """Decimal, hexadecimal or fractional number text as bigint; null where it is none of them."""
    t = F.trim(text)
    hexadecimal = F.conv(F.regexp_extract(t, "^0[xX]0*([0-9a-fA-F]{1,16})$", 1), 16, 10).try_cast("bigint")
    number = t.try_cast("double")
    # Most cells are decimal or empty. A text that is no number at all costs an exception in the cast to double.
    return F.when(t != "", F.coalesce(t.try_cast("bigint"), F.when(
        t.rlike("^0[xX][0-9a-fA-F]+$"), hexadecimal).otherwise(F.when(~F.isnan(number), number.cast("bigint")))))


_TEXT_CELLS = ("frame.time_epoch", "ip.src", "ip.dst", "ipv6.src", "ipv6.dst")


def parse_field_dump(lines: DataFrame, sensor_id: str = "default") -> DataFrame:
    """Packets from 23-column field dumps; lines without both addresses are dropped.

    Short lines are padded with empty fields; a line without tabs may be separated by backslashes.

    The cells of a line are read as numbers once, by one small expression over their array. Written out for each use, the
    expressions make a method that the JVM only interprets. A line is split below an explode, which the filter on
    addresses doesn't pass; it would split the line again for every address.
    """
    line = F.rtrim("value", F.lit("\r\n"))
    parts = F.when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(line, r"\\"))
    numbers = [n for n in FIELD_DUMP_COLUMNS if n not in _TEXT_CELLS]
    rows = lines.select(F.explode(F.array(parts)).alias("_p")).select("_p", F.transform(
        F.array(*[F.get("_p", F.lit(FIELD_DUMP_COLUMNS.index(n))) for n in numbers]), _int).alias("_n"))
    raw = {n: F.coalesce(F.get("_p", F.lit(i)), F.lit("")) for i, n in enumerate(FIELD_DUMP_COLUMNS)}

    def address(v4: str, v6: str) -> Column:
        return F.coalesce(F.nullif(F.trim(raw[v4]), F.lit("")), F.nullif(F.trim(raw[v6]), F.lit("")))

    def number(name: str, default: int = 0) -> Column:
        return F.coalesce(F.get("_n", F.lit(numbers.index(name))), F.lit(default).cast("bigint"))

    def first_nonzero(*names: str) -> Column:
        return F.coalesce(*[F.nullif(number(n), F.lit(0).cast("bigint")) for n in names],
                          F.lit(0).cast("bigint"))

    def above(value: Column, header: int) -> Column:
        return F.greatest(F.lit(0), value - header)

    rows = rows.select(
        "_p", "_n", address("ip.src", "ipv6.src").alias("src_ip"), address("ip.dst", "ipv6.dst").alias("dst_ip"),
        first_nonzero("ip.proto", "ipv6.nxt").alias("_proto"),
    ).where("src_ip IS NOT NULL AND dst_ip IS NOT NULL")
    proto = F.col("_proto")
    tcp, udp, icmp = proto == 6, proto == 17, proto == 1

    def by_protocol(for_tcp, for_udp, for_icmp, otherwise) -> Column:
        return (F.when(tcp, for_tcp).when(udp, for_udp).when(icmp, for_icmp).otherwise(otherwise))

    zero = F.lit(0).cast("bigint")
    size = number("frame.len")
    rows = rows.select(
        F.trim(raw["frame.time_epoch"]).try_cast("double").alias("timestamp"), "src_ip", "dst_ip", "_proto",
        by_protocol(number("tcp.srcport"), number("udp.srcport"), zero,
                    first_nonzero("tcp.srcport", "udp.srcport")).alias("src_port"),
        by_protocol(number("tcp.dstport"), number("udp.dstport"), zero,
                    first_nonzero("tcp.dstport", "udp.dstport")).alias("dst_port"),
        size.alias("packet_size"), first_nonzero("ip.ttl", "ipv6.hlim").alias("ttl"),
        by_protocol(number("tcp.flags"), zero, zero, number("tcp.flags")).alias("flags"),
        by_protocol(number("tcp.len"), above(number("udp.length"), 8), above(size, 28), above(size, 40))
        .alias("payload_size"),
        number("ip.frag_offset").alias("fragment_offset"),
        by_protocol(number("tcp.seq"), zero, zero, number("tcp.seq")).alias("sequence_number"),
        by_protocol(number("tcp.ack"), zero, zero, number("tcp.ack")).alias("ack_number"),
        by_protocol(number("tcp.window_size_value", 65535), zero, zero, number("tcp.window_size_value"))
        .alias("window_size"),
        F.lit(sensor_id).alias("sensor_id"))
    dns = (F.col("src_port") == 53) | (F.col("dst_port") == 53)
    return to_packets(rows.withColumn("protocol", F.when(dns, F.lit(53)).otherwise(F.col("_proto"))))


def ingest_field_dump(spark: SparkSession, path: str, streaming: bool = False,
                      sensor_id: str = "default") -> DataFrame:
    """A folder of field-dump text files as packets, batch or streaming."""
    reader = spark.readStream.option("maxFilesPerTrigger", 200) if streaming else spark.read
    return parse_field_dump(reader.text(path), sensor_id)


def packet_topic_source(spark: SparkSession, servers: str, topic: str = "raw-packets",
                        max_offsets: int = MAX_RECORDS_PER_TRIGGER, **options) -> DataFrame:
    """Streaming ``key, value`` rows of a topic (needs the Kafka connector on the class path)."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("maxOffsetsPerTrigger", max_offsets)
            .options(**options).load())


def file_topic_source(spark: SparkSession, path: str, max_files: int = 12) -> DataFrame:
    """The same ``key, value`` rows from a folder of parquet files, for sites without a broker."""
    return (spark.readStream.schema("key binary, value binary, partition int").option("maxFilesPerTrigger", max_files)
            .parquet(path).select("key", "value"))


def topic_sink(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Writer of ``key, value`` rows to a topic (needs the Kafka connector); call ``start()``."""
    return (df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint))


def file_topic_sink(df: DataFrame, path: str, topic: str, partitions: int | None = None) -> None:
    """``key, value`` rows as a folder per topic partition; a key stays in one. Each task adds a file of its own to the
    partitions that it has rows for, so a partition has no largest size and its rows meet in no task."""
    count = partitions or TOPICS[topic][0]
    (df.select("key", "value", F.pmod(F.hash("key"), F.lit(count)).alias("partition"))
     .write.mode("append").partitionBy("partition").parquet(f"{path}/{topic}"))
