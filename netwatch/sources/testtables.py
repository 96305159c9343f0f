"""Adapters that derive telemetry-shaped tables from the generated star-schema tables.

Each adapter is a plain projection of a whole table (integer arithmetic only), so the same
derivation can be written in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC
ORDERS_PER_SECOND = 300


# Tables large enough that computing on them should use every core.
_LARGE = ("lineitem", "orders", "events", "documents", "pages")


# Rows of a task: a table is spread into tasks of this size, and left as it is where no task reads more than twice as many.
TASK_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A generated table. A large one is spread once if fewer tasks than there are cores would read it (one row group is
    one task), or if a task would read too many rows: the number of tasks grows with the rows. Else it is read as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in _LARGE:
        return df
    tasks = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)), F.max("n"), F.sum("n")).first()  # from the files' footers
    used, most, rows = (x or 0 for x in tasks)
    cores = spark.sparkContext.defaultParallelism
    if used >= cores and most <= 2 * TASK_ROWS:
        return df
    return df.repartition(max(cores, -(-rows // TASK_ROWS)))


def packets_from(lineitem: DataFrame) -> DataFrame:
    """One packet per line item: about 1,200 packets per second, in eight repeating phases
    (0-3 normal, 4 SYN, 5 UDP, 6 DNS, 7 ICMP)."""
    base = lineitem.selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
        "CAST(l_quantity AS INT) AS q",
        f"l_orderkey DIV {ORDERS_PER_SECOND} AS sec",
        f"CAST((l_orderkey DIV {ORDERS_PER_SECOND}) * 3 % 8 AS INT) AS ph",
    )
    return base.selectExpr(
        f"timestamp_micros(({EPOCH} + sec) * 1000000 + l_partkey % 1000 * 1000) AS ts",
        "concat('10.0.', CAST(l_suppkey % IF(ph >= 4, 50, 4) AS STRING), '.', "
        "CAST(l_partkey % 20 AS STRING)) AS src_ip",
        "concat('10.0.1.', CAST(100 + l_suppkey % 5 AS STRING)) AS dst_ip",
        "CAST(IF(ph = 6 AND l_linenumber <= 3, 53, 1024 + l_partkey % 60000) AS INT) AS src_port",
        "CASE WHEN ph = 7 THEN 0 WHEN l_linenumber = 3 AND ph < 4 THEN 53 "
        "WHEN l_linenumber = 2 THEN 443 ELSE 80 END AS dst_port",
        "CASE WHEN ph IN (5, 6) THEN 17 WHEN ph = 7 THEN 1 WHEN l_linenumber = 3 AND ph < 4 THEN 17 "
        "WHEN l_linenumber = 7 THEN 1 ELSE 6 END AS protocol",
        "CASE ph WHEN 4 THEN 64 WHEN 5 THEN 1400 + q WHEN 6 THEN 3000 + 20 * q ELSE 40 + 10 * q END "
        "AS packet_size",
        "IF(l_partkey % 3 = 0, 128, 64) AS ttl",
        "CASE WHEN ph >= 5 THEN 0 WHEN ph = 4 THEN 2 WHEN l_returnflag = 'R' THEN 2 "
        "WHEN l_returnflag = 'A' THEN 16 ELSE 18 END AS flags",
        "CASE ph WHEN 4 THEN 0 WHEN 6 THEN 2960 ELSE 10 * q END AS payload_size",
        "IF(l_partkey % 50 = 0, 8, 0) AS fragment_offset",
        "CAST(l_orderkey * 10 AS BIGINT) AS sequence_number",
        "CAST(l_partkey AS BIGINT) AS ack_number",
        "IF(ph = 4, 1024, 8192 * (1 + l_linenumber % 7)) AS window_size",
        "0 AS checksum",
        "IF(l_linenumber = 7, 's1', 's0') AS sensor_id",
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from(table(spark, sf_dir, "lineitem"))


# Derived measures of one feature row; every threshold used by a rule is straddled.
FEATURE_COLUMNS = {
    "packet_count": "(l_partkey * 37 + l_orderkey) % 60000",
    "byte_count": "(l_partkey * 7919 + l_orderkey * 13) % 30000000",
    "packet_rate": "CAST((l_partkey * 37 + l_orderkey) % 60000 AS DOUBLE)",
    "byte_rate": "CAST((l_partkey * 7919 + l_orderkey * 13) % 30000000 AS DOUBLE)",
    "tcp_ratio": "CAST(l_partkey % 101 AS DOUBLE) / 100",
    "udp_ratio": "CAST((l_partkey + 3 * l_suppkey) % 101 AS DOUBLE) / 100",
    "icmp_ratio": "CAST(l_suppkey % 51 AS DOUBLE) / 100",
    "dns_ratio": "CAST(l_orderkey % 41 AS DOUBLE) / 100",
    "syn_ratio": "CAST(3 * l_orderkey % 101 AS DOUBLE) / 100",
    "syn_ack_ratio": "CAST((l_orderkey + l_linenumber) % 31 AS DOUBLE) / 100",
    "ack_ratio": "CAST(7 * l_partkey % 101 AS DOUBLE) / 100",
    "rst_ratio": "CAST(l_orderkey % 61 AS DOUBLE) / 100",
    "fin_ratio": "CAST(l_partkey % 23 AS DOUBLE) / 100",
    "syn_to_ack_ratio": "CAST(11 * l_orderkey % 200 AS DOUBLE) / 10",
    "src_ip_entropy": "CAST(l_partkey % 110 AS DOUBLE) / 10",
    "dst_ip_entropy": "CAST((l_partkey + l_suppkey) % 70 AS DOUBLE) / 10",
    "src_port_entropy": "CAST((l_orderkey + l_partkey) % 130 AS DOUBLE) / 10",
    "dst_port_entropy": "CAST((l_orderkey + l_suppkey) % 80 AS DOUBLE) / 10",
    "avg_packet_size": "CAST((5 * l_orderkey + l_linenumber) % 4000 AS DOUBLE)",
    "std_packet_size": "CAST((l_orderkey + 3 * l_partkey) % 300 AS DOUBLE)",
    "min_packet_size": "40 + l_suppkey % 30",
    "max_packet_size": "1000 + l_suppkey % 500",
    "unique_src_ips": "(17 * l_suppkey + l_linenumber) % 600",
    "unique_dst_ips": "(l_suppkey + l_linenumber) % 12",
    "unique_src_ports": "(13 * l_partkey + l_linenumber) % 900",
    "unique_dst_ports": "(l_partkey + l_linenumber) % 40",
    "unique_ip_pairs": "(19 * l_suppkey + l_linenumber) % 900",
    "avg_ttl": "CAST(50 + l_partkey % 78 AS DOUBLE)",
    "ttl_diversity": "1 + (l_partkey + l_linenumber) % 6",
    "avg_payload_size": "CAST(7 * l_orderkey % 3900 AS DOUBLE)",
    "zero_payload_ratio": "CAST(3 * l_partkey % 101 AS DOUBLE) / 100",
    "avg_window_size": "CAST(1000 + 31 * l_partkey % 64000 AS DOUBLE)",
    "small_window_ratio": "CAST((l_partkey + l_orderkey) % 67 AS DOUBLE) / 100",
    "fragmentation_ratio": "CAST(l_suppkey % 17 AS DOUBLE) / 100",
    "dns_response_ratio": "CAST(l_partkey % 37 AS DOUBLE) / 100",
    "large_packet_ratio": "CAST((l_orderkey + 2 * l_partkey) % 101 AS DOUBLE) / 100",
}
FEATURE_KEYS = {
    "sensor_id": "concat('s', CAST(l_suppkey % 20 AS STRING))",
    "sec": f"CAST({EPOCH} + l_orderkey AS BIGINT)",
    "row_id": "l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey % 100 * 10 + l_linenumber",
}
_INTEGER_MEASURES = {"packet_count", "byte_count", "min_packet_size", "max_packet_size",
                     "unique_src_ips", "unique_dst_ips", "unique_src_ports", "unique_dst_ports",
                     "unique_ip_pairs", "ttl_diversity"}


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature vector per line item, keyed by (sensor_id, sec, row_id)."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        *[f"{sql} AS {name}" for name, sql in FEATURE_KEYS.items()],
        *[f"CAST({sql} AS BIGINT) AS {name}" if name in _INTEGER_MEASURES else f"{sql} AS {name}"
          for name, sql in FEATURE_COLUMNS.items()],
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_from(table(spark, sf_dir, "events"))


def alerts_from(events: DataFrame) -> DataFrame:
    """One detection-like alert per event."""
    return events.selectExpr(
        "CAST(event_id AS STRING) AS alert_id",
        "event_id",
        "unix_seconds(CAST(ts AS TIMESTAMP)) AS t",
        "CAST(ts AS TIMESTAMP) AS ts",
        "concat('s', CAST(user_id % 3 AS STRING)) AS sensor_id",
        "CASE event_type WHEN 'click' THEN 'syn_flood' WHEN 'view' THEN 'udp_flood' "
        "WHEN 'purchase' THEN 'dns_amplification' WHEN 'error' THEN 'http_flood' ELSE 'unknown' END "
        "AS attack_type",
        "CASE WHEN value >= 200 THEN 'emergency' WHEN value >= 100 THEN 'critical' "
        "WHEN value >= 40 THEN 'warning' ELSE 'info' END AS severity",
        "least(value / 250, 1.0D) AS anomaly_score",
        "CAST(event_id % 100 AS DOUBLE) / 100 AS confidence",
        "value * 100 AS packet_rate",
        "value * 70000 AS byte_rate",
        "true AS is_anomaly",
        "transform(sequence(0, CAST(user_id % 7 AS INT)), "
        "i -> concat('10.1.', CAST(user_id % 50 AS STRING), '.', CAST(i AS STRING))) AS source_ips",
        "CASE WHEN event_id % 3 = 0 THEN array('ML_Ensemble', 'Sensor') "
        "WHEN event_id % 3 = 1 THEN array('sensor') ELSE array('local_threat_guard') END "
        "AS detection_sources",
        "user_id", "value",
    )


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator actions on alerts: some acknowledged, some resolved, some both, some twice."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "unix_seconds(CAST(ts AS TIMESTAMP)) AS t")
    return e.select(
        F.col("event_id").cast("string").alias("alert_id"), "user_id",
        F.explode(F.expr(
            "filter(array("
            "  named_struct('action', 'acknowledge', 't', t + event_id % 400, 'on', event_id % 2 = 0),"
            "  named_struct('action', 'acknowledge', 't', t + 600, 'on', event_id % 6 = 0),"
            "  named_struct('action', 'resolve', 't', t + event_id % 900, 'on', event_id % 5 = 0)"
            "), a -> a.on)")).alias("a"),
    ).selectExpr("alert_id", "a.action AS action", "a.t AS t",
                 "concat('u', CAST(user_id AS STRING)) AS user")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples: the event type is the metric name."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(ts AS TIMESTAMP) AS ts", "unix_seconds(CAST(ts AS TIMESTAMP)) AS sec",
        "event_id AS sample_id", "event_type AS metric", "value",
        "concat('s', CAST(user_id % 3 AS STRING)) AS sensor_id")


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearby access points seen by each scanning host, one observation per customer."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).selectExpr(
        "c_custkey", "concat('h', CAST(c_custkey % 10 AS STRING)) AS host_id",
        "CAST(c_custkey % 4 AS BIGINT) AS scan_ts",
        "concat(c_mktsegment, IF(c_custkey % 11 = 0, ' Free WiFi', '')) AS ssid",
        "concat('00:13:', CAST(30 + c_custkey % 40 % 9 AS STRING), ':aa:bb:', "
        "CAST(c_custkey % 40 + 10 AS STRING)) AS bssid",
        "CASE c_nationkey % 3 WHEN 0 THEN 'Open' WHEN 1 THEN 'WPA2-Personal' ELSE 'WPA3' END "
        "AS authentication",
        "CASE c_custkey % 3 WHEN 0 THEN 'CCMP' WHEN 1 THEN 'None' ELSE 'GCMP' END AS encryption",
        "CAST(c_acctbal AS INT) % 100 AS signal")


def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network each supplier's host is joined to, one row per host and scan."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('h', CAST(s_suppkey % 10 AS STRING)) AS host_id",
        "CAST(s_suppkey % 4 AS BIGINT) AS scan_ts",
        "CASE s_nationkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'AUTOMOBILE' "
        "WHEN 3 THEN 'HOUSEHOLD' ELSE '' END AS ssid",
        "IF(s_suppkey % 2 = 0, "
        "concat('00-13-', CAST(30 + s_suppkey % 40 % 9 AS STRING), '-AA-BB-', CAST(s_suppkey % 40 + 10 AS STRING)), "
        "concat('00:13:', CAST(30 + s_suppkey % 40 % 9 AS STRING), ':aa:BB:', CAST(s_suppkey % 40 + 10 AS STRING))) "
        "AS bssid",
        "CASE s_suppkey % 3 WHEN 0 THEN 'Open' WHEN 1 THEN 'WPA2-Personal' ELSE '' END "
        "AS authentication",
        "'CCMP' AS cipher")


def adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network adapters, one per part."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS adapter_no", "concat('h', CAST(p_partkey % 50 AS STRING)) AS host_id",
        "CAST(p_partkey % 4 AS BIGINT) AS scan_ts",
        "p_name AS Name",
        "IF(p_partkey % 7 = 0, NULL, concat('Ethernet ', CAST(p_partkey AS STRING))) AS NetConnectionID",
        "CASE p_size % 6 WHEN 0 THEN 'Remote NDIS Gadget' WHEN 1 THEN 'USB Ethernet' "
        "WHEN 2 THEN 'Wireless USB Network' WHEN 3 THEN 'Intel Wi-Fi' WHEN 4 THEN 'Trusted RNDIS dock' "
        "ELSE 'PCI controller' END AS Description",
        "IF(p_partkey % 2 = 0, concat('USB\\\\VID_', CAST(p_partkey AS STRING)), "
        "concat('PCI\\\\VEN_', CAST(p_partkey AS STRING))) AS PNPDeviceID",
        "p_type AS ServiceName")


def ip_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('h', CAST(p_partkey % 50 AS STRING)) AS host_id",
        "CAST(p_partkey % 4 AS BIGINT) AS scan_ts",
        "concat('ETHERNET ', CAST(p_partkey AS STRING)) AS InterfaceAlias",
        "concat('{\"IPv4\":\"172.16.', CAST(40 + p_partkey % 8 AS STRING), '.2\"}') AS ip_text",
    )


def trusted_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted names with their known access points, from the customer table."""
    return table(spark, sf_dir, "customer").where(
        "c_mktsegment IN ('BUILDING', 'MACHINERY')").selectExpr(
        "c_mktsegment AS ssid",
        "IF(c_mktsegment = 'BUILDING', concat('00:13:', CAST(30 + c_custkey % 20 % 9 AS STRING), ':AA:bb:', "
        "CAST(c_custkey % 20 + 10 AS STRING)), NULL) AS bssid").distinct()


def vendor_registry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry text in both line formats, one line per nation, with headers in between."""
    return table(spark, sf_dir, "nation").selectExpr(
        "CASE n_nationkey % 3 WHEN 0 THEN concat('0013', CAST(30 + n_nationkey AS STRING), ' ', n_name, ' Corp ') "
        "WHEN 1 THEN concat('00-13-', CAST(30 + n_nationkey AS STRING), '   (hex)\t\t', n_name) "
        "ELSE concat('0013', CAST(30 + n_nationkey AS STRING), '     (base 16)\t\t', n_name) END AS value")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectivity-probe results, one per page fetched."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", "concat('h', CAST(page_id % 20 AS STRING)) AS host_id",
        "CAST(page_id % 4 AS BIGINT) AS scan_ts",
        "CASE page_id % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'Cafe' ELSE 'MACHINERY' END AS ssid",
        "concat('00-13-37-aa-bb-', CAST(page_id % 40 + 10 AS STRING)) AS bssid",
        "CASE WHEN page_id % 5 = 0 THEN 302 ELSE 200 END AS status",
        "IF(page_id % 2 = 0, 'http://probe.example/test.txt/', url) AS final_url",
        "html AS body")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled flow table as text columns, the way a CSV reader delivers it."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey % 100 * 10 + l_linenumber AS row_id",
        "CAST(l_orderkey AS STRING) AS `Flow ID`",
        "CAST(CAST(l_quantity AS INT) AS STRING) AS `Total Packets`",
        "IF(l_partkey % 20 = 0, '', CAST(l_partkey AS STRING)) AS `Flow Duration`",
        "IF(l_suppkey % 4 = 0, 'n/a', CAST(l_suppkey AS STRING)) AS `Flow Code`",
        "l_linestatus AS `Status`",
        "IF(l_partkey % 4 = 0, 'tcp', CAST(l_linenumber AS STRING)) AS `Service`",
        "CAST(l_linenumber AS STRING) AS `Hop Count`",
        "concat('x', CAST(l_partkey AS STRING)) AS `Endpoint`",
        "CAST(NULL AS STRING) AS `Empty`",
        "CASE l_returnflag WHEN 'N' THEN ' BENIGN' WHEN 'A' THEN 'Syn ' WHEN 'R' THEN 'DrDoS_DNS' END "
        "AS `Label`")
