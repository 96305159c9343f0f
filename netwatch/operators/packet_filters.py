"""Packet predicates; all of them are plain filters that Catalyst pushes to the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ALL_TRAFFIC_TARGETS, UDP_SERVICE_PORTS


def parse_ports(value: str | Iterable[int]) -> list[int]:
    """Ports from a comma-separated text or an iterable; each must lie in 1..65535."""
    items = value.split(",") if isinstance(value, str) else value
    ports = [int(text) for text in (str(item).strip() for item in items) if text]
    for port in ports:
        if port not in range(1, 65536):
            raise ValueError(f"port out of range: {port}")
    return ports


def filter_target(packets: DataFrame, host: str, ports: str | Iterable[int] = ()) -> DataFrame:
    """Keep traffic of a protected host: TCP on the listed ports, UDP on listed service ports."""
    host, ports = host.strip(), parse_ports(ports)
    if host.lower() in ALL_TRAFFIC_TARGETS:
        return packets
    keep = (F.col("src_ip") == host) | (F.col("dst_ip") == host)

    def uses(numbers: list[int]) -> Column:
        return F.col("src_port").isin(numbers) | F.col("dst_port").isin(numbers)

    if ports:
        udp_ports = [p for p in ports if p in UDP_SERVICE_PORTS]
        wanted = (F.col("protocol") == 6) & uses(ports)
        if udp_ports:
            wanted = wanted | (F.col("protocol").isin(17, 53) & uses(udp_ports))
        keep = keep & wanted
    return packets.where(keep)


def drop_late(packets: DataFrame, as_of: Column | int, delay_seconds: int = 10) -> DataFrame:
    """Drop packets older than ``as_of`` by more than the delay; packets without a time stay."""
    limit = as_of - F.expr(f"INTERVAL {int(delay_seconds)} SECONDS")
    return packets.where(F.col("ts").isNull() | (F.col("ts") >= limit))
