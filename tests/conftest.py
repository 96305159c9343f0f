import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netwatch.session import build_session  # noqa: E402
from netwatch.streaming.dedup import use_rocksdb  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "tests", shuffle_partitions=4, **{"spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    use_rocksdb(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def packet(**over):
    """One ordinary ACK packet as a plain row."""
    row = {"timestamp": 1704067200.25, "src_ip": "10.0.1.50", "dst_ip": "10.0.1.100", "src_port": 45678,
           "dst_port": 80, "protocol": 6, "packet_size": 512, "ttl": 64, "flags": 16, "payload_size": 472,
           "fragment_offset": 0, "sequence_number": 1, "ack_number": 1, "window_size": 65535, "checksum": 0}
    return row | over


@pytest.fixture(scope="session")
def make_packets(spark):
    from netwatch.functions.schemas import WIRE_PACKET
    from netwatch.sources.packets import to_packets

    def make(rows):
        data = [tuple(r[f.name] for f in WIRE_PACKET.fields) for r in rows]
        return to_packets(spark.createDataFrame(data, WIRE_PACKET))
    return make
