import math
import random
from collections import Counter

import pytest
from conftest import packet

from netwatch.functions.constants import FEATURE_ORDER, MEASURES
from netwatch.operators import context as cx
from netwatch.operators import features as ft
from netwatch.operators import packet_filters as pf
from netwatch.streaming.features import stream_features
from netwatch.streaming.run import run_to_table


def test_identical_ack_packets(make_packets):
    row = ft.feature_vector(make_packets([packet()] * 100)).head()
    assert row.packet_count == 100 and row.tcp_ratio == 1 and row.ack_ratio == 1
    assert row.src_ip_entropy == 0 and row.unique_src_ips == 1 and row.std_packet_size == 0
    assert row.avg_payload_size == 472 and row.byte_count == 51200


def test_syn_flood(make_packets):
    rng = random.Random(1)
    rows = [packet(src_ip=f"10.{rng.randrange(9)}.{rng.randrange(99)}.{rng.randrange(99)}", packet_size=64,
                   payload_size=0, flags=2, window_size=1024) for _ in range(1000)]
    row = ft.feature_vector(make_packets(rows)).head()
    assert row.syn_ratio == 1 and row.zero_payload_ratio == 1 and row.small_window_ratio == 1
    assert row.src_ip_entropy > 5 and row.packet_rate == 1000


def test_empty_input_is_one_zero_row(make_packets):
    rows = ft.feature_vector(make_packets([]), window=None, keys=()).collect()
    assert len(rows) == 1 and all(rows[0][m] == 0 for m in MEASURES)


def test_entropy_values(make_packets):
    four = ft.feature_vector(make_packets([packet(src_ip=f"10.0.0.{i}") for i in range(4)])).head()
    one = ft.feature_vector(make_packets([packet()] * 4)).head()
    assert four.src_ip_entropy == pytest.approx(2.0) and one.src_ip_entropy == 0


def test_model_array_has_thirty_inputs(make_packets):
    row = ft.with_model_array(ft.feature_vector(make_packets([packet()]))).head()
    assert len(row.feature_array) == len(FEATURE_ORDER) == 30


def _random_packets(n, seconds, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = rng.choice([t for t in range(seconds) if t not in range(20, 30)])
        out.append(packet(
            timestamp=1704067200 + s + rng.random() * 0.9, src_ip=f"10.0.0.{rng.randrange(12)}",
            dst_ip=f"10.0.1.{rng.randrange(3)}", src_port=rng.choice([53, 1000, 2000, 3000]),
            protocol=rng.choice([6, 17, 1, 53]), packet_size=rng.randrange(40, 3000), flags=rng.choice([0, 2, 16, 18, 4, 1]),
            ttl=rng.choice([64, 128, 255]), window_size=rng.choice([0, 1024, 65535]), fragment_offset=rng.choice([0, 0, 8])))
    return out


def _entropy(values):
    n = len(values)
    return -sum(c / n * math.log2(c / n) for c in Counter(values).values())


@pytest.mark.parametrize("block", [3600, 40])
def test_sliding_windows_equal_naive(make_packets, block):
    """Also across block edges and through a silent gap."""
    rows = _random_packets(300, 60)
    got = {(r.window_name, r.window_end): r for r in ft.multi_window_features(
        make_packets(rows), {"1s": 1, "5s": 5, "10s": 10}, block=block).collect()}
    want = set()
    for name, size in (("1s", 1), ("5s", 5), ("10s", 10)):
        for end in range(1704067201, 1704067200 + 75):
            inside = [r for r in rows if end - size <= int(r["timestamp"]) < end]
            if not inside:
                continue
            want.add((name, end))
            g = got[name, end]
            assert g.packet_count == len(inside) and g.window_start == end - size
            assert g.unique_src_ips == len({r["src_ip"] for r in inside})
            assert g.unique_ip_pairs == len({(r["src_ip"], r["dst_ip"]) for r in inside})
            assert g.src_ip_entropy == pytest.approx(_entropy([r["src_ip"] for r in inside]), abs=1e-8)
            assert g.min_packet_size == min(r["packet_size"] for r in inside)
            assert g.packet_rate == pytest.approx(len(inside) / size)
            assert g.src_ip_entropy <= math.log2(g.unique_src_ips) + 1e-9
    assert set(got) == want


@pytest.mark.parametrize("window,slide", [(1, 1), (5, 1), (20, 5)])
def test_stream_equals_batch_on_closed_windows(spark, make_packets, tmp_path, window, slide):
    rows = _random_packets(200, 50, 5)
    packets = make_packets(rows)
    packets.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in"))
    run_to_table(stream_features(stream, window, slide), str(tmp_path / "out"))
    streamed = {(r.sensor_id, r.window_end): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    closed = max(r["timestamp"] for r in rows) - 10
    batch = [r for r in ft.feature_vector(packets, window, slide).collect() if r.window_end <= closed]
    assert len(batch) == len(streamed) > 5
    for r in batch:
        for m in MEASURES:
            assert streamed[r.sensor_id, r.window_end][m] == pytest.approx(r[m], abs=1e-9), m


def test_context_ranks_and_limits(make_packets):
    rows = [packet(src_ip=f"10.0.0.{i}") for i in range(30) for _ in range(i + 1)] + [packet(dst_port=0)] * 5
    row = cx.packet_context(make_packets(rows)).head()
    assert len(row.source_ips) == 20 and row.source_ips[0] == "10.0.0.29"
    assert row.target_ports == [80] and row.protocol == 6 and row.packet_sample_count == len(rows)


def test_target_filter(make_packets):
    rows = [packet(), packet(protocol=17, dst_port=53), packet(protocol=17, dst_port=80), packet(dst_ip="1.1.1.1")]
    packets = make_packets(rows)
    assert pf.filter_target(packets, "ANY").count() == 4
    assert pf.filter_target(packets, "10.0.1.100").count() == 3
    assert pf.filter_target(packets, "10.0.1.100", "80,53").count() == 2
    with pytest.raises(ValueError):
        pf.parse_ports("0")


def test_filters_reach_the_scan(spark, make_packets, tmp_path):
    make_packets([packet()]).write.parquet(str(tmp_path / "p"))
    df = pf.filter_target(spark.read.parquet(str(tmp_path / "p")), "10.0.1.100").select("ts")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(EqualTo(src_ip" in plan and "checksum" not in plan


def test_sliding_steps_in_portions(make_packets):
    """The changes of a value don't depend on where portions of rows end, and no change point is sorted."""
    import pyarrow as pa

    rows = sorted(({"sensor_id": s, "b": b, "_h": hash(v), "dim": d, "v": v, "p": p, "c": 1 + p % 3}
                   for s in ("s0", "s1") for b in (0, 1) for d in ("src_ip", "ttl") for v in ("x", "y", None)
                   for p in range(b * 40 - 9 * b, b * 40 + 40) if (p + len(s + d + str(v))) % 5),
                  key=lambda r: (r["sensor_id"], r["b"], r["_h"], r["dim"], str(r["v"]), r["p"]))
    table = pa.Table.from_pylist(rows)

    def run(portion, size):
        out = ft._steps(iter(table.to_batches(size)), 1, [5, 10], 40, ["src_ip", "ttl"], ["src_ip"], portion)
        return pa.Table.from_batches(out).to_pylist()

    whole = run(10_000, 10_000)
    assert len(whole) > 100 and whole == run(7, 3) == run(1, 50)
    for s, b, w in (("s0", 0, 5), ("s1", 1, 10)):
        distinct = 0
        steps = {r["t"]: r["u_ttl"] for r in whole if (r["sensor_id"], r["b"], r["w"]) == (s, b, w)}
        for t in range(b * 40, b * 40 + 40):
            distinct += steps.get(t, 0)
            assert distinct == len({r["v"] for r in rows if (r["sensor_id"], r["b"], r["dim"]) == (s, b, "ttl")
                                    and t - w < r["p"] <= t})
    assert "lag(" not in ft.multi_window_features(make_packets(_random_packets(20, 9)))._jdf.queryExecution().toString()
