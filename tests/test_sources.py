import bz2
import gzip
import hashlib
import io
import ipaddress
import json
import lzma
import zipfile

import pytest
from conftest import packet
from pyspark.sql import functions as F

from netwatch.functions.constants import AUDIT_HASH_COLUMNS, FIELD_DUMP_COLUMNS
from netwatch.functions.ips import in_networks, ip_key
from netwatch.operators import audit as au
from netwatch.operators import inventory as iv
from netwatch.operators import redact as rd
from netwatch.sources import archives as ar
from netwatch.sources import codecs as cd
from netwatch.sources import packets as pk
from netwatch.streaming.run import run_to_table


def dump(sep="\t", **cells):
    names = {c.replace(".", "_"): i for i, c in enumerate(FIELD_DUMP_COLUMNS)}
    row = [""] * len(FIELD_DUMP_COLUMNS)
    for name, value in ({"frame_time_epoch": "1704067200.5"} | cells).items():
        row[names[name]] = str(value)
    return sep.join(row)


def test_field_dump_cases(spark):
    v4 = {"ip_src": "10.0.0.1", "ip_dst": "10.0.0.2", "frame_len": 100, "ip_ttl": 64}
    lines = [
        dump(**v4, ip_proto=6, tcp_srcport=4000, tcp_dstport=80, tcp_flags="0x0002", tcp_seq=7, tcp_len=0),
        dump(**v4, ip_proto=17, udp_srcport=4000, udp_dstport=53, udp_length=48),
        dump(**v4, ip_proto=1, icmp_type=8),
        dump(ipv6_src="fd00::1", ipv6_dst="fd00::2", ipv6_nxt=6, ipv6_hlim=60, frame_len=90, tcp_srcport=1, tcp_dstport=2),
        dump("\\", **v4, ip_proto=6, tcp_srcport=5, tcp_dstport=6, tcp_window_size_value="0x10"),
        "\t".join(["1", "10.0.0.1", "10.0.0.2", "47", "140"]),
        dump(frame_len=60),
    ]
    rows = pk.parse_field_dump(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert len(rows) == 6
    tcp, dns, icmp, v6, legacy, gre = rows
    assert (tcp.flags, tcp.window_size, tcp.sequence_number) == (2, 65535, 7)
    assert (dns.protocol, dns.payload_size, dns.window_size) == (53, 40, 0)
    assert (icmp.src_port, icmp.payload_size) == (0, 72)
    assert (v6.src_ip, v6.ttl, v6.protocol) == ("fd00::1", 60, 6)
    assert (legacy.src_port, legacy.window_size) == (5, 16)
    assert (gre.protocol, gre.payload_size, gre.window_size) == (47, 100, 0)


def test_codecs_round_trip(make_packets, spark):
    packets = make_packets([packet(), packet(timestamp=1704067201.123456, src_port=65535, sequence_number=2 ** 40)])
    want = sorted(map(tuple, cd._wire(packets).collect()))
    for encode, decode in ((cd.encode_json_packets, cd.decode_json_packets),
                           (cd.encode_binary_packets, cd.decode_binary_packets)):
        got = decode(encode(packets).select("value"))
        assert sorted(tuple(r)[:-1] for r in got.collect()) == want
        assert got.where("_corrupt IS NOT NULL").count() == 0
    bad = spark.createDataFrame([(b"nonsense",)], "value binary")
    assert cd.decode_binary_packets(bad).head()._corrupt == b"nonsense"
    assert cd.decode_json_packets(bad).head()._corrupt == "nonsense"
    six = cd.encode_binary_packets(make_packets([packet(src_ip="fd00::1")])).head()
    assert six.value is None and "fd00::1" in six._corrupt


def test_ip_keys_agree_with_standard_library(spark):
    texts = ["10.0.0.1", "255.255.255.255", "256.1.1.1", "01.2.3.4", "1.2.3", "::1", "::", "fe80::1", "1:2:3:4:5:6:7:8",
             "1:2:3:4:5:6:7::", "::ffff:10.0.0.1", "1::2::3", "12345::", "FF02::FB", "1:2:3:4:5:6:7:8:9", "x", "", "224.1.2.3"]
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    nets = ["224.0.0.0/4", "ff00::/8", "::1", "10.0.0.0/8"]
    for r in df.select("ip", ip_key(F.col("ip")).alias("k"), in_networks(ip_key(F.col("ip")), nets).alias("hit")).collect():
        try:
            addr = ipaddress.ip_address(r.ip)
        except ValueError:
            assert r.k is None, r.ip
            continue
        width = 8 if addr.version == 4 else 32
        assert r.k == f"{addr.version}{int(addr):0{width}x}", r.ip
        assert r.hit == any(addr in ipaddress.ip_network(n) for n in nets if ipaddress.ip_network(n).version == addr.version)


CSV = "a, b ,Label\n1,x,BENIGN\n2,,Syn\n"


def test_labelled_files_in_every_packing(spark, tmp_path):
    def inner(name, data):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr(name, data)
        return buf.getvalue()

    (tmp_path / "p.csv").write_text(CSV)
    (tmp_path / "g.csv.gz").write_bytes(gzip.compress(CSV.encode()))
    (tmp_path / "b.csv.bz2").write_bytes(bz2.compress(CSV.encode()))
    (tmp_path / "x.csv.xz").write_bytes(lzma.compress(CSV.encode()))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/one.csv", CSV)
        z.writestr("readme.txt", "no")
        z.writestr("outer.zip", inner("in/two.csv.gz", gzip.compress(CSV.encode())))
    paths = [str(tmp_path / n) for n in ("p.csv", "g.csv.gz", "b.csv.bz2", "x.csv.xz", "z.zip")]
    df = ar.read_labelled_csv(spark, paths)
    assert df.columns == ["a", "b", "Label", "source"] and df.count() == 12
    assert {r.source for r in df.collect()} == {
        "p.csv", "g.csv.gz", "b.csv.bz2", "x.csv.xz", "d/one.csv", "outer.zip!in/two.csv.gz"}
    assert df.where("b IS NULL").count() == 6
    (tmp_path / "q.csv").write_text("a,c,Label\n1,2,3\n")
    with pytest.raises(ValueError):
        ar.read_labelled_csv(spark, [paths[0], str(tmp_path / "q.csv")])
    with pytest.raises(ValueError):
        ar.read_labelled_csv(spark, str(tmp_path / "f.txt"))


def audit_rows(n=6):
    out, previous = [], None
    for i in range(n):
        e = {"event_id": f"e{i}", "occurred_at": 1704067200.1 + i, "actor_user_id": None, "actor_role": "admin",
             "action": "login", "target_type": "user", "target_id": "ü", "reason": None, "outcome": "ok",
             "request_id": None, "details_json": '{"k":1}', "previous_hash": previous}
        previous = hashlib.sha256(json.dumps(e, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        out.append((i + 1, *[e[c] for c in AUDIT_HASH_COLUMNS], previous))
    return out


def test_audit_chain(spark):
    schema = "seq long, " + ", ".join(f"{c} {'double' if c == 'occurred_at' else 'string'}" for c in AUDIT_HASH_COLUMNS)
    schema += ", event_hash string"
    rows = audit_rows()
    assert au.verify_audit_chain(spark.createDataFrame(rows, schema)).count() == 0
    edited = [r if r[0] != 3 else (*r[:5], "logout", *r[6:]) for r in rows]
    assert [r.seq for r in au.verify_audit_chain(spark.createDataFrame(edited, schema)).collect()] == [3]
    removed = [r for r in rows if r[0] != 3]
    assert [r.seq for r in au.verify_audit_chain(spark.createDataFrame(removed, schema)).collect()] == [4]


def test_redaction(spark):
    df = spark.createDataFrame([("00:11", {"mac": "m", "x": "y"}, '{"a": [{"MAC": 1}]}')],
                               "bssid string, tags map<string,string>, details string")
    row = rd.redact(df, ["details"]).head()
    assert row.bssid == rd.MASK and row.tags == {"mac": rd.MASK, "x": "y"}
    assert json.loads(row.details) == {"a": [{"MAC": rd.MASK}]}
    assert rd.redact_for_role(df, "viewer").count() == 0 and rd.redact_for_role(df, "admin").head().bssid == "00:11"


def test_vendor_registry_and_usb_gadget(spark):
    lines = spark.createDataFrame([("001337 Hak5 LLC",), ("00-13-38   (hex)\t\tAcme",), ("001339     (base 16)\t\tNo",)],
                                  "value string")
    nets = spark.createDataFrame([("h", 1, "n", b) for b in ("00:13:37:aa:bb:cc", "00-13-38-00-00-00", "00:13:39:0:0:0", "zz")],
                                 "host_id string, scan_ts long, ssid string, bssid string")
    got = {r.bssid: r.vendor for r in iv.enrich_vendor(nets, iv.parse_vendor_registry(lines), ["001337"]).collect()}
    assert list(got.values()).count("Unknown") == 2 and got["00:13:37:aa:bb:cc"] == "Hak5 LLC"
    adapters = spark.createDataFrame([("h", 1, "Remote NDIS", "Ethernet 9", "RNDIS Gadget", "USB\\VID", "rndis")],
                                     "host_id string, scan_ts long, Name string, NetConnectionID string, Description string, "
                                     "PNPDeviceID string, ServiceName string")
    ips = spark.createDataFrame([("h", 1, "ethernet 9", "172.16.42.2")],
                                "host_id string, scan_ts long, InterfaceAlias string, ip_text string")
    row = iv.usb_gadget_findings(adapters, ips).head()
    assert (row.severity, row.confidence, row.adapter_name) == ("critical", 0.92, "Ethernet 9")
    assert iv.usb_gadget_findings(adapters, ips, ["gadget"]).count() == 0


def test_every_header_of_a_folder_is_checked(spark, tmp_path):
    folder = tmp_path / "days.csv"
    folder.mkdir()
    (folder / "a.csv").write_text(" x,y\n1,2\n")
    (folder / "b.csv").write_text(" x,y\n3,4\n")
    rows = ar.read_labelled_csv(spark, str(folder))
    assert {(r.x, r.y, r.source) for r in rows.collect()} == {("1", "2", "a.csv"), ("3", "4", "b.csv")}
    (folder / "c.csv").write_text("y, x\n6,5\n")
    with pytest.raises(Exception, match="(?i)header"):
        ar.read_labelled_csv(spark, str(folder)).collect()
    with pytest.raises(Exception, match="(?i)header"):
        ar.read_labelled_csv(spark, str(folder)).groupBy("y").count().collect()


def test_headers_of_archives_need_no_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("a.csv", "x,y\n" + "1,2\n" * 50)
        z.writestr("empty.csv", "")
    rows = ar.read_archives(spark, str(tmp_path / "d.zip"), 1).collect()
    assert [(r.source, r.row_no, list(r.cells)) for r in rows] == [("a.csv", 0, ["x", "y"])]
    assert ar.read_labelled_csv(spark, str(tmp_path / "d.zip")).count() == 50


def test_a_topic_partition_is_no_single_task(spark, tmp_path):
    """A key stays in one partition, however many rows it has; every task writes its own share, and all rows are streamed back."""
    rows = spark.range(0, 4000, 1, 5).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("k"), F.col("id") % 70)).otherwise("hot").cast("binary").alias("key"),
        F.col("id").cast("string").cast("binary").alias("value"))
    pk.file_topic_sink(rows, str(tmp_path), "raw-packets")
    kept = spark.read.parquet(str(tmp_path / "raw-packets")).withColumn("file", F.input_file_name())
    assert kept.groupBy("key").agg(F.count_distinct("partition").alias("n")).where("n > 1").count() == 0
    assert kept.where(F.col("key") == b"hot").select("file").distinct().count() == 5
    stream = pk.file_topic_source(spark, str(tmp_path / "raw-packets"))
    run_to_table(stream, str(tmp_path / "back"))
    got = spark.read.parquet(str(tmp_path / "back"))
    assert got.columns == ["key", "value"] and sorted(got.collect()) == sorted(rows.collect())


def test_table_is_spread_by_its_rows(spark, sf, monkeypatch):
    from netwatch.sources import testtables as tt
    whole = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(tt, "TASK_ROWS", whole // 10, raising=False)
    rows = tt.table(spark, sf, "lineitem")
    assert rows.rdd.getNumPartitions() >= 10 and rows.count() == whole
    assert tt.table(spark, sf, "nation").rdd.getNumPartitions() == 1


def test_field_dump_lines_are_split_once(spark):
    """The filter on addresses is not pushed below the splitting, and numbers are read by one expression."""
    plan = pk.parse_field_dump(spark.range(3).selectExpr("CAST(id AS STRING) AS value"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 2 and plan.count("RLIKE(") == 1


def test_field_dump_numbers_and_line_ends(spark):
    """Hexadecimal, fractional, padded, too large, infinite and no numbers; every kind of line end."""
    sizes = {"7": 7, " 0x1F ": 31, "12.9": 12, "1e3": 1000, "x": 0, "": 0, "nan": 0, "0xfffffffffffffffff": 0, "0x": 0}
    lines = [f"1704067200.5\t10.0.0.1\t10.0.0.2\t6\t60\t64\t1\t2\t0x0002\t{text}{end}" for text in sizes for end in ("", "\n", "\r\n")]
    rows = pk.parse_field_dump(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).collect()
    assert [r.sequence_number for r in rows] == [n for n in sizes.values() for _ in range(3)]
    assert {(r.src_ip, r.dst_ip, r.flags, r.window_size) for r in rows} == {("10.0.0.1", "10.0.0.2", 2, 65535)}
