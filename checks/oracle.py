"""The same results as plain SQL over the given tables (DuckDB dialect)."""

from __future__ import annotations

from netwatch.functions.constants import MEASURES
from netwatch.sources.testtables import EPOCH, FEATURE_COLUMNS, FEATURE_KEYS, ORDERS_PER_SECOND

SQL: dict[str, str] = {}

PACKETS = f"""
base AS (
  SELECT *, CAST(l_quantity AS INTEGER) AS q, l_orderkey // {ORDERS_PER_SECOND} AS sec0,
         (l_orderkey // {ORDERS_PER_SECOND}) * 3 % 8 AS ph FROM lineitem),
packets AS (
  SELECT {EPOCH} + sec0 AS sec,
    ({EPOCH} + sec0) * 1000000 + l_partkey % 1000 * 1000 AS us,
    '10.0.' || CAST(l_suppkey % (CASE WHEN ph >= 4 THEN 50 ELSE 4 END) AS VARCHAR) || '.'
      || CAST(l_partkey % 20 AS VARCHAR) AS src_ip,
    '10.0.1.' || CAST(100 + l_suppkey % 5 AS VARCHAR) AS dst_ip,
    CASE WHEN ph = 6 AND l_linenumber <= 3 THEN 53 ELSE 1024 + l_partkey % 60000 END AS src_port,
    CASE WHEN ph = 7 THEN 0 WHEN l_linenumber = 3 AND ph < 4 THEN 53 WHEN l_linenumber = 2 THEN 443
      ELSE 80 END AS dst_port,
    CASE WHEN ph IN (5, 6) THEN 17 WHEN ph = 7 THEN 1 WHEN l_linenumber = 3 AND ph < 4 THEN 17
      WHEN l_linenumber = 7 THEN 1 ELSE 6 END AS protocol,
    CASE ph WHEN 4 THEN 64 WHEN 5 THEN 1400 + q WHEN 6 THEN 3000 + 20 * q ELSE 40 + 10 * q END
      AS packet_size,
    CASE WHEN l_partkey % 3 = 0 THEN 128 ELSE 64 END AS ttl,
    CASE WHEN ph >= 5 THEN 0 WHEN ph = 4 THEN 2 WHEN l_returnflag = 'R' THEN 2
      WHEN l_returnflag = 'A' THEN 16 ELSE 18 END AS flags,
    CASE ph WHEN 4 THEN 0 WHEN 6 THEN 2960 ELSE 10 * q END AS payload_size,
    CASE WHEN l_partkey % 50 = 0 THEN 8 ELSE 0 END AS fragment_offset,
    l_orderkey * 10 AS sequence_number, l_partkey AS ack_number,
    CASE WHEN ph = 4 THEN 1024 ELSE 8192 * (1 + l_linenumber % 7) END AS window_size,
    CASE WHEN l_linenumber = 7 THEN 's1' ELSE 's0' END AS sensor_id
  FROM base)
"""


def measures(group: str, source: str, seconds: str, digits: int = 6) -> str:
    """All measures straight from packet rows, with DuckDB's own distinct and entropy."""
    return f"""
SELECT {group}, count(*) AS packet_count, CAST(sum(packet_size) AS BIGINT) AS byte_count,
  round(count(*) / {seconds}, {digits}) AS packet_rate, round(sum(packet_size) / {seconds}, {digits}) AS byte_rate,
  round(count(*) FILTER (protocol = 6) / count(*), {digits}) AS tcp_ratio,
  round(count(*) FILTER (protocol = 17) / count(*), {digits}) AS udp_ratio,
  round(count(*) FILTER (protocol IN (1, 58)) / count(*), {digits}) AS icmp_ratio,
  round(count(*) FILTER (protocol = 53 OR src_port = 53 OR dst_port = 53) / count(*), {digits}) AS dns_ratio,
  round(count(*) FILTER (flags & 2 <> 0 AND flags & 16 = 0)
    / greatest(count(*) FILTER (protocol = 6), 1), {digits}) AS syn_ratio,
  round(count(*) FILTER (flags = 18) / greatest(count(*) FILTER (protocol = 6), 1), {digits}) AS syn_ack_ratio,
  round(count(*) FILTER (flags & 16 <> 0 AND flags & 2 = 0)
    / greatest(count(*) FILTER (protocol = 6), 1), {digits}) AS ack_ratio,
  round(count(*) FILTER (flags & 4 <> 0) / greatest(count(*) FILTER (protocol = 6), 1), {digits}) AS rst_ratio,
  round(count(*) FILTER (flags & 1 <> 0) / greatest(count(*) FILTER (protocol = 6), 1), {digits}) AS fin_ratio,
  round(count(*) FILTER (flags & 2 <> 0 AND flags & 16 = 0)
    / greatest(count(*) FILTER (flags & 16 <> 0 AND flags & 2 = 0), 1), {digits}) AS syn_to_ack_ratio,
  round(entropy(src_ip), {digits}) AS src_ip_entropy, round(entropy(dst_ip), {digits}) AS dst_ip_entropy,
  round(entropy(src_port), {digits}) AS src_port_entropy, round(entropy(dst_port), {digits}) AS dst_port_entropy,
  round(avg(packet_size), {digits}) AS avg_packet_size, round(stddev_pop(packet_size), {digits}) AS std_packet_size,
  CAST(min(packet_size) AS BIGINT) AS min_packet_size,
  CAST(max(packet_size) AS BIGINT) AS max_packet_size,
  count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips,
  count(DISTINCT src_port) AS unique_src_ports, count(DISTINCT dst_port) AS unique_dst_ports,
  count(DISTINCT (src_ip, dst_ip)) AS unique_ip_pairs,
  round(avg(ttl), {digits}) AS avg_ttl, count(DISTINCT ttl) AS ttl_diversity,
  round(avg(payload_size), {digits}) AS avg_payload_size,
  round(count(*) FILTER (payload_size = 0) / count(*), {digits}) AS zero_payload_ratio,
  round(avg(window_size), {digits}) AS avg_window_size,
  round(count(*) FILTER (window_size < 4096) / count(*), {digits}) AS small_window_ratio,
  round(count(*) FILTER (fragment_offset > 0) / count(*), {digits}) AS fragmentation_ratio,
  round(count(*) FILTER (src_port = 53)
    / greatest(count(*) FILTER (protocol = 53 OR src_port = 53 OR dst_port = 53), 1), {digits})
    AS dns_response_ratio,
  round(count(*) FILTER (packet_size > 1400) / count(*), {digits}) AS large_packet_ratio
FROM {source} GROUP BY {group}"""


VECTORS = f"""
{PACKETS}, vectors AS ({measures('sensor_id, window_start', '(SELECT *, sec AS window_start FROM packets)', '1.0')})
"""
# The same with practically unrounded measures, for results computed from them.
FINE_VECTORS = f"""
{PACKETS}, vectors AS ({measures('sensor_id, window_start', '(SELECT *, sec AS window_start FROM packets)', '1.0', 12)})
"""

from .queries import FEATURE_GROUPS  # noqa: E402  (names of the column groups only)

for _name, _cols in FEATURE_GROUPS.items():
    SQL[_name] = f"WITH {VECTORS} SELECT sensor_id, window_start, {', '.join(_cols)} FROM vectors"

SQL["multi_window_features"] = f"""
WITH {PACKETS}, sizes(window_name, w) AS (VALUES ('1s', 1), ('5s', 5), ('60s', 60)),
spread AS (
  SELECT p.*, window_name, w, unnest(generate_series(sec + 1, sec + w)) AS window_end
  FROM packets p, sizes),
r AS ({measures('sensor_id, window_name, w, window_end', 'spread', 'w')})
SELECT * EXCLUDE (w), window_end - w AS window_start FROM r"""


# --- rules over feature rows --------------------------------------------------------------------

_INT = {"packet_count", "byte_count", "min_packet_size", "max_packet_size", "unique_src_ips",
        "unique_dst_ips", "unique_src_ports", "unique_dst_ports", "unique_ip_pairs", "ttl_diversity"}
FROWS = "f AS (SELECT " + ", ".join(
    [f"{sql.replace('STRING', 'VARCHAR')} AS {n}" for n, sql in FEATURE_KEYS.items()]
    + [f"CAST({sql} AS BIGINT) AS {n}" if n in _INT else f"{sql} AS {n}"
       for n, sql in FEATURE_COLUMNS.items()]) + " FROM lineitem)"


def frule(**cols: str) -> str:
    return (f"WITH {FROWS} SELECT sensor_id, sec, row_id, "
            + ", ".join(f"{sql} AS {name}" for name, sql in cols.items()) + " FROM f")


def best(*rules: tuple[str, str]) -> str:
    return "round(greatest(0.0::DOUBLE, " + ", ".join(
        f"CASE WHEN {c} THEN least(1.0::DOUBLE, {s}) ELSE 0.0 END" for c, s in rules) + "), 9)"


def flags(*rules: tuple[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in rules) + ")"


FINGERPRINT = """CASE
  WHEN syn_ratio > 0.25 AND zero_payload_ratio > 0.3 AND unique_src_ips > 30 THEN 'syn_flood'
  WHEN dns_ratio > 0.12 AND avg_packet_size > 600 THEN 'dns_amplification'
  WHEN udp_ratio > 0.35 AND packet_rate > 6000 THEN 'udp_flood'
  WHEN tcp_ratio > 0.7 AND unique_src_ips > 60 AND src_ip_entropy > 4.5 THEN 'http_flood'
  WHEN avg_packet_size < 80 AND avg_payload_size < 30 AND tcp_ratio > 0.7 THEN 'slowloris'
  WHEN icmp_ratio > 0.15 AND packet_rate > 5000 THEN 'icmp_flood' ELSE 'unknown' END"""

SQL["fingerprint"] = frule(fingerprint=FINGERPRINT)
SQL["detect_volumetric"] = frule(
    volumetric_score=best(("packet_rate > 20000", "packet_rate / 60000"),
                          ("byte_rate > 10000000", "byte_rate / 30000000")),
    volumetric_sub_type="CASE WHEN packet_rate <= 20000 THEN 'none' WHEN syn_ratio > 0.4 THEN 'syn_flood' "
    "WHEN udp_ratio > 0.5 THEN 'udp_flood' WHEN icmp_ratio > 0.3 THEN 'icmp_flood' "
    "ELSE 'volumetric_generic' END")
SQL["detect_protocol"] = frule(
    protocol_score=best(("syn_to_ack_ratio > 3", "syn_to_ack_ratio / 10"),
                        ("rst_ratio > 0.3", "rst_ratio / 0.5"),
                        ("fragmentation_ratio > 0.1", "fragmentation_ratio / 0.3")),
    protocol_indicators=flags(("syn_to_ack_ratio > 3", "incomplete_handshakes"),
                              ("rst_ratio > 0.3", "high_rst_ratio"),
                              ("fragmentation_ratio > 0.1", "fragment_attack")))
_DNS = ("CASE WHEN dns_ratio > 0.2 AND avg_packet_size > 1000 "
        "THEN least(1.0::DOUBLE, dns_ratio * avg_packet_size / 2000) ELSE 0.0::DOUBLE END")
_NTP = ("CASE WHEN udp_ratio > 0.4 AND large_packet_ratio > 0.3 "
        "THEN least(1.0::DOUBLE, udp_ratio * large_packet_ratio * 3) ELSE 0.0::DOUBLE END")
SQL["detect_amplification"] = frule(
    amplification_score=f"round(greatest({_DNS}, {_NTP}), 9)",
    amplification_sub_type=f"CASE WHEN {_NTP} > {_DNS} THEN 'ntp_amplification' "
    f"WHEN {_DNS} > 0 THEN 'dns_amplification' ELSE 'none' END",
    amplification_indicators=flags(
        ("dns_ratio > 0.2 AND avg_packet_size > 1000", "large_dns_responses"),
        (f"{_NTP} > {_DNS}", "large_ntp_responses")))
_A = ("tcp_ratio > 0.8 AND unique_src_ips > 100 AND packet_rate > 5000",
      "avg_packet_size > 200 AND avg_packet_size < 800 AND packet_rate > 10000")
SQL["detect_application"] = frule(
    application_score=best((_A[0], "(unique_src_ips / 500) * (packet_rate / 20000)"),
                           (_A[1], "packet_rate / 30000")),
    application_indicators=flags((_A[0], "http_flood"), (_A[1], "get_flood")))
_S = ("avg_payload_size < 50 AND unique_src_ips > 30 AND avg_packet_size < 100",
      "packet_rate < 500 AND unique_src_ips > 50 AND avg_payload_size < 20")
SQL["detect_slowloris"] = frule(
    slowloris_score=best((_S[0], "unique_src_ips / 100"), (_S[1], "unique_src_ips / 150")),
    slowloris_indicators=flags((_S[0], "slow_partial_requests"), (_S[1], "slow_read_attack")))
_B = ("unique_src_ips > 50 AND ttl_diversity < 3 AND std_packet_size < 50",
      "small_window_ratio > 0.3 AND unique_src_ips > 30")
SQL["detect_botnet"] = frule(
    botnet_score=best((_B[0], "unique_src_ips / 200"),
                      (_B[1], "small_window_ratio * unique_src_ips / 100")),
    botnet_indicators=flags((_B[0], "coordinated_botnet"), (_B[1], "resource_exhaustion_botnet")))
_G = "src_ip_entropy > 7 AND unique_src_ips > 200"
SQL["detect_geo"] = frule(geo_score=best((_G, "src_ip_entropy / 10")),
                          geo_indicators=flags((_G, "geo_distributed_attack")))
_Z = {"src_ip_entropy": "abs(src_ip_entropy - 4) > 2", "dst_ip_entropy": "abs(dst_ip_entropy - 2.5) > 2",
      "src_port_entropy": "abs(src_port_entropy - 8) > 3",
      "dst_port_entropy": "abs(dst_port_entropy - 3.5) > 2"}
_ZN = "(" + " + ".join(f"CAST({c} AS INTEGER)" for c in _Z.values()) + ")"
_ZP = "greatest(tcp_ratio, udp_ratio, icmp_ratio, dns_ratio) > 0.85"
SQL["detect_zero_day"] = frule(
    zero_day_score=f"round(greatest(CASE WHEN {_ZN} >= 2 THEN {_ZN} / 4 ELSE 0.0 END, "
    f"CASE WHEN {_ZP} THEN 0.3::DOUBLE ELSE 0.0 END), 9)",
    zero_day_indicators=flags((f"{_ZN} >= 2", "multi_feature_deviation"), (_ZP, "protocol_concentration")),
    zero_day_features=flags(*[(c, n) for n, c in _Z.items()]))

from netwatch.functions.constants import (  # noqa: E402  (fixed values)
    EXPERT_DEFAULT, EXPERT_TABLE, MODEL_FEATURES, RESPONSE_ACTIONS, SHAPING_TABLE, TOP_FEATURE_SCALE,
    WEIGHTED_RULES)

_ZARR = "[" + ", ".join(f"abs(({n} - {m}::DOUBLE) / {s}::DOUBLE)" for n, m, s, _ in MODEL_FEATURES) + "]"
SQL["heuristic_if"] = frule(isolation_forest_score=(
    f"round(1 / (1 + exp(-2.5 * (0.6 * list_avg({_ZARR}) + 0.4 * list_max({_ZARR}) - 1.6))), 9)"))
SQL["heuristic_ae"] = f"""
WITH {FROWS}, z AS (SELECT sensor_id, sec, row_id, unnest({_ZARR}) AS z FROM f),
r AS (SELECT *, pow(z, 1.5) AS e,
        row_number() OVER (PARTITION BY row_id ORDER BY z DESC) AS rn FROM z)
SELECT sensor_id, sec, row_id, round(1 / (1 + exp(-3.0 * (
  0.5 * coalesce(sum(e / rn) FILTER (rn <= 10), 0) / 5 + 0.5 * avg(e) / 3 - 1))), 9) AS autoencoder_score
FROM r GROUP BY ALL"""
_RF = " + ".join(f"CASE WHEN {c.replace('D AND', ' AND').rstrip('D')} THEN {w}::DOUBLE ELSE 0.0::DOUBLE END"
                 for w, c in WEIGHTED_RULES)
SQL["heuristic_rf"] = frule(gradient_boosting_score=(
    f"round(1 / (1 + exp(-8.0 * (({_RF}) / {sum(w for w, _ in WEIGHTED_RULES)!r}::DOUBLE - 0.28))), 9)"))

_EXPLAIN = " UNION ALL ".join(
    f"SELECT row_id, {i} AS pos, '{n}' AS name, '{d}' AS description, CAST({n} AS DOUBLE) AS value, "
    f"{m}::DOUBLE AS baseline_value, "
    f"abs(({n} - {m}::DOUBLE) / {m}::DOUBLE) AS contribution, "
    f"CASE WHEN {n} > {m} THEN 'high' ELSE 'low' END AS direction FROM f"
    for i, (n, m, _, d) in enumerate(MODEL_FEATURES))
_RANKED = (f"WITH {FROWS}, e AS ({_EXPLAIN}), r AS (SELECT *, "
           "row_number() OVER (PARTITION BY row_id ORDER BY contribution DESC, pos) AS rank FROM e)")
SQL["explain_features"] = (
    f"{_RANKED} SELECT row_id, rank, name, round(value, 6) AS value, "
    "round(baseline_value, 6) AS baseline_value, round(contribution, 6) AS contribution, direction FROM r")
SQL["explain_summary"] = f"""
{_RANKED}, t AS (SELECT row_id, {FINGERPRINT} AS kind FROM f), l AS (
  SELECT row_id, string_agg('  • ' || description || ': ' || printf('%.2f', value) || ' (' || direction
    || ', ' || printf('%.0f', abs(value - baseline_value) / baseline_value * 100)
    || '% from baseline ' || printf('%.2f', baseline_value) || ')', chr(10) ORDER BY rank) AS lines
  FROM r WHERE rank <= 3 GROUP BY row_id)
SELECT t.row_id, 'Attack Type: ' || CASE kind WHEN 'syn_flood' THEN 'Syn Flood'
  WHEN 'dns_amplification' THEN 'Dns Amplification' WHEN 'udp_flood' THEN 'Udp Flood'
  WHEN 'http_flood' THEN 'Http Flood' WHEN 'slowloris' THEN 'Slowloris'
  WHEN 'icmp_flood' THEN 'Icmp Flood' ELSE 'Unknown' END || chr(10) || 'Key Contributing Factors:'
  || chr(10) || lines AS summary
FROM t JOIN l USING (row_id)"""
_TOP = " UNION ALL ".join(
    f"SELECT row_id, {i} AS pos, '{n}' AS name, "
    f"CAST(printf('%.2f', abs({n} - {m}::DOUBLE) / {s}::DOUBLE) AS DOUBLE) AS z FROM f"
    for i, (n, m, s) in enumerate(TOP_FEATURE_SCALE))
SQL["top_features"] = f"""
WITH {FROWS}, e AS ({_TOP}),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY z DESC, pos) AS rank FROM e)
SELECT row_id, string_agg(name || '=' || printf('%.2f', z), ' ' ORDER BY rank) AS top_features
FROM r WHERE rank <= 6 GROUP BY row_id"""

SCORED = f"""{FROWS}, s AS (
  SELECT *, (row_id % 97) / 97 AS a, (row_id % 89) / 89 AS b, (row_id % 83) / 83 AS c FROM f),
sk AS (SELECT *, CAST(a >= 0.45 AS INTEGER) + CAST(b >= 0.45 AS INTEGER) + CAST(c >= 0.45 AS INTEGER) AS k
       FROM s)"""


def ladder(score: str) -> str:
    return (f"CASE WHEN {score} >= 0.88::DOUBLE - k * 0.02::DOUBLE THEN 'emergency' "
            f"WHEN {score} >= 0.72::DOUBLE - k * 0.02::DOUBLE THEN 'critical' "
            f"WHEN {score} >= 0.45 THEN 'warning' ELSE 'info' END")


def conf(score: str) -> str:
    return (f"round(least(1, greatest(0.05, 0.4 * (1 - least(greatest(a, b, c) - least(a, b, c), 1)) "
            f"+ least(0.3, 0.5 * abs({score} - 0.45)) + k / 3 * 0.3)), 6)")


SQL["severity_ladder"] = (f"WITH {SCORED} SELECT row_id, CAST(k AS BIGINT) AS k, {ladder('b')} AS severity "
                          "FROM sk")
SQL["confidence"] = f"WITH {SCORED} SELECT row_id, {conf('b')} AS confidence FROM sk"
SQL["temporal_smoothing"] = f"""
WITH {SCORED} SELECT row_id, round(c, 6) AS autoencoder_score, round(CASE WHEN c > 0.4 AND coalesce(
  lag(c) OVER (PARTITION BY sensor_id ORDER BY sec, row_id), 0) > 0.4
  THEN least(1, c + 0.02) ELSE c END, 6) AS smoothed_score FROM sk"""

DETECTED = f"""{SCORED}, v0 AS (
  SELECT *, {FINGERPRINT} AS fingerprint,
    a * 0.3::DOUBLE + b * 0.4::DOUBLE + c * 0.3::DOUBLE AS s0 FROM sk),
v1 AS (SELECT *, CASE WHEN k = 3 AND s0 > 0.3 THEN least(1, s0 + 0.05) WHEN k = 1 AND s0 > 0.35 THEN s0 * 0.8
         WHEN k = 0 THEN s0 * 0.5 ELSE s0 END AS s1,
         k >= 2 AND fingerprint <> 'unknown' AS lifted FROM v0),
v2 AS (SELECT *, lag(s1 > 0.4 OR lifted, 1, false) OVER (PARTITION BY sensor_id ORDER BY sec, row_id) AS hot
       FROM v1),
v3 AS (SELECT *, CASE WHEN hot AND s1 > 0.4 THEN least(1, s1 + 0.02) ELSE s1 END AS s2 FROM v2),
det0 AS (SELECT *, CASE WHEN lifted THEN greatest(s2, 0.5) ELSE s2 END AS score FROM v3),
det AS (SELECT *, score >= 0.45 AS is_anomaly,
         CASE WHEN score < 0.45 THEN 'none' ELSE fingerprint END AS attack_type,
         {ladder('score')} AS severity FROM det0)"""
SQL["ensemble_vote"] = f"""
WITH {DETECTED} SELECT row_id, fingerprint, CAST(k AS BIGINT) AS models_agreeing,
  round(score, 6) AS anomaly_score, is_anomaly, attack_type, severity, {conf('score')} AS confidence
FROM det"""

_MANY = "(unique_src_ips >= 20 OR src_ip_entropy >= 4)"
_GATES = [
    ("syn_flood", f"packet_rate >= 1000 AND syn_ratio >= 0.35 AND syn_to_ack_ratio >= 3 "
     f"AND zero_payload_ratio >= 0.3 AND {_MANY}",
     "packet_rate:0 syn_ratio:2 syn_to_ack_ratio:2 unique_src_ips:0"),
    ("udp_flood", "udp_ratio >= 0.6 AND (packet_rate >= 2000 OR byte_rate >= 10000000) "
     f"AND (large_packet_ratio >= 0.3 OR packet_rate >= 5000) AND {_MANY}",
     "packet_rate:0 byte_rate:0 udp_ratio:2 unique_src_ips:0"),
    ("dns_amplification", "dns_ratio >= 0.2 AND large_packet_ratio >= 0.3 AND avg_packet_size >= 800 "
     "AND (packet_rate >= 300 OR byte_rate >= 1000000) AND unique_src_ips >= 10",
     "dns_ratio:2 large_packet_ratio:2 avg_packet_size:0 unique_src_ips:0"),
    ("icmp_flood", f"icmp_ratio >= 0.3 AND packet_rate >= 1000 AND {_MANY}",
     "packet_rate:0 icmp_ratio:2 unique_src_ips:0"),
    ("http_flood", "tcp_ratio >= 0.7 AND ack_ratio >= 0.5 AND (packet_rate >= 2000 OR byte_rate >= 8000000) "
     "AND unique_src_ips >= 50 AND src_ip_entropy >= 4",
     "packet_rate:0 tcp_ratio:2 ack_ratio:2 unique_src_ips:0"),
    ("slowloris", "packet_rate >= 50 AND packet_rate <= 2000 AND tcp_ratio >= 0.7 AND avg_packet_size <= 120 "
     "AND avg_payload_size <= 40 AND (unique_src_ips >= 20 OR unique_src_ports >= 100)",
     "packet_rate:0 avg_packet_size:0 avg_payload_size:0 unique_src_ports:0"),
]


def _quoted(spec: str) -> str:
    return "concat_ws('|', " + ", ".join(
        f"'{n}=' || printf('%.{d}f', CAST({n} AS DOUBLE))"
        for n, d in (x.split(":") for x in spec.split())) + ")"


_HIGH = ("(packet_rate >= 8000 OR byte_rate >= 25000000) AND (unique_src_ips >= 25 OR src_ip_entropy >= 4.5)",
         "packet_rate:0 byte_rate:0 unique_src_ips:0 src_ip_entropy:2")
_REASON = ("CASE WHEN NOT is_anomaly THEN 'model_not_anomalous' "
           "WHEN packet_rate < 50 AND byte_rate < 1000000 THEN 'low_sample_volume' "
           + " ".join(f"WHEN attack_type IN ('{n}', 'unknown') AND {c} THEN '{n}_evidence'"
                      for n, c, _ in _GATES)
           + f" WHEN {_HIGH[0]} THEN 'high_volume_multisource_evidence' "
           "ELSE 'no_operational_ddos_evidence' END")
GATED = f"""{DETECTED}, g0 AS (SELECT *, {_REASON} AS reason FROM det),
g AS (SELECT *, reason LIKE '%\\_evidence' ESCAPE '\\' AND reason <> 'no_operational_ddos_evidence' AS allowed,
  CASE reason {' '.join(f"WHEN '{n}_evidence' THEN {_quoted(q)}" for n, _, q in _GATES)}
    WHEN 'high_volume_multisource_evidence' THEN {_quoted(_HIGH[1])} ELSE '' END AS evidence FROM g0)"""
SQL["live_gate"] = f"WITH {GATED} SELECT row_id, allowed, reason, evidence FROM g"
SQL["apply_suppression"] = f"""
WITH {GATED} SELECT row_id, is_anomaly AND allowed AS is_anomaly,
  round(CASE WHEN is_anomaly AND NOT allowed THEN least(score, 0.44) ELSE score END, 6) AS anomaly_score,
  round(CASE WHEN is_anomaly AND NOT allowed THEN score END, 6) AS raw_anomaly_score,
  CASE WHEN is_anomaly AND NOT allowed THEN 'none' ELSE attack_type END AS attack_type,
  CASE WHEN is_anomaly AND NOT allowed THEN 'info' ELSE severity END AS severity,
  CASE WHEN is_anomaly THEN NOT allowed END AS suppressed,
  CASE WHEN is_anomaly AND NOT allowed THEN reason END AS suppression_reason,
  CASE WHEN is_anomaly AND allowed THEN reason END AS gate_reason,
  CASE WHEN is_anomaly THEN evidence END AS gate_evidence FROM g"""


def _case(key: str, table: dict, default: str, at: int | None = None) -> str:
    return f"CASE {key} " + " ".join(
        f"WHEN '{k}' THEN '{v if at is None else v[at]}'" for k, v in table.items()) + f" ELSE {default} END"


_EX = ["mitre_id", "osi_layer", "expert_description", "mitigation"]
SQL["expert_lookup"] = (
    f"WITH {FROWS}, t AS (SELECT row_id, {FINGERPRINT} AS fingerprint FROM f) SELECT row_id, fingerprint, "
    + ", ".join(_case("fingerprint", EXPERT_TABLE, f"'{EXPERT_DEFAULT[i]}'", i) + f" AS {n}"
                for i, n in enumerate(_EX)) + " FROM t")

ALERTS = """alerts AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS alert_id, CAST(floor(epoch(ts)) AS BIGINT) AS t,
    epoch_us(ts) AS us, user_id, value, 's' || CAST(user_id % 3 AS VARCHAR) AS sensor_id,
    CASE event_type WHEN 'click' THEN 'syn_flood' WHEN 'view' THEN 'udp_flood'
      WHEN 'purchase' THEN 'dns_amplification' WHEN 'error' THEN 'http_flood' ELSE 'unknown' END AS attack_type,
    CASE WHEN value >= 200 THEN 'emergency' WHEN value >= 100 THEN 'critical' WHEN value >= 40 THEN 'warning'
      ELSE 'info' END AS severity,
    least(value / 250, 1) AS anomaly_score, (event_id % 100) / 100 AS confidence,
    value * 100 AS packet_rate, value * 70000 AS byte_rate,
    CASE event_id % 3 WHEN 0 THEN 'ml_ensemble|sensor' WHEN 1 THEN 'sensor' ELSE 'local_threat_guard' END
      AS sources,
    list_transform(generate_series(0, user_id % 7),
      lambda i : '10.1.' || CAST(user_id % 50 AS VARCHAR) || '.' || CAST(i AS VARCHAR)) AS source_ips
  FROM events)"""
SQL["shaping_recommendation"] = (
    f"WITH {ALERTS} SELECT event_id, attack_type, "
    + ", ".join(_case("attack_type", SHAPING_TABLE, d, i) + f" AS {n}" for i, (n, d) in enumerate(
        [("shaping_action", "'monitor'"), ("rate_limit", "'none'"), ("block_duration", "NULL")]))
    + " FROM alerts")
SQL["classify_alert"] = f"""WITH {ALERTS} SELECT event_id, CASE
  WHEN anomaly_score >= 0.9 OR packet_rate >= 50000 THEN 'emergency'
  WHEN anomaly_score >= 0.75 OR packet_rate >= 30000 THEN 'critical'
  WHEN anomaly_score >= 0.6 OR packet_rate >= 15000 THEN 'warning' ELSE 'info' END AS tier FROM alerts"""
SQL["response_actions_for"] = (
    f"WITH {ALERTS} SELECT event_id, "
    + _case("severity", {k: "|".join(v) for k, v in RESPONSE_ACTIONS.items()}, "'log_event'")
    + " AS actions FROM alerts")


# --- packets: predicates, context ----------------------------------------------------------------

SQL["packet_flags"] = f"""WITH {PACKETS} SELECT sequence_number, ack_number, src_ip, CAST(dst_port AS BIGINT) AS dst_port,
  sensor_id, protocol = 6 AS is_tcp, protocol = 17 AS is_udp, protocol IN (1, 58) AS is_icmp,
  protocol = 53 OR src_port = 53 OR dst_port = 53 AS is_dns, flags & 2 <> 0 AND flags & 16 = 0 AS is_syn,
  flags = 18 AS is_syn_ack, flags & 16 <> 0 AND flags & 2 = 0 AS is_ack, flags & 4 <> 0 AS is_rst,
  flags & 1 <> 0 AS is_fin, payload_size = 0 AS is_zero_payload, window_size < 4096 AS is_small_window,
  fragment_offset > 0 AS is_fragment, packet_size > 1400 AS is_large FROM packets"""
SQL["filter_target"] = f"""WITH {PACKETS} SELECT sequence_number, ack_number, src_ip,
  CAST(dst_port AS BIGINT) AS dst_port, dst_ip, CAST(src_port AS BIGINT) AS src_port,
  CAST(protocol AS BIGINT) AS protocol FROM packets
WHERE '10.0.1.102' IN (src_ip, dst_ip) AND (
  (protocol = 6 AND (src_port IN (53, 443) OR dst_port IN (53, 443)))
  OR (protocol IN (17, 53) AND 53 IN (src_port, dst_port)))"""
SQL["drop_late"] = f"""WITH {PACKETS} SELECT sequence_number, ack_number, src_ip,
  CAST(dst_port AS BIGINT) AS dst_port, us FROM packets WHERE us >= 1704067210000000"""


def _ctx(dim: str, limit: int, alias: str, where: str = "true") -> str:
    return f"""{alias} AS (SELECT sensor_id, sec,
    string_agg(CAST(v AS VARCHAR), '|' ORDER BY rn) AS l,
    string_agg(CAST(v AS VARCHAR) || '=' || CAST(c AS VARCHAR), ' ' ORDER BY rn) AS m, min_by(v, rn) AS top
  FROM (SELECT sensor_id, sec, {dim} AS v, count(*) AS c, row_number() OVER (
      PARTITION BY sensor_id, sec ORDER BY count(*) DESC, {dim}) AS rn FROM packets GROUP BY sensor_id, sec, {dim})
  WHERE rn <= {limit} AND {where} GROUP BY sensor_id, sec)"""


ENDPOINTS = f"""{_ctx('src_ip', 20, 'ca')}, {_ctx('dst_ip', 20, 'cb')},
{_ctx('src_port', 20, 'cc', 'v > 0')}, {_ctx('dst_port', 20, 'cd', 'v > 0')}, {_ctx('protocol', 10, 'ce')},
cs AS (SELECT sensor_id, sec, count(*) AS packet_sample_count, min(us) AS first_seen, max(us) AS last_seen
  FROM packets GROUP BY ALL),
ctx AS (SELECT cs.sensor_id, cs.sec AS window_start, packet_sample_count, first_seen, last_seen,
  coalesce(ca.l, '') AS source_ips, coalesce(cb.l, '') AS target_ips, coalesce(cc.l, '') AS source_ports,
  coalesce(cd.l, '') AS target_ports, CAST(ce.top AS BIGINT) AS protocol,
  coalesce(ca.m, '') AS source_ip_counts, coalesce(cb.m, '') AS target_ip_counts,
  coalesce(cd.m, '') AS target_port_counts, coalesce(ce.m, '') AS protocol_counts
FROM cs LEFT JOIN ca USING (sensor_id, sec) LEFT JOIN cb USING (sensor_id, sec)
  LEFT JOIN cc USING (sensor_id, sec) LEFT JOIN cd USING (sensor_id, sec) LEFT JOIN ce USING (sensor_id, sec))"""
SQL["packet_context"] = f"WITH {PACKETS}, {ENDPOINTS} SELECT * FROM ctx"


def heuristics(source: str) -> str:
    """CTEs h(..., a, b, c): the three fallback scores of ``source``, which has a unique ``row_id``."""
    return f"""
hz AS (SELECT row_id, unnest({_ZARR}) AS z FROM {source}),
hr AS (SELECT row_id, z, pow(z, 1.5) AS e, row_number() OVER (PARTITION BY row_id ORDER BY z DESC) AS rn FROM hz),
hs AS (SELECT row_id, 1 / (1 + exp(-2.5 * (0.6 * avg(z) + 0.4 * max(z) - 1.6))) AS a,
  1 / (1 + exp(-3.0 * (0.5 * sum(e / rn) FILTER (rn <= 10) / 5 + 0.5 * avg(e) / 3 - 1))) AS c
  FROM hr GROUP BY row_id),
s AS (SELECT t.*, a, 1 / (1 + exp(-8.0 * (({_RF}) / {sum(w for w, _ in WEIGHTED_RULES)!r}::DOUBLE - 0.28))) AS b, c
  FROM {source} t JOIN hs USING (row_id)),
sk AS (SELECT *, CAST(a >= 0.45 AS INTEGER) + CAST(b >= 0.45 AS INTEGER) + CAST(c >= 0.45 AS INTEGER) AS k FROM s)"""


_VOTE = DETECTED[len(SCORED):]
WINDOW_DETECTED = f"""{FINE_VECTORS}, wv AS (SELECT *, sensor_id || '@' || CAST(window_start AS VARCHAR) AS row_id,
  window_start AS sec FROM vectors), {heuristics('wv')} {_VOTE}"""
SQL["detections_with_context"] = f"""
WITH {WINDOW_DETECTED}, {ENDPOINTS}
SELECT d.sensor_id, d.window_start, packet_rate, packet_sample_count, protocol, source_ips, attack_type,
  round(score, 6) AS anomaly_score
FROM det d JOIN ctx c ON d.sensor_id = c.sensor_id AND d.window_start = c.window_start"""

# --- metric samples ------------------------------------------------------------------------------

METRICS = """m AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS sec, epoch_us(ts) AS us, event_id AS sample_id,
  event_type AS metric, value, 's' || CAST(user_id % 3 AS VARCHAR) AS sensor_id FROM events)"""


def _baseline(value: str, length: int, digits: int = 4) -> str:
    """Deviations are taken about the frame's own mean, so that the check doesn't lose what it checks."""
    return f"""WITH {METRICS}, b AS (SELECT sample_id, metric, sec, {value} AS v FROM m), c AS (SELECT *, avg(v) OVER (PARTITION BY
  metric) AS level FROM b) SELECT sample_id, metric, round(level + avg(v - level) OVER w + 0.033 / 1e{digits}, {digits}) AS mean,
  round(stddev_pop(v - level) OVER w + 0.033 / 1e{digits}, {digits}) AS std, min(v) OVER e AS min, max(v) OVER e AS max, count(*) OVER e AS count FROM c
WINDOW w AS (PARTITION BY metric ORDER BY sec, sample_id ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW),
  e AS (PARTITION BY metric ORDER BY sec, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


SQL["rolling_baseline"] = _baseline("value", 86400)
SQL["rolling_baseline_high_level"] = _baseline("1e9 + round(value)", 1000, 2)
SQL["rolling_baseline_small_spread"] = _baseline("2.5e6 + sample_id % 5", 1000)
SQL["baseline_anomaly"] = f"""WITH {METRICS}, r AS (SELECT *, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sd,
  row_number() OVER (PARTITION BY metric ORDER BY sec, sample_id) - 1 AS n FROM m
WINDOW w AS (PARTITION BY metric ORDER BY sec, sample_id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))
SELECT sample_id, metric, n AS prior_count,
  CASE WHEN sd > 0 THEN round((value - mu) / sd, 6) ELSE 0 END AS z_score,
  CASE WHEN n < 10 THEN false WHEN sd = 0 THEN value <> mu ELSE abs(value - mu) / sd > 3 END AS is_anomalous FROM r"""


def _profile(keys: str, length: int) -> str:
    return f"""SELECT {keys}, round(min(value), 4) AS min, round(max(value), 4) AS max, count(*) AS count,
  round(avg(value) FILTER (rn <= {length}), 4) AS mean, round(stddev_pop(value) FILTER (rn <= {length}), 4) AS std
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY sec DESC, sample_id DESC) AS rn FROM h) GROUP BY {keys}"""


SQL["baseline_snapshot"] = f"WITH {METRICS}, h AS (SELECT * FROM m) {_profile('metric', 1000)}"
SQL["hourly_profile"] = (f"WITH {METRICS}, h AS (SELECT *, sec // 3600 % 24 AS hour FROM m) "
                         f"{_profile('metric, hour', 50)}")
ENTRIES = f"""{METRICS}, en AS (SELECT *, CASE WHEN sample_id % 2 = 0 THEN 'window_' ELSE 'ip_' END || metric || '_'
  || sensor_id AS key FROM m)"""
SQL["latest_features"] = f"""WITH {ENTRIES}, r AS (SELECT *, row_number() OVER (
  PARTITION BY key ORDER BY sec DESC, sample_id DESC) AS rn FROM en WHERE key LIKE 'window%')
SELECT key, sec, sample_id, value FROM r WHERE rn = 1 AND 1706659200 - sec <= 7200"""
SQL["feature_history"] = f"""WITH {ENTRIES}, r AS (SELECT *, row_number() OVER (
  PARTITION BY key ORDER BY sec DESC, sample_id DESC) AS rn FROM en)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY sec, sample_id) AS position, sec, sample_id, value
FROM r WHERE rn <= 60"""
SQL["traffic_history"] = f"""WITH {METRICS} SELECT sec, sample_id, metric, value FROM m
ORDER BY sec DESC, sample_id DESC LIMIT 120"""
_TRAIL = """OVER (PARTITION BY metric ORDER BY sec RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)"""
SQL["avg_over_5m"] = f"""WITH {METRICS} SELECT DISTINCT metric, sec, round(avg(value) {_TRAIL}, 6) AS avg_value FROM m"""
SQL["max_over_5m"] = f"""WITH {METRICS} SELECT DISTINCT metric, sec, max(value) {_TRAIL} AS max_value FROM m"""
SQL["latency_p95_5m"] = f"""WITH {METRICS} SELECT metric, sec - sec % 300 AS window_start,
  round(quantile_cont(value, 0.95), 6) AS percentile, count(*) AS samples FROM m GROUP BY ALL"""
SQL["latency_p95_trailing"] = f"""WITH {METRICS} SELECT DISTINCT metric, sec,
  round(quantile_cont(value, 0.95) {_TRAIL}, 6) AS percentile, count(value) {_TRAIL} AS samples FROM m"""
SQL["latency_p95_hourly_sliding"] = f"""WITH {METRICS}, x AS (SELECT *, unnest(generate_series(
  sec - sec % 600 - 3000, sec - sec % 600, 600)) AS window_start FROM m)
SELECT metric, window_start, round(quantile_cont(value, 0.95), 6) AS percentile, count(*) AS samples
FROM x GROUP BY ALL"""


def _islands(source: str, keys: str, cond: str, hold: int) -> str:
    return f"""SELECT {keys}, min(sec) AS start_sec, max(sec) AS end_sec, count(*) AS samples,
  min(sec) FILTER (sec - s0 >= {hold}) AS fired_at
FROM (SELECT *, min(sec) OVER (PARTITION BY {keys}, grp) AS s0 FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY sec, sample_id)
    - row_number() OVER (PARTITION BY {keys}, {cond} ORDER BY sec, sample_id) AS grp, {cond} AS on_ FROM {source})
  WHERE on_) GROUP BY {keys}, grp"""


SQL["sustained_alert"] = f"WITH {METRICS} {_islands('m', 'metric', 'value > 20', 3600)}"
_RULES = [("HighPacketRate", "packet_rate", 50000, 30, "warning"),
          ("HighAnomalyScore", f"1 / (1 + exp(-8.0 * (({_RF}) / 1.0 - 0.28)))", 0.8, 15, "critical"),
          ("DetectionLatencyHigh", "avg_packet_size", 200, 60, "warning")]
SQL["sustained_rules"] = f"WITH {FROWS}, " + ", ".join(
    f"q{i} AS (SELECT sensor_id, sec, row_id AS sample_id, {v} AS value FROM f), "
    f"i{i} AS ({_islands(f'q{i}', 'sensor_id', f'value > {lim}', hold)})"
    for i, (_, v, lim, hold, _s) in enumerate(_RULES)) + " " + " UNION ALL ".join(
    f"SELECT *, '{n}' AS rule, '{s}' AS severity FROM i{i} WHERE fired_at IS NOT NULL"
    for i, (n, _, _, _, s) in enumerate(_RULES))
SQL["sla_status"] = f"""WITH {METRICS}, n AS (SELECT CASE metric WHEN 'click' THEN 'detection_latency_ms'
    WHEN 'view' THEN 'true_positive_rate' WHEN 'error' THEN 'false_positive_rate' END AS metric, sec, sample_id, value
  FROM m), r AS (SELECT metric, avg(value) AS mean FROM (SELECT *, row_number() OVER (
    PARTITION BY metric ORDER BY sec DESC, sample_id DESC) AS rn FROM n) WHERE rn <= 1000 GROUP BY metric),
t(metric, target, low) AS (VALUES ('detection_latency_ms', 200.0::DOUBLE, true), ('true_positive_rate', 0.97, false),
  ('false_positive_rate', 0.01, true), ('uptime_pct', 99.9, false))
SELECT t.metric, target, round(coalesce(mean, 0), 4) AS current,
  CASE WHEN low THEN coalesce(mean, 0) <= target ELSE coalesce(mean, 0) >= target END AS met
FROM t LEFT JOIN r ON t.metric = r.metric"""
SQL["idle_periods"] = f"""WITH {METRICS}, g AS (SELECT sensor_id, us, lag(us) OVER (
  PARTITION BY sensor_id ORDER BY us) AS p FROM m)
SELECT sensor_id, p AS idle_from, us AS idle_until, round((us - p) / 1000000, 6) AS idle_seconds
FROM g WHERE us - p > 3600000000"""

# --- reports -------------------------------------------------------------------------------------

SQL["severity_breakdown"] = f"""WITH {ALERTS}, l(severity) AS (VALUES ('emergency'), ('critical'), ('warning'), ('info'))
SELECT coalesce(l.severity, a.severity) AS severity, count(a.event_id) AS incidents,
  (SELECT count(*) FROM alerts) AS total_incidents
FROM l FULL JOIN alerts a ON l.severity = a.severity GROUP BY 1"""
_STATS = """count(*) AS detection_count, count(*) FILTER (is_anomaly) AS anomaly_count,
  round(avg(score) FILTER (rn <= 50), 4) AS avg_recent_score,
  round(count(*) FILTER (is_anomaly) / count(*) * 100, 2) AS anomaly_rate_pct"""
SQL["detection_stats"] = f"""WITH {DETECTED}
SELECT sensor_id, {_STATS} FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY sec DESC, row_id DESC) AS rn
  FROM det) GROUP BY sensor_id
UNION ALL SELECT '*', {_STATS} FROM (SELECT *, row_number() OVER (ORDER BY sec DESC, row_id DESC) AS rn FROM det)"""
SQL["pipeline_counters"] = f"""WITH {GATED} SELECT sensor_id, sec, row_id,
  CAST(sum(packet_count) OVER w AS BIGINT) AS packets, CAST(sum(byte_count) OVER w AS BIGINT) AS bytes,
  count(*) OVER w AS detections, count(*) FILTER (is_anomaly AND allowed) OVER w AS attacks,
  count(*) FILTER (is_anomaly AND NOT allowed) OVER w AS suppressed_detections
FROM g WINDOW w AS (PARTITION BY sensor_id ORDER BY sec, row_id)"""
SQL["binary_metrics"] = """WITH c AS (SELECT count(*) FILTER (l_returnflag = 'R' AND l_suppkey % 5 < 2) AS tp,
  count(*) FILTER (l_returnflag <> 'R' AND l_suppkey % 5 < 2) AS fp,
  count(*) FILTER (l_returnflag = 'R' AND l_suppkey % 5 >= 2) AS fn FROM lineitem),
d AS (SELECT *, tp / greatest(tp + fp, 1) AS p, tp / greatest(tp + fn, 1) AS r FROM c)
SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall,
  round(2 * p * r / greatest(p + r, 1e-6), 6) AS f1 FROM d"""
SQL["classification_metrics"] = """WITH x AS (SELECT l_returnflag AS y,
  CASE WHEN l_partkey % 4 = 0 THEN 'N' ELSE l_returnflag END AS p FROM lineitem),
k AS (SELECT DISTINCT y FROM x),
c AS (SELECT k.y, count(*) FILTER (x.y = k.y) AS s, count(*) FILTER (p = k.y) AS q,
  count(*) FILTER (x.y = k.y AND p = k.y) AS h FROM x, k GROUP BY k.y),
d AS (SELECT *, coalesce(h / nullif(q, 0), 0) AS pr, coalesce(h / nullif(s, 0), 0) AS re FROM c)
SELECT CAST(sum(s) AS BIGINT) AS rows, round(sum(h) / sum(s), 6) AS accuracy, round(avg(re), 6) AS balanced_accuracy,
  round(sum(pr * s) / sum(s), 6) AS precision, round(sum(re * s) / sum(s), 6) AS recall,
  round(sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * s) / sum(s), 6) AS f1_score FROM d"""
SQL["error_distribution"] = """WITH e AS (SELECT l_returnflag = 'R' AS is_attack,
  l_extendedprice / 1000 + CASE WHEN l_returnflag = 'R' THEN 50 ELSE 0 END AS e FROM lineitem),
d AS (SELECT is_attack, avg(e) AS mean, stddev_pop(e) AS std, count(*) AS n, quantile_cont(e, 0.5) AS p50,
  quantile_cont(e, 0.95) AS p95, quantile_cont(e, 0.97) AS p97 FROM e GROUP BY 1)
SELECT is_attack, round(mean, 6) AS mean, round(std, 6) AS std, n, round(p50, 6) AS p50, round(p95, 6) AS p95,
  round(p97, 6) AS p97, round(((SELECT p50 FROM d WHERE is_attack) - (SELECT p95 FROM d WHERE NOT is_attack))
    / (SELECT std FROM d WHERE NOT is_attack), 6) AS separation FROM d"""
SQL["class_profile"] = """WITH c AS (SELECT CASE l_returnflag WHEN 'N' THEN 'BENIGN' WHEN 'A' THEN 'Syn'
  ELSE 'DrDoS_DNS' END AS label, count(*) AS n FROM lineitem GROUP BY 1)
SELECT label, n, (SELECT n FROM c WHERE label = 'BENIGN') AS normal_rows,
  CAST((SELECT sum(n) FROM c WHERE label <> 'BENIGN') AS BIGINT) AS attack_rows FROM c"""


# --- alerts and responses ------------------------------------------------------------------------

SQL["normalise_severity"] = f"""WITH {ALERTS} SELECT event_id, CASE event_id % 5 WHEN 0 THEN severity
  WHEN 4 THEN 'medium' ELSE 'warning' END AS severity FROM alerts"""
_TITLE = ("CASE attack_type WHEN 'syn_flood' THEN 'SYN Flood' WHEN 'udp_flood' THEN 'UDP Flood' "
          "WHEN 'dns_amplification' THEN 'DNS Amplification' WHEN 'http_flood' THEN 'HTTP Flood' ELSE 'Unknown' END")
SQL["alert_text"] = f"""WITH {ALERTS} SELECT event_id, 'DDoS Attack Detected: ' || {_TITLE} AS title,
  'A ' || replace(attack_type, '_', ' ') || ' attack has been detected with an anomaly score of '
  || printf('%.2f', anomaly_score) || '. Current packet rate: ' || printf('%.0f', packet_rate) || ' pps.' AS description
FROM alerts"""


def greedy(key: str, gap: int) -> str:
    """Rows kept when a row is dropped that follows the last kept one of its key by less than gap."""
    return f"""
firsts AS (SELECT {key} AS k, t, min(event_id) AS event_id FROM alerts GROUP BY ALL),
kept AS (
  SELECT k, min(t) AS t FROM firsts GROUP BY k
  UNION ALL
  SELECT kept.k, (SELECT min(f.t) FROM firsts f WHERE f.k = kept.k AND f.t >= kept.t + {gap}) AS t
  FROM kept WHERE t IS NOT NULL)"""


_KEY = "sensor_id || '|' || attack_type || ':' || severity"
SQL["create_alerts"] = f"""WITH RECURSIVE {ALERTS}, {greedy(_KEY, 7200)}
SELECT sensor_id, t, event_id, attack_type, severity,
  substr(sha256(sensor_id || '|' || md5(attack_type || ':' || severity) || '|' || CAST(t AS VARCHAR)), 1, 8) AS alert_id,
  'DDoS Attack Detected: ' || {_TITLE} AS title,
  {_case("attack_type", EXPERT_TABLE, f"'{EXPERT_DEFAULT[3]}'", 3)} AS recommended_response
FROM alerts JOIN firsts USING (event_id, t) JOIN kept USING (k, t)"""
SQL["create_alerts_default_window"] = f"""WITH RECURSIVE {ALERTS}, {greedy("attack_type || ':' || severity", 300)}
SELECT t, event_id, attack_type, severity FROM alerts JOIN firsts USING (event_id, t) JOIN kept USING (k, t)"""
SQL["create_security_alerts"] = f"""WITH RECURSIVE {ALERTS},
{greedy(_KEY + " || ':' || CAST(user_id % 10 AS VARCHAR)", 86400)}
SELECT sensor_id, t, event_id, attack_type, severity, 'Finding ' || attack_type AS title
FROM alerts JOIN firsts USING (event_id, t) JOIN kept USING (k, t)"""

LIFECYCLE = f"""{ALERTS}, acts AS (
  SELECT event_id, 'ack' AS a, t + event_id % 400 AS tm FROM alerts WHERE event_id % 2 = 0
  UNION ALL SELECT event_id, 'ack', t + 600 FROM alerts WHERE event_id % 6 = 0
  UNION ALL SELECT event_id, 'res', t + event_id % 900 FROM alerts WHERE event_id % 5 = 0),
fold AS (SELECT event_id, min(tm) FILTER (a = 'res') AS resolved_at, min(tm) FILTER (a = 'ack') AS ack FROM acts
  GROUP BY event_id),
life AS (SELECT alerts.*, resolved_at,
  CASE WHEN resolved_at IS NULL OR ack <= resolved_at THEN ack END AS acknowledged_at,
  CASE WHEN resolved_at IS NOT NULL THEN 'resolved' WHEN ack IS NOT NULL THEN 'acknowledged' ELSE 'active' END AS status
  FROM alerts LEFT JOIN fold USING (event_id))"""
SQL["alert_lifecycle"] = f"""WITH {LIFECYCLE} SELECT event_id, status, acknowledged_at,
  CASE WHEN acknowledged_at IS NOT NULL THEN 'u' || CAST(user_id AS VARCHAR) END AS acknowledged_by, resolved_at
FROM life"""
SQL["query_alerts"] = f"""WITH {LIFECYCLE} SELECT event_id, t, severity, status FROM life
WHERE severity = 'warning' AND event_id % 3 < 2 AND status <> 'resolved' ORDER BY t DESC, event_id DESC LIMIT 100"""
SQL["response_times"] = f"""WITH {LIFECYCLE} SELECT count(*) AS incidents,
  round(avg(acknowledged_at - t), 6) AS avg_ack_seconds, round(avg(resolved_at - t), 6) AS avg_resolve_seconds,
  round(100 * count(*) FILTER (acknowledged_at - t <= 300) / count(acknowledged_at), 6) AS sla_met_pct FROM life"""
SQL["alert_stats"] = f"""WITH RECURSIVE {ALERTS}, {greedy(_KEY, 7200)},
made AS (SELECT event_id FROM firsts JOIN kept USING (k, t))
SELECT count(*) AS alerts_created, count(*) FILTER (event_id % 5 <> 0) AS active_alerts, count(*) AS total_alerts,
  (SELECT count(*) FROM alerts) - count(*) AS alerts_deduplicated FROM made"""
SQL["correlate_alerts"] = f"""WITH {ALERTS} SELECT a.event_id, coalesce(string_agg(b.alert_id, ','
    ORDER BY b.t, b.alert_id) FILTER (b.event_id IS NOT NULL), '') AS correlated_alerts
FROM alerts a LEFT JOIN alerts b ON a.sensor_id = b.sensor_id AND a.attack_type = b.attack_type
  AND b.t > a.t - 3600 AND (b.t < a.t OR (b.t = a.t AND b.alert_id < a.alert_id))
GROUP BY a.event_id"""
SQL["escalation_state"] = f"""WITH {LIFECYCLE} SELECT event_id, 1705363200 - t AS age_seconds,
  CASE WHEN 1705363200 - t >= 900 THEN 'L3 - CISO' WHEN 1705363200 - t >= 300 THEN 'L2 - Security Engineer'
    ELSE 'L1 - SOC Analyst' END AS level,
  CASE WHEN 1705363200 - t >= 900 THEN 'slack,pagerduty,email' WHEN 1705363200 - t >= 300 THEN 'slack,pagerduty'
    ELSE 'slack' END AS notifiers
FROM life WHERE status <> 'resolved' AND t <= 1705363200"""
SQL["display_alert"] = f"""WITH {ALERTS} SELECT event_id, array_to_string(source_ips[1:10], '|') AS source_ips,
  CAST(printf('%.0f', packet_rate) AS DOUBLE) AS packet_rate FROM alerts"""
SQL["cidr_allowlist"] = f"""WITH {ALERTS}, r AS (SELECT event_id, unnest(source_ips) AS raw,
  unnest(generate_series(0, len(source_ips) - 1)) AS pos FROM alerts),
i AS (SELECT event_id, pos, CASE WHEN event_id % 17 = 0 THEN raw || '9' WHEN event_id % 19 = 0 THEN 'fe80::1'
    WHEN event_id % 23 = 0 THEN 'ff02::fb' ELSE raw END AS ip FROM r),
n AS (SELECT *, CASE WHEN contains(ip, '.') THEN CAST(split_part(ip, '.', 3) AS BIGINT) * 256
    + CAST(split_part(ip, '.', 4) AS BIGINT) END AS low FROM i)
SELECT event_id, pos, ip, CASE WHEN ip LIKE '%.09' THEN 'invalid IP address' WHEN ip LIKE 'ff%' OR low < 8 * 256 OR low = 33 * 256 + 2
    OR low BETWEEN 40 * 256 + 4 AND 40 * 256 + 7 THEN 'target IP is allowlisted' END AS ip_rejection FROM n"""
SQL["response_decisions"] = f"""WITH {ALERTS}, d AS (SELECT *, CASE WHEN severity IN ('info', 'warning')
    THEN 'severity_below_auto_block_threshold'
  WHEN event_id % 4 <> 0 AND anomaly_score < 0.88 AND confidence < 0.75 THEN 'insufficient_multi_evidence'
  ELSE 'critical_alert_policy' END AS decision_reason FROM alerts),
x AS (SELECT d.*, unnest(CASE WHEN decision_reason = 'critical_alert_policy' THEN source_ips[1:5] ELSE [NULL] END)
  AS target_ip FROM d),
y AS (SELECT *, CASE WHEN user_id % 50 < 8 OR target_ip = '10.1.33.2' THEN true ELSE false END AS listed FROM x)
SELECT event_id, target_ip, CASE WHEN target_ip IS NULL THEN 'monitoring' ELSE 'actions_recorded' END AS decision_status,
  decision_reason, CASE WHEN target_ip IS NULL THEN NULL WHEN listed THEN 'rejected' ELSE 'monitor_only' END AS action_status,
  CASE WHEN target_ip IS NOT NULL AND listed THEN 'target IP is allowlisted' END AS ip_rejection,
  CASE WHEN target_ip IS NOT NULL THEN 'auto_response:' || attack_type END AS reason,
  CASE WHEN target_ip IS NOT NULL THEN t + 1800 END AS expires_at FROM y"""
ACTIONS = f"""{ALERTS}, actions AS (SELECT event_id AS action_id, t, sensor_id,
  '10.2.' || CAST(user_id AS VARCHAR) || '.' || CAST(event_id % 9 AS VARCHAR) AS target_ip,
  CASE WHEN event_id % 4 = 3 THEN 'unblock_ip' ELSE 'block_ip' END AS action_type,
  CASE WHEN event_id % 4 = 3 THEN 'rolled_back' WHEN event_id % 5 = 0 THEN 'failed' ELSE 'executed' END AS status
  FROM alerts)"""
SQL["active_blocks"] = f"""WITH {ACTIONS}, r AS (SELECT *, row_number() OVER (
    PARTITION BY target_ip ORDER BY t DESC, action_id DESC) AS rn FROM actions
  WHERE status <> 'failed' AND t <= 1705363200)
SELECT target_ip, action_id, t, t + 864000 AS expires_at FROM r
WHERE rn = 1 AND action_type = 'block_ip' AND t + 864000 > 1705363200"""
SQL["query_actions"] = f"""WITH {ACTIONS} SELECT * FROM actions WHERE status = 'executed' AND action_type = 'block_ip'
ORDER BY t DESC, action_id DESC LIMIT 50"""
SQL["forensic_evidence"] = f"""WITH {PACKETS}, al AS (SELECT sec - sec % 5 AS t, dst_ip, min(us) AS first_us,
  max(src_ip) AS a, min(src_ip) AS b FROM packets GROUP BY 1, 2)
SELECT al.dst_ip || '@' || CAST(t AS VARCHAR) AS alert_id, count(*) AS packet_sample_count,
  min(us) AS first_packet_us, max(us) AS last_packet_us
FROM al JOIN packets p ON p.src_ip IN (a, b) AND us BETWEEN first_us AND first_us + 10000000
GROUP BY 1"""
SQL["verify_audit_chain"] = """SELECT event_id AS seq, event_id = 0 OR (event_id - 1) % 10 = 0 AS link_ok,
  event_id % 10 <> 0 AS hash_ok FROM events"""
SQL["query_audit"] = """SELECT event_id AS seq, floor(epoch(ts)) + 0.5 AS occurred_at,
  'u' || CAST(user_id AS VARCHAR) AS actor_user_id FROM events
WHERE event_type = 'click' AND floor(epoch(ts)) + 0.5 >= 1705000000 ORDER BY 2 DESC, 1 DESC LIMIT 500"""
SQL["redact_for_role"] = f"""WITH {ALERTS}, v(role, kind, seen) AS (VALUES ('admin', 'alerts', true),
  ('admin', 'actions', true), ('admin', 'detections', true), ('analyst', 'alerts', false),
  ('analyst', 'detections', false), ('viewer', 'detections', false))
SELECT event_id, CASE WHEN seen THEN '10.2.0.' || CAST(user_id AS VARCHAR) ELSE '[REDACTED]' END AS gateway,
  CASE WHEN seen THEN '00:' || CAST(user_id AS VARCHAR) ELSE '[REDACTED]' END AS bssid, attack_type AS ssid,
  CASE WHEN seen THEN 'm' ELSE '[REDACTED]' END AS mac, user_id AS port,
  CASE WHEN seen THEN 'x' ELSE '[REDACTED]' END AS dns, severity AS note,
  CASE WHEN seen THEN '{{"command": "c' || CAST(user_id AS VARCHAR) || '", "k": [{{"mac": 1}}], "n": '
    || CAST(user_id AS VARCHAR) || '}}' ELSE '{{"command": "[REDACTED]", "k": [{{"mac": "[REDACTED]"}}], "n": '
    || CAST(user_id AS VARCHAR) || '}}' END AS details, role, kind
FROM alerts, v"""


# --- host inventory ------------------------------------------------------------------------------

NETS = """nets AS (SELECT c_custkey, 'h' || CAST(c_custkey % 10 AS VARCHAR) AS host_id, c_custkey % 4 AS scan_ts,
  c_mktsegment || CASE WHEN c_custkey % 11 = 0 THEN ' Free WiFi' ELSE '' END AS ssid,
  '00:13:' || CAST(30 + c_custkey % 40 % 9 AS VARCHAR) || ':aa:bb:' || CAST(c_custkey % 40 + 10 AS VARCHAR) AS bssid,
  '0013' || CAST(30 + c_custkey % 40 % 9 AS VARCHAR) AS oui,
  CASE c_nationkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'wpa2-personal' ELSE 'wpa3' END AS auth,
  CASE c_custkey % 3 WHEN 0 THEN 'ccmp' WHEN 1 THEN 'none' ELSE 'gcmp' END AS enc
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
reg AS (SELECT '0013' || CAST(30 + n_nationkey AS VARCHAR) AS oui,
  CASE WHEN n_nationkey % 3 = 0 THEN n_name || ' Corp' ELSE n_name END AS vendor FROM nation WHERE n_nationkey % 3 < 2),
en AS (SELECT nets.*, coalesce(vendor, 'Unknown') AS vendor, oui IN ('001333', '001336') AS watched
  FROM nets LEFT JOIN reg USING (oui)),
assoc AS (SELECT 'h' || CAST(s_suppkey % 10 AS VARCHAR) AS host_id, s_suppkey % 4 AS scan_ts,
  CASE s_nationkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'AUTOMOBILE' WHEN 3 THEN 'HOUSEHOLD'
    ELSE '' END AS ssid,
  '00:13:' || CAST(30 + s_suppkey % 40 % 9 AS VARCHAR) || ':aa:bb:' || CAST(s_suppkey % 40 + 10 AS VARCHAR) AS bssid,
  s_suppkey % 2 = 1 AS colons,
  CASE s_suppkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'wpa2-personal' ELSE '' END AS auth FROM supplier),
tb AS (SELECT DISTINCT '00:13:' || CAST(30 + c_custkey % 20 % 9 AS VARCHAR) || ':aa:bb:'
  || CAST(c_custkey % 20 + 10 AS VARCHAR) AS bssid FROM customer WHERE c_mktsegment = 'BUILDING')"""


def _found(category, severity, title, confidence, enforceable, ssid="NULL::VARCHAR", bssid="NULL::VARCHAR", adapter="NULL::VARCHAR",
           evidence="NULL::VARCHAR") -> str:
    q = lambda v: v if v.startswith("CASE") else f"'{v}'"
    return (f"SELECT host_id, scan_ts, {q(category)} AS category, {q(severity)} AS severity, {q(title)} AS title, "
            f"CAST({confidence} AS DOUBLE) AS confidence, {enforceable} AS enforceable, {ssid} AS ssid, "
            f"{bssid} AS bssid, {adapter} AS adapter_name, {evidence} AS evidence ")


CHECKS = {
    "suspicious_oui": _found(
        "wireless_suspicious_access_point", "warning", "Access point matches monitored device OUI", "0.62", "false",
        "min(ssid)", "bssid", evidence="'oui=' || oui || ' vendor=' || vendor")
    + "FROM en WHERE watched GROUP BY host_id, scan_ts, bssid, oui, vendor",
    "suspicious_ssid": "SELECT DISTINCT * FROM (" + _found(
        "wireless_suspicious_ssid", "warning", "Suspicious wireless network name observed", "0.58", "false", "ssid",
        "bssid", evidence="CASE WHEN contains(lower(ssid), 'free wifi') THEN 'pattern=free wifi' "
        "ELSE 'pattern=machin' END")
    + "FROM en WHERE contains(lower(ssid), 'free wifi') OR contains(lower(ssid), 'machin'))",
    "multi_ssid_ap": _found(
        "wireless_multi_ssid_access_point", "CASE WHEN on_ THEN 'high' ELSE 'warning' END",
        "One access point advertises multiple SSIDs", "CASE WHEN on_ THEN 0.76 ELSE 0.6 END", "false",
        bssid="bssid", evidence="names")
    + "FROM (SELECT m.*, a.bssid IS NOT NULL AND a.colons AND a.bssid = m.bssid AS on_ FROM (SELECT host_id, scan_ts, "
    "bssid, string_agg(DISTINCT ssid, ',' ORDER BY ssid) AS names FROM en GROUP BY ALL HAVING count(DISTINCT ssid) > 1) m "
    "LEFT JOIN assoc a ON m.host_id = a.host_id AND m.scan_ts = a.scan_ts)",
    "usb_gadget_findings": _found(
        "CASE WHEN rule < 3 THEN 'rogue_usb_network_gadget' ELSE 'usb_network_adapter_review' END",
        "CASE rule WHEN 1 THEN 'critical' WHEN 2 THEN 'high' ELSE 'medium' END",
        "CASE rule WHEN 1 THEN 'Suspicious USB network gadget with Pineapple-like network' "
        "WHEN 2 THEN 'Suspicious USB Ethernet/RNDIS adapter detected' ELSE 'USB network adapter needs review' END",
        "CASE rule WHEN 1 THEN 0.92 WHEN 2 THEN 0.82 ELSE 0.62 END", "rule < 3", adapter="alias", evidence="ip")
    + """FROM (SELECT *, CASE WHEN contains(ip, '172.16.42.') OR contains(ip, '172.16.43.') THEN 1
      WHEN net AND NOT contains(txt, 'wireless') AND NOT contains(txt, 'wi-fi') THEN 2 WHEN net THEN 3 END AS rule
    FROM (SELECT a.*, regexp_matches(txt, 'rndis|remote ndis|usb ethernet|usb network|ecm|ncm') AS net, ip FROM (
      SELECT 'h' || CAST(p_partkey % 50 AS VARCHAR) AS host_id, p_partkey % 4 AS scan_ts,
        CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE 'Ethernet ' || CAST(p_partkey AS VARCHAR) END AS alias,
        lower(concat_ws(' ', p_name, CASE WHEN p_partkey % 7 <> 0 THEN 'Ethernet ' || CAST(p_partkey AS VARCHAR) END,
          CASE p_size % 6 WHEN 0 THEN 'Remote NDIS Gadget' WHEN 1 THEN 'USB Ethernet' WHEN 2 THEN 'Wireless USB Network'
            WHEN 3 THEN 'Intel Wi-Fi' WHEN 4 THEN 'Trusted RNDIS dock' ELSE 'PCI controller' END,
          CASE WHEN p_partkey % 2 = 0 THEN 'USB' ELSE 'PCI' END, p_type)) AS txt FROM part) a
      LEFT JOIN (SELECT 'h' || CAST(p_partkey % 50 AS VARCHAR) AS host_id, p_partkey % 4 AS scan_ts,
        'ethernet ' || CAST(p_partkey AS VARCHAR) AS alias,
        '{"ipv4":"172.16.' || CAST(40 + p_partkey % 8 AS VARCHAR) || '.2"}' AS ip FROM part) c
      ON a.host_id = c.host_id AND a.scan_ts = c.scan_ts AND lower(a.alias) = c.alias)
    WHERE contains(txt, 'usb') AND NOT contains(txt, 'trusted')) WHERE rule IS NOT NULL""",
    "evil_twin_findings": _found(
        "evil_twin_wifi", "critical", "Trusted SSID is using open authentication", "0.93", "true", "ssid", "bssid",
        evidence="'authentication=' || auth")
    + "FROM assoc WHERE ssid IN ('BUILDING', 'MACHINERY') AND auth IN ('open', '') UNION ALL "
    + _found("evil_twin_wifi", "high", "Connected BSSID is not in trusted list", "0.87", "true", "ssid", "bssid",
             evidence="(SELECT string_agg(bssid, ',' ORDER BY bssid) FROM tb)")
    + "FROM assoc WHERE ssid = 'BUILDING' AND bssid NOT IN (SELECT bssid FROM tb) UNION ALL "
    + _found("evil_twin_wifi", "CASE WHEN ssid IN ('BUILDING', 'MACHINERY') THEN 'high' ELSE 'warning' END",
             "Same SSID advertised with conflicting security", "0.78", "ssid IN ('BUILDING', 'MACHINERY')", "ssid",
             evidence="p")
    + "FROM (SELECT host_id, scan_ts, ssid, string_agg(DISTINCT auth || '/' || enc, ',' ORDER BY auth || '/' || enc) AS p "
    "FROM en GROUP BY ALL HAVING count(DISTINCT auth || '/' || enc) > 1) JOIN assoc USING (host_id, scan_ts, ssid)",
    "captive_portal_findings": _found(
        "captive_portal_interception", "CASE WHEN known THEN 'high' ELSE 'warning' END",
        "Captive portal or HTTP interception detected", "CASE WHEN known THEN 0.82 ELSE 0.66 END", "known", "ssid",
        "bssid", evidence="CAST(status AS VARCHAR) || ' ' || final_url")
    + """FROM (SELECT 'h' || CAST(page_id % 20 AS VARCHAR) AS host_id, page_id % 4 AS scan_ts, page_id % 3 <> 1 AS known,
      CASE page_id % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'Cafe' ELSE 'MACHINERY' END AS ssid,
      '00:13:37:aa:bb:' || CAST(page_id % 40 + 10 AS VARCHAR) AS bssid,
      CASE WHEN page_id % 5 = 0 THEN 302 ELSE 200 END AS status,
      CASE WHEN page_id % 2 = 0 THEN 'http://probe.example/test.txt/' ELSE url END AS final_url, html FROM pages)
    WHERE status = 302 OR rtrim(final_url, '/') <> 'http://probe.example/test.txt' OR NOT contains(html, '<p>')""",
}
for _name, _sql in CHECKS.items():
    SQL[_name] = f"WITH {NETS} {_sql}"
SQL["enrich_vendor"] = f"WITH {NETS} SELECT c_custkey, bssid, oui, vendor, watched AS wireless_suspicious_oui FROM en"
_ALL = "found AS (" + " UNION ALL ".join(f"SELECT * FROM ({s})" for s in CHECKS.values()) + ")"
SQL["pivot_findings"] = f"WITH {NETS}, {_ALL} SELECT category, severity, count(*) AS n FROM found GROUP BY ALL"
_RANK = ("CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'warning' THEN 3 "
         "WHEN 'high' THEN 4 WHEN 'critical' THEN 5 WHEN 'emergency' THEN 6 END")
SQL["finding_to_alert"] = f"""WITH {NETS}, {_ALL} SELECT host_id, scan_ts, category AS attack_type, severity,
  round(least(1, 0.45 + {_RANK} * 0.08::DOUBLE), 6) AS anomaly_score,
  lower(concat_ws(':', category, title, nullif(ssid, ''), nullif(bssid, ''), nullif(adapter_name, ''))) AS dedup_key,
  CASE WHEN category LIKE 'wireless%' THEN 'local_threat_guard,enterprise_wireless_analyzer' ELSE 'local_threat_guard'
    END AS detection_sources FROM found"""
SQL["highest_severity"] = f"""WITH {NETS}, {_ALL} SELECT host_id, scan_ts, max_by(severity, {_RANK}) AS highest_severity,
  count(*) AS findings FROM found GROUP BY ALL"""

# --- sources and sinks ---------------------------------------------------------------------------

_B = ["src_port", "dst_port", "protocol", "packet_size", "ttl", "flags", "payload_size", "fragment_offset"]
_BIG = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _B)
SQL["read_packets"] = f"""WITH {PACKETS} SELECT us AS ts, src_ip, dst_ip, {_BIG}, sequence_number, ack_number,
  65535::BIGINT AS window_size, 0::BIGINT AS checksum, 'default' AS sensor_id FROM packets"""
SQL["decode_json_packets"] = f"""WITH {PACKETS} SELECT round(us / 1000000, 6) AS "timestamp", src_ip, dst_ip, {_BIG},
  sequence_number, ack_number, CAST(window_size AS BIGINT) AS window_size, 0::BIGINT AS checksum,
  NULL::VARCHAR AS _corrupt FROM packets"""
SQL["packet_topic_source"] = SQL["decode_json_packets"]
SQL["encode_json_packets"] = f"""WITH {PACKETS} SELECT '{{"schema_version":1,"schema_id":1,"data":{{"timestamp":' ||
  CASE WHEN us % 1000000 = 0 THEN '1.' || regexp_replace(CAST(us // 1000000 - 1000000000 AS VARCHAR), '0+$', '')
    ELSE '1.' || regexp_replace(CAST(us // 1000000 - 1000000000 AS VARCHAR)
      || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0'), '0+$', '') END || 'E9,"src_ip":"' || src_ip || '","dst_ip":"' || dst_ip
  || '","src_port":' || src_port || ',"dst_port":' || dst_port || ',"protocol":' || protocol || ',"packet_size":'
  || packet_size || ',"ttl":' || ttl || ',"flags":' || flags || ',"payload_size":' || payload_size
  || ',"fragment_offset":' || fragment_offset || ',"sequence_number":' || sequence_number || ',"ack_number":'
  || ack_number || ',"window_size":' || window_size || ',"checksum":0}}}}' AS value FROM packets"""
SQL["decode_binary_packets"] = f"""WITH {PACKETS} SELECT round(us / 1000000, 6) AS "timestamp", src_ip, dst_ip, {_BIG},
  sequence_number, ack_number, CAST(window_size AS BIGINT) AS window_size, 0::BIGINT AS checksum,
  NULL::BIGINT AS _corrupt FROM packets
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 69 FROM packets"""
SQL["ingest_field_dump"] = f"""WITH {PACKETS}, d AS (SELECT *, ack_number AS a, ack_number % 11 = 0 AS v6,
  (ack_number % 19 = 0 AND ack_number % 11 <> 0) AS short FROM packets WHERE ack_number % 13 <> 0)
SELECT us AS ts, CASE WHEN v6 THEN 'fd00::' || CAST(src_port AS VARCHAR) ELSE src_ip END AS src_ip,
  CASE WHEN v6 THEN 'fd00::1' ELSE dst_ip END AS dst_ip,
  CAST(CASE WHEN protocol = 1 THEN 0 ELSE src_port END AS BIGINT) AS src_port,
  CAST(CASE WHEN protocol = 1 THEN 0 ELSE dst_port END AS BIGINT) AS dst_port,
  CAST(CASE WHEN protocol <> 1 AND 53 IN (src_port, dst_port) THEN 53 ELSE protocol END AS BIGINT) AS protocol,
  CAST(packet_size AS BIGINT) AS packet_size, CAST(ttl AS BIGINT) AS ttl,
  CAST(CASE WHEN protocol = 6 THEN flags ELSE 0 END AS BIGINT) AS flags,
  CAST(CASE WHEN protocol = 6 THEN payload_size WHEN protocol = 1 THEN greatest(0, packet_size - 28)
    WHEN a % 5 > 0 THEN payload_size ELSE 0 END AS BIGINT) AS payload_size,
  CAST(fragment_offset AS BIGINT) AS fragment_offset,
  CASE WHEN protocol = 6 THEN sequence_number ELSE 0 END AS sequence_number,
  CASE WHEN protocol = 6 THEN ack_number ELSE 0 END AS ack_number,
  CAST(CASE WHEN protocol <> 6 THEN 0 WHEN a % 3 = 0 THEN 65535 ELSE window_size END AS BIGINT) AS window_size,
  'default' AS sensor_id FROM d"""
LABELLED = """lab AS (SELECT l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey % 100 * 10 + l_linenumber AS row_id,
  CAST(l_orderkey AS VARCHAR) AS "Flow ID", CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS "Total Packets",
  CASE WHEN l_partkey % 20 = 0 THEN NULL ELSE CAST(l_partkey AS VARCHAR) END AS "Flow Duration",
  CASE WHEN l_suppkey % 4 = 0 THEN 'n/a' ELSE CAST(l_suppkey AS VARCHAR) END AS "Flow Code", l_linestatus AS "Status",
  CASE WHEN l_partkey % 4 = 0 THEN 'tcp' ELSE CAST(l_linenumber AS VARCHAR) END AS "Service",
  CAST(l_linenumber AS VARCHAR) AS "Hop Count", 'x' || CAST(l_partkey AS VARCHAR) AS "Endpoint",
  NULL::VARCHAR AS "Empty", CASE l_returnflag WHEN 'N' THEN ' BENIGN' WHEN 'A' THEN 'Syn ' ELSE 'DrDoS_DNS' END AS "Label"
  FROM lineitem)"""
SQL["read_labelled_csv"] = f"""WITH {LABELLED} SELECT * REPLACE (CAST(row_id AS VARCHAR) AS row_id) FROM lab"""
SQL["read_labelled_csv_formats"] = SQL["read_labelled_csv"]
SQL["write_features"] = f"""WITH {VECTORS} SELECT sensor_id, window_start, packet_count, byte_count,
  '2024-01-01' AS day FROM vectors"""
SQL["write_alerts"] = f"""WITH {ALERTS} SELECT strftime(make_timestamp(t * 1000000), '%Y-%m-%d') AS day, severity,
  count(*) AS n FROM alerts GROUP BY ALL"""
SQL["format_cef"] = f"""WITH {ALERTS} SELECT event_id, 'CEF:0|netwatch|netwatch|1.0|' || attack_type
  || '|DDoS Attack Detected: ' || {_TITLE} || '|' || CASE severity WHEN 'emergency' THEN '10' WHEN 'critical' THEN '8'
    WHEN 'warning' THEN '5' ELSE '2' END || '|src=' || array_to_string(source_ips[1:5], ',') || ' score='
  || printf('%.4f', anomaly_score) AS value FROM alerts"""
SQL["format_notification"] = f"""WITH {ALERTS} SELECT event_id, CASE severity WHEN 'emergency' THEN '🚨'
    WHEN 'critical' THEN '🔴' WHEN 'warning' THEN '🟡' ELSE '🔵' END || ' *DDoS Attack Detected: ' || {_TITLE}
  || '*' || chr(10) || 'Score: ' || printf('%.2f', anomaly_score) || ' | Type: ' || attack_type AS text,
  'SEC-' || alert_id AS ticket_id FROM alerts"""


# --- streams: all windows, closed at the end of the source ---------------------

def _windows(window: int, slide: int) -> str:
    return f"""WITH {PACKETS}, spread AS (
  SELECT p.*, unnest(generate_series(sec // {slide} * {slide} + {slide}, sec // {slide} * {slide} + {window}, {slide}))
    AS window_end FROM packets p),
r AS ({measures('sensor_id, window_end', 'spread', f'{window}.0')})
SELECT *, window_end - {window} AS window_start FROM r"""


SQL["stream_features_1s"] = _windows(1, 1)
SQL["stream_features_5s"] = _windows(5, 1)
SQL["stream_features_60s"] = _windows(60, 1)
SQL["run_stream"] = f"""WITH {VECTORS} SELECT {FINGERPRINT} AS attack_type, count(*) AS windows,
  CAST(sum(packet_count) AS BIGINT) AS packets FROM vectors
WHERE window_start + 1 <= (SELECT max(us) / 1000000 - 10 FROM packets) GROUP BY 1"""
SQL["stream_alert_dedup"] = f"""WITH RECURSIVE {ALERTS}, {greedy(_KEY, 7200)}
SELECT sensor_id, t, event_id, attack_type, severity
FROM alerts JOIN firsts USING (event_id, t) JOIN kept USING (k, t)"""


# --- models: the parts that are plain SQL ---------------------------------------------------------

_SAMPLED = f"""{LABELLED}, samp AS (SELECT row_id, trim("Label") AS k, row_number() OVER (
  PARTITION BY trim("Label") ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) AS rn FROM lab)"""
SQL["balanced_weights"] = f"""WITH {LABELLED}, c AS (SELECT trim("Label") AS k, count(*) AS n FROM lab GROUP BY 1)
SELECT row_id, k AS label, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight
FROM lab JOIN c ON trim(lab."Label") = k"""
SQL["sample_per_class"] = f"WITH {_SAMPLED} SELECT row_id, k AS label FROM samp WHERE rn <= 3000"
SQL["stratified_split"] = f"""WITH {LABELLED} SELECT row_id, trim("Label") AS label, percent_rank() OVER (
  PARTITION BY trim("Label") ORDER BY md5('7:' || CAST(row_id AS VARCHAR)), row_id) < 0.2 AS is_test FROM lab"""
_PROFILED = ["Total Packets", "Flow Duration", "Flow Code", "Status", "Service", "Hop Count", "Endpoint", "Empty"]
SQL["profile_columns"] = f"WITH {LABELLED}, p AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(x) AS non_empty, count(TRY_CAST(x AS DOUBLE)) AS numeric_cells,
      count(DISTINCT x) + CAST(bool_or(x IS NULL) AS INTEGER) AS d, count(*) AS n
    FROM (SELECT CASE WHEN "{c}" NOT IN ('n/a') THEN "{c}" END AS x FROM lab)""" for c in _PROFILED) + """)
SELECT "column", CASE WHEN non_empty = 0 THEN 'dropped' WHEN numeric_cells / non_empty >= 0.9 THEN 'numeric'
  WHEN d > least(1000, greatest(100, n // 2)) THEN 'dropped' ELSE 'categorical' END AS kind, non_empty, numeric_cells FROM p"""
SQL["typed_columns"] = f"""WITH {LABELLED} SELECT row_id, trim("Label") AS label,
  CAST("Total Packets" AS DOUBLE) AS "Total Packets", CAST("Flow Duration" AS DOUBLE) AS "Flow Duration",
  TRY_CAST("Flow Code" AS DOUBLE) AS "Flow Code", CAST("Hop Count" AS DOUBLE) AS "Hop Count", "Status", "Service" FROM lab"""

_INPUTS = [n for n, _, _, _ in MODEL_FEATURES]
SQL["robust_scale"] = f"""WITH {FROWS}, x AS (SELECT row_id, {", ".join(
    f"CAST(coalesce({n}, 0) AS DOUBLE) AS {n}" if n in FEATURE_COLUMNS else f"0::DOUBLE AS {n}" for n in _INPUTS)} FROM f),
q AS (SELECT {", ".join(f"quantile_cont({n}, [0.25, 0.5, 0.75]) AS q_{n}" for n in _INPUTS)} FROM x)
SELECT row_id, {", ".join(
    f"round(CASE WHEN q_{n}[3] > q_{n}[1] THEN ({n} - q_{n}[2]) / (q_{n}[3] - q_{n}[1]) ELSE 0 END + 3.3e-8, 6) AS {n}"
    for n in _INPUTS)} FROM x, q"""
_TYPED = {"Total Packets": "CAST", "Flow Duration": "CAST", "Flow Code": "TRY_CAST", "Hop Count": "CAST"}
SQL["median_fill"] = f"""WITH {LABELLED}, x AS (SELECT row_id, {", ".join(
    f'{cast}("{n}" AS DOUBLE) AS "{n}"' for n, cast in _TYPED.items())} FROM lab)
SELECT row_id, {", ".join(
    f'coalesce("{n}", (SELECT quantile_cont("{n}", 0.5) FROM x)) AS "{n} filled"' for n in _TYPED)} FROM x"""

# --- whole plans ---------------------------------------------------------------------------------

_GATE_CTES = GATED[len(DETECTED):]
_MULTI = f"""{PACKETS}, sizes(window_name, w) AS (VALUES ('1s', 1), ('5s', 5), ('60s', 60)),
spread AS (SELECT p.*, window_name, w, unnest(generate_series(sec + 1, sec + w)) AS window_end FROM packets p, sizes),
multi AS (SELECT * RENAME (sensor_id AS sensor), sensor_id || window_name AS sensor_id, window_end AS sec,
  sensor_id || window_name || CAST(window_end AS VARCHAR) AS row_id
  FROM ({measures('sensor_id, window_name, w, window_end', 'spread', 'w', 12)}))"""
SQL["flagship"] = f"""WITH {_MULTI}, {heuristics('multi')} {_VOTE} {_GATE_CTES}
SELECT sensor AS sensor_id, window_name, window_end, round(packet_rate, 6) AS packet_rate, fingerprint,
  CAST(k AS BIGINT) AS models_agreeing,
  round(CASE WHEN is_anomaly AND NOT allowed THEN least(score, 0.44) ELSE score END, 6) AS anomaly_score,
  is_anomaly AND allowed AS is_anomaly,
  CASE WHEN is_anomaly AND NOT allowed THEN 'none' ELSE attack_type END AS attack_type,
  CASE WHEN is_anomaly AND NOT allowed THEN 'info' ELSE severity END AS severity,
  CASE WHEN is_anomaly AND NOT allowed THEN reason END AS suppression_reason,
  CASE WHEN is_anomaly AND allowed THEN reason END AS gate_reason FROM g"""
_KEEP10 = greedy("sensor_id || '|' || attack_type || ':' || severity", 10).replace(
    "min(event_id) AS event_id FROM alerts", "count(*) AS c FROM anomalies")
SQL["alert_flow"] = f"""WITH RECURSIVE {WINDOW_DETECTED} {_GATE_CTES}, {ENDPOINTS},
anomalies AS (SELECT g.sensor_id, g.window_start AS t, attack_type, severity, score, string_split(source_ips, '|') AS ips
  FROM g JOIN ctx ON g.sensor_id = ctx.sensor_id AND g.window_start = ctx.window_start WHERE is_anomaly AND allowed),
{_KEEP10},
al AS (SELECT a.*, CASE WHEN severity IN ('critical', 'emergency') THEN 'critical_alert_policy'
    ELSE 'severity_below_auto_block_threshold' END AS decision_reason
  FROM anomalies a JOIN kept ON kept.k = a.sensor_id || '|' || attack_type || ':' || severity AND kept.t = a.t)
SELECT sensor_id, t, attack_type, severity, unnest(CASE WHEN decision_reason = 'critical_alert_policy' THEN ips[1:5]
    ELSE [NULL] END) AS target_ip, decision_reason,
  CASE WHEN decision_reason = 'critical_alert_policy' THEN 'monitor_only' END AS action_status FROM al"""

# --- streams closed at the end of their source give what the batch gives ---------------------------

SQL["stream_alert_flow"] = SQL["alert_flow"]
SQL["stream_vote"] = SQL["detections_with_context"]
