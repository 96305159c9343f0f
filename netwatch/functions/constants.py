"""Names, thresholds and lookup tables that results depend on."""

from __future__ import annotations

# The 36 measures of a feature vector, in output order.
MEASURES = [
    "packet_count", "byte_count", "packet_rate", "byte_rate",
    "tcp_ratio", "udp_ratio", "icmp_ratio", "dns_ratio",
    "syn_ratio", "syn_ack_ratio", "ack_ratio", "rst_ratio", "fin_ratio", "syn_to_ack_ratio",
    "src_ip_entropy", "dst_ip_entropy", "src_port_entropy", "dst_port_entropy",
    "avg_packet_size", "std_packet_size", "min_packet_size", "max_packet_size",
    "unique_src_ips", "unique_dst_ips", "unique_src_ports", "unique_dst_ports", "unique_ip_pairs",
    "avg_ttl", "ttl_diversity",
    "avg_payload_size", "zero_payload_ratio",
    "avg_window_size", "small_window_ratio",
    "fragmentation_ratio", "dns_response_ratio", "large_packet_ratio",
]

# The 30 model inputs in model order, with the normal-traffic value used for
# explanations, the heuristic scale (standard deviation) and a description.
MODEL_FEATURES = [
    ("packet_rate", 5000.0, 1500.0, "Packets per second"),
    ("byte_rate", 2500000.0, 750000.0, "Bytes per second"),
    ("tcp_ratio", 0.65, 0.12, "Proportion of TCP traffic"),
    ("udp_ratio", 0.20, 0.08, "Proportion of UDP traffic"),
    ("icmp_ratio", 0.05, 0.02, "Proportion of ICMP traffic"),
    ("dns_ratio", 0.10, 0.04, "Proportion of DNS traffic"),
    ("syn_ratio", 0.10, 0.06, "Ratio of SYN packets"),
    ("syn_ack_ratio", 0.10, 0.04, "Ratio of SYN-ACK packets"),
    ("ack_ratio", 0.40, 0.12, "Ratio of ACK packets"),
    ("rst_ratio", 0.05, 0.02, "Ratio of RST packets"),
    ("fin_ratio", 0.05, 0.02, "Ratio of FIN packets"),
    ("syn_to_ack_ratio", 0.25, 0.10, "SYN to ACK ratio (handshake completeness)"),
    ("src_ip_entropy", 4.0, 1.2, "Source IP address diversity"),
    ("dst_ip_entropy", 2.5, 0.8, "Destination IP address diversity"),
    ("src_port_entropy", 8.0, 2.5, "Source port diversity"),
    ("dst_port_entropy", 3.5, 1.2, "Destination port diversity"),
    ("avg_packet_size", 500.0, 150.0, "Average packet size in bytes"),
    ("std_packet_size", 150.0, 60.0, "Standard deviation of packet sizes"),
    ("unique_src_ips", 50.0, 15.0, "Number of unique source IPs"),
    ("unique_dst_ips", 5.0, 2.0, "Number of unique destination IPs"),
    ("unique_src_ports", 200.0, 80.0, "Number of unique source ports"),
    ("unique_dst_ports", 15.0, 6.0, "Number of unique destination ports"),
    ("avg_ttl", 80.0, 15.0, "Average Time-To-Live value"),
    ("ttl_diversity", 3.0, 1.0, "Number of distinct TTL values"),
    ("avg_payload_size", 300.0, 120.0, "Average payload size"),
    ("zero_payload_ratio", 0.15, 0.08, "Proportion of empty payloads"),
    ("avg_window_size", 40000.0, 12000.0, "Average TCP window size"),
    ("small_window_ratio", 0.05, 0.02, "Proportion of small TCP windows"),
    ("fragmentation_ratio", 0.01, 0.008, "Proportion of fragmented packets"),
    ("large_packet_ratio", 0.10, 0.04, "Proportion of large packets (>1400 bytes)"),
]
FEATURE_ORDER = [name for name, _, _, _ in MODEL_FEATURES]

# Mean and deviation of the twelve features ranked as "top features".
TOP_FEATURE_SCALE = [
    ("packet_rate", 5000.0, 1500.0),
    ("byte_rate", 2500000.0, 750000.0),
    ("syn_ratio", 0.08, 0.04),
    ("syn_to_ack_ratio", 0.20, 0.08),
    ("udp_ratio", 0.20, 0.06),
    ("dns_ratio", 0.10, 0.03),
    ("src_ip_entropy", 3.5, 0.8),
    ("unique_src_ips", 40.0, 12.0),
    ("avg_packet_size", 500.0, 120.0),
    ("zero_payload_ratio", 0.12, 0.06),
    ("small_window_ratio", 0.04, 0.02),
    ("large_packet_ratio", 0.08, 0.03),
]

# Attack fingerprints, first match wins.
FINGERPRINTS = [
    ("syn_flood", "syn_ratio > 0.25D AND zero_payload_ratio > 0.30D AND unique_src_ips > 30"),
    ("dns_amplification", "dns_ratio > 0.12D AND avg_packet_size > 600"),
    ("udp_flood", "udp_ratio > 0.35D AND packet_rate > 6000"),
    ("http_flood", "tcp_ratio > 0.70D AND unique_src_ips > 60 AND src_ip_entropy > 4.5D"),
    ("slowloris", "avg_packet_size < 80 AND avg_payload_size < 30 AND tcp_ratio > 0.70D"),
    ("icmp_flood", "icmp_ratio > 0.15D AND packet_rate > 5000"),
]

# Weighted rules of the tree-ensemble fallback score.
WEIGHTED_RULES = [
    (0.18, "syn_ratio > 0.35D"),
    (0.14, "packet_rate > 12000"),
    (0.12, "udp_ratio > 0.45D AND byte_rate > 5000000"),
    (0.10, "src_ip_entropy > 6.0D"),
    (0.10, "avg_packet_size < 120 AND packet_rate > 8000"),
    (0.10, "dns_ratio > 0.20D AND avg_packet_size > 800"),
    (0.08, "unique_src_ips > 80"),
    (0.07, "syn_to_ack_ratio > 1.5D"),
    (0.06, "zero_payload_ratio > 0.4D"),
    (0.05, "rst_ratio > 0.20D"),
]

# What an analyst is told about each attack type.
EXPERT_TABLE = {
    "syn_flood": (
        "T1498.001", "Layer 4 (Transport)",
        "State exhaustion attack targeting TCP handshake queue.",
        "Enable SYN cookies, aggressive timeout for half-open connections."),
    "dns_amplification": (
        "T1498.002", "Layer 3/4 (Network/Transport)",
        "Reflective volumetric attack using open DNS resolvers.",
        "Rate-limit DNS responses, deploy BCP38 anti-spoofing filters."),
    "udp_flood": (
        "T1498.002", "Layer 4 (Transport)",
        "Bandwidth saturation via random UDP port spam.",
        "Block non-standard UDP ports, implement strict rate limits."),
    "http_flood": (
        "T1499.004", "Layer 7 (Application)",
        "Resource exhaustion via valid HTTP GET/POST requests.",
        "Implement WAF JS-challenges, rate-limit per source context."),
    "slowloris": (
        "T1499.002", "Layer 7 (Application)",
        "Low-bandwidth attack holding connection slots open with partial requests.",
        "Deploy reverse proxy buffer limits, set strict Request-Header timeouts."),
    "icmp_flood": (
        "T1498.001", "Layer 3 (Network)",
        "Volumetric ping flood aiming to consume bandwidth.",
        "Drop all inbound ICMP Echo Requests at perimeter firewall."),
}
EXPERT_DEFAULT = (
    "Unknown", "Multiple or Unknown",
    "Anomalous traffic pattern detected without a specific known signature.",
    "Review Top Features in Forensics Panel. Isolate IP ranges.")

# Traffic-shaping advice (action, rate limit, block duration).
SHAPING_TABLE = {
    "syn_flood": ("syn_cookies", "10000 pps", "300s"),
    "udp_flood": ("udp_rate_limit", "5000 pps", "600s"),
    "http_flood": ("challenge_response", "1000 rps", "900s"),
    "dns_amplification": ("dns_response_limit", "100 pps", "300s"),
    "slowloris": ("connection_timeout", "50 connections/IP", "1800s"),
}
SHAPING_DEFAULT = ("monitor", "none", None)

# Automatic response actions per severity.
RESPONSE_ACTIONS = {
    "emergency": ["rate_limit_source_ips", "enable_geo_blocking", "notify_upstream_provider",
                  "capture_forensics"],
    "critical": ["rate_limit_source_ips", "enable_challenge_response", "capture_forensics"],
    "warning": ["increase_monitoring", "prepare_mitigation"],
}
RESPONSE_ACTIONS_DEFAULT = ["log_event"]

# Severities. The response and the inventory ranks differ on purpose.
SEVERITY_ALIASES = {
    "low": "low", "medium": "medium", "high": "high", "warn": "warning", "warning": "warning",
    "emergency": "emergency", "critical": "critical", "info": "info",
}
REPORT_SEVERITIES = ["emergency", "critical", "warning", "info"]
RESPONSE_SEVERITY_RANK = {
    "info": 0, "low": 1, "warning": 2, "medium": 2, "high": 3, "critical": 4, "emergency": 5,
}
INVENTORY_SEVERITY_RANK = {
    "info": 0, "low": 1, "medium": 2, "warning": 3, "high": 4, "critical": 5, "emergency": 6,
}
CEF_SEVERITY = {"emergency": 10, "critical": 8, "warning": 5, "info": 2}
SEVERITY_MARKERS = {"emergency": "🚨", "critical": "🔴", "warning": "🟡", "info": "🔵"}
SEVERITY_MARKER_DEFAULT = "⚪"

# Words written in capitals in alert titles.
TITLE_ACRONYMS = ["syn", "ack", "udp", "tcp", "dns", "http", "icmp", "ntp", "ssdp"]

# Escalation levels (name, age in seconds at which it starts, notifiers).
ESCALATION_LEVELS = [
    ("L1 - SOC Analyst", 0, ["slack"]),
    ("L2 - Security Engineer", 300, ["slack", "pagerduty"]),
    ("L3 - CISO", 900, ["slack", "pagerduty", "email"]),
]

# Score and packet-rate thresholds of the tiered alert classifier.
CLASSIFIER_TIERS = [("emergency", 0.9, 50000), ("critical", 0.75, 30000), ("warning", 0.6, 15000)]

# Service-level targets; True means the mean must not exceed the target.
SLA_TARGETS = [
    ("detection_latency_ms", 200.0, True),
    ("true_positive_rate", 0.97, False),
    ("false_positive_rate", 0.01, True),
    ("uptime_pct", 99.9, False),
]

# Conditions that must hold for a time before they alert.
SUSTAINED_RULES = [
    ("HighPacketRate", "packet_rate", 50000.0, 30, "warning"),
    ("HighAnomalyScore", "anomaly_score", 0.8, 15, "critical"),
    ("DetectionLatencyHigh", "detection_latency_ms", 200.0, 60, "warning"),
]

# Networks that must never be blocked.
DEFAULT_ALLOWLIST = ["127.0.0.1", "::1", "0.0.0.0", "255.255.255.255", "224.0.0.0/4", "ff00::/8"]

# Ports and names used by the target filter.
UDP_SERVICE_PORTS = [53, 123, 161, 500, 514, 1900]
ALL_TRAFFIC_TARGETS = ["", "*", "all", "any", "0.0.0.0/0", "::/0"]

# Columns of a tab-separated packet field dump, in file order.
FIELD_DUMP_COLUMNS = [
    "frame.time_epoch", "ip.src", "ip.dst", "ip.proto", "frame.len", "ip.ttl",
    "tcp.srcport", "tcp.dstport", "tcp.flags", "tcp.seq", "tcp.ack", "tcp.window_size_value",
    "tcp.len", "udp.srcport", "udp.dstport", "udp.length", "icmp.type", "icmp.code",
    "ip.frag_offset", "ipv6.src", "ipv6.dst", "ipv6.nxt", "ipv6.hlim",
]

# Topics (name, partitions, retention in ms).
TOPICS = {
    "raw-packets": (12, 3600000),
    "processed-features": (12, 86400000),
    "detection-alerts": (6, 604800000),
}
MAX_RECORDS_PER_TRIGGER = 50000

# Keys hidden from analysts, and detection keys hidden from viewers.
SENSITIVE_KEYS = [
    "adapter", "adapter_name", "adapter_description", "adapters", "bssid", "command", "commands",
    "default_gateway", "dns", "dns_servers", "gateway", "ip_configuration", "mac", "mac_address",
    "pnp_device_id", "pnp_id",
]
VIEWER_HIDDEN_DETECTION_KEYS = ["raw_anomaly_score", "suppression_reason", "gate_evidence"]

# Key words of the adapter inventory check.
USB_NETWORK_KEYWORDS = [
    "rndis", "remote ndis", "usb ethernet", "usb network", "ethernet gadget", "cdc ethernet",
    "linux usb ethernet", "linux foundation", "ecm", "ncm",
]
WIRELESS_KEYWORDS = ["wi-fi", "wifi", "wireless", "802.11", "wlan"]
GADGET_NETWORKS = ["172.16.42.", "172.16.43."]
REDIRECT_STATUSES = [301, 302, 303, 307, 308]

# Labelled-table column names (letters and digits only) and model names.
TARGET_COLUMNS = [
    "label", "class", "target", "y", "outcome", "attack", "attacktype", "category", "result",
    "malicious", "isattack", "ddos",
]
DROPPED_COLUMNS = [
    "unnamed0", "flowid", "sourceip", "srcip", "destinationip", "dstip", "timestamp", "simillarhttp",
]
NORMAL_LABELS = ["BENIGN", "NORMAL"]
MODEL_NAMES = {
    "hist_gradient_boosting": "Hist Gradient Boosting",
    "random_forest": "Random Forest",
    "logistic_regression": "Logistic Regression",
    "linear_svm": "Linear SVM",
    "mlp": "Neural Network (MLP)",
    "gaussian_nb": "Gaussian Naive Bayes",
    "knn": "K-Nearest Neighbors",
}
MODEL_ALIASES = {
    "auto": "auto", "best": "auto",
    "hgb": "hist_gradient_boosting", "histgradientboosting": "hist_gradient_boosting",
    "histgradientboostingclassifier": "hist_gradient_boosting",
    "gradientboosting": "hist_gradient_boosting", "gb": "hist_gradient_boosting",
    "rf": "random_forest", "randomforest": "random_forest",
    "randomforestclassifier": "random_forest",
    "logreg": "logistic_regression", "logistic": "logistic_regression",
    "logisticregression": "logistic_regression",
    "svm": "linear_svm", "linearsvc": "linear_svm", "linearsvm": "linear_svm",
    "mlp": "mlp", "neuralnetwork": "mlp", "neuralnet": "mlp",
    "gaussiannb": "gaussian_nb", "naivebayes": "gaussian_nb", "nb": "gaussian_nb",
    "knn": "knn", "kneighbors": "knn", "knearestneighbors": "knn",
}
AUTO_CANDIDATES = [
    "hist_gradient_boosting", "random_forest", "logistic_regression", "linear_svm",
    "gaussian_nb", "knn",
]

# The twelve audit columns covered by an event's hash.
AUDIT_HASH_COLUMNS = [
    "event_id", "occurred_at", "actor_user_id", "actor_role", "action", "target_type", "target_id",
    "reason", "outcome", "request_id", "details_json", "previous_hash",
]
