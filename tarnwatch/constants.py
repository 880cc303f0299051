"""Domain constants shared by the operators.

Everything in this module is a fixed value: results only agree with the
established behaviour of the system when these tables are used unchanged.
"""

from __future__ import annotations

# --- fixed values: protocols -------------------------------------------------
FLOW_PROTOCOL_CODES = {"TCP": 1.0, "UDP": 2.0, "ICMP": 3.0, "OTHER": 0.0}
BEHAVIOR_PROTOCOL_NUMBERS = {
    "TCP": 6.0,
    "UDP": 17.0,
    "ICMP": 1.0,
    "HTTP": 80.0,
    "HTTPS": 443.0,
    "FTP": 21.0,
    "SSH": 22.0,
    "DNS": 53.0,
}
TCP_FLAG_BITS = ["FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR"]
FLOW_FLAGS = ["syn", "ack", "fin", "rst", "psh", "urg"]

# --- fixed values: the 29 traffic features in training order -----------------
FEATURE_NAMES = [
    "packet_size", "duration", "protocol_encoded",
    "flow_duration", "flow_packet_count", "flow_bytes_total",
    "flow_bytes_per_second", "flow_packets_per_second",
    "packet_size_mean", "packet_size_std", "packet_size_min", "packet_size_max",
    "inter_arrival_mean", "inter_arrival_std", "inter_arrival_min", "inter_arrival_max",
    "flag_syn", "flag_ack", "flag_fin", "flag_rst", "flag_psh", "flag_urg",
    "src_port_category", "dst_port_category",
    "hour_of_day", "day_of_week",
    "protocol_frequency", "port_frequency_src", "port_frequency_dst",
]

# --- fixed values: severities ------------------------------------------------
SEVERITY_ORDER = ["low", "medium", "high", "critical"]
SEVERITY_WEIGHTS = {"LOW": 0.2, "MEDIUM": 0.5, "HIGH": 0.8, "CRITICAL": 1.0}
DEFAULT_SEVERITY_WEIGHT = 0.5

# --- fixed values: kill chain ------------------------------------------------
KILL_CHAIN_STAGES = [
    "reconnaissance",
    "weaponization",
    "delivery",
    "exploitation",
    "installation",
    "command_control",
    "actions_objectives",
]
ATTACK_STAGE = {
    "Probe": "reconnaissance",
    "Port Scan": "reconnaissance",
    "DoS": "actions_objectives",
    "DDoS": "actions_objectives",
    "R2L": "exploitation",
    "U2R": "exploitation",
    "Brute Force": "exploitation",
    "Malware": "installation",
    "Command Control": "command_control",
}
SIMILAR_ATTACKS = [
    ["DoS", "DDoS"],
    ["Probe", "Port Scan"],
    ["R2L", "Brute Force"],
    ["U2R", "Privilege Escalation"],
    ["Malware", "Trojan", "Virus"],
]
ACTOR_PATTERNS = {
    "APT1": ["probe", "r2l", "command_control"],
    "Lazarus": ["malware", "ddos", "u2r"],
    "FancyBear": ["probe", "brute_force", "lateral_movement"],
}
MITRE = {
    "Probe": ("TA0007", "T1046"),
    "Port Scan": ("TA0007", "T1046"),
    "Brute Force": ("TA0006", "T1110"),
    "DoS": ("TA0040", "T1499"),
    "DDoS": ("TA0040", "T1498"),
    "R2L": ("TA0008", "T1021"),
    "U2R": ("TA0004", "T1068"),
    "Malware": ("TA0002", "T1204"),
}

# --- fixed values: alerting --------------------------------------------------
RECOMMENDED_ACTIONS = {
    "DoS": "Block source IP, investigate traffic patterns, check system resources",
    "DDoS": "Activate DDoS mitigation, contact ISP, implement rate limiting",
    "Probe": "Monitor source IP, review firewall rules, check for follow-up attacks",
    "R2L": "Block source IP, review authentication logs, check for compromised accounts",
    "U2R": "Isolate affected system, review privilege escalation logs, conduct forensic analysis",
    "Brute Force": "Block source IP, review authentication policies, enable account lockout",
    "Port Scan": "Monitor source IP, review exposed services, update firewall rules",
    "Malware": "Isolate affected system, run antivirus scan, conduct forensic analysis",
}
DEFAULT_ACTION = "Investigate traffic, review logs, consider blocking source IP"
ACTION_SUFFIX = {
    "CRITICAL": ". IMMEDIATE ACTION REQUIRED - Escalate to security team.",
    "HIGH": ". High priority - Review within 1 hour.",
    "MEDIUM": ". Medium priority - Review within 4 hours.",
}
DEFAULT_ACTION_SUFFIX = ". Low priority - Review during next maintenance window."
SLACK_COLORS = {"LOW": "good", "MEDIUM": "warning", "HIGH": "danger", "CRITICAL": "danger"}
TEAMS_COLORS = {"LOW": "28a745", "MEDIUM": "ffc107", "HIGH": "fd7e14", "CRITICAL": "dc3545"}

# --- fixed values: confidence bins, highest first ----------------------------
CONFIDENCE_BINS = [
    (0.9, "0.9-1.0"),
    (0.8, "0.8-0.9"),
    (0.7, "0.7-0.8"),
    (0.6, "0.6-0.7"),
    (0.5, "0.5-0.6"),
]
LOWEST_CONFIDENCE_BIN = "0.0-0.5"

# --- fixed values: threat feeds ----------------------------------------------
FEED_THREAT_TYPES = {"abuse_ch": "botnet", "tor_exit_nodes": "tor", "malware_domains": "malware"}
FEED_CONFIDENCE = 0.8

# --- fixed values: behavioural recommendations -------------------------------
ANOMALY_RECOMMENDATIONS = {
    ("critical", "statistical_deviation"): "Immediate investigation required. Potential security incident.",
    ("critical", "pattern_deviation"): "Urgent analysis of traffic patterns. Possible attack in progress.",
    ("critical", "ml_anomaly"): "High-confidence anomaly detected. Escalate to security team.",
    ("high", "statistical_deviation"): "Investigate within 1 hour. Monitor closely.",
    ("high", "pattern_deviation"): "Analyze traffic patterns within 2 hours.",
    ("high", "ml_anomaly"): "Review anomaly details and correlate with other events.",
    ("medium", "statistical_deviation"): "Monitor trend. Investigate if pattern continues.",
    ("medium", "pattern_deviation"): "Review traffic patterns during next analysis cycle.",
    ("medium", "ml_anomaly"): "Log for trend analysis. Consider baseline adjustment.",
    ("low", "statistical_deviation"): "Normal variation. Continue monitoring.",
    ("low", "pattern_deviation"): "Minor pattern change. No immediate action required.",
    ("low", "ml_anomaly"): "Low-confidence anomaly. Monitor for recurring patterns.",
}
DEFAULT_ANOMALY_RECOMMENDATION = "Monitor and analyze."

# --- fixed values: log redaction and text cleaning ---------------------------
SENSITIVE_WORDS = ["password", "token", "key", "secret", "auth", "credential"]
REDACTED = "[REDACTED - Sensitive information removed]"
UNSAFE_CHARS = "<>\"'&\x00"
MAX_TEXT = 1000

# --- fixed values: labelled datasets -----------------------------------------
NSL_KDD_FEATURES = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land",
    "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in", "num_compromised",
    "root_shell", "su_attempted", "num_root", "num_file_creations", "num_shells",
    "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count",
    "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
]
NSL_KDD_TEXT = ["protocol_type", "service", "flag"]
NSL_KDD_CATEGORIES = {
    "normal": ["normal"],
    "dos": ["back", "land", "neptune", "pod", "smurf", "teardrop", "mailbomb", "apache2",
            "processtable", "udpstorm", "worm"],
    "probe": ["satan", "ipsweep", "nmap", "portsweep", "mscan", "saint"],
    "r2l": ["guess_passwd", "ftp_write", "imap", "phf", "multihop", "warezmaster", "warezclient",
            "spy", "xlock", "xsnoop", "snmpguess", "snmpgetattack", "httptunnel", "sendmail",
            "named"],
    "u2r": ["buffer_overflow", "loadmodule", "rootkit", "perl", "sqlattack", "xterm", "ps"],
}
CICIDS_CATEGORIES = {
    "normal": ["benign"],
    "dos": ["ddos", "dos hulk", "dos goldeneye", "dos slowloris", "dos slowhttptest", "heartbleed"],
    "probe": ["portscan", "port scan"],
    "r2l": ["ftp-patator", "ssh-patator", "brute force", "brute force -web", "brute force -xss",
            "web attack - brute force", "web attack - xss", "web attack - sql injection",
            "sql injection", "xss", "bot"],
    "u2r": ["infiltration"],
}
CICIDS_FEATURES = [
    "destination_port", "flow_duration", "total_fwd_packets", "total_backward_packets",
    "total_length_of_fwd_packets", "total_length_of_bwd_packets", "fwd_packet_length_max",
    "fwd_packet_length_min", "fwd_packet_length_mean", "fwd_packet_length_std",
    "bwd_packet_length_max", "bwd_packet_length_min", "bwd_packet_length_mean",
    "bwd_packet_length_std", "flow_bytes_s", "flow_packets_s", "flow_iat_mean", "flow_iat_std",
    "flow_iat_max", "flow_iat_min", "fwd_iat_total", "fwd_iat_mean", "fwd_iat_std", "fwd_iat_max",
    "fwd_iat_min", "bwd_iat_total", "bwd_iat_mean", "bwd_iat_std", "bwd_iat_max", "bwd_iat_min",
    "fwd_psh_flags", "bwd_psh_flags", "fwd_urg_flags", "bwd_urg_flags", "fwd_header_length",
    "bwd_header_length", "fwd_packets_s", "bwd_packets_s", "min_packet_length",
    "max_packet_length", "packet_length_mean", "packet_length_std", "packet_length_variance",
    "fin_flag_count", "syn_flag_count", "rst_flag_count", "psh_flag_count", "ack_flag_count",
    "urg_flag_count", "cwe_flag_count", "ece_flag_count", "down_up_ratio", "average_packet_size",
    "avg_fwd_segment_size", "avg_bwd_segment_size", "subflow_fwd_packets", "subflow_fwd_bytes",
    "subflow_bwd_packets", "subflow_bwd_bytes", "init_win_bytes_forward",
    "init_win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward", "active_mean",
    "active_std", "active_max", "active_min", "idle_mean", "idle_std", "idle_max", "idle_min",
]
FEATURE_RENAMES = {
    "nsl_kdd": {"protocol_type": "protocol", "src_bytes": "source_bytes",
                "dst_bytes": "destination_bytes"},
    "cicids": {"destination_port": "dst_port", "flow_duration": "duration"},
}
TARGET_ALIASES = ["Class", "Attack", "Category", "Target", "Label"]
