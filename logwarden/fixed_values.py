"""Names, tables, patterns and constants that results depend on."""

# --- Fixed values: events -> (severity, category) ---------------------------------------------
EVENT_META = {
    "login_success": ("low", "authentication"),
    "failed_login": ("medium", "authentication"),
    "auth_invalid_user": ("medium", "authentication"),
    "brute_force": ("critical", "attack"),
    "suspicious_ip": ("high", "network"),
    "port_scan": ("high", "reconnaissance"),
    "malware_detected": ("critical", "malware"),
    "file_access": ("low", "file_system"),
    "privilege_escalation": ("critical", "attack"),
    "data_exfiltration": ("critical", "data_leak"),
    "normal_traffic": ("low", "network"),
    "log_debug": ("low", "application"),
    "log_info": ("low", "application"),
    "log_notice": ("low", "application"),
    "log_warning": ("medium", "application"),
    "log_error": ("high", "application"),
    "log_critical": ("critical", "application"),
    "log_alert": ("critical", "application"),
    "log_emergency": ("critical", "application"),
}
DEFAULT_META = ("low", "other")
SEVERITIES = ("low", "medium", "high", "critical")

# --- Fixed values: syslog -----------------------------------------------------------------------
SYSLOG_SEVERITY_EVENTS = (
    "log_emergency", "log_alert", "log_critical", "log_error",
    "log_warning", "log_notice", "log_info", "log_debug",
)
SYSLOG_FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news",
    "uucp", "cron", "authpriv", "ftp", "ntp", "audit", "alert", "clock",
    "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
LEVEL_EVENTS = {
    "TRACE": "log_debug",
    "DEBUG": "log_debug",
    "INFO": "log_info",
    "NOTICE": "log_notice",
    "WARN": "log_warning",
    "WARNING": "log_warning",
    "ERROR": "log_error",
    "SEVERE": "log_error",
    "CRITICAL": "log_critical",
    "FATAL": "log_critical",
}
ERROR_WORDS = ("error", "failed", "failure", "denied", "refused", "panic", "fatal")
WARNING_WORDS = ("warn", "warning", "unable to", "timeout", "retry")
SERVICE_ACCOUNTS = ("www-data", "apache", "nginx")
OPENSSH_CORPUS_YEAR = 2016

# --- Fixed values: line patterns (Java syntax: d = only \n ends a line, U = Unicode classes) ----
HDFS_LINE = r"(?dU)^(\d{6})\s+(\d{6})\s+(\d+)\s+(\w+)\s+([^:]+):\s*(.*)$"
OPENSSH_LINE = r"(?dU)^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:]+):\s*(.*)$"
SYSLOG_FILE_LINE = (
    r"(?dU)^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
    r"([^\s:\[]{1,64})(?:\[(\d+)\])?:\s*(.*)$"
)
RFC5424_LINE = (
    r"(?sU)^<(\d{1,3})>(\d)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)$"
)
RFC3164_LINE = r"(?sU)^<(\d{1,3})>(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*)$"
SYSLOG_TAG = r"(?sU)^([^\s:\[]{1,32})(?:\[(\d+)\])?:\s*(.*)$"
SSHD_TAG = r"^sshd(?:\[\d+\])?\z"
SSHD_FAILED = (
    r"(?dU)^Failed password for (?:invalid user )?(\S+) from (\S+) port (\d{1,5})(?: ssh2)?\z"
)
SSHD_INVALID = r"(?dU)^Invalid user (\S+) from (\S+)\z"
SSHD_ACCEPTED = (
    r"(?dU)^Accepted (?:password|publickey) for (\S+) from (\S+) port (\d{1,5})(?: ssh2)?\z"
)
SUCCESSFUL_SU = r"(?dU)^Successful su for (\S+) by (\S+)\z"
IPV4_IN_TEXT = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
BLOCK_ID = r"(?U)blk_-?\d+"
BLOCK_LINE_HEAD = r"(?dU)^\d{6}\s+\d{6}\s+\d+\s+\w+\s+[^:]+:\s*(.*)$"
TEMPLATE_MASKS = (
    (r"(?U)blk_-?\d+", "<BLK>"),
    (r"(?U)(\d+\.){3}\d+(:\d+)?", "<IP>"),
    (r"(?U)/[-\w./]+", "<PATH>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (r"(?U)\b\d+\b", "<NUM>"),
)
ORIGIN_PATTERN = r"^(synthetic|syslog|file|replay:.+)$"

# --- Fixed values: rules (weights in hundredths) ------------------------------------------------
EVENT_WEIGHTS = {
    "brute_force": 45,
    "malware_detected": 50,
    "privilege_escalation": 50,
    "data_exfiltration": 45,
    "port_scan": 35,
    "suspicious_ip": 35,
}
FAILED_LOGIN_TIERS = ((5, 40), (3, 20))  # count >= limit
FREQUENCY_TIERS = ((15, 20), (8, 10))  # count > limit
FAILED_LOGIN_WINDOW_S = 60
FREQUENCY_WINDOW_S = 30
ALERT_COOLDOWN_S = 60
ALERT_THRESHOLD = 45

# --- Fixed values: address scopes, first match wins ---------------------------------------------
SCOPE_RANGES = (
    ("0.0.0.0", 8, "non_routable", "unspecified"),
    ("10.0.0.0", 8, "internal", "private (RFC1918)"),
    ("127.0.0.0", 8, "internal", "loopback"),
    ("169.254.0.0", 16, "internal", "link-local (RFC3927)"),
    ("172.16.0.0", 12, "internal", "private (RFC1918)"),
    ("192.168.0.0", 16, "internal", "private (RFC1918)"),
    ("100.64.0.0", 10, "non_routable", "carrier-grade NAT (RFC6598)"),
    ("192.0.0.0", 24, "non_routable", "IETF protocol assignments"),
    ("192.0.2.0", 24, "non_routable", "documentation range (RFC5737)"),
    ("198.51.100.0", 24, "non_routable", "documentation range (RFC5737)"),
    ("203.0.113.0", 24, "non_routable", "documentation range (RFC5737)"),
    ("198.18.0.0", 15, "non_routable", "benchmarking range (RFC2544)"),
    ("224.0.0.0", 4, "non_routable", "multicast"),
    ("240.0.0.0", 4, "non_routable", "reserved"),
)

# --- Fixed values: threat feeds, in citation order -----------------------------------------------
# (position, name, kind, max_age_hours, min_entries, verdict, score in hundredths, citation)
FEED_SPECS = (
    (1, "tor_exits", "exact", 24, 100, "tor_exit", 40, "Tor Project bulk exit list"),
    (2, "firehol_level1", "cidr", 72, 500, "blocklisted", 40, "FireHOL level1"),
)

# --- Fixed values: response policy ---------------------------------------------------------------
# (name, trigger, priority, [(action, required, ttl_seconds, reason, message)])
PLAYBOOKS = (
    ("Brute force containment", "brute_force", "P1", (
        ("block_ip", True, 3600, "repeated authentication failures", None),
        ("incident_report", True, None, None, None),
        ("webhook", False, None, None, None),
        ("notify", False, None, None, "security team paged for brute force from {ip}"),
    )),
    ("Data exfiltration response", "data_exfiltration", "P1", (
        ("block_ip", True, 7200, "large transfer to an external address", None),
        ("incident_report", True, None, None, None),
        ("webhook", False, None, None, None),
    )),
    ("Default notification", "*", "P3", (
        ("notify", False, None, None,
         "{event} from {ip} — no playbook is defined for this event type"),
    )),
    ("Malware response", "malware_detected", "P1", (
        ("incident_report", True, None, None, None),
        ("webhook", False, None, None, None),
        ("notify", False, None, None,
         "malware signature reported from {ip} — host isolation NOT performed"),
    )),
    ("Port scan containment", "port_scan", "P2", (
        ("block_ip", True, 900, "sequential port scan", None),
        ("notify", False, None, None, "port scan from {ip}"),
    )),
    ("Privilege escalation response", "privilege_escalation", "P1", (
        ("incident_report", True, None, None, None),
        ("webhook", False, None, None, None),
        ("notify", False, None, None,
         "privilege escalation by {user} on {source} — session NOT terminated"),
    )),
    ("Flagged address containment", "suspicious_ip", "P2", (
        ("block_ip", True, 1800, "address appears on a cached public threat feed", None),
        ("webhook", False, None, None, None),
        ("notify", False, None, None, "connection from flagged address {ip}"),
    )),
)
DEFAULT_TTL_S = 3600
REVIEW_EDGES = (("new", "investigating"), ("investigating", "closed"), ("closed", "investigating"))

# --- Fixed values: ledger -------------------------------------------------------------------------
CANON_V1 = "py-json-sortkeys-ensureascii-defaultsep-v1"
CANON_V2 = "py-json-sortkeys-ensureascii-defaultsep-v2"
CANON_V3 = "py-json-sortkeys-ensureascii-defaultsep-v3"
CANON_V1_FIELDS = (
    "id", "ts_ms", "source", "event", "event_type", "severity",
    "ip", "user", "message", "log_format", "origin",
)
CANON_V2_FIELDS = (*CANON_V1_FIELDS, "dropped")
CANON_V3_FIELDS = (*CANON_V2_FIELDS, "transport_peer_ip")
CANON_FIELDS = {CANON_V1: CANON_V1_FIELDS, CANON_V2: CANON_V2_FIELDS, CANON_V3: CANON_V3_FIELDS}
CANON_FLAGS = ("dropped",)
GENESIS = "0" * 64

# --- Fixed values: baseline profile ---------------------------------------------------------------
PROFILE_FEATURES = ("failed_attempts_count", "request_frequency", "ip_reputation_score")
PROFILE_SCALE_FLOORS = {
    "failed_attempts_count": 1.0,
    "request_frequency": 1.0,
    "ip_reputation_score": 0.05,
}
MAD_FACTOR = 1.4826
PROFILE_THRESHOLD = 1.0

# --- Fixed values: template mining and grouping floors ----------------------------------------------
TEMPLATE_SIMILARITY = 0.4
TEMPLATE_MAX_CHILDREN = 100
GROUPING_FLOORS = {"HDFS": (0.98, 40), "OpenSSH": (0.65, 60)}

# --- Fixed values: dashboard and scorer limits -------------------------------------------------------
SEARCH_COLUMNS = ("message", "ip", "user", "event", "source", "severity", "origin")
RECENT_WINDOW = 200
RATE_WINDOW_S = 60
STAGE_SAMPLES = 512
TRACKED_BLOCKS = 20_000
LIFETIME_COUNTERS = ("events", "alerts", "blocks", "soar")
NOTE_MAX_CHARS = 500

# --- Fixed values: enumerations checked by the table constraints ------------------------------------
ENUMS = {
    "severity": SEVERITIES,
    "status": ("open", "contained", "mitigated", "action_failed", "closed"),
    "review_status": ("new", "investigating", "closed"),
    "shadow_status": ("scored", "unavailable", "skipped"),
    "execution_mode": ("simulated", "live"),
    "step_status": ("executed", "failed", "skipped", "selected"),
}
