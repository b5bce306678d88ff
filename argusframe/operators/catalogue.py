"""The shipped rules."""

from __future__ import annotations

from .rules import Rule


def _r(rule_id, severity, *groups, kind="detection", mitre=(), **more):
    return Rule(rule_id, severity, groups, kind, mitre=mitre, **more)


# Conditions of the shipped detection rules.
DETECTION = [
    _r("AUTH-001", "medium", (("event_type", "eq", "authentication"), ("action", "eq", "logon_failed")),
       (("message", "regex", "failed password|authentication failure|invalid user"), ("product", "in", ["sshd", "ssh", "login"])), mitre=("T1110",), suppress=60),
    _r("AUTH-002", "high", (("source_user", "eq", "root"), ("action", "in", ["logon", "logon_explicit"]), ("result", "eq", "success")), mitre=("T1078",)),
    _r("AUTH-003", "medium", (("source_country", "exists", True), ("source_is_internal", "eq", False), ("source_country", "in", ["Russia", "China", "North Korea", "Iran"])), mitre=("T1078",)),
    _r("AUTH-004", "low", (("action", "in", ["logon", "logon_explicit"]), ("result", "eq", "success"), ("source_user", "regex", "admin|root|administrator"))),
    _r("AUTH-005", "high", (("action", "eq", "user_disabled"), ("message", "contains", "lock")), (("event_type", "eq", "authentication"), ("message", "regex", "account.*lock|lockout"))),
    _r("PRIV-001", "medium", (("action", "eq", "execute"), ("product", "eq", "sudo")), (("message", "contains", "sudo"), ("command_line", "exists", True)), mitre=("T1548.003",)),
    _r("PRIV-002", "high", (("action", "eq", "user_created"),), (("event_type", "eq", "authorization"), ("message", "contains", "account"), ("message", "contains", "creat")), mitre=("T1136",)),
    _r("PRIV-003", "high", (("action", "eq", "member_added"),), (("message", "regex", "(admin|root|wheel|sudo|domain admins)"),), mitre=("T1098",)),
    _r("MAL-001", "critical", (("event_type", "eq", "av_malware"),),
       (("message", "regex", "(virus|malware|trojan|worm|ransomware|backdoor)"), ("action", "in", ["alert", "detect"])), mitre=("T1204", "T1055")),
    _r("MAL-002", "critical", (("ioc_matched", "exists", True), ("file_hash", "exists", True)), kind="threat_intel"),
    _r("MAL-003", "high", (("file_path", "regex", r"/tmp/|/var/tmp/|C:\\Temp|C:\\Users.*\\AppData.*\\Temp"), ("file_name", "regex", r"\.(exe|dll|sh|bat|ps1|vbs|js)$")), mitre=("T1105", "T1059")),
    _r("NET-001", "high", (("ioc_matched", "exists", True), ("dest_ip", "exists", True)), kind="threat_intel", mitre=("T1071",)),
    _r("NET-002", "high", (("dest_port", "eq", 3389), ("source_is_internal", "eq", False)), mitre=("T1021.001",)),
    _r("NET-003", "high", (("event_type", "eq", "dns"), ("ioc_matched", "exists", True)), kind="threat_intel"),
    _r("NET-004", "medium", (("direction", "eq", "outbound"), ("dest_port", "not_in", [80, 443, 53, 25, 587, 993, 995, 123, 22]), ("source_is_internal", "eq", True))),
    _r("WEB-001", "high", (("uri_path", "regex", r"(union|select|insert|drop|update|delete).*from|;|--|/\*"),), (("query_string", "regex", r"(union|select|insert|drop).*from|;|--|/\*|xp_cmdshell"),), mitre=("T1190",)),
    _r("WEB-002", "high", (("uri_path", "regex", "<script|javascript:|onerror=|onload=|<iframe|<embed|<object"),),
       (("query_string", "regex", r"<script|javascript:|onerror=|onload=|alert\(|document\.cookie"),), mitre=("T1185",)),
    _r("WEB-003", "high", (("uri_path", "regex", r"\.\./|\.\.%2f|%2e%2e|/etc/passwd|/etc/shadow|\.\.%5c"),)),
    _r("WEB-004", "low", (("user_agent", "regex", "(sqlmap|nikto|nmap|masscan|nessus|acunetix|burp|zap|w3af|dirbuster|gobuster)"),)),
    _r("SYS-001", "critical", (("action", "eq", "log_cleared"),), (("rule_id", "eq", "1102"),), (("message", "contains", "audit log"), ("message", "contains", "clear")), mitre=("T1070.001",)),
    _r("SYS-002", "medium", (("action", "eq", "service_installed"),), (("rule_id", "eq", "7045"),), mitre=("T1543.003",)),
    _r("SYS-003", "medium", (("action", "eq", "task_created"),), (("rule_id", "eq", "4698"),), mitre=("T1053.005",)),
    _r("PSH-001", "high", (("command_line", "regex", "-enc|-encodedcommand|JAB|AGQAcgB"),), (("command_line", "regex", "-e |-ec |-EncodedCommand"), ("process_name", "regex", "powershell|pwsh")), mitre=("T1059.001", "T1027")),
    _r("PSH-002", "high", (("command_line", "regex", r"(Invoke-WebRequest|iex|Invoke-Expression|Net\.WebClient|DownloadString|DownloadFile|Start-BitsTransfer)"),), mitre=("T1059.001", "T1105")),
    _r("PSH-003", "medium", (("command_line", "regex", "ExecutionPolicy Bypass|-ep bypass|-exec bypass"),)),
]


def _c(rule_id, severity, window, threshold, group_by, *groups, mitre=()):
    return Rule(rule_id, severity, groups, "correlation", window=window, threshold=threshold, group_by=group_by, mitre=mitre)


# Conditions, windows and thresholds of the shipped correlation rules.
CORRELATION = [
    _c("CORR-001", "high", 300, 10, ("source_ip",), (("action", "eq", "logon_failed"), ("product", "in", ["sshd", "ssh"])), mitre=("T1110.001",)),
    _c("CORR-002", "high", 600, 5, ("source_ip", "source_user"), (("rule_id", "eq", "4625"),), (("event_type", "eq", "authentication"), ("result", "eq", "failure")), mitre=("T1110.001",)),
    _c("CORR-003", "critical", 900, 5, ("source_user",), (("action", "eq", "logon_failed"),), mitre=("T1110.003",)),
    _c("CORR-004", "medium", 120, 20, ("source_ip",), (("event_type", "in", ["network", "firewall"]), ("action", "in", ["connect", "deny", "accept"])), mitre=("T1046",)),
    _c("CORR-005", "medium", 300, 10, ("source_ip",), (("event_type", "in", ["network", "firewall"]),), mitre=("T1046",)),
    _c("CORR-006", "high", 600, 5, ("source_ip", "dest_ip"), (("direction", "eq", "outbound"), ("bytes_sent", "gt", 10485760)), mitre=("T1041", "T1048")),
    _c("CORR-007", "high", 300, 100, ("source_ip", "dns_query"), (("event_type", "eq", "dns"),), mitre=("T1071.004", "T1572")),
    _c("CORR-008", "high", 600, 10, ("source_ip",), (("source_is_internal", "eq", True), ("dest_is_internal", "eq", True), ("event_type", "in", ["authentication", "network"])), mitre=("T1021",)),
    _c("CORR-009", "high", 300, 5, ("source_ip",), (("event_type", "eq", "authentication"), ("result", "eq", "success")), mitre=("T1550.002",)),
    _c("CORR-010", "high", 3600, 30, ("source_ip", "dest_ip"), (("dest_is_internal", "eq", False), ("source_is_internal", "eq", True), ("event_type", "in", ["network", "dns"])), mitre=("T1071", "T1573")),
    _c("CORR-011", "critical", 300, 100, ("source_host",), (("event_type", "eq", "file"), ("action", "in", ["modify", "write", "create"])), mitre=("T1486",)),
    _c("CORR-012", "high", 600, 3, ("source_ip",), (("action", "in", ["execute", "user_created", "member_added", "policy_changed"]), ("source_user", "regex", "admin|root|system")), mitre=("T1068", "T1548")),
    _c("CORR-013", "high", 600, 5, ("source_ip",), (("action", "in", ["user_created", "user_deleted", "user_disabled", "password_reset", "member_added"]),), mitre=("T1098", "T1136")),
    _c("CORR-014", "medium", 60, 50, ("source_ip",), (("event_type", "eq", "firewall"), ("action", "eq", "deny")), mitre=("T1498", "T1499")),
    _c("CORR-015", "critical", 1800, 3, ("file_hash",), (("event_type", "eq", "av_malware"),), mitre=("T1204",)),
]
RULES = DETECTION + CORRELATION
