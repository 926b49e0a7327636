"""Line patterns, keyword packs, rule packs and stage defaults.

Everything in this module is data that decides results, so it is stated as
plain text.  The logic that applies it lives in ``rules.py`` and ``dialects.py``.
"""

# --- fixed values: line patterns -------------------------------------------
# Group order: linux/mac = timestamp, host, process, pid, message;
#              windows   = timestamp, level, component, message.

LINUX_LINE = (
    r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
    r"([A-Za-z0-9_.-]+)(?:\[(\d+)\])?:\s*(.*)$"
)
MAC_LINE = (
    r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
    r"([A-Za-z0-9_.:-]+)(?:\[(\d+)\])?:\s*(.*)$"
)
WINDOWS_LINE = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}),\s*(\w+)\s+(\w+)\s+(.*)$"

# --- fixed values: keyword packs -------------------------------------------

LINUX_KEYWORDS = {
    "kw_error": r"\berror\b|\bfail(ed|ure)?\b|\bdenied\b|\bcritical\b|\bpanic\b",
    "kw_timeout": r"\btimeout\b|\btimed? out\b|\bNo route to host\b|\bConnection refused\b",
    "kw_auth": r"\bFailed password\b|\binvalid user\b|\bauthentication failure\b|\bpossible break-in attempt\b",
    "kw_kernel": r"\boom-killer\b|\bOut of memory\b|\bKernel panic\b",
    "kw_segfault": r"\bsegfault\b|\bcore dumped\b",
    "kw_firewall": r"\bUFW\b|\biptables\b",
}

MAC_KEYWORDS = {
    "kw_error": r"\berror\b|\bfail(ed|ure)?\b|\bdenied\b|\bcritical\b",
    "kw_sandbox": r"\bSandbox\b.*\bdeny\b|\bSandbox violation\b",
    "kw_kernel": r"\bkernel panic\b|\bKernel panic\b|\bpanic\b.*\bcpu\b",
    "kw_power": r"\bSleep\b|\bWake\b|\bpower\b.*\bstate\b|\bthermal pressure\b|\bpowerChange\b",
    "kw_wifi": r"\bLink Down\b|\bAirPort\b.*\b(error|fail)\b|\bchannel changed\b|\bdisassociated\b",
    "kw_disk": r"\bdisk\d+s\d+\b.*\berror\b|\bI/O error\b|\bfilevault\b|\bRead-only file system\b",
    "kw_memory": r"\bmemory pressure\b|\bjetsam\b|\bVM Compressor\b|\bMemory pressure state:\s*[1-9]\b",
    "kw_bluetooth": r"\bBluetooth\b.*\b(error|fail|disconnect)\b|Bluetooth --",
    "kw_usb": r"\bUSB\b.*\b(error|fail|disconnect)\b|\bIOUSB\b",
    "kw_thunderbolt": r"\bThunderbolt\b.*\b(error|fail)\b|\bIOThunderbolt\b",
}

WINDOWS_KEYWORDS = {
    "kw_error": r"\berror\b|\bfail(ed|ure)?\b|\bE_FAIL\b|\bHRESULT\b.*0x8",
    "kw_warning": r"\bwarning\b|\bcaution\b",
    "kw_update": r"\bWindowsUpdateAgent\b|\bWindows Update\b|\bwusa\b",
    "kw_service": r"\bTrustedInstaller\b|\bservice\b.*\b(start|stop|fail)\b",
    "kw_manifest": r"CBS_E_MANIFEST|INVALID_ITEM|\bmanifest\b.*\berror\b",
    "kw_corruption": r"\bcorrupt(ed|ion)?\b|\brepair\b|\bSFC\b|\bDISM\b",
    "kw_security": r"\baudit\b|\bpolicy\b.*\bfail\b|\baccess denied\b|\bsecurity\b.*\bviolation\b",
    "kw_store": r"\bstore\b.*\b(error|corrupt|fail)\b|\bCSI Store\b",
    "kw_reboot": r"\breboot\b|\brestart\b.*\bpending\b|\bshutdown\b",
}

# --- fixed values: rule packs, first match wins ------------------------------

LINUX_RULES = [
    ("ABNORMAL_EXIT", r"\bALERT\b.*\bexited abnormally\b"),
    ("SEGFAULT", r"\bsegfault\b|\bcore dumped\b"),
    ("AUTH_FAIL", r"\bFailed password\b|\binvalid user\b|\bauthentication failure\b|\bpossible break-in attempt\b"),
    ("SUSP_ROOT", r"Accepted password for root\b"),
    ("PRIV_ESC", r"\bsudo:.*\bUSER=root\b|sudo: pam_open_session.*failure"),
    ("REMOTE_SCRIPT", r"\b(curl|wget)\b.*\bhttps?://.*(\\|\s*(bash|sh)|\\|\s*/bin/bash)\b"),
    ("FIREWALL", r"\bufw\s+(disable|reset)\b|\biptables\s+(-F|DROP|REJECT)\b"),
    ("UFW_BLOCK", r"\[UFW\s+BLOCK\]"),
    ("DISK_ERR", r"\bEXT4-fs error\b|\bBuffer I/O error\b|\bI/O error\b|Read-only file system"),
    ("APPARMOR", r'apparmor="DENIED"'),
    ("SUSP_CRON", r"\bCRON\[\d+\].*CMD.*(\.cache/|/tmp/|python3\s+-c|wget|curl)"),
    ("OOM_KILL", r"\boom-killer\b|\bOut of memory\b"),
    ("KERNEL_PANIC", r"Kernel panic - not syncing"),
    ("NET_REFUSED", r"Connection refused|No route to host|timed? out"),
]

MAC_RULES = [
    ("SANDBOX_DENY", r"\bSandbox\b.*\bdeny\b|\bSandbox violation\b"),
    ("KERNEL_PANIC", r"\bKernel panic\b|\bpanic\b.*\bnot syncing\b|\bpanic\b.*\bcpu\b"),
    (
        "DISK_ERROR",
        r"\bdisk\d+s\d+\b.*\berror\b|\bI/O error\b|\bBuffer I/O error\b"
        r"|\bRead-only file system\b|\bEXT4-fs error\b",
    ),
    (
        "WIFI_FAILURE",
        r"\bLink Down\b.*\bReason\b|\bAirPort\b.*\bfail\b"
        r"|\bwl0\b.*\berror\b|\bNo route to host\b",
    ),
    (
        "MEMORY_PRESSURE",
        r"\bmemory pressure\b.*\bstate:\s*[2-9]\b|\bjetsam\b.*\bkill\b"
        r"|\bVM Compressor\b.*\berror\b",
    ),
    (
        "THERMAL_EVENT",
        r"\bthermal pressure\b.*\bstate:\s*[2-9]\b|\bthermal\b.*\bcritical\b",
    ),
    (
        "APP_CRASH",
        r"\bcrash(ed)?\b|\bSegmentation fault\b|\bcore dumped\b"
        r"|\bsignal\s+11\b|\bASSERTION FAILED\b",
    ),
    (
        "SECURITY_VIOLATION",
        r"\baccess denied\b|\bpermission denied\b"
        r"|\bauthentication\b.*\bfail\b|\bFailed password\b",
    ),
    (
        "NETWORK_ERROR",
        r"\bConnection refused\b|\btimed? out\b|\bnetwork\b.*\bunreachable\b"
        r"|\bDNS\b.*\bfail\b",
    ),
    ("USB_ERROR", r"\bUSB\b.*\b(error|fail|disconnect|reset)\b|\bIOUSB\b.*\berror\b"),
    (
        "MDNS_ERROR",
        r"\bmDNSResponder\b.*\b(error|fail)\b|\bmDNS\b.*\bFrequent transitions\b",
    ),
    ("PM_RESPONSE_SLOW", r"\bPM response took\b.*\b\d{4,}\b.*\bms\b"),
]

WINDOWS_RULES = [
    ("CBS_FAIL", r"\bCBS\b.*\bfail|\bCBS\b.*\berror\b|\bfailed to\b.*\bCBS\b"),
    ("MANIFEST_ERROR", r"CBS_E_MANIFEST|\bmanifest\b.*\b(invalid|error|corrupt)\b"),
    (
        "UPDATE_FAIL",
        r"\bWindows\s*Update\b.*\b(fail|error)\b|\bupdate\b.*\bfail(ed|ure)\b"
        r"|\bHRESULT\s*=\s*0x80(070002|004005|073712|240016)\b",
    ),
    (
        "CORRUPTION",
        r"\bcorrupt(ed|ion)?\b.*\b(store|component|package)\b"
        r"|\bSFC\b.*\b(found|repair|fail)\b"
        r"|\bDISM\b.*\b(error|fail)\b",
    ),
    (
        "STORE_ERROR",
        r"\bstore\b.*\b(corrupt|error|fail|damage)\b"
        r"|\bcomponent store\b.*\b(error|repair)\b",
    ),
    (
        "SERVICE_FAIL",
        r"\bservice\b.*\b(fail|crash|unexpected|stop)\b"
        r"|\bTrustedInstaller\b.*\b(fail|error|crash)\b",
    ),
    (
        "SECURITY_VIOLATION",
        r"\baccess denied\b|\bsecurity\b.*\bviolation\b"
        r"|\bpolicy\b.*\bfail\b|\baudit\b.*\bfail\b",
    ),
    ("HRESULT_ERROR", r"\bHRESULT\s*=\s*0x8[0-9a-fA-F]{7}\b"),
    ("INSTALL_FAIL", r"\binstall(ation)?\b.*\bfail(ed|ure)?\b|\bpackage\b.*\bfail\b"),
    (
        "PENDING_REBOOT",
        r"\breboot\b.*\bpending\b|\bpending\b.*\breboot\b|\brestart\b.*\brequired\b",
    ),
]

# --- fixed values: stage defaults --------------------------------------------

DEFAULT_YEAR = 2026
DEFAULT_WINDOW = "60s"
DEFAULT_HORIZON_MIN = 15
DEFAULT_MIN_LINES = 5
DEFAULT_K_CONFIRM = 3
DEFAULT_TARGET_PRECISION = 0.80
TOP_PROCESSES = 12
TEXT_SEPARATOR = " || "
EXAMPLE_CHARS = 250
FALLBACK_GATE = 0.2
MAX_FEATURES = 50_000
MIN_DF = 2
WINDOWS_HOST = "localhost"
