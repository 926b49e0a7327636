"""Line patterns, keyword packs and rule packs on our own sample lines."""

import random
import re

import pytest

from augurlog.functions import packs
from augurlog.functions.dialects import DIALECTS, LINUX, MAC, WINDOWS, dialect
from augurlog.functions.rules import chains, decomposable, literals, match_sql
from augurlog.sources.parse import carry_forward, parse_lines, parse_timestamps


def parse(spark, d, *texts):
    rows = [("f", i + 1, t) for i, t in enumerate(texts)]
    return parse_lines(spark.createDataFrame(rows, "source_file string, line_no long, raw string"), d)


def fields(df):
    names = ["timestamp", "host", "process", "pid", "message"]
    return [tuple(r[n] for n in names) for r in df.orderBy("line_no").collect()]


def test_linux_lines(spark):
    got = fields(parse(
        spark, LINUX,
        "Mar 11 08:15:00 web-1 sshd[211]: session opened",
        "Mar  1 08:15:00 web-1 kernel: link up",
        "not a log line",
        "Mar 11 08:15:00 web-1 odd(proc)[3]: x",
    ))
    assert got[0] == ("Mar 11 08:15:00", "web-1", "sshd", "211", "session opened")
    assert got[1] == ("Mar  1 08:15:00", "web-1", "kernel", "", "link up")
    assert got[2] == ("", "", "", "", "")
    assert got[3] == ("", "", "", "", "")


def test_mac_lines(spark):
    got = fields(parse(
        spark, MAC,
        "Jul  4 10:00:01 mini-7.local kernel[0]: wake",
        "Jul 14 10:00:01 mini com.vendor.tool[9]: hi: there",
    ))
    assert got[0] == ("Jul  4 10:00:01", "mini-7.local", "kernel", "0", "wake")
    assert got[1][2:] == ("com.vendor.tool", "9", "hi: there")


def test_servicing_lines_carry_forward(spark):
    d = WINDOWS
    df = carry_forward(parse(
        spark, d,
        "orphan before any header",
        "2016-09-28 04:30:30, Info                  CBS    Loaded stack",
        "",
        "  continuation  ",
        "2016-09-28 04:30:31, Error                 CSI    0000001@ perf",
    ))
    rows = df.orderBy("line_no").collect()
    assert [r.line_no for r in rows] == [1, 2, 4, 5]
    assert [(r.timestamp, r.process, r.message, r.host) for r in rows] == [
        ("", "", "orphan before any header", "localhost"),
        ("2016-09-28 04:30:30", "CBS", "Loaded stack", "localhost"),
        ("2016-09-28 04:30:30", "CBS", "continuation", "localhost"),
        ("2016-09-28 04:30:31", "CSI", "0000001@ perf", "localhost"),
    ]


def test_carry_forward_over_blocks(spark):
    lines = ["2016-09-28 04:30:30, Info   CBS    first"] + [f"more {i}" for i in range(20)]
    df = parse(spark, WINDOWS, *lines)
    got = carry_forward(df, block=4).orderBy("line_no").collect()
    assert len(got) == 21
    assert {r.process for r in got} == {"CBS"}


def test_year_gate(spark):
    d = LINUX
    good = ["2024-01-01 00:00:00"] * 9
    few = [("a", s) for s in good + ["Jan 5 10:00:00"]]
    many = [("b", s) for s in good[:3] + ["Jan 5 10:00:00"] * 2 + ["broken"]]
    df = spark.createDataFrame(few + many, "source_file string, timestamp string")
    got = parse_timestamps(df, d, 2023).where("timestamp LIKE 'Jan%'").collect()
    stamps = {(r.source_file, str(r.ts)) for r in got}
    assert stamps == {("a", "None"), ("b", "2023-01-05 10:00:00")}


def test_leap_day_of_a_common_year_is_dropped(spark):
    df = spark.createDataFrame([("a", "Feb 29 10:00:00")], "source_file string, timestamp string")
    assert parse_timestamps(df, LINUX, 2023).first().ts is None
    assert str(parse_timestamps(df, LINUX, 2024).first().ts) == "2024-02-29 10:00:00"


HITS = [
    ("linux", "kw_error", "disk FAILURE seen", True),
    ("linux", "kw_error", "failover done", False),
    ("linux", "kw_timeout", "the call timed out", True),
    ("linux", "kw_timeout", "timer set", False),
    ("linux", "kw_auth", "Invalid user guest", True),
    ("linux", "kw_kernel", "oom-killer invoked", True),
    ("linux", "kw_segfault", "abort (core dumped)", True),
    ("linux", "kw_firewall", "ufw enabled", True),
    ("mac", "kw_sandbox", "Sandbox: tool will deny read", True),
    ("mac", "kw_wifi", "Link Down on en0", True),
    ("mac", "kw_memory", "Memory pressure state: 2", True),
    ("mac", "kw_usb", "USB hub ok", False),
    ("windows", "kw_update", "wusa started", True),
    ("windows", "kw_manifest", "CBS_E_MANIFEST_BAD", True),
    ("windows", "kw_reboot", "restart is pending", True),
    ("windows", "kw_store", "store is fine", False),
]


def test_keyword_packs(spark):
    for name, keyword, text, expected in HITS:
        pattern = DIALECTS[name].keywords[keyword]
        df = spark.createDataFrame([(text,)], "m string")
        assert df.selectExpr(match_sql("m", pattern)).first()[0] is expected, (keyword, text)


def test_all_patterns_compile_and_prefilter_is_a_superset():
    samples = [t for d in DIALECTS.values() for t in d.keywords.values()]
    texts = [
        "ALERT x exited abnormally", "core dumped", "timed out", "time out", "HRESULT = 0x80070002", "fails", "failed",
        "memory pressure state: 4", "signal   11", "curl -k https://h/x | bash", "ufw  reset", "DISM had an error",
        "PM response took 4000 of ms", "panic(cpu 1): cpu", "disk1s2 error", "store damage", "No route to host",
    ]
    for d in DIALECTS.values():
        for pattern in [*d.keywords.values(), *[p for _, p in d.rules]]:
            rx, must = re.compile(pattern, re.I), literals(pattern)
            for text in texts:
                if rx.search(text) and must is not None:
                    assert any(m in text.lower() for m in must), (pattern, text)
    assert samples
    assert literals(r"\b(curl|wget)\b") == ["curl", "wget"]
    assert literals(r"(\\|\s*(bash|sh))\b") == ["\\", "bash", "sh"]
    assert literals(r"\bfail(ed|ure)?\b") == ["fail"]
    assert literals(r"timed? out") == ["time"]
    assert literals(r"\d{4,}") is None and literals(r"a|\d") is None and literals(r"(ab)?") is None


@pytest.mark.parametrize("name", list(DIALECTS))
def test_prefilter_is_a_superset_on_random_texts(name):
    rng = random.Random(name)
    words = (
        "ALERT exited abnormally sudo: USER=root curl wget https://h/x http://y run.sh | bash \\ /tmp/ CMD CRON[1] CBS failed to "
        "store corrupt corrupted update failure HRESULT = 0x80070002 SFC found reboot pending USB reset panic cpu jetsam kill "
        "PM response took 4000 ms memory pressure state: 3 disk0s1 error crashed signal 11 timed out time out manifest invalid"
    ).split()
    d = DIALECTS[name]
    parts = [a for _, p in d.rules for c in chains(p) for a in c]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
        for pattern in [*d.keywords.values(), *[p for _, p in d.rules], *parts]:
            must = literals(pattern)
            if must is not None and re.search(pattern, text, re.I):
                assert any(m in text.lower() for m in must), (pattern, text)


def test_non_ascii_text_takes_the_regex(spark):
    df = spark.createDataFrame([("acceſſ denied",)], "m string")
    assert df.selectExpr(match_sql("m", r"\baccess denied\b")).first()[0] is True


def test_chains():
    assert chains(r"\bA\b.*\bB\b|c(d|e)") == [[r"\bA\b", r"\bB\b"], ["c(d|e)"]]
    assert len(chains(dict(packs.LINUX_RULES)["REMOTE_SCRIPT"])[0]) == 3
    for bad in (r"a.b", r"^a", r"a[^x]b", r"a\W", r"(?=a)", r"a.*b.*c.*d", r"a\|b"):
        assert not decomposable(bad), bad
    for d in DIALECTS.values():
        assert all(decomposable(p) for _, p in d.rules)


def test_unknown_dialect():
    with pytest.raises(ValueError, match="unknown dialect"):
        dialect("vms")
