import random

import pytest

from augurlog.functions.dialects import DIALECTS, Dialect
from augurlog.functions.timestamps import width_seconds
from augurlog.operators import labels, trends, windows


def by_key(df, *cols):
    return {(r.source_file, str(r.bucket)[11:]): tuple(r[c] for c in cols) for r in df.collect()}


def test_counts_text_and_floor(make_lines):
    lines = make_lines([
        ("f", 1, "10:23:45", "a", "one"), ("f", 2, "10:23:59", "b", "two"),
        ("f", 4, "10:24:00", None, "error x"), ("f", 3, "10:24:00", "a", None),
    ])
    w = windows.create_windows(lines, "60s")
    assert by_key(w, "lines", "kw_error", "kw_unique_procs") == {("f", "10:23:00"): (2, 0, 2), ("f", "10:24:00"): (2, 1, 2)}
    text = by_key(windows.window_text(lines, "60s"), "text", "text_with_proc")
    assert text[("f", "10:23:00")] == ("one || two", "a: one || b: two")
    assert text[("f", "10:24:00")] == (" || error x", "a:  || : error x")
    five = windows.create_windows(lines, "5min")
    assert set(by_key(five, "lines")) == {("f", "10:20:00")}


def test_top_processes_ties_and_blank(make_lines):
    rows = [("f", i, "10:00:00", p, "m") for i, p in enumerate(["", "", "b", "a", "c"])]
    lines = make_lines(rows)
    grouped = windows.grouped_lines(lines, "60s", DIALECTS["linux"], keywords=False)
    top = [(r.process, r["rank"]) for r in windows.top_processes(grouped, 3).orderBy("rank").collect()]
    assert top == [("", 1), ("a", 2), ("b", 3)]
    counts = windows.create_windows(lines, "60s", processes=["a", "zz"]).first().proc_counts
    assert counts == {"a": 1}
    wide = windows.widen_processes(windows.create_windows(lines, "60s", processes=["a", "zz"]), ["a", "zz"]).first()
    assert (wide.cnt_proc_a, wide.cnt_proc_zz) == (1, 0)


def test_heads_are_the_text_start(make_lines):
    lines = make_lines([("f", i, f"10:00:{i % 60:02d}", "p", "x" * (i % 7)) for i in range(400)])
    head = windows.window_heads(lines, "1h").first().head
    text = windows.window_text(lines, "1h").first().text_with_proc
    assert head == text[:250]


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="no column ts among id"):
        windows.create_windows(spark.range(1), "60s")


def test_bad_width():
    with pytest.raises(ValueError):
        width_seconds("sixty")


WORDS = {
    "linux": ["ALERT", "exited abnormally", "sudo:", "USER=root", "curl", "https://h/i", "run.sh", "ok", "CMD", "/tmp/x", "timed out", "wget", "push"],
    "mac": ["PM response took", "1500", "ms", "panic", "cpu", "jetsam", "kill", "USB", "reset", "ok", "mDNS", "Frequent transitions", "99"],
    "windows": ["CBS", "failed to", "store", "corrupt", "reboot", "pending", "policy", "fail", "ok", "package", "manifest", "invalid"],
}


@pytest.mark.parametrize("name", list(DIALECTS))
def test_labels_without_text_equal_labels_of_text(make_lines, name):
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        words = [rng.choice(WORDS[name]) if rng.random() < 0.25 else "calm" for _ in range(rng.randint(1, 3))]
        rows.append((f"f{rng.randint(0, 2)}", i, f"{rng.randint(0, 23):02d}:{rng.randint(0, 11) * 5:02d}:00", rng.choice(["sudo", "CBS", "p"]), " ".join(words)))
    lines = make_lines(rows)
    pushed = by_key(labels.label_windows(lines, "5min", name), "window_label", "window_is_anomaly")
    joined = by_key(labels.label_text(windows.window_text(lines, "5min"), name), "window_label", "window_is_anomaly")
    assert pushed == joined
    assert len({v[0] for v in pushed.values()}) > 3


def test_three_part_chain_is_settled_by_a_middle_between_outer_ones(make_lines):
    d = Dialect("t", ".*", {}, (("R", r"aa.*bb.*cc"),))
    def label(messages):
        lines = make_lines([("f", i, "10:00:00", "p", m) for i, m in enumerate(messages)])
        return labels.label_windows(lines, "60s", d).first().window_label

    assert label(["bb", "aa", "bb", "cc", "bb"]) == "R"
    assert label(["bb", "aa", "cc", "bb"]) == "NORMAL"
    assert label(["aa bb", "cc"]) == "R"
    assert label(["aa", "bb cc"]) == "R"
    assert label(["cc", "bb", "aa"]) == "NORMAL"


def test_rules_that_need_the_text_are_labelled_by_it(make_lines):
    d = Dialect("t", ".*", {}, (("START", r"^p: start"), ("FOUR", r"aa.*bb.*cc.*dd")))

    def label(*messages):
        lines = make_lines([("f", i, "10:00:00", "p", m) for i, m in enumerate(messages)])
        row = labels.label_windows(lines, "60s", d).first()
        return row.window_label, row.window_is_anomaly, row.lines

    assert label("m") == ("NORMAL", 0, 1)
    assert label("start", "aa") == ("START", 1, 2)
    assert label("aa", "bb", "cc", "dd") == ("FOUR", 1, 4)
    assert label("aa", "cc", "bb", "dd") == ("NORMAL", 0, 4)


def test_label_text_null_empty_and_first_rule_wins(spark):
    df = spark.createDataFrame([(None,), ("",), ("segfault then Out of memory",)], "text_with_proc string")
    assert [r.window_label for r in labels.label_text(df).collect()] == ["NORMAL", "NORMAL", "SEGFAULT"]


def test_trends_and_roles(spark):
    rows = [("f", f"2024-01-01 00:0{i}:00", i + 1, i + 1) for i in range(5)]
    df = spark.createDataFrame(rows, "source_file string, b string, lines long, kw_error long")
    df = df.selectExpr("source_file", "CAST(b AS TIMESTAMP_NTZ) AS bucket", "lines", "kw_error")
    out = trends.add_trends(df).orderBy("bucket").collect()
    assert [r.kw_error_roll3_mean for r in out] == [1, 1.5, 2, 3, 4]
    assert [r.kw_error_roll6_sum for r in out] == [1, 3, 6, 10, 15]
    assert [r.kw_error_diff1 for r in out] == [0, 1, 1, 1, 1]
    names = trends.numeric_features(trends.add_trends(df))
    assert names == ["kw_error", "kw_error_roll3_mean", "kw_error_roll6_sum", "kw_error_diff1", "lines"]
    assert trends.expected_inputs(["cnt_proc_a b_diff1", "kw_error_roll6_sum", "lines"]) == (["a b"], ["kw_error"])
    aligned = trends.align_features(df, ["kw_error", "kw_gone"]).first()
    assert (aligned.kw_error, aligned.kw_gone) == (1.0, 0.0)
