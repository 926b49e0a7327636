"""SQL that states the expected rows of the registered queries (DuckDB dialect)."""

from __future__ import annotations

from augurlog.functions import packs
from augurlog.functions.dialects import DIALECTS
from augurlog.operators.alerts import grid_levels
from augurlog.plans.queries import HORIZON_MIN, K, LIVE_INTERCEPT, LIVE_NUMERIC, LIVE_TERMS, MIN_LINES, PIVOT, SEQ_LEN, THRESHOLD, WIDTH_SEC
from augurlog.sources.event_lines import rendered_year, sql_lines, sql_rendered

SEP = packs.TEXT_SEPARATOR
YEAR = rendered_year()


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def bucket(ts: str = "ts") -> str:
    return f"time_bucket(INTERVAL '{WIDTH_SEC} seconds', {ts})"


def with_(**ctes: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n"


def keyword_cols(d) -> str:
    return ", ".join(
        f"count(*) FILTER (regexp_matches(message, {q(p)}, 'i')) AS {k}" for k, p in d.keywords.items()
    )


def label_case(d, text: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({text}, {q(p)}, 'i') THEN {q(n)}" for n, p in d.rules)
    return f"CASE {arms} ELSE 'NORMAL' END"


def windows_sql(name: str) -> str:
    d = DIALECTS[name]
    return f"""SELECT source_file, {bucket()} AS bucket, count(*) AS lines, {keyword_cols(d)},
               count(DISTINCT process) AS kw_unique_procs
               FROM ({sql_lines(name)}) GROUP BY 1, 2"""


def text_sql(name: str) -> str:
    return f"""SELECT source_file, {bucket()} AS bucket, count(*) AS lines,
               string_agg(message, {q(SEP)} ORDER BY ts, line_no) AS text,
               string_agg(process || ': ' || message, {q(SEP)} ORDER BY ts, line_no) AS text_with_proc
               FROM ({sql_lines(name)}) GROUP BY 1, 2"""


def labelled_sql(name: str) -> str:
    label = label_case(DIALECTS[name], "text_with_proc")
    return f"""SELECT source_file, bucket, lines, CAST(window_label <> 'NORMAL' AS INT) AS window_is_anomaly, window_label
               FROM (SELECT *, {label} AS window_label FROM ({text_sql(name)}))"""


FLAGGED = f"SELECT *, CAST(line_no % 97 = 5 AS INT) AS is_anomaly FROM ({sql_lines()})"

ANOMALY = f"""SELECT source_file, {bucket()} AS bucket, max(is_anomaly) AS window_is_anomaly
              FROM ({FLAGGED}) GROUP BY 1, 2"""


def future_sql(table: str) -> str:
    return f"""SELECT *, coalesce(max(window_is_anomaly) OVER (PARTITION BY source_file ORDER BY bucket
               RANGE BETWEEN INTERVAL '1 second' FOLLOWING AND INTERVAL '{HORIZON_MIN} minutes' FOLLOWING), 0) AS y_future,
               {HORIZON_MIN} AS horizon_min FROM ({table})"""


SCORES = f"""SELECT source_file, bucket, lines, window_is_anomaly, y_future AS y_true,
             cents / (cents + CAST(20000 AS DOUBLE)) AS proba
             FROM ({future_sql(f'''SELECT source_file, {bucket()} AS bucket, count(*) AS lines,
                 max(is_anomaly) AS window_is_anomaly, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS cents
                 FROM ({FLAGGED}) GROUP BY 1, 2''')})"""

PREDICTIONS = f"""SELECT *, CAST(coalesce(sum(predict_raw) OVER (PARTITION BY source_file ORDER BY bucket
                  ROWS BETWEEN {K - 1} PRECEDING AND CURRENT ROW), 0) >= {K} AS INT) AS predict_confirmed
                  FROM (SELECT *, CAST(proba >= {THRESHOLD} AS INT) AS predict_raw FROM ({SCORES})) WHERE lines >= {MIN_LINES}"""

RISES = f"""SELECT *, CAST(predict_confirmed = 1 AND coalesce(lag(predict_confirmed) OVER
            (PARTITION BY source_file ORDER BY bucket), 1) = 0 AS INT) AS rise FROM ({PREDICTIONS})"""


def parsed_sql(name: str) -> str:
    """Fields of rendered syslog lines."""
    p = q(DIALECTS[name].line_pattern)
    f = lambda i: f"regexp_extract(raw, {p}, {i})"
    return f"""SELECT *, try_strptime(timestamp || ' {YEAR}', '%b %d %H:%M:%S %Y') AS ts FROM (
               SELECT source_file, line_no, {f(1)} AS timestamp, {f(2)} AS host, {f(3)} AS process, {f(4)} AS pid,
               {f(5)} AS message, raw, regexp_matches(raw, {p}) AS ok FROM ({sql_rendered(name)}))"""


def cbs_sql() -> str:
    p = q(packs.WINDOWS_LINE)
    f = lambda i: f"trim(regexp_extract(raw, {p}, {i}))"
    carried = lambda c: (
        f"coalesce(last_value(CASE WHEN ok THEN {c} END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY line_no "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '')"
    )
    return f"""SELECT *, try_strptime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts FROM (
               SELECT source_file, line_no, {carried('t')} AS timestamp, {q(packs.WINDOWS_HOST)} AS host,
               {carried('p')} AS process, '' AS pid, CASE WHEN ok THEN m ELSE trim(raw) END AS message, raw
               FROM (SELECT *, regexp_matches(raw, {p}) AS ok, {f(1)} AS t, {f(3)} AS p, {f(4)} AS m
                     FROM ({sql_rendered('windows')})))"""


FIELDS = "source_file, line_no, timestamp, host, process, pid, message, raw, ts"


def report_sql(table: str, pred: str) -> str:
    return f"""
    WITH c AS (SELECT CAST(count(*) FILTER (y_true = 0 AND {pred} = 0) AS DOUBLE) c00, CAST(count(*) FILTER (y_true = 0 AND {pred} = 1) AS DOUBLE) c01,
                      CAST(count(*) FILTER (y_true = 1 AND {pred} = 0) AS DOUBLE) c10, CAST(count(*) FILTER (y_true = 1 AND {pred} = 1) AS DOUBLE) c11
               FROM ({table})),
    pc AS (SELECT '0' AS label, coalesce(c00 / nullif(c00 + c10, 0), 0) p, coalesce(c00 / nullif(c00 + c01, 0), 0) r, c00 + c01 AS s FROM c
           UNION ALL SELECT '1', coalesce(c11 / nullif(c01 + c11, 0), 0), coalesce(c11 / nullif(c10 + c11, 0), 0), c10 + c11 FROM c),
    pf AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) f FROM pc),
    acc AS (SELECT coalesce((c00 + c11) / nullif(c00 + c01 + c10 + c11, 0), 0) a, c00 + c01 + c10 + c11 AS n FROM c),
    u AS (SELECT label, p, r, f, s FROM pf
          UNION ALL SELECT 'accuracy', a, a, a, n FROM acc
          UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM pf
          UNION ALL SELECT 'weighted avg', coalesce(sum(p * s) / nullif(sum(s), 0), 0), coalesce(sum(r * s) / nullif(sum(s), 0), 0),
                 coalesce(sum(f * s) / nullif(sum(s), 0), 0), sum(s) FROM pf)
    SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(s AS BIGINT) AS support FROM u"""


CURVE = f"""SELECT threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, pos,
            (SELECT count(*) FROM ({SCORES}) WHERE y_true = 1) AS positives
            FROM (SELECT proba AS threshold, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg
                  FROM ({SCORES}) GROUP BY 1) WINDOW w AS (ORDER BY threshold DESC)"""

CURVE_PR = f"SELECT *, tp / CAST(tp + fp AS DOUBLE) AS precision, coalesce(tp / nullif(CAST(positives AS DOUBLE), 0), 0) AS recall FROM ({CURVE})"


def threshold_sql(target: float | None, policy: str) -> str:
    met = f"(SELECT min(threshold) FROM ({CURVE_PR}) WHERE precision >= {target})" if target is not None else "NULL"
    fallback = f"(SELECT threshold FROM ({CURVE_PR}) ORDER BY precision * recall DESC, threshold LIMIT 1)"
    ok = f"{met} IS NOT NULL" if target is not None else "true"
    return f"SELECT round(coalesce({met}, {fallback}), 6) AS threshold, {q(policy)} AS policy, {ok} AS met_target"


# Every grid threshold against every window: the plain definition of calibration.
CALIBRATION = f"""
    WITH s AS MATERIALIZED ({SCORES}),
    g AS (SELECT DISTINCT unnest(quantile_cont(proba, [{', '.join(map(repr, grid_levels()))}])) AS threshold FROM s),
    raw AS (SELECT g.threshold, s.*, CAST(proba >= g.threshold AS INT) AS y FROM s, g),
    conf AS (SELECT *, CAST(count(*) OVER w = {K} AND sum(y) OVER w = {K} AS INT) AS c FROM raw
             WINDOW w AS (PARTITION BY threshold, source_file ORDER BY bucket ROWS BETWEEN {K - 1} PRECEDING AND CURRENT ROW)),
    edge AS (SELECT *, CAST(c = 1 AND coalesce(lag(c) OVER (PARTITION BY threshold, source_file ORDER BY bucket), 1) = 0 AS INT) AS rise FROM conf),
    day AS (SELECT threshold, CAST(bucket AS DATE) AS d, sum(rise) AS rises FROM edge GROUP BY 1, 2),
    apd AS (SELECT threshold, avg(rises) AS alerts_per_day FROM day GROUP BY 1),
    cnt AS (SELECT threshold, count(*) FILTER (c = 1 AND y_true = 1) AS tp, count(*) FILTER (c = 1 AND y_true = 0) AS fp,
                   count(*) FILTER (c = 0 AND y_true = 1) AS fn FROM edge GROUP BY 1)
    SELECT threshold, alerts_per_day, tp, fp, fn, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision_k,
           coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall_k FROM apd JOIN cnt USING (threshold)"""
CALIBRATION_COLS = """round(threshold, 6) AS threshold, round(alerts_per_day, 6) AS alerts_per_day, tp, fp, fn,
    round(precision_k, 6) AS precision_k, round(recall_k, 6) AS recall_k"""


def tfidf_ctes(docs: str, key: str, text: str, limit: int) -> dict[str, str]:
    """Term weights from whole texts: tokens, pairs, vocabulary, unit length."""
    return {
        "docs": docs,
        "tok": f"SELECT {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS u FROM docs",
        "terms": f"""SELECT {key}, unnest(list_concat(u, CASE WHEN len(u) > 1
                     THEN list_transform(range(1, len(u)), lambda k: u[k] || ' ' || u[k + 1]) ELSE [] END)) AS term FROM tok""",
        "counts": f"SELECT {key}, term, count(*) AS tf FROM terms GROUP BY ALL",
        "vocab": f"""SELECT term, count(*) AS df, sum(tf) AS cf, ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + count(*))) + 1.0 AS idf
                     FROM counts GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT {limit}""",
        "kept": f"SELECT {key}, term, tf, tf * idf AS w FROM counts JOIN vocab USING (term)",
        "norms": f"SELECT {key}, sqrt(sum(w * w)) AS nrm FROM kept GROUP BY {key}",
        "weights": f"SELECT {key}, term, tf, w / nrm AS weight FROM kept JOIN norms USING ({key})",
    }


def tfidf_sql(docs: str, key: str, text: str, limit: int) -> str:
    return with_(**tfidf_ctes(docs, key, text, limit)) + f"SELECT {key}, term, tf, round(weight, 6) AS weight FROM weights"


KEY = "source_file, bucket"


def explained(extra: dict[str, str]) -> str:
    """The fixed model of ``queries.fixed_model`` over window text, in dense form."""
    ctes = tfidf_ctes(text_sql("linux"), KEY, "text_with_proc", 50000)
    ctes["vocab"] = ctes["vocab"].replace("SELECT term,", "SELECT term, ((length(term) * 7 + ascii(term)) % 11 - 5) / 10.0 AS coef,", 1)
    ctes.update(
        win=windows_sql("linux"),
        feats=f"""SELECT {KEY}, 'txt:' || term AS feature, weight AS x FROM weights
                  UNION ALL SELECT {KEY}, 'lines', lines / 2.0 FROM win
                  UNION ALL SELECT {KEY}, 'kw_error', kw_error / 1.0 FROM win""",
        coefs="""SELECT 'txt:' || term AS feature, CAST(coef AS DOUBLE) AS coef FROM vocab
                 UNION ALL SELECT 'lines', 0.25 UNION ALL SELECT 'kw_error', 0.5""",
        means=f"""SELECT feature, sum(x) / (SELECT count(*) FROM win) AS mean
                  FROM feats GROUP BY 1""",
        dense=f"""SELECT win.source_file, win.bucket, feature, coef * (coalesce(x, 0) - coalesce(mean, 0)) AS phi,
                  coalesce(x, 0) * coef AS share, x IS NOT NULL OR mean IS NOT NULL AS known
                  FROM win CROSS JOIN coefs LEFT JOIN means USING (feature)
                  LEFT JOIN feats ON feats.source_file = win.source_file AND feats.bucket = win.bucket AND feats.feature = coefs.feature""",
        **extra,
    )
    return with_(**{k: v for k, v in ctes.items()})


RANKED = {
    "ranked": f"""SELECT {KEY}, feature, round(phi, 9) AS phi, row_number() OVER (PARTITION BY {KEY}
                  ORDER BY abs(round(phi, 9)) DESC, feature) AS rn FROM dense WHERE known"""
}
SENTENCE = """string_agg(CASE WHEN phi > 0 THEN '↑' ELSE '↓' END || ' ' ||
    CASE WHEN starts_with(feature, 'txt:') THEN 'text:"' || substr(feature, 5) || '"' ELSE feature END ||
    printf(' (%+.4f)', phi), ' | ' ORDER BY rn)"""


def trend_sql() -> str:
    base = f"""SELECT source_file, {bucket()} AS bucket, count(*) AS lines,
        count(*) FILTER (process = 'kernel') AS cnt_proc_kernel, count(*) FILTER (process = 'sshd') AS cnt_proc_sshd,
        count(*) FILTER (regexp_matches(message, {q(packs.LINUX_KEYWORDS['kw_error'])}, 'i')) AS kw_error,
        count(DISTINCT process) AS kw_unique_procs FROM ({sql_lines()}) GROUP BY 1, 2"""
    parts = []
    for c in ("cnt_proc_kernel", "cnt_proc_sshd", "kw_error", "kw_unique_procs"):
        parts += [
            f"round(avg(CAST({c} AS DOUBLE)) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS {c}_roll3_mean",
            f"CAST(sum({c}) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS DOUBLE) AS {c}_roll6_sum",
            f"CAST(coalesce({c} - lag({c}) OVER w, 0) AS DOUBLE) AS {c}_diff1",
        ]
    return f"SELECT *, {', '.join(parts)} FROM ({base}) WINDOW w AS (PARTITION BY source_file ORDER BY bucket)"


def split_sql(order: str) -> str:
    return f"""SELECT source_file, bucket, lines, kw_unique_procs, row_number() OVER (ORDER BY {order}) <=
               CAST(floor((SELECT count(*) FROM w) * 0.8) AS BIGINT) AS is_train FROM w"""


def live_sql() -> dict[str, str]:
    """Closed windows and alerts as one batch: windows whose end the watermark
    (latest line minus two hours) has passed."""
    kw = q(packs.LINUX_KEYWORDS["kw_error"])
    kernel = "process = 'kernel'"
    ctes = {
        "p": f"SELECT * FROM ({parsed_sql('linux')}) WHERE ts IS NOT NULL",
        "base": f"""SELECT host AS source_file, {bucket()} AS bucket, count(*) AS lines, count(DISTINCT process) AS kw_unique_procs,
            count(*) FILTER (regexp_matches(message, {kw}, 'i')) AS kw_error, count(*) FILTER ({kernel}) AS cnt_proc_kernel,
            string_agg(process || ': ' || message, {q(SEP)} ORDER BY ts, line_no) AS text FROM p GROUP BY 1, 2""",
        "tok": "SELECT source_file, bucket, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS u FROM base",
        "term": """SELECT source_file, bucket, unnest(list_concat(u, CASE WHEN len(u) > 1
            THEN list_transform(range(1, len(u)), lambda k: u[k] || ' ' || u[k + 1]) ELSE [] END)) AS term FROM tok""",
        "coef": "SELECT * FROM (VALUES " + ", ".join(f"({q(t)}, {i}, {c})" for t, i, c in LIVE_TERMS) + ") v(term, idf, coef)",
        "txt": """SELECT source_file, bucket, sum(n * idf * coef) / sqrt(sum(CAST(n * idf AS DOUBLE) * (n * idf))) AS t
            FROM (SELECT source_file, bucket, term, count(*) AS n FROM term GROUP BY ALL) JOIN coef USING (term) GROUP BY 1, 2""",
        "w": "SELECT base.*, coalesce(t, 0) AS text_logit FROM base LEFT JOIN txt USING (source_file, bucket)",
        "tr": """SELECT *, avg(kw_error) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS kw_error_roll3_mean,
            sum(kw_error) OVER (o ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS kw_error_roll6_sum,
            coalesce(cnt_proc_kernel - lag(cnt_proc_kernel) OVER o, 0) AS cnt_proc_kernel_diff1
            FROM w WINDOW o AS (PARTITION BY source_file ORDER BY bucket)""",
        "sc": f"SELECT *, 1 / (1 + exp(-({LIVE_INTERCEPT} + text_logit + "
        + " + ".join(f"CAST({n} AS DOUBLE) * {c} / {s}" for n, s, c in LIVE_NUMERIC)
        + f"))) AS score FROM tr WHERE lines >= {MIN_LINES}",
        "rw": f"SELECT *, CAST(score >= {THRESHOLD} AS INT) AS predict_raw FROM sc",
    }
    return {
        "live_windows": with_(**ctes) + """SELECT source_file, bucket, lines, kw_error, kw_unique_procs, cnt_proc_kernel,
            round(text_logit, 6) AS text_logit, translate(substr(text, 1, 250), chr(10) || ',', '  ') AS example_text FROM w""",
        "live_alerts": with_(**ctes) + f"""SELECT source_file, bucket, round(score, 6) AS early_warning_score, predict_raw,
            CAST(sum(predict_raw) OVER (PARTITION BY source_file ORDER BY bucket ROWS BETWEEN {K - 1} PRECEDING AND CURRENT ROW) >= {K} AS INT)
            AS predict_confirmed, lines FROM rw""",
        "live_late_lines": with_(p=ctes["p"]) + f""", wm AS (SELECT max(ts) - INTERVAL '2 hours' AS mark FROM p WHERE line_no % 50 <> 3),
            j AS (SELECT host AS source_file, {bucket()} AS bucket, line_no % 50 = 3 AND ts <= mark AS is_late FROM p, wm)
            SELECT source_file, bucket, count(*) FILTER (NOT is_late) AS lines, count(*) FILTER (is_late) AS late
            FROM j GROUP BY 1, 2 HAVING count(*) FILTER (is_late) > 0""",
        "live_collected": f"""SELECT ts, host, 'linux' AS os, 'file' AS source, process, pid,
            CASE WHEN ok THEN message ELSE raw END AS message, raw FROM ({parsed_sql('linux')})""",
    }


def stored_sql(counts: str) -> dict[str, str]:
    """What comes back from disk is what was written."""
    known = sorted({k for d in DIALECTS.values() for k in d.keywords})
    merged = " UNION ALL BY NAME ".join(f"SELECT *, {q(n)} AS os FROM ({windows_sql(n)})" for n in DIALECTS)
    return {
        "stage_tables": f"""SELECT c.*, f.format, (SELECT count(*) FROM ({counts})) AS rows_written
            FROM ({counts}) c, (VALUES ('parquet'), ('csv')) f(format)""",
        "merged_files": "SELECT os AS folder, os, bucket, lines, kw_unique_procs, " + ", ".join(f"coalesce({k}, -1) AS {k}" for k in known) + f" FROM ({merged})",
        "files_by_source": f"""SELECT source_file, count(*) AS rows, CAST(sum(predict_raw) AS BIGINT) AS raw_positive,
            CAST(ceil(count(*) / 400.0) AS BIGINT) AS files FROM ({PREDICTIONS}) GROUP BY 1""",
        "bundle_round_trip": explained({}) + f"""SELECT {KEY}, round(1 / (1 + exp(0.5 - sum(share))), 6) AS proba,
            CAST(1 / (1 + exp(0.5 - sum(share))) >= {THRESHOLD} AS INT) AS predict_raw, CAST({THRESHOLD} AS DOUBLE) AS threshold,
            (SELECT count(*) FROM coefs) AS features FROM dense GROUP BY {KEY}""",
        "calibrated_predictions": f"""WITH t AS (SELECT threshold FROM ({CALIBRATION}) ORDER BY abs(alerts_per_day - 1), threshold DESC LIMIT 1),
            r AS (SELECT source_file, bucket, CAST(proba >= threshold AS INT) AS predict_raw, threshold FROM ({SCORES}), t)
            SELECT source_file, bucket, predict_raw, CAST(coalesce(sum(predict_raw) OVER (PARTITION BY source_file ORDER BY bucket
            ROWS BETWEEN {K - 1} PRECEDING AND CURRENT ROW), 0) >= {K} AS INT) AS predict_confirmed, round(threshold, 6) AS threshold FROM r""",
        "explain_sample": f"""SELECT * FROM ({counts}) ORDER BY md5(source_file || '|' || strftime(bucket, '%Y-%m-%d %H:%M:%S') || '|42'),
            source_file, bucket LIMIT 200""",
        "explained_predictions": explained(RANKED) + f"""SELECT r.source_file, r.bucket, prediction_score, explanation FROM
            (SELECT {KEY}, {SENTENCE} AS explanation FROM ranked WHERE rn <= 1 GROUP BY ALL) r
            JOIN (SELECT {KEY}, round(1 / (1 + exp(0.5 - sum(share))), 6) AS prediction_score FROM dense GROUP BY ALL) s USING (source_file, bucket)""",
    }


def model_sql() -> dict[str, str]:
    """Sizes of what a fit sees, and the grid of every process in every window."""
    top = f"""SELECT source_file, process FROM (SELECT source_file, process, row_number() OVER (PARTITION BY source_file
        ORDER BY count(*) DESC, process) AS rank FROM ({sql_lines()}) GROUP BY 1, 2) WHERE rank <= {packs.TOP_PROCESSES} AND process <> ''"""
    train = f"""SELECT * FROM (SELECT *, row_number() OVER (ORDER BY source_file, bucket) AS rn, count(*) OVER () AS n FROM kept) WHERE rn <= CAST(floor(n * 0.8) AS BIGINT)"""
    grid = {
        "win": f"SELECT source_file, {bucket()} AS bucket FROM ({sql_lines()}) GROUP BY 1, 2",
        "top": top,
        "own": f"SELECT source_file, {bucket()} AS bucket, process, count(*) AS n FROM ({sql_lines()}) GROUP BY 1, 2, 3",
        "x": "SELECT w.source_file, w.bucket, t.process, coalesce(o.n, 0) AS x FROM win w JOIN top t USING (source_file) LEFT JOIN own o ON o.source_file = w.source_file AND o.bucket = w.bucket AND o.process = t.process",
        "tr": """SELECT *, avg(CAST(x AS DOUBLE)) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m, sum(x) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s,
            coalesce(x - lag(x) OVER w, 0) AS d FROM x WINDOW w AS (PARTITION BY source_file, process ORDER BY bucket)""",
    }
    cells = " UNION ALL ".join(f"SELECT source_file, bucket, 'cnt_proc_' || process || {q(suffix)} AS feature, round(CAST({c} AS DOUBLE), 6) AS x FROM tr WHERE {c} <> 0" for suffix, c in (("", "x"), ("_roll3_mean", "m"), ("_roll6_sum", "s"), ("_diff1", "d")))
    docs = f"SELECT t.* FROM ({text_sql('linux')}) t JOIN tr USING (source_file, bucket)"
    sized = {"every": text_sql("linux"), "tr": train.replace("SELECT *, row_number", "SELECT source_file, bucket, row_number").replace("FROM kept", "FROM every")}
    sized |= tfidf_ctes(docs, KEY, "text_with_proc", packs.MAX_FEATURES)
    return {
        "process_trend_features": with_(**grid) + cells,
        "fit_certificate": with_(kept=f"SELECT * FROM ({future_sql(labelled_sql('linux'))})", tr=train)
        + "SELECT count(*) AS windows, CAST(sum(y_future) AS BIGINT) AS positives, true AS optimal FROM tr WHERE window_is_anomaly = 0",
        "svd_quality": with_(**sized) + """SELECT (SELECT count(*) FROM tr) AS windows, CAST(count(*) AS INT) AS terms,
            CAST(least(256, count(*) - 1, (SELECT count(*) FROM tr)) AS INT) AS components, true AS orthonormal, true AS within_energy FROM vocab""",
    }


def oracle() -> dict[str, str]:
    counts = f"""SELECT source_file, {bucket()} AS bucket, count(*) AS lines, count(DISTINCT process) AS kw_unique_procs
                 FROM ({sql_lines()}) GROUP BY 1, 2"""
    totals = f"""SELECT source_file, process, count(*) AS total, row_number() OVER (PARTITION BY source_file
                 ORDER BY count(*) DESC, process) AS rank FROM ({sql_lines()}) GROUP BY 1, 2"""
    clean = lambda c: f"translate({c}, chr(10) || ',', '  ')"
    out = {
        "parse_syslog": f"SELECT {FIELDS} FROM ({parsed_sql('linux')})",
        "parse_mac": f"SELECT {FIELDS} FROM ({parsed_sql('mac')})",
        "parse_cbs_carry_forward": f"SELECT {FIELDS} FROM ({cbs_sql()})",
        "log_files_syslog": f"SELECT source_file AS log, timestamp, host, process, pid, message, raw, ts FROM ({parsed_sql('linux')})",
        "log_files_numbering": f"SELECT source_file AS log, count(*) AS lines, 1 AS numbered FROM ({sql_rendered('windows')}) GROUP BY 1",
        "collected_events": f"""SELECT CASE WHEN ok THEN ts ELSE TIMESTAMP '2024-02-01 00:00:00' END AS ts, host, 'linux' AS os,
            'file' AS source, process, pid, {clean("CASE WHEN ok THEN message ELSE raw END")} AS message, {clean('raw')} AS raw
            FROM ({parsed_sql('linux')})""",
        "dropped_lines": f"SELECT count(*) AS lines, count(*) FILTER (ts IS NULL) AS without_time FROM ({parsed_sql('linux')})",
        "window_counts": counts,
        "window_text": text_sql("linux"),
        "window_examples": f"""SELECT source_file, bucket, replace(substr(text_with_proc, 1, 250), chr(10), ' ') AS example_text,
            {clean('substr(text_with_proc, 1, 250)')} AS live_text FROM ({text_sql('linux')})""",
        "keyword_totals": " UNION ALL ".join(
            f"SELECT {q(k)} AS keyword, CAST(sum({k}) AS BIGINT) AS total FROM ({windows_sql('linux')})"
            for k in [*packs.LINUX_KEYWORDS, "kw_unique_procs"]
        ),
        "top_processes": f"SELECT source_file, process, total, CAST(rank AS INT) AS rank FROM ({totals}) WHERE rank <= {packs.TOP_PROCESSES}",
        "process_counts": f"""SELECT l.source_file, {bucket('l.ts')} AS bucket, l.process, count(*) AS n FROM ({sql_lines()}) l
            JOIN ({totals}) t ON t.source_file = l.source_file AND t.process = l.process AND t.rank <= {packs.TOP_PROCESSES}
            WHERE l.process <> '' GROUP BY 1, 2, 3""",
        "process_pivot": f"SELECT source_file, {bucket()} AS bucket, count(*) AS lines, "
        + ", ".join(f"count(*) FILTER (process = {q(p)}) AS \"cnt_proc_{p}\"" for p in PIVOT)
        + f" FROM ({sql_lines()}) GROUP BY 1, 2",
        "process_counts_long": f"SELECT source_file, {bucket()} AS bucket, process, count(*) AS n FROM ({sql_lines()}) GROUP BY 1, 2, 3",
        "min_lines_filter": f"SELECT * FROM ({counts}) WHERE lines >= {MIN_LINES}",
        "label_window_text": labelled_sql("linux"),
        "label_documents": f"""SELECT doc_id, window_label, CAST(window_label <> 'NORMAL' AS INT) AS window_is_anomaly
            FROM (SELECT doc_id, {label_case(DIALECTS['windows'], 'text')} AS window_label FROM documents)""",
        "label_distribution": f"""SELECT window_label, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM ({counts})) AS DOUBLE), 6) AS share
            FROM ({labelled_sql('linux')}) GROUP BY 1 ORDER BY n DESC, window_label LIMIT 10""",
        "anomaly_rate": f"""SELECT count(*) AS windows, CAST(sum(window_is_anomaly) AS BIGINT) AS anomalies,
            round(avg(CAST(window_is_anomaly AS DOUBLE)), 6) AS rate FROM ({labelled_sql('linux')})""",
        "window_anomaly": ANOMALY,
        "trend_features": trend_sql(),
        "align_features": f"""SELECT source_file, {bucket()} AS bucket, CAST(count(*) FILTER (process = 'kernel') AS DOUBLE) AS cnt_proc_kernel,
            CAST(0 AS DOUBLE) AS cnt_proc_gone,
            CAST(count(*) FILTER (regexp_matches(message, {q(packs.LINUX_KEYWORDS['kw_error'])}, 'i')) AS DOUBLE) AS kw_error,
            CAST(count(*) AS DOUBLE) AS lines FROM ({sql_lines()}) GROUP BY 1, 2""",
        "future_labels": future_sql(ANOMALY),
        "future_labels_rows": f"""SELECT *, coalesce(max(window_is_anomaly) OVER (PARTITION BY source_file ORDER BY bucket
            ROWS BETWEEN 1 FOLLOWING AND {HORIZON_MIN * 60 // WIDTH_SEC} FOLLOWING), 0) AS y_future, {HORIZON_MIN} AS horizon_min FROM ({ANOMALY})""",
        "legacy_anomaly_join": f"""SELECT c.*, coalesce(a.window_is_anomaly, 0) AS window_is_anomaly FROM ({counts}) c
            LEFT JOIN (SELECT * FROM ({ANOMALY}) WHERE window_is_anomaly = 1) a USING (source_file, bucket)""",
        "future_label_summary": f"""SELECT count(*) AS windows, CAST(sum(window_is_anomaly) AS BIGINT) AS anomalies,
            CAST(sum(y_future) AS BIGINT) AS positives, CAST(median(gap) AS DOUBLE) AS median_gap_sec
            FROM (SELECT *, epoch(bucket) - lag(epoch(bucket)) OVER (PARTITION BY source_file ORDER BY bucket) AS gap
                  FROM ({future_sql(ANOMALY)}))""",
        "chronological_split": with_(w=counts) + split_sql("source_file, bucket"),
        "chronological_split_time": with_(w=counts) + split_sql("bucket, source_file"),
        "train_hygiene": with_(s=SCORES) + f"""SELECT source_file, bucket, lines, y_true FROM (SELECT *, row_number() OVER
            (ORDER BY source_file, bucket) AS rn FROM s) WHERE rn <= CAST(floor((SELECT count(*) FROM s) * 0.8) AS BIGINT) AND window_is_anomaly = 0""",
        "k_confirm": f"SELECT source_file, bucket, predict_raw, predict_confirmed FROM ({PREDICTIONS})",
        "rising_edges": f"SELECT source_file, bucket, predict_confirmed, rise FROM ({RISES})",
        "alerts_by_day": f"SELECT CAST(bucket AS DATE) AS day, CAST(sum(rise) AS BIGINT) AS alerts FROM ({RISES}) GROUP BY 1",
        "alerts_per_day": f"""SELECT round(coalesce(avg(a), 0), 6) AS alerts_per_day
            FROM (SELECT CAST(bucket AS DATE) AS day, sum(rise) AS a FROM ({RISES}) GROUP BY 1)""",
        "prediction_summary": f"""SELECT count(*) AS windows, CAST(sum(predict_raw) AS BIGINT) AS raw_positive,
            CAST(sum(predict_confirmed) AS BIGINT) AS confirmed_positive FROM ({PREDICTIONS})""",
        "prediction_text": f"""SELECT source_file || ',' || strftime(bucket, '%Y-%m-%dT%H:%M:%S') || ',' || printf('%.6f', proba) || ',' || predict_raw
            || ',' || predict_confirmed || ',' || lines AS row FROM ({PREDICTIONS})""",
        "top_alerts": f"""SELECT source_file, bucket, strftime(bucket, '%Y-%m-%d %H:%M:%S') || printf('  score=%.4f  raw=%d  conf=%d  lines=%d  ',
            proba, predict_raw, predict_confirmed, p.lines) || substr(text_with_proc, 1, 120) AS alert_line
            FROM ({PREDICTIONS}) p JOIN ({text_sql('linux')}) t USING (source_file, bucket) ORDER BY proba DESC, source_file, bucket LIMIT 20""",
        "calibration_table": f"SELECT {CALIBRATION_COLS} FROM ({CALIBRATION})",
        "calibrate_alert_budget": f"""SELECT {CALIBRATION_COLS}, CAST(1 AS DOUBLE) AS target_alerts_per_day, {K} AS k_confirm
            FROM (SELECT * FROM ({CALIBRATION}) ORDER BY abs(alerts_per_day - 1), threshold DESC LIMIT 1)""",
        "pr_curve": f"SELECT round(threshold, 6) AS threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM ({CURVE_PR})",
        "average_precision": f"SELECT round(sum(pos / CAST(positives AS DOUBLE) * precision), 6) AS average_precision FROM ({CURVE_PR})",
        "confusion_matrix": f"""SELECT a.i AS actual, b.i AS predicted, (SELECT count(*) FROM ({PREDICTIONS}) p
            WHERE p.y_true = a.i AND p.predict_raw = b.i) AS n FROM (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(i)""",
        "classification_report": report_sql(PREDICTIONS, "predict_raw"),
        "classification_report_confirmed": report_sql(PREDICTIONS, "predict_confirmed"),
        # a count that a dialect does not have is null; shown as -1
        "union_by_name": "SELECT source_file, bucket, os, lines, kw_unique_procs, "
        + ", ".join(f"coalesce({k}, -1) AS {k}" for k in sorted({k for d in DIALECTS.values() for k in d.keywords}))
        + " FROM ("
        + " UNION ALL BY NAME ".join(f"SELECT *, {q(n)} AS os FROM ({windows_sql(n)})" for n in DIALECTS)
        + ")",
        "tfidf_windows": tfidf_sql(text_sql("linux"), KEY, "text_with_proc", 50000),
        "tfidf_documents": tfidf_sql("SELECT doc_id, text FROM documents", "doc_id", "text", 50000),
        "fixed_model_scores": explained({}) + f"""SELECT {KEY}, round(1 / (1 + exp(0.5 - sum(share))), 6) AS proba FROM dense GROUP BY ALL""",
        "linear_attribution_topk": explained(RANKED) + f"SELECT {KEY}, CAST(rn - 1 AS INT) AS pos, feature, round(phi, 6) AS phi FROM ranked WHERE rn <= 5",
        "explanation_text": explained(RANKED) + f"""SELECT {KEY}, max(feature) FILTER (rn = 1) AS feature_1, max(feature) FILTER (rn = 2) AS feature_2,
            max(feature) FILTER (rn = 3) AS feature_3,
            round(max(phi) FILTER (rn = 1), 6) AS shap_1, round(max(phi) FILTER (rn = 2), 6) AS shap_2, round(max(phi) FILTER (rn = 3), 6) AS shap_3, {SENTENCE} AS explanation FROM ranked WHERE rn <= 3 GROUP BY ALL""",
        "global_importance": explained({}) + """SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_shap, round(avg(phi), 6) AS mean_shap,
            CASE WHEN round(avg(phi), 6) > 0 THEN '↑ risk' ELSE '↓ risk' END AS direction
            FROM dense GROUP BY 1 HAVING bool_or(known)""",
        "sequence_windows": f"""SELECT source_file, bucket, array_to_string(s, ',') AS sequence, y_true AS label FROM (
            SELECT *, list(lines) OVER (PARTITION BY source_file ORDER BY bucket ROWS BETWEEN {SEQ_LEN} PRECEDING AND 1 PRECEDING) AS s
            FROM ({SCORES})) WHERE len(s) = {SEQ_LEN}""",
        "threshold_precision": threshold_sql(0.5, "precision"),
        "threshold_precision_unmet": threshold_sql(1.1, "precision"),
        "threshold_pr_max": threshold_sql(None, "pr_max"),
        "threshold_percentile": f"SELECT round(quantile_cont(proba, 0.99), 6) AS threshold, 'percentile' AS policy, true AS met_target FROM ({SCORES})",
        "threshold_min_score": f"SELECT round(min(proba), 6) AS threshold, 'min_score' AS policy, true AS met_target FROM ({SCORES})",
    }
    out.update(stored_sql(counts), **model_sql())
    out.update(live_sql())
    out["live_replayed"] = out["live_alerts"]
    for name in DIALECTS:
        out[f"window_keywords_{name}"] = windows_sql(name)
        out[f"label_windows_{name}"] = labelled_sql(name)
    early = f"""SELECT source_file, {bucket()} AS bucket, count(*) AS lines, {label_case(DIALECTS['linux'], "string_agg(process || ': ' || message, ' || ' ORDER BY ts, line_no)")} AS window_label,
        count(*) FILTER (regexp_matches(message, {q(packs.LINUX_KEYWORDS['kw_error'])}, 'i')) AS kw_error,
        count(*) FILTER (process = 'kernel') AS k FROM ({parsed_sql('linux')}) WHERE ts IS NOT NULL GROUP BY 1, 2"""
    out["early_warning"] = f"""SELECT source_file, bucket, lines, window_label, window_is_anomaly, kw_error,
        CAST(sum(kw_error) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS DOUBLE) AS kw_error_roll6_sum,
        CAST(coalesce(k - lag(k) OVER w, 0) AS DOUBLE) AS cnt_proc_kernel_diff1, y_future,
        CAST(coalesce(sum(window_is_anomaly) OVER (w ROWS BETWEEN {K - 1} PRECEDING AND CURRENT ROW), 0) >= {K} AS INT) AS confirmed
        FROM ({future_sql(f"SELECT *, CAST(window_label <> 'NORMAL' AS INT) AS window_is_anomaly FROM ({early})")})
        WINDOW w AS (PARTITION BY source_file ORDER BY bucket)"""
    return out
