import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from augurlog.operators import explain, model as models, sequences, targets, tfidf, trends, windows
from augurlog.plans import pipeline
from augurlog.session import materialise
from augurlog.sources import bundle

WORDS = "alpha beta gamma delta disk error link up x é1 naïve".split()


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        t = f"2024-03-01 {rng.randint(0, 19):02d}:{rng.randint(0, 59):02d}:{rng.choice([0, 0, 30]):02d}"
        message = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 3)))
        rows.append((f"f{rng.randint(0, 2)}", i, t, rng.choice(["p", "sshd", ""]), message))
    df = spark.createDataFrame(rows, "source_file string, line_no long, t string, process string, message string")
    return df.selectExpr("source_file", "line_no", "CAST(t AS TIMESTAMP_NTZ) AS ts", "process", "message")


def textbook_tfidf(texts, min_df=2, limit=50):
    tokens = {k: re.findall(r"\b\w\w+\b", t.lower()) for k, t in texts.items()}
    counts = {k: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for k, w in tokens.items()}
    df, cf = Counter(), Counter()
    for c in counts.values():
        df.update(c.keys())
        cf.update(c)
    vocab = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-cf[t], t))[:limit]
    n = len(texts)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocab}
    out = {}
    for k, c in counts.items():
        w = {t: c[t] * idf[t] for t in c if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(k, t): v / norm for t, v in w.items()})
    return out


def test_line_terms_equal_terms_of_the_joined_text(lines):
    texts = {(r.source_file, r.bucket): r.text_with_proc for r in windows.window_text(lines, "30min").collect()}
    want = textbook_tfidf(texts)
    counts = tfidf.line_term_counts(lines, "30min")
    vocab = tfidf.vocabulary(counts, len(texts), 2, 50)
    got = {
        ((r.source_file, r.bucket), r.term): r.weight for r in tfidf.weights(counts, vocab, windows.KEYS).collect()
    }
    assert set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_line_terms_of_a_vocabulary_are_those_of_all(lines):
    """Only a vocabulary's words and pairs are counted, pairs over a line border among them."""
    whole = {(r.source_file, r.bucket, r.term): r.tf for r in tfidf.line_term_counts(lines, "30min").collect()}
    terms = sorted({t for _, _, t in whole})[::3]
    vocab = lines.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    for ngrams in (1, 2):
        got = {(r.source_file, r.bucket, r.term): r.tf for r in tfidf.line_term_counts(lines, "30min", ngrams, vocab=vocab).collect()}
        assert got == {k: n for k, n in whole.items() if k[2] in set(terms) and (ngrams > 1 or " " not in k[2])}


def test_unigrams_only(lines):
    counts = tfidf.line_term_counts(lines, "30min", ngram_max=1)
    assert counts.where("term LIKE '% %'").count() == 0


def newton(x, y, weights, reg):
    """Weighted L2 logistic regression with a free intercept."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.append(np.full(x.shape[1], reg), 0.0)
    beta = np.zeros(x1.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x1 @ beta))
        grad = x1.T @ (weights * (p - y)) + penalty * beta
        hess = (x1 * (weights * p * (1 - p))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-12:
            break
    return beta


@pytest.fixture(scope="module")
def fitted(spark, lines):
    cut = windows.create_windows(lines, "30min")
    table = trends.add_trends(cut.drop("proc_counts")).withColumn("y_future", (windows.F.col("kw_error") > 1).cast("int"))
    counts = tfidf.line_term_counts(lines, "30min")
    return models.fit(table, counts, ["kw_error_diff1", "kw_segfault", "lines"], max_features=30), table, counts


def test_fit_equals_a_direct_solve(fitted):
    model, table, counts = fitted
    rows = table.select(*windows.KEYS, "y_future", "kw_error_diff1", "kw_segfault", "lines").collect()
    index = {(r.source_file, r.bucket): i for i, r in enumerate(rows)}
    terms = {r.term: r for r in model.terms.collect()}
    x = np.zeros((len(rows), len(terms) + 3))
    for r in tfidf.weights(counts, model.terms, windows.KEYS).collect():
        x[index[(r.source_file, r.bucket)], terms[r.term].idx] = r.weight
    for i, r in enumerate(rows):
        x[i, len(terms):] = [r.kw_error_diff1, r.kw_segfault, r.lines]
    raw = x[:, len(terms):]
    scale = np.where(raw.std(axis=0) == 0, 1, raw.std(axis=0))
    assert [s for _, s, _ in model.numeric] == pytest.approx(scale)
    x[:, len(terms):] = raw / scale
    y = np.array([r.y_future for r in rows])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta = newton(x, y, weight, 1.0)
    got = np.array([0.0] * len(terms))
    for t in terms.values():
        got[t.idx] = t.coef
    got = np.concatenate([got, [c for _, _, c in model.numeric], [model.intercept]])
    assert np.abs(got - beta).max() < 2e-3
    proba = {(r.source_file, r.bucket): r.proba for r in models.score(model, table, counts).collect()}
    want = 1 / (1 + np.exp(-(x @ got[:-1] + got[-1])))
    assert max(abs(proba[k] - want[i]) for k, i in index.items()) < 1e-9


def test_contributions_add_up_to_the_log_odds(fitted):
    model, table, counts = fitted
    features = explain.long_features(model, table, counts)
    n = table.agg(windows.F.count("*")).scalar()
    coefs = explain.coefficient_table(model)
    means = explain.background_means(features, n)
    phi = explain.contributions(features, coefs, means)
    absent = {r.feature: r.phi for r in explain.absent_constants(coefs, means).collect()}
    base = model.intercept + sum(-v for v in absent.values())
    sums, held = Counter(), {}
    per = {}
    for r in phi.collect():
        k = (r.source_file, r.bucket)
        sums[k] += r.phi
        held.setdefault(k, set()).add(r.feature)
        per.setdefault(k, {})[r.feature] = r.phi
    for r in models.score(model, table, counts).collect():
        k = (r.source_file, r.bucket)
        total = base + sums[k] + sum(v for f, v in absent.items() if f not in held[k])
        assert 1 / (1 + math.exp(-total)) == pytest.approx(r.proba, abs=1e-9)
    top = explain.top_features(phi, explain.absent_constants(coefs, means), 4)
    for r in top.collect():
        k = (r.source_file, r.bucket)
        everything = {**{f: v for f, v in absent.items() if f not in held[k]}, **per[k]}
        want = sorted((-abs(v)) for v in everything.values())[:4]
        assert [-abs(t.phi) for t in r.top] == pytest.approx(want)
    names = [r.feature for r in explain.feature_names(model).orderBy("idx").collect()]
    assert names[-3:] == ["kw_error_diff1", "kw_segfault", "lines"] and names[0].startswith("txt:")
    sentence = explain.explanation_rows(top, 2).first()
    assert sentence.explanation.count(" | ") == 2 and sentence.feature_1


def test_one_class_is_an_error(lines):
    cut = windows.create_windows(lines, "30min").drop("proc_counts").selectExpr("*", "0 AS y_future")
    with pytest.raises(ValueError, match="one class"):
        models.fit(cut, tfidf.line_term_counts(lines, "30min"), ["lines"], max_features=5)


def test_sequences(spark):
    rows = [("a", i, float(i)) for i in range(5)] + [("b", i, 10.0 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "source_file string, bucket long, v double").selectExpr("*", "int(bucket % 2) AS y_future")
    got = {(r.source_file, r.bucket): (list(r.sequence), r.label) for r in sequences.sequences(df, "v", 3).collect()}
    assert got == {("a", 3): ([0.0, 1.0, 2.0], 1), ("a", 4): ([1.0, 2.0, 3.0], 0)}


def test_svd_embedding(lines):
    counts = tfidf.line_term_counts(lines, "30min")
    cut = windows.create_windows(lines, "30min").withColumn("is_train", windows.F.lit(True))
    out = sequences.svd_embedding(cut, counts, 3, max_features=40, standardise=False)
    n = cut.count()
    vocab = tfidf.vocabulary(counts, n, 2, 40)
    keys = sorted((r.source_file, r.bucket) for r in cut.collect())
    terms = sorted(r.term for r in vocab.collect())
    x = np.zeros((n, len(terms)))
    for r in tfidf.weights(counts, vocab, windows.KEYS).collect():
        x[keys.index((r.source_file, r.bucket)), terms.index(r.term)] = r.weight
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    got = np.array([v for _, v in sorted(((r.source_file, r.bucket), r.embedding) for r in out.collect())])
    assert np.abs(np.abs(got) - np.abs(u[:, :3] * s[:3])).max() < 1e-8
    scaled = sequences.svd_embedding(cut, counts, 3, max_features=40)
    z = np.array([r.embedding for r in scaled.collect()])
    assert np.abs(z.mean(axis=0)).max() < 1e-9 and np.abs(z.std(axis=0) - 1).max() < 1e-9


def test_pipeline_from_files(spark, tmp_path):
    rng = random.Random(11)
    texts = ["session opened", "disk error now", "link up", "Out of memory: kill", "timed out", "job done"]
    for f in range(3):
        rows = sorted((rng.randint(0, 23), rng.randint(0, 59), rng.randint(0, 59)) for _ in range(2000))
        body = [
            f"Mar {5 + f:2d} {h:02d}:{m:02d}:{s:02d} h p[{i}]: "
            + (texts[3] if rng.random() < 0.01 else rng.choice([texts[0], texts[1], texts[2], texts[5]]))
            for i, (h, m, s) in enumerate(rows)
        ]
        (tmp_path / f"n{f}.log").write_text("\n".join(body) + "\n")
    settings = pipeline.with_settings(pipeline.RUNNER, use_trends=True, year=2025, max_features=100, horizon_min=15)
    out = str(tmp_path / "out")
    run = pipeline.run_pipeline(spark, str(tmp_path), "linux", out, settings, target_alerts_per_day=4.0)
    kept = run.prepared.windows.where("lines >= 3").count()
    assert run.predictions.count() == kept
    cols = {"bucket", "early_warning_score", "predict_raw", "predict_confirmed", "threshold", "k_confirm", "lines", "example_text", "source_file"}
    assert set(run.predictions.columns) == cols
    assert run.predictions.where("predict_confirmed > predict_raw").count() == 0
    back = bundle.load_model(spark, f"{out}/model")
    assert back.features == run.trained.model.features
    again = pipeline.score(run.prepared, back, bundle.load_threshold(spark, f"{out}/model"), settings)
    a = {(r.source_file, r.bucket): round(r.early_warning_score, 9) for r in again.collect()}
    b = {(r.source_file, r.bucket): round(r.early_warning_score, 9) for r in run.predictions.collect()}
    assert a == b
    assert bundle.thresholds(spark, f"{out}/model").count() == 2
    rows, importance = pipeline.explain_windows(run.prepared, back, settings, top_k=3, sample=20)
    assert rows.count() == 20 and importance.count() == 30
    seq = pipeline.sequence_set(run.prepared, 4, 6, max_features=50)
    assert seq.where("size(sequence) <> 6").count() == 0 and seq.count() > 0
    assert targets.MIN_TRAIN_ROWS == 50


@pytest.mark.parametrize("flag,score", [("0", 0.0), ("1", 1.0), (None, 0.5)])
def test_constant_model_of_one_class_or_no_row(lines, flag, score):
    cut = windows.create_windows(lines, "30min").drop("proc_counts").selectExpr("*", f"{flag or 0} AS y_future")
    counts = tfidf.line_term_counts(lines, "30min")
    long = cut.selectExpr("source_file", "bucket", "'cnt' AS feature", "CAST(lines AS DOUBLE) AS x")
    train = cut if flag else cut.where("false")
    model = models.fit(train, counts, ["lines"], max_features=5, numbers=long, constant=True)
    assert model.meta["classes"] == (1 if flag else 0)
    scored = models.score(model, train, counts, numbers=long)
    assert {r.proba for r in models.score(model, cut, counts, numbers=long).collect()} == {score}
    features = explain.long_features(model, train, counts, long)
    row = models.optimality(model, features, scored, explain.coefficient_table(model)).first()
    assert (row.windows, row.largest_gradient) == (cut.count() if flag else 0, 0.0)


def test_busy_logs_train_score_and_explain(make_lines):
    # every window holds an anomaly, so none is left to train on
    rows = [(f"f{s}", i, f"{h:02d}:{m:02d}:00", "kernel", "Out of memory: kill process") for s in range(4) for i, (h, m) in enumerate((h, m) for h in range(20) for m in (0, 20, 40))]
    settings = pipeline.with_settings(width="20min", min_lines=0, constant_model=True)
    prepared = pipeline.prepare(make_lines(rows), "linux", settings)
    trained = pipeline.train(prepared, settings, eval_k=2)
    out = pipeline.score(prepared, trained.model, trained.threshold, settings).collect()
    assert len(out) == 240 and {r.early_warning_score for r in out} == {0.5}
    assert pipeline.explain_windows(prepared, trained.model, settings)[0].count() == 240
    row = pipeline.fit_certificate(prepared, trained, settings).first()
    assert (row.windows, row.positives, row.largest_gradient) == (0, None, 0.0)
    with pytest.raises(ValueError, match="no training rows"):
        pipeline.train(prepared, pipeline.with_settings(settings, constant_model=False))


def test_terms_of_texts_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(tfidf, "TASK_BYTES", 50)
    rng = random.Random(9)
    texts = {i: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))) for i in range(40)}
    rows = [(i, t) for i, t in texts.items()] + [(None, "disk error disk"), (None, "link error"), (40, None), (41, "alpha"), (41, "beta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = tfidf.dealt_texts(docs, ["doc_id"], "text")
    assert dealt.rdd.getNumPartitions() > 8
    plain = tfidf.text_term_counts(docs, ["doc_id"], "text")
    vocab = materialise(tfidf.vocabulary(plain, 42, 2, 50))
    got = tfidf.weights(tfidf.text_term_counts(dealt, ["doc_id"], "text", vocab=vocab), vocab, ["doc_id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    shown = lambda df: sorted((str(r.doc_id), r.term, r.tf, round(r.weight, 12)) for r in df.collect())
    assert shown(got) == shown(tfidf.weights(plain, vocab, ["doc_id"])) and len(got.collect()) > 200
