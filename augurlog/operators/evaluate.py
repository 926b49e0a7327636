"""Model quality: precision/recall curve, average precision, thresholds, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augurlog.functions import packs
from augurlog.operators.ordered import exact_quantiles, running_totals
from augurlog.session import materialise

POLICIES = ("precision", "percentile", "pr_max", "min_score")


def pr_curve(scores: DataFrame, score: str = "proba", target: str = "y_true") -> DataFrame:
    """``threshold, tp, fp, precision, recall`` at every distinct score.

    Equal scores are merged first, so the running sums see distinct values.
    """
    merged = scores.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(target) == 1).alias("_pos"), F.count_if(F.col(target) == 0).alias("_neg")
    )
    merged = materialise(merged, "curve")
    total = merged.agg(F.sum("_pos")).scalar()
    sums = running_totals(merged, "threshold", {"tp": "_pos", "fp": "_neg"}, descending=True)
    return sums.select(
        "threshold",
        "tp",
        "fp",
        F.col("_pos").alias("tp_here"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), total), F.lit(0.0)).alias("recall"),
        total.alias("positives"),
    )


def average_precision(scores: DataFrame, score: str = "proba", target: str = "y_true") -> DataFrame:
    """Step-wise area: precision at each score times the recall it adds (not interpolated)."""
    curve = pr_curve(scores, score, target)
    step = F.try_divide(F.col("tp_here"), F.col("positives")) * F.col("precision")
    return curve.agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision"))


def confusion_matrix(df: DataFrame, target: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """``actual, predicted, n`` for all four cells."""
    a, p = F.col(target).cast("int"), F.col(pred).cast("int")
    cells = [(i, j) for i in (0, 1) for j in (0, 1)]
    counts = df.agg(*[F.count_if((a == i) & (p == j)).alias(f"c{i}{j}") for i, j in cells])
    row = lambda i, j: F.struct(F.lit(i).alias("actual"), F.lit(j).alias("predicted"), F.col(f"c{i}{j}").alias("n"))
    return counts.select(F.explode(F.array(*[row(i, j) for i, j in cells])).alias("c")).select("c.*")


def classification_report(df: DataFrame, target: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """``label, precision, recall, f1, support`` per class, accuracy and both means."""
    a, p = F.col(target).cast("int"), F.col(pred).cast("int")
    c = df.agg(
        *[F.count_if((a == i) & (p == j)).cast("double").alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)]
    )
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    n = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    per = {}
    for i in (0, 1):
        hit = F.col(f"c{i}{i}")
        prec = ratio(hit, F.col(f"c0{i}") + F.col(f"c1{i}"))
        rec = ratio(hit, F.col(f"c{i}0") + F.col(f"c{i}1"))
        per[i] = {
            "precision": prec,
            "recall": rec,
            "f1": ratio(2 * prec * rec, prec + rec),
            "support": F.col(f"c{i}0") + F.col(f"c{i}1"),
        }

    def line(label, precision, recall, f1, support):
        return F.struct(
            F.lit(label).alias("label"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.cast("long").alias("support"),
        )

    accuracy = ratio(F.col("c00") + F.col("c11"), n)
    macro = {m: (per[0][m] + per[1][m]) / 2 for m in ("precision", "recall", "f1")}
    weighted = {
        m: ratio(per[0][m] * per[0]["support"] + per[1][m] * per[1]["support"], n)
        for m in ("precision", "recall", "f1")
    }
    lines = [
        line("0", **per[0]),
        line("1", **per[1]),
        line("accuracy", accuracy, accuracy, accuracy, n),
        line("macro avg", **macro, support=n),
        line("weighted avg", **weighted, support=n),
    ]
    return c.select(F.explode(F.array(*lines)).alias("r")).select("r.*")


def choose_threshold(
    scores: DataFrame,
    policy: str = "precision",
    target_precision: float = packs.DEFAULT_TARGET_PRECISION,
    percentile: float = 0.99,
    score: str = "proba",
    target: str = "y_true",
) -> DataFrame:
    """One row ``threshold, policy, met_target``.

    * ``precision``: best recall with precision at or above the target, else the
      best product of precision and recall (ties: lower score)
    * ``percentile``: a score quantile
    * ``pr_max``: the best product of precision and recall
    * ``min_score``: the lowest score, i.e. everything is positive
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; known: {POLICIES}")
    if policy == "percentile":
        q = min(max(percentile, 0.0), 1.0)
        out = exact_quantiles(scores, score, [q]).select(F.col("quantile").alias("threshold"))
        return out.select("threshold", F.lit(policy).alias("policy"), F.lit(True).alias("met_target"))
    if policy == "min_score":
        return scores.agg(F.min(score).alias("threshold")).select(
            "threshold", F.lit(policy).alias("policy"), F.lit(True).alias("met_target")
        )
    curve = pr_curve(scores, score, target)
    product = F.col("precision") * F.col("recall")
    best = curve.agg(
        # recall grows as the score falls, so the lowest valid score has the best recall
        F.min(
            F.when(F.lit(policy == "precision") & (F.col("precision") >= target_precision), F.col("threshold"))
        ).alias("_met"),
        F.max_by("threshold", F.struct(product, -F.col("threshold"))).alias("_fallback"),
    )
    met = F.col("_met").isNotNull() if policy == "precision" else F.lit(True)
    return best.select(
        F.coalesce("_met", "_fallback").alias("threshold"), F.lit(policy).alias("policy"), met.alias("met_target")
    )
