"""Why a window scored as it did: exact linear attribution in log-odds.

A feature adds ``coef * (x - mean)``.  Text features a window does not hold add a
constant that only depends on the feature; the explanations therefore work on the
non-zero entries and one ranked table of those constants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augurlog.functions import packs
from augurlog.operators import tfidf
from augurlog.operators.model import Model
from augurlog.operators.windows import KEYS
from augurlog.session import broadcast_if_small, materialise

UP, DOWN = "↑", "↓"


def feature_names(model: Model) -> DataFrame:
    """``idx, feature`` in model order: text terms (``txt:``), then numeric columns."""
    spark = model.terms.sparkSession
    n_terms = model.meta["terms"]
    numeric = [(n_terms + i, name) for i, (name, _, _) in enumerate(model.numeric)]
    text = model.terms.select("idx", F.concat(F.lit("txt:"), "term").alias("feature"))
    named = text.unionByName(spark.createDataFrame(numeric, "idx int, feature string"))
    return named if model.numbers is None else named.unionByName(model.numbers.select("idx", "feature"))


def long_features(model: Model, windows: DataFrame, counts: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """``KEYS, feature, x``: the scaled model inputs of each window; zeros of text and of ``numbers``
    (``KEYS, feature, x``) are left out."""
    weighted = tfidf.weights(counts.join(windows.select(*KEYS), KEYS, "left_semi"), model.terms, KEYS)
    text = weighted.select(*KEYS, F.concat(F.lit("txt:"), "term").alias("feature"), F.col("weight").alias("x"))
    if model.numbers is not None:
        if numbers is None:
            raise ValueError("the model has inputs in long form; give numbers (KEYS, feature, x)")
        mine = numbers.join(windows.select(*KEYS), KEYS, "left_semi").join(broadcast_if_small(model.numbers.select("feature", "scale")), "feature")
        text = text.unionByName(mine.select(*KEYS, "feature", (F.col("x") / F.col("scale")).alias("x")))
    if not model.numeric:
        return text
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in windows.columns else F.lit(0.0)
    cells = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), (value(name) / F.lit(scale)).alias("x"))
            for name, scale, _ in model.numeric
        ]
    )
    numbers = windows.select(*KEYS, F.explode(cells).alias("c")).select(*KEYS, "c.feature", "c.x")
    return text.unionByName(numbers)


def coefficient_table(model: Model) -> DataFrame:
    """``feature, coef``: at most ``max_features`` rows plus the numeric inputs."""
    spark = model.terms.sparkSession
    text = model.terms.select(F.concat(F.lit("txt:"), "term").alias("feature"), "coef")
    numeric = spark.createDataFrame([(n, c) for n, _, c in model.numeric], "feature string, coef double")
    every = text.unionByName(numeric)
    return every if model.numbers is None else every.unionByName(model.numbers.select("feature", "coef"))


def background_means(features: DataFrame, n_windows: Column) -> DataFrame:
    """``feature, mean`` over all windows (absent entries count as 0)."""
    return features.groupBy("feature").agg((F.sum("x") / n_windows).alias("mean"))


def contributions(features: DataFrame, coefs: DataFrame, means: DataFrame) -> DataFrame:
    """``KEYS, feature, phi`` for the entries a window holds.

    ``coefs`` and ``means`` have one row per model feature, a fixed bound.
    """
    table = coefs.join(means, "feature", "left").select(
        "feature", "coef", F.coalesce("mean", F.lit(0.0)).alias("mean")
    )
    return features.join(broadcast_if_small(table), "feature").select(
        *KEYS, "feature", (F.col("coef") * (F.col("x") - F.col("mean"))).alias("phi")
    )


def absent_constants(coefs: DataFrame, means: DataFrame) -> DataFrame:
    """``feature, phi`` of a feature whose value is 0, for features with a mean."""
    return coefs.join(means, "feature").select("feature", (-F.col("coef") * F.col("mean")).alias("phi"))


def top_features(phi: DataFrame, absent: DataFrame, k: int = 5, rows: DataFrame | None = None) -> DataFrame:
    """``KEYS, top``: the k strongest contributions of each window, strongest first, ties by name.

    A window's candidates are its own k strongest entries and the k strongest features it lacks.
    With ``m`` own entries the latter are among the first k + m of all absent features, so only as
    many of these are listed as the fullest window needs, once for all windows, and a window finds
    its own by the places its entries take in the list.  One shuffle, of the entries.  ``rows`` has
    the keys of windows that are to be explained though they may hold no feature at all.
    """
    phi = materialise(phi, "contributions")
    fullest = phi.groupBy(*KEYS).count().agg(F.max("count")).first()[0] or 0
    entry = lambda feature, value: F.struct((-F.abs(value)).alias("size"), feature.alias("feature"), value.alias("phi"))
    first = absent.orderBy(F.desc(F.abs("phi")), F.asc("feature")).limit(fullest + k)
    listed = materialise(first.agg(F.array_sort(F.collect_list(entry(F.col("feature"), F.col("phi")))).alias("constants")), "constants")
    placed = listed.select(F.posexplode("constants").alias("place", "c")).select("place", F.col("c.feature").alias("feature"), F.col("c.phi").alias("constant"))
    placed = broadcast_if_small(materialise(placed, "places"))
    own = phi.join(placed.drop("constant"), "feature", "left").groupBy(*KEYS).agg(
        F.collect_list(entry(F.col("feature"), F.col("phi"))).alias("_own"), F.collect_list("place").alias("_taken")
    )
    if rows is not None:
        own = rows.select(*KEYS).join(own, KEYS, "left")
    none = F.array().cast("array<struct<size:double,feature:string,phi:double>>")
    held, taken = F.coalesce("_own", none), F.coalesce("_taken", F.array().cast("array<int>"))
    free = F.slice(F.array_except(F.sequence(F.lit(0), F.size(held) + F.lit(k - 1)), taken), 1, k)
    # opened and closed again on the same key, so the rows stay where they are
    opened = own.select(*KEYS, F.slice(F.array_sort(held), 1, k).alias("_own"), F.explode_outer(free).alias("place")).join(placed, "place", "left")
    lacking = F.when(F.col("feature").isNotNull(), entry(F.col("feature"), F.col("constant")))
    both = opened.groupBy(*KEYS).agg(F.first("_own").alias("_own"), F.collect_list(lacking).alias("_lacking"))
    best = F.slice(F.array_sort(F.concat("_own", "_lacking")), 1, k)
    return both.select(*KEYS, F.transform(best, lambda e: F.struct(e["feature"].alias("feature"), e["phi"].alias("phi"))).alias("top"))


def _pretty(feature: Column) -> Column:
    quoted = F.concat(F.lit('text:"'), F.substring_index(feature, "txt:", -1), F.lit('"'))
    return F.when(feature.startswith("txt:"), quoted).otherwise(feature)


def explanation_text(top: Column) -> Column:
    """The three strongest as one line, e.g. ``^ text:"oom killer" (+0.1234)``."""
    part = lambda s: F.concat(
        F.when(s["phi"] > 0, F.lit(UP)).otherwise(F.lit(DOWN)),
        F.lit(" "),
        _pretty(s["feature"]),
        F.format_string(" (%+.4f)", s["phi"]),
    )
    return F.array_join(F.transform(F.slice(top, 1, 3), part), " | ")


def explanation_rows(top: DataFrame, k: int = 5) -> DataFrame:
    """Flat form: ``feature_1, shap_1, ...`` and the sentence."""
    cells = []
    for i in range(k):
        at = F.try_element_at(F.col("top"), F.lit(i + 1))
        cells += [at["feature"].alias(f"feature_{i + 1}"), F.round(at["phi"], 6).alias(f"shap_{i + 1}")]
    others = [c for c in top.columns if c != "top"]
    return top.select(*others, *cells, explanation_text(F.col("top")).alias("explanation"))


def direction(mean: Column) -> Column:
    """Whether a feature raises or lowers the risk on average."""
    return F.when(mean > 0, F.lit(f"{UP} risk")).otherwise(F.lit(f"{DOWN} risk"))


def global_importance(phi: DataFrame, absent: DataFrame, n_windows: Column, top_k: int = 20) -> DataFrame:
    """``feature, mean_abs_shap, mean_shap, direction`` of the strongest features.

    Windows without the feature add its constant, by count instead of by row.
    """
    held = phi.groupBy("feature").agg(
        F.sum(F.abs("phi")).alias("_abs"), F.sum("phi").alias("_sum"), F.count("*").alias("_n")
    )
    constant = absent.select("feature", F.col("phi").alias("_c"))
    c = F.coalesce("_c", F.lit(0.0))
    rest = n_windows - F.coalesce(F.col("_n"), F.lit(0))
    zero = F.lit(0.0)
    return (
        held.join(constant, "feature", "full")
        .select(
            "feature",
            ((F.coalesce("_abs", zero) + rest * F.abs(c)) / n_windows).alias("mean_abs_shap"),
            ((F.coalesce("_sum", zero) + rest * c) / n_windows).alias("mean_shap"),
        )
        .withColumn("direction", direction(F.col("mean_shap")))
        .orderBy(F.desc("mean_abs_shap"), "feature")
        .limit(top_k)
    )


def sample_rows(windows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` windows, by a hash of the key that other engines have too."""
    key = F.concat_ws("|", "source_file", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"), F.lit(str(seed)))
    return windows.orderBy(F.md5(key), *KEYS).limit(n)
