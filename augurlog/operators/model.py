"""The early-warning model: TF-IDF text block + scaled numeric block -> logistic regression.

Fitting uses Spark ML's distributed logistic regression on sparse vectors.  A
fitted model is narrow tables of coefficients plus an intercept, so scoring is
joins and sums, inside generated code.

Numeric inputs come in two forms: columns of the window table (keywords, ``lines``),
few and named by the schema, and rows ``KEYS, feature, x`` without zeros
(processes), of which there may be any number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from augurlog.functions import packs
from augurlog.operators import tfidf
from augurlog.operators.ordered import global_rank
from augurlog.operators.trends import numeric_features
from augurlog.operators.windows import KEYS, require
from augurlog.session import broadcast_if_small, materialise, scratch_path


@dataclass
class Model:
    """``terms``: term, idf, idx, coef - at most ``max_features`` rows.
    ``numeric``: ordered (feature, scale, coef) of columns; ``numbers``: feature, idx,
    scale, coef of the inputs in long form.  ``processes``: the names that get counts."""

    terms: DataFrame
    numeric: list[tuple[str, float, float]]
    intercept: float
    text_col: str = "text_with_proc"
    processes: DataFrame | None = None
    meta: dict = field(default_factory=dict)
    numbers: DataFrame | None = None

    @property
    def features(self) -> list[str]:
        return [name for name, _, _ in self.all_numeric()]

    def all_numeric(self) -> list[tuple[str, float, float]]:
        """Every numeric input as (feature, scale, coef), for callers that keep the model in
        memory (the live state).  As many as the fitted vector, which a driver held once."""
        if self.numbers is None:
            return self.numeric
        return self.numeric + [tuple(r) for r in self.numbers.orderBy("idx").select("feature", "scale", "coef").collect()]


def sparse_struct(size: int, entries: Column) -> Column:
    """A sparse vector in stored form, from an array of (index, value) structs."""
    ordered = F.array_sort(entries)
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.transform(ordered, lambda e: e["i"]).alias("indices"),
        F.transform(ordered, lambda e: e["v"]).alias("values"),
    )


def stored_vectors(df: DataFrame, column: str = "features") -> DataFrame:
    """Write rows whose ``column`` is in stored form and read it back as a vector.

    There is no built-in that makes sparse vectors; reading the written form under
    the vector type keeps the whole step out of Python.
    """
    path = scratch_path(df.sparkSession, "vectors")
    df.write.parquet(path)
    fields = [StructField(f.name, VectorUDT() if f.name == column else f.dataType) for f in df.schema.fields]
    return df.sparkSession.read.schema(StructType(fields)).parquet(path)


def numeric_scales(train: DataFrame, features: list[str]) -> list[float]:
    """Population standard deviation per feature, nulls as 0; 1 where it is 0."""
    if not features:
        return []
    row = train.agg(
        *[F.stddev_pop(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))).alias(f"s{i}") for i, c in enumerate(features)]
    ).first()
    return [float(s) if s else 1.0 for s in row]


def number_scales(numbers: DataFrame, n: int) -> DataFrame:
    """``feature, scale`` of inputs in long form: as ``numeric_scales``, absent rows as 0.

    The spread of a constant is rounding error, so a spread that small counts as none.
    """
    sums = numbers.groupBy("feature").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    square, variance = F.col("q") / n, F.col("q") / n - (F.col("s") / n) * (F.col("s") / n)
    return sums.select("feature", F.when(variance > 1e-12 * square, F.sqrt(variance)).otherwise(1.0).alias("scale"))


def class_weights(train: DataFrame, target: str = "y_future") -> dict[int, float]:
    """Balanced weights ``n / (2 * n_class)``."""
    counts = {r[target]: r["n"] for r in train.groupBy(target).agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    return {c: n / (2.0 * m) for c, m in counts.items()}


def feature_vectors(
    rows: DataFrame, weights: DataFrame, terms: DataFrame, numeric: list[str], scales: list[float], n_terms: int,
    numbers: DataFrame | None = None, n_numbers: int = 0,
) -> DataFrame:
    """``KEYS, y_future, features``: text, then numeric columns, then inputs in long form.

    ``numbers`` has ``KEYS, i, v``, index and scaled value.  A row's entries are at most the
    vocabulary plus the numeric columns plus the entries of its processes.
    """
    cells = weights.join(F.broadcast(terms.select("term", "idx")), "term").select(*KEYS, F.col("idx").alias("i"), F.col("weight").alias("v"))
    if numbers is not None:
        cells = cells.unionByName(numbers.select(*KEYS, "i", "v"))
    entries = cells.groupBy(*KEYS).agg(F.collect_list(F.struct("i", "v")).alias("_text"))
    number = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))
    cells = [
        F.struct(F.lit(n_terms + i).alias("i"), (number(c) / F.lit(s)).alias("v"))
        for i, (c, s) in enumerate(zip(numeric, scales))
    ]
    none = F.array().cast("array<struct<i:int,v:double>>")
    everything = F.concat(F.coalesce("_text", none), F.array(*cells) if cells else none)
    return rows.join(entries, KEYS, "left").select(
        *KEYS, "y_future", sparse_struct(n_terms + len(numeric) + n_numbers, everything).alias("features")
    )


def fit(
    train: DataFrame,
    counts: DataFrame,
    numeric: list[str] | None = None,
    min_df: int = packs.MIN_DF,
    max_features: int = packs.MAX_FEATURES,
    max_iter: int = 4000,
    numbers: DataFrame | None = None,
    constant: bool = False,
) -> Model:
    """Fit on training windows and their term counts.

    One class only is an error, unless ``constant`` asks for the optimum of that case too: all
    coefficients 0, and a score of 1 or 0, the class seen, or of 1/2 where no row was.

    ``train`` has ``KEYS, y_future`` and the numeric columns; ``counts`` and
    ``numbers`` (``KEYS, feature, x``) may cover more windows, the ones not in
    ``train`` are left out.  As in wide form, a feature that only other windows have
    is a feature of the model too, with coefficient 0.
    """
    require(train, *KEYS, "y_future")
    require(counts, *KEYS, "term", "tf")
    train = materialise(train, "train")
    numeric = numeric if numeric is not None else numeric_features(train)
    n = train.count()
    if n == 0 and not constant:
        raise ValueError("no training rows")
    mine = materialise(counts.join(train.select(*KEYS), KEYS, "left_semi"), "terms")
    vocab = tfidf.vocabulary(mine, n, min_df, max_features).select("term", "idf").orderBy("term")
    # At most max_features rows pass the driver: the index of each term.
    listed = [(r.term, r.idf, i) for i, r in enumerate(vocab.collect())]
    spark = train.sparkSession
    terms = spark.createDataFrame(listed, "term string, idf double, idx int")
    weighted = tfidf.weights(mine, terms, KEYS)
    scales = numeric_scales(train, numeric)
    known, own, n_numbers = None, None, 0
    if numbers is not None:
        own = materialise(numbers.join(train.select(*KEYS), KEYS, "left_semi"), "numbers")
        names = numbers.select("feature").distinct().join(number_scales(own, max(n, 1)), "feature", "left")
        named = global_rank(names.withColumn("scale", F.coalesce("scale", F.lit(1.0))), "feature", name="rank")
        first = len(listed) + len(numeric)
        known = materialise(named.select("feature", (F.col("rank") - 1 + first).cast("int").alias("idx"), "scale"), "number-index")
        n_numbers = known.count()
        own = own.join(broadcast_if_small(known), "feature").select(*KEYS, F.col("idx").alias("i"), (F.col("x") / F.col("scale")).alias("v"))
    balance = class_weights(train)
    if len(balance) < 2:
        if not constant:
            raise ValueError("training rows hold one class only")
        # as Spark's own regression has it: the class seen is certain, and the penalty leaves no other coefficient
        coef, intercept = np.zeros(len(listed) + len(numeric) + n_numbers), {(): 0.0, (0,): -np.inf, (1,): np.inf}[tuple(balance)]
    else:
        vectors = feature_vectors(train, weighted, terms, numeric, scales, len(listed), own, n_numbers)
        weight = F.lit(1.0)
        for label, w in balance.items():
            weight = F.when(F.col("y_future") == label, F.lit(w)).otherwise(weight)
        data = stored_vectors(vectors.withColumn("weight", weight).withColumn("label", F.col("y_future").cast("double")))
        fitted = LogisticRegression(
            weightCol="weight",
            regParam=1.0 / n,
            elasticNetParam=0.0,
            standardization=False,
            maxIter=max_iter,
            tol=1e-7,
        ).fit(data.select("features", "label", "weight"))
        coef, intercept = fitted.coefficients.toArray(), float(fitted.intercept)
    with_coef = [(t, i, k, float(coef[k])) for t, i, k in listed]
    if known is not None:
        # the fitted vector is on the driver anyway; it goes out as one narrow table
        first = len(listed) + len(numeric)
        rest = pa.table({"idx": pa.array(range(first, first + n_numbers), pa.int32()), "coef": pa.array(coef[first:], pa.float64())})
        known = materialise(known.join(spark.createDataFrame(rest), "idx").select("feature", "idx", "scale", "coef"), "number-coefs")
    return Model(
        numbers=known,
        terms=spark.createDataFrame(with_coef, "term string, idf double, idx int, coef double"),
        numeric=[(c, s, float(coef[len(listed) + i])) for i, (c, s) in enumerate(zip(numeric, scales))],
        intercept=float(intercept),
        meta={"train_rows": n, "terms": len(listed), "numeric_cols": numeric, "classes": len(balance)},
    )


def numeric_logit(model: Model, have: list[str]) -> Column:
    """The numeric block's share of the log-odds; absent columns and nulls count 0."""
    out = F.lit(0.0)
    for name, scale, coef in model.numeric:
        if name in have:
            out = out + F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0)) * F.lit(coef / scale)
    return out


def number_logit(numbers: DataFrame, known: DataFrame) -> DataFrame:
    """The share of inputs in long form: ``KEYS, _number_logit``."""
    weighted = numbers.join(broadcast_if_small(known.select("feature", "scale", "coef")), "feature")
    return weighted.groupBy(*KEYS).agg(F.sum(F.col("x") * F.col("coef") / F.col("scale")).alias("_number_logit"))


def text_logit(counts: DataFrame, terms: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The text block's share of the log-odds: ``keys, _text_logit``.

    Sum(coef x w) over the length of w, so one aggregation serves both.
    """
    w = F.col("tf") * F.col("idf")
    return (
        counts.join(F.broadcast(terms.select("term", "idf", "coef")), "term")
        .groupBy(*keys)
        .agg((F.sum(w * F.col("coef")) / F.sqrt(F.sum(w * w))).alias("_text_logit"))
    )


def optimality(model: Model, features: DataFrame, scored: DataFrame, coefs: DataFrame) -> DataFrame:
    """``windows, positives, largest_gradient``: how far a fit is from the optimum.

    The loss is the class-balanced mean log-loss plus the penalty; at its minimum every derivative
    is 0.  ``features`` has the scaled inputs of the training windows (``KEYS, feature, x``),
    ``scored`` their ``proba`` and ``y_future``, ``coefs`` a row per feature.  Derivatives are one
    aggregate by feature, the intercept's is that of a feature that is always 1.
    """
    balance = class_weights(scored)
    n = scored.count()
    weight = F.lit(0.0)
    for label, w in balance.items():
        weight = F.when(F.col("y_future") == label, F.lit(w)).otherwise(weight)
    pull = scored.select(*KEYS, (weight * (F.col("proba") - F.col("y_future"))).alias("_r"))
    by_feature = features.join(pull, KEYS).groupBy("feature").agg(F.sum(F.col("_r") * F.col("x")).alias("_g"))
    inner = coefs.join(by_feature, "feature", "left").agg(F.max(F.abs(F.coalesce("_g", F.lit(0.0)) + F.col("coef"))).alias("g"))
    counted = scored.agg(F.count("*").alias("windows"), F.sum(F.col("y_future").cast("long")).alias("positives"))
    free = pull.agg(F.abs(F.sum("_r"))).scalar()
    # without windows only the penalty is left
    return counted.withColumn("largest_gradient", F.greatest(inner.scalar(), free) / max(n, 1))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score(model: Model, windows: DataFrame, counts: DataFrame, out: str = "proba", numbers: DataFrame | None = None) -> DataFrame:
    """Add the probability of an anomaly within the horizon."""
    require(windows, *KEYS)
    if model.numbers is not None:
        if numbers is None:
            raise ValueError("the model has inputs in long form; give numbers (KEYS, feature, x)")
        share = number_logit(numbers.join(windows.select(*KEYS), KEYS, "left_semi"), model.numbers)
        windows = windows.join(share, KEYS, "left")
    # counts of other windows are left out before they are summed
    text = text_logit(counts.join(windows.select(*KEYS), KEYS, "left_semi"), model.terms)
    z = F.lit(model.intercept) + F.coalesce(F.col("_text_logit"), F.lit(0.0)) + numeric_logit(model, windows.columns)
    if model.numbers is not None:
        z = z + F.coalesce(F.col("_number_logit"), F.lit(0.0))
    return windows.join(text, KEYS, "left").withColumn(out, sigmoid(z)).drop("_text_logit", "_number_logit")
