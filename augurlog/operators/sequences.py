"""Dense embeddings of windows and sliding sequences for temporal models."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augurlog.functions import packs
from augurlog.operators import svd, tfidf
from augurlog.operators.ordered import global_rank
from augurlog.operators.series import over_rows
from augurlog.operators.windows import KEYS
from augurlog.session import broadcast_if_small, materialise


def sequences(df: DataFrame, value: str, length: int, target: str = "y_future", series: str = "source_file") -> DataFrame:
    """``series, bucket, sequence, label``: the ``length`` rows before each row, with
    that row's label.  Sequences never cross from one series to the next."""
    thin = df.select(series, "bucket", F.col(value).alias("_value"), F.col(target).alias("label"))
    before = lambda rows: {"sequence": F.collect_list("_value").over(rows.rowsBetween(-length, -1))}
    out = over_rows(thin, before, before=length, series=series, settled=F.size("sequence") == length)
    return out.select(series, "bucket", "sequence", "label")


def fitted_svd(
    windows: DataFrame, counts: DataFrame, n_components: int = 256, min_df: int = packs.MIN_DF, max_features: int = packs.MAX_FEATURES, max_rounds: int = 30
) -> tuple[DataFrame, svd.Svd]:
    """(``term, idf, idx``, decomposition) of the TF-IDF rows of the training windows.

    ``windows`` has ``KEYS, is_train``, ``counts`` the term counts of its windows.
    """
    train = materialise(windows.where("is_train").select(*KEYS, F.monotonically_increasing_id().alias("rid")), "svd-rows")
    mine = materialise(counts.join(train, KEYS), "svd-terms")
    n = train.count()
    ranked = global_rank(tfidf.vocabulary(mine, n, min_df, max_features).select("term", "idf"), "term", name="_rank")
    terms = materialise(ranked.select("term", "idf", (F.col("_rank") - 1).alias("idx")), "svd-vocabulary")
    entries = tfidf.weights(mine, terms, ["rid"]).join(broadcast_if_small(terms.select("term", "idx")), "term")
    k = min(n_components, terms.count() - 1, n)
    return terms, svd.truncated_svd(entries.select("rid", "idx", F.col("weight").alias("w")), terms, n, max(k, 1), max_rounds)


def svd_embedding(
    windows: DataFrame,
    counts: DataFrame,
    n_components: int = 256,
    min_df: int = packs.MIN_DF,
    max_features: int = packs.MAX_FEATURES,
    standardise: bool = True,
    max_rounds: int = 30,
) -> DataFrame:
    """``KEYS, embedding``: TF-IDF -> truncated SVD -> zero mean, unit spread.

    ``windows`` has ``KEYS, is_train``; ``counts`` are the term counts of its windows.

    Vocabulary, components and scaling are fitted on the training windows only; the
    factor stays a table (see ``svd``).  Signs of components are free.
    """
    windows = materialise(windows.select(*KEYS, "is_train", F.monotonically_increasing_id().alias("rid")), "svd-windows")
    terms, fitted = fitted_svd(windows.drop("rid"), counts, n_components, min_df, max_features, max_rounds)
    k = len(fitted.values)
    own = materialise(counts.join(windows.select(*KEYS, "rid"), KEYS), "svd-counts")
    weighted = tfidf.weights(own, terms, ["rid"]).join(broadcast_if_small(terms.select("term", "idx")), "term")
    entries = svd.in_blocks(weighted.select("rid", "idx", F.col("weight").alias("w")), windows.count())
    zeros = F.array_repeat(F.lit(0.0), k)
    projected = windows.select(*KEYS, "is_train", "rid").join(svd.product(entries, fitted.factor, k), "rid", "left").select(
        *KEYS, "is_train", F.coalesce("y", zeros).alias("embedding")
    )
    if not standardise:
        return projected.drop("is_train")
    dense = materialise(projected.withColumn("v", array_to_vector("embedding")), "svd-dense")
    n = dense.where("is_train").count()
    scaler = StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True).fit(dense.where("is_train"))
    # the scaler divides by the sample spread; the population spread is wanted
    factor = (n / (n - 1.0)) ** 0.5 if n > 1 else 1.0
    z = vector_to_array("z")
    return scaler.transform(dense).select(*KEYS, F.transform(z, lambda x: x * factor).alias("embedding"))
