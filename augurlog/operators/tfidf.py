"""TF-IDF over window text, in long form: one row per (window, term).

Terms are words and adjacent word pairs of the window's joined text.  They are
counted from the lines: words and pairs inside a line need no order, and only the
pair over a line border looks at the neighbour line (``ordered.previous_value``).
The joined text is never built.

Vocabulary: terms in at least ``min_df`` windows; of those the ``max_features``
most frequent in the corpus (ties by term).  Weight: count x (ln((1+n)/(1+df))+1),
each window scaled to length 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augurlog.functions import packs
from augurlog.functions.text import first_token, last_token, line_text, terms_of, tokens
from augurlog.functions.timestamps import width_seconds
from augurlog.operators.ordered import largest, previous_value
from augurlog.operators.windows import KEYS, bucketed

#: Text of a task that counts the terms of whole texts; in memory they take some 50 times as much.
TASK_BYTES = 4 << 20


def line_term_counts(
    lines: DataFrame, width: str = packs.DEFAULT_WINDOW, ngram_max: int = 2, with_process: bool = True, vocab: DataFrame | None = None
) -> DataFrame:
    """``source_file, bucket, term, tf`` from a line table; with ``vocab`` of its terms only."""
    cut = bucketed(lines, width)
    text = line_text(F.col("process"), F.col("message")) if with_process else F.col("message")
    own = _known(term_rows(cut, KEYS, text, ngram_max), vocab)
    if ngram_max < 2:
        return _count(own, KEYS)
    # Outer tokens only: this side shuffles two short words per line, not its text.
    low = F.lower(text)
    ends = cut.select(
        *KEYS, "ts", "line_no", first_token(low).alias("first"), last_token(low).alias("last")
    ).where(F.col("first") != "")
    border = previous_value(ends, KEYS, "ts", "line_no", "first", "last", width_seconds(width) * 1_000_000)
    pairs = border.select(*KEYS, F.concat_ws(" ", "prev", "next").alias("term"))
    return _count(own.unionByName(_known(pairs, vocab)), KEYS)


def dealt_texts(docs: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys, text_col`` dealt out by the keys, so many bytes of text to a task that its terms fit in memory.

    Counts and weights by these keys stay in that place: only the texts are shuffled, not their terms.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return docs.select(*keys, text_col).repartition(tasks, *keys)


def text_term_counts(docs: DataFrame, keys: list[str], text_col: str, ngram_max: int = 2, vocab: DataFrame | None = None) -> DataFrame:
    """``keys, term, tf`` from rows that already carry their text; with ``vocab`` of its terms only."""
    return _count(_known(term_rows(docs, keys, F.col(text_col), ngram_max), vocab), keys)


def term_rows(rows: DataFrame, keys: list[str], text: Column, ngram_max: int = 2) -> DataFrame:
    """``keys, term``: one row per word and per adjacent pair of words.

    Words are zipped with their follower and opened twice, which stays inside
    generated code (array lambdas do not).
    """
    zipped = rows.select(*keys, tokens(text).alias("_words")).select(
        *keys, F.explode(terms_of(F.col("_words"), ngram_max)).alias("_w")
    )
    # the pair is null after the last word
    both = F.array("_w.a", F.concat("_w.a", F.lit(" "), "_w.b"))
    return zipped.select(*keys, F.explode(both).alias("term")).where(F.col("term").isNotNull())


def _known(rows: DataFrame, vocab: DataFrame | None) -> DataFrame:
    """The rows whose term is in ``vocab``, a bounded table; all without one."""
    return rows if vocab is None else rows.join(F.broadcast(vocab.select("term")), "term", "left_semi")


def _count(terms: DataFrame, keys: list[str]) -> DataFrame:
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def vocabulary(
    counts: DataFrame, n_docs: int, min_df: int = packs.MIN_DF, max_features: int = packs.MAX_FEATURES
) -> DataFrame:
    """``term, df, cf, idf``: at most ``max_features`` rows, a written table."""
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    totals = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df)
    return largest(totals, max_features, "cf", "term").withColumn("idf", idf)


def weights(counts: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, term, tf, weight`` with unit length per row key.

    ``vocab`` is at most ``max_features`` narrow rows, a fixed bound, so it is
    broadcast and the term counts stay where they are.
    """
    kept = counts.join(F.broadcast(vocab.select("term", "idf")), "term").withColumn(
        "_w", F.col("tf") * F.col("idf")
    )
    # a row key has at most as many terms as the vocabulary
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(*keys)))
    return kept.select(*keys, "term", "tf", (F.col("_w") / norm).alias("weight"))
