"""Hard negatives by inner product: length buckets and coordinate pruning, verified exactly.

After Teflioudi, Gemulla and Mykytiuk, "LEMP: Fast Retrieval of Large Entries in a Matrix
Product".  All vectors are range-sorted by length into written files; a task reads its files in
buckets of like length, each with one sorted list per coordinate.  An anchor that needs a score
of at least theta meets in a bucket of length l only vectors whose cosine is at least
theta / (|anchor| l); so every coordinate of such a vector lies in a known range.  The ranges of
the anchor's largest (focus) coordinates are looked up in the sorted lists and the sets they give
are intersected; what is left is scored exactly.  Where the shortest range still holds most of a
bucket, the anchor is scored against the whole bucket in one matrix product.  theta is the k-th
best score the task has found so far, so nothing is lost.

Anchors come in blocks of at most about ``BLOCK``, each broadcast in turn; a vector is read once
a block and never shuffled again.  A task gives k rows per anchor at most, which one window ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augurlog.session import materialise, scratch_path

#: Anchors broadcast at once; a block of 64 coordinates takes 8 MB.
BLOCK = 16_384
#: Vectors of a bucket, anchors scored at once, coordinates looked up.
BUCKET, CHUNK, FOCUS = 4096, 256, 3
#: A range of more than this part of the bucket is not worth looking up.
SELECTIVE = 0.2
#: Vectors that one task holds in a file.
FILE_ROWS = 200_000
#: Components beyond are set to it; scores beyond a long are set to its limits.
LARGEST = 1 << 62


def quantised(vectors: DataFrame, scale: int, vec_id: str, label: str, vector: str) -> DataFrame:
    """(id, label, q, norm): the rows that take part, components floor(scale * x).

    Rows with a null label or vector, or with a null or non-finite component, are left out.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    within = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    q = F.transform(vector, lambda x: F.floor(within(x)).cast("bigint"))
    kept = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    kept = kept.select(F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), q.alias("q"))
    return kept.withColumn("norm", F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"), F.sqrt))


def length_buckets(rows: DataFrame) -> DataFrame:
    """The rows with a key ``rid`` each, written in order of length, longest first."""
    n = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    files = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n.count() // FILE_ROWS))
    ordered = n.repartitionByRange(files, F.desc("norm"), "rid").sortWithinPartitions(F.desc("norm"), "rid")
    return materialise(ordered, "buckets")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Components as int64, shorter vectors filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(column.flatten())
    return out


class Anchors:
    """A block of anchors and their slots: what scores each looks for.

    A slot takes scores from ``lo`` to ``hi``; an anchor has one slot or more, numbered by
    ``number``.  ``wide`` tells that scores may not fit a double exactly; they are then computed
    with Python's integers.
    """

    def __init__(self, block: pa.Table, width: int, wide: bool, slots: list[tuple[int, int, int, int]]):
        self.rid, self.label = (np.asarray(block[c].combine_chunks(), np.int64) for c in ("rid", "label"))
        self.q, self.width, self.wide = _matrix(block["q"], width), width, wide
        self.anchor, self.number, self.lo, self.hi = (np.array([s[i] for s in slots], np.int64) for i in range(4))


def _scores(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    """Exact inner products: as doubles that hold integers, or from Python's integers."""
    if not wide:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return np.clip(a.astype(object) @ b.astype(object).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Search:
    """The best ``k`` rows of each slot among the buckets seen so far."""

    def __init__(self, anchors: Anchors, k: int, same: bool):
        self.of, self.k, self.same = anchors, k, same
        self.least = anchors.lo.copy()  # a slot's k-th best score, or its lower limit
        self.length = np.sqrt((anchors.q.astype(np.float64) ** 2).sum(1))
        self.unit = anchors.q / np.maximum(self.length, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1)[:, :FOCUS]
        self.alpha = np.arccos(np.clip(np.take_along_axis(self.unit, self.focus, 1), -1, 1))
        self.users = [np.nonzero(self.focus == f) for f in range(anchors.width)]
        none = np.zeros(0, np.int64)
        self.found = (none, none, none.astype(bool), none, none)  # slot, score, id is null, id, rid

    def bucket(self, q: np.ndarray, *names: np.ndarray) -> None:
        """Take in a bucket: vectors and their (id is null, id, label, rid)."""
        a = self.of
        length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        longest = max(float(length.max()), 1e-300)
        unit = q / np.maximum(length, 1e-300)[:, None]
        order = np.argsort(unit, axis=0)  # the sorted lists: rows and values by coordinate
        ranked = np.take_along_axis(unit, order, 0)

        need = np.full(len(a.rid), np.inf)
        np.minimum.at(need, a.anchor, self.least.astype(np.float64))
        cosine = need / np.maximum(self.length * longest, 1e-300)
        beta = np.arccos(np.clip(cosine, -1, 1))[:, None]
        low, high = np.cos(np.minimum(self.alpha + beta, np.pi)) - 1e-9, np.cos(np.maximum(self.alpha - beta, 0)) + 1e-9
        begin, end = np.zeros(low.shape, np.int64), np.zeros(low.shape, np.int64)
        for f, at in enumerate(self.users):
            begin[at], end[at] = np.searchsorted(ranked[:, f], low[at]), np.searchsorted(ranked[:, f], high[at], "right")
        shortest = np.argmin(end - begin, axis=1)
        spans = np.take_along_axis(end - begin, shortest[:, None], 1)[:, 0]
        whole = ~(cosine > 0) | (spans > SELECTIVE * len(q)) | a.wide
        for i in np.flatnonzero(~whole & (cosine <= 1 + 1e-9) & (spans > 0)).tolist():
            j = shortest[i]
            rows = order[begin[i, j] : end[i, j], self.focus[i, j]]
            values = unit[np.ix_(rows, self.focus[i])]
            rows = rows[((values >= low[i]) & (values <= high[i])).all(1)]
            if len(rows):
                self._take(np.array([i]), q[rows], *(x[rows] for x in names))
        whole = np.flatnonzero(whole & (cosine <= 1 + 1e-9))
        for at in range(0, len(whole), CHUNK):
            self._take(whole[at : at + CHUNK], q, *names)
        self._settle()

    def _take(self, which: np.ndarray, q: np.ndarray, null: np.ndarray, ids: np.ndarray, labels: np.ndarray, rids: np.ndarray) -> None:
        """Score some anchors against some vectors and keep what can be among the best."""
        a = self.of
        scores = _scores(a.q[which], q, a.wide)
        fits = labels == a.label[which][:, None]
        fits = (fits & (rids != a.rid[which][:, None])) if self.same else ~fits
        place = np.full(len(a.rid), -1)
        place[which] = np.arange(len(which))
        slots = np.flatnonzero(place[a.anchor] >= 0)
        for at in range(0, len(slots), CHUNK):
            part = slots[at : at + CHUNK]
            row = place[a.anchor[part]]
            s = scores[row]
            ok = fits[row] & (s <= a.hi[part][:, None]) & (s >= self.least[part][:, None])
            if ok.shape[1] > 4 * self.k and ok.sum() > 16 * self.k * len(part):
                lowest = np.iinfo(np.int64).min if a.wide else -np.inf
                best = np.partition(np.where(ok, s, lowest), ok.shape[1] - self.k, axis=1)[:, -self.k]
                ok &= s >= best[:, None]
            i, j = np.nonzero(ok)
            new = (part[i], s[i, j].astype(np.int64), null[j], ids[j], rids[j])
            self.found = tuple(np.concatenate(x) for x in zip(self.found, new, strict=True))

    def _settle(self) -> None:
        """Keep the best k of each slot; ~score orders like -score and can't overflow."""
        slot, score, null, ids, rids = self.found
        order = np.lexsort((rids, ids, null, ~score, slot))
        slot = slot[order]
        begins = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else slot
        rank = np.arange(len(slot)) - np.repeat(begins, np.diff(np.r_[begins, len(slot)]))
        self.found = tuple(x[order][rank < self.k] for x in self.found)
        full = rank == self.k - 1
        self.least[slot[full]] = score[order][full]


def best_of(buckets: DataFrame, anchors: Anchors, k: int, same: bool) -> DataFrame:
    """(a, of, rank, id, score): the first ``k`` rows of each slot, higher scores first, then smaller ids."""
    shared = buckets.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        search = Search(block, k, same)
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                rows = batch.slice(at, BUCKET)
                null = np.asarray(rows.column("id").is_null())
                ids, labels, rids = (np.asarray(rows.column(c).fill_null(0)) for c in ("id", "label", "rid"))
                search.bucket(_matrix(rows.column("q"), block.width), null, ids, labels, rids)
        slot, score, null, ids, rids = search.found
        columns = [pa.array(x) for x in (block.rid[block.anchor[slot]], block.number[slot], rids, score)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, mask=null)], names=["a", "of", "rid", "score", "id"])

    found = buckets.select("id", "label", "q", "rid").mapInArrow(run, "a bigint, of bigint, rid bigint, score bigint, id bigint")
    order = Window.partitionBy("a", "of").orderBy(F.desc("score"), F.asc_nulls_last("id"), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("a", "of", "rank", "id", "score")


def hard_negatives(
    vectors: DataFrame, anchor, relabel=None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    scale: int = 256, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """For each anchor and each of its positives the best negatives within a share of the positive's score.

    ``anchor`` is a condition over (id, label) that names the anchors, ``relabel`` an expression
    that replaces the label.  A score is the integer inner product of components
    ``floor(scale * x)``.  Positives: the first ``positives`` other rows of the anchor's label;
    higher scores first, ties by smaller id.  Negatives: the first ``negatives`` rows of other
    labels with ``low`` % to ``high`` % of the positive's score, both ends included.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).  Rows
    with a null label or vector, or a null or non-finite component, take no part.  A null id is
    never an anchor and comes last among ties.  Rows that repeat an id are different rows: each is
    an anchor, and a positive or negative, of its own.  A shorter vector is filled with zeros, an
    empty one has score 0 with all.  Anchors without another row of their label have no rows, nor
    have positives without a row in their range (a negative score has none).  Other columns are
    not read.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, scale, vec_id, label, vector)
    if relabel is not None:
        rows = rows.withColumn("label", relabel.cast("bigint"))
    buckets = length_buckets(rows)
    size = buckets.agg(F.max(F.size("q")), F.max(F.array_max(F.transform("q", lambda x: F.abs(x)))), F.sum(anchor.cast("int"))).first()
    width, wide, n_anchors = max(size[0] or 0, 1), (size[0] or 0) * int(size[1] or 0) ** 2 >= 1 << 53, int(size[2] or 0)
    blocks = max(1, -(-n_anchors // BLOCK))
    chosen = materialise(buckets.where(anchor).withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks))), "anchors")
    best, mined = scratch_path(spark, "positives"), scratch_path(spark, "negatives")
    for b in range(blocks):
        block = chosen.where(F.col("block") == b).select("rid", "label", "q").toArrow()
        slots = [(i, 0, -(1 << 63), (1 << 63) - 1) for i in range(block.num_rows)]
        best_of(buckets, Anchors(block, width, wide, slots), positives, same=True).write.parquet(f"{best}/block={b}")

        listed = spark.read.parquet(f"{best}/block={b}").groupBy("a").agg(F.collect_list(F.struct("rank", "score")).alias("positives"))
        block = chosen.where(F.col("block") == b).join(listed, F.col("rid") == F.col("a")).select("rid", "label", "q", "positives").toArrow()
        of = [(i, p["rank"], p["score"]) for i, ps in enumerate(block["positives"].to_pylist()) for p in ps]
        slots = [(i, rank, -(-score * low // 100), score * high // 100) for i, rank, score in of]
        best_of(buckets, Anchors(block, width, wide, slots), negatives, same=False).write.parquet(f"{mined}/block={b}")
    positive = spark.read.parquet(best).select("a", F.col("rank").cast("bigint").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    negative = spark.read.parquet(mined).select("a", "of", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = chosen.select(F.col("rid").alias("a"), F.col("id").alias("anchor_id"))
    joined = negative.join(positive, ["a", "of"]).join(named, "a")
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
