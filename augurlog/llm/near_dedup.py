"""MinHash near-duplicate detection with tensored banding.

The set of a document is its distinct word shingles.  Two collections of ``bands`` keys are made
per set, each key from ``rows`` minhashes.  A table key is a *pair* (key of the first collection,
key of the second): ``bands * bands`` tables from ``2 * bands * rows`` minhashes, where plain
banding of the same strength needs ``bands * bands * 2 * rows``.  Candidates that share a table
key are confirmed on the full sets.

Shape of the job, all as Spark joins and aggregates:

* Equal sets fall into one class first, so exact copies cost one row each however many there are.
* Only keys that at least two classes share on *both* sides are combined into table keys.
* Within a table, members are compared with one leader (the smallest), never all with all.
  What is left with more than one component is compared exactly in blocks of bounded size, every
  class once.  Comparisons within one component are skipped; no link between components is lost.
* Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augurlog.llm import tables, textcore as tc
from augurlog.session import broadcast_if_small, materialise

SHINGLE = 5
ROWS = 4
#: A linked pair shares no table with at most this chance.
MISS = 5e-4
#: Leaders per table in each further round, and the most of these rounds.
LEADERS, ROUNDS = 8, 3
#: Clusters up to this many open classes are compared without further rounds, in blocks of BLOCK.
LARGE, BLOCK = 10_000, 256

_MULTIPLY = tc.seeds(5, 77) | np.uint64(1)


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands per collection so that a pair at ``threshold`` is missed with chance ``miss`` at most.

    A pair is missed if it shares no key of the first or none of the second collection.
    """
    return max(2, math.ceil(math.log(miss / 2) / math.log(1 - threshold**rows)))


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in row order.

    A text of fewer than ``size`` words has the whole sequence as its one shingle; one without
    words, or null, has none.
    """
    for lo, hi, data, bounds in tc.pieces(column):
        words, ends = tc.words(data, bounds)
        n = len(words)
        joint = np.zeros(max(0, n - size + 1), np.uint64)
        for k in range(size):
            joint += words[k : k + len(joint)] * _MULTIPLY[k % 5]
        joint = tc.mix(joint)
        for i in range(hi - lo):
            a, b = int(ends[i]), int(ends[i + 1])
            if b - a >= size:
                s = np.sort(joint[a : b - size + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                few = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    few = tc.mix(few * _MULTIPLY[0] + words[k])
                yield few
            else:
                yield words[:0]


def _digests(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16 bytes per non-empty set, from sums of mixed members."""
    two = np.empty((len(starts), 2), np.uint64)
    two[:, 0] = np.add.reduceat(tc.mix(flat), starts)
    two[:, 1] = np.add.reduceat(tc.mix(flat ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts)
    return two


def _lists(values: np.ndarray) -> pa.Array:
    """A list column from a matrix of 64-bit values."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def signatures(docs: DataFrame, text: str = "text", keep: list[str] | None = None, size: int = SHINGLE, bands: int = 12, rows: int = ROWS) -> DataFrame:
    """``keep`` columns, n_shingles, cls (digest of the set, null if empty), and the two key collections a and b."""
    total = 2 * bands * rows
    factor, offset = tc.seeds(total, 5000) | np.uint64(1), tc.seeds(total, 9000)
    salt = tc.seeds(2 * bands, 12000)

    def compute(column: pa.Array) -> list:
        n_rows = len(column)
        counts = np.zeros(n_rows, np.int64)
        digest = np.zeros((n_rows, 2), np.uint64)
        keys = np.zeros((n_rows, 2 * bands), np.uint64)
        held, at, row = [], 0, 0

        def flush() -> None:
            nonlocal held, at
            sets = [s for _, s in held]
            if sets:
                which = np.array([i for i, _ in held])
                flat, lengths = np.concatenate(sets), np.array([len(s) for s in sets])
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                digest[which] = _digests(flat, starts)
                own = np.zeros((len(sets), 2 * bands), np.uint64)
                for k in range(total):
                    least = np.minimum.reduceat(flat * factor[k] + offset[k], starts)
                    own[:, k // rows] = tc.mix(own[:, k // rows] * np.uint64(31) + least)
                keys[which] = own ^ salt
            held, at = [], 0

        for s in shingle_sets(column, size):
            counts[row] = len(s)
            if len(s):
                held.append((row, s))
                at += len(s)
            row += 1
            if at >= 200_000:
                flush()
        flush()
        raw = [d.tobytes() if c else None for d, c in zip(digest, counts, strict=True)]
        return [counts, pa.array(raw, pa.binary()), _lists(keys[:, :bands]), _lists(keys[:, bands:])]

    many = T.ArrayType(T.LongType())
    fields = [("n_shingles", T.LongType()), ("cls", T.BinaryType()), ("a", many), ("b", many)]
    return tc.with_columns(docs, text, compute, fields, keep or [])


def _sets(docs: DataFrame, doc_id: str, text: str, size: int, bands: int) -> DataFrame:
    """cls and the full set of every text."""

    def compute(column: pa.Array) -> list:
        sets = list(shingle_sets(column, size))
        lengths = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
        full = np.flatnonzero(lengths)
        raw: list = [None] * len(sets)
        if len(full):
            starts = (np.cumsum(lengths) - lengths)[full]
            for i, d in zip(full, _digests(flat, starts), strict=True):
                raw[i] = d.tobytes()
        bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return [pa.array(raw, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.view(np.int64)))]

    return tc.with_columns(docs, text, compute, [("cls", T.BinaryType()), ("shingles", T.ArrayType(T.LongType()))], [])


def table_members(classes: DataFrame) -> DataFrame:
    """(bucket, cls, n, c, head, hn) of all tables in which at least two classes meet.

    c is the number of classes in the table, head the smallest, hn its set size.  A key that only
    one class has on its side can meet nobody, so it is left out before the two collections are
    combined; this loses no meeting.
    """

    def shared(side: str) -> DataFrame:
        each = classes.select("cls", F.explode(side).alias("key"))
        twice = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
        return each.join(twice, "key").groupBy("cls").agg(F.collect_list("key").alias(side))

    both = shared("a").join(shared("b"), "cls").join(classes.select("cls", "n"), "cls")
    pairs = both.select("cls", "n", F.explode("a").alias("ka"), "b").select("cls", "n", F.explode("b").alias("kb"), "ka")
    keys = materialise(pairs.select("cls", "n", F.xxhash64("ka", "kb").alias("bucket")), "table_keys")
    met = keys.groupBy("bucket").agg(F.count("*").alias("c"), F.min(F.struct("cls", "n")).alias("h")).where("c > 1")
    return keys.join(met, "bucket").select("bucket", "cls", "n", "c", F.col("h.cls").alias("head"), F.col("h.n").alias("hn"))


def _confirmed(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among the pairs (cls, n, head, hn): 100 * intersection >= percent * union of the full sets."""
    small = F.col("cls") < F.col("head")
    pairs = met.where("cls <> head").where(f"100 * least(n, hn) >= {percent} * greatest(n, hn)").select(
        F.least("cls", "head").alias("x"), F.greatest("cls", "head").alias("y"),
        F.when(small, F.col("n")).otherwise(F.col("hn")).alias("xn"), F.when(small, F.col("hn")).otherwise(F.col("n")).alias("yn"),
    ).distinct()
    x = sets.select(F.col("cls").alias("x"), F.col("shingles").alias("xs"))
    y = sets.select(F.col("cls").alias("y"), F.col("shingles").alias("ys"))
    both = F.size(F.array_intersect("xs", "ys")).cast("long")
    return pairs.join(x, "x").join(y, "y").where(100 * both >= percent * (F.col("xn") + F.col("yn") - both)).select(F.col("x").alias("u"), F.col("y").alias("v"))


def block_links(left: list[np.ndarray], right: list[np.ndarray], differ: np.ndarray, percent: int) -> np.ndarray:
    """Index pairs of linked sets among those marked in ``differ``, by counting shared members."""
    ln, rn = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    order = np.argsort(flat := np.concatenate(right), kind="stable")
    values, owner = flat[order], np.repeat(np.arange(len(right)), rn)[order]
    common = np.zeros((len(left), len(right)), np.int64)
    for i, own in enumerate(left):
        lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        counts = hi - lo
        at = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        common[i] = np.bincount(owner[at], minlength=len(right))
    return np.argwhere(differ & (100 * common >= percent * (ln[:, None] + rn[None, :] - common)))


def _open_links(open_members: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between members of different components of what is still open, in blocks.

    ``open_members`` has (cluster, cls, n, root).  Blocks hold neighbours by (root, size); pairs of
    blocks within one component, or of sizes too different for a link, are left out.
    """
    place = Window.partitionBy("cluster").orderBy("root", "n", "cls")
    placed = materialise(open_members.withColumn("block", F.floor((F.row_number().over(place) - 1) / block).cast("int")), "blocks")
    blocks = placed.groupBy("cluster", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    other = blocks.select("cluster", *[F.col(c).alias("o" + c) for c in ("block", "n0", "n1", "r0", "r1")])
    meet = blocks.join(other, "cluster").where("block <= oblock").where(f"100 * n1 >= {percent} * on0 AND 100 * on1 >= {percent} * n0").where("NOT (r0 = r1 AND or0 = or1 AND r0 = or0)")
    meet = materialise(meet.select("cluster", F.col("block").alias("i"), F.col("oblock").alias("j")), "block_pairs")
    filled = placed.join(sets, "cls").select("cluster", "block", "cls", "root", "shingles")
    sides = [filled.join(meet.withColumnRenamed(own, "block").withColumnRenamed(far, "far"), ["cluster", "block"]).select("cluster", *(("block", "far") if s == 0 else ("far", "block")), "cls", "root", "shingles", F.lit(s).alias("side")).toDF("cluster", "i", "j", "cls", "root", "shingles", "side") for s, own, far in ((0, "i", "j"), (1, "j", "i"))]

    def links(pdf):
        import pandas as pd

        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        differ = left.root.to_numpy()[:, None] != right.root.to_numpy()[None, :]
        arrays = [[np.asarray(s, np.int64) for s in side.shingles] for side in (left, right)]
        at = block_links(*arrays, differ, percent)
        return pd.DataFrame({"u": left.cls.to_numpy()[at[:, 0]], "v": right.cls.to_numpy()[at[:, 1]]})

    return sides[0].union(sides[1]).groupBy("cluster", "i", "j").applyInPandas(links, "u binary, v binary")


def class_links(members: DataFrame, sets: DataFrame, percent: int, leaders: int = LEADERS, rounds: int = ROUNDS, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """(node, root) of all classes with a link; no component is split that links found by the tables join.

    The smallest member of every table is compared with the others, which settles tables of two.
    Larger tables whose members then lie in several components are *open*.  Open tables that share
    members form clusters, and each cluster is compared in blocks, every class once.  While a
    cluster has more than ``large`` members, up to ``rounds`` rounds of further leaders come first.
    """
    links = materialise(_confirmed(members, sets, percent), "links")
    open_members = members.where("c > 2").select("bucket", "cls", "n")
    for step in range(rounds + 1):
        roots = materialise(tables.components(links), "roots")
        if open_members.isEmpty():
            return roots
        at = open_members.select("bucket", "cls", "n").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        split = at.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("cls").alias("first")).where("r0 <> r1").select("bucket", "first")
        open_members = materialise(at.join(split, "bucket"), "open_members")
        if open_members.isEmpty():
            return roots
        clusters = tables.components(open_members.select(F.col("cls").alias("u"), F.col("first").alias("v"))).withColumnRenamed("root", "cluster")
        clusters = materialise(clusters, "open_clusters")
        if step == rounds or clusters.groupBy("cluster").count().agg(F.max("count")).first()[0] <= large:
            break
        order = Window.partitionBy("bucket").orderBy(F.xxhash64("cls", F.lit(step)), "cls")
        heads = open_members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= leaders)
        heads = heads.select("bucket", F.col("cls").alias("head"), F.col("n").alias("hn"), F.col("root").alias("head_root"))
        links = materialise(links.union(_confirmed(open_members.join(heads, "bucket").where("root <> head_root"), sets, percent)), "links")
    each = open_members.select("cls", "n", "root").distinct().join(clusters.withColumnRenamed("node", "cls"), "cls")
    return tables.components(links.union(materialise(_open_links(each, sets, percent, block), "open_links")))


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, rows: int = ROWS, key: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, cls, component_id and kept.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets.
    component_id is the smallest doc_id that links lead to, the document's own included; kept is
    doc_id = component_id.  Documents without words, or null text, are linked with nothing.
    Repeated rows (same doc_id) each get a row; a null doc_id counts only where a component has no
    other.  Equal sets are linked by their digest.  An empty table gives an empty result.

    With ``key``, a column of ``docs``, the result also has ``key`` and ``root``, a name of the
    component that does not depend on ids (null for documents without words).
    """
    bands = band_count(percent / 100, rows)
    carried = [] if key is None else [F.col(f"`{key}`").alias("key")]
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *carried)
    names = [c for c in own.columns if c != "text"]
    signed = materialise(signatures(own, "text", names, size, bands, rows), "signatures")
    narrow = signed.select(*names, "n_shingles", "cls")
    classes = signed.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")
    )
    classes = materialise(classes, "classes")
    members = materialise(table_members(classes), "table_members")
    met = members.select("cls").distinct()
    needed = materialise(classes.select("cls", "least").join(met, "cls"), "needed")
    # One text of each class that meets another; without any id it is found by the digest alone.
    texts = own.join(needed.select(F.col("least").alias("doc_id")).distinct(), on="doc_id", how="left_semi")
    if not needed.where("least is null").isEmpty():
        texts = texts.select("text").union(own.where("doc_id is null").select("text"))
    sets = _sets(texts, "doc_id", "text", size, bands).dropDuplicates(["cls"]).join(met, "cls", "left_semi")
    sets = materialise(sets, "sets")
    roots = materialise(class_links(members, sets, percent), "class_roots")
    least = classes.select("cls", "least").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    whole = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = least.join(whole, "root").select("cls", "component_id", "root")
    out = narrow.join(by_class, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    more = [] if key is None else ["key", "root"]
    return out.select("doc_id", "n_shingles", "cls", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *more)


def keep_one(docs: DataFrame, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, columns unchanged.

    A row is known by a digest of its doc_id and text.  Of a group stays the row with the smallest
    doc_id, one with a null doc_id only where the group has no other; ties go to the smallest
    digest.  Rows that share a doc_id but are not near copies are different documents.  Of rows
    equal in doc_id and text one stays, whatever their other columns.  All documents without words
    stay, null texts included.
    """
    key = tc.unused("row_key", docs.columns)
    owner = F.coalesce(F.concat(F.lit("#"), F.col("doc_id").cast("string")), F.lit(""))
    keyed = docs.withColumn(key, F.md5(F.concat(owner, F.lit("\n"), F.col("text"))))
    found = materialise(near_duplicates(keyed, percent, rows=rows, key=key).where("root is not null").select("root", "doc_id", "key"), "near_duplicates")
    alike = found.groupBy("root", "doc_id", "key").agg(F.count("*").alias("c"))
    first = alike.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "c")).alias("m"))
    first = materialise(first.select(F.col("m.key").alias(key), "m.c"), "first_of_group")
    columns = [f"`{c}`" for c in docs.columns]
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keep = docs.where(~worded).union(keyed.join(first.where("c = 1").select(key), key, "left_semi").select(*columns))
    repeated = first.where("c > 1").select(key)
    if repeated.isEmpty():
        return keep
    once = keyed.join(broadcast_if_small(repeated), key, "left_semi").dropDuplicates([key])
    return keep.union(once.select(*columns))
