"""SimHash fingerprints, and all fingerprints within a Hamming radius by permuted block tables.

The terms of a text are its words and pairs of neighbouring words; every term votes with its
weight on each of 128 signed bits.  Votes are counted per byte value of the term hashes and turned
into bits by one small matrix product per text.

Search: the fingerprint is cut into ``RADIUS + 1`` blocks.  Two fingerprints within the radius
agree on one block at least, so one table per block, keyed by it, finds them all; a pair counts at
its first table only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augurlog.llm import textcore as tc
from augurlog.session import materialise

BITS = 128
RADIUS = 3
#: Vote of a pair of words; a word votes with its length in bytes (8 at most) over 8.
PAIR_WEIGHT = 2.0
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1


def fingerprints(column: pa.Array) -> np.ndarray:
    """A row of 16 bytes per text; all zero for a text without words."""
    out = np.zeros((len(column), BITS // 8), np.uint8)
    for lo, hi, data, bounds in tc.pieces(column):
        starts, ends, row = tc.runs(data, bounds, tc.NOT_SPACE)
        word = tc.span_hashes(data, starts, ends)
        joined = np.flatnonzero(row[1:] == row[:-1]) if len(row) else row
        term = np.concatenate([word, tc.mix(word[joined] * np.uint64(3) + word[joined + 1])])
        owner = np.concatenate([row, row[joined]])
        weight = np.concatenate([np.minimum(ends - starts, 8) / 8, np.full(len(joined), PAIR_WEIGHT)])
        rows = hi - lo
        both = np.stack([term, tc.mix(term ^ np.uint64(0x5DEECE66D))], axis=1).view(np.uint8).reshape(-1, 16) if len(term) else np.zeros((0, 16), np.uint8)
        base = owner * 256
        for k in range(BITS // 8):
            votes = np.bincount(base + both[:, k], weight, rows * 256).reshape(rows, 256) @ _SIGNS
            out[lo:hi, k] = np.packbits(votes > 0, axis=1)[:, 0]
    return out


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, 0 to 1."""
    return 1 - _ONES[a ^ b].sum(1) / BITS


SCHEMA = """doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,
  near_edited double, near_next double, part int, first boolean, last boolean"""
CHUNK = 512


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def _compared(ids: list, texts: list[str], marks: np.ndarray, following: list[str], next_marks: np.ndarray) -> list:
    """Result columns of documents, given the texts and fingerprints of the next ones."""
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, following, strict=True)]
    edited_marks = fingerprints(pa.array(edited, pa.large_string()))
    digests = [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]
    return [ids, [len(t) for t in texts], digests, _hex(marks), _hex(edited_marks), likeness(marks, edited_marks), likeness(marks, next_marks)]


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness to each other and to the next document's.

    Documents are in ascending order of id (null first), equal ids in order of their text; after
    the last comes the first.  A null text counts as empty; an only document is followed by itself.
    In the edited text the last floor(n / 4) code points are replaced by the first as many (or all)
    of the next document.  An empty table gives an empty result.

    Texts are moved once, into ranges of ids that one task goes through in order.  The last document
    of each range, whose successor is in another one, is completed in a second step over these few.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.format(id=kind)
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list = []
        texts: list[str] = []
        marks = np.zeros((0, BITS // 8), np.uint8)
        first = True
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, CHUNK):
                chunk = batch.slice(at, CHUNK)
                ids += chunk.column(0).to_pylist()
                texts += chunk.column(1).to_pylist()
                marks = np.concatenate([marks, fingerprints(chunk.column(1))])
                n = len(texts) - 1
                if n:
                    values = _compared(ids[:n], texts[:n], marks[:n], texts[1:], marks[1:])
                    flags = [np.full(n, part, np.int32), np.arange(n) == 0 if first else np.zeros(n, bool), np.zeros(n, bool)]
                    yield pa.RecordBatch.from_arrays([pa.array(values[0], id_type), *(pa.array(v) for v in [*values[1:], *flags])], names=columns)
                    first = False
                ids, texts, marks = ids[n:], texts[n:], marks[n:]
        if ids:
            none = pa.array([None], pa.string())
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, id_type), pa.array([len(texts[0])]), none, pa.array(_hex(marks)), none, pa.array([None], pa.float64()), pa.array([None], pa.float64()),
                pa.array([part], pa.int32()), pa.array([first]), pa.array([True]),
            ], names=columns)

    order = F.col("doc_id").asc_nulls_first()
    ranged = own.repartitionByRange(order).sortWithinPartitions(order, "text")
    found = materialise(ranged.mapInArrow(run, schema), "fingerprints")
    # One first and one last document per range: as many rows as the shuffle has partitions.
    edges = found.where("first OR last").select("part", "doc_id", "first", "last").collect()
    if not edges:
        return found.drop("part", "first", "last")
    begin = [r for r in sorted((r for r in edges if r.first), key=lambda r: r.part)]
    end = [r for r in sorted((r for r in edges if r["last"]), key=lambda r: r.part)]
    links = [(i, e.doc_id, begin[(i + 1) % len(begin)].doc_id) for i, e in enumerate(end)]
    spark = docs.sparkSession
    pairs = spark.createDataFrame(links, f"k int, before {kind}, after {kind}")
    # Of equal ids the range ends with the last text and begins with the first.
    before = own.join(F.broadcast(pairs), F.expr("doc_id <=> before")).groupBy("k", "before").agg(F.max("text").alias("text"))
    after = own.join(F.broadcast(pairs), F.expr("doc_id <=> after")).groupBy("k").agg(F.min("text").alias("following"))

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            values = _compared(batch.column(0).to_pylist(), texts, fingerprints(batch.column(1)), following, fingerprints(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in values[1:])], names=columns[:7])

    short = schema[: schema.index(", part")]
    last = before.join(after, "k").select("before", "text", "following").mapInArrow(complete, short)
    return found.where("NOT last").select(*columns[:7]).union(last)


def near(marked: DataFrame, queries: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """(query, fingerprint, distance) of all distinct fingerprints within RADIUS of those of ``queries``.

    Both have hexadecimal fingerprints; equal ones are collapsed first, so copies cost nothing.
    The fingerprint itself is found too, at distance 0.  Nulls are left out.
    """
    size = BITS // 4 // (RADIUS + 1)
    block = lambda k: F.substring(fingerprint, k * size + 1, size)

    def tables(df: DataFrame, name: str) -> DataFrame:
        keyed = F.posexplode(F.array(*[block(k) for k in range(RADIUS + 1)])).alias("t", "key")
        return df.select(fingerprint).where(f"{fingerprint} is not null").distinct().select(keyed, F.col(fingerprint).alias(name))

    halves = lambda c: [F.conv(F.substring(c, 1 + 16 * h, 16), 16, -10).cast("decimal(20,0)").cast("long") for h in (0, 1)]
    distance = sum(F.bit_count(a.bitwiseXOR(b)) for a, b in zip(halves("q"), halves("f"), strict=True))
    earlier = F.lit(False)
    for k in range(RADIUS):
        at = k * size + 1
        earlier = earlier | ((F.col("a.t") > k) & (F.substring("q", at, size) == F.substring("f", at, size)))
    pairs = tables(queries, "q").alias("a").join(tables(marked, "f").alias("b"), F.expr("a.t = b.t AND a.key = b.key") & ~earlier & (distance <= RADIUS))
    return pairs.select(F.col("q").alias("query"), F.col("f").alias("fingerprint"), distance.alias("distance"))


def with_neighbours(marked: DataFrame, every: int = 100) -> DataFrame:
    """``marked`` with n_near: other documents within RADIUS, for ids divisible by ``every`` (else null)."""
    marked = materialise(marked, "marked")
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    copies = marked.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    counted = near(copies, marked.where(asked)).join(copies, "fingerprint").groupBy("query").agg((F.sum("copies") - 1).alias("n_near"))
    hits = marked.where(asked).join(counted.withColumnRenamed("query", "fingerprint"), "fingerprint", "left").select(*marked.columns, "n_near")
    return hits.union(marked.where(~asked).withColumn("n_near", F.lit(None).cast("long")))
