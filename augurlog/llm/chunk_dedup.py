"""Repeated passages found by content-defined chunks, and removed from all documents but the first.

A gear hash rolls over the bytes of a text: twice the last value plus a value per byte, over 16
bytes.  Places where a word starts may be cuts (in words of over ``LONG`` bytes, as unspaced scripts
have, every character).  Of ``width`` neighbouring places the one with the smallest hash of the
bytes that follow is a cut; nothing else decides, so bytes put in or taken out move the cuts near
them only.  A chunk lies between two cuts.  ``width`` is such that any passage of more than
``min_words`` words has two cuts that depend on its own bytes alone, hence a whole chunk.

Chunks are compared by 64-bit digests across all documents; of equal chunks in a row each has its
own, so that a word said a hundred times isn't a repeat of one said twice.  Neighbouring chunks that earlier
documents (smaller ids) hold too are a run.  Both its ends are extended as far as the text of the
run's first holders goes on alike: the holders' texts give the ``width`` words around the chunks at
the ends, and a join hands them over.  A run of four fifths of ``min_words`` or more is a passage.

The shuffles carry a digest and an id per chunk.  Digests with very many rows are joined by a
broadcast instead; there are at most ``HOT`` of them, whatever the size of the tables.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augurlog.llm import textcore as tc
from augurlog.session import materialise

#: Bytes that the gear hash reads.
WINDOW = 16
#: Passages of more words are always found.
MIN_WORDS = 50
#: Bytes above which a word counts as one word per ``WORD`` bytes and may be cut at any character.
LONG, WORD = 32, 8
#: Digests that are joined by a broadcast at most.
HOT = 50_000
#: Bytes of text handled at once.
PIECE = 1 << 19

_GEAR = (tc.seeds(256, 31) >> np.uint64(32)).astype(np.uint32)
_NONE = np.zeros(0, np.int64)


def width_of(min_words: int) -> int:
    """Places of which one is a cut: a passage has twice as many, its last 16 bytes and a partial first word left out."""
    if min_words < WINDOW // 2 + 2:
        raise ValueError(f"min_words must be {WINDOW // 2 + 2} at least")
    return (min_words - WINDOW // 2) // 2


class Chunks(NamedTuple):
    """Chunks of the rows ``lo`` to ``hi`` of a batch, in order, and what their bounds were found by."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray
    places: np.ndarray  # where cuts may be
    size: np.ndarray  # words before each byte, in parts of 1 / WORD
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    digest: np.ndarray


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours."""
    seen = 1
    while seen < width:
        step = min(seen, width - seen)
        values = np.minimum(values[:-step], values[step:])
        seen += step
    return values


def chunks(column: pa.Array, min_words: int = MIN_WORDS) -> Iterator[Chunks]:
    """The chunks of every text; a null has none."""
    width = width_of(min_words)
    for lo, hi, data, bounds in tc.pieces(column, PIECE):
        begin, end, _ = tc.runs(data, bounds, tc.NOT_SPACE)
        long = end - begin > LONG
        inside = np.zeros(len(data) + 1, np.int8)
        inside[begin[long]] += 1
        inside[end[long]] -= 1
        inside = np.cumsum(inside, dtype=np.int8)[:-1] > 0
        may = inside & (data & 0xC0 != 0x80)
        may[begin] = True
        places = np.flatnonzero(may)
        part = inside.astype(np.int64)
        part[begin[~long]] = WORD
        size = np.concatenate([_NONE, [0], np.cumsum(part)])

        row = np.searchsorted(bounds, places, "right") - 1
        whole = places + WINDOW <= bounds[row + 1]
        at, row = places[whole], row[whole]
        cuts = _NONE
        if len(at) >= width:
            h = _GEAR[data]
            for step in (1, 2, 4, 8):
                longer = h.copy()
                longer[step:] += h[:-step] << np.uint32(step)
                h = longer
            # The place breaks ties, so that the first of equal hashes counts.
            least = _least((h[at + WINDOW - 1].astype(np.uint64) << np.uint64(32)) | np.arange(len(at), dtype=np.uint64), width)
            cuts = (least[row[: len(least)] == row[width - 1 :]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])[: len(cuts)]]
        bound, of = at[cuts], row[cuts]
        same = of[1:] == of[:-1]
        starts, ends = bound[:-1][same], bound[1:][same]
        yield Chunks(lo, hi, data, bounds, places, size, starts, ends, of[1:][same], _numbered(starts, ends, tc.span_hashes(data, starts, ends, tc.EXACT)).view(np.int64))


def _around(c: Chunks, k: int, width: int) -> tuple[bytes, bytes]:
    """The bytes of the ``width`` words before chunk ``k`` and after it, within its row."""
    low, high = c.bounds[c.row[k]], c.bounds[c.row[k] + 1]
    i = np.searchsorted(c.places, c.starts[k]) - width
    j = np.searchsorted(c.places, c.ends[k]) + width
    begin = max(low, c.places[i]) if i >= 0 else low
    end = min(high, c.places[j] + 2 * WINDOW) if j < len(c.places) else high
    return c.data[begin : c.starts[k]].tobytes(), c.data[c.ends[k] : end].tobytes()


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def _numbered(starts: np.ndarray, ends: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Digests in which the k-th of neighbouring equal chunks is told from the others, so that a longer stretch isn't a repeat of a shorter one."""
    first = np.ones(len(digest), bool)
    first[1:] = (digest[1:] != digest[:-1]) | (starts[1:] != ends[:-1])
    at = np.flatnonzero(first)
    k = np.arange(len(digest)) - np.repeat(at, np.diff(np.append(at, len(digest))))
    return np.where(k > 0, tc.mix(digest + k.astype(np.uint64)), digest)


def _places(c: Chunks) -> np.ndarray:
    """Place of every chunk: the text, and the number in it.  Repeated rows of a doc_id may have different texts."""
    texts = (tc.span_hashes(c.data, c.bounds[:-1], c.bounds[1:], tc.EXACT) >> np.uint64(33)).astype(np.int64) << 32
    return texts[c.row] + np.arange(len(c.row)) - np.searchsorted(c.row, c.row)


def _rows(lists: pa.Array) -> np.ndarray:
    """The row of every element of a column of lists."""
    return np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))


def _with_few(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` and what ``few``, a written table with one row per key and the number ``n`` of its rows, knows of them.

    Keys of very many rows stay out of the shuffle.  There are ``HOT`` of them at most, since each
    has more than 1 / HOT of the rows.
    """
    floor = max(20_000, rows.count() // HOT)
    hot = few.where(F.col("n") > floor).drop("n")
    if hot.isEmpty():
        return rows.join(few.drop("n"), keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(few.where(F.col("n") <= floor).drop("n"), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys))


def deduplicated(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``keep`` columns, the text without repeated passages, n_removed (bytes) and repeats_of (ids).

    A passage stays in the document of the smallest id that has its bytes; repeats_of lists the
    documents, in order, whose chunks the removed passages of this one repeat.  Texts without a
    repeated passage are returned as they are, null and empty ones too, with 0 and an empty list.
    Repeated rows with one doc_id count as one document, so they don't repeat each other; rows
    without an id are neither compared nor changed.  What a document repeats within itself stays.
    Passages begin and end at whole words (in words of over ``LONG`` bytes: characters).  An empty
    table gives an empty result.
    """
    width, least = width_of(min_words), min_words * WORD * 4 // 5
    kind = docs.schema[doc_id].dataType
    id_type = kind.simpleString()
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1), min_words):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c.lo + c.row)), pa.array(c.digest), pa.array(_places(c))], names=["doc_id", "digest", "place"])

    found = materialise(own.mapInArrow(cut, f"doc_id {id_type}, digest long, place long"), "chunks")
    shared = found.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    shared = materialise(shared.where("owner <> last").drop("last"), "shared")
    hits = _with_few(found, shared, ["digest"]).where("doc_id <> owner")
    hits = materialise(hits.groupBy(F.col("doc_id").alias("_of")).agg(F.collect_set(F.struct("place", "digest", "owner")).alias("hits")), "hits")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The digests at the ends of each run, with every first holder of a chunk of the run."""
        for batch in batches:
            items = batch.column(1).flatten()
            place, digest, owner = (np.asarray(items.field(i)) if i < 2 else items.field(i) for i in range(3))
            row = _rows(batch.column(1))
            if not len(row):
                continue
            order = np.lexsort((place, row))
            place, digest, row = place[order], digest[order], row[order]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
            head = np.flatnonzero(fresh)
            tail = np.append(head[1:], len(row))[: len(head)] - 1
            run = np.cumsum(fresh) - 1
            listed = pa.table([pa.array(run), owner.take(pa.array(order))], names=["run", "owner"]).group_by(["run", "owner"]).aggregate([])
            of = np.asarray(listed["run"].combine_chunks())
            owners = listed["owner"].combine_chunks()
            for edge in (head, tail):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[edge[of]])), pa.array(digest[edge[of]]), owners], names=["doc_id", "digest", "owner"])

    edges = hits.mapInArrow(ends, f"doc_id {id_type}, digest long, owner {id_type}").distinct()
    edges = materialise(edges, "edges")
    asked = edges.groupBy("owner", "digest").agg(F.count("*").alias("n")).groupBy(F.col("owner").alias("_of")).agg(F.collect_list(F.struct("digest", "n")).alias("asked"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words around the chunks asked for: the first and, if there are several, the last one of a digest in a text."""
        for batch in batches:
            for c in chunks(batch.column(1), min_words):
                out = [[] for _ in range(7)]
                bound = np.searchsorted(c.row, np.arange(c.hi - c.lo + 1))
                for i in range(c.hi - c.lo):
                    wanted = batch.column(2)[c.lo + i].values
                    number = dict(zip(wanted.field(0).to_pylist(), wanted.field(1).to_pylist(), strict=True))
                    place = defaultdict(list)
                    for j in (bound[i] + np.flatnonzero(np.isin(c.digest[bound[i] : bound[i + 1]], np.fromiter(number, np.int64)))).tolist():
                        place[int(c.digest[j])].append(j)
                    for digest, at in place.items():
                        for values, value in zip(out, (c.lo + i, digest, number[digest], *_around(c, at[0], width), *(_around(c, at[-1], width) if len(at) > 1 else (None, None))), strict=True):
                            values.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(v, t) for v, t in zip(out[1:], [pa.int64()] * 2 + [pa.binary()] * 4, strict=True))],
                    names=["owner", "digest", "n", "before", "after", "last_before", "last_after"],
                )

    around = own.join(asked, F.col("doc_id") == F.col("_of")).select("doc_id", "text", "asked").mapInArrow(told, f"owner {id_type}, digest long, n long, before binary, after binary, last_before binary, last_after binary")
    around = around.groupBy("owner", "digest").agg(F.max("n").alias("n"), F.min(F.struct("before", "after", "last_before", "last_after")).alias("near"))
    near = _with_few(edges, materialise(around, "around"), ["digest", "owner"])
    near = near.groupBy(F.col("doc_id").alias("_near_of")).agg(F.collect_list(F.struct("digest", "near.*")).alias("near"))

    kept = [c for c in keep if c != text]
    names = {n: tc.unused(n, kept + [text]) for n in ("n_removed", "repeats_of")}
    marks, known_near = tc.unused("hits", docs.columns), tc.unused("near", docs.columns)
    of = tc.unused("_of", docs.columns)
    lists = hits.join(near, F.col("_of") == F.col("_near_of"), "left").select(F.col("_of").alias(of), F.col("hits").alias(marks), F.col("near").alias(known_near))
    joined = docs.join(lists, F.col(f"`{doc_id}`") == F.col(of), "left").select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"), marks, known_near)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(text, T.StringType()), T.StructField(names["n_removed"], T.LongType()), T.StructField(names["repeats_of"], T.ArrayType(kind))])

    def passages(c: Chunks, i: int, known: np.ndarray, before: dict, after: dict) -> list[tuple[int, int]]:
        """Begin and end of the passages of row ``i``, of whose chunks ``known`` are held by earlier documents."""
        low, high = int(c.bounds[i]), int(c.bounds[i + 1])
        fresh = np.append(True, c.starts[known[1:]] != c.ends[known[:-1]])
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(known)) - 1
        spans = []
        for first, last in zip(known[head].tolist(), known[tail].tolist(), strict=True):
            b, e = int(c.starts[first]), int(c.ends[last])
            b -= max((_alike(np.frombuffer(x, np.uint8)[::-1], c.data[max(low, b - len(x)) : b][::-1]) for x in before[int(c.digest[first])]), default=0)
            e += max((_alike(np.frombuffer(x, np.uint8), c.data[e : min(high, e + len(x))]) for x in after[int(c.digest[last])]), default=0)
            if spans and b <= spans[-1][1]:
                spans[-1][1] = max(e, spans[-1][1])
            else:
                spans.append([b, e])
        whole = []
        space = ~tc.NOT_SPACE
        for b, e in spans:
            if b > low and not (space[c.data[b - 1]] or space[c.data[b]]):
                j = int(np.searchsorted(c.places, b))
                b = int(c.places[j]) if j < len(c.places) else e
            if e < high and not (space[c.data[e - 1]] or space[c.data[e]]):
                e = int(c.places[np.searchsorted(c.places, e, "right") - 1])
            if e > b and c.size[e] - c.size[b] >= least:
                whole.append((b, e))
        return whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(kept)
            column, lists, around = batch.column(n), batch.column(n + 1), batch.column(n + 2)
            texts, removed, origins = column.to_pylist(), np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            hit_rows = np.flatnonzero(np.asarray(lists.is_valid()))
            for c in chunks(column.take(pa.array(hit_rows)), min_words):
                bound = np.searchsorted(c.row, np.arange(c.hi - c.lo + 1))
                for i in range(c.hi - c.lo):
                    k = int(hit_rows[c.lo + i])
                    items = lists[k].values
                    owner = dict(zip(items.field(1).to_pylist(), items.field(2).to_pylist(), strict=True))
                    known = bound[i] + np.flatnonzero(np.isin(c.digest[bound[i] : bound[i + 1]], np.fromiter(owner, np.int64)))
                    if not len(known):
                        continue
                    before, after = defaultdict(list), defaultdict(list)
                    for digest, *texts_near in zip(*(around[k].values.field(f).to_pylist() for f in range(5)), strict=True) if around[k].is_valid else ():
                        before[digest] += [t for t in texts_near[0::2] if t is not None]
                        after[digest] += [t for t in texts_near[1::2] if t is not None]
                    left, done, ids = [], int(c.bounds[i]), set()
                    for b, e in passages(c, i, known, before, after):
                        ids.update(owner[d] for d in c.digest[known[(c.starts[known] < e) & (c.ends[known] > b)]].tolist())
                        left.append(c.data[done:b])
                        removed[k] += e - b
                        done = e
                    if ids:
                        left.append(c.data[done : c.bounds[i + 1]])
                        texts[k], origins[k] = np.concatenate(left).tobytes().decode("utf-8", "replace"), sorted(ids)
            ids_type = pa.list_(lists.type.value_type.field(2).type)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(texts, pa.string()), pa.array(removed), pa.array(origins, ids_type)], names=schema.names)

    return joined.mapInArrow(run, schema)
