"""Benchmark decontamination with suffix arrays over shards of the training text.

Each task cuts its documents into shards of about ``SHARD`` words and builds the suffix array of
each shard: all word positions, sorted by the words that follow.  Every suffix of every benchmark
item is then looked up by binary search, one word deeper at a time, which gives its longest
verbatim match and, at the depth of a window, all its locations.  Document words inside a located
window are hit.

No row is moved: documents are scanned once.  Benchmark items reach the tasks as broadcast blocks
of at most ``BLOCK`` words (one item, if that is longer), however large the benchmark is; each
block is one more pass over the batch within the same task.  The driver builds one block at a time;
a Python worker keeps the blocks it has read, so its memory grows with the benchmark, not with the
documents.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augurlog.llm import textcore as tc

WINDOW = 13
#: A document is contaminated if it has a hit and 100 * hit words >= PERCENT * words.
PERCENT = 5
#: Words of a shard of documents, and of a broadcast block of benchmark items.
SHARD = 1 << 18
BLOCK = 1 << 20


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``words`` sorted by at least the next ``depth`` words, by prefix doubling.

    Only positions whose order is still open are sorted again, so the cost of later rounds is that
    of the repeated text.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    padded = np.zeros(n + 1, np.int64)
    padded[:n] = rank
    key = padded[:n] * (n + 2) + padded[1:]
    order = np.argsort(key, kind="stable")
    known = 2
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    while known < depth:
        # A group is named by the place of its first member, so names stay valid when it splits.
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        padded = np.zeros(n + known + 1, np.int64)
        padded[order] = first + 1
        lone = head & np.concatenate([head[1:], [True]])
        tied = np.flatnonzero(~lone)
        if not len(tied):
            break
        at = order[tied]
        next_key = padded[at + known]
        again = np.lexsort((next_key, first[tied]))
        order[tied] = at[again]
        group, next_key = first[tied][again], next_key[again]
        head[tied] = np.concatenate([[True], (group[1:] != group[:-1]) | (next_key[1:] != next_key[:-1])])
        known *= 2
    return order


class Items:
    """The words of some benchmark items, and their suffixes."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int) -> None:
        column = pa.array([t for _, t in rows], pa.string())
        held, lengths = [], []
        for _, _, data, bounds in tc.pieces(column):
            words, ends = tc.words(data, bounds, tc.LETTER_OR_DIGIT)
            held.append(words)
            lengths.append(np.diff(ends))
        self.names = [i for i, _ in rows]
        self.words = np.concatenate([*held, np.zeros(0, np.uint64)])
        lengths = np.concatenate([*lengths, np.zeros(0, np.int64)]).astype(np.int64)
        self.item = np.repeat(np.arange(len(rows)), lengths)
        self.place = place = np.arange(len(self.words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        #: Words from each suffix to the end of its item, and the window that starts there (0: none).
        self.left = np.repeat(lengths, lengths) - place
        short = np.repeat(lengths < window, lengths)
        self.window = np.where(short, np.where(place == 0, self.left, 0), np.where(self.left >= window, window, 0))
        self.longest = int(self.left.max(initial=0))


def _edge(words: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, target: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of many ranges of the suffix array at once, by the word at ``depth``."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        middle = (lo[open_] + hi[open_]) >> 1
        found = words[order[middle] + depth]
        before = found <= target[open_] if right else found < target[open_]
        lo[open_[before]] = middle[before] + 1
        hi[open_[~before]] = middle[~before]


def _spread(order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all ranges of the suffix array in a row, and the size of each range."""
    counts = hi - lo
    return order[np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())], counts


def _least_positions(order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The smallest position within each range of the suffix array; equal ranges are gone through once."""
    if not len(lo):
        return lo
    ranges, which = np.unique(np.stack([lo, hi], axis=1), axis=0, return_inverse=True)
    flat, counts = _spread(order, ranges[:, 0], ranges[:, 1])
    return np.minimum.reduceat(flat, np.cumsum(counts) - counts)[which.reshape(-1)]


def shard_matches(words: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matches of all suffixes of ``items`` in a shard of words, 0 marking the end of a document.

    ``order`` is the suffix array of the shard.  Window hits as (position, length, item); for every
    suffix the length of its longest match and the smallest position of it; for every position of
    the shard the length of the longest match of a window's length or more that begins there.
    """
    n = len(items.words)
    longest, reach = np.zeros(n, np.int64), np.zeros(len(words), np.int64)
    last_lo, last_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    alive = np.arange(n)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(words), np.int64)
    position, length, item = [], [], []
    for depth in range(items.longest):
        target = items.words[alive + depth]
        new_lo = _edge(words, order, lo, hi, depth, target, False)
        new_hi = _edge(words, order, new_lo, hi, depth, target, True)
        stay = np.flatnonzero(new_lo < new_hi)
        alive, lo, hi = alive[stay], new_lo[stay], new_hi[stay]
        longest[alive] = depth + 1
        last_lo[alive], last_hi[alive] = lo, hi
        whole = np.flatnonzero(items.window[alive] == depth + 1)
        if len(whole):
            flat, counts = _spread(order, lo[whole], hi[whole])
            position.append(flat)
            length.append(np.full(len(flat), depth + 1))
            item.append(np.repeat(items.item[alive[whole]], counts))
        # Suffixes with the same words so far share a range, and ranges of one depth don't overlap.
        covered = (items.window[alive] > 0) & (items.window[alive] <= depth + 1)
        begin, at = np.unique(lo[covered], return_index=True)
        reach[_spread(order, begin, hi[covered][at])[0]] = depth + 1
        more = items.left[alive] > depth + 1
        alive, lo, hi = alive[more], lo[more], hi[more]
        if not len(alive):
            break
    join = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
    where = np.full(n, -1)
    matched = longest > 0
    where[matched] = _least_positions(order, last_lo[matched], last_hi[matched])
    return join(position), join(length), join(item), longest, where, reach


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block: int = BLOCK) -> tuple[list, int]:
    """Broadcast ``Items`` of at most about ``block`` words each, and the words of the longest item.

    The driver holds one block at a time; blocks without words are left out.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-size // (3 * block)))
    blocks, depth = [], 0
    for part in range(parts if size else 0):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        held = Items([(r.item_id, r.text) for r in rows], window)
        if held.longest:
            blocks.append(spark.sparkContext.broadcast(held))
            depth = max(depth, held.longest)
    return blocks, depth


FIELDS = [
    ("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()),
    ("contaminated", T.BooleanType()), ("longest", T.LongType()), ("longest_at", T.LongType()),
]


def _shards(column: pa.Array, shard: int):
    """(first row, words with a 0 after each row) of runs of rows of about ``shard`` words."""
    held, first, size = [], 0, 0
    for lo, hi, data, bounds in tc.pieces(column):
        words, ends = tc.words(data, bounds, tc.LETTER_OR_DIGIT)
        held.append(np.insert(words, ends[1:], np.uint64(0)))
        size += len(held[-1])
        if size >= shard or hi == len(column):
            yield first, np.concatenate(held)
            held, first, size = [], hi, 0


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, percent: int = PERCENT, prefix: str = "", shard: int = SHARD) -> DataFrame:
    """``keep`` columns of every document with its words, hit words, items, and verdict.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.  A window is
    ``window`` consecutive words of an item, or a whole item of fewer words.  n_hit counts document
    words inside any occurrence of a window; n_items the items (distinct ids) with one;
    items_sha256 is the SHA-256 of their ids, sorted as strings and joined by commas.  A document is
    contaminated if n_hit > 0 and 100 * n_hit >= percent * n_words.  longest is the length of the
    longest verbatim match of a window's length or more, longest_at the first word where one of
    that length begins, from 0; 0 and -1 without a hit.

    Null and empty texts have no words and are clean; items without words match nothing; repeated
    item rows count once; an item without an id hits but is not listed; repeated documents are
    judged alike.  ``prefix`` is put before the names of the result columns.
    """
    blocks, depth = benchmark_blocks(benchmark, item_id, item_text, window)

    def compute(column: pa.Array) -> list:
        n = len(column)
        n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
        found: dict[int, set] = {}
        longest, longest_at = np.zeros(n, np.int64), np.full(n, -1)
        for first, words in _shards(column, shard):
            end = words == 0
            row = first + np.cumsum(end) - end
            reach = np.zeros(len(words), np.int64)
            n_words += np.bincount(row[~end], minlength=n)
            change = np.zeros(len(words) + 1, np.int64)
            order = suffix_array(words, depth) if depth else None
            for items in (b.value for b in blocks):
                position, length, item, _, _, own = shard_matches(words, order, items)
                reach = np.maximum(reach, own)
                change += np.bincount(position, minlength=len(change)) - np.bincount(position + length, minlength=len(change))
                for pair in np.unique(row[position] * len(items.names) + item).tolist():
                    name = items.names[pair % len(items.names)]
                    if name is not None:
                        found.setdefault(pair // len(items.names), set()).add(name)
            n_hit += np.bincount(row[np.cumsum(change[:-1]) > 0], minlength=n)
            begins = np.flatnonzero(reach)
            # the longest of every row, of these the first
            at = begins[np.lexsort((begins, -reach[begins], row[begins]))]
            own_row, at_first = np.unique(row[at], return_index=True)
            at = at[at_first]
            text_begin = np.concatenate([[0], np.flatnonzero(end) + 1])
            longest[own_row], longest_at[own_row] = reach[at], at - text_begin[own_row - first]
        listed = [sorted(found.get(i, ())) for i in range(n)]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]
        bad = (n_hit > 0) & (100 * n_hit >= percent * n_words)
        return [n_words, n_hit, np.array([len(x) for x in listed], np.int64), pa.array(digest, pa.string()), bad, longest, longest_at]

    return tc.with_columns(docs, text, compute, [(prefix + name, kind) for name, kind in FIELDS], keep)


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without contaminated documents, columns unchanged; in place, without a shuffle."""
    prefix = "hits_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return decontaminate(docs, benchmark, docs.columns, percent=percent, prefix=prefix).where(f"NOT `{prefix}contaminated`").select(docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard: int = SHARD) -> DataFrame:
    """(item_id, item_word, length, doc_id, doc_word) of the longest verbatim match of every item suffix.

    item_word and doc_word count words from 0.  Ties go to the smallest doc_id, then place.  The
    documents of a shard are taken in order of id, so its smallest position is the tie's winner, and
    each shard gives one row per suffix; the aggregate over shards is pre-aggregated.
    Suffixes without any match have no row.
    """
    blocks, depth = benchmark_blocks(benchmark, item_id, item_text, WINDOW)
    schema = f"item_id string, item_word long, length long, doc_id {docs.schema[doc_id].dataType.simpleString()}, doc_word long"

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            sorted_rows = pc.sort_indices(ids, null_placement="at_end")
            ids, column = ids.take(sorted_rows), batch.column(1).take(sorted_rows)
            for first, words in _shards(column, shard):
                end = words == 0
                row = np.cumsum(end) - end
                begin = np.concatenate([[0], np.flatnonzero(end) + 1])
                order = suffix_array(words, depth) if depth else None
                for items in (b.value for b in blocks):
                    _, _, _, longest, where, _ = shard_matches(words, order, items)
                    hit = np.flatnonzero(longest)
                    at = row[where[hit]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([items.names[i] for i in items.item[hit]], pa.string()), pa.array(items.place[hit]), pa.array(longest[hit]),
                        ids.take(pa.array(first + at)), pa.array(where[hit] - begin[at]),
                    ], names=["item_id", "item_word", "length", "doc_id", "doc_word"])

    each = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
    best = each.groupBy("item_id", "item_word").agg(F.min(F.struct((-F.col("length")).alias("n"), F.col("doc_id").isNull(), "doc_id", "doc_word")).alias("m"))
    return best.select("item_id", "item_word", (-F.col("m.n")).alias("length"), "m.doc_id", "m.doc_word")
