"""Spelling variants: words within one error of each other, found by bit-sliced position indexes.

For a block of words the index holds one bitset per (position, letter): the words that have the
letter there.  All words of the block are looked up at once, letter by letter; the recurrences
carry four bitsets of words per query, 64 words to a machine word: no error so far, one letter
replaced, one missing from the indexed word (its positions lag by one), one extra in it (they
lead by one).

Words meet in a block only if one error can part them.  Let M be the longer length and d the
first place where two words differ: they agree before d and, counted from the end, after it.  So
a group (M, lo, hi) is keyed by the first lo and the last M - hi letters and holds the pairs with
lo <= d < hi; each pair belongs to exactly one group.  A group of more than ``GROUP`` words is cut
into the halves of its window until it fits or the window is one letter wide, when it can hold no
more words than there are letters.  So no block grows with the data, however frequent a beginning
or an end is, and no pair is lost.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from augurlog.session import materialise

#: Words of a group; words and cells (words x letters) of a block.
GROUP, BLOCK, CELLS = 512, 1024, 1 << 20
#: Words whose counts a task holds before it passes them on.
COUNTED = 100_000


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 7, count: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the words of at least ``least`` letters that occur ``count`` times or more.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.  Where ``every``
    divides the crc32 h of ``<doc_id>:<run>``, the letter h % length of the run is deleted first;
    a null id is an empty string there.  Null and empty texts have no words.  Repeated rows count
    again; other columns are not read.
    """
    runs = regex.compile("[a-zÀ-ÿ]{%d,}" % least)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def passed_on() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return rows

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = body.as_py()
                if not body:
                    continue
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                lowered = body.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                for run, n in Counter(runs.findall(lowered)).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    found[run] += n
                if len(found) > COUNTED:
                    yield passed_on()
        yield passed_on()

    partial = docs.select(F.col(doc_id).cast("string"), F.col(text)).mapInArrow(counts, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the key of their group (m, lo, hi)."""
    return rows.withColumn("key", F.expr("xxhash64(m, lo, hi, substring(word, 1, lo), right(word, m - hi))"))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row once for either half of its window."""
    middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
    return _keyed(rows.withColumn("half", F.explode(halves)).select("word", "n", "m", "half.lo", "half.hi"))


def groups(words: DataFrame) -> DataFrame:
    """(word, n, m, lo, hi, key): every word in its groups, none too large for a block."""
    length = F.length("word")
    classes = words.withColumn("m", F.explode(F.array(length, length + 1)))
    rows, done = _halves(classes.select("word", "n", "m", F.lit(0).alias("lo"), F.col("m").alias("hi"))), []
    while True:
        rows = materialise(rows, "spelling-groups")
        large = materialise(rows.where("hi - lo > 1").groupBy("key").count().where(F.col("count") > GROUP).select("key"), "spelling-large")
        if large.isEmpty():
            break
        done.append(rows.join(large, "key", "left_anti"))
        rows = _halves(rows.join(large, "key", "left_semi"))
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _near(words: list[str], groups: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one group with exactly one error, first difference within the window."""
    n, length = len(words), np.array([len(w) for w in words])
    order = np.argsort(-length, kind="stable")  # longest first, so the queries still running are a prefix
    words, length = [words[i] for i in order], length[order]
    groups, m, lo, hi = groups[order], m[order], lo[order], hi[order]
    longest, lanes = int(length[0]), -(-n // 64)
    letters, coded = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), return_inverse=True)
    cells = np.full((n, longest + 2), -1, np.int32)  # two columns more than any word has
    cells[np.arange(longest + 2) < length[:, None]] = coded.ravel()

    def bits(rows: np.ndarray) -> np.ndarray:
        """Boolean rows over the words as machine words."""
        padded = np.zeros((len(rows), lanes * 64), bool)
        padded[:, :n] = rows
        return np.packbits(padded, axis=1, bitorder="little").view("<u8")

    def index(position: int) -> np.ndarray:
        """The bitset of each letter at a position."""
        return bits(cells[:, position] == np.arange(len(letters))[:, None])

    zero = np.repeat(bits(np.ones((1, n), bool)), n, axis=0)
    replaced, missing, extra = np.zeros_like(zero), np.zeros_like(zero), zero.copy()
    before, here, after = np.zeros((len(letters), lanes), zero.dtype), index(0), index(1)
    for i in range(longest):
        live = int(np.searchsorted(-length, -i, "left"))  # words longer than i
        c = cells[:live, i]
        z, same = zero[:live], here[c]
        missing[:live] = (missing[:live] & before[c]) | z
        replaced[:live] = (replaced[:live] & same) | (z & ~same)
        zero[:live] = z & same
        extra[:live] = (extra[:live] & after[c]) | zero[:live]
        before, here, after = here, after, index(i + 2) if i + 2 < longest + 2 else np.zeros_like(here)
    of_length = {k: bits((length == k)[None])[0] for k in range(int(length[-1]) - 1, longest + 2)}
    fits = lambda k: np.stack([of_length[x] for x in (length + k).tolist()])
    found = (replaced & fits(0)) | (missing & fits(-1)) | (extra & fits(1))

    q, lane = np.nonzero(found)
    hit, bit = np.nonzero(np.unpackbits(found[q, lane][:, None].view(np.uint8), axis=1, bitorder="little"))
    q, v = q[hit], lane[hit] * 64 + bit
    ok = (groups[q] == groups[v]) & (np.maximum(length[q], length[v]) == m[q])
    q, v = q[ok], v[ok]
    inside = np.zeros(len(q), bool)
    step = max(1, CELLS // (longest + 2))
    for at in range(0, len(q), step):
        first = np.argmax(cells[q[at : at + step]] != cells[v[at : at + step]], axis=1)
        inside[at : at + step] = (lo[q[at : at + step]] <= first) & (first < hi[q[at : at + step]])
    return order[q[inside]], order[v[inside]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups, side by side in the input, until a block is full."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        bounds = _bounds(rows)
        yield from _full(rows, bounds[:-1])
        held = rows.slice(bounds[-2])  # the last group may go on in the next batch
    if held is not None:
        yield from _full(held, _bounds(held))


def _bounds(rows: pa.Table) -> np.ndarray:
    """Where groups begin, and the number of rows."""
    keys = np.asarray(rows["key"].combine_chunks())
    return np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]


def _full(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.Table]:
    """The rows up to the last of ``bounds`` in blocks of whole groups."""
    length, at = np.asarray(rows["m"].combine_chunks(), np.int64), 0
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if begin > at and (end - at > BLOCK or (end - at) * length[at:end].max() > CELLS):
            yield rows.slice(at, begin - at)
            at = begin
    if bounds[-1] > at:
        yield rows.slice(at, bounds[-1] - at)


def near_words(grouped: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): of each word with a near word their number, and the best of them.

    One row per word and block that found some; the best is the near word of largest n, ties by
    code-point order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            words = block["word"].to_pylist()
            n, key, m, lo, hi = (np.asarray(block[c].combine_chunks(), np.int64) for c in ("n", "key", "m", "lo", "hi"))
            if len(words) < 2:
                continue
            q, v = _near(words, key, m, lo, hi)
            rank = np.empty(len(words), np.int64)
            rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
            order = np.lexsort((rank[v], -n[v], q))
            q, v = q[order], v[order]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else q
            counts = np.diff(np.r_[first, len(q)])
            columns = [[words[i] for i in q[first]], counts, n[v[first]], [words[i] for i in v[first]]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "near_n", "near"])

    side_by_side = grouped.repartition("key").sortWithinPartitions("m", "key")
    return side_by_side.mapInArrow(run, "word string, n_near bigint, near_n bigint, near string")


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n; distinct words).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point.
    ``form``: the near word of largest n (ties: smallest in code-point order), if its n is at
    least ``times`` the word's; else null.  ``root``: the last word reached by following forms,
    the word itself if it has none.  n grows at every step, so chains end.  Rows with a null word
    or n are left out; an empty table gives no rows.
    """
    words = materialise(words.select("word", "n").where("word is not null and n is not null"), "vocabulary")
    best = near_words(groups(words)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    is_form = -F.col("best.minus") >= times * F.col("n")
    judged = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n"),
    )
    judged = materialise(judged, "spelling-forms")
    roots, moved = materialise(judged.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots"), 1
    while moved:
        seen = Observation()
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = roots.join(on, "root", "left").observe(seen, F.count("further").alias("moved"))
        roots = materialise(longer.select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        moved = seen.get["moved"]
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
