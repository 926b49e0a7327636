"""BPE encoding and decoding by a deterministic tokenization automaton.

The automaton reads tokens.  It starts as one state that every symbol loops on and takes in the
merges in rank order, one gadget each (Berglund, Martens and van der Merwe, "Constructing a BPE
Tokenization DFA"): for a merge (u, v) the state after ``u`` is copied without its arcs on ``v``,
and the new token ``uv`` gets arcs wherever ``u`` had them, into the state that ``v`` led to.  In
the end exactly the token sequences that BPE produces are paths.

All arcs on a token lead to one state, so a state is known by the token before it, and what a
gadget takes away - ``v`` and the later tokens that begin with it - is one interval when tokens
are numbered in post-order of their left parts.  The compiled table holds the missing arcs of
each state as such intervals; an arc exists if a binary search finds no interval.  A word is
encoded from left to right: of the tokens that end at a symbol exactly one has an arc from the
state reached where the token begins.  Decoding emits the labels of the arcs.

Vocabularies: files of the ``tokenizers`` library with a BPE model over bytes, an end-of-word
suffix and no decoder, each token made by one merge of earlier tokens.  Others are refused.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters of text that are split at once, and cells of one batch of words to be encoded.
PIECE, CELLS = 1 << 21, 1 << 20
#: Words whose tokens a task remembers; beyond it the memory starts anew.
REMEMBERED = 150_000
#: Code points that ``regex``, ``str.lower`` and ``unicodedata`` treat like the tokenizers
#: library whatever their Unicode versions.  Texts with others are split by that library.
SETTLED = regex.compile("[^\u0000-ԯ‐-‧‰-⁞₠-₿←-⏿─-➿ぁ-ゖァ-ヺ一-鿯가-힣]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


@dataclass
class Automaton:
    """Tables of the automaton.  Symbols: bytes, and 256 more for the last byte of a word."""

    #: Trie over the symbols of tokens: sorted ``node * 512 + symbol``, the node they lead to, its token or -1.
    steps: np.ndarray
    nodes: np.ndarray
    accepts: np.ndarray
    #: Place of each token in post-order of left parts, and the missing arcs: sorted first places
    #: (``state * size + place``) and last places of the intervals.
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    #: Label of each id, the special tokens among them.
    labels: list[str]
    specials: list[tuple[str, int]]
    pattern: str
    #: The file without its model, for texts beyond ``SETTLED``.
    shell: str

    def missing(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """True where a state has no arc on a token."""
        at = states.astype(np.int64) * len(self.place) + self.place[tokens]
        i = np.searchsorted(self.first, at, "right") - 1
        return (i >= 0) & (self.last[i] >= at)


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    model, splits = found["model"], (found.get("pre_tokenizer") or {}).get("pretokenizers") or []
    normalizers = [x["type"] for x in (found.get("normalizer") or {}).get("normalizers") or []]
    known = (
        model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
        and not (model.get("dropout") or model.get("ignore_merges")) and not found.get("decoder")
        and normalizers == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        and splits[0]["invert"] and splits[0]["behavior"] == "Removed" and not splits[1]["add_prefix_space"]
    )
    if not known:
        raise ValueError(f"{path}: not a byte-level BPE file with an end-of-word suffix")
    return found


def compiled(path: str) -> Automaton:
    """The automaton of a vocabulary file, which the driver reads."""
    file = _read(path)
    model, letters = file["model"], byte_letters()
    suffix, ids = model["end_of_word_suffix"], model["vocab"]
    symbol_ids = [ids[x] for x in letters] + [ids[x + suffix] for x in letters]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = np.array([(ids[u], ids[v], ids[u + v]) for u, v in pairs], np.int64).reshape(-1, 3)
    n = max(ids.values()) + 1

    rank = np.full(n, len(merges))
    rank[symbol_ids] = -1
    if len(np.unique(merges[:, 2])) < len(merges) or (rank[merges[:, 2]] == -1).any():
        raise ValueError(f"{path}: a token is made by two merges")
    rank[merges[:, 2]] = np.arange(len(merges))
    if (rank[merges[:, :2]] >= np.arange(len(merges))[:, None]).any():
        raise ValueError(f"{path}: a merge precedes one of its parts")

    # Post-order of left parts: sizes from the last merge to the first, starts from the first on.
    size = np.ones(n, np.int64)
    for u, _, uv in merges[::-1].tolist():
        size[u] += size[uv]
    size = size.tolist()
    fresh = [0] * n  # first place that tokens beginning with this one and made from now on will get
    place = [0] * n
    at = 0
    for s in symbol_ids:
        fresh[s], place[s] = at, at + size[s] - 1
        at += size[s]
    removed: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # of the state after a token, in rank order
    copied: list[tuple[int, int]] = [(-1, 0)] * n  # the state this one was copied from, and how much that had lost

    def lost(token: int) -> Iterator[tuple[int, int]]:
        upto = len(removed[token])
        while token >= 0:
            yield from removed[token][:upto]
            token, upto = copied[token]

    for u, v, uv in merges.tolist():
        if any(lo <= place[v] <= hi for lo, hi in lost(u)):
            raise ValueError(f"{path}: the merge of {u} and {v} can never take place")
        copied[uv] = (v, len(removed[v]))
        removed[u].append((fresh[v], place[v]))
        fresh[uv], place[uv] = fresh[u], fresh[u] + size[uv] - 1
        fresh[u] += size[uv]

    first, last = [], []
    for token in range(n):
        if gone := sorted(set(lost(token))):
            spans = np.array(gone, np.int64)
            reach = np.maximum.accumulate(spans[:, 1])
            opens = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1] + 1])
            first.append(spans[opens, 0] + token * n)
            last.append(reach[np.r_[opens[1:] - 1, len(spans) - 1]] + token * n)
    steps, nodes, accepts = _trie(merges, symbol_ids, n)
    labels = [""] * max(n, *(x["id"] + 1 for x in file["added_tokens"] or [{"id": 0}]))
    for label, i in ids.items():
        labels[i] = label
    specials = []
    for token in file["added_tokens"]:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"{path}: added token {token['content']} of an unknown form")
        labels[token["id"]] = token["content"]
        specials.append((token["content"], token["id"]))
    none = np.zeros(0, np.int64)
    shell = json.dumps(file | {"model": model | {"vocab": {}, "merges": []}, "added_tokens": []})
    return Automaton(
        steps, nodes, accepts, np.array(place), np.concatenate([none, *first]), np.concatenate([none, *last]),
        labels, specials, file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], shell,
    )


def _trie(merges: np.ndarray, symbol_ids: list[int], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    spelled: list[tuple[int, ...]] = [()] * n
    for symbol, token in enumerate(symbol_ids):
        spelled[token] = (symbol,)
    for u, v, uv in merges.tolist():
        spelled[uv] = spelled[u] + spelled[v]
    arcs: dict[int, int] = {}
    accepts = [-1]
    for token, word in enumerate(spelled):
        node = 0
        for symbol in word:
            node, above = arcs.get(node * 512 + symbol, -1), node
            if node < 0:
                node = arcs[above * 512 + symbol] = len(accepts)
                accepts.append(-1)
        if word:
            accepts[node] = token
    keys = np.array(sorted(arcs), np.int64)
    return keys, np.array([arcs[k] for k in keys.tolist()], np.int64), np.array(accepts, np.int64)


def encode_words(words: list[str], automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and the number of ids of each."""
    coded = [w.encode("utf-8", "surrogatepass") for w in words]
    length = np.array([len(b) for b in coded], np.int64)
    order = np.argsort(length, kind="stable")
    counts, parts, at = np.zeros(len(words), np.int64), [np.zeros(0, np.int64)], 0
    while at < len(order):
        # words of like length side by side: at most CELLS cells, or one word
        end = int(np.searchsorted(length[order], 2 * length[order[at]] + 16, "right"))
        widths = length[order[at:end]] * np.arange(1, end - at + 1)
        end = at + max(1, int(np.searchsorted(widths, CELLS, "right")))
        rows = order[at:end]
        flat, counts[rows] = _encode_block([coded[i] for i in rows], length[rows], automaton)
        parts.append(flat)
        at = end
    flat = np.concatenate(parts)
    begins = np.zeros(len(words), np.int64)
    begins[order] = np.cumsum(counts[order]) - counts[order]
    return flat[_ragged(begins, counts)], counts


def _ragged(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the runs of ``counts`` elements that begin at ``begins``, one run after the other."""
    ends = np.cumsum(counts)
    return np.repeat(begins - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _encode_block(coded: list[bytes], length: np.ndarray, automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    rows, width = len(coded), int(length.max())
    symbols = np.zeros((rows, width), np.int64)
    inside = np.arange(width) < length[:, None]
    symbols[inside] = np.frombuffer(b"".join(coded), np.uint8)
    filled = np.flatnonzero(length)
    symbols[filled, length[filled] - 1] += 256

    # all tokens in the words: walk the trie from every symbol at once
    row, start = np.nonzero(inside)
    node, step = np.zeros(len(row), np.int64), 0
    rows_of, starts, ends, tokens = [], [], [], []
    while len(row):
        keys = node * 512 + symbols[row, start + step]
        i = np.minimum(np.searchsorted(automaton.steps, keys), len(automaton.steps) - 1)
        known = automaton.steps[i] == keys
        row, start, node = row[known], start[known], automaton.nodes[i[known]]
        step += 1
        token = automaton.accepts[node]
        is_token = token >= 0
        rows_of.append(row[is_token]); starts.append(start[is_token]); tokens.append(token[is_token])  # noqa: E702
        ends.append(starts[-1] + step)
        on = start + step < length[row]
        row, start, node = row[on], start[on], node[on]
    row, start, end, token = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows_of, starts, ends, tokens))

    # the state after each symbol, left to right: the one token with an arc from where it begins
    order = np.argsort(end, kind="stable")
    row, start, end, token = row[order], start[order], end[order], token[order]
    bounds = np.searchsorted(end, np.arange(1, width + 2))
    state, begin = np.zeros((rows, width + 1), np.int64), np.zeros((rows, width + 1), np.int64)
    for e in range(1, width + 1):
        here = slice(bounds[e - 1], bounds[e])
        r, s, t = row[here], start[here], token[here]
        fits = (s == 0) | ~automaton.missing(state[r, s], t)
        r = r[fits]
        state[r, e], begin[r, e] = t[fits], s[fits]

    counts, parts, live, e = np.zeros(rows, np.int64), [], filled, length[filled]
    while len(live):
        parts.append((live, state[live, e]))
        counts[live] += 1
        e = begin[live, e]
        live, e = live[e > 0], e[e > 0]
    ends_at = np.cumsum(counts)
    flat = np.zeros(int(counts.sum()), np.int64)
    for i, (r, t) in enumerate(parts):
        flat[ends_at[r] - 1 - i] = t
    return flat, counts


class Encoder:
    """Encodes texts with an automaton and remembers the tokens of words."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.split = automaton, regex.compile(automaton.pattern)
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s, _ in automaton.specials) + ")") if automaton.specials else None
        self.library = None
        self.forget()

    def forget(self) -> None:
        self.known = {label: i for i, (label, _) in enumerate(self.automaton.specials)}
        self.flat = np.array([i for _, i in self.automaton.specials], np.int64)
        self.bounds = np.arange(len(self.flat) + 1)

    def words(self, text: str) -> list[str]:
        """The pre-split words and special tokens of a text; no word equals a special token."""
        if not self.special or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self._plain(part))]

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.split.findall(text.lower())
        if not SETTLED.search(text):
            # sigma has one small form here, wherever it stands
            return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.automaton.shell)
            self.bytes_of = {letter: b for b, letter in enumerate(byte_letters())}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes_of[c] for c in piece).decode("utf-8") for piece, _ in pieces]

    def __call__(self, texts: list[str | None]) -> pa.ListArray:
        split = [self.words(t) if t else [] for t in texts]
        every = set(chain.from_iterable(split))
        if len(self.known) + len(every) > REMEMBERED:
            self.forget()
        new = list(every - self.known.keys())
        if new:
            flat, counts = encode_words(new, self.automaton)
            self.known.update(zip(new, range(len(self.bounds) - 1, len(self.bounds) - 1 + len(new)), strict=True))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])
            self.flat = np.concatenate([self.flat, flat])
        sizes = np.array([len(s) for s in split], np.int64)
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        counts = self.bounds[index + 1] - self.bounds[index]
        gathered = self.flat[_ragged(self.bounds[index], counts)]
        offsets = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(gathered.astype(np.int32)))


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about PIECE characters."""
    sizes = np.asarray(pc.fill_null(pc.utf8_length(column), 0), np.int64)
    total, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PIECE, "right")) - 1)
        yield lo, hi
        lo = hi


def _over_batches(df: DataFrame, read: str, out: str, kind: T.DataType, compute) -> DataFrame:
    """``df`` with the column ``out`` made from ``read``, batch-wise and in place; no shuffle."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"there is a column {out} already")
    at, names = df.columns.index(read), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = compute()
        for batch in batches:
            for lo, hi in _slices(batch.column(at)) if pa.types.is_string(batch.column(at).type) else [(0, batch.num_rows)]:
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*rows.columns, step(rows.column(at))], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField(out, kind)]))


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All rows and columns of ``docs`` and the token ids of ``text`` as an array of int.

    Special tokens of the file are recognised where their string stands in the text; none are
    added.  A null and an empty text have no ids (an empty array).  Texts are never cut; a task
    holds about ``PIECE`` characters or one text, and the tokens of ``REMEMBERED`` words.  Rows
    are neither dropped nor moved, so repeated rows, ties and other columns stay; a column
    named like ``ids`` is refused with a ValueError.  The automaton is broadcast: its size is
    that of the vocabulary, not of the data.
    """
    tables = docs.sparkSession.sparkContext.broadcast(compiled(path))

    def compute():
        encoder = Encoder(tables.value)
        return lambda column: encoder(column.to_pylist())

    return _over_batches(docs, text, ids, T.ArrayType(T.IntegerType()), compute)


def decoded(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All rows and columns and the text of ``ids``: the labels of the arcs, one space between two.

    This is the library's decoding for files that name no decoder; special tokens are kept.  A
    null is read as no ids and gives an empty text.  Ids outside the vocabulary, and nulls in an
    array, emit nothing.
    """
    labels = tokens.sparkSession.sparkContext.broadcast(compiled_labels(path))

    def compute():
        table = pa.array(labels.value)

        def emit(column: pa.Array) -> pa.Array:
            column = pc.fill_null(column, pa.scalar([], column.type))
            flat, sizes = column.flatten(), np.asarray(pc.list_value_length(column), np.int64)
            values = np.asarray(pc.fill_null(flat, -1), np.int64)
            inside = (values >= 0) & (values < len(table))
            offsets = np.concatenate([[0], np.cumsum(inside)])[np.concatenate([[0], np.cumsum(sizes)])]
            strings = table.take(pa.array(values[inside]))
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), strings), " ")

        return emit

    return _over_batches(tokens, ids, text, T.StringType(), compute)


def compiled_labels(path: str) -> list[str]:
    """Label of each id of a vocabulary file."""
    file = _read(path)
    found = {i: label for label, i in file["model"]["vocab"].items()} | {x["id"]: x["content"] for x in file["added_tokens"]}
    return [found.get(i, "") for i in range(max(found) + 1)]
