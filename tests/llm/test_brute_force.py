"""Operators against plain computations, exact round trips and held-out accuracy on small tables."""

import collections
import hashlib
import itertools
import math
import pathlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from augurlog.llm import bit_mixing, chunk_dedup, decontaminate, mixing, near_dedup, pii, quality_crf, simhash, toxicity, url_filter
from augurlog.llm import tables as T, textcore

SF = pathlib.Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def grouped(sets, percent):
    """Smallest id reachable for every id."""
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def copies(make_docs):
    """Groups of near copies of all degrees, some linked through chains only."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(6):
        base = rng.choices(vocabulary, k=120)
        for _ in range(30):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009 + 1, " ".join(own)))
    return make_docs(rows)


@pytest.mark.parametrize("settings", [{}, {"large": 3, "leaders": 2, "rounds": 2, "block": 4}])
def test_near_duplicate_groups(copies, monkeypatch, settings):
    full = near_dedup.class_links
    monkeypatch.setattr(near_dedup, "class_links", lambda *a: full(*a, **settings))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(copies, 85).collect()}
    sets = {r.doc_id: shingles(r.text) for r in copies.collect()}
    want = grouped(sets, 85)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (want[i] == i) for i in sets)
    kept = near_dedup.keep_one(copies, 85)
    assert kept.columns == copies.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_repeated_ids_leave_one_row(make_docs):
    docs = make_docs([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "q r s t u v"), (None, "q r s t u v")])
    rows = near_dedup.keep_one(docs).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1]


def test_rows_without_an_id_are_kept_by_group(make_docs):
    base = [f"w{i}" for i in range(60)]
    near = lambda i: " ".join([*base[:i], "new", *base[i + 1 :]])
    ids = lambda rows: sorted((r.doc_id or 0) for r in near_dedup.keep_one(make_docs(rows)).collect())
    group = [(1, " ".join(base)), (None, near(0)), (None, near(59)), (None, near(1))]
    assert ids(group) == [1]
    # an unrelated row, and near copies among rows without an id only
    assert ids([*group, (None, "q r s t u v")]) == [0, 1]
    alone = [(None, " ".join(f"z{i}" for i in range(60))), (None, " ".join(f"z{i}" for i in range(59)))]
    assert ids([*group, *alone]) == [0, 1]
    assert ids([(None, None), (None, None), (None, " "), (7, "")]) == [0, 0, 0, 7]


def test_different_texts_under_one_id_stay(make_docs):
    rows = [(5, "a b c d e f"), (5, "k l m n o p"), (5, "k l m n o p"), (6, "k l m n o p")]
    kept = near_dedup.keep_one(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(5, "a b c d e f"), (5, "k l m n o p")]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in T.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_suffix_array_matches(spark, make_docs):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(12)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(40)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 9))) for _ in range(6)] + [" ".join(texts[i].split()[5:30]) for i in (3, 8, 9)]
    docs = make_docs(list(enumerate(texts)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, ["doc_id"], window=5, shard=150).collect()}
    for i, text in enumerate(texts):
        w, hit, found, matches = text.split(), set(), set(), [(0, -1)]
        for k, item in enumerate(items):
            v = item.split()
            size = min(5, len(v))
            for s in range(len(v) - size + 1):
                for at in range(len(w) - size + 1):
                    if size and w[at : at + size] == v[s : s + size]:
                        hit |= set(range(at, at + size))
                        found.add(str(k))
                        n = next((n for n in itertools.count(size) if w[at : at + n + 1] != v[s : s + n + 1] or s + n == len(v) or at + n == len(w)))
                        matches.append((-n, at))
        best = min(matches)
        assert (got[i].longest, got[i].longest_at) == (-best[0], best[1])
        assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (len(w), len(hit), len(found))
        assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert got[i].contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    longest = {(r.item_id, r.item_word): r for r in decontaminate.longest_matches(docs, bench, shard=150).collect()}
    for k, item in enumerate(items):
        v = item.split()
        for s in range(len(v)):
            want = max((n for text in texts for n in range(len(v) - s + 1) if n and f" {' '.join(v[s:s + n])} " in f" {text} "), default=0)
            row = longest.get((str(k), s))
            assert (row.length if row else 0) == want
            if row:
                assert texts[row.doc_id].split()[row.doc_word : row.doc_word + want] == v[s : s + want]


def test_longest_match_names_the_smallest_id(spark, make_docs):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = make_docs([(9, f"a {passage} b"), (5, passage), (None, passage), (2, f"c d {passage}"), (3, "other words")]).coalesce(1)
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    row = {r.item_word: r for r in decontaminate.longest_matches(docs, bench).collect()}[0]
    assert (row.length, row.doc_id, row.doc_word) == (20, 2, 2)


def test_suffix_array_order():
    w = np.array([3, 1, 2, 1, 2, 1, 2, 0, 1, 2, 1, 0], np.uint64)
    order = decontaminate.suffix_array(w, 20)
    assert order.tolist() == sorted(range(len(w)), key=lambda i: tuple(w[i:]))


@needs_tables
def test_simhash_of_texts_and_neighbours(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id: r for r in simhash.with_neighbours(simhash.with_next(docs)).collect()}
    distance = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for i, r in enumerate(rows):
        text, following = r.text or "", rows[(i + 1) % len(rows)]
        k = len(text) // 4
        edited = text[: len(text) - k] + (following.text or "")[:k]
        g = got[r.doc_id]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.edited_fingerprint == simhash.fingerprints(pa.array([edited]))[0].tobytes().hex()
        assert g.near_edited == pytest.approx(1 - distance(g.fingerprint, g.edited_fingerprint) / 128)
        assert g.near_next == pytest.approx(1 - distance(g.fingerprint, got[following.doc_id].fingerprint) / 128)
        if r.doc_id % 100 == 0:
            assert g.n_near == sum(distance(g.fingerprint, x.fingerprint) <= simhash.RADIUS for x in got.values()) - 1
    assert np.mean([g.near_edited > g.near_next for g in got.values()]) > 0.98


def test_block_tables_find_all(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(128) for _ in range(5)]
    marks = sorted({b ^ sum(1 << i for i in rng.sample(range(128), k)) for b in base for k in (0, 1, 2, 3, 4, 5) for _ in range(6)})
    df = spark.createDataFrame([(f"{m:032x}",) for m in marks], "fingerprint string")
    got = {(r["query"], r["fingerprint"]): r.distance for r in simhash.near(df, df).collect()}
    want = {(f"{a:032x}", f"{b:032x}"): (a ^ b).bit_count() for a in marks for b in marks if (a ^ b).bit_count() <= 3}
    assert got == want


@needs_tables
def test_unigram_base_and_mixing(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    rows = docs.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
    count = collections.Counter(w for r in rows if not held[r.doc_id] for w in [*words(r.text), ""])
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in bit_mixing.scored(docs).collect()}
    for r in rows:
        tokens, g = [*words(r.text), ""], got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[r.doc_id], len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert g.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert g.score < 0


def test_bit_chances_are_a_distribution():
    """All words of two letters over a small alphabet, and all longer ones, share a chance of 1."""
    letters = b"abcdefgh"
    known = [bytes(p) for n in (1, 2) for p in itertools.product(letters, repeat=n)]
    w = bit_mixing.Words(known, np.arange(len(known)) % 5)
    tables = bit_mixing.no_counts()
    tables = bit_mixing.bit_tables(bit_mixing.byte_counts(w, tables))
    total = (10 ** bit_mixing.prices(w, {}, tables, bit_mixing.Mixer())).sum()
    assert 0.5 < total < 1


def test_ranges_sum_to_the_whole():
    """Prices from parts of the vocabulary with shared splits equal those from one part."""
    rng = random.Random(2)
    known = sorted({bytes(rng.choices(b"abc\xc3\xa9 "[:5], k=rng.randrange(0, 9))) for _ in range(400)} | {b"x" * 70, b"x" * 70 + b"y"})
    counts = np.array([rng.choice([0, 1, 1, 5, 90]) for _ in known])
    whole, mixer = bit_mixing.Words(known, counts), bit_mixing.Mixer()
    tables = bit_mixing.no_counts()
    tables = bit_mixing.bit_tables(bit_mixing.byte_counts(whole, tables))
    want = bit_mixing.prices(whole, {}, tables, mixer)
    parts = [bit_mixing.Words(known[a : a + 97], counts[a : a + 97]) for a in range(0, len(known), 97)]
    shared = collections.defaultdict(lambda: [0, 0, 0, 0])
    for p in parts:
        for key, sums in bit_mixing.spine(p).items():
            shared[key] = [a + b for a, b in zip(shared[key], sums, strict=True)]
    got = np.concatenate([bit_mixing.prices(p, dict(shared), tables, mixer) for p in parts])
    assert np.allclose(got, want)


def test_shared_bits_are_predicted_once(monkeypatch):
    """Words that begin alike cost one prediction a bit for what they share, and have the prices they have one by one."""
    known = [b"a" * 30 + bytes([x, y]) for x in range(97, 117) for y in range(97, 117)]
    counts = np.arange(len(known)) % 4
    w, mixer = bit_mixing.Words(known, counts), bit_mixing.Mixer()
    tables = bit_mixing.bit_tables(bit_mixing.byte_counts(w, bit_mixing.no_counts()))
    follow = collections.Counter()
    for word in (x for x, c in zip(known, counts, strict=True) if c):
        for place in range(len(word) + 1):
            last = np.frombuffer((b"\0" * 5 + word)[place : place + 5], np.uint8)[None]
            cell = int(bit_mixing.contexts(last, np.array([place]), 0)[0][0]) * (bit_mixing.END + 1)
            follow[cell + (word[place] if place < len(word) else bit_mixing.END)] += 1
    plain = bit_mixing.byte_counts(w, bit_mixing.no_counts())[0]
    assert {int(i): int(plain[i]) for i in np.flatnonzero(plain)} == dict(follow)
    predicted, real = [], bit_mixing._predict
    monkeypatch.setattr(bit_mixing, "_predict", lambda n0, *rest: predicted.append(len(n0)) or real(n0, *rest))
    together = bit_mixing.prices(w, {}, tables, mixer)
    assert sum(predicted) < len(known) * 30
    own = bit_mixing.spine(w)
    alone = [bit_mixing.Words([x], counts[i : i + 1]) for i, x in enumerate(known)]
    shared = collections.defaultdict(lambda: [0, 0, 0, 0])
    for part in alone:
        for key, sums in bit_mixing.spine(part).items():
            shared[key] = [a + b for a, b in zip(shared[key], sums, strict=True)]
    assert all(shared[k] == v for k, v in own.items())
    assert np.allclose(together, [bit_mixing.prices(x, dict(shared), tables, mixer)[0] for x in alone])


def test_a_range_gets_the_sums_it_shares(spark):
    """A range holds sums of its own bits only, and of these the ones that other ranges have too."""
    rows = [(0, "a", 1, 2), (0, "b", 3, 4), (1, "b", 10, 20), (1, "c", 5, 5), (2, "c", 6, 1), (3, "d", 9, 9)]
    nodes = spark.createDataFrame([(p, n, x, y, x, y) for p, n, x, y in rows], "part int, node string, s0 long, s1 long, s2 long, s3 long")
    got = {r.part: {x.node: [x.s0, x.s1, x.s2, x.s3] for x in r.nodes} for r in bit_mixing.over_borders(nodes).collect()}
    b, c = [13, 24, 13, 24], [11, 6, 11, 6]
    assert got == {0: {"b": b}, 1: {"b": b, "c": c}, 2: {"c": c}}


def test_kind_of_text_so_far():
    """The kind at a word is that of most frequent words before it in its text, the smaller one of equals."""
    rng = np.random.default_rng(4)
    top, group = np.sort(rng.integers(1, 1 << 62, 20).astype(np.uint64)), rng.integers(0, 4, 20)
    ends = np.array([0, 0, 40, 41, 41, 100, 130])
    flat = np.where(rng.random(130) < 0.4, rng.choice(top, 130), rng.integers(1, 1 << 62, 130).astype(np.uint64))
    flat[100:] = 7
    want = []
    for a, b in itertools.pairwise(ends):
        seen = collections.Counter()
        for h in [*flat[a:b].tolist(), None]:
            want.append(min(seen, key=lambda k: (-seen[k], k)) if seen else bit_mixing.KINDS)
            seen.update(group[top == h].tolist() if h is not None else [])
    assert bit_mixing.kinds_so_far(flat, ends, top, group).tolist() == want


def test_mix_is_cut_at_the_budget(spark):
    """The cut of the range-sorted finish times equals the one of a plain sort, with ties and for every budget."""
    rng = random.Random(5)
    rows = [([a, a + 4.0] if i % 9 else [None, None], rng.randrange(0, 30)) for i in range(400) for a in [rng.randrange(60) / 8]]
    timed = spark.createDataFrame(rows, "times array<double>, size long")
    words = collections.Counter()
    for times, size in rows:
        for t in times:
            words[t] += size if t is not None and size else 0
    order = sorted(t for t in words if t is not None and words[t])
    for budget in (0.0, float(words[order[0]]), 0.3 * sum(words.values()), 0.77 * sum(words.values()), 1e9):
        fits, total = [], 0
        for t in order:
            total += words[t]
            if total <= budget:
                fits.append(t)
        got = mixing._cut(timed, budget)
        assert got == fits[-1] if fits else got < order[0]
    assert mixing._cut(timed.limit(0), 5.0) == 0.0


def test_repeats_across_documents(make_docs):
    rng = random.Random(7)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))
    passage = fresh(70)
    rows = [(i, f"{fresh(40)} {passage} {fresh(rng.randrange(5, 40))}" if i % 3 == 0 else fresh(90)) for i in range(1, 40)]
    got = {r.doc_id: r for r in chunk_dedup.deduplicated(make_docs(rows), ["doc_id"]).collect()}
    middle = passage[len(passage) // 2 - 20 : len(passage) // 2 + 20]
    for i, text in rows:
        if i % 3 == 0 and i != 3:
            assert got[i].n_removed >= 150 and middle not in got[i].text and got[i].repeats_of[0] == 3
            assert len(got[i].text) + got[i].n_removed == len(text)
        else:
            assert got[i].n_removed == 0 and got[i].text == text and got[i].repeats_of == []


def shared_bytes(text, earlier, size):
    """Mask of the bytes that lie in a stretch of ``size`` bytes which an earlier text has."""
    known = {e[i : i + size] for e in earlier for i in range(len(e) - size + 1)}
    mask = np.zeros(len(text), bool)
    for i in range(len(text) - size + 1):
        if text[i : i + size] in known:
            mask[i : i + size] = True
    return mask


def test_repeats_are_whole(make_docs):
    """Passages of 51 words go, but for parts of words at either end, also of short words, of repeated phrases and of one character."""
    rng = random.Random(11)
    word = lambda least, most: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(least, most)))
    fresh = lambda n, least=2, most=9: " ".join(word(least, most) for _ in range(n))
    phrase = fresh(4)
    passages = [*(fresh(51, 1, 1) for _ in range(20)), *(fresh(51, 1, 3) for _ in range(20)), *(fresh(51) for _ in range(20)), *(" ".join([fresh(1, k, k)] * 51) for k in range(1, 8)), " ".join([phrase] * 15), "z" * 420]
    rows = []
    for i, passage in enumerate(passages):
        rows += [(2 * i + 1, f"{fresh(30)}<{passage}>{fresh(30)}"), (2 * i + 2, f"{fresh(20)}[{passage}]{fresh(20)}")]
    # A document that has the first words only, and one that comes first with a stock phrase.
    tail = fresh(90)
    rows += [(1000, tail[:45] + " " + fresh(20)), (1001, f"{fresh(20)} {tail}"), (1002, f"{fresh(20)} _ {tail[:420]}_ {fresh(20)}")]
    # Passages of 30 words stay.
    short = fresh(30)
    rows += [(1003, f"{fresh(40)} {short} {fresh(40)}"), (1004, f"{fresh(40)} {short} {fresh(40)}")]
    got = {r.doc_id: r for r in chunk_dedup.deduplicated(make_docs(rows), ["doc_id"]).collect()}
    for i, text in rows:
        mask = shared_bytes(text, [t for j, t in rows if j < i], 200 if i >= 1000 else 90)
        gone = got[i].n_removed
        if i in (1003, 1004) or not mask.any():
            assert gone == 0 and got[i].text == text, (i, text)
        else:
            at = int(mask.argmax())
            assert mask.sum() - 40 < gone <= mask.sum(), (i, gone, mask.sum(), text)
            assert any(at <= b < at + 20 and got[i].text == text[:b] + text[b + gone :] for b in range(len(text)))
            assert i % 2 == 0 and i != 1000
    assert all(2 * i + 1 in got[2 * i + 2].repeats_of for i in range(len(passages))) and 1001 in got[1002].repeats_of


def test_repeats_of_many_pieces(make_docs):
    """Stretches of a few earlier documents, in any number and of any length: no passage stays, and nothing goes that no earlier document has."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abé ü😀ß", k=rng.randint(2, 9))).strip() or "b"
    source = [" ".join(word() for _ in range(150)).split() for _ in range(6)]
    rows = [(i, " ".join(s)) for i, s in enumerate(source)]
    for i in range(10, 60):
        cut = lambda: (s := rng.choice(source))[(a := rng.randrange(100)) : a + rng.choice([4, 9, 15, 30, 45])]
        rows.append((i, " ".join(w for _ in range(6) for w in cut())))
    min_words = 20
    got = {r.doc_id: r for r in chunk_dedup.deduplicated(make_docs(rows), ["doc_id"], min_words=min_words).collect()}
    for i, text in rows:
        words, earlier = text.split(), [t.split() for j, t in rows if j < i]
        grams = lambda n: {tuple(e[k : k + n]) for e in earlier for k in range(len(e) - n + 1)}
        known, any_known = grams(min_words + 1), grams(1)
        must = np.zeros(len(words), bool)
        for k in range(len(words) - min_words):
            must[k : k + min_words + 1] |= tuple(words[k : k + min_words + 1]) in known
        gone = len(words) - len(got[i].text.split())
        assert gone <= sum((w,) in any_known for w in words) and (gone > 0 or not must.any())
        # Up to the width of a cut may stay at an end that other first holders cover.
        edges = np.count_nonzero(must[1:] != must[:-1]) + 2
        assert gone >= must.sum() - edges * chunk_dedup.width_of(min_words), (i, gone, must.sum())
        assert len(got[i].text.encode()) + got[i].n_removed == len(text.encode())


def test_long_stretches_are_no_repeats_of_short_ones(make_docs):
    """A word or phrase said often is a repeat as far as an earlier document says it as often."""
    rng = random.Random(15)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))
    rows = []
    for i, (few, many) in enumerate([(25, 90), (30, 300), (90, 70), (60, 200)]):
        unit = fresh(1 + i % 2)
        rows += [(2 * i + j, f"{fresh(30)} {' '.join([unit] * (n // (1 + i % 2)))} {fresh(30)}") for j, n in enumerate((few, many))]
    got = {r.doc_id: len(t.split()) - len(r.text.split()) for (i, t), r in zip(rows, sorted(chunk_dedup.deduplicated(make_docs(rows), ["doc_id"]).collect()), strict=True)}
    assert [got[i] for i in (0, 1, 2, 3, 4, 6)] == [0] * 6 and 60 <= got[5] <= 70 and 50 <= got[7] <= 64, got


def test_chunk_bounds_shift_with_insertions():
    """Bytes put in or taken out change the chunks near them only; all others are found at the shifted place, and bounds follow the definition."""
    rng = random.Random(13)
    for _ in range(20):
        words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 9))) for _ in range(600)]
        at = rng.randrange(100, 500)
        other = words[:at] + [f"new{k}" for k in range(rng.randrange(1, 40))] + words[at + rng.randrange(0, 3) :]
        a, b = (next(chunk_dedup.chunks(pa.array([" ".join(w)]))) for w in (words, other))
        width = chunk_dedup.width_of(chunk_dedup.MIN_WORDS)
        assert (a.ends[:-1] == a.starts[1:]).all() and (np.searchsorted(a.places, a.ends) - np.searchsorted(a.places, a.starts) <= width).all()
        shift = len(b.data) - len(a.data)
        place = len(" ".join(words[:at]).encode())
        before = {(s, d) for s, d in zip(a.starts.tolist(), a.digest.tolist(), strict=True)}
        after = {(s, d) for s, d in zip(b.starts.tolist(), b.digest.tolist(), strict=True)} | {(s - shift, d) for s, d in zip(b.starts.tolist(), b.digest.tolist(), strict=True)}
        lost = [s for s, d in before - after]
        assert all(place - 3 * width * 19 < s < place + 3 * width * 19 for s in lost) and len(lost) <= 8
        # Each cut is the first smallest hash of some window of places, and each window's smallest is a cut.
        data = " ".join(words).encode()
        gear = lambda p: sum(int(chunk_dedup._GEAR[data[p + 15 - k]]) << k for k in range(16)) & 0xFFFFFFFF
        starts = [p for p in range(len(data)) if (p == 0 or data[p - 1] == 32) and p + 16 <= len(data)]
        hashes = [gear(p) for p in starts]
        cuts = sorted({min(range(k, k + width), key=lambda j: (hashes[j], j)) for k in range(len(starts) - width + 1)})
        assert [starts[j] for j in cuts] == [*a.starts.tolist(), int(a.ends[-1])]


def test_hot_chunks_are_joined_apart(make_docs, monkeypatch):
    """The broadcast join of digests with very many rows gives the same rows."""
    rng = random.Random(14)
    fresh = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))
    common, rare = fresh(70), fresh(70)
    docs = make_docs([(i, f"{fresh(20)} {common} {fresh(20)}" + (f" {rare} {fresh(9)}" if i % 10 == 0 else "")) for i in range(60)])
    want = sorted(map(tuple, chunk_dedup.deduplicated(docs, ["doc_id"]).collect()))
    whole, floors = chunk_dedup._with_few, []

    def low(rows, few, keys):
        floors.append(few.where("n > 20").count())
        return whole(rows, few.withColumn("n", F.expr("IF(n > 20, n + 1000000, n)")), keys)

    monkeypatch.setattr(chunk_dedup, "_with_few", low)
    assert sorted(map(tuple, chunk_dedup.deduplicated(docs, ["doc_id"]).collect())) == want and all(floors)
    assert sum(r[2] > 0 for r in want) == 59


def test_surrogates_of_other_countries(make_docs):
    """Phone numbers of several countries and IPv6 addresses go; their format and country code stay."""
    found = ["+49 30 1234567", "+44 20 7946 0958", "+33 1 23 45 67 89", "+34 912 345 678", "+49 (0)30 7654321", "030 1234567", "020 7946 0958", "01 23 45 67 89", "912 345 678", "912 34 56 78", "212 555 1234",
             "2001:db8:85a3:0:0:8a2e:370:7334", "2001:db8::ff00:42:8329", "fe80::1ff:fe23:4567:890a"]
    other = ["on 01-02-2024 12 came", "at 12:30:45", "std::vector x1::y", "about 1 234 567 in 2024", "word 030"]
    rows = [(i, f"Tel. {v}, Ende") for i, v in enumerate(found)] + [(100 + i, v) for i, v in enumerate(other)]
    got = {r.doc_id: r for r in pii.pseudonymised(make_docs(rows), "k").collect()}
    shape = lambda v: re.sub("[0-9a-f]", "0", v)
    for i, v in enumerate(found):
        new = got[i].text[5:-6]
        assert got[i].n_entities == 1 and new != v and shape(new) == shape(v), (v, got[i].text)
        assert not v.startswith("+") or new.split()[0] == v.split()[0]
    assert got[0].text[9:-6] == got[5].text[6:-6] and got[2].text[9:-6] == got[7].text[6:-6]
    assert all(got[100 + i].text == v for i, v in enumerate(other))


def test_surrogates(make_docs):
    phones = [f"+1 ({200 + i}) 555-{1000 + i}" for i in range(300)]
    rows = [(i, f"call {p} or mail u{i}@mail.example.com about password=ab12cd{i:04d}x, {i}.") for i, p in enumerate(phones)]
    rows += [(1000 + i, f"again {p[3:]} and {p.replace(' ', '-').replace('(', '').replace(')', '')}") for i, p in enumerate(phones[:20])]
    rows += [(2000, "Frau Anna Schmidt, Mrs. Schmidt and Mr. Peter Smith; card 4111 1111 1111 1111"), (2001, "nothing here but 12 words and version 3.0")]
    got = {r.doc_id: r for r in pii.pseudonymised(make_docs(rows), "k").collect()}
    new = [re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[i].text)[0] for i in range(300)]
    assert len(set(new)) == 300 and not set(new) & set(phones)
    for i in range(20):  # one surrogate per number, in each mention's format
        digits = re.sub(r"\D", "", new[i])[1:]
        assert re.sub(r"\D", "", got[1000 + i].text) == digits + "1" + digits
        assert got[1000 + i].text.startswith(f"again {new[i][3:]} and +1-{digits[:3]}-")
    for i, text in rows[:300]:
        assert phones[i] not in got[i].text and f"u{i}@" not in got[i].text and f"{i:04d}x" not in got[i].text and got[i].n_entities == 3
        assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or mail [a-z]\d+@[a-z]{4}\.[a-z]{7}\.com about password=[a-z0-9]{11}, \d+\.", got[i].text)
    first, surname = re.match(r"Frau (\w+) (\w+), Mrs\. (\w+) and", got[2000].text).group(1, 2), re.search(r"Mrs\. (\w+)", got[2000].text)[1]
    assert first[0] in pii.GIVEN["f", "latin"] and first[1] == surname != "Schmidt"
    card = re.sub(r"\D", "", got[2000].text)
    assert re.search(r"card 4\d{3} \d{4} \d{4} \d{4}$", got[2000].text)
    assert sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(card))) % 10 == 0
    assert got[2001].text == rows[-1][1] and got[2001].n_entities == 0


def test_surrogates_of_very_long_mentions(make_docs):
    """Thousands of what each pattern repeats: no pattern runs out of stack."""
    texts = [
        "x@" + "a." * 4000 + "com", "a" * 8000 + "@b.example.com", "password=" + "s" * 8000, "+1" + " 2" * 4000, "1.2.3." * 1500, "2001:" * 1500,
        "DE12 " + "ABCD " * 1500, "Mrs. A" + "a" * 8000, "0" + "12 34 " * 1500, "1 " * 4000, "a@" * 4000, "Frau " * 1500,
    ]
    got = {r.doc_id: r for r in pii.pseudonymised(make_docs([*enumerate(texts), (100, "mail me@mail.example.com")]), "k").collect()}
    assert len(got) == len(texts) + 1 and got[100].n_entities == 1
    for i in (0, 1, 2):
        assert got[i].n_entities == 1 and got[i].text != texts[i]


def test_pattern_of_a_million_labels(spark):
    """The pattern itself, on domains of megabytes."""
    text = spark.range(1).selectExpr("concat('x@', repeat('a.', 1000000), 'com and y@b.de') AS t")
    assert text.select(F.regexp_count("t", F.lit(pii.PATTERN))).first()[0] == 2


def test_surrogates_stay_apart_when_values_run_out(spark):
    units = spark.createDataFrame([("ip", f"1.1.1.{i}") for i in range(50)] + [("ssn", f"{i}") for i in range(10)], "kind string, norm string")
    got = pii.surrogates(units, "k").collect()
    assert len(got) == 60 and len({(r.kind, r.sur) for r in got}) == 60
    assert not {(r.kind, r.sur) for r in got} & {(r.kind, r.norm) for r in got}


@needs_tables
@pytest.mark.parametrize("judge,label,least", [(quality_crf.judged, "quality", 0.95), (toxicity.judged, "toxic", 0.8)])
def test_held_out_accuracy(spark, judge, label, least):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = judge(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got[label]).mean() > least


def test_counterfactual_penalty(make_docs, spark):
    """A group named mostly in toxic texts: the penalty keeps neutral mentions clean."""
    rng = random.Random(4)
    plain = [f"p{i}" for i in range(60)]
    rows, marks = [], []
    for i in range(600):
        toxic = i % 3 == 0
        text = rng.choices(plain, k=12) + (["scum"] if toxic and rng.random() < 0.6 else []) + (["muslims"] if rng.random() < (0.8 if toxic else 0.05) else ["jews"] if rng.random() < 0.2 else [])
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    docs, labels = make_docs(rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    neutral = pa.array(["p1 p2 muslims p3", "p1 p2 jews p3"])
    with_penalty = toxicity.train(docs, labels, penalty=5.0).score(neutral)
    without = toxicity.train(docs, labels, penalty=0.0).score(neutral)
    assert without[0] - without[1] > 0.3
    assert abs(with_penalty[0] - with_penalty[1]) < 0.15 and with_penalty[0] < without[0]


def test_forward_backward_equals_all_paths():
    emission, stay = np.array([0.3, -1.0, 2.0, 0.1]), 0.7
    ahead, behind = quality_crf.forward_backward(emission, stay, quality_crf.Chains(np.array([4])))
    weight = {p: math.exp(sum(e for e, s in zip(emission, p, strict=True) if s) + stay * sum(a == b for a, b in zip(p, p[1:], strict=False))) for p in itertools.product((0, 1), repeat=4)}
    for t in range(4):
        good = sum(w for p, w in weight.items() if p[t]) / sum(weight.values())
        assert 1 / (1 + math.exp(-(ahead + behind)[t])) == pytest.approx(good)


def test_ranks_over_links(spark):
    pages = [(1, "http://good.com/en/", '<a href="http://friend.org/">x</a> <a href=//far.org/y>'), (2, "http://bad.org/x/", ""), (3, "http://farm.org/", "<a href='https://BAD.org/x/1'>"), (4, "http://friend.org/", ""), (5, "http://lone.org/", "")]
    rules = spark.createDataFrame([("good.com", "/", "allow"), ("bad.org", "/x/", "block")], "host string, path string, verdict string")
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow"}
    assert got[3].rule is None
    # Against the power method on a small random graph.
    rng = np.random.default_rng(0)
    hosts = [f"h{i}" for i in range(12)]
    counts = rng.integers(0, 3, (12, 12)) * (1 - np.eye(12, dtype=int))
    links = spark.createDataFrame([(hosts[i], hosts[j], int(counts[i, j])) for i in range(12) for j in range(12) if counts[i, j]], "src string, dst string, n long")
    seeds = np.zeros(12)
    seeds[[1, 4]] = 1.0, 3.0
    start = seeds / seeds.sum()
    rank = start
    for _ in range(url_filter.ITERATIONS):
        rank = 0.15 * start + 0.85 * rank @ (counts / np.maximum(counts.sum(1, keepdims=True), 1))
    frame = spark.createDataFrame([("h1", 1.0), ("h4", 3.0)], "host string, weight double")
    found = {r["host"]: r["rank"] for r in url_filter.spread(frame, links, "src", "dst").collect()}
    assert all(found.get(h, 0.0) == pytest.approx(rank[i]) for i, h in enumerate(hosts))


def test_kinds_of_text_are_counted_over_all_texts(make_docs, monkeypatch):
    """Words and pairs are those of every training text, also where tasks lower their counts."""
    rng = random.Random(11)
    often = [f"w{k}" for k in range(300)]
    texts = [" ".join(dict.fromkeys(rng.choices(often, weights=range(300, 600), k=12))) + f" x{i}" for i in range(5000)]
    docs = make_docs(list(enumerate(texts))).repartition(3)
    train = docs.doc_id % 5 != 1
    hashed = lambda w: textcore.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]
    count = collections.Counter(w for i, t in enumerate(texts) if i % 5 != 1 for w in t.split())
    by_hash = {int(hashed(w)): n for w, n in count.items()}
    want = sorted(sorted(by_hash), key=lambda h: -by_hash[h])[: bit_mixing.FREQUENT]
    assert bit_mixing.text_kinds(docs, train)[0].tolist() == sorted(want)
    for kept in (4000, 400, 50):
        monkeypatch.setattr(bit_mixing, "KEPT", kept)
        assert bit_mixing.text_kinds(docs, train)[0].tolist() == sorted(want)
    both, n = bit_mixing.texts_with_both(docs.where(train).select("text"), np.array(sorted(want), np.uint64))
    assert n == 4000 and np.diag(both).tolist() == [by_hash[h] for h in sorted(want)]


def test_shards_take_little_memory():
    """A batch of a million words is cut in pieces and shards that take a few dozen megabytes."""
    rng = np.random.default_rng(3)
    column = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 50_000, 300)) for _ in range(4000)], pa.string())
    tracemalloc.start()
    try:
        for _, shard in decontaminate._shards(column, decontaminate.SHARD):
            decontaminate.suffix_array(shard, 20)
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()
