"""Spelling variants, the tokenization automaton and hard negatives against plain versions."""

import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from augurlog.llm import bpe_automaton, hard_negatives, queries, spelling

PATH = public_tokenizers.path("word_bpe_49k.json")


# --- spelling -----------------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_vocabulary(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def plain_variants(n):
    wild, near, form = defaultdict(list), defaultdict(set), {}
    for w in n:
        for i in range(len(w)):
            wild[i, w[:i] + w[i + 1 :]].append(w)
    for (_, rest), words in wild.items():
        for a in words:
            near[a].update(b for b in words if b != a)
            if rest in n:
                near[a].add(rest), near[rest].add(a)
    for w in n:
        if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= 10 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_variants_of_documents(make_docs):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(7, 11))) for _ in range(120)]
    rows = []
    for i in range(400):
        words = []
        for w in rng.choices(base, weights=[1 / (k + 1) ** 2 for k in range(120)], k=60):
            at, kind = rng.randrange(len(w)), rng.random()
            w = w if kind < 0.8 else w[:at] + rng.choice(["", "x", "ab"]) + w[at + 1 :]
            words.append(rng.choice([w, w.upper(), w.title()]))
        rows.append((i, ", ".join(words)))
    rows += [(None, "abcdefgh abcdefgh"), (1, None), (2, ""), (3, "short"), (7, "z" * 4000 + " " + "z" * 4001 + " " + "z" * 3999 + "y"), (7, "z" * 4000 + " " + "z" * 4001)]
    got = rows_of(spelling.variants(spelling.vocabulary(make_docs(rows))))
    want = plain_variants(plain_vocabulary(rows))
    assert got == want and sum(r[1] is not None for r in got) > 20 and max(r[4] for r in got) > 3


def test_large_groups_are_halved(spark, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP", 3)
    rng = random.Random(5)
    words = {"international" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(700)}
    n = {w: rng.choice([2, 3, 40, 500, 9000]) for w in words}
    table = spark.createDataFrame(list(n.items()), "word string, n bigint")
    sizes = spelling.groups(table).groupBy("key", "m", "lo", "hi").count()
    assert sizes.where("hi - lo > 1 AND count > 3").isEmpty() and sizes.agg(F.max("count")).first()[0] <= 8
    assert rows_of(spelling.variants(table)) == plain_variants(n)


def test_near_of_one_block():
    words = ["abcdefg", "abcdefgh", "abcdefx", "bcdefgh", "abcdef", "xabcdefg", "abcdefg", "abdcefg", "abccdefg"]
    zeros = np.zeros(len(words), np.int64)
    got = [set(), set()]
    for m in (7, 8):
        q, v = spelling._near(words, zeros, zeros + m, zeros, zeros + m)
        got[m - 7] = {(words[a], words[b]) for a, b in zip(q, v)}
    pairs = {("abcdefg", "abcdefx"), ("abcdefg", "abcdef"), ("abcdefx", "abcdef")}
    assert got[0] == pairs | {(b, a) for a, b in pairs}
    pairs = {("abcdefg", "abcdefgh"), ("bcdefgh", "abcdefgh"), ("abcdefg", "xabcdefg"), ("abcdefg", "abccdefg")}
    assert got[1] == pairs | {(b, a) for a, b in pairs}


def test_empty_vocabularies(spark, make_docs):
    assert spelling.variants(spelling.vocabulary(make_docs([]))).count() == 0
    one = spark.createDataFrame([("abcdefg", 2), (None, 3), ("abcdefh", None)], "word string, n bigint")
    assert rows_of(spelling.variants(one)) == [("abcdefg", None, "abcdefg", 2, 0, None)]


# --- tokenization automaton ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def automaton():
    return bpe_automaton.compiled(PATH)


ODD = [
    "", " \n\t", "<|endoftext|>", "a<|startoftext|><|endoftext|>b", "<|endoftext", "don't we'll I'M", "aaaa aaaaa " + "a" * 3000, "ΑΣ Σ ς", "İstanbul",
    "café é", "字が한국어 🙂🙂", "՘a࢏ \U0003fc3b", "\x00\x85\xa0 ", "x" * 40_000, "https://www.example.com/" * 200, "ha" * 2000,
]


def test_automaton_equals_library(spark, automaton):
    rng, library = random.Random(1), Tokenizer.from_file(PATH)
    letters = "aabbethinorsABÉß'’ 12́İΣσ<|endoftext|>\n\t字が한🙂՘"
    tokens = sorted(library.get_vocab())
    texts = ODD + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(800)]
    texts += ["".join(rng.choice(tokens).replace("</w>", "") for _ in range(5)) for _ in range(800)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, None, None, None)], "doc_id long, text string, word string, id string")
    rows = bpe_automaton.decoded(bpe_automaton.encoded(docs, PATH), PATH).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.word == (None if r.doc_id is None else "clash")


def test_every_token_is_its_own_encoding(automaton):
    bytes_of = {c: b for b, c in enumerate(bpe_automaton.byte_letters())}
    last = [i for i, label in enumerate(automaton.labels) if label.endswith("</w>")]
    rng = random.Random(2)
    whole = []
    for i in rng.sample(last, 4000):
        try:
            whole.append((i, bytes(bytes_of[c] for c in automaton.labels[i].removesuffix("</w>")).decode()))
        except UnicodeDecodeError:  # a token that is part of a character
            continue
    flat, counts = bpe_automaton.encode_words([w for _, w in whole], automaton)
    assert (counts == 1).all() and flat.tolist() == [i for i, _ in whole]


def test_forgetting_changes_nothing(automaton, monkeypatch):
    words = [f"word{i} other{i % 50} Straße" for i in range(300)]
    full = bpe_automaton.Encoder(automaton)(words).to_pylist()
    monkeypatch.setattr(bpe_automaton, "REMEMBERED", 40)
    monkeypatch.setattr(bpe_automaton, "CELLS", 50)
    encoder = bpe_automaton.Encoder(automaton)
    assert [x for i in range(0, 300, 7) for x in encoder(words[i : i + 7]).to_pylist()] == full


def test_decoding_skips_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [320, None, 10**6, -1, 49407]), (2, None), (3, [])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe_automaton.decoded(rows, PATH).collect()}
    assert got == {1: Tokenizer.from_file(PATH).id_to_token(320) + " <|endoftext|>", 2: "", 3: ""}
    assert bpe_automaton.decoded(rows.limit(0), PATH).count() == 0
    with pytest.raises(ValueError, match="a column ids already"):
        bpe_automaton.encoded(rows, PATH, text="k")


@pytest.mark.parametrize("change", [{"decoder": {"type": "BPEDecoder"}}, {"merges": [["i", "n"], ["in", "g"], ["i", "n"]]}, {"merges": [["in", "g"], ["i", "n"]]}])
def test_other_files_are_refused(tmp_path, change):
    with open(PATH, encoding="utf-8") as file:
        found = json.load(file)
    if "merges" in change:
        found["model"]["merges"] = change["merges"]
    else:
        found |= change
    (tmp_path / "v.json").write_text(json.dumps(found))
    with pytest.raises(ValueError):
        bpe_automaton.compiled(str(tmp_path / "v.json"))


# --- hard negatives -----------------------------------------------------------------------------


def plain_negatives(rows):
    kept = []
    for i, (key, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if key is not None and key % 7 == 0 else label
        kept.append((i, key, [math.floor(256 * x) for x in v], label))
    out = []
    rank = lambda s, r: (-s, r[1] is None, r[1] or 0, r[0])
    for a in kept:
        if a[1] is None or a[1] % 50:
            continue
        score = {b[0]: sum(x * y for x, y in zip(a[2], b[2])) for b in kept}
        near = sorted((b for b in kept if b[3] == a[3] and b[0] != a[0]), key=lambda b: rank(score[b[0]], b))[:5]
        for p in near:
            s = score[p[0]]
            fit = sorted((b for b in kept if b[3] != a[3] and 50 * s <= 100 * score[b[0]] <= 95 * s), key=lambda b: rank(score[b[0]], b))[:3]
            out += [(a[1], p[1], k + 1, b[1], s, score[b[0]]) for k, b in enumerate(fit)]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def mined(spark, rows):
    vectors = spark.createDataFrame([(k, v, label, "clash", "clash") for k, v, label in rows], "vec_id long, embedding array<double>, label int, rid string, norm string")
    key, label = F.col("id"), F.col("label")
    got = hard_negatives.hard_negatives(vectors, anchor=key % 50 == 0, relabel=F.when(key % 7 == 0, (label + 1) % 10).otherwise(label))
    return order(tuple(r) for r in got.collect())


def vectors_for(seed, n, scale=1.0, copies=True):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, 12)) * rng.uniform(0.05, 1, (n, 1)) * scale
    rows = [(i, v[i].tolist(), int(rng.integers(0, 4))) for i in range(n)]
    if copies:
        rows += [(1000 + i, v[i % 3].tolist(), i % 4) for i in range(60)]
        rows += [(50, v[50].tolist(), rows[50][2]), (50, v[51].tolist(), 1), (None, v[9].tolist(), 2), (None, v[9].tolist(), 1), (-100, v[4].tolist(), 3)]
        rows += [(2000, None, 1), (2050, v[0].tolist(), None), (2100, [float("nan")] * 12, 1), (2150, [float("inf")] * 12, 1), (2200, [None] + [0.1] * 11, 1), (2250, [], 1), (2300, [0.5, -0.5], 2)]
    return rows


def test_negatives_equal_all_pairs(spark):
    rows = vectors_for(1, 900)
    assert mined(spark, rows) == order(plain_negatives(rows))


def test_negatives_of_large_numbers(spark):
    """Scores beyond what doubles hold exactly."""
    rows = vectors_for(2, 160, scale=3e5, copies=False)
    want = order(plain_negatives(rows))
    assert max(abs(r[4]) for r in want) > 1 << 53 and mined(spark, rows) == want


def test_negatives_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    rows = vectors_for(3, 700)
    assert mined(spark, rows) == order(plain_negatives(rows))


def test_negatives_of_few_rows(spark):
    assert mined(spark, [(50, [1.0, 0.0], 1)]) == []
    assert mined(spark, [(50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.7, 0.0], 2)]) == [(50, 51, 1, 52, 65536, 256 * 179)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(empty, anchor=F.col("id") % 50 == 0).count() == 0


def test_coordinate_ranges_keep_what_is_near():
    """Pruned search over buckets finds what a full product finds."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16)) * 200
    q = (centres[rng.integers(0, 40, 3000)] + rng.standard_normal((3000, 16)) * 10).astype(np.int64)
    q = q[np.argsort(-np.linalg.norm(q, axis=1))]
    import pyarrow as pa

    ids, labels = np.arange(3000), rng.integers(0, 3, 3000)
    block = pa.table({"rid": ids[:60], "label": labels[:60], "q": pa.array(list(q[:60]))})
    search = hard_negatives.Search(hard_negatives.Anchors(block, 16, False, [(i, 0, -(1 << 63), (1 << 63) - 1) for i in range(60)]), 5, True)
    taken = []
    search._take = lambda which, rows, *names, take=search._take: (taken.append(len(which) * len(rows)), take(which, rows, *names))
    for at in range(0, 3000, 500):
        part = slice(at, at + 500)
        search.bucket(q[part], np.zeros(500, bool), ids[part], labels[part], ids[part])
    slot, score, _, found, _ = search.found
    for a in range(60):
        s = q @ q[a]
        want = sorted((i for i in range(3000) if labels[i] == labels[a] and i != a), key=lambda i: (-s[i], i))[:5]
        assert found[slot == a].tolist() == want and score[slot == a].tolist() == s[want].tolist()
    assert sum(taken) < 0.5 * 60 * 3000  # most rows were never scored


def test_registered_queries_over_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(queries.op11_bit_sliced_spelling(spark, sf)) == plain_variants(plain_vocabulary(docs))
    library = Tokenizer.from_file(PATH)
    import hashlib

    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in docs}
    for r in queries.op12_bpe_automaton(spark, sf).collect():
        ids = want[r.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
