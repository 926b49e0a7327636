import pathlib
import sys

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2] / "tools"))

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Documents from (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s1", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def edge_docs(spark, make_docs):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with internal ones."""
    long = " ".join(f"word{i % 977} of{i}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "one two three"), (6, "one two three"), (7, long), (8, long + " end"),
        (9, "Plain text, with a few words; mail x.y@mail.example.com now.", None), (9, "Plain text, with a few words; mail x.y@mail.example.com now.", None),
        (9, "another text under the same id, a little longer than most of the others here"), (None, "a text without an id"), (None, None),
        (10, "x" * 50_000), (11, "\n" * 500), (12, "große Häuser, été à Paris, número ñandú"), (13, "\x00\x01 control \x7f bytes"), (14, "😀😀 emoji 😀"),
    ]
    docs = make_docs(rows)
    for name in ("score", "cls", "a", "b", "kept", "row", "pieces", "found", "hits", "n_entities", "taken", "size", "target", "finish", "n_words", "contaminated", "quality_score", "digest", "word", "block", "y", "id"):
        docs = docs.selectExpr("*", f"'clash' AS {name}")
    return docs


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(1, 14)] + [(3, None, None), (None, 1, 1), (4, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (None, "control bytes"), (4, " ".join(f"word{i % 977} of{i}" for i in range(100, 140)))]
    return spark.createDataFrame(rows, "item_id long, text string")
