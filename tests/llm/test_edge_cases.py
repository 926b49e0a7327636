"""Every operator over null, empty, very long, tied and repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from augurlog.llm import bit_mixing, chunk_dedup, decontaminate, mixing, near_dedup, pii, quality_crf, simhash, toxicity, url_filter
from augurlog.llm.queries import URL_RULES

OPERATORS = {
    "op1": lambda d, labels, bench: pii.pseudonymised(d, "k", count="n_found"),
    "op2": lambda d, labels, bench: toxicity.judged(d, labels),
    "op3": lambda d, labels, bench: simhash.with_neighbours(simhash.with_next(d)),
    "op4": lambda d, labels, bench: near_dedup.near_duplicates(d, 85),
    "op6": lambda d, labels, bench: mixing.mix(d, ["doc_id"]),
    "op7": lambda d, labels, bench: bit_mixing.scored(d),
    "op8": lambda d, labels, bench: decontaminate.decontaminate(d, bench, ["doc_id"]),
    "op9": lambda d, labels, bench: quality_crf.judged(d, labels),
    "op10": lambda d, labels, bench: chunk_dedup.deduplicated(d, ["doc_id"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(edge_docs, labels, benchmark, name):
    got = OPERATORS[name](edge_docs, labels, benchmark).toPandas()
    want = edge_docs.select("doc_id").toPandas()
    assert sorted(got.doc_id.fillna(-1)) == sorted(want.doc_id.fillna(-1))
    if "score" in got and name != "op1":
        assert got.score.notna().all()
        assert name == "op7" or got.score.between(0, 1).all()
    if name == "op4":
        alone = got[got.doc_id.isin([1, 2, 3, 11])]
        assert (alone.n_shingles == 0).all() and alone.kept.all() and (alone.component_id == alone.doc_id).all()
        assert got[got.doc_id.isin([5, 6])].component_id.tolist() == [5, 5]
        assert got[got.doc_id.isin([7, 8])].component_id.tolist() == [7, 7]
    if name == "op8":
        hit = got.set_index("doc_id").n_hit
        assert hit[5] == 3 and hit[13] == 2 and hit[7] == 40 * 2 and hit[1] == 0
    if name == "op10":
        assert (got[got.doc_id == 8].n_removed > 100_000).all() and (got[got.doc_id != 8].n_removed == 0).all()
        assert got[got.doc_id == 1].text.isna().all()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(edge_docs, labels, benchmark, name):
    assert OPERATORS[name](edge_docs.limit(0), labels, benchmark).count() == 0
    few = edge_docs.where("doc_id = 4")
    assert OPERATORS[name](few, labels.limit(0), benchmark.limit(0)).count() == 1


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stage(spark, edge_docs, labels, benchmark, tmp_path, at):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    edge_docs.write.parquet(f"{tmp_path}/documents.parquet")
    name, stage = corpus_pipeline.STAGES[at]
    got = stage(spark, edge_docs, str(tmp_path))
    if at < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == edge_docs.columns and got.dtypes == edge_docs.dtypes
    rows = got.select("doc_id", "text", "score").collect()
    assert all(r.score == "clash" for r in rows)
    assert name != "pii_surrogates" or len(rows) == edge_docs.count()
    assert name != "minhash_near_dedup" or sum(r.doc_id in (5, 6) for r in rows) == 1
    assert stage(spark, edge_docs.limit(0), str(tmp_path)).count() == 0


def test_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no scheme", "x"), (4, "http://", None), (5, "HTTP://A.Example.NET/en/x?y#z", ""), (6, "x://net/", ""), (6, "x://net/", ""), (None, "x://org?a://b", ""),
            (7, "http://" + "a." * 3000 + "com/de/", ""), (8, "http://sub.example.com/de/1", "<a href='//other.org/x'>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS host", "'clash' AS path", "'clash' AS rules", "'clash' AS hit")
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block"), ("x", None, "block")], "host string, path string, verdict string")
    got = {r.page_id: r for r in url_filter.judged(pages, rules).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("", "", None, "allow")
    assert (got[5].host, got[5].path, got[5].rule, got[5].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[6].rule, got[6].verdict) == ("net/", "block") and got[None].host == "org" and got[None].path == ""
    assert got[8].rule == "example.com/de/" and len(got[7].host) == 6003
    assert url_filter.judged(pages.limit(0), rules).count() == 0 and url_filter.judged(pages, rules.limit(0)).count() == len(rows)
