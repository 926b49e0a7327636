"""The distributed decomposition against a dense one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from augurlog.operators import svd


def table(spark, x, hole=()):
    rows = [(i, j, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j] and j not in hole]
    return spark.createDataFrame(rows, "rid long, idx long, w double").repartition(4)


def factor_of(found, n):
    v = np.zeros((n, len(found.values)))
    for r in found.factor.collect():
        v[r.idx] = r.v
    return v


def columns(spark, n):
    return spark.range(n).select(F.col("id").alias("idx"))


def test_equals_dense_svd(spark, monkeypatch):
    monkeypatch.setattr(svd, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 40)) * (rng.random((300, 40)) < 0.3) * np.geomspace(3, 0.02, 40)
    found = svd.truncated_svd(table(spark, x), columns(spark, 40), 300, 6, 60)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    v = factor_of(found, 40)
    assert found.values == pytest.approx(s[:6], rel=1e-9) and max(found.residuals) <= 1e-10
    assert np.abs(np.abs((v * vt[:6].T).sum(0)) - 1).max() < 1e-7
    assert np.abs(v.T @ v - np.eye(6)).max() < 1e-12
    y = {r.rid: r.y for r in svd.product(svd.in_blocks(table(spark, x), 300), found.factor, 6).collect()}
    assert np.abs(np.array([y[i] for i in sorted(y)]) - (x @ v)[sorted(y)]).max() < 1e-10


def test_many_components_and_low_rank(spark):
    """256 components of a matrix of rank 300; a matrix of rank 3 gives 3."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 300)) * np.geomspace(10, 1e-3, 300)
    found = svd.truncated_svd(table(spark, x), columns(spark, 300), 600, 256, 30)
    v = factor_of(found, 300)
    assert len(found.values) == 256 and np.abs(v.T @ v - np.eye(256)).max() < 1e-10
    assert found.values == pytest.approx(np.linalg.svd(x, compute_uv=False)[:256], rel=1e-6)
    low = rng.standard_normal((50, 3)) @ rng.standard_normal((3, 20))
    found = svd.truncated_svd(table(spark, low), columns(spark, 20), 50, 8)
    assert len(found.values) == 3 and found.values == pytest.approx(np.linalg.svd(low, compute_uv=False)[:3])


def test_unused_columns_and_no_entries(spark):
    x = np.diag([5.0, 4, 3, 2, 1])
    found = svd.truncated_svd(table(spark, x, hole=(2,)), columns(spark, 5), 5, 3)
    assert found.values == pytest.approx([5, 4, 2]) and np.abs(factor_of(found, 5)[2]).max() < 1e-9
    assert svd.truncated_svd(table(spark, np.zeros((2, 2))), columns(spark, 2), 2, 1).values == []


def test_blocks_by_entries_dense_and_sparse(spark, monkeypatch):
    """A few full rows make as many blocks as their entries need, each in a task of its own."""
    monkeypatch.setattr(svd, "BLOCK_ENTRIES", 500)
    rng = np.random.default_rng(3)
    for share in (1.0, 0.02):
        x = rng.standard_normal((200, 60)) * (rng.random((200, 60)) < share)
        blocks = svd.in_blocks(table(spark, x), 200)
        entries = int((x != 0).sum())
        assert blocks.select("block").distinct().count() == -(-entries // 500)
        factor = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(np.eye(60))], "idx long, v array<double>")
        used = svd._handed(blocks, factor).select(F.spark_partition_id().alias("p"), "block").distinct().collect()
        assert len({r.p for r in used}) == len(used) == -(-entries // 500)
        got = np.zeros((60, 60))
        for r in svd.gram_product(blocks, factor, 60).collect():
            got[r.idx] = r.v
        assert np.abs(got - x.T @ x).max() < 1e-10
