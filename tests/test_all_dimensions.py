"""The pair queries over all 64 dimensions, against NumPy and their own SQL."""

import duckdb
import numpy as np
import pytest

from blocklens import queries
from blocklens.sources.layers import embedding_layer

SF = "/root/testdata/sf0.001"
NAMES = "pearson spearman adjacency_unsigned adjacency_signed adjacency_signed_hybrid connectivity tom hubs gram pls_first_weights pls_first_scores pls_first_vip".split()


def run(spark, name):
    return queries.QUERIES[f"q_{name}"](spark, SF)


@pytest.fixture(scope="module")
def correlations(spark):
    x = np.zeros((spark.read.parquet(f"{SF}/embeddings.parquet").count(), 64))
    ids: dict = {}
    for r in embedding_layer(spark, SF).collect():
        x[ids.setdefault(r.sample_id, len(ids)), r.f_ord] = r.value
    return np.corrcoef(x.T)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.sql(queries.SQL[f"q_{name}"])
    got = run(spark, name)
    assert got.columns == want.columns and "f_ord < 12" not in queries.SQL[f"q_{name}"]
    keys = [k for k, t in enumerate(want.types) if str(t) != "DOUBLE"]
    by_key = lambda rows: {tuple(r[k] for k in keys): [v for k, v in enumerate(r) if k not in keys] for r in rows}
    a, b = by_key(got.collect()), by_key(want.fetchall())
    assert a.keys() == b.keys() and len(a) >= 64
    assert all(np.allclose(a[k], b[k], rtol=0, atol=2e-6) for k in a)


def test_whole_network(spark, correlations):
    r = {(e.i, e.j): e.r for e in run(spark, "pearson").collect()}
    assert len(r) == 2016 and all(abs(v - correlations[k]) < 1e-6 for k, v in r.items())
    w = correlations**2 - np.eye(64)
    k = w.sum(0)
    assert np.allclose([e.k for e in run(spark, "connectivity").orderBy("i").collect()], k, atol=1e-8)
    tom = (w @ w + w) / (np.minimum.outer(k, k) + 1 - w)
    got = run(spark, "tom").collect()
    assert len(got) == 2016 and all(abs(e.w - tom[e.i, e.j]) < 1e-8 for e in got)
