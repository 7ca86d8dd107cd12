"""Vectors of a ball are met by matrix products, with the distances that plain sums give."""

import numpy as np
import pandas as pd
import pytest

from casewright import catalog
from casewright.operators import retrieve


def test_no_distance_in_interpreted_expressions(spark, sf):
    plan = catalog.vector_topk_l2(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "zip_with" not in plan


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_keeps_ties_and_odd_values(metric):
    rnd = np.random.default_rng(5)
    rows = [*rnd.normal(size=(300, 6)).astype("float32"), *[np.ones(6, "float32")] * 40, np.full(6, np.nan, "float32")]
    vectors = pd.DataFrame({"vec_id": rnd.permutation(len(rows)), "embedding": rows})
    queries = pd.DataFrame({"query_id": [1, 2], "query": [np.ones(6, "float32"), rows[0]]})
    for k in (5, 400):
        got = retrieve._nearest(queries, vectors, k, metric, block=1)
        for n, q in zip(queries["query_id"], queries["query"]):
            q = q.astype("float64")
            e = [r.astype("float64") for r in vectors["embedding"]]
            far = [sum((x - q) ** 2) if metric == "l2" else 1 - sum(x * q) / (sum(x * x) * sum(q * q)) ** 0.5 for x in e]
            order = lambda rows: sorted(rows, key=lambda r: (np.isnan(r[0]), r[0] if r[0] == r[0] else 0, r[1]))[:k]
            want = order([(round(d, 6), i) for d, i in zip(far, vectors["vec_id"])])
            have = order([(round(r.distance, 6), r.vec_id) for r in got[got.query_id == n].itertuples()])
            assert [i for _, i in have] == [i for _, i in want]
