"""The paths query against its SQL where two suppliers share few customers, and where a total lies on a half."""

from datetime import datetime

import duckdb
import pytest

from casewright import catalog
from casewright.operators import paths

#: (customer, supplier, quantity): confidence is (30 + quantity mod 70) / 100
SHARED = [(1, 1, 40), (1, 2, 50)]
APART = [(2, 1, 69), (3, 2, 69), (2, 3, 69), (3, 3, 69), (4, 1, 60)]


@pytest.mark.parametrize("bought", [SHARED + APART, APART])
def test_equals_its_sql(spark, tmp_path, bought):
    day = datetime(2024, 1, 1)
    rows = {
        "customer": ([(c, f"c{c}", 5) for c in range(1, 12)], "c_custkey long, c_name string, c_nationkey int"),
        "supplier": ([(s, f"s{s}", 5 if s == 2 else s) for s in (1, 2, 3)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(n, f"n{n}") for n in range(6)], "n_nationkey int, n_name string"),
        "orders": ([(i, c, "1-URGENT", day) for i, (c, _, _) in enumerate(bought)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp"),
        "lineitem": ([(i, 1, 1, s, float(q), day, "N", "O") for i, (_, s, q) in enumerate(bought)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_shipdate timestamp, l_returnflag string, l_linestatus string"),
    }
    con = duckdb.connect()
    for name, (held, schema) in rows.items():
        spark.createDataFrame(held, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = catalog.k_shortest_paths(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE['k_shortest_paths']}) ORDER BY path_rank, hop").fetchall()
    assert [tuple(r) for r in got.orderBy("path_rank", "hop").collect()] == want


def test_totals_round_as_in_sql(spark):
    halves = [k / 10**6 for k in range(1_000_050, 1_040_000, 100)]
    want = [r[0] for r in duckdb.connect().execute("SELECT round(x, 4) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [halves]).fetchall()]
    view = spark.createDataFrame([(f"r{i}", f"a{i}", f"b{i}", "KNOWS", 0.5, 1, x) for i, x in enumerate(halves)], "rel_id string, source_entity string, target_entity string, relation_type string, confidence double, evidence_count long, weight double")
    hops = paths.hydrate(spark.createDataFrame([(i, [f"a{i}", f"b{i}"]) for i in range(len(halves))], "path_rank int, path array<string>"), view)
    assert [r.total_weight for r in hops.orderBy("path_rank").collect()] == want
