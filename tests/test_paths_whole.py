"""The paths query against all simple paths where two suppliers have fewer than five paths of two edges, or none."""

from datetime import datetime

import duckdb
import pytest

from casewright import catalog
from casewright.operators import edges, paths
from casewright.projection import trade_graph

#: (customer, supplier, quantity); customer 1 lives in nation 5, the others in nation 1
CASES = {
    "none of two edges": ([(2, 1, 69), (3, 1, 10)], {1: 1, 2: 2}, {2: 2, 3: 4}),
    "one of two edges, lighter ones of three": ([(1, 1, 2), (1, 2, 2), (2, 1, 69), (3, 1, 60)], {1: 1, 2: 2}, {2: 2, 3: 2}),
    "one of two edges, heavier ones of three": ([(1, 1, 69), (1, 2, 69), (2, 1, 1), (3, 1, 2)], {1: 1, 2: 2}, {2: 2, 3: 2}),
    "no way": ([(2, 1, 69)], {1: 1, 2: 2}, {2: 3}),
}


def lightest(view, k, cutoff):
    near = {}
    for r in view:
        w = round(r.weight * 10**6)
        for a, b in ((r.source_entity, r.target_entity), (r.target_entity, r.source_entity)):
            near.setdefault(a, {})[b] = min(w, near.get(a, {}).get(b, w))
    found, going = [], [(0, ["S1"])]
    while going:
        w, path = going.pop()
        if path[-1] == "S2":
            found.append((w, path))
            continue
        going += [(w + x, [*path, n]) for n, x in near.get(path[-1], {}).items() if n not in path]
    out = []
    for _, path in sorted(found)[:k]:
        if len(path) - 1 > cutoff:
            break
        out.append(path)
    return out


@pytest.mark.parametrize("name", CASES)
def test_all_simple_paths_count(spark, tmp_path, name):
    bought, sellers, buyers = CASES[name]
    day = datetime(2024, 1, 1)
    rows = {
        "customer": ([(c, f"c{c}", buyers.get(c, 5)) for c in range(1, 4)], "c_custkey long, c_name string, c_nationkey int"),
        "supplier": ([(s, f"s{s}", n) for s, n in sellers.items()], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(n, f"n{n}") for n in range(6)], "n_nationkey int, n_name string"),
        "orders": ([(i, c, "1-URGENT", day) for i, (c, _, _) in enumerate(bought)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp"),
        "lineitem": ([(i, 1, 1, s, float(q), day, "N", "O") for i, (_, s, q) in enumerate(bought)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_shipdate timestamp, l_returnflag string, l_linestatus string"),
    }
    con = duckdb.connect()
    for table, (held, schema) in rows.items():
        spark.createDataFrame(held, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = catalog.k_shortest_paths(spark, str(tmp_path))
    held = got.orderBy("path_rank", "hop").collect()
    want = lightest(edges.edge_view(trade_graph(spark, str(tmp_path))).collect(), 5, 3)
    assert [["S1"] + [r.next_node for r in held if r.path_rank == k + 1] for k in range(len(want))] == want and len({r.path_rank for r in held}) == len(want)
    assert bool(want) == (name != "no way")
    assert [tuple(r) for r in held] == con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE['k_shortest_paths']}) ORDER BY path_rank, hop").fetchall()


def test_a_bound_is_given_only_where_it_holds(spark):
    adj = spark.createDataFrame([r for a, b, w in (("s", "m", 1), ("m", "t", 1), ("s", "n", 2), ("n", "o", 2), ("o", "t", 2)) for r in ((a, b, w), (b, a, w))], "node string, neighbour string, w long")
    of = lambda k, cutoff: paths.short_path_bound(adj, "s", "t", k, cutoff)
    assert [of(1, None), of(2, None), of(3, None), of(3, 3), of(3, 2), of(1, 1), of(1, 0), of(3, 4)] == [2, 6, None, 6, 2, -1, -1, None]
