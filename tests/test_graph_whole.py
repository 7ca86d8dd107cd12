"""Louvain, lightest paths and betweenness against plain versions."""

import heapq
import random
from collections import defaultdict

import pytest

from casewright import catalog
from casewright.operators import analytics, brokers, communities, edges, paths

EDGE = "source_entity string, target_entity string, weight double"


def modularity(rows, of, resolution=1.0):
    m, inside, degree = sum(w for *_, w in rows), defaultdict(float), defaultdict(float)
    for a, b, w in rows:
        degree[of[a]] += w
        degree[of[b]] += w
        inside[of[a]] += w * (of[a] == of[b])
    return sum(inside[c] / m - resolution * (degree[c] / (2 * m)) ** 2 for c in degree)


def planted(rnd, groups, size, p_in, p_out):
    name = lambda g, i: f"g{g}n{i:02d}"
    nodes = [(g, i) for g in range(groups) for i in range(size)]
    return [(name(*x), name(*y), round(rnd.uniform(0.5, 2), 3)) for k, x in enumerate(nodes) for y in nodes[:k] if rnd.random() < (p_in if x[0] == y[0] else p_out)]


def test_louvain_finds_planted_groups(spark):
    rnd = random.Random(11)
    rows = planted(rnd, 6, 14, 0.6, 0.02) + [("loop", "loop", 1.0), ("far1", "far2", 1.0)]
    e = spark.createDataFrame(rows, EDGE)
    got = communities.louvain(e)
    of = {r.node: r.community for r in got.collect()}
    assert len(of) == got.count() == len({n for r in rows for n in r[:2]})
    assert all(min(n for n in of if of[n] == c) == c for c in of.values())
    truth = {n: n[:2] if n[0] == "g" else n[:3] for n in of}
    assert modularity(rows, of) >= modularity(rows, truth) - 1e-6
    assert abs(analytics.modularity(e, got).first().modularity - modularity(rows, of)) < 6e-5
    labels = {"loop": "loop"} | {r.node: r.community for r in analytics.label_propagation(e, 6).collect()}
    assert modularity(rows, of) >= modularity(rows, labels)
    # no node has a better place left
    for n in of:
        for c in set(of.values()):
            assert modularity(rows, {**of, n: c}) <= modularity(rows, of) + 1e-6
    assert of["far1"] == of["far2"] and of["loop"] == "loop"


def test_resolution_and_small_graphs(spark):
    ring = [(f"c{k}n{i}", f"c{k}n{j}", 1.0) for k in range(8) for i in range(4) for j in range(i)] + [(f"c{k}n0", f"c{(k + 1) % 8}n1", 1.0) for k in range(8)]
    e = spark.createDataFrame(ring, EDGE)
    n = lambda r: len({x.community for x in communities.louvain(e, resolution=r).collect()})
    assert n(1.0) == 8 and n(0.0) < 8 <= n(99.0)
    assert communities.louvain(e.where("false")).count() == 0
    pair = spark.createDataFrame([("a", "b", 1.0)], EDGE)
    assert {tuple(r) for r in communities.louvain(pair).collect()} == {("a", "a"), ("b", "a")}


def test_report_orders_and_limits(spark):
    of = [(f"a{i:02d}", "x") for i in range(30)] + [(f"b{i}", "y") for i in range(3)] + [("c", "z"), ("d1", "w"), ("d2", "w")]
    df = spark.createDataFrame(of, "node string, community string")
    ents = spark.createDataFrame([("a05", 9), ("a07", 9), ("b2", 1)], "entity_id string, mention_count long")
    rows = communities.report(df, ents).orderBy("community_id", "place").collect()
    assert [(r.community_id, r.size) for r in rows if r.place == 1] == [(0, 30), (1, 3), (2, 2)]
    assert [r.node for r in rows if r.community_id == 0][:3] == ["a05", "a07", "a00"] and sum(r.community_id == 0 for r in rows) == 25
    assert [r.node for r in rows if r.community_id == 1] == ["b2", "b0", "b1"]
    assert {r.community_id for r in communities.report(df, ents, most=1).collect()} == {0}


def test_louvain_of_the_whole_graph(spark, sf):
    got = {r.method: r.modularity for r in catalog.louvain_modularity(spark, sf).collect()}
    assert got["louvain"] >= got["labels"] and got["louvain"] > 0


def near_of(rows):
    near = defaultdict(dict)
    for a, b, w in rows:
        if a != b:
            w = max(1, round(w * 10**6))
            near[a][b] = near[b][a] = min(w, near[a].get(b, w))
    return near


def simple(near, s, t):
    out, stack = [], [(0, [s])]
    while stack:
        g, path = stack.pop()
        if path[-1] == t:
            out.append((g, path))
            continue
        stack += [(g + w, [*path, x]) for x, w in near[path[-1]].items() if x not in path]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_lightest_paths_equal_all_paths(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"n{rnd.randint(0, 8)}", f"n{rnd.randint(0, 8)}", rnd.choice([0.5, 1.0, 1.5, 2.25])) for _ in range(22)] + [("n0", "m", 0.1), ("lone", "ly", 1.0)]
    e = spark.createDataFrame(rows, EDGE)
    want = simple(near_of(rows), "n0", "n8")
    for k, batch in ((1, 1000), (7, 40)):
        got = [(r.path_rank, r.path) for r in paths.k_shortest(e, "n0", "n8", k=k, batch=batch).collect()]
        assert got == [(i, p) for i, (_, p) in enumerate(want[:k], 1)]
    for cutoff in (1 + 2 * seed,):
        keep = []
        for _, p in want[:12]:
            if len(p) - 1 > cutoff:
                break
            keep.append(p)
        assert [r.path for r in paths.k_shortest(e, "n0", "n8", k=12, cutoff=cutoff).collect()] == keep
    assert paths.k_shortest(e, "n0", "lone").count() == paths.k_shortest(e, "n0", "n0").count() == paths.k_shortest(e, "n0", "nobody").count() == 0


def test_hops_carry_their_best_edge(spark):
    view = spark.createDataFrame(
        [("r1", "a", "b", "KNOWS", 0.9, 2, 1.0), ("r2", "b", "a", "OWNS", 0.8, 1, 0.5), ("r3", "c", "b", "SAW", 0.7, 0, 2.0), ("r4", "b", "c", "MET", 0.6, 3, 2.0), ("r0", "c", "b", "MET", 0.6, 3, 2.0)],
        "rel_id string, source_entity string, target_entity string, relation_type string, confidence double, evidence_count long, weight double",
    )
    found = paths.k_shortest(view, "a", "c")
    cites = spark.createDataFrame([("e1", "r2", "d1", 4, "x"), ("e2", "r2", "d2", 2, "y"), ("e3", "r9", "d", 1, "z")], "evidence_id string, rel_id string, doc_id string, page int, span_text string")
    rows = paths.cited(paths.hydrate(found, view), cites).orderBy("hop").collect()
    assert [(r.hop, r.node, r.next_node, r.rel_id, r.direction) for r in rows] == [(1, "a", "b", "r2", "reverse"), (2, "b", "c", "r4", "forward")]
    assert {(r.total_weight, r.min_confidence, r.hops) for r in rows} == {(2.5, 0.6, 2)}
    assert [[c.evidence_id for c in r.citations] for r in rows] == [["e2", "e1"], []]


def dependencies(near, source):
    """Brandes for one source."""
    best, ways, through, done, heap = {source: 0}, defaultdict(float, {source: 1.0}), defaultdict(list), [], [(0, source)]
    while heap:
        d, x = heapq.heappop(heap)
        if x in done or d > best[x]:
            continue
        done.append(x)
        for y, w in near[x].items():
            if y not in best or d + w < best[y]:
                best[y], ways[y], through[y] = d + w, ways[x], [x]
                heapq.heappush(heap, (d + w, y))
            elif d + w == best[y] and x not in through[y]:
                ways[y] += ways[x]
                through[y].append(x)
    rest = defaultdict(float)
    for y in reversed(done):
        for x in through[y]:
            rest[x] += ways[x] / ways[y] * (1 + rest[y])
    rest.pop(source, None)
    return rest


def betweenness(rows, chosen=None):
    near = near_of(rows)
    n, chosen = len(near), chosen or list(near)
    score = defaultdict(float)
    for s in chosen:
        for x, v in dependencies(near, s).items():
            score[x] += v
    return {x: score[x] * n / len(chosen) / max(1, (n - 1) * (n - 2)) for x in near}


def test_betweenness_equals_brandes(spark):
    rnd = random.Random(2)
    rows = [(f"n{rnd.randint(0, 25)}", f"n{rnd.randint(0, 25)}", rnd.choice([1.0, 1.0, 2.0, 3.0, 0.0])) for _ in range(70)] + [("x", "y", 1.0)]
    e = spark.createDataFrame(rows, EDGE)
    want = betweenness(rows)
    got = {r.node: r.betweenness for r in brokers.betweenness(e).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)
    assert brokers.betweenness(e.where("false")).count() == 0


def test_betweenness_of_the_whole_graph(spark, sf):
    e = catalog._best_edges(spark, sf)
    rows = [tuple(r) for r in e.collect()]
    order = [r.node for r in spark.createDataFrame([(x,) for x in near_of(rows)], "node string").selectExpr("node", "xxhash64(node, 17) h").orderBy("h", "node").collect()]
    want, got = betweenness(rows, order[:16]), {r.node: r.betweenness for r in catalog.betweenness_all(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_lightest_paths_over_the_whole_graph(spark, sf):
    view = edges.edge_view(catalog.graph(spark, sf))
    got = paths.k_shortest(view, "C1", "C2", k=3).collect()
    assert [r.path_rank for r in got] == [1, 2, 3] and all(r.path[0] == "C1" and r.path[-1] == "C2" and len(set(r.path)) == len(r.path) for r in got)
