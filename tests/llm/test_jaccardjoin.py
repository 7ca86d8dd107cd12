import random

import numpy as np
import pytest

from casewright.llm import jaccardjoin as J
from casewright.llm import queries
from tests.llm import brute


def corpus(seed, n=400):
    rnd = random.Random(seed)
    base, passage, rows = ["w%d" % rnd.randrange(5000) for _ in range(200)], ["p%d" % i for i in range(40)], []
    word = lambda: "w%d" % rnd.randrange(3000)
    for d in range(n):
        k = rnd.random()
        if k < 0.25 or not rows:
            t = [word() for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 30, 100, 400]))]
        elif k < 0.5:
            t = list(base)
            for _ in range(rnd.randint(0, 7)):
                t[rnd.randrange(len(t))] = word()
        elif k < 0.6:
            t = [word() for _ in range(rnd.choice([5, 30, 60]))] + passage + [word() for _ in range(rnd.choice([5, 30]))]
        else:
            t = list((rnd.choice(rows)[1] or "z").split())
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, max(1, len(t) // 40)])):
                i = rnd.randrange(len(t) + 1)
                t[i : i + rnd.randint(0, 2)] = [word()] * rnd.randint(0, 1)
        rows.append((d * 7 % 1009, " ".join(t)))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (5003, "A b"), (5004, "a B"), (5005, "a b c"), (5006, "q" * 50_000), (5007, " ".join(f"v{i % 9000}" for i in range(12_000)))]


def run(spark, rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute.components(rows)


def test_tiles_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_TOKENS", 3000)
    monkeypatch.setattr(J, "SMALL", 3)
    rows = corpus(4, 250)
    assert run(spark, rows) == brute.components(rows)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_jaccard_join(spark, sf).collect()} == brute.components(rows)


def test_a_chain_of_links(spark):
    words, rows = [f"c{i}" for i in range(200)], []
    for d in range(30):
        rows.append((d, " ".join(words[d * 4 : d * 4 + 80])))
    assert run(spark, rows) == brute.components(rows)


def test_pigeonhole_finds_every_similar_pair():
    """Two similar sets always share a signature in a band that both enter."""
    rnd, sim = np.random.default_rng(7), J.Similarity()
    for _ in range(1500):
        n = int(rnd.integers(1, 60))
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        b = a[rnd.random(len(a)) > rnd.random() * 0.25]
        b = np.unique(np.append(b, rnd.integers(0, 2**63, int(rnd.integers(0, 1 + n // 6))).astype(np.uint64)))
        k = len(np.intersect1d(a, b))
        if not len(b) or not sim.linked(k, len(a), len(b)):
            continue
        met = False
        for band in set(J._bands(len(a), sim)) & set(J._bands(len(b), sim)):
            x, y = J._signatures(a, band, sim), J._signatures(b, band, sim)
            met |= bool(set(np.append(x[0], x[1]).tolist()) & set(np.append(y[0], y[1]).tolist()))
        assert met


def test_one_of_each(spark):
    t = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(4, t, "a"), (2, t + " x", "b"), (9, "other words here now yes", "c"), (None, t, "d"), (11, None, "e")], "doc_id long, text string, component_id string")
    assert sorted((r.doc_id or 0, r.component_id) for r in J.one_of_each(docs).collect()) == [(0, "d"), (2, "b"), (9, "c"), (11, "e")]


def test_repeated_rows_and_empty_table(spark):
    assert run(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (0, "a b c d e f")]) == {1: (2, 0), 0: (2, 0)}
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def by_row(rows):
    """(doc_id, set size, smallest id that is not null of the component) for each row; ids may repeat."""
    got = brute.components(list(enumerate(t for _, t in rows)))
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[got[k][1]] = min(d, least.get(got[k][1], d))
    return sorted(((d, got[k][0], least.get(got[k][1])) for k, (d, _) in enumerate(rows)), key=str)


def test_repeated_and_null_ids_with_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    for rows in ([(1, a), (1, b), (2, a + " x"), (4, b + " y")], [(1, b), (1, a), (4, b + " y"), (2, a + " x")], [(None, a), (None, a + " x"), (None, b), (3, b + " y"), (None, c), (None, None), (5, a + " x z"), (2, c), (2, None), (2, "")]):
        got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == by_row(rows)


def test_random_repeated_ids(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice([None, d % 40, d % 97]), t) for d, t in corpus(9, 200)]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == by_row(rows)


def test_components_raise_where_rounds_do_not_end(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(64)], "a long, b long")
    assert {r.component for r in J.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        J.components(chain, most_rounds=2)


def test_clusters_with_common_classes_become_one_group_where_that_is_cheaper(spark):
    near = [(c, k, 10) for c in (1001, 1002, 1003) for k in range(6)]
    chain = [(2000 + c, 100 + c + k, 10) for c in range(12) for k in range(2)]
    got = J.groups(spark.createDataFrame(near + chain + [(3000, 500, 10)], "cluster long, set_key long, size int"))
    sizes = {}
    for r in got.collect():
        sizes.setdefault(r.cluster, []).append(r.set_key)
    assert sorted(map(len, sizes.values())) == [2] * 12 + [6]


def test_one_of_each_with_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "a", 0), (2, text, "b", 0), (3, "else", "c", 0)], "doc_id long, text string, _gone string, _GONE_ int")
    got = J.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
