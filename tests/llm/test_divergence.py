"""Source divergence against a plain version with Python's whole numbers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from casewright.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def brute(rows, least=30, most=50):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall((text or "").translate(LOW))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        of = {s: [count[lang, s][t] for t in kept] for g, s in groups if g == lang}
        share = lambda c: [1 + 10**9 * (n + 5) // (sum(c) + 5 * len(kept)) for n in c]
        p = {s: share(c) for s, c in of.items()}
        q = share([sum(c[k] for c in of.values()) for k in range(len(kept))])
        for s in of:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in of if o != s]
            terms = [(p[s][k] - q[k], t) for k, t in enumerate(kept) if of[s][k] and p[s][k] > q[k]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(order, 1)}
    return out


def made(rnd, n, sources, words):
    pick = lambda: rnd.choice([None, "", "en", "fr"])
    return [(None if rnd.random() < 0.05 else " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))), pick(), rnd.choice([None, "", *sources])) for _ in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"block": 2, "chunk": 3, "span": 2}, {"block": 1, "chunk": 1, "span": 1}])
def test_equals_brute_force(spark, sizes):
    rnd = random.Random(len(sizes))
    words = ["Der", "der", "DÉJÀ", "déjà", "x1y", "a-b", "_", "ß", "日本", "q r", "\u0085"] + [f"w{chr(97 + i)}" for i in range(12)]
    rows = made(rnd, 260, ["s1", "s2", "S2", "é", "z\n"], words) + [("rare words here", "de", "only"), ("", "de", "other"), (None, "de", None)]
    docs = spark.createDataFrame([(t, g, s, 1, "k") for t, g, s in rows], "text string, lang string, source string, n int, term string").withColumnRenamed("n", "value")
    got = divergence.audit(docs, least_docs=12, **sizes)
    assert {tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()} == brute(rows, 12)


def test_a_flush_in_between_changes_nothing(spark, monkeypatch):
    rows = made(random.Random(5), 200, ["a", "b"], [f"t{chr(97 + i)}" for i in range(20)])
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    monkeypatch.setattr(divergence, "FLUSH", 30)
    parts = [b for b in divergence._count(iter(docs.selectExpr("coalesce(text, '') text", "coalesce(lang, '') lang", "coalesce(source, '') source").toArrow().to_batches()))]
    assert len(parts) > 3
    assert sum(sum(b.column(3).to_pylist()) for b in parts) > 0
    assert {tuple(r) for r in divergence.audit(docs, least_docs=8).collect()} == brute(rows, 8)


def test_empty_table_and_one_source(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(docs).count() == 0
    one = spark.createDataFrame([("a b", "en", "s")] * 40, "text string, lang string, source string")
    assert divergence.audit(one).count() == 0


def test_shares_are_exact():
    rnd = random.Random(1)
    for _ in range(300):
        total, v = rnd.choice([0, 7, 10**6, 8 * 10**15]), rnd.choice([1, 2, 50_000])
        n = [rnd.randint(0, total) for _ in range(5)] + [total, 0]
        assert divergence.shares(np.array(n), total, v).tolist() == [1 + 10**9 * (x + 5) // (total + 5 * v) for x in n]
    with pytest.raises(ValueError):
        divergence.shares(np.zeros(1, np.int64), 9 * 10**15, 1)


def test_share_expression_is_exact(spark):
    rows = [(0, 0, 1), (10**12, 10**13, 10**6), (123456789012345, 999999999999999, 77)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select("n", "total", "v", divergence.share("n", "total", "v").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in rows]
