import random

import pytest

from casewright.llm import packing, queries, repeats, wordhash
from tests.llm import brute


def corpus(seed, n=250):
    rnd, rows = random.Random(seed), []
    for d in range(n):
        t, want = [], rnd.choice([0, 5, 19, 20, 30, 80, 200])
        while len(t) < want:
            if rows and rnd.random() < 0.4 and (src := (rnd.choice(rows)[1] or "").split()):
                a = rnd.randrange(len(src))
                t += src[a : a + rnd.randint(5, 60)]
            elif rnd.random() < 0.1 and t:
                a = rnd.randrange(len(t))
                t += t[a : a + rnd.randint(15, 30)]
            else:
                t += ["w%d" % rnd.randrange(4 if rnd.random() < 0.3 else 3000) for _ in range(rnd.randint(1, 25))]
        rows.append((d * 7 % 311, " ".join(t)))
    return rows + [(1000, None), (1001, "a " * 100), (-5, "\x0ba　b " * 50), (1002, ""), (1003, "ä\n" * 30), (1004, "z " + "q" * 100_000), (1005, " ".join(f"v{i}" for i in range(40_000)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r[0]: tuple(r[1:]) for r in repeats.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeats(rows)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    assert {r[0]: tuple(r[1:]) for r in queries.op5_substring_dedup(spark, sf).collect()} == brute.repeats(rows)


def test_text_that_occurs_once_ends_at_the_index(spark):
    """Only windows around the shared passage are named; a passage in every document costs each send one entry."""
    passage = [f"p{i}" for i in range(30)]
    rows = [(d, " ".join([f"d{d}w{i}" for i in range(500)] + (passage if d < 3 else []) + [f"e{d}w{i}" for i in range(7 * d)])) for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: [s for b in r.hits for s in packing.unpack(b)[0].tolist()] for r in repeats.hits(docs, 10, 4, "doc_id", "text").collect()}
    assert got == {d: [500, 510, 520] for d in range(3)}
    sent = [packing.unpack(r.blob) for r in repeats.named(docs, "doc_id", "text", 20, 4).collect()]
    assert sum(len(g[0]) for g in sent) < 3 * 32 and {d for g in sent for d in g[2].tolist() + g[5].tolist()} == {0, 1, 2}
    docs = docs.repartition(5)
    assert {r.doc_id: r.n_removed for r in repeats.digests(docs).collect()} == {d: 30 if d in (1, 2) else 0 for d in range(20)}


def test_many_small_sends(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEND_AT", 50)
    monkeypatch.setattr(repeats, "SEND_MOST", 50)
    rows = corpus(3, 60)
    got = {r[0]: tuple(r[1:]) for r in repeats.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.repeats(rows)


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    got = repeats.digests(spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 40)]


def test_strip_keeps_columns_and_spacing(spark):
    t = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"begin\n{t} end", "x", 5, b"b"), (2, f"other  start {t}\nlast\tword", "y", 6, b"c"), (3, "plain \n text ", None, None, None), (4, None, "z", 1, b"")], "doc_id long, text string, found string, target int, repeats_found binary")
    out = {r.doc_id: r for r in repeats.strip_repeats(docs).collect()}
    assert out[1].text == docs.first().text
    assert out[2].text == "other  start last\tword" and out[2].found == "y" and out[2]["repeats_found"] == b"c"
    assert out[3].text == "plain \n text " and out[4].text is None


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, more string")
    assert repeats.digests(empty).count() == 0 and repeats.strip_repeats(empty).columns == empty.columns


def test_packing_round_trip():
    import numpy as np

    a, b = np.array([1, 2**40, 3], np.int64), np.zeros(0, np.uint32)
    got = packing.unpack(packing.pack(a, b, np.arange(5, dtype=np.uint8)))
    assert [g.tolist() for g in got] == [a.tolist(), [], [0, 1, 2, 3, 4]]


def test_hashes_do_not_depend_on_place():
    import pyarrow as pa

    a = wordhash.read(pa.array(["Ab cd", None, "xx Ab\tcd"]), lower=True)
    b = wordhash.read(pa.array(["zzz", "ab", "CD"]).slice(1), lower=True)
    assert a.hash[0] == a.hash[3] == b.hash[0] and a.hash[1] == a.hash[4] == b.hash[1] and a.first.tolist() == [0, 2, 2, 5]


def test_repeated_ids_with_different_texts(spark):
    """Documents of one id go in the order of their texts' hashes; each is held against all before it."""
    from pyspark.sql import functions as F

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(4, a), (4, b + " " + a), (4, a), (2, b), (9, c), (9, c + " " + a), (None, a), (None, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted({(r.doc_id, r.k, r.text) for r in docs.withColumn("k", F.xxhash64("text")).collect() if r.doc_id is not None}, key=lambda x: x[:2])
    want = brute.repeats([(n, t) for n, (_, _, t) in enumerate(order)])
    of = {(d, t): want[n] for n, (d, _, t) in enumerate(order)}
    left = sorted((*of[r], r[0]) if r[0] is not None else (*brute.repeats([(0, r[1])])[0], -1) for r in rows)
    got = repeats.digests(docs).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_sha256, -1 if r.doc_id is None else r.doc_id) for r in got) == left
