import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from casewright.llm import compressive, queries, toxicity


def made(seed=1, n=600):
    rnd = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        toxic = rnd.random() < 0.2
        w = ["w%s" % chr(97 + rnd.randrange(26)) + chr(97 + rnd.randrange(26)) for _ in range(rnd.choice([30, 200]))]
        if toxic:
            for _ in range(max(2, len(w) // 40)):
                w[rnd.randrange(len(w))] = rnd.choice(["Nasty", "vileness,", "vilely"])
        rows.append((d, " ".join(w)))
        if rnd.random() < 0.7:
            labels.append((d, int(toxic)))
    return rows, labels


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def test_toxicity_on_held_out_rows(spark):
    rows, labels = made()
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, score int, _id string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model, prior = toxicity.fit(docs, lab)
    got = {r.doc_id: r for r in toxicity.score(docs, model, prior).collect()}
    assert len(got) == len(rows) and all(got[d].held_out == held(d) and 0 <= got[d].score <= 1 and got[d].predicted == (got[d].score >= 0.5) for d, _ in rows)
    y = [(d, t) for d, t in labels if held(d)]
    assert np.mean([got[d].predicted for d, t in y if t]) > 0.9 and np.mean([got[d].predicted for d, t in y if not t]) < 0.05


def test_held_out_labels_are_never_read(spark):
    rows, labels = made(2, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(d, 1 - t if held(d) else t) for d, t in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int"))[0] for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_risk_stays_non_negative():
    """Unlabelled texts that are positives too do not drag their features down."""
    rnd = np.random.default_rng(3)
    texts = lambda n, share: [" ".join(rnd.choice(["vilest"] if rnd.random() < share else ["calm", "plain", "quiet"], 12)) for _ in range(n)]

    def blobs(column):
        out = []
        bucket, first, n = toxicity.features(pa.array(column))
        for k in range(len(column)):
            b, c = np.unique(bucket[first[k] : first[k + 1]], return_counts=True)
            ok = b < 2**toxicity.BITS
            out.append(toxicity.pack(b[ok].astype(np.uint32), c[ok].astype(np.uint32), np.array([n[k]], np.uint32)))
        return out

    model = toxicity.train(blobs(texts(40, 1.0)), blobs(texts(200, 0.3)), 0.3)
    s = model.score(pa.array(["vilest " * 12, "calm plain quiet " * 4]))
    assert s[0] > 0.5 > s[1]


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (compressive, "quality")])
def test_odd_rows(spark, module, label):
    rows, labels = made(4, 200)
    odd = [(9001, None), (9002, ""), (9003, " \n"), (9004, "1 2 3 !!"), (9005, "word " * 60_000), (9005, "word " * 60_000), (None, "some text")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (labels[0][0], None), (9002, 1), (9001, 0)], f"doc_id long, {label} int")
    model, share = module.fit(docs, lab)
    got = module.score(docs, model, share).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    a, b = [r.score for r in got if r.doc_id == 9005]
    assert a == b


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (compressive, "quality")])
def test_nothing_to_learn_from(spark, module, label):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    model, share = module.fit(docs, none)
    assert model is None and [r.score for r in module.score(docs, model, share).collect()] == [0.0, 0.0]
    model, share = module.fit(docs, spark.createDataFrame([(1, 0), (2, 0)], f"doc_id long, {label} int"))
    assert model is None and share == 0.0
    assert module.score(docs.limit(0), None, 0.0).count() == 0


def test_quality_on_held_out_rows(spark):
    rnd = random.Random(5)
    good = lambda: " ".join(rnd.choice(["the", "of", "river", "stone", "walk", "green", "light"]) for _ in range(80))
    bad = lambda: " ".join(rnd.choice(["BUY!!", "$$$", "click|here", "FREE%%%", "now***"]) for _ in range(60))
    rows, labels = [], []
    for d in range(300):
        q = int(rnd.random() < 0.7)
        rows.append((d, good() if q else bad()))
        labels.append((d, q))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, share = compressive.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r for r in compressive.score(docs, model, share).collect()}
    assert all(got[d].predicted == (got[d].score >= 0.3) for d, _ in rows)
    assert np.mean([got[d].predicted == q for d, q in labels if held(d)]) > 0.97


def test_a_text_compresses_better_with_its_own_dictionary():
    good, bad = ["the river runs green and still " * 5] * 20, ["CLICK $$$ NOW *** FREE " * 5] * 20
    model = compressive.train(good, bad, 0.5)
    m = model.measures(["the river runs green and still", "CLICK $$$ NOW *** FREE", "", None])
    assert m[0, 0] > 0 > m[1, 0] and not m[2:].any()


@pytest.mark.parametrize("name", ["op7_toxicity", "op8_quality_classifier"])
def test_whole_tables(spark, sf, name):
    n = queries.table(spark, sf, "documents").count()
    got = queries.QUERIES[name](spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == n
