"""Spelling variants against plain versions that compare all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from casewright.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOW = {i: i + 32 for i in range(65, 91)}


def count(rows, length=7, uses=2, every=31):
    n = Counter()
    for d, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= length:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= uses}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, ratio=10):
    out, form = {}, {}
    for w in n:
        found = sorted((x for x in n if x != w and near(w, x)), key=lambda x: (-n[x], x))
        form[w] = found[0] if found and n[found[0]] >= ratio * n[w] else None
        out[w] = len(found)
    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n}


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("plain", [64, 8, 3])
def test_groups_equal_all_pairs(spark, monkeypatch, plain):
    """The digests of long words and the strings of short ones agree, also where both kinds meet."""
    monkeypatch.setattr(variants, "PLAIN", plain)
    rnd = random.Random(plain)
    n = {}
    for _ in range(400):
        w = "".join(rnd.choice("abÉé") for _ in range(rnd.randint(1, 11)))
        n[w] = rnd.choice([1, 1, 2, 11, 20, 300, 5000])
    n |= {"a": 2, "aaaa": 40, "aaa": 3, "aaaaa": 500, "x:1": 4, "x:2": 4, "1:x": 70}
    # the setting has to reach Python workers, which import the module anew
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    if plain != 64:
        monkeypatch.setattr(variants, "_long_keys", _with_plain(plain))
    assert rows(variants.group_variants(df)) == brute(n)


def _with_plain(plain):
    def run(batches):
        variants.PLAIN = plain
        yield from keep(batches)

    keep = variants._long_keys
    return run


def test_texts_to_words(spark):
    rnd = random.Random(4)
    words = ["STRASSEN", "straßenÀ", "Àstraßen", "abcdefg", "abcdefgh", "shorty", "x" * 200, "x" * 199 + "y", "x" * 201, "DÉJÀVUS", "déjàvus", "b×c÷defg"]
    texts = [(None, "abcdefg abcdefg"), (1, None), (2, ""), (2, "abcdefg,abcdefg\nabcdefg"), (3, "1234567 _______ 日本語日本語日本語")]
    texts += [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for k in range(90)] * 2
    docs = spark.createDataFrame([(d, t, 1, "k", 2) for d, t in texts], "doc_id long, text string, n int, word string, rank int")
    want = count(texts)
    got = variants.vocabulary(docs)
    assert {(r.word, r.n) for r in got.collect()} == set(want.items())
    assert rows(variants.variants(docs)) == brute(want)
    assert any(len(w) > 64 for w in want)


def test_a_very_long_word_and_an_empty_table(spark):
    n = {"q" * 30_000: 5, "q" * 30_001: 60, "q" * 29_999 + "z": 700}
    got = rows(variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute_long(n)
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_long(n):
    a, b, c = "q" * 30_000, "q" * 30_001, "q" * 29_999 + "z"
    assert set(n) == {a, b, c}
    # a is near b (one q more) and c (the last letter); b and c are not near
    return {(a, c, c, 5, 2, 700), (b, None, b, 60, 1, None), (c, None, c, 700, 1, None)}


def test_chains_of_forms_lead_to_the_root(spark):
    n = {"abcdefg" + "h" * k: 2 * 10**k for k in range(7)}
    got = rows(variants.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n)
    assert {r[2] for r in got} == {"abcdefghhhhhh"}
