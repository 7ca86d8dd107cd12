import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casewright.functions import dates, normalise, text
from casewright.functions.normalise import jaro_winkler

GOLDEN = [
    ("rx71kld", "VEHICLE", "RX71 KLD"), ("abc123d", "VEHICLE", "ABC 123D"), ("9 A", "VEHICLE", "9 A"), ("xx-1234-yy-99", "VEHICLE", "XX1234YY99"), ("a123bcd", "VEHICLE", "A123 BCD"),
    ("07712 345 678", "PHONE", "+447712345678"), ("0044 7712 345678", "PHONE", "+447712345678"), ("+1 (555) 010-9999", "PHONE", "+15550109999"), ("n/a", "PHONE", "n/a"),
    ("op nightfall", "CASE_REF", "OP_NIGHTFALL"), ("dc webb, marcus", "PERSON", "Marcus Webb"), ("Mr. john  SMITH", "PERSON", ". John Smith"), ("mr john  SMITH", "PERSON", "John Smith"), ("O'neil mary-jane", "PERSON", "O'neil Mary-jane"),
    ("Acme Trading LTD.", "ORGANISATION", "Acme Trading"), ("12 High St", "LOCATION", "12 High Street"), ("5 mill rd", "LOCATION", "5 Mill Rd"), (" A@B.Example ", "EMAIL", "a@b.example"),
    ("gb 12 abcd", "BANK_ACCOUNT", "GB12ABCD"), ("  x ", "UNKNOWN_TYPE", "x"), ("   ", "PERSON", ""), (None, "PHONE", ""),
]


def test_normal_forms(spark):
    df = spark.createDataFrame([(k, s, t) for k, (s, t, _) in enumerate(GOLDEN)], "k int, s string, t string")
    got = {r.k: r.n for r in df.select("k", normalise.normalise(F.col("s"), F.col("t")).alias("n")).collect()}
    assert [got[k] for k in range(len(GOLDEN))] == [w for _, _, w in GOLDEN]


def test_jaro_winkler_against_duckdb():
    import duckdb

    rnd, con = random.Random(1), duckdb.connect()
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 12))) for _ in range(2))
        assert abs(jaro_winkler(a, b) - con.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]) < 1e-12


def windows(words, target, overlap):
    stride, out, start = max(1, target - overlap), [], 0
    while words:
        out.append(words[start : start + target])
        if start + target >= len(words):
            return out
        start += stride
    return out


@pytest.mark.parametrize("target, overlap", [(5, 1), (5, 0), (3, 3), (350, 70)])
def test_chunks(spark, target, overlap):
    pages = [("a", 1, " ".join(f"w{i}" for i in range(23))), ("a", 2, ""), ("a", 3, "x y"), ("b", 1, None), ("c", 1, " \n"), ("d", 1, "one")]
    got = text.chunk_windows(spark.createDataFrame(pages, "doc_id string, page int, text string"), target, overlap).orderBy("doc_id", "chunk_index").collect()
    want = []
    for d in "abcd":
        parts = [(p, w) for doc, p, t in pages if doc == d for w in windows((t or "").split(), target, overlap)]
        want += [(d, p, k, " ".join(w), len(w)) for k, (p, w) in enumerate(parts)]
    assert [tuple(r) for r in got] == want


def test_chunks_need_a_target(spark):
    with pytest.raises(ValueError):
        text.chunk_windows(spark.createDataFrame([], "doc_id string, page int, text string"), 0)


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string").orderBy("k").select(column).collect()]


def test_small_text_functions(spark):
    t = F.col("t")
    assert one(spark, text.clean(t), "a\x00b\tc\x7f\n") == ["ab\tc\n"]
    assert one(spark, text.count_tokens(t), "", None, "  ", "a b  c") == [0, 0, 1, 3]
    assert one(spark, text.redactions(t), "x [REDACTED] y ████ ______ -----", None, "redactedly") == [3, 0, 0]
    assert [sorted(x) for x in one(spark, text.word_set(t), "About the big Big cat, known cats")] == [["big", "cat", "cats", "the"]]
    assert one(spark, text.sentences(t), "One. Two! Three; four") == [["One.", "Two!", "Three", "four"]]
    assert [len(x) for x in one(spark, text.excerpt(t), "x" * 220, "y" * 221)] == [220, 220]
    assert one(spark, text.html_text(t), "<p>a&amp;b<script>x()</script> <b>c</b><!-- no -->&lt;") == ["a&b c <"]
    assert one(spark, text.is_boilerplate(t, ["page intentionally"]), "a | b | c", "SHOUTING HEADLINE", "Plain words here", "Page intentionally blank") == [True, True, False, True]
    assert one(spark, text.safe_name(t), "a b/c.pdf") == ["a_b_c.pdf"] and one(spark, text.file_stem(t), "x.tar.gz") == ["x.tar"]


DATES = [
    ("seen 12 March 2026 at 09:30 there", dt.datetime(2026, 3, 12, 9, 30)), ("on 12/03/2025 14:30 by", dt.datetime(2025, 3, 12, 14, 30)), ("January 5, 2025 at 08:15", dt.datetime(2025, 1, 5, 8, 15)),
    ("2026-04-01T09:00 log", dt.datetime(2026, 4, 1, 9, 0)), ("2024/2/03", None), ("2024/02/03 x", dt.datetime(2024, 2, 3)), ("Mon, 3 Feb 2020", dt.datetime(2020, 2, 3)), ("the 3rd June 2021", dt.datetime(2021, 6, 3)), ("nothing", None), (None, None),
]


def test_dates(spark):
    assert one(spark, dates.parse(dates.first_date(F.col("t"))), *[t for t, _ in DATES]) == [w for _, w in DATES]


def test_mail_dates(spark):
    assert one(spark, dates.mail_timestamp(F.col("t")), "Tue, 3 Mar 2020 10:11:12 +0000", "2020-03-04 05:06:07", "bad", None) == [dt.datetime(2020, 3, 3, 10, 11, 12), dt.datetime(2020, 3, 4, 5, 6, 7), None, None]
