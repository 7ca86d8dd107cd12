import hashlib
import random

import pytest

pytest.importorskip("sentencepiece")
from casewright.llm import pieces, queries

TEXTS = ["", " ", "  a  b ", "Hello world\n\tx", "ﬁ ½", "\x00a", "a▁b ▁ c", "<s> </s> <unk>", "😀 日本語", "\n", " \n \n", "▁", "x" * 30_000, "word " * 20_000, "​ é\r\n", "مرحبا", "a\x85b c"]


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(queries.piece_model())


def test_agenda_equals_the_library(model):
    rnd = random.Random(5)
    texts = TEXTS + ["".join(rnd.choice("ab c\n▁\t😀éxyz1 .") for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    for t in texts:
        want = model.library.encode(t, add_eos=True)
        assert model.encode(t) == want
        assert model.encoded(t)[1] == model.library.decode(want) == model.decode(want)


def test_decode_of_any_ids(model):
    rnd = random.Random(6)
    for _ in range(2000):
        ids = [rnd.choice([rnd.randrange(300), rnd.randrange(32000), 131 + rnd.randrange(128), 259]) for _ in range(rnd.randint(0, 9))]
        assert model.decode(ids) == model.library.decode(ids)


def test_forgetting_changes_nothing():
    small = pieces.PieceModel(queries.piece_model(), remember=3)
    for t in ("some words and more words", "again some words"):
        assert small.encode(t) == small.library.encode(t, add_eos=True)


def test_query_rows(spark, model):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(100, None, None, None), (3, TEXTS[3], "again", 2)]
    got = pieces.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids_sha256 int"), queries.piece_model(), check_every=1).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, t in [*enumerate(TEXTS), (100, "")]:
        ids = model.library.encode(t, add_eos=True)
        assert by[k].n_tokens == len(ids)
        assert by[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert by[k].decoded_sha256 == hashlib.sha256(model.library.decode(ids).encode()).hexdigest()


def test_empty_table(spark):
    assert pieces.encode_documents(spark.createDataFrame([], "doc_id long, text string"), queries.piece_model()).count() == 0
    assert pieces.token_ids(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), queries.piece_model()).first().token_ids[-1] == 2


def test_whole_table(spark, sf, model):
    docs = queries.table(spark, sf, "documents").collect()
    got = {r.doc_id: r for r in queries.op3_sentencepiece(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs[::7]:
        assert got[d.doc_id].n_tokens == len(model.library.encode(d.text or "", add_eos=True))
