import hashlib

import pytest

import __spark_entry__
from casewright.llm import queries, rules
from casewright.llm import sql as llm_sql
from tests.llm import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def kept_by_rules(rows):
    out = []
    for d, t in rows:
        n, chars, symbols, dup, repeat = brute.measures(t)
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        upper = sum("A" <= c <= "Z" for c in t or "")
        if not (n < 50 or 100 * repeat > 50 * n or 100 * symbols > 20 * n or chars < 2 * n or chars > 20 * n or 100 * dup > 50 * len(lines) or 100 * upper > 50 * chars):
            out.append((d, t))
    return out


def test_pipeline_equals_brute_force(spark, sf):
    import sentencepiece

    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    rows = kept_by_rules(rows)
    comp = brute.components(rows)
    rows = [(d, t) for d, t in rows if comp[d][1] == d]
    left = brute.repeats(rows)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    stripped, seen = [], set()
    for d, t in sorted(rows):
        w, gone = brute.words(t), set()
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone |= set(range(s, s + 20))
            seen.add(k)
        stripped.append((d, " ".join(x for i, x in enumerate(w) if i not in gone)))
        assert len(gone) == left[d][1]
    leaks = {x[1] for x in brute.contained(stripped, items)}
    assert got.keys() == {d for d, _ in stripped} - leaks
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    same = [d for d, t in rows if d in got and not left[d][1]]
    texts = dict(rows)
    for d in same[:40]:
        assert got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, sp.encode(texts[d], add_eos=True))).encode()).hexdigest()


def test_stages_keep_the_columns(spark, sf):
    docs = queries.table(spark, sf, "documents").limit(30)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_entry_lists_all():
    found = __spark_entry__.queries()
    assert "pipeline" in found and {f"op{n}_" for n in range(1, 14)} <= {k[: k.index("_") + 1] for k in found if k.startswith("op")}


@pytest.mark.parametrize("name", sorted(llm_sql.ORACLE))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(llm_sql.ORACLE[name])
    want = sorted(rel.fetchall(), key=repr)
    df = queries.QUERIES[name](spark, sf)
    assert sorted((tuple(r) for r in df.select(*rel.columns).collect()), key=repr) == want


def test_rules_sample_is_bounded(spark, sf):
    assert sorted(r.name for r in rules.order_rules(queries.table(spark, sf, "documents"), sample_rows=20)) == sorted(r.name for r in rules.BASE + rules.RULES)
