"""Archives and chat formatting."""

import hashlib
import random

import pytest

from casewright.llm import chat, queries, warc
from casewright.llm.shared import work_path
from tests.llm import brute

PAGES = [(1, "http://a/x", "same"), (5, "http://b/\r\nInjected: 1", "same"), (3, None, "same"), (7, "http://c", None), (8, "http://d", ""), (9, "http://é/ü", "ä\r\n\r\nWARC/1.1\r\n" * 500), (10, "http://long", "y" * 300_000), (11, "u", "only"), (11, "u", "only"), (None, "n", "null id")]
PAGE = "page_id long, url string, html string, digest string, file string"


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGE)


def test_round_trip(spark):
    got = warc.round_trip(frame(spark)).collect()
    assert len(got) == len(PAGES)
    lead = {}
    for p, _, h in PAGES:
        if p is not None:
            lead[h or ""] = max(lead.get(h or "", p), p)
    for r in got:
        html = next(h for p, _, h in PAGES if p == r.page_id) or ""
        raw = html.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), brute.sha1_base32(raw))
        first = r.page_id is None or lead[html] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", lead[html]))


def test_repeated_ids_with_different_payloads(spark):
    """Rows of one id are judged by their payload; none is lost and none is doubled."""
    for rows in ([(5, "A"), (5, "B"), (7, "A")], [(5, "A"), (5, "B"), (7, "A"), (9, "B")], [(7, "A"), (7, "A"), (7, "B"), (None, "A"), (None, "B"), (3, "B"), (3, "B")]):
        lead = {}
        for p, h in rows:
            if p is not None:
                lead[h] = max(p, lead.get(h, p))
        want = [(p, brute.sha1_base32(h.encode()), "response", None) if p is None or p == lead[h] else (p, brute.sha1_base32(h.encode()), "revisit", lead[h]) for p, h in rows]
        got = warc.round_trip(spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string")).collect()
        assert sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)


def test_payloads_and_selection(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200)
    folder = work_path(spark, "archives")
    index = warc.write(frame(spark).repartition(2), folder)
    assert index.select("file").distinct().count() > 1
    got = {r.page_id: r for r in warc.read(index.where("page_id >= 9"), folder).collect()}
    assert got.keys() == {9, 10, 11} and bytes(got[10].payload) == b"y" * 300_000 and bytes(got[9].payload).decode() == PAGES[5][2]
    assert {r.url for r in warc.read(index.where("page_id = 5"), folder).collect()} == {PAGES[1][1]}


def test_dedup_threshold(spark):
    got = warc.round_trip(frame(spark), dedup_from=5).collect()
    assert {r.record_type for r in got if r.payload_bytes < 5} == {"response"}


def test_ranges_are_joined():
    assert list(warc.ranges([(0, 10), (10, 5), (20, 5), (500, 1)], gap=10, most=100)) == [[(0, 10), (10, 5), (20, 5)], [(500, 1)]]
    assert list(warc.ranges([(0, 60), (60, 60)], gap=10, most=100)) == [[(0, 60)], [(60, 60)]]


def test_a_wrong_index_is_noticed(spark):
    folder = work_path(spark, "archives")
    index = warc.write(frame(spark, PAGES[:2]), folder).selectExpr("file", "offset", "length", "url", "'WRONG' as payload_digest")
    with pytest.raises(Exception, match="index does not fit"):
        warc.read(index, folder).collect()


def test_no_pages(spark):
    assert warc.round_trip(frame(spark, [])).count() == 0


CONTROL = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "a>b", "<role:x>y</role>", "<<SYS>>", "", "<", "<<<SYS>>>", "[[INST]", "\\n\n<s", "é😀"]


PIECES = ["<", ">", "\\", "s", "/", "|", "[", "]", "INST]", "[INST]", "</s>", "</s", "<s", "</role", "<role=", "|role>", "|role", "<<SYS>>", "<</SYS>>", "role=", "a", "\n", ""]


def test_formatting_is_reversible():
    """Roles and texts made of pieces of marks come back from the whole formatted conversation, whatever its chunks."""
    made, rnd = chat.Formatter(), random.Random(3)
    some = lambda most: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, most)))
    for _ in range(400):
        turns = [(rnd.choice(["user", "assistant", "system", "", "</s", "</role", "<s", some(6)]), some(14)) for _ in range(rnd.randint(0, 8))] + [("x", rnd.choice(CONTROL))]
        parts = [made.segments(r, t) for r, t in turns]
        whole = "".join(s for p in parts for s, _ in p)
        assert made.parse(whole) == turns
        reader, got, at = chat.Reader(made), [], 0
        while at < len(whole):
            k = rnd.randint(1, 9)
            got += reader.feed(whole[at : at + k])
            at += k
        reader.end()
        assert got == turns
        assert not any(made.mark.search(made.escape(x)) for turn in turns for x in turn)


def test_what_is_no_formatted_conversation_raises():
    made = chat.Formatter()
    for text in ("x", "<s>a", "<s>a[INST]", "</s>", "<s>a</s>b", "<role=a</role>"):
        with pytest.raises(ValueError):
            made.parse(text)


def test_templates_whose_control_strings_overlap_are_refused():
    for other in (("<role:", ":role>", "</role>"), ("<r", "|>", ">x"), ("<r", "m", "e>")):
        with pytest.raises(ValueError):
            chat.Template(roles={"user": ("<u>", "</u>", True)}, other=other, follows={})


def conversations():
    return [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "</s> x"), (2, 1, "assistant", "first"), (2, 0, "user", None), (3, 0, "assistant", "wrong"), (3, 1, None, "n"), (4, 0, "user", "a"), (4, 1, "user", "b"), (5, 0, "user", "end"), (None, 0, "user", "x"), (6, None, "user", "q"), (6, 3, "assistant", "r"), (7, 0, "user", "same"), (7, 0, "user", "same")]


def want(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        made = chat.Formatter()
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(s) for r, t in turns for s, _ in made.segments(r, t)))
    return out


def test_digests(spark):
    rows = conversations() + [(9, 0, "</s", "hi"), (9, 1, "</role", "<s"), (9, 2, "<s", "|role>")] + [(8, k, ("user", "assistant")[k % 2], CONTROL[k % len(CONTROL)]) for k in range(3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for c, r in got.items()} == want(rows)
    assert {c: r.first_invalid for c, r in got.items() if c in (1, 2, 3, 4, 5, 8)} == {1: None, 2: None, 3: 0, 4: 1, 5: 1, 8: None}


def test_segments_join_to_the_output(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    rows = chat.format_segments(df).where("conv_id = 1").orderBy("turn_no", "segment_no").collect()
    assert "".join(r.text for r in rows) == "<<SYS>>s<</SYS>>[INST]u[/INST]<s><\\/s> x</s>"
    assert [r.text for r in rows if r.loss] == ["<\\/s> x"]


def test_no_turns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(empty).count() == 0 and chat.format_segments(empty).count() == 0


def test_whole_tables(spark, sf):
    rows = [tuple(r) for r in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    control = "</s>[INST] ok [/INST]"
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in queries.op2_chat_formatting(spark, sf).collect()}
    assert got == want([*rows, (-7, 0, "user", control), (-7, 1, "assistant", control)])
