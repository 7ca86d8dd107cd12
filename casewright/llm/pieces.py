"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The vocabulary is read through the sentencepiece library; the merging is done here. Adjacent symbol pairs wait
in an agenda ordered by piece score (ties: the leftmost pair); the best pair is merged, its neighbours form new
pairs, until no pair is a piece. Characters that are no piece become their UTF-8 bytes' pieces.

A text is cut where no piece can reach across: between another character and a following ``▁``, and around
characters that only occur as single characters or bytes. The parts are encoded by themselves and remembered,
so a running text costs one dictionary look-up a word.

Nulls count as the empty text, which has no ids but the end id. Very long words go through the same agenda in
``n log n`` steps and are not remembered. Equal texts give equal rows; extra columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from casewright.llm.packing import lean

SPACE = "▁"
#: The score of a pair that is no piece.
LAST = float("-inf")


class PieceModel:
    """A merge-type vocabulary with the agenda encoder and the decoder.

    ``remember`` bounds the number of remembered parts; the memory is emptied when it is full.
    """

    def __init__(self, path: str, remember: int = 600_000):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, len(self.library)
        self.piece = [lib.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        self.special = special
        self.ids = {p: i for i, p in enumerate(self.piece) if i not in special}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.eos = lib.eos_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the vocabulary has pieces that reach across a word boundary")
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        a = re.escape(alone)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}{a}]*|[^{SPACE}{a}]+|[{a}]" if alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.known = _Parts(self, remember)

    def merge(self, part: str) -> list[str]:
        """The pieces of a part: merges in score order from an agenda of adjacent pairs.

        The agenda of a short part is a list beside its symbols, that of a long one a heap.
        """
        return self._merge_long(part) if len(part) > 32 else self._merge_short(part)

    def _merge_short(self, part: str) -> list[str]:
        sym, score = list(part), self.score.get
        agenda = [score(a + b, LAST) for a, b in zip(sym, sym[1:], strict=False)]
        while agenda:
            best = max(agenda)
            if best == LAST:
                break
            i = agenda.index(best)
            sym[i] += sym.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score(sym[i] + sym[i + 1], LAST)
            if i:
                agenda[i - 1] = score(sym[i - 1] + sym[i], LAST)
        return sym

    def _merge_long(self, part: str) -> list[str]:
        sym, n, score = list(part), len(part), self.score
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(sym[i] + sym[i + 1])
            if s is not None:
                agenda.append((-s, i, i + 1, len(sym[i]) + len(sym[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not sym[i] or not sym[j] or len(sym[i]) + len(sym[j]) != size or after[i] != j:
                continue
            sym[i] += sym[j]
            sym[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                s = score.get(sym[i] + sym[k])
                if s is not None:
                    heapq.heappush(agenda, (-s, i, k, len(sym[i]) + len(sym[k])))
            h = before[i]
            if h >= 0:
                s = score.get(sym[h] + sym[i])
                if s is not None:
                    heapq.heappush(agenda, (-s, h, i, len(sym[h]) + len(sym[i])))
        return [x for x in sym if x]

    def part_ids(self, part: str) -> list[int]:
        pieces = self.merge(part)
        try:
            return [self.ids[p] for p in pieces]
        except KeyError:
            pass
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte_id[b] for b in p.encode("utf-8")]
        return out

    def normalise(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encoded(self, text: str) -> tuple[str, str]:
        """The ids in decimal joined by one space, end id included, and the text that these ids decode to.

        A part's bytes are whole characters, so the decoded parts joined are the decoded text; ``odd`` holds the
        parts that decode to another text than their own.
        """
        whole = self.normalise(text)
        parts = self.cut(whole)
        got = list(map(self.known.__getitem__, parts))
        got.append(str(self.eos))
        odd = self.known.odd
        back = ("".join([odd.get(p, p) for p in parts]) if odd else whole).replace(SPACE, " ")
        return " ".join(got), back[1:] if back.startswith(" ") else back

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.encoded(text or "")[0].split(" ")]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids: runs of byte pieces are read as UTF-8, each byte that is part of no character becomes U+FFFD.

        ``first``: the ids begin a text, so the space that stands before every text goes.
        """
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(_characters(pending))
                pending.clear()
                first = False
            if i in self.special:
                if self.library.is_unknown(i):
                    out.append(" ⁇ ")
                    first = False
                continue
            p = self.piece[i]
            if first and p.startswith(SPACE):
                p = p[1:]
            first = False
            out.append(p)
        if pending:
            out.append(_characters(pending))
        return "".join(out).replace(SPACE, " ")


@functools.cache
def model_of(path: str) -> PieceModel:
    """The model of a file, kept by a Python worker from task to task; its remembered parts end with a task."""
    return PieceModel(path)


class _Parts(dict):
    """Remembered parts: their ids in decimal. Each part is decoded once, to see that it gives itself."""

    def __init__(self, model: PieceModel, most: int):
        super().__init__()
        self.model, self.most, self.odd = model, most, {}

    def __missing__(self, part: str) -> str:
        ids = self.model.part_ids(part)
        back = self.model.decode(ids, first=False)
        if back != part.replace(SPACE, " "):
            self.odd[part] = back
        got = " ".join(map(str, ids))
        if len(part) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[part] = got
        return got


def _characters(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that starts no character."""
    try:
        return bytes(data).decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(data[i : i + n]).decode("utf-8"))
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id", check_every: int = 100) -> DataFrame:
    """Digests of ids and decoded texts: each whole text encoded and decoded in Arrow batches.

    Of every ``check_every`` texts of an Arrow batch, beginning with its first, one is compared with the library's own
    encode and decode; a difference fails the task. 0 compares none. Returns doc_id, n_tokens, ids_sha256, decoded_sha256.
    """
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        with lean(model.known.clear):
            for batch in batches:
                n_tokens, ids_hex, text_hex = [], [], []
                for k, t in enumerate(batch.column(1)):
                    t = t.as_py() or ""
                    ids, back = model.encoded(t)
                    if check_every and k % check_every == 0:
                        lib = model.library.encode(t, add_eos=True)
                        listed = [int(x) for x in ids.split(" ")]
                        if lib != listed or model.library.decode(lib) != back:
                            raise AssertionError("the agenda's result differs from the library's")
                    n_tokens.append(ids.count(" ") + 1)
                    ids_hex.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_hex.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, model_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, token_ids``: the ids themselves, for writing out a tokenized corpus."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        with lean(model.known.clear):
            for batch in batches:
                ids = [model.encode(t.as_py()) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "token_ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, token_ids array<int>")
