"""Substring dedup: words of every window of ``length`` words that also starts earlier in the corpus.

Method: fixed-block anchors. With blocks of half the window's length, ``block = length // 2``, the index holds the
non-overlapping blocks of every document, those that start at a multiple of ``block``: its anchors. Every rolling window
of ``block`` words probes it, as a semi join on hashes: an anchor costs one entry however frequent it is, and no pair
of places is made. A probe is a hit if it is some document's anchor and its words occur at a second place. Every
repeated window of ``length`` words holds a hit, as its earlier place covers one anchor whole; so text that occurs once
ends here, and only the hits' starts go back to their documents. There each hit is extended left and right over
all windows of ``length`` words that hold it, which puts neighbouring hits together into stretches, the candidates for
maximal repeats. Only windows inside stretches are named, by a hash of their words, and exchanged: of each name all
but the first start are repeats. Overlapping repeated windows give the maximal exact repeats.

"Earlier" is a smaller doc_id, or an earlier start in the same document; windows are judged on the input. In the index
a hash has 32 bits and the partition's number; one that is shared by chance only makes a candidate. A name has 96
bits (64 of the whole window, 32 of its first half) and is not compared with the words again: with 10^13
named windows, two that differ share a name with a probability below 0.001.

Null and empty texts have no words. Texts with fewer words than a window lose nothing. Very long texts are
packed piece by piece. Rows that repeat a doc_id and its text are copies of one document's windows at the same
starts, so neither removes the other. Rows of one doc_id with different texts are documents of their own, in the order
of a hash of their texts. Extra columns pass through ``strip_repeats``.
Rows with a null doc_id pass unchanged. All numbers travel packed. A window that a third of all documents share costs
each send of half a million windows and more one entry, in both exchanges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm import wordhash
from casewright.llm.packing import SENT, blobs, exchange, lean, pack, unpack
from casewright.llm.shared import cut, fresh, partitions

U = np.uint64
#: Rolling windows gathered by a task before it sends, and the most that it gathers for many targets.
SEND_AT, SEND_MOST = 500_000, 6_000_000


def _targets(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int32)


def _by_target(target: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(target.astype(np.uint16) if n <= 65536 else target, kind="stable")
    cuts = np.searchsorted(target[order], np.arange(n + 1))
    for k in range(n):
        if cuts[k + 1] > cuts[k]:
            yield k, order[cuts[k] : cuts[k + 1]]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.diff(np.append(starts, len(values)))


def _send_windows(block: int, n: int):
    """Rolling windows of ``block`` words, each once for a send, to the partition of their hash.

    A send holds whole documents. Of windows that occur several times in it the first place goes out, with marks for
    "several times" and "an indexed block"; the other places go, as links to that first place, to the partition
    where the send's answers will meet (its home), so a frequent window costs each send one entry.
    """

    def flush(ids: list, starts: list, hashes: list, home: int) -> pa.RecordBatch:
        doc, start, h = np.concatenate(ids), np.concatenate(starts), np.concatenate(hashes)
        order = np.argsort(doc, kind="stable")
        doc, start, h = doc[order], start[order], h[order]
        order = np.argsort(h, kind="stable")
        at, count = _runs(h[order])
        first = order[at]
        marks = (count > 1).astype(np.uint8) | np.logical_or.reduceat(start[order] % block == 0, at).astype(np.uint8) << 1
        lead = np.repeat(first, count)
        other = np.ones(len(order), bool)
        other[at] = False
        again, lead = order[other], lead[other]
        order = np.argsort(first)
        first, marks = first[order], marks[order]
        to, data = [], []
        for k, pick in _by_target(_targets(h[first], n), n):
            i = first[pick]
            run, count = _runs(doc[i])
            step = np.diff(start[i], prepend=np.int64(0))
            step[run] = start[i][run]
            to.append(k)
            data.append(pack(_mark(WINDOWS, home), (h[i] & U(0xFFFFFFFF)).astype(np.uint32), doc[i][run], count.astype(np.uint32), step.astype(np.uint32), marks[pick]))
        if len(again):
            order = np.argsort(again)
            i, j = again[order], lead[order]
            run, count = _runs(doc[i])
            to.append(home)
            data.append(pack(_mark(LINKS, home), doc[i][run], count.astype(np.uint32), start[i].astype(np.uint32), doc[j], start[j].astype(np.uint32)))
        return blobs(to, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            ids, starts, hashes, held = [], [], [], 0
            # with many targets a send has to be larger, or its blobs hold next to nothing
            enough = min(max(SEND_AT, 50 * n), max(SEND_AT, SEND_MOST))
            # neighbouring tasks begin at different homes, so that all homes get as many sends
            home = TaskContext.get().partitionId() * 7919
            for batch in batches:
                for part in wordhash.slices(batch, 1):
                    w = wordhash.read(part.column(1))
                    h = w.windows(block)
                    keys = np.asarray(part.column(0).to_numpy(zero_copy_only=False), np.int64)
                    own = np.repeat(np.arange(len(keys)), np.diff(w.first))[: len(h)]
                    start = np.arange(len(h)) - w.first[own]
                    whole = np.arange(len(h)) + block <= w.first[own + 1]
                    ids.append(keys[own[whole]])
                    starts.append(start[whole])
                    hashes.append(h[whole])
                    held += int(whole.sum())
                    if held >= enough:
                        yield flush(ids, starts, hashes, home % n)
                        ids, starts, hashes, held = [], [], [], 0
                        home += 1
            if held:
                yield flush(ids, starts, hashes, home % n)

    return run


WINDOWS, LINKS = 0, 1


def _mark(kind: int, home: int) -> np.ndarray:
    return np.array([kind, home], np.uint32)


def _expand(got: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    h = np.concatenate([g[1] for g in got])
    doc = np.concatenate([np.repeat(g[2], g[3]) for g in got])
    home = np.concatenate([np.full(len(g[1]), g[0][1], np.int32) for g in got])
    marks = np.concatenate([g[5] for g in got])
    start = []
    for g in got:
        first = np.cumsum(g[3].astype(np.int64)) - g[3]
        total = np.cumsum(g[4].astype(np.int64))
        base = total[first] - g[4][first]
        start.append(total - np.repeat(base, g[3]))
    return h, doc, np.concatenate(start), home, marks


def _probe(n: int):
    """In a hash's partition: the probes that are in the index and occur again, to the homes of their sends."""

    def work(got: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for g in got:
            if g[0][0] == LINKS:
                yield blobs([int(g[0][1])], [pack(*g)])
        got[:] = [g for g in got if g[0][0] == WINDOWS]
        if not got:
            return
        index = np.unique(np.concatenate([g[1][g[5] & 2 > 0] for g in got]))
        for g in got:
            # probes that meet no anchor end here
            place = np.minimum(np.searchsorted(index, g[1]), max(len(index) - 1, 0))
            g.append(index[place] == g[1] if len(index) else np.zeros(len(g[1]), bool))
        met = np.concatenate([g.pop() for g in got])
        h, doc, start, home, marks = (x[met] for x in _expand(got))
        got.clear()
        order = np.argsort(h)
        at, count = _runs(h[order])
        if not len(at):
            return
        several = (count > 1) | (np.bitwise_or.reduceat(marks[order], at) & 1 > 0)
        order = order[np.repeat(several, count)]
        doc, start, home = doc[order], start[order], home[order]
        to, data = [], []
        for k, pick in _by_target(home, n):
            pick = pick[np.lexsort((start[pick], doc[pick]))]
            at, count = _runs(doc[pick])
            to.append(k)
            data.append(pack(_mark(WINDOWS, k), doc[pick][at], count.astype(np.uint32), start[pick].astype(np.uint32)))
        if to:
            yield blobs(to, data)

    return work


PLACES = "doc_id long, blob binary"


def _by_document(doc: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each document with its packed distinct starts in order."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    keep = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])]) if len(doc) else np.zeros(0, bool)
    doc, start = doc[keep], start[keep].astype(np.uint32)
    at, count = _runs(doc)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(doc[at], pa.int64()), pa.array([pack(start[a : a + c]) for a, c in zip(at, count, strict=True)], pa.binary())], names=["doc_id", "blob"])


def _at_home(got: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """At a send's home: starts of hits by document. Links are hits where the place that they link to is one."""
    hits, links = ([g for g in got if g[0][0] == kind] for kind in (WINDOWS, LINKS))
    got.clear()
    if not hits:
        return
    doc = np.concatenate([np.repeat(g[1], g[2]) for g in hits])
    start = np.concatenate([g[3] for g in hits]).astype(np.int64)
    if links:
        ldoc = np.concatenate([np.repeat(g[1], g[2]) for g in links])
        lstart, adoc, astart = (np.concatenate([g[k] for g in links]).astype(np.int64) for k in (3, 4, 5))
        ids = np.unique(doc)
        key = np.sort(np.searchsorted(ids, doc).astype(np.int64) << 32 | start)
        of = np.minimum(np.searchsorted(ids, adoc), len(ids) - 1)
        asked = of.astype(np.int64) << 32 | astart
        linked = (ids[of] == adoc) & (key[np.minimum(np.searchsorted(key, asked), len(key) - 1)] == asked)
        doc, start = np.concatenate([doc, ldoc[linked]]), np.concatenate([start, lstart[linked]])
    yield from _by_document(doc, start)


def hits(docs: DataFrame, block: int, n: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id, hits``: for documents with hits, packed arrays of the starts of blocks that are anchors and occur again."""
    source = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).where(F.col(doc_id).isNotNull())
    met = exchange(source.mapInArrow(_send_windows(block, n), SENT), n, _probe(n), SENT)
    return exchange(met, n, _at_home, PLACES).groupBy("doc_id").agg(F.collect_list("blob").alias("hits"))


def _stretches(found: list[bytes], n_words: int, length: int, block: int) -> np.ndarray:
    """Starts of all windows of ``length`` words that hold a hit."""
    edge = np.zeros(n_words + 1, np.int64)
    for blob in found:
        at = unpack(blob)[0].astype(np.int64)
        np.add.at(edge, np.maximum(at + block - length, 0), 1)
        np.add.at(edge, at + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: max(n_words - length + 1, 0)] > 0)


def _name_windows(place: int, key: int, held: int, length: int, block: int, n: int):
    """Windows inside the stretches, to the partition of their name; of those that a send holds again it says so itself."""

    def flush(docs: list, starts: list, names: list, halves: list) -> pa.RecordBatch:
        doc, start, h, half = (np.concatenate(x) for x in (docs, starts, names, halves))
        order = np.lexsort((start, doc, half, h))
        doc, start, h, half = (x[order] for x in (doc, start, h, half))
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (half[1:] != half[:-1])])
        first = np.flatnonzero(new)
        lead = np.repeat(first, np.diff(np.append(first, len(h))))
        again = np.flatnonzero((doc != doc[lead]) | (start != start[lead]))
        others = dict(_by_target(_targets(h[again], n), n))
        to, data = [], []
        # a name's repeats go where its first place goes, so a task that runs again cannot divide them otherwise
        for k, pick in _by_target(_targets(h[first], n), n):
            parts = []
            for i in (first[pick], again[others[k]] if k in others else again[:0]):
                i = i[np.lexsort((start[i], doc[i]))]
                at, count = _runs(doc[i])
                parts.append((i, doc[i][at], count.astype(np.uint32), start[i].astype(np.uint32)))
            i = parts[0][0]
            to.append(k)
            data.append(pack(h[i], half[i], *parts[0][1:], *parts[1][1:]))
        return blobs(to, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            gathered, count = ([], [], [], []), 0
            enough = min(max(SEND_AT, 50 * n), max(SEND_AT, SEND_MOST))
            for batch in batches:
                for part in wordhash.slices(batch, place):
                    w = wordhash.read(part.column(place))
                    names, halves = w.windows(length), w.windows(block)
                    ids = np.asarray(part.column(key).to_numpy(zero_copy_only=False), np.int64)
                    for k in range(part.num_rows):
                        a, b = int(w.first[k]), int(w.first[k + 1])
                        start = _stretches(part.column(held)[k].as_py(), b - a, length, block)
                        if len(start):
                            for x, y in zip(gathered, (np.full(len(start), ids[k]), start, names[a + start], (halves[a + start] & U(0xFFFFFFFF)).astype(np.uint32)), strict=True):
                                x.append(y)
                            count += len(start)
                    if count >= enough:
                        yield flush(*gathered)
                        gathered, count = ([], [], [], []), 0
            if count:
                yield flush(*gathered)

    return run


def named(docs: DataFrame, doc_id: str, text: str, length: int, n: int) -> DataFrame:
    """The windows inside stretches, packed by the partition of their name: all that is left of the corpus for the last step."""
    block = length // 2
    key, held = fresh("repeats_hit_id", docs.columns), fresh("repeats_hits", docs.columns)
    found = hits(docs, block, n, doc_id, text).withColumnsRenamed({"doc_id": key, "hits": held})
    both = docs.join(found, docs[doc_id] == found[key]).drop(key).sortWithinPartitions(doc_id)
    return both.mapInArrow(_name_windows(both.columns.index(text), both.columns.index(doc_id), len(both.columns) - 1, length, block, n), SENT)


def _settle(n: int):
    """Of equal windows all but the first, to the partitions of their documents."""

    def work(got: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, half, start = (np.concatenate([g[k] for g in got]) for k in (0, 1, 4))
        doc = np.concatenate([np.repeat(g[2], g[3]) for g in got])
        known = np.concatenate([np.repeat(g[5], g[6]) for g in got]), np.concatenate([g[7] for g in got])
        got.clear()
        order = np.lexsort((start, doc, half, h))
        h, half, doc, start = (x[order] for x in (h, half, doc, start))
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (half[1:] != half[:-1])]))
        lead = np.repeat(first, np.diff(np.append(first, len(h))))
        later = (doc != doc[lead]) | (start != start[lead])
        doc, start = np.concatenate([doc[later], known[0]]), np.concatenate([start[later], known[1]])
        to, data = [], []
        for k, i in _by_target(_targets(wordhash.mix(doc.view(U)), n), n):
            i = i[np.lexsort((start[i], doc[i]))]
            at, count = _runs(doc[i])
            to.append(k)
            data.append(pack(doc[i][at], count.astype(np.uint32), start[i].astype(np.uint32)))
        if to:
            yield blobs(to, data)

    return work


def _together(got: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Everything of a document in one row, however many partitions its windows were named in."""
    doc, start = np.concatenate([np.repeat(g[0], g[1]) for g in got]), np.concatenate([g[2] for g in got])
    got.clear()
    yield from _by_document(doc, start)


def numbered(docs: DataFrame, doc_id: str, text: str, name: str) -> DataFrame:
    """``docs`` with ``name``: a long for each document in the order of doc_id, the same only for equal id and text.

    It is the doc_id itself where no doc_id has two texts; else documents are counted in the order of id and text's hash.
    """
    own, key = F.col(doc_id).cast("long"), F.xxhash64(F.col(text).cast("string"))
    small = docs.where(own.isNotNull()).select(own.alias("d"), key.alias("k"))
    several = small.groupBy("d").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a != b")
    if several.limit(1).count() == 0:
        return docs.withColumn(name, own)
    d, k, at = (fresh(x, [*docs.columns, name]) for x in ("numbered_d", "numbered_k", "numbered_at"))
    ordered = cut(small.distinct().repartitionByRange(partitions(small), "d", "k").sortWithinPartitions("d", "k").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    # one row a partition: as many as there are tasks
    sizes = dict(sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()))
    before, total = [], 0
    for part, n in sizes.items():
        before.append((part, total))
        total += n
    offset = F.broadcast(docs.sparkSession.createDataFrame(before, "part int, before long"))
    found = ordered.join(offset, "part").select(F.col("d").alias(d), F.col("k").alias(k), (F.col("before") + F.col("row")).alias(at))
    return docs.join(found, (own == F.col(d)) & (key == F.col(k)), "left").drop(d, k).withColumnRenamed(at, name)


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 20) -> DataFrame:
    """``doc_id, found``: for documents with repeats, packed arrays of the starts of their repeated windows.

    A doc_id must have one text and no null; ``numbered`` gives such ids.
    """
    if length % 2:
        raise ValueError("the window's length has to be even")
    n = partitions(docs)
    settled = exchange(named(docs, doc_id, text, length, n), n, _settle(n), SENT)
    return exchange(settled, n, _together, PLACES).select("doc_id", F.array("blob").alias("found"))


def _removed(found: list[bytes], n_words: int, length: int) -> np.ndarray:
    """True for every word that a repeated window covers."""
    edge = np.zeros(n_words + 1, np.int64)
    for blob in found:
        starts = unpack(blob)[0].astype(np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.minimum(starts + length, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def _with_found(docs: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """``docs`` and, as the last column, the packed starts of each document's repeated windows."""
    number = fresh("repeats_number", docs.columns)
    key, held = fresh("repeats_id", docs.columns), fresh("repeats_found", docs.columns)
    docs = numbered(docs, doc_id, text, number)
    # both joins with texts shuffle the same rows by the same key, so Spark makes that shuffle once
    own = docs.where(docs[number].isNotNull())
    found = repeated_windows(own, number, text, length).withColumnsRenamed({"doc_id": key, "found": held})
    out = own.join(found, own[number] == found[key], "left").drop(key, number)
    return out.unionByName(docs.where(docs[number].isNull()).drop(number).withColumn(held, F.lit(None).cast("array<binary>")))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, 1):
                w = wordhash.words_only(part.column(1))
                raw, sizes, removed, digest = w.data.tobytes(), [], [], []
                for k in range(part.num_rows):
                    a, b = int(w.first[k]), int(w.first[k + 1])
                    found = part.column(2)[k].as_py()
                    keep = np.arange(a, b) if not found else a + np.flatnonzero(~_removed(found, b - a, length))
                    sizes.append(b - a)
                    removed.append(b - a - len(keep))
                    digest.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)])).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    # a renaming that renames nothing would keep Spark from seeing that both text shuffles are one
    as_is = (doc_id, text) == ("doc_id", "text") and dict(docs.dtypes)["doc_id"] == "bigint" and dict(docs.dtypes)["text"] == "string"
    source = docs.select("doc_id", "text") if as_is else docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _with_found(source, "doc_id", "text", length).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 20) -> DataFrame:
    """``docs`` with the repeated words taken out of the texts; texts without repeats stay as they are.

    What is left of a text keeps its own white space after each kept word. A text that loses all its words
    becomes empty.
    """
    schema = docs.schema
    place, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, place):
                w = wordhash.words_only(part.column(place))
                raw, out = w.data.tobytes(), []
                for k in range(part.num_rows):
                    found = part.column(len(names))[k].as_py()
                    if not found:
                        out.append(part.column(place)[k].as_py())
                        continue
                    a, b = int(w.first[k]), int(w.first[k + 1])
                    keep = a + np.flatnonzero(~_removed(found, b - a, length))
                    until = np.append(w.starts[a + 1 : b], w.ends[b - 1])
                    until = until[keep - a]
                    out.append(b"".join([raw[s:e] for s, e in zip(w.starts[keep].tolist(), until.tolist(), strict=True)]).decode("utf-8").strip(" \t\n\x0b\x0c\r"))
                columns = [part.column(i) for i in range(len(names))]
                columns[place] = pa.array(out, part.column(place).type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return _with_found(docs, doc_id, text, length).mapInArrow(run, schema)
