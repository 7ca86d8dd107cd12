"""N-gram Jaccard join: all links between documents whose shingle sets reach a similarity, and their components.

Method: universe-partition pigeonhole. Documents with the same set are one class. Classes are put into size bands
(sizes from a power of two to below the next); a class near the top of its band also enters the next band, so that
any two classes of similar size meet in one. In a band the universe of shingles is hashed into ``m`` segments. Two
similar sets differ in at most ``H = (1 - t) / (1 + t) * (a + b)`` shingles, so of the segments that are not empty
in both at most ``H`` differ: a class with more non-empty segments than its largest possible ``H`` shares a whole
segment subset with every similar class. The segments' subsets are indexed by hash. Cost-based allocation: most
classes pay one signature for a non-empty segment; a class without that many adds the one-deletion neighbourhoods
of its subsets, which let a segment differ by one shingle and so count twice; where this too is not enough, every
shingle by itself is a signature. Both classes of a pair that a cheaper level could miss are at the dearer level.

Signatures meet, packed, in the partition of their hash. Groups of up to ``SMALL`` classes give pairs with the number
of shared segments, and pairs with fewer than the pigeonhole asks for are dropped. Larger groups never give pairs:
their classes are listed under the group's first class, and of these only classes with so many frequent segments
that a link could rest on them go on. What is left is verified exactly, set against set, in blocks of bounded
size; linked classes are joined by connected components in Spark. Lists and pairs that share classes are first put
together to one group, where comparing the whole group costs no more than comparing each: a class of near copies is
then sent once and not once for each list that holds it.

A shingle is five consecutive words, lower-cased (A-Z), held as a 64-bit hash; a text with one to four words is one
shingle of all its words. Null and empty texts have an empty set and link with nothing. Very long texts are one set
each. Repeated rows and equal texts are one class. Extra columns are ignored; an empty table gives an empty table.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm import wordhash
from casewright.llm.packing import SENT, blobs, exchange, lean, pack
from casewright.llm.repeats import _by_target, _runs, _targets
from casewright.llm.shared import broadcast_checked, cut, fresh, partitions

U = np.uint64
#: Classes of a signature that are paired; more are listed under one class.
SMALL = 8
#: Signatures gathered by a task before it sends, and the most that it gathers for many targets.
SEND_AT, SEND_MOST = 500_000, 4_000_000
#: Shingles of one block of a cluster that is verified in several tasks.
BLOCK_TOKENS = 500_000
#: Rows of a table that is broadcast; a larger one goes through a shuffled join.
MOST_SENT = 200_000
#: Mean shingles of a segment in the middle of a band; see ``segments``.
FILL = 1.5


class Similarity:
    """The threshold as a fraction ``num / den``, so that every bound is exact in integers."""

    def __init__(self, num: int = 75, den: int = 100):
        self.num, self.den = num, den

    def most_apart(self, a, b):
        """The largest symmetric difference of similar sets of these sizes."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def most_apart_any(self, a):
        """The same over all sizes the other set can have."""
        return (self.den - self.num) * a // self.num

    def sizes_fit(self, a, b):
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def linked(self, shared, a, b):
        return self.den * shared >= self.num * (a + b - shared)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = wordhash.read(column, lower=True)
    h = w.windows(n)
    for k in range(len(column)):
        a, b = int(w.first[k]), int(w.first[k + 1])
        if b - a >= n:
            x = np.sort(h[a : b - n + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif b > a:
            with np.errstate(over="ignore"):
                yield wordhash.mix(np.array([_fold(w.hash[a:b])], U))
        else:
            yield np.zeros(0, U)


def _fold(h: np.ndarray) -> int:
    out = len(h)
    for x in h.tolist():
        out = ((out * 0xD6E8FEB86659FD93) ^ x) & 0xFFFFFFFFFFFFFFFF
    return out


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set; 0 for the empty set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        return int(wordhash.mix(np.array([np.add.reduce(wordhash.mix(s ^ U(0xA5A5A5A5DEADBEEF))) + U(len(s))], U))[0].astype(np.int64)) or 1


def segments(band: int) -> int:
    """Segments of a band that holds sizes from ``2 ** band`` to below ``2 ** (band + 1)``."""
    return max(1, round(2**band * 1.4142 / FILL))


def _bands(size: int, sim: Similarity) -> list[int]:
    band = size.bit_length() - 1
    return [band, band + 1] if sim.den * size >= sim.num * 2 ** (band + 1) else [band]


def _signatures(s: np.ndarray, band: int, sim: Similarity) -> tuple[np.ndarray, np.ndarray, int]:
    """(exact signatures, additional ones, non-empty segments) of a set in a band."""
    m, size = segments(band), len(s)
    with np.errstate(over="ignore"):
        place = ((wordhash.mix(s + U(0x51ED270B + band)) >> U(32)) * U(m) >> U(32)).astype(np.int64)
        value = wordhash.mix(s ^ U(0x0123456789ABCDEF))
        order = np.argsort(place, kind="stable")
        place, value = place[order], value[order]
        at, count = _runs(place)
        total = np.add.reduceat(value, at)
        salt = wordhash.mix(place[at].astype(U) * U(64) + U(band + 1))
        exact = wordhash.mix(total ^ salt)
        need = sim.most_apart_any(size) + 1
        if len(at) >= need:
            return exact, np.zeros(0, U), len(at)
        many = count >= 2
        own = np.repeat(np.arange(len(at)), count)
        less = np.repeat(many, count)
        more = [wordhash.mix((total[own] - value)[less] ^ salt[own][less])]
        if len(at) + int(many.sum()) < need:
            more.append(wordhash.mix(s ^ U(0xFEDCBA9876543210)))
    return exact, np.concatenate(more), len(at)


def _send_signatures(n_words: int, sim: Similarity, n: int):
    def flush(rows: list) -> pa.RecordBatch:
        key = np.array([r[0] for r in rows], np.int64)
        size, band, filled = (np.array([r[k] for r in rows], np.uint32) for k in (1, 2, 3))
        exact, more = [r[4] for r in rows], [r[5] for r in rows]
        h = np.concatenate(exact + more)
        who = np.concatenate([np.repeat(np.arange(len(rows)), [len(x) for x in exact]), np.repeat(np.arange(len(rows)), [len(x) for x in more])])
        extra = np.concatenate([np.zeros(sum(map(len, exact)), np.uint8), np.ones(sum(map(len, more)), np.uint8)])
        order = np.argsort(who, kind="stable")
        h, who, extra = h[order], who[order], extra[order]
        to, data = [], []
        for k, pick in _by_target(_targets(h, n), n):
            at, count = _runs(who[pick])
            r = who[pick][at]
            to.append(k)
            data.append(pack((h[pick] & U(0xFFFFFFFF)).astype(np.uint32), extra[pick], key[r], size[r], band[r], filled[r], count.astype(np.uint32)))
        return blobs(to, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            rows, held, seen = [], 0, set()
            enough = min(max(SEND_AT, 50 * n), max(SEND_AT, SEND_MOST))
            for batch in batches:
                for part in wordhash.slices(batch, 0):
                    for s in shingle_sets(part.column(0), n_words):
                        if not len(s) or (key := set_key(s)) in seen:
                            continue
                        seen.add(key)
                        for band in _bands(len(s), sim):
                            exact, more, filled = _signatures(s, band, sim)
                            rows.append((key, len(s), band, filled, exact, more))
                            held += len(exact) + len(more)
                    if held >= enough:
                        yield flush(rows)
                        rows, held, seen = [], 0, set()
            if rows:
                yield flush(rows)

    return run


MET = "big boolean, band int, a long, b long, size_a int, size_b int, filled_a int, filled_b int, shared int"


def _meet(sim: Similarity):
    """In a signature's partition: pairs of small groups with their number of shared segments; members of large groups."""

    def out(big: bool, band, a, b, size_a, size_b, filled_a, filled_b, shared) -> pa.RecordBatch:
        i32 = lambda x: pa.array(np.asarray(x).astype(np.int32), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), big)), i32(band), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *map(i32, (size_a, size_b, filled_a, filled_b, shared))], names=["big", "band", "a", "b", "size_a", "size_b", "filled_a", "filled_b", "shared"])

    def work(got: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sig = np.concatenate([g[0] for g in got])
        extra = np.concatenate([g[1] for g in got])
        key, size, band, filled = (np.concatenate([g[k] for g in got]) for k in (2, 3, 4, 5))
        row = np.repeat(np.arange(len(key)), np.concatenate([g[6] for g in got]))
        got.clear()
        order = np.lexsort((key, band))
        new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (band[order][1:] != band[order][:-1])])
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new) - 1
        keep = order[new]
        key, size, band, filled = key[keep], size[keep].astype(np.int64), band[keep].astype(np.int64), filled[keep].astype(np.int64)
        # one entry for a signature and class; an exact one goes before an additional one
        if len(key) >= 2**31:
            raise ValueError(f"{len(key)} classes in one partition; use more shuffle partitions")
        packed = np.unique((sig.astype(U) << U(32)) | (rank[row].astype(U) << U(1)) | extra.astype(U))
        sig, who, extra = packed >> U(32), ((packed & U(0xFFFFFFFF)) >> U(1)).astype(np.int64), (packed & U(1)).astype(np.int64)
        one = np.concatenate([[True], (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])])
        sig, who, extra = sig[one], who[one], extra[one]
        at, count = _runs(sig)
        pairs, hits = [], []
        for g in range(2, SMALL + 1):
            rows = at[count == g][:, None] + np.arange(g)
            if not len(rows):
                continue
            i, j = np.triu_indices(g, 1)
            a, b = who[rows[:, i]].ravel(), who[rows[:, j]].ravel()
            ok = (band[a] == band[b]) & sim.sizes_fit(size[a], size[b])
            e = ((extra[rows[:, i]] | extra[rows[:, j]]) == 0).ravel()
            pairs.append((a[ok].astype(U) << U(32)) | b[ok].astype(U))
            hits.append(e[ok])
        if pairs:
            p, h = np.concatenate(pairs), np.concatenate(hits)
            p, back = np.unique(p, return_inverse=True)
            shared = np.bincount(back, h, len(p)).astype(np.int64)
            a, b = (p >> U(32)).astype(np.int64), (p & U(0xFFFFFFFF)).astype(np.int64)
            if len(p):
                yield out(False, band[a], key[a], key[b], size[a], size[b], filled[a], filled[b], shared)
        large = count > SMALL
        if large.any():
            pivot = np.repeat(who[at[large]], count[large])
            pick = np.flatnonzero(np.repeat(large, count))
            m, back = np.unique((pivot.astype(U) << U(32)) | who[pick].astype(U), return_inverse=True)
            shared = np.bincount(back, 1 - extra[pick], len(m)).astype(np.int64)
            a, b = (m >> U(32)).astype(np.int64), (m & U(0xFFFFFFFF)).astype(np.int64)
            yield out(True, band[b], key[a], key[b], size[a], size[b], filled[a], filled[b], shared)

    return work


def text_key(text: str):
    """The name under which a text is fetched again: rows with equal texts have the same."""
    return F.xxhash64(F.col(text).cast("string"))


def classes(docs: DataFrame, doc_id: str, text: str, n_words: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_key`` for each document; the key of an empty set is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            yield from keyed(batches)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in wordhash.slices(batch, 2):
                sizes, keys = [], []
                for s in shingle_sets(part.column(2), n_words):
                    sizes.append(len(s))
                    keys.append(set_key(s) or None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())], names=["doc_id", "text_key", "n_shingles", "set_key"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key long")


def candidates(docs: DataFrame, text: str, n_words: int, sim: Similarity) -> DataFrame:
    """``cluster, set_key, size``: classes that have to be compared with those of the same cluster."""
    n = partitions(docs)
    sent = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_send_signatures(n_words, sim, n), SENT)
    met = cut(exchange(sent, n, _meet(sim), MET))
    most_apart = F.floor(F.lit(sim.den - sim.num) * (F.col("size_a") + F.col("size_b")) / F.lit(sim.den + sim.num))
    loose = F.floor(F.lit(sim.den - sim.num) * F.col("size_b") / F.lit(sim.num))
    large = met.where("big")
    frequent = large.groupBy("band", "b").agg(F.sum("shared").alias("frequent"), F.first("filled_b").alias("filled_b"), F.first("size_b").alias("size_b"))
    resting = frequent.where(F.col("frequent") >= F.col("filled_b") - loose).select("band", "b")
    listed = large.join(resting, ["band", "b"]).select(F.xxhash64("band", "a", F.lit(1)).alias("cluster"), F.col("b").alias("set_key"), F.col("size_b").alias("size"))
    pairs = met.where("not big").groupBy("band", "a", "b").agg(F.sum("shared").alias("shared"), *[F.first(c).alias(c) for c in ("size_a", "size_b", "filled_a", "filled_b")]).withColumn("least", F.greatest("filled_a", "filled_b") - most_apart)
    of = lambda side: frequent.select("band", F.col("b").alias(side), F.col("frequent").alias(f"frequent_{side}"))
    pairs = pairs.join(of("a"), ["band", "a"], "left").join(of("b"), ["band", "b"], "left")
    rest = F.least(F.coalesce("frequent_a", F.lit(0)), F.coalesce("frequent_b", F.lit(0)))
    pairs = pairs.where(F.col("shared") + rest >= F.col("least"))
    label = F.xxhash64("a", F.lit(0)).alias("cluster")
    paired = pairs.select(label, F.explode(F.array(F.struct(F.col("a").alias("set_key"), F.col("size_a").alias("size")), F.struct(F.col("b").alias("set_key"), F.col("size_b").alias("size")))).alias("x")).select("cluster", "x.*")
    return listed.unionByName(paired).distinct()


def _verify(n_words: int, sim: Similarity):
    """Links of one tile of a cluster, as a star for each component of the tile."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) < 256:
            return stars(frame)
        with lean():
            return stars(frame)

    def stars(frame: pd.DataFrame) -> pd.DataFrame:
        sets = []
        for lo in range(0, len(frame), 64):
            sets += list(shingle_sets(pa.array(frame["text"][lo : lo + 64], pa.string()), n_words))
        # another text under the same text_key is not the class's
        own = np.array([set_key(s) for s in sets], np.int64) == frame["set_key"].to_numpy()
        rows = frame[own].reset_index().sort_values(["set_key", "probe"], ascending=[True, False]).drop_duplicates("set_key")
        frame, sets = rows.reset_index(drop=True), [sets[k] for k in rows["index"]]
        n = len(sets)
        if n < 2:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        size = np.array([len(s) for s in sets], np.int64)
        tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), size)
        order = np.argsort(token, kind="stable")
        postings, first = owner[order], np.searchsorted(token[order], np.arange(len(tokens) + 1))
        begin = np.concatenate([[0], np.cumsum(size)])
        root = np.arange(n)
        components = n
        for r in np.flatnonzero(frame["probe"].to_numpy()):
            if components == 1:
                break
            mine = token[begin[r] : begin[r + 1]]
            s, c = first[mine], first[mine + 1] - first[mine]
            where = np.repeat(s - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(int(c.sum()))
            shared = np.bincount(postings[where], minlength=n)
            linked = np.flatnonzero(sim.linked(shared, size[r], size) & (root != root[r]))
            if len(linked):
                joined = np.unique(np.append(root[linked], root[r]))
                root[np.isin(root, joined)] = joined[0]
                components -= len(joined) - 1
        keys = frame["set_key"].to_numpy()
        other = np.flatnonzero(root != np.arange(n))
        return pd.DataFrame({"a": keys[root[other]], "b": keys[other]})

    return run


def groups(found: DataFrame) -> DataFrame:
    """``cluster, set_key, size, tokens``: every two classes of a cluster of ``found`` are in a cluster of this.

    Clusters that are connected by common classes are put together where the square of the whole is at most the sum of
    the squares of the parts; chains of loosely connected clusters stay apart. ``tokens`` is the sum of a cluster's sizes.
    """
    label = components(found.select(F.col("cluster").alias("a"), F.col("set_key").alias("b"))).withColumnRenamed("node", "set_key")
    held = cut(found.join(label, "set_key"))
    single = held.select("component", "set_key", "size").distinct()
    parts = held.groupBy("component", "cluster").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("members"))
    whole = single.groupBy("component").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("members"))
    square = lambda c: F.col(c).cast("double") * F.col(c)
    apart = parts.groupBy("component").agg(F.sum(square("tokens")).alias("apart"))
    # a table of its own, so that a join with it can be split where one group is hot
    one = cut(whole.join(apart, "component").select("component", "tokens", "members", (square("tokens") <= F.col("apart")).alias("together")))
    together = single.join(one.where("together and members > 1").select("component", "tokens"), "component").select(F.col("component").alias("cluster"), "set_key", "size", "tokens")
    lists = cut(parts.join(one.where("not together").select("component"), "component").where("members > 1").select("cluster", "tokens"))
    return together.unionByName(held.join(lists, "cluster").select("cluster", "set_key", "size", "tokens"))


def links(docs: DataFrame, held: DataFrame, text: str, n_words: int, sim: Similarity) -> DataFrame:
    """``a, b``: links between classes that span every component of linked classes.

    A cluster with many shingles is dealt into blocks. First every block is compared with itself and with block 0,
    which joins nearly all of a group of near copies at a cost in proportion to its size. Then only classes outside
    the cluster's main component are compared with all others; two classes inside it need no further link.
    """
    blocks = lambda tokens: F.greatest(F.lit(1), F.ceil(tokens / F.lit(BLOCK_TOKENS)).cast("int"))
    placed = groups(cut(candidates(docs, text, n_words, sim))).withColumn("n_blocks", blocks(F.col("tokens")))
    placed = cut(placed.withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("n_blocks")).cast("int")).drop("tokens"))
    member = held.where("set_key is not null").groupBy("set_key").agg(F.min("text_key").alias("text_key"))
    asked = placed.select("set_key").distinct().join(member, "set_key")
    # equal texts are one before they are sent; the same plan at every size, as the asked classes grow with the corpus
    texts = docs.select(text_key(text).alias("text_key"), F.col(text).cast("string").alias("text")).where("text is not null").groupBy("text_key").agg(F.first("text").alias("text"))
    texts = cut(texts.join(asked.hint("merge"), "text_key").select("set_key", "text"))

    def compared(tiles: DataFrame) -> DataFrame:
        rows = texts.join(broadcast_checked(tiles, MOST_SENT), "set_key").select("cluster", "i", "j", "probe", "set_key", "text")
        return cut(rows.groupBy("cluster", "i", "j").applyInPandas(_verify(n_words, sim), "a long, b long"))

    with_first = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.array(F.lit(0), F.col("block")))
    tiles = placed.select("cluster", "set_key", "block", F.explode(with_first).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    first = compared(tiles.select("cluster", "set_key", low.alias("i"), high.alias("j"), (F.col("block") == low).alias("probe")))
    large = placed.where("n_blocks > 1")
    if large.limit(1).count() == 0:
        return first
    label = components(first)
    state = cut(large.join(label, large["set_key"] == label["node"], "left").withColumn("component", F.coalesce("component", "set_key")).drop("node"))
    main = cut(state.groupBy("cluster", "component").agg(F.sum("size").alias("tokens")).groupBy("cluster").agg(F.max_by("component", F.struct("tokens", "component")).alias("main")))
    left = cut(state.join(main, "cluster").where("component != main").drop("main"))
    count = cut(left.groupBy("cluster").agg(blocks(F.sum("size")).alias("n_left")))
    probes = left.join(count, "cluster").select("cluster", "set_key", F.pmod(F.xxhash64("set_key"), F.col("n_left")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("j"), F.lit(True).alias("probe"))
    others = state.join(count, "cluster").select("cluster", "set_key", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("i"), F.col("block").alias("j"), F.lit(False).alias("probe"))
    return first.unionByName(compared(probes.unionByName(others)))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, component``: the smallest node that each node of ``a, b`` reaches; large-star and small-star rounds.

    Raises where ``most_rounds`` rounds do not reach an end. A node's least neighbour is a table of its own, so that
    the join with it can be split where one node has very many edges.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = None
    for _ in range(most_rounds):
        near = both(e)
        low = cut(near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        large = near.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a != b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            nodes = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
            return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = 5, sim: Similarity | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    sim = sim or Similarity()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = cut(classes(docs, "doc_id", "text", n_words))
    joined = cut(components(links(docs, held, "text", n_words, sim)))
    member = held.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    named = member.join(joined, member["set_key"] == joined["node"], "left").select("set_key", "least", F.coalesce("component", "set_key").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "component").select("set_key", "component_id")
    out = held.join(of_class, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are the smallest doc_id of their component, with all their columns.

    Rows of one doc_id stay or go together: they stay where one of them is in a component of which this is the smallest
    id. Documents without id stay.
    """
    got = jaccard_components(docs, doc_id, text, **options).groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    name = fresh("_gone", docs.columns)
    gone = cut(got.where("not stays").select(F.col("doc_id").alias(name)))
    return docs.join(broadcast_checked(gone, MOST_SENT), docs[doc_id] == F.col(name), "left_anti")
