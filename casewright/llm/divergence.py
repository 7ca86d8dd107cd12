"""Source divergence audit: how far the sources of a language lie from each other and from the language as a whole.

Term counts become shares ``p = 1 + floor(1e9 * (count + 5) / (N + 5 * V))`` over the V kept terms of a language, and two
groups (language, source) differ by the sum of ``abs(p - q)`` over them. The pairs are computed by two-dimensional tiling:
the groups of a language are dealt by hash into group blocks and its vocabulary into chunks; each group's counts of a
chunk are packed into one blob, which is replicated to the tiles (block, block) that its block takes part in; a tile goes
through successive chunks with the submatrix of its pairs, and tiles of one pair of blocks over different spans of chunks
are summed. So a task holds two blocks of one chunk, however many groups or terms there are, and no two groups are joined
as rows.

Null text, lang and source count as ''. A document without terms still makes its group occur. Repeated rows count as
documents of their own. Columns other than these three are never read, whatever their names. Without rows there is no
result; a language without kept terms has pairs of value 0 and no terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.llm.packing import lean, pack, unpack
from casewright.llm.shared import partitions, work_path

#: ASCII letters in lower case and every byte of other characters: on lowered UTF-8 the same runs as on code points.
TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE, PRIOR = 1_000_000_000, 5
#: Parts counted in one task before they are sent on.
FLUSH = 1_000_000
#: Rows of a batch that leaves a task, so that the JVM never holds a large one outside its heap.
SENT_ROWS = 20_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: of a group's term occurrences (its source given), of a language's documents with a term (source null)."""
    with lean():
        uses: dict[tuple[bytes, bytes], Counter] = {}
        docs: dict[bytes, Counter] = {}
        held = 0
        for batch in batches:
            for t, g, s in zip(*(batch.column(k) for k in range(3)), strict=True):
                key = g.as_py().encode(), s.as_py().encode()
                # bytes.lower leaves everything but A-Z alone
                found = TERM.findall(t.as_py().encode().lower())
                mine, all_ = uses.setdefault(key, Counter()), docs.setdefault(key[0], Counter())
                held += 1 - len(mine) - len(all_)
                mine.update(found)
                all_.update(set(found))
                held += len(mine) + len(all_)
                if held > FLUSH:
                    yield from _parts(uses, docs)
                    uses, docs, held = {}, {}, 0
        yield from _parts(uses, docs)


def _parts(uses: dict, docs: dict) -> Iterator[pa.RecordBatch]:
    """One row a counter's entry; a group's first row has a null term, so that a group without terms occurs too."""
    lang, source, term, n = [], [], [], []
    for (g, s), terms in [*uses.items(), *(((g, None), c) for g, c in docs.items())]:
        first = [] if s is None else [None]
        lang += [g] * (len(first) + len(terms))
        source += [s] * (len(first) + len(terms))
        term += first + list(terms)
        n += [0] * len(first) + list(terms.values())
    text = [pa.array(c, pa.binary()).cast(pa.string()) for c in (lang, source, term)]
    whole = pa.RecordBatch.from_arrays([*text, pa.array(n, pa.int64())], names=["lang", "source", "term", "n"])
    for at in range(0, whole.num_rows, SENT_ROWS):
        yield whole.slice(at, SENT_ROWS)


def share(count: str, total: str, v: str):
    """The share as an exact expression: decimals of 38 digits, divided to a whole number."""
    return F.expr(f"1 + ((cast({count} as decimal(18,0)) + {PRIOR}) * cast({SCALE} as decimal(10,0))) div (cast({total} as decimal(18,0)) + {PRIOR} * cast({v} as decimal(17,0)))")


def shares(counts: np.ndarray, total: int, v: int) -> np.ndarray:
    """The same in numpy: long division in base 1000, so that no step leaves 64 bits while N + 5 V is below 9e15."""
    whole = total + PRIOR * v
    if whole >= 9_000_000_000_000_000:
        raise ValueError(f"a group of {total} term occurrences is beyond exact 64-bit division")
    rest, out = counts.astype(np.int64) + PRIOR, np.zeros(len(counts), np.int64)
    out += (rest // whole) * SCALE
    rest %= whole
    digits = np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + rest // whole
        rest %= whole
    return 1 + out + digits


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n``: occurrences by group (a null term with 0 for each group); where source is null, documents by language."""
    got = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return got.mapInArrow(_count, "lang string, source string, term string, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, least_docs: int = 30, top_terms: int = 50, block: int = 64, chunk: int = 16_384, span: int = 64) -> DataFrame:
    """``lang, source, part, item, value, rank`` for both parts.

    block: groups of a group block. chunk: terms of a vocabulary chunk. span: chunks that one tile goes through.
    """
    spark = docs.sparkSession
    path = work_path(spark, "divergence")
    term_counts(docs).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    groups = counts.where("source is not null and term is null").select("lang", "source")
    kept = counts.where("source is null").where(F.col("n") >= least_docs).select("lang", "term")
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left").fillna(0, ["v"])
    sizes = sizes.withColumn("n_blocks", F.ceil(F.col("n_groups") / block)).withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.col("v") / chunk)))
    sizes.write.parquet(f"{path}/sizes")
    sizes = spark.read.parquet(f"{path}/sizes")
    # hashed chunks and blocks: about equal sizes without a global numbering; a place in a chunk is a rank among its terms
    place = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    dealt = kept.join(sizes.select("lang", "n_chunks"), "lang").select("lang", "term", F.pmod(F.xxhash64("term"), "n_chunks").alias("chunk")).withColumn("place", place)
    dealt.write.parquet(f"{path}/kept")
    dealt = spark.read.parquet(f"{path}/kept")
    used = counts.where("source is not null and term is not null").join(dealt, ["lang", "term"])
    used.write.parquet(f"{path}/used")
    used = spark.read.parquet(f"{path}/used")
    totals = groups.join(used.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0, ["total"])
    totals = totals.join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "n_blocks"))
    return _pairs(used, dealt, totals, span).unionByName(_terms(used, totals, top_terms))


def _terms(used: DataFrame, totals: DataFrame, most: int) -> DataFrame:
    """The terms that a group uses more than its language, by how much."""
    of_lang = used.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    whole = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    got = used.select("lang", "source", "term", "n").where("n > 0").join(of_lang, ["lang", "term"]).join(totals.select("lang", "source", "total", "v"), ["lang", "source"]).join(whole, "lang")
    got = got.withColumn("value", (share("n", "total", "v") - share("lang_n", "lang_total", "v")).cast("long")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    got = got.withColumn("rank", rank.cast("int")).where(F.col("rank") <= most)
    return got.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


#: side 0: first block of the tile, 1: second, 2: both. chunk -1 opens a tile with its groups.
TILE = "lang string, first long, second long, span long, chunk long, side int, source string, width long, blob binary"


def _pack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with lean():
        for batch in batches:
            cols = batch.to_pydict()
            blobs = [pack(np.asarray(p, np.int32), np.asarray(n, np.int64)) for p, n in zip(cols.pop("places"), cols.pop("ns"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(cols))), pa.array(blobs, pa.binary())], names=[*cols, "blob"])


def _pairs(used: DataFrame, dealt: DataFrame, totals: DataFrame, span: int) -> DataFrame:
    widths = dealt.groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("width"))
    vectors = used.groupBy("lang", "source", "chunk").agg(F.collect_list("place").alias("places"), F.collect_list("n").alias("ns"))
    vectors = vectors.select("lang", "source", "chunk", "places", "ns").mapInArrow(_pack_counts, "lang string, source string, chunk long, blob binary")
    vectors = vectors.join(widths, ["lang", "chunk"]).join(totals.select("lang", "source", "block", "n_blocks"), ["lang", "source"]).withColumn("span", F.floor(F.col("chunk") / span))
    # a span's groups come first, with the width that its chunks have together and what their shares need
    spans = widths.groupBy("lang", F.floor(F.col("chunk") / span).alias("span")).agg(F.sum("width").alias("width"))
    heads = totals.join(spans, "lang", "left").select("lang", "source", F.lit(-1).cast("long").alias("chunk"), F.encode(F.concat_ws(",", F.col("total").cast("string"), F.col("v").cast("string")), "UTF-8").alias("blob"), F.coalesce("width", F.lit(0)).alias("width"), "block", "n_blocks", F.coalesce("span", F.lit(0)).alias("span"))
    sent = vectors.select(heads.columns).unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    tiles = sent.select("lang", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "span", "chunk", side.alias("side"), "source", "width", "blob")
    tiles = tiles.repartition(partitions(used), "lang", "first", "second", "span").sortWithinPartitions("lang", "first", "second", "span", "chunk", "source")
    found = tiles.mapInArrow(_submatrices, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.cast("int").alias("rank"))


class _Tile:
    """The pairs of two group blocks over the chunks of a span."""

    def __init__(self) -> None:
        self.sides: list[list[tuple[str, int, int]]] = [[], []]
        self.same, self.left, self.chunk, self.rows = False, 0, None, []
        self.sums: np.ndarray | None = None

    def head(self, side: int, source: str, width: int, blob: bytes) -> None:
        total, v = map(int, blob.decode().split(","))
        self.left, self.same = width, side == 2
        for k in (0, 1) if side == 2 else (side,):
            self.sides[k].append((source, total, v))

    def _sums(self) -> np.ndarray:
        if self.sums is None:
            self.sums = np.zeros((len(self.sides[0]), len(self.sides[1])), np.int64)
            self.at = [{s[0]: i for i, s in enumerate(side)} for side in self.sides]
            self.none = [np.array([shares(np.zeros(1, np.int64), t, v)[0] if v else 0 for _, t, v in side], np.int64) for side in self.sides]
        return self.sums

    def close_chunk(self) -> None:
        """Adds the chunk whose rows are held."""
        if not self.rows:
            return
        sums, width = self._sums(), self.rows[0][2]
        dense = [np.repeat(none[:, None], width, axis=1) for none in (self.none if not self.same else self.none[:1])]
        for side, source, _, blob in self.rows:
            place, n = unpack(blob)
            k = 0 if side == 2 else side
            i = self.at[k][source]
            dense[k][i, place] = shares(n, *self.sides[k][i][1:])
        for i, p in enumerate(dense[0]):
            sums[i] += np.abs(dense[-1] - p).sum(axis=1)
        self.left -= width
        self.rows = []

    def pairs(self) -> tuple[list[str], list[str], list[int]]:
        self.close_chunk()
        # chunks in which neither block has a term
        sums = self._sums() + self.left * np.abs(self.none[0][:, None] - self.none[1][None, :])
        a, b = [s[0] for s in self.sides[0]], [s[0] for s in self.sides[1]]
        i, j = np.nonzero(~np.eye(len(a), dtype=bool)) if self.same else (x.reshape(-1) for x in np.indices(sums.shape))
        left, right, value = [a[x] for x in i], [b[x] for x in j], sums[i, j].tolist()
        return (left, right, value) if self.same else (left + right, right + left, value + value)


def _submatrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(key: tuple, tile: _Tile) -> pa.RecordBatch:
        left, right, value = tile.pairs()
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(left), pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])

    with lean():
        key, tile = None, None
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(batch.num_columns)), strict=True):
                lang, first, second, span, chunk, side, source, width, blob = (c.as_py() for c in row)
                if (now := (lang, first, second, span)) != key:
                    if tile is not None:
                        yield out(key, tile)
                    key, tile = now, _Tile()
                if chunk == -1:
                    tile.head(side, source, width, blob)
                    continue
                if chunk != tile.chunk:
                    tile.close_chunk()
                    tile.chunk = chunk
                tile.rows.append((side, source, width, blob))
        if tile is not None:
            yield out(key, tile)
