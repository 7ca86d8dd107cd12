"""Exact top-k search by inner product through a pivot-distance index.

Vectors become whole numbers, floor(scale * x). With M the longest norm, a vector x gets the further component
sqrt(M^2 - |x|^2) and a query q the component 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the highest inner products are
the nearest neighbours and the triangle inequality holds.

Index: each distinct vector is keyed by its nearest pivot and the distance to it, sorted by that key, and cut into blocks,
each an annulus (pivot, least distance, greatest distance). A query at distance d of a pivot is at least max(0, d - greatest,
least - d) away from all of a block. It visits blocks in the order of that bound, in rounds that grow eightfold (the
annuli around its own distance first, then wider), and stops where the bound passes the distance of its k-th best; what is
kept is exact, ties included.

Work is dealt in cells: runs of blocks that are held by one task, through which batches of queries stream, so neither the
vectors nor the queries of a task grow with the data, and only (query, score, id) rows above a query's k-th best leave it.
The pivots are fitted on a bounded sample (``sample`` distinct vectors, by hash) with a few rounds of k-means; they decide
the cost, never the result. The directory of blocks is broadcast: blocks grow with the data so that there are at most
``most_blocks`` of them besides one for each pivot and partition.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id. Shorter vectors
count as padded with zeros. Each row is a candidate of all other rows, so repeated rows appear as often as they are there,
and a query that is there n times has its results n times. Scores that do not fit 62 bits raise an error. Columns other
than the two named are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.llm.packing import lean, pack, unpack
from casewright.llm.shared import partitions, work_path

CODES = [np.dtype(t) for t in ("<i1", "<i2", "<i4")]
#: The k-th best score of a query without k candidates so far.
NONE = np.iinfo(np.int64).min


def encode(v: np.ndarray) -> bytes:
    """The smallest whole-number type that holds the vector, without zeros at its end: equal vectors have equal codes."""
    at = np.flatnonzero(v)
    v = v[: at[-1] + 1] if len(at) else v[:0]
    low, high = (v.min(), v.max()) if len(v) else (0, 0)
    for k, kind in enumerate(CODES):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return bytes([k]) + v.astype(kind).tobytes()
    raise ValueError("a vector's component is too large for exact scores")


def decode(codes: list[bytes], width: int) -> np.ndarray:
    """A matrix of codes, padded with zeros."""
    if codes and len({(c[0], len(c)) for c in codes}) == 1:
        kind = CODES[codes[0][0]]
        rows = np.frombuffer(b"".join(c[1:] for c in codes), kind).reshape(len(codes), -1)
        if rows.shape[1] == width:
            return rows
    out = np.zeros((len(codes), width), np.int32)
    for i, c in enumerate(codes):
        v = np.frombuffer(c, CODES[c[0]], offset=1)
        out[i, : len(v)] = v
    return out


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``vec_id, code, norm2, top, width`` of each row that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            for batch in batches:
                ids, codes, norms, tops, widths = [], [], [], [], []
                lists = batch.column(1)
                ends, values, valid = lists.offsets.to_numpy(), lists.values, lists.is_valid().to_numpy(zero_copy_only=False)
                known = values.is_valid().to_numpy(zero_copy_only=False)
                flat = np.where(known, values.fill_null(0.0).to_numpy(zero_copy_only=False), np.nan)
                for i, key in enumerate(batch.column(0).to_pylist()):
                    v = flat[ends[i] : ends[i + 1]]
                    if not valid[i] or key is None or not np.isfinite(v).all():
                        continue
                    v = np.floor(scale * v)
                    code = encode(v)
                    ids.append(key)
                    codes.append(code)
                    whole = v.astype(np.int64)
                    norms.append(int(whole @ whole))
                    tops.append(float(np.abs(v).max()) if len(v) else 0.0)
                    widths.append((len(code) - 1) // CODES[code[0]].itemsize)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.binary()), pa.array(norms, pa.int64()), pa.array(tops, pa.float64()), pa.array(widths, pa.int32())], names=["vec_id", "code", "norm2", "top", "width"])

    taken = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return taken.mapInArrow(run, "vec_id long, code binary, norm2 long, top double, width int")


class Space:
    """What all tasks know: width, greatest square norm, number type of exact products, pivots."""

    def __init__(self, width: int, norm2: int, top: float, sample: list[bytes], pivots: int) -> None:
        self.width, self.norm2 = width, float(norm2)
        most = width * top * top
        if most >= 2**62:
            raise ValueError("inner products beyond 62 bits")
        self.kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        self.pivots = self._fit(self.lift(decode(sample, width)), pivots) if sample else np.zeros((1, width + 1))

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.c_[x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0.0))]

    @staticmethod
    def far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T), 0.0))

    def _fit(self, x: np.ndarray, pivots: int, rounds: int = 6) -> np.ndarray:
        centres = x[:pivots].copy()
        for _ in range(rounds):
            near = self.far(x, centres).argmin(1)
            for j in range(len(centres)):
                if (mine := near == j).any():
                    centres[j] = x[mine].mean(0)
        return centres

    def slack(self) -> float:
        """More than the rounding of any distance here: squares carry a relative error of some 1e-13."""
        return 1e-5 * (1.0 + self.norm2**0.5)

    def query_distances(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float64)
        return self.far(np.c_[q, np.zeros(len(q))], self.pivots)


def build_index(classes: DataFrame, space: Space, block: int, cell_blocks: int) -> DataFrame:
    """``cell, block, pivot, near, far, n, blob, codes``: blocks of vectors in the order of (pivot, distance), with their ids."""
    spark = classes.sparkSession
    held = spark.sparkContext.broadcast(space)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = held.value.lift(decode(batch.column(0).to_pylist(), held.value.width))
            far = held.value.far(x, held.value.pivots)
            pivot = far.argmin(1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(x)), pivot]), batch.column(0), batch.column(1)], names=["pivot", "far", "code", "ids"])

    def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, rows, pivot = TaskContext.get().partitionId(), 0, [], None

        def out() -> pa.RecordBatch:
            ids = [i for r in rows for i in r[2]]
            blob = pack(np.asarray(ids, np.int64), np.asarray([len(r[2]) for r in rows], np.int32))
            cols = [[(part << 32) + number // cell_blocks], [(part << 32) + number], [pivot], [rows[0][0]], [rows[-1][0]], [len(rows)], [blob], [[r[1] for r in rows]]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, BLOCK.types, strict=True)], names=BLOCK.names)

        with lean():
            for batch in batches:
                for p, far, code, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    if rows and (p != pivot or len(rows) == block):
                        yield out()
                        number, rows = number + 1, []
                    pivot = p
                    rows.append((far, code, ids))
            if rows:
                yield out()

    assigned = classes.mapInArrow(assign, "pivot int, far double, code binary, ids array<long>")
    # the code parts equal distances, so that one distance of very many vectors is not one partition
    order = ["pivot", "far", "code"]
    ranged = assigned.repartitionByRange(partitions(classes), *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(cut_blocks, "cell long, block long, pivot int, near double, far double, n int, blob binary, codes array<binary>")


BLOCK = pa.schema([("cell", pa.int64()), ("block", pa.int64()), ("pivot", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("n", pa.int32()), ("blob", pa.binary()), ("codes", pa.list_(pa.binary()))])
REQUEST = "cell long, batch long, blob binary, codes array<binary>"


def plan_visits(batches: DataFrame, space: Space, directory: dict[str, np.ndarray], low: int, high: int) -> DataFrame:
    """``cell, batch, blob, codes``: what each batch of queries asks of each cell in this round.

    batches: ``batch, codes, best`` (a query's k-th best score so far, null before it has k). A query asks for the blocks at
    places low to high of its bound order whose bound does not pass its k-th best. blob: for each asked (query, block)
    the query's place and the block's place in the directory; and each query's k-th best.
    """
    spark = batches.sparkSession
    held, sent = spark.sparkContext.broadcast(space), spark.sparkContext.broadcast(directory)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, d = held.value, sent.value
        n = len(d["pivot"])
        step = max(1, 2_000_000 // n)
        with lean():
            for part in parts:
                for batch, codes, best in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    q = decode(codes, space.width)
                    far, square = space.query_distances(q), (q.astype(np.float64) ** 2).sum(1)
                    floor_ = np.array([NONE if b is None else b for b in best], np.int64)
                    # the greatest distance that can still reach the k-th best score
                    reach = np.where(floor_ == NONE, np.inf, np.sqrt(np.maximum(square + space.norm2 - 2.0 * floor_, 0.0)) + space.slack())
                    rows, places = [], []
                    for at in range(0, len(q), step):
                        to = far[at : at + step][:, d["pivot"]]
                        bound = np.maximum(np.maximum(to - d["far"], d["near"] - to), 0.0)
                        order = np.argsort(bound, axis=1, kind="stable")[:, low:high]
                        r, c = np.nonzero(np.take_along_axis(bound, order, 1) <= reach[at : at + step, None])
                        rows.append(r + at)
                        places.append(order[r, c])
                    row, place = np.concatenate(rows), np.concatenate(places)
                    cells = d["cell"][place]
                    for cell in np.unique(cells):
                        mine = cells == cell
                        asked, at = np.unique(row[mine], return_inverse=True)
                        blob = pack(at.astype(np.int32), place[mine].astype(np.int32), asked.astype(np.int32), floor_[asked])
                        cols = [[cell], [batch], [blob], [[codes[i] for i in asked]]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())), strict=True)], names=["cell", "batch", "blob", "codes"])

    return batches.select("batch", "codes", "best").mapInArrow(run, REQUEST)


def best_rows(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores, rows))
    r = rows[order]
    first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0)) if len(r) else np.zeros(0, np.int64)
    return order[np.arange(len(r)) - start < k]


def _block_hits(x: np.ndarray, q: np.ndarray, floor_: np.ndarray, counts: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row, score, id) of the candidates of one block that reach a query's floor, each query's k best."""
    s = q @ x.T
    # exact in the number type of the scores
    keep = s >= floor_.astype(s.dtype)[:, None]
    many = np.flatnonzero(keep.sum(1) > k)
    if len(many):
        kth = np.partition(s[many], -k, axis=1)[:, -k]
        keep[many] &= s[many] >= kth[:, None]
    r, c = np.nonzero(keep)
    start = np.cumsum(counts) - counts
    n = counts[c]
    at = np.repeat(start[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    row, score, found = np.repeat(r, n), np.repeat(s[r, c].astype(np.int64), n), ids[at]
    best = best_rows(row, score, found, k)
    return row[best], score[best], found[best]


def visit(index: DataFrame, requests: DataFrame, space: Space, directory: dict[str, np.ndarray], k: int, tasks: int, salt: int) -> DataFrame:
    """``batch, q, score, vec_id``: the candidates of the asked blocks that reach a query's k-th best, at most k of a cell.

    A cell's blocks come first in its task, then the requests stream through; ``salt`` copies of a cell share its requests.
    """
    spark = index.sparkSession
    held, sent = spark.sparkContext.broadcast(space), spark.sparkContext.broadcast(directory["block"])
    wanted = index.join(requests.select("cell").distinct(), "cell", "left_semi")
    blocks = wanted.select("cell", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("salt"), "block", "blob", "codes")
    asks = requests.select("cell", F.pmod(F.xxhash64("batch"), F.lit(salt)).cast("int").alias("salt"), (-1 - F.col("batch")).alias("block"), "blob", "codes")
    # blocks have numbers from 0, requests negative ones: a falling order puts a cell's blocks first
    both = blocks.unionByName(asks).repartition(tasks, "cell", "salt").sortWithinPartitions("cell", "salt", F.desc("block"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, numbers = held.value, sent.value
        key, blocks = None, {}
        with lean(lambda: blocks.clear()):
            for part in parts:
                for cell, salt_, block, blob, codes in zip(*(part.column(i) for i in range(5)), strict=True):
                    if (now := (cell.as_py(), salt_.as_py())) != key:
                        key, blocks = now, {}
                    block = block.as_py()
                    if block >= 0:
                        ids, counts = unpack(blob.as_py())
                        blocks[block] = (decode(codes.as_py(), space.width), counts.astype(np.int64), ids)
                        continue
                    at, place, asked, floor_ = unpack(blob.as_py())
                    q = decode(codes.as_py(), space.width).astype(space.kind)
                    floor_ = floor_.copy()
                    row, score, found = (np.zeros(0, np.int64) for _ in range(3))
                    for p in np.unique(place):
                        x, counts, ids = blocks[int(numbers[p])]
                        mine = at[place == p]
                        r, s, i = _block_hits(x.astype(space.kind), q[mine], floor_[mine], counts, ids, k)
                        row, score, found = np.r_[row, mine[r]], np.r_[score, s], np.r_[found, i]
                        best = best_rows(row, score, found, k)
                        row, score, found = row[best], score[best], found[best]
                        last = np.flatnonzero(np.r_[row[1:] != row[:-1], True]) if len(row) else row
                        full = np.bincount(row, minlength=len(q))[row[last]] == k
                        floor_[row[last[full]]] = np.maximum(floor_[row[last[full]]], score[last[full]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), -1 - block, np.int64)), pa.array(asked[row].astype(np.int32)), pa.array(score), pa.array(found)], names=["batch", "q", "score", "vec_id"])

    return both.mapInArrow(run, "batch long, q int, score long, vec_id long")


def _query_batches(codes: DataFrame, space: Space, size: int) -> DataFrame:
    """``batch, codes``: distinct queries in batches of near ones, by their nearest pivot and the distance to it."""
    held = codes.sparkSession.sparkContext.broadcast(space)

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            far = held.value.query_distances(decode(part.column(0).to_pylist(), held.value.width))
            pivot = far.argmin(1) if len(far) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(far[np.arange(len(far)), pivot]), part.column(0)], names=["pivot", "far", "code"])

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held_ = TaskContext.get().partitionId() << 32, []
        for part in parts:
            held_ += part.column(2).to_pylist()
            while len(held_) >= size:
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([held_[:size]], pa.list_(pa.binary()))], names=["batch", "codes"])
                number, held_ = number + 1, held_[size:]
        if held_:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([held_], pa.list_(pa.binary()))], names=["batch", "codes"])

    order = ["pivot", "far", "code"]
    ranged = codes.mapInArrow(assign, "pivot int, far double, code binary").repartitionByRange(partitions(codes), *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(deal, "batch long, codes array<binary>")


def _directory(index: DataFrame) -> dict[str, np.ndarray]:
    rows = index.select("cell", "block", "pivot", "near", "far").orderBy("block").toPandas()
    return {c: rows[c].to_numpy() for c in rows.columns}


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, pivots: int = 64, sample: int = 8192, block: int = 4096, most_blocks: int = 200_000, batch: int = 1024, first: int = 2) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest scores of each query among all other rows.

    is_query: a condition on ``vec_id``. first: blocks of the first round.
    """
    spark = vectors.sparkSession
    path = work_path(spark, "pivotsearch")
    quantise(vectors, id_col, vector_col, scale).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    most = rows.agg(F.max("width").alias("width"), F.max("norm2").alias("norm2"), F.max("top").alias("top")).first()
    if most.width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # an own row may be among the best, so one more than k is looked for, and of equal vectors no more ids can count
    n = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    classes = rows.select("code", "vec_id").withColumn("n", n).where(F.col("n") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes.write.parquet(f"{path}/classes")
    classes = spark.read.parquet(f"{path}/classes")
    chosen = classes.select("code").orderBy(F.xxhash64("code"), "code").limit(sample).collect()
    space = Space(most.width, most.norm2, most.top, [bytes(r.code) for r in chosen], pivots)
    n_classes, tasks = classes.count(), partitions(classes)
    size = max(block, -(-n_classes // most_blocks))
    cell_blocks = max(1, min(256, n_classes // size // (4 * tasks)))
    build_index(classes, space, size, cell_blocks).write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    directory = _directory(index)

    asked = rows.where(is_query).groupBy("vec_id", "code", "norm2").agg(F.count(F.lit(1)).alias("copies"))
    _query_batches(asked.select("code").distinct(), space, batch).write.parquet(f"{path}/batches")
    batches = spark.read.parquet(f"{path}/batches")
    best = _rounds(spark, path, index, batches, space, directory, k + 1, tasks, first)

    hits = best.groupBy("batch", "q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("hits"))
    coded = batches.select("batch", F.posexplode("codes").alias("q", "code")).join(hits, ["batch", "q"])
    own = F.array_position(F.transform("hits", lambda h: (h["vec_id"] == F.col("query_id")) & (-h["s"] == F.col("norm2"))), F.lit(True))
    got = asked.withColumnRenamed("vec_id", "query_id").join(coded, "code").withColumn("own", own)
    others = F.slice(F.filter("hits", lambda h, i: i + 1 != F.col("own")), 1, k)
    got = got.select("query_id", F.explode(F.array_repeat(others, F.col("copies").cast("int"))).alias("hits"))
    return got.select("query_id", F.posexplode("hits").alias("at", "h")).select("query_id", (F.col("at") + 1).alias("rank"), "h.vec_id", (-F.col("h.s")).alias("score"))


def _rounds(spark: SparkSession, path: str, index: DataFrame, batches: DataFrame, space: Space, directory: dict[str, np.ndarray], k: int, tasks: int, first: int) -> DataFrame:
    """``batch, q, score, vec_id``: each query's k best of all blocks."""
    salt = max(1, -(-batches.count() // 512))
    low, high, best, k_best = 0, first, None, None
    while low < len(directory["block"]):
        if best is None:
            asking = batches.withColumn("best", F.array_repeat(F.lit(None).cast("long"), F.size("codes")))
        else:
            # a query without k candidates so far has no k-th best
            per = best.groupBy("batch", "q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") == k)
            k_best = per.groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("q", "s"))).alias("m"))
            asking = batches.join(k_best, "batch", "left").withColumn("best", F.transform(F.sequence(F.lit(0), F.size("codes") - 1), lambda i: F.get(F.map_values("m"), F.array_position(F.map_keys("m"), i).cast("int") - 1)))
        plan_visits(asking, space, directory, low, high).write.parquet(f"{path}/asks-{low}")
        requests = spark.read.parquet(f"{path}/asks-{low}")
        if requests.isEmpty():
            break
        found = visit(index, requests, space, directory, k, tasks, salt)
        if best is not None:
            found = best.unionByName(found)
        n = F.row_number().over(Window.partitionBy("batch", "q").orderBy(F.desc("score"), "vec_id"))
        found.withColumn("n", n).where(F.col("n") <= k).drop("n").write.parquet(f"{path}/best-{low}")
        best = spark.read.parquet(f"{path}/best-{low}")
        low, high = high, 8 * high
    return best if best is not None else spark.createDataFrame([], "batch long, q int, score long, vec_id long")
