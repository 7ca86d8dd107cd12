"""Numbers packed into compressed blobs, exchanged between tasks by a target partition.

Billions of small rows cost far more than their bytes when each is a Spark row; a blob holds all numbers that one
task sends to one target. Rows stay even, as every target gets at most a few blobs from each task.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame


@functools.cache
def _libc():
    """The C library, told once to map every array of 256 KB or more by itself, so that it can be given back."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 18)
        return libc
    return None


@contextlib.contextmanager
def lean(free: Callable[[], object] | None = None):
    """Python workers outlive their tasks; what a task has freed goes back to the machine when it ends.

    ``free`` is called first, to let go of what is kept between batches.
    """
    libc = _libc()
    try:
        yield
    finally:
        if free is not None:
            free()
        pa.default_memory_pool().release_unused()
        if libc is not None:
            libc.malloc_trim(0)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned or signed integers, byte planes apart so that small numbers cost little."""
    out = bytearray([len(arrays)])
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        kind = a.dtype.str.encode()
        out += bytes([len(kind)]) + kind + len(a).to_bytes(8, "little") + raw
    return zstandard.ZstdCompressor(level=1).compress(bytes(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1
    for _ in range(raw[0]):
        k = raw[at]
        kind = np.dtype(raw[at + 1 : at + 1 + k].decode())
        n = int.from_bytes(raw[at + 1 + k : at + 9 + k], "little")
        at += 9 + k
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def blobs(targets: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(targets, pa.int32()), pa.array(data, pa.binary())], names=["target", "blob"])


SENT = "target int, blob binary"


def exchange(sent: DataFrame, n: int, work: Callable[[list[list[np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` gets, in one task for each target from 0 to ``n - 1``, what all blobs for it hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            got = [unpack(b.as_py()) for batch in batches for b in batch.column(1)]
            if got:
                yield from work(got)

    return sent.repartitionById(n, sent["target"]).mapInArrow(run, schema)
