"""WARC archives: write with an index first, read selected records by coalesced byte ranges.

Writing appends a gzip member for each record to archive files of bounded size and keeps, for every record, its file,
offset, length, url and digest; the index is a Parquet table beside the archives. Reading takes any selection of
index rows, sorts it by file and offset, joins neighbouring ranges to one read while the gap stays small, and parses
the records. Files are reached through pyarrow's file systems by URI, so the folder can be any shared store.

Of records with equal payloads of at least ``dedup_from`` bytes, those with the largest id are written as response;
the others become revisit records that refer to it and hold no payload. Payloads are compared by SHA-1 and length.

A file's name holds the partition and a fresh number, so a task that runs again writes a new file and only the
index rows of the attempt that counted point to it. A null payload counts as empty, a null url is written as an
empty target; a record without id is a response of its own. Very large payloads are one record each and end a file.
Every row is a record of its own: rows of one id with different payloads are judged by their payload, and rows with
equal payloads that share the largest id are all responses. Extra columns are ignored; an empty table gives an empty
index and no file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.shared import cut, work_path

#: An archive file ends at the first record beyond so many bytes.
FILE_BYTES = 64 << 20
#: Ranges of one file with at most so many bytes between them are read at once, and no read is much longer than MOST.
GAP, MOST = 64 << 10, 8 << 20

INDEX = "file string, offset long, length long, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(page_id: int, url: str, kind: str, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, compressed as a gzip member."""
    body = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html;charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress(("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n", compresslevel=1, mtime=0)


def _line(url: str) -> str:
    """A header value has no line ends; they are percent-encoded, and nothing else is."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the body of a record; a body that is not as long as said raises."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError("a record's body is not as long as its header says")
    return fields, rest[:n]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", dedup_from: int = 0) -> DataFrame:
    """Write ``pages`` as archives into ``folder`` and return the stored index."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.col(html).cast("string").alias("html"))
    source = source.withColumn("sha1", F.sha1(payload)).withColumn("n", F.length(payload))
    # digests first, without payloads: the groups of equal payloads are found on a few bytes a page
    small = source.select("page_id", "sha1", "n").where(F.col("n") >= dedup_from)
    lead = small.groupBy("sha1", "n").agg(F.max("page_id").alias("lead"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisits = cut(small.join(lead, ["sha1", "n"]).where("page_id != lead").select("page_id", "sha1", "n", "lead").distinct())
    rows = source.join(revisits, ["page_id", "sha1", "n"], "left").select("page_id", "url", "html", "lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                got = []
                for row in batch.to_pylist():
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(top, recursive=True)
                        out = store.open_output_stream(f"{top}/{name}", compression=None)
                    body = (row["html"] or "").encode("utf-8", "surrogatepass")
                    kind, sha1 = ("response" if row["lead"] is None else "revisit"), digest(body)
                    member = record(row["page_id"], row["url"], kind, body, sha1, row["lead"])
                    out.write(member)
                    got.append((name, at, len(member), row["page_id"], row["url"], kind, sha1, len(body), row["lead"]))
                    at += len(member)
                    if at >= FILE_BYTES:
                        out.close()
                        out = None
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), _TYPES, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


_TYPES = [{"string": pa.string(), "long": pa.int64()}[c.split()[1]] for c in INDEX.split(", ")]


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def ranges(wanted: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> Iterator[list[tuple[int, int]]]:
    """Sorted (offset, length) in groups that are read at once."""
    group: list[tuple[int, int]] = []
    for offset, length in wanted:
        if group and (offset - sum(group[-1]) > gap or offset + length - group[0][0] > most):
            yield group
            group = []
        group.append((offset, length))
    if group:
        yield group


RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The selected index rows' records, parsed from the archives. A revisit has no payload of its own.

    Each record's target and digest are held against the index, and a response's payload against its digest.
    """
    n = max(1, index.rdd.getNumPartitions())
    rows = index.select("file", "offset", "length", "url", "payload_digest").repartition(n, "file").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        for batch in batches:
            held = batch.to_pylist()
            a = 0
            while a < len(held):
                b = a
                while b < len(held) and held[b]["file"] == held[a]["file"]:
                    b += 1
                with store.open_input_file(f"{top}/{held[a]['file']}") as f:
                    k = a
                    for group in ranges([(x["offset"], x["length"]) for x in held[a:b]]):
                        start = group[0][0]
                        block = f.read_at(sum(group[-1]) - start, start)
                        got = []
                        for offset, length in group:
                            fields, body = parse(block[offset - start : offset - start + length])
                            sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            if sha1 != held[k]["payload_digest"] or fields["WARC-Target-URI"] != _line(held[k]["url"]):
                                raise ValueError("the index does not fit the archive")
                            kind = fields["WARC-Type"]
                            if kind == "response" and digest(body) != sha1:
                                raise ValueError("a payload does not fit its digest")
                            refers = fields.get("WARC-Refers-To")
                            got.append((_page(fields["WARC-Record-ID"]), held[k]["url"], kind, sha1, int(fields["X-Payload-Length"]), _page(refers) if refers else None, body if payloads else None))
                            k += 1
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*got, strict=True), [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=[c.split()[0] for c in RECORD.split(", ")])
                a = b

    return rows.mapInArrow(run, RECORD)


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "None" else int(name)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all pages, read all records back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = work_path(pages.sparkSession, "warc")
    index = write(pages, folder, **options)
    return read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
