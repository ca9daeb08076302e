"""WARC archives: records compressed one by one with a Zstandard dictionary of their own kind.

1. *Digests.* Payloads get their SHA-1. Of equal payloads the one with the largest
   key is a ``response``; the others are ``revisit`` records, which refer to it and
   carry no payload. Only (key, digest, size) is aggregated; the table of repeated
   payloads is broadcast when small, else a sort-merge join that can split hot digests.
2. *Dictionary.* A Zstandard dictionary is trained on at most ``SAMPLE`` distinct
   payloads of ``SAMPLE_BYTES`` or less (the smallest digests, a random choice), as the
   records that hold them. All records are compressed with it, wherever they come from.
3. *Archives.* Each task writes files of about ``FILE_BYTES``: a leading skippable
   frame (0x184D2A5D) that holds the dictionary, then one Zstandard frame a record, so
   any record can be read by its offset alone. A file's name is never used twice;
   which files count is committed with the index, a Parquet table of ``(key, file, offset,
   length)``, so the files of lost or repeated tasks are never read.
4. *Reading.* A task opens a file, takes the dictionary out of its leading frame and
   walks through its frames. Sizes and digests of responses come from the payload
   read, those of revisits from their headers.

Defined results: a null payload is empty (and takes part like any other); a null
URL gives a record without a target; rows that repeat a key are records of their own,
and those that repeat key and payload of a response are responses, too; a null key is
smaller than any other and reads back as null. With too few records to train on, the archives have no
dictionary frame. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.common import broadcast_if, prepare
from tandem.llm.token_scan import open_store
from tandem.session import cut_lineage

SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL, FILE_BYTES = 1000, 32768, 65536, 3, 64 << 20
DUPLICATES = 200_000           # repeated payloads that may be broadcast
BATCH = 64                     # records a reader hands on at once
SKIPPABLE, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"  # fixed values of the format
KEYED, KEYLESS = 0x7461_6E64_656D_8000, 0x7461_6E64_656D_8001  # upper halves of record ids
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "1970-01-01T00:00:00Z"


def record_id(key: int | None, digest: bytes) -> str:
    high, low = (KEYED, key & (1 << 64) - 1) if key is not None else (KEYLESS, int.from_bytes(digest[:8], "big"))
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def key_of(name: str | None) -> int | None:
    """The key in a record id."""
    if name is None:
        return None
    n = uuid.UUID(name.strip("<>")[9:]).int
    low = n & (1 << 64) - 1
    return None if n >> 64 != KEYED else low - (1 << 64) if low >> 63 else low


def _target(url: str) -> str:
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def record(key: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: str | None, date: str = RECORD_DATE) -> bytes:
    """One WARC record of a page; a revisit keeps the HTTP head and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_target(url)}"] if url is not None else []
    head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT}"] if refers_to else []
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame: the dictionary, compressed."""
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def _pages(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload")).withColumn(
        "digest", F.unhex(F.sha1("payload")))


def train(rows: DataFrame, groups: DataFrame) -> bytes:
    """A dictionary of the bounded sample, empty when that is too small."""
    chosen = groups.where(F.col("size").between(1, SAMPLE_BYTES)).orderBy("digest").limit(SAMPLE).select("digest", F.col("kept").alias("key"))
    found = rows.join(F.broadcast(chosen), (rows["digest"] == chosen["digest"]) & rows["key"].eqNullSafe(chosen["key"])).select(
        rows["key"], "url", "payload", rows["digest"])
    texts = [record(r["key"], r["url"], bytes(r["payload"]), bytes(r["digest"]), None)
             for r in found.dropDuplicates(["digest"]).orderBy("digest").collect()]  # SAMPLE rows of SAMPLE_BYTES at most
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes() if texts else b""
    except zstandard.ZstdError:  # the library can't make one of so little
        return b""


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record of each page to archives in ``path``, and their index to ``path``/index.

    Payloads of at least ``min_bytes`` are kept once; smaller ones are all responses.
    """
    spark = pages.sparkSession
    prepare(spark)
    rows = _pages(pages, key, url, payload)
    groups = cut_lineage(rows.select("key", "digest", F.octet_length("payload").alias("size")).groupBy("digest").agg(
        F.max("key").alias("kept"), F.max("size").alias("size"), F.count("*").alias("n")), "digests")
    dictionary = train(rows, groups)
    repeated = cut_lineage(groups.where((F.col("n") > 1) & (F.col("size") >= min_bytes)).select(
        F.col("digest").alias("same"), "kept", F.lit(True).alias("repeats")), "repeated")
    joined = rows.join(broadcast_if(repeated, DUPLICATES), F.col("digest") == F.col("same"), "left")
    revisit = F.coalesce(F.col("repeats"), F.lit(False)) & ~F.col("key").eqNullSafe(F.col("kept"))
    planned = joined.select("key", "url", "payload", "digest", F.when(revisit, F.col("kept")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)
        store.create_dir(folder)
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **(
            {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
        lead = dictionary_frame(dictionary) if dictionary else b""
        out, name, at = None, "", 0
        try:
            for b in batches:
                files, starts, sizes = [], [], []
                for k, u, body, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is not None and at >= len(lead) + file_bytes:
                        out.close()
                        out = None
                    if out is None:
                        name, at = f"pages-{uuid.uuid4().hex}.warc.zst", len(lead)
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)  # the name ends in .zst
                        out.write(lead)
                    frame = packer.compress(record(k, u, body, digest, record_id(refers, digest) if refers is not None else None))
                    out.write(frame)
                    files.append(name)
                    starts.append(at)
                    sizes.append(len(frame))
                    at += len(frame)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                                                 names=["key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    planned.mapInArrow(run, "key long, file string, offset long, length long").write.mode("overwrite").parquet(f"{path}/index")


def frames(stream) -> Iterator[bytes]:
    """The decompressed records of an archive, frame by frame; the dictionary comes from its leading frame."""
    head = stream.read(8)
    dictionary, rest = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        body = stream.read(struct.unpack("<I", head[4:])[0])
        if body[:4] == ZSTD_MAGIC:
            body = zstandard.ZstdDecompressor().decompress(body)
        dictionary, rest = zstandard.ZstdCompressionDict(body), b""
    reader = zstandard.ZstdDecompressor(**({"dict_data": dictionary} if dictionary else {}))
    while True:
        rest = rest or stream.read(1 << 20)
        if not rest:
            return
        frame, out = reader.decompressobj(), io.BytesIO()
        while True:
            out.write(frame.decompress(rest))
            rest = frame.unused_data
            if frame.eof:
                break
            rest = stream.read(1 << 20)
            if not rest:
                raise ValueError("an archive ends inside a record")
        yield out.getvalue()


def _headers(text: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in text.decode().split("\r\n")[1:])}


def parse(text: bytes) -> tuple:
    """(key, record type, url, payload or None, payload bytes, payload digest, refers to) of a record; a response's digest is that of the payload read."""
    head, _, rest = text.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    response = warc["warc-type"] == "response"
    size = len(payload) if response else int(_headers(http)["content-length"])
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of {warc['warc-record-id']} isn't what was archived")
    return (key_of(warc["warc-record-id"]), warc["warc-type"], warc.get("warc-target-uri"), payload if response else None, size, digest,
            key_of(warc.get("warc-refers-to")))


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """``(page_id, record_type, url, payload, payload_bytes, payload_digest, refers_to)`` of every record; ``payload`` false leaves it out."""
    prepare(spark)
    files = spark.read.parquet(f"{path}/index").groupBy("file").count()
    n = files.count()
    kinds = [("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload", pa.binary()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)

        def give(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            if not payload:
                cols[3] = (None,) * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[k for k, _ in kinds])

        for b in batches:
            for name, expected in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, seen = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for text in frames(stream):
                        rows.append(parse(text))
                        seen += 1
                        if len(rows) == BATCH:
                            yield give(rows)
                            rows = []
                if seen != expected:
                    raise ValueError(f"{name} holds {seen} records, its index {expected}")
                if rows:
                    yield give(rows)

    return files.repartition(max(1, n)).mapInArrow(
        run, "page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def read_record(path: str, file: str, offset: int, length: int) -> tuple:
    """One record by its place in the index."""
    store, folder = open_store(path)
    with store.open_input_file(f"{folder}/{file}") as f:
        lead = f.read(8)
        held = f.read(struct.unpack("<I", lead[4:])[0]) if struct.unpack("<I", lead[:4])[0] == SKIPPABLE else b""
        f.seek(offset)
        whole = io.BytesIO((lead + held if held else b"") + f.read(length))
    return parse(next(frames(whole)))
