"""Web archives (WARC 1.1) compressed record by record with a dictionary of their own.

Each task writes archives of at most ARCHIVE_BYTES of payload. When one is full, a Zstandard dictionary is
trained on records spread evenly over all of it and put in front, in a skippable frame (magic 0x184D2A5D);
then each record follows as one frame that needs this dictionary and can be read alone by its offset. An
archive with too few records to train on has no such frame and plain ones. The index, a Parquet table with
a row for each record, is committed by Spark: files of tasks that were lost or run twice aren't in it, and
readers open only files that are.

Of records with equal payloads the one with the largest page_id is a response, the others are revisits
that refer to it. Equal means equal SHA-256 and length; the digests are counted first, with partial sums,
and joined to the pages, and only responses carry their payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlab.llm.common import framed

MAGIC = 0x184D2A5D
#: Payload of an archive; records that a dictionary is trained on and its size, at most; zstd's level.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 32 << 20, 4 << 20, 64 << 10, 3
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, page_id long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def sha1_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _target(url: str | None) -> str:
    """A header can hold neither control characters nor spaces."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit where payload is None; a revisit keeps the response's HTTP headers, which tell its full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    fields = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), ("WARC-Target-URI", _target(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_digest(block)}")]
    if url is None:
        fields.append(("No-Target-URI", "1"))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], sample_bytes: int = SAMPLE_BYTES, size: int = DICTIONARY_BYTES):
    """A dictionary from records spread evenly over all of them, or None where they are too few."""
    import zstandard

    step = max(1, -(-sum(map(len, records)) // sample_bytes))
    some = records[::step]
    try:
        return zstandard.train_dictionary(max(256, min(size, sum(map(len, some)) // 10)), some, k=256, d=8)
    except zstandard.ZstdError:
        return None


def archived(records: list[bytes], level: int = LEVEL, **options: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes of an archive and (offset, length) of each record's frame."""
    import zstandard

    trained = dictionary(records, **options)
    out, at = [], 0
    if trained is not None:
        data = trained.as_bytes()
        out.append(struct.pack("<II", MAGIC, len(data)) + data)
        trained = zstandard.ZstdCompressionDict(data)  # as readers will make it
        trained.precompute_compress(level=level)
        at = len(out[0])
    own = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True)
    places = []
    for r in records:
        frame = own.compress(r)
        places.append((at, len(frame)))
        out.append(frame)
        at += len(frame)
    return b"".join(out), places


def _file_system(path: str):
    from pyarrow import fs

    local = re.sub(r"^file:/*", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def _dictionary_of(file) -> tuple[object, int]:
    """The archive's dictionary or None, and where the records begin."""
    import zstandard

    head = file.read(8)
    if len(head) < 8 or struct.unpack("<II", head)[0] != MAGIC:
        return None, 0
    size = struct.unpack("<II", head)[1]
    data = file.read(size)
    if data[:4] == b"\x28\xb5\x2f\xfd":  # dictionaries may be compressed themselves
        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 28)
    return zstandard.ZstdCompressionDict(data), 8 + size


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, names in lower case, and block of one record; ValueError where it isn't one."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not mark or not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:size]


def records_of(path: str) -> Iterator[bytes]:
    """All records of an archive, one at a time; a frame holds one record."""
    import zstandard

    system, at = _file_system(path)
    with system.open_input_file(at) as file:
        trained, start = _dictionary_of(file)
        file.seek(start)
        data = b""
        while True:
            decompress = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
            out, begun = [], False
            while not decompress.eof:
                data = data or file.read(1 << 20)
                if not data:
                    if begun:
                        raise ValueError(f"{path} ends within a record")
                    return
                begun = True
                out.append(decompress.decompress(data))
                data = decompress.unused_data if decompress.eof else b""
            yield b"".join(out)


def record_at(path: str, offset: int, length: int) -> bytes:
    """One record by its place in the index."""
    import zstandard

    system, at = _file_system(path)
    with system.open_input_file(at) as file:
        trained, _ = _dictionary_of(file)
        file.seek(offset)
        return zstandard.ZstdDecompressor(dict_data=trained).decompress(file.read(length))


def decided(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, size, sha1, record_type, refers_to); payload is null for revisits.

    Of records with equal payloads of at least least_bytes the one with the largest id is the response, and
    rows that repeat that id are responses, too. A null html is an empty payload. Rows without an id (or
    with one that is no whole number) revisit the response of their group; where no row of it has an id all are responses.
    """
    rows = pages.select(F.col(id_col).try_cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    shared = rows.where(F.col("size") >= least_bytes).groupBy("key", "size").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 AND top IS NOT NULL").drop("n")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    out = rows.join(shared, ["key", "size"], "left")
    return out.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", F.sha1("payload").alias("sha1"),
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("top")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, path: str, date: datetime = datetime(1970, 1, 1, tzinfo=UTC), archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL, **columns) -> DataFrame:
    """Writes pages as archives into path/archives, and path/index, (file, offset, length, page_id, record_type), which it returns.

    columns: those of decided(). Memory is that of one archive and one record.
    """
    spark = pages.sparkSession
    when, folder = date.strftime("%Y-%m-%dT%H:%M:%SZ"), f"{path.rstrip('/')}/archives"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = _file_system(folder)
        system.create_dir(at, recursive=True)

        def flushed(held: list) -> pd.DataFrame:
            name = f"{uuid.uuid4().hex}.warc.zst"
            data, places = archived([r for r, *_ in held], level)
            with system.open_output_stream(f"{at}/{name}", compression=None) as file:
                file.write(data)
            return framed([(f"{folder}/{name}", *place, page, kind) for place, (_, page, kind) in zip(places, held, strict=True)], ["file", "offset", "length", "page_id", "record_type"], ("offset", "length", "page_id"))

        held, size = [], 0
        for rows in batches:
            for page, url, payload, full, sha1, kind, to in rows.itertuples(index=False, name=None):
                page, to = (None if v is None else int(v) for v in (page, to))
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                held.append((record(page, url, payload, full, digest, to, when), page, kind))
                size += len(held[-1][0])
                if size >= archive_bytes:
                    yield flushed(held)
                    held, size = [], 0
        if held:
            yield flushed(held)

    rows = decided(pages, **columns)
    rows = rows.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    rows.mapInPandas(run, INDEX).write.parquet(f"{path.rstrip('/')}/index")
    return spark.read.schema(INDEX).parquet(f"{path.rstrip('/')}/index")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records in the archives of path.

    Digests are checked against the bytes read: a response whose payload doesn't have its digest raises
    ValueError. payload is null for revisits; payload_bytes and payload_digest are always the full payload's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        number = lambda v: None if v is None else int(v)
        for rows in batches:
            for file in rows["file"]:
                held, size = [], 0
                for data in records_of(file):
                    fields, block = parsed(data)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    full = int(re.search(rb"(?mi)^content-length: (\d+)", http)[1])
                    if kind == "response" and (len(payload) != full or sha1_digest(payload) != digest):
                        raise ValueError(f"{file}: {fields['warc-record-id']} isn't what was written")
                    url = None if "no-target-uri" in fields else fields["warc-target-uri"]
                    held.append((number(fields.get("page-id")), url, full, digest, kind, number(fields.get("refers-to-page-id")), payload if kind == "response" else None))
                    size += len(payload)
                    if size >= 4 << 20:
                        yield framed(held, names, ("page_id", "payload_bytes", "refers_to"))
                        held, size = [], 0
                if held:
                    yield framed(held, names, ("page_id", "payload_bytes", "refers_to"))

    files = spark.read.schema(INDEX).parquet(f"{path.rstrip('/')}/index").select("file").distinct()
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").mapInPandas(run, RECORD)
