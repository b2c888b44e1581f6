"""Write pages as WARC archives and read archives back, a chunk at a time.

Between tables and files a payload is a run of rows ``(record, chunk_no, data)`` of bounded size.
The writer sees the chunks of a record one after the other: it opens a gzip member, writes the
header, passes the chunks through and carries a running SHA-256, which must agree with the digest
in the header when the last chunk has passed. The reader makes chunk rows again, each with the
digest of the record up to there, through a fixed buffer; what is known of a record (its bytes, its
digest, whether it is intact) is put together from its chunk rows. Neither ever holds a whole
record.

Records with equal payloads of at least ``LEAST_SHARED`` bytes are stored once: the one with the
smallest ``page_id`` is the response, the others are revisits that refer to it. This is decided on
``(page_id, digest, length)`` rows; only rows of shared payloads are joined back.

Files are opened through ``pyarrow.fs`` in the shared folder. A task writes files of names that no
other attempt uses, and only the files listed in the manifest count, so a lost executor costs a
rerun of its tasks and nothing else.

Edge cases: a null payload is empty; a null ``page_id`` is written as ``null`` and read back as
null, and is a revisit wherever another record has the payload and an id; rows equal in
``page_id`` and payload are records of their own, and all of them are responses if their id is
the smallest; an address that is null or empty becomes ``urn:page:<page_id>``; line ends in an address are
percent-encoded; an empty table writes no file; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwise.session import scratch_path, via_table

CHUNK = 1 << 20
LEAST_SHARED = 100
ROLL_AT = 128 << 20         # compressed bytes after which a task begins another file
BUFFER = 1 << 18
LEVEL = 5                   # of gzip
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "path string, page_id long, record_type string, offset long, stored long"
CHUNKS = ("path string, record long, page_id string, url string, record_type string, refers_to string, told_bytes long, "
          "told_digest string, chunk_no long, chunk_bytes long, data binary, digest_so_far string")
ROWS = 1024                 # chunk rows handed on together, and at most about a chunk of bytes


def _store(uri: str):
    """File system and path of a folder named the way Spark names it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def payload_roles(pages: DataFrame) -> DataFrame:
    """``page_id, digest, first``: the rows whose payload others have as well, and the smallest id."""
    light = via_table(pages.select("page_id", "digest", "length").where(F.col("length") >= LEAST_SHARED), "warc-digests")
    shared = (light.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
              .where("n > 1").drop("n"))
    roles = light.select("page_id", "digest").distinct().join(shared, "digest").where(
        F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    return via_table(roles, "warc-roles")


def chunk_rows(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table: the columns of a record once per chunk, with its bytes.

    ``payload`` is replaced by ``chunk_no``, ``chunks`` and ``data``; an empty payload has one
    empty chunk. The chunks of a record are adjacent and in order.
    """
    pieces = F.greatest(F.lit(1), F.ceil(F.length("payload") / chunk)).cast("int")
    numbered = pages.withColumn("chunks", pieces).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return numbered.withColumn(
        "data", F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk))).drop("payload")


class _Archive:
    """One file being written: a gzip member for each record."""

    def __init__(self, folder: str):
        self.files, base = _store(folder)
        self.files.create_dir(base, recursive=True)
        name = f"pages-{uuid.uuid4().hex}.warc.gz"
        self.path, self.at = f"{folder}/{name}", 0
        self.out = self.files.open_output_stream(f"{base}/{name}", compression=None)
        self.begin()
        self.put(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:" + str(uuid.uuid4()).encode()
                 + f">\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\n"
                   "format: WARC/1.1\r\n\r\n\r\n".encode())
        self.end()

    def begin(self) -> int:
        self.gzip = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        return self.at

    def put(self, data: bytes) -> None:
        packed = self.gzip.compress(data)
        self.out.write(packed)
        self.at += len(packed)

    def end(self) -> int:
        packed = self.gzip.flush()
        self.out.write(packed)
        self.at += len(packed)
        return self.at


def _urn(page_id) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def header(page_id, url: str | None, length: int, digest: str, first) -> bytes:
    """Record header and, for a response, the HTTP header that the payload follows."""
    where = (url or "").replace("\r", "%0D").replace("\n", "%0A") or _urn(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{_urn(page_id)}>",
             f"WARC-Target-URI: {where}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}",
             f"X-Payload-Length: {length}"]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{_urn(first)}>", "Content-Length: 0"]
        http = b""
    else:
        lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _id(text: str | None) -> int | None:
    return None if text is None or text != text else int(text)


def _writer(folder: str, roll_at: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, digest, start = None, None, 0
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                page, first = _id(row.page_id), _id(row.first)
                if row.chunk_no == 0:
                    if archive is not None and archive.at >= roll_at:
                        archive.out.close()
                        archive = None
                    archive = archive or _Archive(folder)
                    start, digest = archive.begin(), hashlib.sha256()
                    archive.put(header(page, row.url, row.length, row.digest, first))
                if first is None:
                    digest.update(row.data)
                    archive.put(bytes(row.data))
                if row.chunk_no == row.chunks - 1:
                    if first is None and digest.hexdigest() != row.digest:
                        raise ValueError(f"the chunks of page {page} do not add up to its digest")
                    archive.put(b"\r\n\r\n")
                    done.append((archive.path, row.page_id, "response" if first is None else "revisit", start,
                                 archive.end() - start))
            yield pd.DataFrame(done, columns=["path", "page_id", "record_type", "offset", "stored"])
        if archive is not None:
            archive.out.close()
    return run


def write_archives(pages: DataFrame, folder: str, payload: str = "html", chunk: int = CHUNK,
                   roll_at: int = ROLL_AT) -> DataFrame:
    """Writes ``page_id, url`` and the payload column to archives in ``folder``; returns the manifest.

    Manifest: ``path, page_id, record_type, offset, stored``, a row for each record.
    """
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    ready = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", raw.alias("payload"),
        F.sha2(raw, 256).alias("digest"), F.length(raw).cast("long").alias("length"))
    roles = payload_roles(ready)
    told = ready.alias("p").join(
        roles.alias("r"), (F.col("p.digest") == F.col("r.digest")) & F.col("p.page_id").eqNullSafe(F.col("r.page_id")), "left")
    told = told.select("p.*", F.col("r.first").cast("string").alias("first"))
    # ids travel as text: a column of numbers with a null would lose its last digits in pandas
    rows = chunk_rows(told.withColumn("payload", F.when(F.col("first").isNull(), F.col("payload")).otherwise(F.lit(b""))), chunk)
    rows = rows.withColumn("page_id", F.col("page_id").cast("string"))
    manifest = rows.mapInPandas(_writer(folder, roll_at), MANIFEST.replace("page_id long", "page_id string"))
    return via_table(manifest.withColumn("page_id", F.col("page_id").cast("long")), "warc-manifest")


class _Stream:
    """Decompressed bytes of one record at a time, through a fixed buffer."""

    def __init__(self, path: str):
        files, name = _store(path)
        self.source = files.open_input_stream(name, compression=None)
        self.packed, self.plain, self.gzip = b"", b"", None

    def more(self) -> bool:
        """Adds to ``plain``; false at the end of the member."""
        while True:
            if not self.packed:
                self.packed = self.source.read(BUFFER)
            if not self.packed:
                if self.gzip is not None:
                    raise ValueError("the archive ends within a record")
                return False
            if self.gzip is None:
                return False
            piece = self.gzip.decompress(self.packed, BUFFER)
            self.packed = self.gzip.unconsumed_tail or self.gzip.unused_data
            ended = self.gzip.eof
            if ended:
                self.gzip = None
            self.plain += piece
            if piece or ended:
                return bool(piece)

    def next_record(self) -> bool:
        while self.gzip is not None:
            self.plain = b""
            self.more()
        self.plain = b""
        if not self.packed:
            self.packed = self.source.read(BUFFER)
        if not self.packed:
            return False
        self.gzip = zlib.decompressobj(31)
        return True

    def upto(self, mark: bytes) -> bytes:
        while mark not in self.plain:
            if not self.more() and mark not in self.plain:
                raise ValueError("a header does not end")
        head, _, self.plain = self.plain.partition(mark)
        return head

    def take(self, most: int) -> bytes:
        if not self.plain:
            self.more()
        piece, self.plain = self.plain[:most], self.plain[most:]
        return piece


def records(path: str) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Header fields and payload pieces of every record of an archive, in order.

    The pieces must be used up before the next record is asked for.
    """
    stream = _Stream(path)
    while stream.next_record():
        lines = stream.upto(b"\r\n\r\n").decode().split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left = int(fields["content-length"])
        if fields.get("content-type", "").startswith("application/http") and left:
            left -= len(stream.upto(b"\r\n\r\n")) + 4

        def pieces(left: int = left) -> Iterator[bytes]:
            while left:
                piece = stream.take(min(left, BUFFER))
                if not piece:
                    raise ValueError("a record is shorter than its header says")
                left -= len(piece)
                yield piece

        yield fields, pieces()


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def _chunked(pieces: Iterator[bytes], chunk: int) -> Iterator[bytes]:
    """The same bytes in pieces of ``chunk``; an empty payload is one empty piece."""
    held, count = bytearray(), 0
    for piece in pieces:
        held += piece
        while len(held) >= chunk:
            yield bytes(held[:chunk])
            del held[:chunk]
            count += 1
    if held or not count:
        yield bytes(held)


def _read_chunks(chunk: int, with_data: bool):
    columns = [x.split()[0] for x in CHUNKS.split(", ") if with_data or not x.startswith("data ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows, size = [], 0
                for number, (fields, pieces) in enumerate(records(path)):
                    kind = fields["warc-type"]
                    digest = hashlib.sha256()
                    for count, data in enumerate(_chunked(pieces, chunk)):
                        if kind not in ("response", "revisit"):
                            continue
                        digest.update(data)
                        ids = [_page(fields["warc-record-id"]), _page(fields.get("warc-refers-to"))]
                        page, refers = (None if x is None else str(x) for x in ids)
                        row = (path, number, page, fields["warc-target-uri"], kind, refers, int(fields["x-payload-length"]),
                               fields["warc-payload-digest"].partition(":")[2], count, len(data), data, digest.hexdigest())
                        rows.append(row if with_data else (*row[:-2], row[-1]))
                        size += len(data) if with_data else 0
                        if len(rows) >= ROWS or size >= chunk:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)
    return run


def _archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    paths = manifest.select("path").distinct()
    return paths.repartition(max(1, paths.count()), "path")


def read_chunks(spark: SparkSession, manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The records of the archives named in the manifest as chunk rows.

    A row has what the header tells, the number and bytes of the chunk, ``data`` (unless it is not
    asked for) and ``digest_so_far``, the digest of the payload up to the end of the chunk.
    """
    kinds = ", ".join(x for x in CHUNKS.split(", ") if with_data or not x.startswith("data "))
    read = _archives(spark, manifest).mapInPandas(_read_chunks(chunk, with_data), kinds)
    return read.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def record_table(chunks: DataFrame) -> DataFrame:
    """One row per record, put together from its chunk rows.

    ``path, record, page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact``: of a
    response the bytes of its chunks and the digest after the last of them, and whether both are
    what the header tells; of a revisit, which has no payload, what the header tells.
    """
    last = chunks.groupBy("path", "record").agg(
        *[F.max(c).alias(c) for c in ("page_id", "url", "record_type", "refers_to", "told_bytes", "told_digest")],
        F.sum("chunk_bytes").alias("bytes"), F.max_by("digest_so_far", "chunk_no").alias("digest"))
    revisit = F.col("record_type") == "revisit"
    same = (F.col("bytes") == F.col("told_bytes")) & (F.col("digest") == F.col("told_digest"))
    return last.select(
        "path", "record", "page_id", "url", "record_type", "refers_to",
        F.when(revisit, F.col("told_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("told_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        (revisit | same).alias("intact"))


def read_records(spark: SparkSession, manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per record of the archives named in the manifest; payloads are only digested, chunk by chunk."""
    return record_table(read_chunks(spark, manifest, chunk, with_data=False))


def round_trip(spark: SparkSession, pages: DataFrame, chunk: int = CHUNK, roll_at: int = ROLL_AT) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads the records back, both as chunk rows."""
    manifest = write_archives(pages, scratch_path(spark, "warc"), chunk=chunk, roll_at=roll_at)
    return read_records(spark, manifest, chunk)
