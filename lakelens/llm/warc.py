"""WARC archives of web pages, compressed record by record with a dictionary of their own (operator 11).

Each task writes one archive.  It builds a Zstandard dictionary from the first
records it holds, puts it into a skippable frame at the head of the file and then
compresses every record as a frame of its own, so that any record can be read by
itself.  Pages with equal payloads are stored once: one row is the ``response``,
the others are ``revisit`` records that refer to it.

Frames are rows of one column that Spark's text writer puts into files on any
Hadoop file system, with its commit protocol (a lost task leaves nothing behind).
What it writes after each row is an empty skippable frame, which readers of the
format pass over.

Payloads are shuffled once.  A group of equal payloads may hold any share of the
rows: groups are counted by digest and salt first, and the answer returns to the
rows by the same salted pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.llm.words import discard, kept_table
from lakelens.session import scratch_dir

#: Payload bytes of an archive (before compression), and the least for which another task is worth while.
ARCHIVE_BYTES, TASK_BYTES = 128 << 20, 4 << 20

#: Bytes of a dictionary, and of the records that one is built from.
DICTIONARY_BYTES, SAMPLE_BYTES = 32 << 10, 4 << 20

# Fixed values of the archive and compression formats.
DICTIONARY_MAGIC = bytes.fromhex("5d2a4d18")
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
ZSTD_MAGIC = bytes.fromhex("28b52ffd")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_SCHEMA = ("page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, "
               "archive string, offset long, length long")


def record_id(page_id: str | None, row: int) -> str:
    from urllib.parse import quote

    return f"urn:x-page:{'!' if page_id is None else quote(page_id, safe='')}:{row}"


def page_of(uri: str) -> str | None:
    """The page's id in a record's id (``<urn:x-page:ID:ROW>``)."""
    from urllib.parse import unquote

    page = uri.strip("<>").split(":")[2]
    return None if page == "!" else unquote(page)


def base32_sha1(data: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, row, url, payload: bytes, top_id, top_row, date: str) -> bytes:
    """One WARC record: a response with its payload, or (with ``top_row``) a revisit
    with the response's HTTP header only."""
    import string
    from urllib.parse import quote

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if top_row is not None else http + payload
    me = record_id(page_id, row)
    target = quote(url, safe=string.punctuation) if url else me
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if top_row is None else 'revisit'}", f"WARC-Record-ID: <{me}>",
        f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if top_row is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(top_id, top_row)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes], size: int):
    """A trained dictionary, or None where the records are too few or too short for one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, [r[: size * 8] for r in records], k=512, d=8, f=20, accel=1)
    except (zstandard.ZstdError, ValueError):
        return None


def frames_of(records: Iterator[bytes], *, level: int, dictionary_bytes: int, sample_bytes: int) -> Iterator[bytes]:
    """The archive's frames: the dictionary's skippable frame, then one frame a record.
    Holds ``sample_bytes`` of records and one more at most."""
    import zstandard

    first, held = [], 0
    for r in records:
        first.append(r)
        held += len(r)
        if held >= sample_bytes:
            break
    if not first:
        return
    words = dictionary_of(first, dictionary_bytes)
    if words:
        body = zstandard.ZstdCompressor(level=19).compress(words.as_bytes())
        yield DICTIONARY_MAGIC + len(body).to_bytes(4, "little") + body
    shrink = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=True).compress
    yield from map(shrink, first)
    del first
    yield from map(shrink, records)


def write_archives(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES, level: int = 3, dictionary_bytes: int = DICTIONARY_BYTES, sample_bytes: int = SAMPLE_BYTES,
    date: str = "2000-01-01T00:00:00Z",
) -> None:
    """Writes a record for every row of ``pages`` into archives below ``path`` (a folder
    that isn't there yet); each ``part-*`` file is a ``.warc.zst`` archive.

    Of rows with equal payloads (UTF-8 bytes; null counts as empty) of ``min_bytes`` or
    more, the one with the largest id is the response; shorter ones are all
    responses.  A null id is smaller than any other; of rows that agree in id and
    payload, repeated rows included, one is the response.  A null or empty URL is
    replaced by the record's id; white space, control characters and all others
    beyond ASCII are percent-encoded.  Very long payloads are whole records: a task needs memory
    for a few of its longest ones.  Records too few or too short to build a
    dictionary from make an archive without one.  An empty table makes no
    records.  Columns not named are not read.
    """
    spark = pages.sparkSession
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = kept_table(
        pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                     F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"),
                     F.monotonically_increasing_id().alias("row"))
        .withColumn("n_bytes", F.octet_length("payload").cast("long"))
        .withColumn("sha", F.when(F.col("n_bytes") >= min_bytes, F.unhex(F.sha2("payload", 256)))
                    .otherwise(F.encode(F.col("row").cast("string"), "UTF-8")))
        .withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")), "warc-rows")
    parts = rows.groupBy("sha", "salt").agg(F.max(F.struct("page_id", "row")).alias("top"))
    groups = parts.groupBy("sha").agg(F.max("top").alias("top"))
    answers = parts.select("sha", "salt").join(groups.hint("merge"), "sha")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first().b
    n = max(-(-total // archive_bytes), min(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES)), 1)
    shown = rows.repartition(n, "sha", "salt").join(answers.hint("merge"), ["sha", "salt"]).select(
        F.col("page_id").cast("string").alias("page_id"), "row", "url", "payload",
        F.when(F.col("row") != F.col("top.row"), F.col("top.page_id").cast("string")).alias("top_id"),
        F.when(F.col("row") != F.col("top.row"), F.col("top.row")).alias("top_row"))

    def written(batches):
        import pyarrow as pa

        records = (record(*(c[i].as_py() for c in b.columns), date) for b in batches for i in range(b.num_rows))
        held, size = [], 0
        for frame in frames_of(records, level=level, dictionary_bytes=dictionary_bytes, sample_bytes=sample_bytes):
            held.append(frame)
            size += len(frame)
            if size >= 4 << 20:
                yield pa.record_batch([pa.array(held, pa.binary())], ["frame"])
                held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(held, pa.binary())], ["frame"])

    frames = shown.mapInArrow(written, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)
    discard(rows)


def records_in(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each compressed record of an archive."""
    import zstandard

    view, at, words = memoryview(data), 0, None
    if data[:4] == DICTIONARY_MAGIC:
        size = int.from_bytes(data[4:8], "little")
        body, at = data[8 : 8 + size], 8 + size
        words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body) if body[:4] == ZSTD_MAGIC else body)
    opener = zstandard.ZstdDecompressor(dict_data=words)
    while at < len(data):
        head = data[at : at + 8]
        if 0x184D2A50 <= int.from_bytes(head[:4], "little") <= 0x184D2A5F:  # skippable
            at += 8 + int.from_bytes(head[4:], "little")
            continue
        one, out, start = opener.decompressobj(), [], at
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            out.append(one.decompress(view[at : at + 65536]))
            at += min(65536, len(data) - at) - len(one.unused_data)
        yield start, at - start, b"".join(out)


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a record's block is not of the length it states: {fields['warc-record-id']}")
    return fields, rest[:size]


def facts(content: bytes) -> tuple:
    """What ``read_archives`` returns of a record; digests are held against the bytes."""
    fields, block = parsed(content)
    me, kind, digest = fields["warc-record-id"], fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if base32_sha1(block) != fields["warc-block-digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest differs: {me}")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if kind == "response" and (len(payload) != stated or base32_sha1(payload) != digest):
        raise ValueError(f"payload digest differs: {me}")
    refers = fields.get("warc-refers-to")
    return page_of(me), fields["warc-target-uri"], kind, refers and page_of(refers), stated, digest


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives below ``path``: page_id and refers_to (as
    strings), url, record_type, payload_bytes and payload_digest (SHA-1 in base 32;
    both of the full payload, for revisits too), archive, offset and length (its frame).

    Responses are decompressed and held against their digests; a revisit states
    its payload's length and digest in its headers.  A damaged archive is an error.
    An archive is read whole by one task (``archive_bytes`` bounds it); a folder
    without records gives no rows.
    """
    def read(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        types = [pa.int64() if x.endswith(" long") else pa.string() for x in READ_SCHEMA.split(", ")]
        for batch in batches:
            for name, data in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                held = []
                for offset, length, content in records_in(data.as_py()):
                    held.append((*facts(content), name.as_py(), offset, length))
                    if len(held) == 8192:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                        held = []
                if held:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(read, READ_SCHEMA)


def archived(pages: DataFrame) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back: page_id, payload_bytes,
    payload_digest, record_type, refers_to.  Edge cases: see ``write_archives``."""
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, path).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))
