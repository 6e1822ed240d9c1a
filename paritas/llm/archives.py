"""WARC archives: writing records, segments and revisits; reading them back whole.

Writing: a page is a response record, an HTTP message in chunked transfer framing. A
record longer than ``SEGMENT`` characters is cut: the first segment keeps the type and
has number 1, the others are continuation records that name the first as their origin,
and the last gives the total length. A page whose payload another page with a larger id
also has is a revisit record without payload, if the payload has ``REVISIT`` bytes or
more; all pages with the largest id stay responses.

Reading: archives are parsed record by record from their declared lengths. Segments are
grouped by origin, ordered by number, checked for gaps and against the total length, and
joined; then the chunked framing is decoded and checked against the payload digest, in hex
or base32 and by the algorithm it names, and revisits take their payload's length from the
record they refer to. A damaged record, a missing segment or a wrong digest has an ``error``;
reading pages fails on it, unless it is asked to keep such records with their error. Behind
damage in an archive nothing more of that archive is read.

Records are separated by an empty line pair, which is what the text sink writes between
its rows, so Spark writes the archives itself, in parallel and committed like any table.

A null html is an empty payload, a null url leaves the target out; a null page id reads
back as null. Rows that repeat a page id are records of their own. An empty table makes
no record. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.session import scratch_path, written

REVISIT = 1000
#: Characters of a chunk of the transfer framing, and of a record segment.
CHUNK = 4096
SEGMENT = 16384
#: Records and segments of an archive file at most. One task reads an archive; as segments
#: are bounded, so is an archive, at 128 MiB.
RECORDS = 2000

#: Digest algorithms that are checked; a digest by another one is passed on.
ALGORITHMS = ("md5", "sha1", "sha256", "sha512")

_END = "\r\n"
_SCHEME = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def described(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to): what is to be
    written; ``refers_to`` is null for a response."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"),
    )
    copies = (
        rows.where(F.col("payload_bytes") >= REVISIT)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("newest"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    older = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return rows.join(copies, "payload_digest", "left").select(
        "page_id",
        "url",
        "html",
        "payload_bytes",
        "payload_digest",
        F.when(older, F.col("newest")).alias("refers_to"),
    )


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; one whose value is null is left out."""
    shown = [F.concat(F.lit(f"{name}: "), value, F.lit(_END)) for name, value in pairs]
    return F.concat(*(F.coalesce(line, F.lit("")) for line in shown))


def _pieces(text: Column, size: int) -> Column:
    """A text cut into pieces of ``size`` characters; none for an empty text."""
    count = F.ceil(F.length(text) / size).cast("int")
    whole = F.when(F.length(text) == 0, F.array().cast("array<string>"))
    return whole.when(F.length(text) <= size, F.array(text)).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
            lambda i: F.substr(text, i * size + 1, F.lit(size)),
        )
    )


def _framed(payload: Column) -> Column:
    """An HTTP message with the payload in chunked transfer framing."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    chunks = F.transform(
        _pieces(payload, CHUNK),
        lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit(_END), c, F.lit(_END)),
    )
    return F.concat(
        F.lit(head + "Transfer-Encoding: chunked" + _END * 2),
        F.array_join(chunks, ""),
        F.lit("0" + _END * 2),
    )


def records(pages: DataFrame) -> DataFrame:
    """(record): the text of every record and segment, without the closing line pair."""
    rows = described(pages)
    name = F.concat(
        F.lit(_SCHEME),
        F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(":"),
        F.monotonically_increasing_id().cast("string"),
    )
    rows = rows.select("*", name.alias("name"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("HTTP/1.1 200 OK" + _END * 2)).otherwise(_framed(F.col("html")))
    rows = rows.select("*", block.alias("block"))
    cut = rows.select(
        "*",
        F.octet_length("block").alias("total"),
        F.posexplode(_pieces(F.col("block"), SEGMENT)).alias("at", "segment"),
        F.ceil(F.length("block") / SEGMENT).alias("segments"),
    )
    first, several = F.col("at") == 0, F.col("segments") > 1
    number = F.when(several, (F.col("at") + 1).cast("string"))
    identifier = F.when(first, F.col("name")).otherwise(F.concat("name", F.lit(":s"), number))
    wrapped = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    kind = F.when(~first, "continuation").when(revisit, "revisit").otherwise("response")
    last = several & (F.col("at") + 1 == F.col("segments"))
    refers = F.concat(F.lit(_SCHEME), F.col("refers_to").cast("string"))
    head = _lines(
        ("WARC-Type", kind),
        ("WARC-Record-ID", wrapped(identifier)),
        ("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "payload_digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        ("WARC-Refers-To", wrapped(refers)),
        ("WARC-Segment-Number", number),
        ("WARC-Segment-Origin-ID", F.when(~first, wrapped(F.col("name")))),
        ("WARC-Segment-Total-Length", F.when(last, F.col("total").cast("string"))),
        ("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        ("Content-Length", F.octet_length("segment").cast("string")),
    )
    return cut.select(
        F.concat(F.lit("WARC/1.1" + _END), head, F.lit(_END), F.col("segment")).alias("record")
    )


def write_archives(pages: DataFrame, path: str, compressed: bool = True) -> None:
    """Write one record per page, or several where one is too long, below ``path``."""
    writer = records(pages).write.option("lineSep", _END * 2).option("maxRecordsPerFile", RECORDS)
    writer.option("compression", "gzip" if compressed else "none").text(path)


def _header(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode()] = value.strip().decode()
    return out


def _decompressed(data: bytes) -> tuple[bytes, str | None]:
    """What the members of an archive hold, one or many, and what ended it early."""
    parts = []
    while data:
        member = zlib.decompressobj(31)
        try:
            parts.append(member.decompress(data))
        except zlib.error as error:
            return b"".join(parts), f"the archive cannot be decompressed: {error}"
        data = member.unused_data
    return b"".join(parts), None if member.eof else "the archive is cut off"


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of every record of an archive, by the declared lengths."""
    damage = None
    if data[:2] == b"\x1f\x8b":
        data, damage = _decompressed(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        header = _header(data[at:end])
        if "content-length" not in header:
            raise ValueError(f"the record at byte {at} has no length")
        start, size = end + 4, int(header["content-length"])
        if len(data) < start + size:
            raise ValueError(f"the record at byte {at} is cut off")
        yield header, data[start : start + size]
        at = start + size
        while data.startswith(b"\r\n", at):
            at += 2
    if damage:
        raise ValueError(damage)


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked transfer framing; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size")
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        piece = body[end + 2 : end + 2 + size]
        if len(piece) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut off")
        out.append(piece)
        at = end + 4 + size


def payload(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = _header(head)
    chunked = fields.get("transfer-encoding", "").lower() == "chunked"
    return unchunked(body) if chunked else body


_RECORD = (
    "record_id string, kind string, url string, digest string, refers string, "
    "number int, origin string, total long, block binary, error string"
)


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def normalised(digest: str | None) -> str | None:
    """A payload digest in lower-case hex, with the algorithm's name unless that is SHA-1."""
    if not digest:
        return None
    label, _, value = digest.rpartition(":")
    name = label.lower().replace("-", "") or "sha1"
    if name not in ALGORITHMS:
        return digest
    size = hashlib.new(name).digest_size
    if len(value) != 2 * size:
        try:
            value = base64.b32decode(value + "=" * (-len(value) % 8), casefold=True).hex()
        except ValueError:
            pass  # neither hex nor base32: equal to no payload's digest
    return value.lower() if name == "sha1" else f"{name}:{value.lower()}"


def _digest_fails(content: bytes, digest: str | None) -> bool:
    if not digest:
        return False
    label, _, value = digest.rpartition(":")
    name = label or "sha1"
    return name in ALGORITHMS and hashlib.new(name, content).hexdigest() != value


def _row(header: dict[str, str], block: bytes) -> tuple:
    number, total = (header.get(f"warc-segment-{name}") for name in ("number", "total-length"))
    return (
        _bare(header.get("warc-record-id")),
        header.get("warc-type"),
        header.get("warc-target-uri"),
        normalised(header.get("warc-payload-digest")),
        _bare(header.get("warc-refers-to")),
        int(number) if number else None,
        _bare(header.get("warc-segment-origin-id")),
        int(total) if total else None,
        block,
        None if header.get("warc-type") else "a record has no type",
    )


def _rows(data: bytes) -> Iterator[tuple]:
    """The records of an archive; damage is a last row with nothing but its error."""
    try:
        for header, block in parsed(data):
            yield _row(header, block)
    except ValueError as error:
        yield (*[None] * 9, str(error))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch["content"]:
            rows, held = [], 0
            for row in _rows(content.as_py()):
                rows.append(row)
                held += len(row[8] or b"")
                if held > 1 << 22:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


_TYPES = [
    *[pa.string()] * 5,
    pa.int32(),
    pa.string(),
    pa.int64(),
    pa.binary(),
    pa.string(),
]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
    return pa.record_batch(arrays, names=[f.split()[0] for f in _RECORD.split(", ")])


def archive_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record and segment of the archives below ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, _RECORD)


def reassembled(found: DataFrame) -> DataFrame:
    """(record_id, kind, url, digest, refers, block, error) of whole records: segments are
    grouped by origin, ordered, checked and joined. Only segments are shuffled."""
    columns = ["record_id", "kind", "url", "digest", "refers"]
    whole = found.where("number is null").select(*columns, "block", "error")
    segments = found.where("number is not null").withColumn(
        "origin", F.coalesce("origin", "record_id")
    )
    part = F.struct("number", "total", "block")
    first = F.col("number") == 1
    grouped = segments.groupBy(F.col("origin").alias("record_id")).agg(
        *(F.max(F.when(first, F.col(c))).alias(c) for c in columns[1:]),
        F.collect_list(part).alias("parts"),
    )
    joined = F.arrow_udf(_joined, "block binary, error string")("record_id", "parts")
    return whole.union(grouped.select(*columns, joined.alias("j")).select(*columns, "j.*"))


def _joined(names: pa.Array, parts: pa.Array) -> pa.Array:
    blocks, errors = [], []
    for name, segments in zip(names.to_pylist(), parts.to_pylist(), strict=True):
        segments.sort(key=lambda p: p["number"])
        block, error = b"".join(p["block"] for p in segments), None
        if [p["number"] for p in segments] != list(range(1, len(segments) + 1)):
            error = f"{name} lacks a segment or has one twice"
        elif {p["total"] for p in segments if p["total"] is not None} != {len(block)}:
            error = f"{name} is not as long as it says"
        blocks.append(None if error else block)
        errors.append(error)
    return _both("block", blocks, errors)


def _both(name: str, values: list, errors: list) -> pa.Array:
    arrays = [pa.array(values, pa.binary()), pa.array(errors, pa.string())]
    return pa.StructArray.from_arrays(arrays, [name, "error"])


def _decoded(kinds: pa.Array, digests: pa.Array, blocks: pa.Array, known: pa.Array) -> pa.Array:
    out, errors = [], []
    for kind, digest, block, error in zip(
        kinds.to_pylist(), digests.to_pylist(), blocks, known.to_pylist(), strict=True
    ):
        content = None
        if kind == "response" and error is None:
            try:
                content = payload(block.as_py())
                if _digest_fails(content, digest):
                    raise ValueError(f"a payload does not have the digest {digest}")
            except ValueError as found:
                content, error = None, str(found)
        out.append(content)
        errors.append(error)
    return _both("payload", out, errors)


def with_payloads(whole: DataFrame) -> DataFrame:
    """The records with ``payload``, the decoded one of a response, null for a revisit, and
    ``error``: what is wrong with the record, if anything is."""
    column = F.arrow_udf(_decoded, "payload binary, error string")(
        "kind", "digest", "block", "error"
    )
    columns = ["record_id", "kind", "url", "digest", "refers"]
    return whole.select(*columns, column.alias("d")).select(*columns, "d.*")


def _page(identifier: Column) -> Column:
    return F.get(F.split(identifier, ":"), 2).try_cast("long")


def page_records(spark: SparkSession, path: str, keep_damaged: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page of
    the archives below ``path``; a revisit has the bytes of the payload it refers to.

    A damaged record fails the job. With ``keep_damaged`` it is a row without bytes, and a
    further column ``error`` says what is wrong with it; other rows have none."""
    rows = with_payloads(reassembled(archive_records(spark, path)))
    size = F.octet_length("payload").cast("long")
    if not keep_damaged:
        size = F.when(F.col("error").isNull(), size).otherwise(F.raise_error(F.col("error")))
    read = written(
        rows.select(
            _page(F.col("record_id")).alias("page_id"),
            size.cast("long").alias("payload_bytes"),
            F.col("digest").alias("payload_digest"),
            F.col("kind").alias("record_type"),
            _page(F.col("refers")).alias("refers_to"),
            "error",
        ),
        "page-records",
    )
    sound = read.where("error is null")
    named = sound.where("record_type = 'response'").groupBy(
        F.col("page_id").alias("refers_to"), "payload_digest"
    )
    sizes = named.agg(F.max("payload_bytes").alias("full"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    columns += ["error"] if keep_damaged else []
    revisits = sound.where("record_type = 'revisit'").drop("payload_bytes")
    revisits = revisits.join(sizes, ["refers_to", "payload_digest"], "left").withColumnRenamed(
        "full", "payload_bytes"
    )
    others = read.where("record_type = 'response' and error is null or error is not null")
    return others.select(*columns).union(revisits.select(*columns))


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path)
    return page_records(pages.sparkSession, path)
