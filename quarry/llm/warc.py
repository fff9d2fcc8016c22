"""WARC: a writer and a splittable reader of archives of gzip members.

Writing. Every row becomes one record in a gzip member of its own. Payloads that are equal (same SHA-256 and length)
are written once, as the response of the largest page_id; the others become revisit records that refer to it. Members
go out through Spark's file writer, so archives land on whatever store the path names and a lost task is committed
once. That writer ends each row with one fixed byte: zero, which is the last byte of every gzip member of under 16 MiB
(the top byte of its length); a longer member is followed by an empty one, which adds nothing to the stream.

Reading. Tasks take byte ranges of the archives. Within a range they look for the gzip magic (1f 8b 08), take the
bytes from one magic to the next as a candidate, and validate it by inflating its start to a WARC header. A magic that
occurs inside compressed data fails that test, and its bytes go back to the member before it. A record belongs to the
range in which it starts; where a range's last member was cut by such a false magic beyond its end, the pieces are
joined afterwards by file and offset (rare, and only those pieces are shuffled).

Any archive of single-record members can be read: header names in any case, with or without a space after the colon;
the payload of an HTTP response is what follows its header (as sent, chunks and codings included); digest_ok says whether
a SHA-1 digest that the record states is the payload's.

Defined cases: a null html is an empty payload; null page_ids are written with an id made from url and payload, read back as
null, and never refer or are referred to while a page_id is known; repeated rows are repeated records, of the same id; an
empty table gives an empty archive and an empty result; a payload of any length is one member, held whole by its task. A
revisit that states no length has a null payload_bytes. Only page_id, url and html are read, whatever other columns are
called.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, cut, fresh_path

MAGIC = b"\x1f\x8b\x08"
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, digest_ok boolean, payload binary"
_NAMES = [f.split()[0] for f in RECORD.split(", ")]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record, header and block, as it stands in an archive before compression."""
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Date: " + date.encode()]
    made = f"urn:page:{page_id}" if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {hashlib.sha256(payload).hexdigest()}").urn
    head.append(f"WARC-Record-ID: <{made}>".encode())
    if url is not None:
        head.append(b"WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "%" + c.encode().hex("%").upper() for c in url).encode("utf-8", "surrogatepass"))
    head.append(b"WARC-Payload-Digest: sha1:" + base32_sha1(payload).encode())
    head.append(b"X-Payload-Length: %d" % len(payload))
    if revisit:
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(b"WARC-Refers-To: <urn:page:%d>" % refers_to)
    block = b"" if revisit else payload
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<?urn:page:(-?\d+)>?", uri or "")
    return int(found[1]) if found else None


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    length = fields.get("content-length", "")
    block = rest[: int(length)] if length.isdecimal() else rest.removesuffix(b"\r\n\r\n")
    payload = block
    if fields.get("content-type", "").lower().startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    kind = fields.get("warc-type", "")
    stated = fields.get("x-payload-length", "")
    algorithm, _, digest = fields.get("warc-payload-digest", "").rpartition(":")
    mine = base32_sha1(payload)
    return {
        "page_id": _page(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload_bytes": int(stated) if stated.isdecimal() else None if kind == "revisit" else len(payload),
        "payload_digest": digest or (None if kind == "revisit" else mine),
        "digest_ok": None if kind == "revisit" or algorithm.lower() not in ("sha1", "") or not digest else digest.upper() == mine,
        "payload": None if kind == "revisit" else payload,
    }


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str | None = None) -> None:
    """Write one record per row under path, dated date (now). Equal payloads of at least least_bytes are stored once."""
    bound_batches(pages.sparkSession)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    keyed = raw.withColumn("key", F.sha2("payload", 256))
    # One row per payload that occurs more than once: written out, so that the join below splits a hot payload's rows.
    owners = cut(keyed.where(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-owners")
    marked = keyed.join(owners.hint("shuffle_hash"), "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, payload, owner in zip(*(c.to_pylist() for c in batch.columns)):
                revisit = owner is not None and page_id != owner
                member = _member(record_bytes(page_id, url, payload, owner if revisit else None, revisit, date))
                out.append(member[:-1] if member[-1] == 0 else member + _EMPTY_MEMBER[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    members = marked.select("page_id", "url", "payload", "owner").mapInArrow(run, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


def _starts_record(piece: bytes) -> bool:
    """Whether the bytes (from a magic on) inflate to the start of a WARC header."""
    if len(piece) < 18 or piece[3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(piece[:4096], 5) == b"WARC/"
    except zlib.error:
        return False


def _complete(piece: bytes) -> bytes | None:
    """The member's data, if the piece holds it to its end."""
    z = zlib.decompressobj(31)
    try:
        data = z.decompress(piece)
    except zlib.error:
        return None
    return data if z.eof else None


_PIECE = RECORD + ", file string, at bigint, seq bigint, kind string, piece binary"


def _split_range(pieces: list[bytes]) -> Iterator[tuple[str, bytes]]:
    """('record', data), or ('head' | 'tail', bytes) for what must be joined across ranges."""
    held: bytes | None = None  # a valid start that is not complete yet
    for body in pieces:
        piece = MAGIC + body
        if _starts_record(piece):
            if held is not None:
                yield "tail", held
            held = piece
        elif held is not None:
            held += piece
        else:
            yield "head", piece
            continue
        data = _complete(held)
        if data is not None:
            yield "record", data
            held = b""
        if held == b"":
            held = None
            # An empty member may follow; as a piece of its own it is a head without a tail and is dropped below.
    if held is not None:
        yield "tail", held


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under path, one row each (RECORD's columns; payload is null for a revisit)."""
    separator = MAGIC.decode("latin-1")
    lines = spark.read.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)
    ranged = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's rows come range by range, in order; a range's pieces are kept only until its records are out."""
        now, pending, seq = None, [], 0

        def flush(last: bool):
            nonlocal pending, seq
            rows = []
            # Without the range's end in sight, the last piece may go on: it stays for the next batch.
            done = list(_split_range(pending))
            keep: list[bytes] = []
            if not last and done and done[-1][0] == "tail":
                keep = [done.pop()[1][len(MAGIC) :]]
            for kind, data in done:
                seq += 1
                row = parse_record(data) if kind == "record" else dict.fromkeys(_NAMES)
                rows.append(row | {"file": now[0], "at": now[1], "seq": seq, "kind": kind, "piece": None if kind == "record" else data})
            pending = keep
            return pa.RecordBatch.from_pylist(rows, schema=_PIECE_SCHEMA)

        for batch in batches:
            for value, file, at in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (file, at):
                    if now is not None:
                        yield flush(True)
                    now, seq = (file, at), 0
                if value or pending:  # what stands before a file's first magic is empty
                    pending.append(value)
            if now is not None:
                yield flush(False)
        if now is not None:
            yield flush(True)

    found = ranged.mapInArrow(run, _PIECE)
    return found


def records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """read() with the pieces of cut members joined; without payloads if they are not asked for."""
    found = read(spark, path)
    found = cut(found if payloads else found.drop("payload"), "warc-read")
    names = [n for n in _NAMES if payloads or n != "payload"]
    whole = found.where("kind = 'record'").select(*names)
    # The pieces of a file come in order, and no more than one member is held.
    loose = found.where("kind <> 'record'").select("file", "at", "seq", "kind", "piece").repartition("file").sortWithinPartitions("file", "at", "seq")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            rows = []
            for file, kind, piece in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
                if file != now:
                    now, held = file, None
                held = piece if kind == "tail" else held + piece if held is not None else None
                data = _complete(held) if held is not None else None
                if data is not None:
                    rows.append(parse_record(data))
                    held = None
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_SCHEMA)

    return whole.unionByName(loose.mapInArrow(join, RECORD).select(*names))


_RECORD_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("payload", pa.binary())]
)
_PIECE_SCHEMA = pa.schema([*_RECORD_SCHEMA, *[pa.field(n, t) for n, t in (("file", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("piece", pa.binary()))]])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    path = fresh_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return records(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP4_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, h, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x,
         max(page_id) OVER (PARTITION BY h) AS owner
  FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('{_ABC}', 1 + ((('0x' || substr(x, CAST(5 * k + 1 AS BIGINT), 5))::BIGINT >> s) & 31), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM d
"""
