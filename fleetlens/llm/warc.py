"""WARC archives: written one gzip member per record, read back sequentially.

A task writes its records into archives of bounded size in the shared folder, under names that no
other attempt uses; only the list of files that Spark's commit keeps is read, so a lost executor
leaves an unread file and no wrong row. The reader inflates one member after the other, a block of
bytes at a time, frames the record by its Content-Length and checks block and payload digests.

Defined cases: a null payload is an empty one, a null url is left out of the record, a null
identifier is left out and read back as null; records with the same identifier and payload are both
responses; payloads of any length are one record each; an empty table gives an empty result; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import shared

VERSION = b"WARC/1.1"
# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_TYPE = "application/http; msgtype=response"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def sha1_name(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(name: str) -> str:
    kind, _, value = name.partition(":")
    if kind != "sha1":
        raise ValueError(f"digest of an unknown kind: {name}")
    return base64.b32decode(value).hex()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record: a response with its payload, or a revisit that names the response."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    fields += [("WARC-Payload-Digest", digest), ("WARC-Block-Digest", sha1_name(block))]
    fields += [("Content-Type", RESPONSE_TYPE), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def classified(df: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """page_id, url, payload, refers_to: the response a record revisits, null for responses.

    Only identifiers and digests are grouped; sums are taken before the shuffle, and the join on
    the digest leaves out records that stand alone.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    long_ = F.length("payload") >= least_bytes
    # Small records have keys of their own, or they would all meet in one task.
    rows = rows.withColumn("digest", F.when(long_, F.sha2("payload", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url", "payload"))))
    groups = (
        rows.filter(long_)
        .groupBy("digest")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    joined = rows.join(groups, "digest", "left")
    first = F.col("response").isNull() | F.col("page_id").eqNullSafe(F.col("response"))
    return joined.select("page_id", "url", "payload", F.when(~first, F.col("response")).alias("refers_to"))


def write(
    df: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 1000,
    archive_bytes: int = 16 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Writes the records into archives below ``folder``; gives the table of archives: path, records, bytes."""

    def archives(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        files, root = FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        files.create_dir(root, recursive=True)
        out = path = None
        size = n = 0

        def closed():
            out.close()
            return pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})

        for part in parts:
            for page_id, url, payload, refers_to in zip(part.page_id, part.url, part.payload, part.refers_to, strict=True):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, size, n = files.open_output_stream(path, compression=None), 0, 0
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                body = bytes(payload)
                packer = zlib.compressobj(5, zlib.DEFLATED, 31)
                whole = record(page_id, url, body, sha1_name(body), refers_to, date)
                member = packer.compress(whole) + packer.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    # Nullable integers would come as floats, which lose digits above 2^53.
    rows = classified(df, id_col, url_col, payload_col, least_bytes)
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return shared.written(rows.mapInPandas(archives, "path string, records long, bytes long"), "warc-archives")


def members(stream, block_bytes: int = 1 << 18) -> Iterator[bytes]:
    """The inflated members of a gzip file, one at a time; a member that is cut off is an error."""
    data = b""
    while True:
        if not data:
            data = stream.read(block_bytes)
            if not data:
                return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data:
                data = stream.read(block_bytes)
                if not data:
                    raise ValueError("archive ends inside a record")
            parts.append(inflate.decompress(data))
            data = inflate.unused_data
        yield b"".join(parts)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and block of a record, framed by its Content-Length and checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) < length or end != b"\r\n\r\n":
        raise ValueError("record is not as long as its header says")
    if sha1_name(block) != fields["warc-block-digest"]:
        raise ValueError("block does not match its digest")
    return fields, block


def read(archives: DataFrame) -> DataFrame:
    """The records of the archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Lengths and digests are those of the full payload; a revisit has no payload of its own.
    """

    def records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        def rows(paths):
            for path in paths:
                files, name = FileSystem.from_uri(path if "://" in path else f"file://{path}")
                with files.open_input_stream(name, compression=None) as stream:
                    for member in members(stream):
                        fields, block = parsed(member)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                        kind, digest = fields["warc-type"], fields["warc-payload-digest"]
                        if kind == "response" and (len(payload) != length or sha1_name(payload) != digest):
                            raise ValueError("payload does not match its length and digest")
                        ids = (fields.get("x-page-id"), fields.get("x-refers-to-page-id"))
                        yield (
                            ids[0], fields.get("warc-target-uri"), kind, length, hex_digest(digest), ids[1],
                            payload if kind == "response" else None,
                        )

        chunk, held = [], 0
        for row in rows(p for part in parts for p in part.path):
            chunk.append(row)
            held += len(row[-1] or b"")
            if len(chunk) >= 1000 or held >= 8 << 20:
                yield pd.DataFrame(chunk, columns=NAMES)
                chunk, held = [], 0
        if chunk:
            yield pd.DataFrame(chunk, columns=NAMES)

    texts = RECORDS.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")
    many = archives.select("path").repartition(shared.pieces_of_a_group(archives.sparkSession))
    back = many.mapInPandas(records, texts)
    return back.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


NAMES = [c.split()[0] for c in RECORDS.split(", ")]
