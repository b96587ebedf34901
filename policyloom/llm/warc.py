"""WARC archives: records for the rows of a table, revisits for equal payloads, and a reader that trusts no magic.

A record begins with ``WARC/1.1`` and says how long it is, so it names the place of its successor.  A payload may hold
the same bytes.  To read one archive in many tasks, each task looks through one block for everything that could be a
record, and follows the successors up to the first place outside the block.  What remains is a small table of places
and the places after them; by pointer jumping from the start of each file the true ones among them are found.  Only
from these are records read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyloom.session import materialize

_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_LINE = re.compile(rb"[!-9;-~]+:[^\r\n]*\r\n|\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A header is looked for in steps of this size beyond the block.
_STEP = 1 << 16
_FRAME = 4 << 20


@dataclass(frozen=True)
class WarcSettings:
    """Payloads below ``least_bytes`` are never revisits; archives are closed once they reach ``archive_bytes``."""

    least_bytes: int = 0
    archive_bytes: int = 128 << 20
    block_bytes: int = 16 << 20
    date: str = "2000-01-01T00:00:00Z"
    salts: int = 16


def _record_id(ident: str | None, digest: str) -> str:
    return f"<urn:row:{'' if ident is None else quote(ident, safe='') or '%'}:{digest}>"


def row_of(record_id: str | None) -> str | None:
    """The id of the table's row that a record was written for."""
    name = (record_id or "").split(":")
    return None if len(name) < 4 or not name[2] else "" if name[2] == "%" else unquote(name[2])


def record_bytes(
    ident: str | None, uri: str | None, payload: bytes, digest: str, refers_to: str | None, size: int, date: str
) -> bytes:
    """One record with its two closing line ends; a revisit (``refers_to`` given) leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {_record_id(ident, digest)}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0], safe=""), uri))
    if refers_to:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {refers_to}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


# --- writing ----------------------------------------------------------------------------------------------------


def _store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def _write(folder: str, settings: WarcSettings):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(folder)
        out, path, size, n = None, "", 0, 0
        for frame in frames:
            for row in frame.itertuples():
                if out is None:
                    # a name of its own for every attempt: only files of finished tasks are listed
                    name = f"{uuid.uuid4()}.warc"
                    out, path, size, n = store.open_output_stream(f"{root}/{name}"), f"{folder}/{name}", 0, 0
                digest = base64.b32encode(row.digest).decode()
                refers = None if row.first is None or row.first == row.ident else _record_id(row.first, digest)
                data = record_bytes(row.ident, row.uri, row.payload, digest, refers, len(row.payload), settings.date)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= settings.archive_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "bytes": [size], "records": [n]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [size], "records": [n]})

    return run


def write_archives(
    table: DataFrame, folder: str, ident: str = "page_id", uri: str = "url", payload: str = "html",
    settings: WarcSettings = WarcSettings(),
) -> DataFrame:
    """Write a record for every row into a shared folder and return the list ``(path, bytes, records)`` of archives.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the smallest id are responses and the
    others revisit them; smaller payloads are all responses.  A null payload counts as the empty one.  Null ids are
    the largest; if equal payloads have no other id, all are responses.  Repeated rows are written again, under the
    same record id.  Control characters and spaces of an address are escaped; a null address is left out.  An empty
    table has no archives.

    Equal payloads meet as digests, combined before the shuffle.  Only digests of several ids are joined back, in
    ``salts`` parts, so that a payload of very many rows is not one task's; Spark broadcasts them if they are few.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary") if dict(table.dtypes)[payload] == "string" else F.coalesce(F.col(payload), F.lit(b""))
    rows = table.select(
        F.col(ident).alias("id"), F.col(uri).cast("string").alias("uri"), body.alias("payload"), F.unhex(F.sha1(body)).alias("digest"),
    )
    shared = rows.where(F.octet_length("payload") >= settings.least_bytes).groupBy("digest").agg(
        F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("nulls"), F.max("id").alias("last")
    ).where("first is not null and (nulls or first != last)")
    salt = F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1)))
    shared = materialize(shared.select("digest", F.col("first").cast("string").alias("first"))).withColumn("salt", salt)
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(settings.salts)).cast("int"))
    # a small payload has no row in the other table, unless another is equal, and equal ones are as small
    ready = salted.join(shared, ["digest", "salt"], "left").select(F.col("id").cast("string").alias("ident"), "uri", "payload", "digest", "first")
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    return materialize(ready.mapInPandas(_write(folder, settings), "path string, bytes long, records long"))


# --- reading ----------------------------------------------------------------------------------------------------


class _File:
    """Random access to one archive."""

    def __init__(self, path: str, size: int) -> None:
        store, place = _store(path)
        self.source, self.size = store.open_input_file(place), size

    def read(self, start: int, end: int) -> bytes:
        return self.source.read_at(max(0, min(end, self.size) - start), start)

    def header(self, start: int, known: bytes = b"") -> tuple[dict[str, str], int] | None:
        """Names and values of a header at a place, and where it ends; None if there is none.

        ``known`` are bytes from the place on.  More are read only as long as all lines so far are lines of a header.
        """
        data = known or self.read(start, start + _STEP)
        magic = _MAGIC.match(data)
        if not magic:
            return None
        at, fields = magic.end(), {}
        while True:
            line = _LINE.match(data, at)
            if line is None:
                # a line that has no end yet may have one further on
                if b"\n" in data[at:] or start + len(data) >= self.size:
                    return None
                data += self.read(start + len(data), start + 2 * len(data) + _STEP)
                continue
            at = line.end()
            if line[0] == b"\r\n":
                return fields, start + at
            name, _, value = line[0].decode("utf-8", "replace").partition(":")
            fields[name.lower()] = value.strip()

    def successor(self, start: int, known: bytes = b"") -> int | None:
        """Where the record after a possible record begins."""
        found = self.header(start, known)
        length = found and found[0].get("content-length", "")
        if not length or not re.fullmatch("[0-9]{1,18}", length):
            return None
        after = found[1] + int(length) + 4
        return after if after <= self.size else None


def _links(block_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, size, begin in zip(frame["path"], frame["bytes"], frame["begin"], strict=True):
                file = _File(path, size)
                base = max(0, begin - 4)
                data = file.read(base, begin + block_bytes + _STEP)
                after = {}
                for found in _MAGIC.finditer(data):
                    place = base + found.start()
                    ends = data[max(0, found.start() - 4) : found.start()] == b"\r\n\r\n"
                    if begin <= place < begin + block_bytes and (place == 0 or ends):
                        following = file.successor(place, data[found.start() : found.start() + _STEP])
                        if following is not None:
                            after[place] = following
                file.source.close()
                # successors lie behind, so the last places come first
                for place in sorted(after, reverse=True):
                    after[place] = after.get(after[place], after[place])
                yield pd.DataFrame({"path": path, "place": list(after), "after": list(after.values())}).astype({"place": "int64", "after": "int64"})

    return run


def reachable(links: DataFrame, starts: DataFrame) -> DataFrame:
    """``(path, place)`` of the places that the links reach from the starts, by pointer jumping.

    Each round, what is reached takes one jump and every jump is doubled, so a chain of n places takes about log2 n
    rounds, each of them written.
    """
    reached, jumps = materialize(starts.select("path", "place")), links
    known = reached.count()
    while True:
        ahead = reached.join(jumps, ["path", "place"]).select("path", F.col("after").alias("place"))
        reached = materialize(reached.union(ahead).distinct())
        n = reached.count()
        if n == known:
            return reached
        known = n
        onward = jumps.select("path", F.col("place").alias("after"), F.col("after").alias("onward"))
        jumps = materialize(jumps.join(onward, ["path", "after"], "left").select("path", "place", F.coalesce("onward", "after").alias("after")))


_RECORD = (
    "path string, place long, type string, record_id string, uri string, refers_to string, payload_bytes long, "
    "payload_digest string, intact boolean, payload binary"
)


def _records(block_bytes: int, payloads: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _RECORD.split(", ")]
        for frame in frames:
            for path, size, place in zip(frame["path"], frame["bytes"], frame["place"], strict=True):
                file, out, held = _File(path, size), [], 0
                end = (place // block_bytes + 1) * block_bytes
                while place < min(end, size):
                    after = file.successor(place)
                    if after is None or file.read(after - 4, after) != b"\r\n\r\n":
                        raise ValueError(f"{path}: no whole record at {place}")
                    fields, begin = file.header(place)
                    head, _, body = file.read(begin, after - 4).partition(b"\r\n\r\n")
                    said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if fields.get("warc-type") == "revisit":
                        length = re.search(rb"(?i)^content-length:[ \t]*([0-9]+)", head, re.MULTILINE)
                        n, digest, body = int(length[1]) if length else None, said, None
                    else:
                        n, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                    out.append((
                        path, place, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"),
                        fields.get("warc-refers-to"), n, digest, said is None or said == digest, body if payloads else None,
                    ))
                    held += len(body or b"")
                    if held > _FRAME:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
                    place = after
                file.source.close()
                yield pd.DataFrame(out, columns=names)

    return run


def read_archives(archives: DataFrame, settings: WarcSettings = WarcSettings(), payloads: bool = True) -> DataFrame:
    """The records of archives ``(path, bytes)``, read block by block.

    Columns: ``path``, ``place``, ``type``, ``record_id``, ``uri``, ``refers_to`` (a record id), ``payload_bytes``,
    ``payload_digest`` (base32 SHA-1 of the bytes read; of a revisit, as its header has it), ``intact`` (does the
    header's digest agree), ``payload`` (null for revisits, and for all if ``payloads`` is false).  Bytes in a payload
    that look like a record give no row.  An archive that does not consist of whole records is an error.  No archives
    give no rows.
    """
    size = settings.block_bytes
    files = archives.select("path", "bytes").where("bytes > 0")
    blocks = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))).alias("begin"))
    n = 4 * archives.sparkSession.sparkContext.defaultParallelism
    links = materialize(blocks.repartition(n, "path", "begin").mapInPandas(_links(size), "path string, place long, after long"))
    starts = files.select("path", F.lit(0).cast("long").alias("place"))
    # a chain is entered at the start of its file or where it leaves another block
    entries = links.select("path", F.col("after").alias("place")).union(starts).distinct()
    reached = reachable(links.join(entries, ["path", "place"], "left_semi"), starts)
    true = reached.join(files, "path").where("place < bytes").repartition(n, "path", "place")
    return true.mapInPandas(_records(size, payloads), _RECORD)


def with_payloads(records: DataFrame, salts: int = 16) -> DataFrame:
    """Records whose revisits have the payload of the record that they refer to, where it is among them."""
    own = records.where("type != 'revisit'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("payload").alias("_found"))
    copies = records.where("type = 'revisit'").select("refers_to").distinct()
    found = own.join(copies, "refers_to", "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = records.withColumn("_salt", F.pmod(F.xxhash64("path", "place"), F.lit(salts)).cast("int"))
    return salted.join(found, ["refers_to", "_salt"], "left").select(
        *(F.col(c) if c != "payload" else F.coalesce("payload", "_found").alias(c) for c in records.columns)
    )
