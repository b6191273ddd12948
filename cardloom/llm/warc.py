"""WARC archives: writing through Spark's file writer, and a splittable reader.

Writing: each record is one gzip member and one row; Spark's text writer puts the rows
behind each other. Its line separator is the zero byte that ends every member (the top byte
of the member's length, below 16 MB; larger records are followed by an empty member).

Reading: tasks get byte ranges of the files, scan them for gzip magic and own what starts
inside (Spark's own split reader, with the magic as separator, so any store that Spark reads
will do). Each candidate is validated by decoding: its first bytes must inflate to a WARC
header, and a candidate too short to tell stays open until later pieces do. Magic that occurs
by chance inside compressed data is thus no member, and what follows it is put back onto the
member it belongs to, across range borders too: a range's unfinished last member and the pieces
that later ranges have before their first member meet in one group, a group for each such member.

Names in .gz make Spark's readers inflate a whole file as one stream. Hadoop switches that off for a
suffix for which its pass-through codec is declared; declared for ``!.gz``, right behind .gz
in the codecs' order, it leaves names in .gz without any codec, so that their ranges are read as they are.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, staged, tidy

MAGIC = b"\x1f\x8b\x08"
EMPTY = MAGIC + b"\0\0\0\0\0\0\xff" + b"\x03\0" + b"\0" * 8
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member that ends with a zero byte (an empty member follows data of 16 MB and more)."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if out[-1] == 0 else out + EMPTY


def record(record_id: str | None, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record with its payload, or a revisit of an equal payload without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}"]
    if record_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{record_id}>")
    if uri is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in uri))
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): of rows with equal bodies of ``least_bytes`` or more, those that are not
    the largest id refer to it. A null body is empty; rows with a null id never are referred to; rows that
    repeat id and body of the largest are responses too."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{body_col}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("_sha", F.sha1(F.col("html").cast("binary")))
    most = rows.where(F.octet_length("html") >= least_bytes).groupBy("_sha").agg(F.max("page_id").alias("most"), F.count("*").alias("n")).where("n > 1").select(F.col("_sha").alias("_of"), "most")
    other = F.when(F.col("most").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("most")), F.col("most"))
    return rows.join(most, F.col("_sha") == F.col("_of"), "left").select("page_id", "url", "html", other.alias("refers_to"))


def _members(date: str, level: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                out = []
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.slice(a, 500).columns), strict=True):
                    payload = (html or "").encode()
                    out.append(member(record(None if page_id is None else str(page_id), url, payload, digest_of(payload), None if refers_to is None else str(refers_to), date), level))
                yield pa.record_batch({"value": pa.array(out, pa.binary())})

    return run


def write_archive(rows: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> None:
    """Write (page_id, url, html, refers_to) rows as WARC records, one gzip member each."""
    members = rows.select("page_id", "url", "html", "refers_to").mapInArrow(_members(date, level), "value binary")
    members.select(F.expr("cast(substring(value, 1, length(value) - 1) as string)").alias("value")).write.option("lineSep", "\0").text(path)


def parse(data: bytes) -> dict | None:
    """Headers (lower-case names), payload and size of the record that data begins with."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    block = rest[: int(fields["content-length"])] if fields.get("content-length", "").isdigit() else rest
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    return {"fields": fields, "payload": payload, "size": len(head) + 4 + len(block)}


def records(text: bytes) -> list[dict]:
    """All records of an inflated member (mostly one)."""
    out = []
    while (one := parse(text)) is not None:
        out.append(one)
        text = text[one["size"] :].lstrip(b"\r\n")
    return out


class Opening:
    """The first bytes of what magic may open, fed as they come: real is None until it is known
    whether they inflate to a WARC header."""

    def __init__(self, at: int):
        self.at = at
        self.real: bool | None = None
        self._unpack = zlib.decompressobj(31)
        self._text = b""

    def feed(self, data: bytes) -> None:
        for a in range(0, len(data), 4096):
            try:
                self._text += self._unpack.decompress(data[a : a + 4096], 64)
            except zlib.error:
                self.real = False
                return
            if len(self._text) >= 5 or self._unpack.eof or not b"WARC/".startswith(self._text):
                self.real = self._text.startswith(b"WARC/")
                return


def inflated(data: bytes) -> tuple[list[bytes], bytes, int]:
    """The texts of the whole members in data, one behind the other, the bytes from a last one that isn't whole,
    and how many bytes of damaged members and of what is no member are passed over."""
    texts, at, lost = [], 0, 0
    while at >= 0:
        unpack = zlib.decompressobj(31)
        try:
            out = unpack.decompress(memoryview(data)[at:])
        except zlib.error:
            end = at
        else:
            if not unpack.eof:
                return texts, data[at:], lost
            if out:
                texts.append(out)
            end = len(data) - len(unpack.unused_data)
        at = data.find(MAGIC, max(end, at + 1))
        lost += len(data[end : at if at >= 0 else len(data)].strip(b"\0"))
    return texts, b"", lost


class Members:
    """Pieces between magic bytes, in file order, to members.

    Magic opens a member once its bytes are seen to inflate to a WARC header. That can take
    several pieces, since magic can occur by chance in a member's first bytes too. What comes
    before the first member is given out as soon as it can't be the beginning of one.
    """

    def __init__(self):
        self.held = bytearray()
        self.real = False  # whether held begins with a member
        self.open: list[Opening] = []
        self.lost = 0

    def _inflated(self, data: bytes) -> tuple[list[bytes], bytes]:
        texts, rest, lost = inflated(data)
        self.lost += lost
        return texts, rest

    def add(self, piece: bytes) -> tuple[bytes, list[bytes]]:
        """What stands before the first member, and texts, as far as this piece settles them."""
        new = MAGIC + piece
        self.open.append(Opening(len(self.held)))
        self.held += new
        for x in self.open:
            x.feed(new)
        loose, texts = b"", []
        while (x := next((x for x in self.open if x.real), None)) is not None:
            before = bytes(self.held[: x.at])
            if self.real:
                whole, rest = self._inflated(before)
                texts += whole
                self.lost += len(rest)
            else:
                loose = before
            del self.held[: x.at]
            self.real = True
            self.open = [y for y in self.open if y.at > x.at]
            for y in self.open:
                y.at -= x.at
        self.open = [x for x in self.open if x.real is None]
        if not self.real and not self.open:
            loose += bytes(self.held)
            self.held.clear()
        return loose, texts

    def end(self) -> tuple[bytes, list[bytes], bytes | None]:
        """What stands before the first member, texts, and a last member that isn't whole (None: no member at all)."""
        if not self.real:
            return bytes(self.held), [], None
        return b"", *self._inflated(bytes(self.held))


RECORD = "record_id string, record_type string, uri string, refers_to string, digest string, payload_length long, payload binary"
NAMES = [c.split()[0] for c in RECORD.split(", ")]
#: part 0: a record; 1: bytes before a range's first member; 2: the unfinished end of a range's last one; 3: bytes passed over;
#: 4: bytes of a range without a member that may begin with one, as the next range will show.
SCANNED = f"part int, file string, at long, seq long, data binary, lost long, {RECORD}"


def _fields_of(one: dict) -> tuple:
    bare = lambda v: v[len("<urn:page:") : -1] if v and v.startswith("<urn:page:") else v
    x, payload = one["fields"], one["payload"]
    again = x.get("warc-type") == "revisit"
    length = int(x["x-payload-length"]) if again and x.get("x-payload-length", "").isdigit() else len(payload)
    digest = x.get("warc-payload-digest", "").removeprefix("sha1:") if again else digest_of(payload)
    return bare(x.get("warc-record-id")), x.get("warc-type"), x.get("warc-target-uri"), bare(x.get("warc-refers-to")), digest, length, payload


class Rows:
    """Rows of SCANNED, given out as batches of some MB."""

    TYPES = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary())

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0

    def texts(self, file: str, at: int, texts: list[bytes]) -> int:
        """Add the records of inflated members; returns the bytes that are no records."""
        lost = 0
        for text in texts:
            found = records(text)
            lost += 0 if found else len(text)
            for one in found:
                self.add(0, file, at, record=_fields_of(one))
        return lost

    def add(self, part: int, file: str, at: int, seq: int = 0, data: bytes | None = None, lost: int | None = None, record: tuple = (None,) * len(NAMES)) -> None:
        self.rows.append((part, file, at, seq, data, lost, *record))
        self.size += len(data or b"") + len(record[-1] or b"") + 200

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.TYPES)
        names = [c.split()[0] for c in SCANNED.split(", ")]
        out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, self.TYPES, strict=True)], names=names)
        self.rows, self.size = [], 0
        return out


@tidy
def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces between magic bytes, in file order, to records; what a range can't settle alone goes on."""
    rows = Rows()
    now: tuple[str, int] | None = None
    members, seq, lost = Members(), 0, 0

    def loose(data: bytes, part: int = 1) -> None:
        nonlocal seq
        if data:
            rows.add(part, *now, seq, data)
            seq += 1

    def end() -> None:
        before, texts, rest = members.end()
        loose(before, 4)  # else it would have been given out
        gone = lost + rows.texts(*now, texts) + members.lost
        if rest is not None:
            rows.add(2, *now, -1, rest)
        if gone:
            rows.add(3, *now, lost=gone)

    for batch in batches:
        for piece, file, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, at) != now:
                if now:
                    end()
                now, members, seq, lost = (file, at), Members(), 0, 0
                if at == 0:  # what stands before the first magic of a file
                    lost = len(piece)
                    continue
            before, texts = members.add(piece)
            loose(before)
            lost += rows.texts(*now, texts)
            if rows.size > 4 << 20:
                yield rows.batch()
    if now:
        end()
    if rows.rows:
        yield rows.batch()


@tidy
def _joined(table: pa.Table) -> pa.Table:
    """The pieces of one member that goes on over ranges, in order."""
    table = table.sort_by([("at", "ascending"), ("seq", "ascending")])
    file, at = table.column("file")[0].as_py(), table.column("at")[0].as_py()
    members, rows = Members(), Rows()
    lost = 0
    for piece in b"".join(table.column("data").to_pylist()).split(MAGIC)[1:]:
        before, texts = members.add(piece)
        lost += len(before) + rows.texts(file, at, texts)
    before, texts, rest = members.end()
    lost += len(before) + len(rest or b"") + rows.texts(file, at, texts) + members.lost
    if lost:
        rows.add(3, file, at, lost=lost)
    return pa.Table.from_batches([rows.batch()])


def _read(spark: SparkSession, path: str) -> DataFrame:
    codec = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec", "io.compress.passthrough.extension": "!.gz", "org.apache.hadoop.shaded.io.compress.passthrough.extension": "!.gz"}
    lines = spark.read.options(lineSep=MAGIC.decode("latin-1"), encoding="ISO-8859-1", recursiveFileLookup="true", **codec).text(path)
    pieces = lines.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    found = pieces.mapInArrow(_scanned, SCANNED)
    # of each range at most the end of one member and what another left over: small beside the archive
    torn = staged(found.where("part IN (1, 2, 4)"), "warc-torn")
    marks = torn.groupBy("file", "at").agg(*[F.bool_or(F.col("part") == part).alias(name) for part, name in ((2, "tail"), (4, "maybe"))])
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("tail"), F.col("at")), ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first(F.when(F.col("maybe"), F.col("at")), ignorenulls=True).over(upto)
    owner = marks.select("file", "at", F.coalesce(last, first).alias("owner"))
    owned = torn.join(owner, ["file", "at"]).withColumn("owner", F.when(F.col("part") == 2, F.col("at")).otherwise(F.col("owner")))
    whole = owned.where("owner IS NOT NULL").select("file", "owner", "at", "seq", "data").groupBy("file", "owner").applyInArrow(_joined, SCANNED)
    nowhere = owned.where("owner IS NULL").select("file", F.octet_length("data").cast("long").alias("lost")).withColumn("part", F.lit(3))
    return found.where("part IN (0, 3)").unionByName(whole).unionByName(nowhere, allowMissingColumns=True)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archive, a file or folder; names in .gz or not. Damaged members and
    other data are passed over: ``damage`` counts them. Without files: an error of Spark's reader."""
    return _read(spark, path).where("part = 0").select(NAMES)


def damage(spark: SparkSession, path: str) -> DataFrame:
    """(file, lost): bytes of each file that belong to no readable record, where there are any (zeros between members don't count)."""
    return _read(spark, path).where("part = 3").groupBy("file").agg(F.sum("lost").alias("lost"))


def op6_warc_splittable(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = shared_dir(spark, "warc")
    write_archive(revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), out)
    return read_archive(spark, out).select(F.col("record_id").cast("long").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE_OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS most FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM d)
SELECT page_id, strlen(h) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: CASE WHEN substr(bits, i * 5 + j + 1, 1) = '1' THEN CAST(pow(2, 4 - j) AS INTEGER) ELSE 0 END))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = most THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> most THEN most END AS refers_to
FROM b
"""

QUERIES = {"op6_warc_splittable": op6_warc_splittable}
ORACLES = {"op6_warc_splittable": ORACLE_OP6}
