"""WARC archives of pages, and a two-level index of their captures.

Archives hold one gzip member per record. Pages with an equal payload are written once, as a response;
the others are revisit records that refer to it. The index has a line per capture, keyed by the URL
with its host reversed and sorted over all parts: lines are compressed in blocks, and each part ends
with a sparse directory of the first key of every block. A lookup picks the part by the parts' first
keys, finds the block by binary search in its directory, reads just that block, and then just the
record's bytes.

Files are written by tasks into a folder of any file system that pyarrow knows (local, HDFS, S3, GCS).
A file counts only if the task that wrote it has reported it: names are new for each attempt, so what
lost or repeated attempts left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from netlantern.llm.common import written
from netlantern.plans.sizing import fresh_path

#: Lines of a block, captures that an index part is meant to hold, bytes after which a task begins
#: another archive, and files that a reader keeps open.
LINES = 1000
PART = 50_000
ARCHIVE_BYTES = 256 << 20
OPEN = 16
#: Keys with more than one in so many of the rows are looked up apart; revisits of one response that a
#: task gets at once.
HOT_SHARE, AT_ONCE = 4096, 1000
#: Payloads of at least this many bytes are written once.
LEAST_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TRAILER = "<QQ"


def open_folder(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (arrow_fs.LocalFileSystem(), path)


def url_key(name: str = "url") -> Column:
    """``com,example,blog)/path?query``: host reversed and lower-cased; no scheme, user or fragment.

    A port stays, behind the host. A null URL has the empty key.
    """
    url = F.coalesce(F.col(name), F.lit(""))
    bare = F.regexp_replace(F.substring_index(url, "#", 1), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    place = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*", 0), r"^.*@", "")
    rest = F.regexp_extract(bare, r"(?s)^[^/?]*(.*)$", 1)
    host, port = F.lower(F.substring_index(place, ":", 1)), F.regexp_extract(place, r":.*$", 0)
    turned = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port)
    return F.when(url == "", F.lit("")).otherwise(F.concat(turned, F.lit(")"), rest))


# --- records -----------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def header_value(value: str) -> str:
    """Line ends can't stand in a header; they are escaped as in URLs."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def header_text(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def make_record(
    page_id: int | None,
    url: str | None,
    payload: bytes,
    digest: str,
    response: int | None,
    response_url: str | None = None,
) -> bytes:
    """One record; a revisit of page ``response`` if that is given, which leaves out the payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if response is None else http
    headers = [
        ("WARC-Type", "response" if response is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", header_value(url)))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if response is not None:
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(response, digest)),
            ("X-Refers-To-Page-Id", str(response)),
        ]
        if response_url is not None:
            headers.append(("WARC-Refers-To-Target-URI", header_value(response_url)))
    headers += [
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    kind: str
    page_id: int | None
    url: str | None
    digest: str
    payload_bytes: int
    payload: bytes | None
    refers_to: int | None
    refers_to_url: str | None = None


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in lines.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return {k: v for k, v in pairs}


def read_record(data: bytes) -> Record:
    """A record back from its gzip member; what doesn't fit its digest or lengths is an error."""
    plain = zlib.decompress(data, wbits=31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    if not head.startswith(VERSION):
        raise ValueError("not a WARC record")
    own = _headers(head)
    size = int(own["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    stated, kind = int(_headers(http)["Content-Length"]), own["WARC-Type"]
    digest = own["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != stated or digest_of(payload) != digest):
        raise ValueError("a payload doesn't fit its digest")
    number = {k: int(own[k]) if k in own else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")}
    url, other = (own.get(k) for k in ("WARC-Target-URI", "WARC-Refers-To-Target-URI"))
    return Record(
        kind,
        number["X-Page-Id"],
        None if url is None else header_text(url),
        digest,
        stated,
        payload if kind == "response" else None,
        number["X-Refers-To-Page-Id"],
        None if other is None else header_text(other),
    )


# --- writing -----------------------------------------------------------------------------------


def decided(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, key, html, digest, response, response_url``: the last two name the page whose
    record has the payload, null where it is the page's own.

    Digests of many pages are looked up from a broadcast of those few. Only rows that revisit another
    are joined back, by page_id and digest: no key of that join is frequent unless its rows repeat in
    full.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    digest = F.unhex(F.sha1(html.cast("binary")))
    narrow = written(
        pages.select("page_id", "url", digest.alias("digest")).filter(F.octet_length(html) >= least), "digests"
    )
    last = F.max(F.struct("page_id", "url")).alias("last")
    groups = narrow.groupBy("digest").agg(last, F.count("*").alias("n")).filter("n > 1")
    groups = groups.select(
        "digest", "n", F.col("last.page_id").alias("response"), F.col("last.url").alias("response_url")
    )
    same = narrow.groupBy("page_id", "digest").agg(F.count("*").alias("_n")).drop("_n")
    revisits = (
        by_count(same, written(groups, "groups"), ["digest"])
        .filter(~F.col("page_id").eqNullSafe(F.col("response")) & F.col("response").isNotNull())
        .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "response", "response_url")
    )
    rows = pages.select("page_id", "url", url_key().alias("key"), html.alias("html"), digest.alias("digest"))
    where = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest"))
    return rows.join(written(revisits, "revisits"), where, "left").drop("_page", "_digest")


def by_count(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """Rows joined with a written ``table`` that counts them in ``n``: keys with more than one in
    ``HOT_SHARE`` of the counted rows, of which there are fewer than that, are looked up from a broadcast."""
    total = table.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > F.lit(total)
    few, many = table.filter(hot).drop("n"), table.filter(~hot).drop("n")
    return rows.join(F.broadcast(few), by).unionByName(rows.join(many, by))


CAPTURE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)


def batch_of(kind: T.StructType, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kind)
    types = [to_arrow_type(f.dataType) for f in kind]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=kind.names
    )


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)``; the written table of captures.

    Each task writes archives of its own. A null html is an empty payload.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                places = []
                for key, page, url, html, digest, response, other in zip(
                    *(c.to_pylist() for c in batch.columns)
                ):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{path}/{name}", compression=None)
                    text = base64.b32encode(digest).decode()
                    record = make_record(page, url, html, text, response, other)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(record) + packer.flush()
                    out.write(data)
                    places.append((key, page, name, at, len(data)))
                    at += len(data)
                yield batch_of(CAPTURE, places)
        finally:
            if out is not None:
                out.close()

    make_folder(folder)
    rows = decided(pages, least).select(
        "key", F.col("page_id").cast("long"), "url", F.col("html").cast("binary"), "digest",
        F.col("response").cast("long"), "response_url",
    )
    return written(rows.mapInArrow(write, CAPTURE), "captures")


def make_folder(folder: str) -> None:
    files, path = open_folder(folder)
    files.create_dir(path, recursive=True)


# --- index -------------------------------------------------------------------------------------


PARTS = T.StructType(CAPTURE.fields[:3])


def _rank(key: str, page_id) -> tuple[bytes, bool, int]:
    """How captures are sorted: as Spark sorts strings, by their bytes; a null page comes first."""
    none = page_id is None
    return key.encode("utf-8", "surrogatepass"), not none, 0 if none else int(page_id)


def write_index(captures: DataFrame, folder: str, part: int = PART, lines: int = LINES) -> DataFrame:
    """Sort the captures into parts of compressed blocks; a written table with a row per part:
    ``key, page_id, file``, its first capture and its file.

    Captures are dealt by ranges of key, page and place, so a URL with any number of captures spreads
    over as many parts as it needs.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        held: list[str] = []
        blocks, first, head, at, out = [], None, None, 0, None
        name = f"{uuid.uuid4().hex}.cdx"

        def flush() -> None:
            nonlocal held, at
            data = zlib.compress("\n".join(held).encode("utf-8", "surrogatepass"))
            out.write(data)
            blocks.append([*first, at, len(data)])
            at, held = at + len(data), []

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                    head = line[:2]
                if not held:
                    first = line[:2]
                held.append(json.dumps(line, ensure_ascii=False))
                if len(held) == lines:
                    flush()
        if out is None:
            return
        if held:
            flush()
        directory = zlib.compress(json.dumps(blocks, ensure_ascii=False).encode("utf-8", "surrogatepass"))
        out.write(directory + struct.pack(TRAILER, at, len(directory)))
        out.close()
        yield batch_of(PARTS, [(*head, name)])

    make_folder(folder)
    parts = max(1, -(-captures.count() // part))
    order = ("key", "page_id", "file", "offset")
    dealt = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return written(dealt.select(*CAPTURE.names).mapInArrow(write, PARTS), "index")


class Reader:
    """Range reads of a folder's files, with a few of them kept open."""

    def __init__(self, folder: str) -> None:
        self.files, self.path = open_folder(folder)
        self.open: OrderedDict = OrderedDict()

    def read(self, name: str, offset: int, length: int) -> bytes:
        held = self.open.pop(name, None) or self.files.open_input_file(f"{self.path}/{name}")
        self.open[name] = held
        if len(self.open) > OPEN:
            self.open.popitem(last=False)[1].close()
        return held.read_at(length, offset)

    def size(self, name: str) -> int:
        return self.files.get_file_info(f"{self.path}/{name}").size


class IndexPart:
    """One part of the index: its directory in memory, and the block last read."""

    def __init__(self, reader: Reader, name: str) -> None:
        self.reader, self.name = reader, name
        size = reader.size(name)
        tail = struct.calcsize(TRAILER)
        at, length = struct.unpack(TRAILER, reader.read(name, size - tail, tail))
        blocks = json.loads(zlib.decompress(reader.read(name, at, length)))
        self.firsts = [_rank(key, page) for key, page, _, _ in blocks]
        self.places = [(offset, length) for _, _, offset, length in blocks]
        self.held, self.lines, self.ranks = -1, [], []

    def block(self, number: int) -> None:
        if self.held != number:
            data = zlib.decompress(self.reader.read(self.name, *self.places[number]))
            self.lines = [json.loads(x) for x in data.decode("utf-8", "surrogatepass").split("\n")]
            self.ranks = [_rank(x[0], x[1]) for x in self.lines]
            self.held = number

    def find(self, key: str, page_id, any_page: bool) -> Iterator[list]:
        """The lines of one capture (those that repeat it included), or of all captures of a key."""
        low = (key.encode("utf-8", "surrogatepass"),) if any_page else _rank(key, page_id)
        number = max(0, bisect_left(self.firsts, low) - 1)
        while number < len(self.firsts) and self.firsts[number][: len(low)] <= low:
            self.block(number)
            at = bisect_left(self.ranks, low)
            while at < len(self.ranks) and self.ranks[at][: len(low)] == low:
                yield self.lines[at]
                at += 1
            if at < len(self.ranks):
                return
            number += 1


FOUND = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("refers_to_url", T.StringType()),
    ]
)
ROUTED = T.StructType([T.StructField("part", T.IntegerType()), *CAPTURE.fields[:2]])
#: Bytes of payload after which found records are handed over.
HANDED = 1 << 22


def read_captures(
    wanted: DataFrame, index: DataFrame, archives: str, index_folder: str, any_page: bool = False
) -> DataFrame:
    """The records that ``wanted(key, page_id)`` asks for, read back from the archives.

    With ``any_page`` only the key counts and every capture of it comes. A revisit has no payload but
    the digest and length of the full one, and the page and URL it refers to: see :func:`Archive.follow`. What the index doesn't hold gives
    no row; a request that repeats gives its rows again, and so do captures written several times.
    The list of parts (one entry per ``PART`` captures) is all that each task gets.
    """
    parts = sorted((_rank(r.key, r.page_id), r.file) for r in index.collect())
    firsts, names = [p[0] for p in parts], [p[1] for p in parts]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, page in zip(*(c.to_pylist() for c in batch.columns)):
                low = (key.encode("utf-8", "surrogatepass"),) if any_page else _rank(key, page)
                n = max(0, bisect_left(firsts, low) - 1)
                while n < len(firsts) and firsts[n][: len(low)] <= low:
                    rows.append((n, key, page))
                    n += 1
            yield batch_of(ROUTED, rows)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, records = Reader(index_folder), Reader(archives)
        number, part = -1, None
        for batch in batches:
            out, held = [], 0
            for n, key, page in zip(*(c.to_pylist() for c in batch.columns)):
                if n != number:
                    number, part = n, IndexPart(lines, names[n])
                for _, _, file, offset, length in part.find(key, page, any_page):
                    r = read_record(records.read(file, offset, length))
                    out.append(
                        (key, r.page_id, r.url, r.kind, r.digest, r.payload_bytes, r.payload, r.refers_to,
                         r.refers_to_url)
                    )
                    held += len(r.payload or b"")
                    if held >= HANDED:
                        yield batch_of(FOUND, out)
                        out, held = [], 0
            yield batch_of(FOUND, out)

    asked = wanted.select(F.coalesce("key", F.lit("")).alias("key"), F.col("page_id").cast("long"))
    routed = asked.mapInArrow(route, ROUTED)
    spread = routed.repartitionByRange(max(1, len(names)), "part", "key", "page_id")
    near = spread.sortWithinPartitions("part", "key", "page_id")
    return near.mapInArrow(fetch, FOUND)


@dataclass
class Archive:
    """Pages written as archives with their index, in two folders."""

    folder: str
    captures: DataFrame
    index: DataFrame

    @property
    def index_folder(self) -> str:
        return f"{self.folder}/index"

    @property
    def records(self) -> str:
        return f"{self.folder}/records"

    def lookup(self, urls: DataFrame) -> DataFrame:
        """All captures of each of ``urls(url)``."""
        wanted = urls.select(url_key().alias("key"), F.lit(None).cast("long").alias("page_id"))
        return read_captures(wanted, self.index, self.records, self.index_folder, any_page=True)

    def read(self, wanted: DataFrame) -> DataFrame:
        """The records of ``wanted(key, page_id)``."""
        return read_captures(wanted, self.index, self.records, self.index_folder)

    def follow(self, found: DataFrame) -> DataFrame:
        """``found`` records, those of revisits with the payload they refer to.

        A second lookup reads each response once, by its key and page, and :func:`read_record` has checked
        its payload against its digest. A revisit whose response isn't there, or doesn't fit the digest and
        length that the revisit states, is an error. A response that many revisits share goes out in
        copies, each for ``AT_ONCE`` of them.
        """
        found = written(found, "found")
        on = ["_key", "refers_to", "payload_digest"]
        revisits = found.filter("record_type = 'revisit'").withColumn("_key", url_key("refers_to_url"))
        counts = written(revisits.groupBy(*on).agg(F.count("*").alias("n")), "referred")
        total = counts.agg(F.sum("n")).first()[0] or 0
        hot = (F.col("n") > AT_ONCE) & (F.col("n") * HOT_SHARE > F.lit(total))
        many = counts.filter(hot).select(*on, F.ceil(F.col("n") / AT_ONCE).cast("int").alias("_parts"))
        many = F.broadcast(written(many, "many"))
        parts = F.coalesce("_parts", F.lit(1))
        asked = counts.select(F.col("_key").alias("key"), F.col("refers_to").alias("page_id")).distinct()
        others = self.read(asked).filter("record_type = 'response'")
        others = others.dropDuplicates(["key", "page_id", "payload_digest"]).select(
            F.col("key").alias("_key"),
            F.col("page_id").alias("refers_to"),
            "payload_digest",
            F.struct("payload", "payload_bytes").alias("_other"),
        )
        others = others.join(many, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        spread = revisits.join(many, on, "left").withColumn(
            "_part", F.pmod(F.xxhash64("page_id", "url", "key"), parts).cast("int")
        )
        joined = spread.join(others.drop("_parts"), [*on, "_part"], "left")
        fits = F.col("_other.payload_bytes") == F.col("payload_bytes")
        wrong = F.raise_error(F.lit("a revisit's payload isn't there or doesn't fit its digest"))
        payload = F.when(F.coalesce(fits, F.lit(False)), F.col("_other.payload")).otherwise(wrong.cast("binary"))
        filled = joined.withColumn("payload", payload).select(*found.columns)
        return found.filter("record_type <> 'revisit'").unionByName(filled)


def archive(
    spark: SparkSession, pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES
) -> Archive:
    """Write ``pages(page_id, url, html)`` as archives with an index, into a new folder.

    Every row gets a record, repeated ones too. Of equal payloads the page with the largest id keeps
    it; rows without an id only if none has one. Null URLs have the empty key, null html an empty
    payload. Other columns are not read; an empty table makes an index without parts.
    """
    folder = folder or fresh_path(spark, "warc")
    captures = write_archives(pages, f"{folder}/records", least)
    return Archive(folder, captures, write_index(captures, f"{folder}/index"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages, then look every capture up and read it back: one row per row of ``pages``.

    A revisit's digest and length are those of the payload it refers to, as that was read back.
    """
    made = archive(spark, pages)
    wanted = made.captures.select("key", "page_id").distinct()
    found = made.read(wanted).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
    found = written(found, "found")
    own, others = (found.filter(f"record_type {sign} 'response'") for sign in ("=", "<>"))
    counts = others.groupBy("payload_digest", "refers_to").agg(F.count("*").alias("n"))
    held = own.select(
        "payload_digest", F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("held")
    ).distinct()
    by = ["payload_digest", "refers_to"]
    counts = written(counts.join(held, by, "left"), "referred")
    missing = F.raise_error(F.lit("a revisit's payload isn't there or doesn't fit its length")).cast("long")
    size = F.when(F.col("held") == F.col("payload_bytes"), F.col("held")).otherwise(missing)
    return own.unionByName(by_count(others, counts, by).withColumn("payload_bytes", size).select(*own.columns))
