"""Web archives with revisit records, and a two-level capture index over them.

Records are written as WARC 1.1, each compressed on its own, into archives of bounded size below a
folder that all executors share. Captures are sorted by their reversed-host key and
cut into compressed blocks; each index file ends in a sparse directory of its blocks (first key,
place, size), and the files' first keys are the level above. A lookup bisects the
files, then the directory, reads one block by its range, and then the record by its range.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rayscape.llm.arrowio import slices
from rayscape.llm.components import dealt_join
from rayscape.llm.scratch import Scratch, arrow_batches, shuffle_width

LEAST_REVISIT = 100  # bytes; smaller payloads are always written in full
ARCHIVE_BYTES = 64 << 20
BLOCK_ENTRIES = 512
STRETCH = 16 << 20  # of an archive that one task reads in order
CACHED = 32  # blocks and directories kept by a task
DATE = "2024-01-01T00:00:00Z"


# -- keys and records ----------------------------------------------------------------


def surt(url: str | None) -> str:
    """The key of a URL: its host's labels from the last to the first, then path and query; no scheme, no default port, no fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ")" + url
    labels = ",".join(reversed(host.split("."))) if host else ""
    if port and (parts.scheme.lower(), port) not in (("http", 80), ("https", 443)):
        labels += f":{port}"
    return f"{labels}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def header_value(text: str) -> str:
    """A value that can't end its header line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers, HTTP headers and payload of one record; an error if they don't fit together."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    size = int(headers["Content-Length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("a WARC record whose length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    return {"headers": headers, "http": fields, "payload": payload}


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# -- archives ------------------------------------------------------------------------


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of (page_id, url, html, digest, first); returns (key, page_id, file, offset, length).

    A task that is run again writes files of other names, so none is ever half replaced.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, name, at, n = None, "", 0, 0
        stem = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
        for b in slices(batches, "html"):
            entries = []
            for page_id, url, html, digest, first, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "revisit"))):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at, n = f"{stem}-{n:03d}.warc.gz", 0, n + 1
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                data = gzipped(record(page_id, url, html.encode(), digest, first, revisit))
                out.write(data)
                entries.append((surt(url), page_id, name, at, len(data)))
                at += len(data)
            cols = list(zip(*entries))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()])], ["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return rows.mapInArrow(work, "key string, page_id bigint, file string, offset bigint, length bigint")


def read_records(places: DataFrame, folder: str, tasks: int, payloads: bool = False) -> DataFrame:
    """Reads the records at (file, offset, length) by their ranges, in order within each stretch of an archive."""
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if payloads else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        name, archive = None, None
        for b in batches:
            for start in range(0, b.num_rows, 64):
                part, out = b.slice(start, 64), []
                for file, offset, length in zip(*(part.column(c).to_pylist() for c in ("file", "offset", "length"))):
                    if file != name:
                        if archive is not None:
                            archive.close()
                        name, archive = file, system.open_input_file(f"{root}/{file}")
                    r = parse(zlib.decompress(archive.read_at(length, offset), 31))
                    h, revisit = r["headers"], r["headers"]["WARC-Type"] == "revisit"
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(r["http"]["Content-Length"])
                    if not revisit and (hashlib.sha256(r["payload"]).hexdigest(), len(r["payload"])) != (digest, size):
                        raise ValueError(f"{file}: the record at {offset} doesn't match its digest")
                    page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                    row = (int(page) if page else None, h.get("WARC-Target-URI"), size, digest, h["WARC-Type"], int(refers) if refers else None)
                    out.append(row + ((r["payload"],) if payloads else ()))
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names[: 6 + payloads])

    return places.repartition(tasks, F.col("file"), F.expr(f"offset div {STRETCH}")).sortWithinPartitions("file", "offset").mapInArrow(work, schema)


# -- index ---------------------------------------------------------------------------


def order_key(key: str, page_id: int | None) -> tuple[str, int]:
    """Ids without a value come first, as Spark sorts them."""
    return key, -(1 << 63) - 1 if page_id is None else page_id


def write_index(captures: DataFrame, folder: str, tasks: int) -> list[tuple[tuple[str, int], str]]:
    """Sorts captures over index files; returns each file's first key and name, in order: one pair a file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.idx"
        out, directory, held, first, at = None, [], [], None, 0

        def flush() -> None:
            nonlocal at, held
            data = zlib.compress(json.dumps(held).encode(), 5)
            out.write(data)
            directory.append([held[0][0], held[0][1], at, len(data)])
            at += len(data)
            held = []

        for b in batches:
            for entry in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length"))):
                if out is None:
                    out, first = system.open_output_stream(f"{root}/{name}", compression=None), entry[:2]
                held.append(entry)
                if len(held) == BLOCK_ENTRIES:
                    flush()
        if out is None:
            return
        if held:
            flush()
        data = zlib.compress(json.dumps(directory).encode(), 5)
        out.write(data)
        out.write(at.to_bytes(8, "big") + len(data).to_bytes(8, "big"))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first[0]]), pa.array([first[1]], pa.int64())], ["name", "key", "page_id"])

    dealt = captures.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")
    files = dealt.mapInArrow(work, "name string, key string, page_id bigint").collect()  # one row a file
    return sorted((order_key(r.key, r.page_id), r.name) for r in files)


class Index:
    """Lookups in index files, with the last blocks and directories kept."""

    def __init__(self, folder: str, files: list[tuple[tuple[str, int], str]]):
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.first, self.names = [k for k, _ in files], [n for _, n in files]
        self.kept: OrderedDict = OrderedDict()

    def _keep(self, what, make):
        if what in self.kept:
            self.kept.move_to_end(what)
        else:
            self.kept[what] = make()
            while len(self.kept) > CACHED:
                self.kept.popitem(last=False)
        return self.kept[what]

    def _directory(self, name: str) -> tuple[list, list]:
        with self.system.open_input_file(f"{self.root}/{name}") as f:
            end = f.read_at(16, f.size() - 16)
            rows = json.loads(zlib.decompress(f.read_at(int.from_bytes(end[8:], "big"), int.from_bytes(end[:8], "big"))))
        return [order_key(*r[:2]) for r in rows], rows

    def _block(self, name: str, offset: int, length: int) -> tuple[list, list]:
        with self.system.open_input_file(f"{self.root}/{name}") as f:
            rows = json.loads(zlib.decompress(f.read_at(length, offset)))
        return [order_key(*r[:2]) for r in rows], rows

    def find(self, key: str, page_id: int | None) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of each capture of that key and page."""
        wanted = order_key(key, page_id)
        k = max(0, bisect.bisect_left(self.first, wanted) - 1)
        while k < len(self.names) and self.first[k] <= wanted:
            name = self.names[k]
            firsts, rows = self._keep(name, lambda: self._directory(name))
            d = max(0, bisect.bisect_left(firsts, wanted) - 1)
            while d < len(rows) and firsts[d] <= wanted:
                keys, entries = self._keep((name, d), lambda: self._block(name, rows[d][2], rows[d][3]))
                i = bisect.bisect_left(keys, wanted)
                while i < len(keys) and keys[i] == wanted:
                    yield tuple(entries[i][2:5])
                    i += 1
                d += 1
            k += 1


def lookup(keys: DataFrame, folder: str, files: list, tasks: int) -> DataFrame:
    """(file, offset, length) of the captures of each distinct (key, page_id)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, files)
        for b in batches:
            out = [x for key, page in zip(b.column("key").to_pylist(), b.column("page_id").to_pylist()) for x in index.find(key, page)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, [pa.string(), pa.int64(), pa.int64()])], ["file", "offset", "length"])

    dealt = keys.distinct().repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")
    return dealt.mapInArrow(work, "file string, offset bigint, length bigint")


def keyed(pages: DataFrame) -> DataFrame:
    """(key, page_id) of each page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b.column("url").to_pylist()], pa.string()), b.column("page_id")], ["key", "page_id"])

    return pages.select("url", F.col("page_id").cast("long")).mapInArrow(work, "key string, page_id bigint")


class Archive:
    """Archives and index of a table of pages."""

    def __init__(self, spark: SparkSession, root: str, files: list):
        self.spark, self.root, self.files = spark, root, files

    @classmethod
    def write(cls, pages: DataFrame) -> Archive:
        """Archives (page_id, url, html). Null html is an empty payload, and a null url has the empty key.

        Very long payloads are records like any other; other columns aren't read, and an empty table gives an empty archive.
        Of rows with equal payloads of LEAST_REVISIT bytes or more those with the smallest id are responses
        and all others revisit it; rows that repeat that id are responses too, and so are rows with no id if no other row has the payload.
        """
        spark = pages.sparkSession
        scratch = Scratch(spark, "warc")
        width = shuffle_width(spark)
        rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
        rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
        copies = rows.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        # ids and digests alone meet by digest, in a join that Spark can split where one payload is a third of all; payloads are dealt by id and digest
        again = dealt_join(rows.select("page_id", "digest"), copies, ["digest"]).filter("not page_id <=> first")
        again = again.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "first").distinct()
        typed = rows.join(again.hint("merge"), F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left")
        typed = typed.select("page_id", "url", "html", "digest", "first", F.col("first").isNotNull().alias("revisit"))
        with arrow_batches(spark):
            captures = scratch.save(write_archives(typed, scratch.path("archives")), "captures")
            files = write_index(captures, scratch.path("index"), width)
        scratch.drop("captures")
        return cls(spark, scratch.root, files)

    def read(self, pages: DataFrame, payloads: bool = False) -> DataFrame:
        """Records of the given (page_id, url), found through the index."""
        width = shuffle_width(self.spark)
        places = lookup(keyed(pages), f"{self.root}/index", self.files, width)
        return read_records(places, f"{self.root}/archives", width, payloads)
