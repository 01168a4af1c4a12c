"""WARC archives of pages, and a two-level capture index over them.

Archives: one gzip member for each record, so that a record can be read from its offset alone. Of pages with equal
payloads of at least LEAST bytes the one with the smallest page id is a response record, the others are revisit
records that name it and hold the header of the response only. The index: one line for each capture, in the order
of the key (host reversed, then path), in gzip blocks of LINES lines, with a sparse directory of its blocks beside each index
file. The driver knows the first and last key of each file, of at most MOST_FILES. A look-up finds the files of a
key by bisection, then the blocks in their directory, then the lines in a block, and reads records by their ranges; ranges
that are close to each other are read at once.

Payloads are never shuffled: pages are compressed where they are read, as responses in staged archives; digests, sizes
and places decide by joins which pages are revisits; then each staged archive is copied, with short records in the
place of those that are revisits, and removed. Files have names of an attempt's own, and rows name the files of the attempt
that counted, so a lost task is simply run again. Tasks return a row for each capture or file, never a payload.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.llm.common import cut, look_up, open_fs, shared_folder, slices, table, write_file

#: Payloads from so many bytes on are stored once.
LEAST = 100
#: Lines of a block of the index; captures of an index file, about; bytes of an archive, about.
LINES, FILE_LINES, MOST_FILES, ARCHIVE_BYTES = 1000, 50_000, 20_000, 256 << 20
#: Ranges of one archive that lie so close are read at once, up to so many bytes.
GAP, READ = 64 << 10, 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
def url_key(url: str | None) -> str:
    """Reversed host labels, then the path and query: com,example,www)/path?x. Without a host: )/ and the text itself."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return ")/" + shown(url or "")
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return shown(place + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))


def shown(text: str) -> str:
    """Without blanks and control characters: lines then sort as their keys do."""
    return "".join(c for c in text if c > " ")


def record_id(page: int | None) -> str:
    """The record's name: the page id in the last 64 bits of a UUID; a null id has a bit above them."""
    return f"<urn:uuid:{uuid.UUID(int=(1 << 64) if page is None else page & (1 << 64) - 1)}>"


def page_of(name: str) -> int | None:
    number = uuid.UUID(name.strip("<>").rpartition(":")[2]).int
    return None if number >> 64 else number - (1 << 64 if number >> 63 else 0)


def record(page: int | None, url: str | None, payload: bytes | None, digest: str, size: int | None = None, refers_to: int | None = None) -> bytes:
    """A record as its gzip member; without a payload a revisit of ``refers_to``, whose payload has ``size`` bytes."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size if revisit else len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of a record and its payload (None in a revisit). A payload that fails its digest is an error."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    revisit, digest = fields["WARC-Type"] == "revisit", fields["WARC-Payload-Digest"].partition(":")[2]
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} fails its digest")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload": None if revisit else payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None,
    }


class Archives:
    """The archives that a task writes, one after another; rows of what it has put into them."""

    def __init__(self, folder: str):
        self.system, self.path = open_fs(folder)
        self.system.create_dir(self.path, recursive=True)
        self.out, self.name, self.at = None, "", 0

    def put(self, member: bytes) -> tuple[str, int, int]:
        """Archive, offset and length of a member."""
        if self.out is None:
            self.name, self.at = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.system.open_output_stream(f"{self.path}/{self.name}", compression=None)
        self.out.write(member)
        place = self.name, self.at, len(member)
        self.at += len(member)
        if self.at >= ARCHIVE_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.out = None


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=names)


STAGED = "id bigint, url string, size bigint, digest string, archive string, offset bigint, length bigint"


def staged(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Every page as a response record, in archives where pages are read. Null bodies are empty."""

    def run(batches):
        out = Archives(folder)
        for batch in slices(batches):
            done = []
            for page, address, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode()
                digest = hashlib.sha256(data).hexdigest()
                done.append((page, address, len(data), digest, *out.put(record(page, address, data, digest))))
            yield as_batch(done, STAGED)
        out.close()

    return cut(pages.select(F.col(key).cast("bigint").alias("id"), F.col(url).alias("url"), F.col(body).alias("body")).mapInArrow(run, STAGED))


def resolved(rows: DataFrame) -> DataFrame:
    """Adds refers_to (of revisits) and revisit to rows with id, size and digest.

    Rows with null keys never are the response of others unless all rows of the payload have null keys, which then all
    are responses; repeated rows of one key and payload are all responses.
    """
    large = rows.where(F.col("size") >= LEAST)
    groups = cut(large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    found = look_up(large, groups, "digest", "n", rows.count()).withColumn("revisit", F.expr("id IS DISTINCT FROM first AND first IS NOT NULL"))
    found = found.select(*rows.columns, F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit")
    return found.unionByName(rows.where(F.col("size") < LEAST).select(*rows.columns, F.lit(None).cast("bigint").alias("refers_to"), F.lit(False).alias("revisit")))


def members(places: list[tuple[str, int, int]], folder: str):
    """The member at each (archive, offset, length), which are sorted; neighbours are read at once."""
    system, path = open_fs(folder)
    i = 0
    while i < len(places):
        archive, begin, length = places[i]
        j, end = i + 1, begin + length
        while j < len(places) and places[j][0] == archive and places[j][1] - end <= GAP and places[j][1] + places[j][2] - begin <= READ:
            end = places[j][1] + places[j][2]
            j += 1
        with system.open_input_file(f"{path}/{archive}") as file:
            file.seek(begin)
            data = file.read(end - begin)
        for _, offset, length in places[i:j]:
            yield data[offset - begin : offset - begin + length]
        i = j


RECORD = "page_id bigint, url_key string, archive string, offset bigint, length bigint"


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Writes the archives; one row for each record: page_id, url_key, archive, offset, length."""
    first = f"{folder}/staged"
    rows = staged(pages, first, key, url, body)
    archives = max(1, rows.select("archive").distinct().count())

    def run(batches):
        out = Archives(folder)
        for batch in slices(batches):
            found = list(zip(*(c.to_pylist() for c in batch.columns)))
            kept = members([x[4:7] for x in found if not x[8]], first)
            done = []
            for page, address, size, digest, _, _, _, refers_to, revisit in found:
                member = record(page, address, None, digest, size, refers_to) if revisit else next(kept)
                done.append((page, url_key(address), *out.put(member)))
            yield as_batch(done, RECORD)
        out.close()

    columns = [x.split()[0] for x in STAGED.split(", ")] + ["refers_to", "revisit"]
    dealt = resolved(rows).select(*columns).repartition(archives, "archive").sortWithinPartitions("archive", "offset")
    written = cut(dealt.mapInArrow(run, RECORD))
    system, path = open_fs(first)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)
    return written


FILE = "first_key string, last_key string, file string, lines bigint"


@dataclass(frozen=True)
class Index:
    folder: str
    files: list[tuple[str, str, str, int]]  # FILE, in the order of the keys
    archives: int


def index(captures: DataFrame, folder: str) -> Index:
    """Writes the index of captures in ranges of the key: files of blocks, each with its directory."""
    count = captures.count()
    parts = max(1, -(-count // max(FILE_LINES, -(-count // MOST_FILES))))

    def run(batches):
        system, path = open_fs(folder)
        system.create_dir(path, recursive=True)
        name = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}.cdx.gz"
        at, held, found, out = 0, [], [], None
        for batch in slices(batches):
            out = out or system.open_output_stream(f"{path}/{name}", compression=None)
            for key, page, archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(key + " " + json.dumps({"page": page, "archive": archive, "offset": offset, "length": length}))
                if len(held) == LINES:
                    at += put(out, at, held, found)
                    held = []
        if held:
            put(out, at, held, found)
        if out:
            out.close()
            write_file(f"{folder}/{name}.dir", [gzip.compress("\n".join(f"{a} {b} {x} {y}" for a, b, x, y, _ in found).encode(), 6, mtime=0)])
            yield as_batch([(found[0][0], found[-1][1], name, sum(x[4] for x in found))], FILE)

    def put(out, at, lines, found) -> int:
        block = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
        out.write(block)
        found.append((lines[0].split(" ")[0], lines[-1].split(" ")[0], at, len(block), len(lines)))
        return len(block)

    order = ["url_key", "page_id", "archive", "offset"]
    ranged = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    files = ranged.select("url_key", "page_id", "archive", "offset", "length").mapInArrow(run, FILE).collect()  # at most MOST_FILES
    return Index(folder, sorted((tuple(f) for f in files), key=lambda f: f[:2]), captures.select("archive").distinct().count())


def between(firsts: list[str], lasts: list[str], key: str) -> range:
    """Places, in sorted ranges of keys, of those that may hold the key."""
    return range(bisect_left(lasts, key), bisect_right(firsts, key))


def read_range(folder: str, name: str, offset: int | None = None, length: int | None = None) -> bytes:
    system, path = open_fs(f"{folder}/{name}")
    with system.open_input_file(path) as file:
        file.seek(offset or 0)
        return file.read(length) if length is not None else file.read()


RESULT = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def look_up_urls(urls: DataFrame, index: Index, url: str = "url") -> DataFrame:
    """The records of given addresses (a row for each capture of each distinct key; none for unknown addresses)."""
    folder = index.folder
    top = urls.sparkSession.sparkContext.broadcast(index.files)  # at most MOST_FILES rows
    if not index.files:
        return urls.sparkSession.createDataFrame([], RESULT)

    def files(batches):
        firsts, lasts = [f[0] for f in top.value], [f[1] for f in top.value]
        for batch in slices(batches, 5000):
            yield as_batch([(i, key) for key in set(map(url_key, batch.column(0).to_pylist())) for i in between(firsts, lasts, key)], "file int, key string")

    def captures(batches):
        known, name, block, lines = None, "", None, []
        for batch in slices(batches):
            found = []
            for file, key in zip(*(c.to_pylist() for c in batch.columns)):
                if file != known:
                    known, name, block = file, top.value[file][2], None
                    blocks = [x.split(" ") for x in gzip.decompress(read_range(folder, f"{name}.dir")).decode().split("\n")]
                    firsts, lasts = [b[0] for b in blocks], [b[1] for b in blocks]
                for i in between(firsts, lasts, key):
                    if i != block:
                        block, lines = i, gzip.decompress(read_range(folder, name, int(blocks[i][2]), int(blocks[i][3]))).decode().split("\n")
                    low = bisect_left(lines, key + " ")
                    for line in lines[low : bisect_left(lines, key + "!", low)]:
                        place = json.loads(line[len(key) + 1 :])
                        found.append((place["archive"], place["offset"], place["length"]))
                if len(found) >= 10_000:
                    yield as_batch(found, "archive string, offset bigint, length bigint")
                    found = []
            yield as_batch(found, "archive string, offset bigint, length bigint")

    def records(batches):
        for batch in slices(batches):
            places = list(zip(*(c.to_pylist() for c in batch.columns)))
            parsed = map(parse, members(places, folder))
            yield as_batch([(p["page_id"], p["url"], p["payload_bytes"], p["payload_digest"], p["record_type"], p["refers_to"]) for p in parsed], RESULT)

    keys = urls.select(url).mapInArrow(files, "file int, key string").distinct().repartition(len(index.files), "file").sortWithinPartitions("file", "key")
    places = keys.mapInArrow(captures, "archive string, offset bigint, length bigint")
    return places.repartition(index.archives, "archive").sortWithinPartitions("archive", "offset").mapInArrow(records, RESULT)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived and indexed, then looked up by their addresses and read back."""
    pages = table(spark, sf_dir, "pages")
    folder = shared_folder(spark, "warc")
    found = look_up_urls(pages, index(write(pages, folder), folder))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST} AND first <> page_id THEN first END AS refers_to
FROM f
"""
