"""WARC archives with a two-level capture index.

Archives: every task writes gzip members, one per record, into files of its own in the shared folder and returns where
each record lies. Files bear a random name, so a task that runs again never touches the files of the first try; only the
captures of the committed try are used.

Index: captures are range-partitioned and sorted by the URL with its host reversed, and cut into compressed blocks of
`BLOCK_LINES` lines; the directory keeps the first and last key and the byte range of each block. A lookup sorts the distinct
keys that are asked for, finds their blocks in the directory by bisection, slice by slice, reads each block once by its range and then
the records of the keys by theirs. A key with many captures spans blocks, which different tasks read.

Payloads of at least `REVISIT_BYTES` bytes with one digest and length are stored once, with the largest page_id; the
other records are revisits that name it.

Defined results: a null html is an empty payload; null and odd URLs sort under their own text, a null one as the empty text; a null
page_id is written, and read, as null and is always a response. Rows that repeat a page_id are records of their own, each with an id
of its own. No pages: no files. Further columns are not looked at.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetgraph.llm.jobs import bounded, fresh_path, joined_by, materialise, written

REVISIT_BYTES = 1000
BLOCK_LINES = 1024
FILE_BYTES = 1 << 30
LEVEL = 4
#: Directory rows that a lookup broadcasts at once; a larger directory is searched slice by slice, each by the keys of its range.
DIRECTORY_ROWS = 200_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sort_key(url: str | None) -> str:
    """The URL with scheme, `www.` and default port dropped and the host's labels reversed: com,example,www)/path?query."""
    url = (url or "").strip().replace("\n", "%0A").replace("\t", "%09").replace("\r", "%0D").replace(" ", "%20")
    scheme, mark, rest = url.partition("://")
    if not mark:
        return url.lower()
    host, tail = rest, ""
    for k, c in enumerate(rest):
        if c in "/?#":
            host, tail = rest[:k], rest[k:]
            break
    host, _, port = host.rpartition("@")[2].lower().partition(":")
    host = host.removeprefix("www.").rstrip(".")
    port = "" if port in ("", "80", "443") else f":{port}"
    tail = tail.partition("#")[0]
    return f"{','.join(reversed(host.split('.')))}{port}){tail if tail.startswith('/') else '/' + tail}".lower()


def record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None, number: str = "", named: bool = True) -> bytes:
    """A record. Its id follows from page and digest, and from `number` for rows that repeat a page.

    length: of the payload, which a revisit does not hold. named: the response has an id that follows from its page; else a revisit names the page alone.
    """
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = lambda page, number="": uuid.uuid5(uuid.NAMESPACE_OID, f"{page}:{digest}{number}")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name(page_id, number)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {sort_safe(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http;msgtype=response",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", *([f"WARC-Refers-To: <urn:uuid:{name(refers_to)}>"] if named else []), f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def sort_safe(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the payload's length (of the original, for a revisit) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return headers, payload, length


def _compress(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Files:
    """Output files of one task, begun anew at a size."""

    def __init__(self, uri: str, suffix: str, limit: int = FILE_BYTES):
        self.fs, self.root = _filesystem(uri)
        self.suffix, self.limit, self.out, self.at, self.name = suffix, limit, None, 0, ""

    def write(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= self.limit:
            self.close()
            self.fs.create_dir(self.root, recursive=True)
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None, buffer_size=1 << 20)
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return self.name, at

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Ranges:
    """Byte ranges of files below a folder; the last few files stay open."""

    def __init__(self, uri: str):
        self.fs, self.root = _filesystem(uri)
        self.open: dict = {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.root}/{name}")
        return self.open[name].read_at(length, offset)


def _html(html: str = "html"):
    return F.coalesce(F.col(html).cast("string"), F.lit(""))


_FILE, _ROW = "_metadata.file_path", "_metadata.row_index"


def _located(pages: DataFrame) -> DataFrame:
    """page_id, url, html and where each row lies: its input file and its number there. Rows that don't come from files are written first."""
    own = (F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _html().alias("html"))
    place = (F.col(_FILE).alias("from"), F.col(_ROW).alias("at"))
    try:
        return pages.select(*own, *place)
    except AnalysisException:  # Spark finds no such column: the rows are not those of files
        return materialise(pages.select(*own), "pages").select("*", *place)


def verdicts(located: DataFrame) -> DataFrame:
    """from, at, refers_to, named, repeated of the rows whose payload another page stores, and of those whose page stands in several rows.

    named: the page that is referred to stands in one row. Only ids, digests and lengths are shuffled; a payload of very many pages meets its response by broadcast.
    """
    payload = F.concat_ws(":", F.sha1("html"), F.octet_length("html"))
    rows = materialise(located.select("from", "at", "page_id", payload.alias("payload"), F.octet_length("html").cast("long").alias("n")), "payload-digests")
    own = rows.groupBy("page_id", "payload").agg(F.count("*").alias("rows"), F.max("n").alias("n"))
    own = written(own.where((F.col("n") >= REVISIT_BYTES) | (F.col("rows") > 1)), "payload-pages")
    first = own.where((F.col("n") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).groupBy("payload").agg(
        F.max("page_id").alias("to"), F.max_by("rows", "page_id").alias("to_rows"), F.count("*").alias("pages"), F.sum("rows").alias("total")
    ).where("pages > 1")
    referring = joined_by(rows, written(first, "payload-responses"), "payload", "total").where("page_id <> to")
    again = own.where("rows > 1").select(F.col("page_id").alias("_p"), F.col("payload").alias("_d"))
    repeated = rows.join(again, rows["page_id"].eqNullSafe(again["_p"]) & (rows["payload"] == again["_d"]), "left_semi")
    both = referring.select("from", "at", F.col("to").alias("refers_to"), (F.col("to_rows") == 1).alias("named"), F.lit(False).alias("repeated"))
    both = both.unionByName(repeated.select("from", "at", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("boolean").alias("named"), F.lit(True).alias("repeated")))
    return both.groupBy("from", "at").agg(F.max("refers_to").alias("refers_to"), F.max("named").alias("named"), F.max("repeated").alias("repeated"))


def _verdict_file(file: str) -> str:
    return hashlib.sha1(file.encode()).hexdigest() + ".verdicts"


def write_verdicts(found: DataFrame, uri: str) -> None:
    """A file below uri for each input file that has verdicts, by row. A task that runs again writes the same file."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        fs, root = _filesystem(uri)
        fs.create_dir(root, recursive=True)
        group = group.select(["at", "refers_to", "named", "repeated"]).sort_by("at")
        with fs.open_output_stream(f"{root}/{_verdict_file(key[0].as_py())}") as out, pa.ipc.new_stream(out, group.schema) as to:
            to.write_table(group)
        return pa.table({"n": [group.num_rows]})

    materialise(found.groupBy("from").applyInArrow(run, "n long"), "verdicts")


class _Verdicts:
    """Verdicts of the input files of a task; the last few are kept."""

    def __init__(self, uri: str):
        self.fs, self.root = _filesystem(uri)
        self.of: dict[str, tuple[np.ndarray, list]] = {}

    def get(self, file: str, at: int) -> tuple[int | None, bool, bool]:
        if file not in self.of:
            if len(self.of) >= 4:
                self.of.pop(next(iter(self.of)))
            path = f"{self.root}/{_verdict_file(file)}"
            self.of[file] = (np.zeros(0, np.int64), [])
            if self.fs.get_file_info(path).is_file:
                with self.fs.open_input_stream(path) as source, pa.ipc.open_stream(source) as reader:
                    t = reader.read_all()
                    self.of[file] = (t.column("at").to_numpy(), [t.column(c) for c in ("refers_to", "named", "repeated")])
        rows, columns = self.of[file]
        k = int(np.searchsorted(rows, at))
        if k == len(rows) or rows[k] != at:
            return None, False, False
        return tuple(c[k].as_py() for c in columns)


def write_archives(pages: DataFrame, uri: str) -> DataFrame:
    """Writes a record for every row below uri; returns the captures: key, page_id, file, offset, length.

    Payloads go from the scan to the archives and through no shuffle or join: what is known of a row lies in a file for each input file, by the row's number.
    """
    located = _located(pages)
    write_verdicts(verdicts(located), f"{uri}-verdicts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, known = _Files(uri, ".warc.gz"), _Verdicts(f"{uri}-verdicts")
        for batch in batches:
            found = []
            for page, url, html, file_, at_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refers, named, repeated = known.get(file_, at_)
                payload = html.encode()
                data = _compress(record(page, url, payload, len(payload), hashlib.sha1(payload).hexdigest(), refers, f":{uuid.uuid4().hex}" if repeated else "", bool(named)))
                name, at = files.write(data)
                found.append((sort_key(url), page, name, at, len(data)))
            yield _batch(found, (("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())))
        files.close()

    return materialise(bounded(located).mapInArrow(run, "key string, page_id long, file string, offset long, length long"), "captures")


def _batch(rows: list[tuple], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)], [n for n, _ in columns])


def write_index(captures: DataFrame, uri: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the sorted, compressed capture blocks below uri; returns the directory: first_key, last_key, file, offset, length, lines."""
    columns = (("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, rest = _Files(uri, ".cdx.gz"), []

        def block(rows: list[tuple]) -> tuple:
            data = _compress("".join("\t".join("" if v is None else str(v) for v in r) + "\n" for r in rows).encode())
            name, at = files.write(data)
            return rows[0][0], rows[-1][0], name, at, len(data), len(rows)

        for batch in batches:
            rest += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            found = []
            while len(rest) >= block_lines:
                found.append(block(rest[:block_lines]))
                rest = rest[block_lines:]
            yield _batch(found, columns)
        if rest:
            yield _batch([block(rest)], columns)
        files.close()

    order = ("key", "page_id", "file", "offset")
    ordered = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ordered.mapInArrow(run, "first_key string, last_key string, file string, offset long, length long, lines long"), "directory")


def _lines(data: bytes) -> list[tuple[str, str, str, int, int]]:
    rows = (line.split("\t") for line in gzip.decompress(data).decode().split("\n")[:-1])
    return [(key, page, name, int(at), int(n)) for key, page, name, at, n in rows]


_READ = (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()))
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _read_record(raw: bytes) -> tuple:
    headers, payload, length = parse(gzip.decompress(raw))
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of page {headers['X-Page-Id']} is damaged")
    refers = headers.get("X-Refers-To-Page")
    return int(headers["X-Page-Id"]) if headers["X-Page-Id"] else None, length, digest, kind, int(refers) if refers else None, headers["WARC-Target-URI"]


def read_all(directory: DataFrame, index_uri: str, archive_uri: str) -> DataFrame:
    """Every record of the archives, by way of the index: its blocks, then the records, each by a range read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, archive = _Ranges(index_uri), _Ranges(archive_uri)
        for batch in batches:
            for name, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                yield _batch([_read_record(archive.read(f, a, m)) for _, _, f, a, m in _lines(index.read(name, at, n))], _READ)

    n = directory.sparkSession.sparkContext.defaultParallelism
    spread = directory.repartition(max(n, int(directory.count() // 64)), "first_key", "file", "offset")
    return spread.mapInArrow(run, READ_SCHEMA)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sort_key(u) for u in batch.column(0).to_pylist()], pa.string())], ["key"])


def _find_blocks(shared):
    """Rows (file, offset, length, key) of the blocks that may hold each key, by bisection in a slice of the directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, rows = shared.value
        for batch in batches:
            found = []
            for key in batch.column(0).to_pylist():
                at = max(0, bisect.bisect_left(firsts, key) - 1)
                while at < len(rows) and rows[at][0] <= key:
                    if rows[at][1] >= key:
                        found.append((*rows[at][2:], key))
                    at += 1
            yield _batch(found, (("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("key", pa.string())))

    return run


def lookup(directory: DataFrame, urls: DataFrame, index_uri: str, archive_uri: str, url: str = "url") -> DataFrame:
    """The records of each distinct URL of urls, every record once. A null URL asks for records without one.

    The keys lie sorted in a table, so that a slice of the directory meets only those of its own range. A block is read by one task,
    with the keys asked of it (no more than it has lines).
    """
    spark, out = directory.sparkSession, None
    asked = urls.select(F.col(url).cast("string").alias("url")).distinct().mapInArrow(_keys, "key string").distinct()
    asked = materialise(asked.repartitionByRange("key").sortWithinPartitions("key"), "asked")
    slices = max(1, -(-directory.count() // DIRECTORY_ROWS))
    ranked = directory.repartitionByRange(slices, "first_key", "last_key").withColumn("slice", F.spark_partition_id()) if slices > 1 else directory.withColumn("slice", F.lit(0))
    ranked = materialise(ranked, "directory") if slices > 1 else ranked
    for s in range(slices):
        rows = ranked.where(F.col("slice") == s).orderBy("first_key", "last_key", "file", "offset").select("first_key", "last_key", "file", "offset", "length").collect()  # about DIRECTORY_ROWS
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(([r["first_key"] for r in rows], [tuple(r) for r in rows]))
        part = asked.where(F.col("key").between(rows[0]["first_key"], max(r["last_key"] for r in rows))).mapInArrow(_find_blocks(shared), "file string, offset long, length long, key string")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], READ_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, archive = _Ranges(index_uri), _Ranges(archive_uri)
        for batch in batches:
            for name, at, n, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = set(keys)
                yield _batch([_read_record(archive.read(f, a, m)) for k, _, f, a, m in _lines(index.read(name, at, n)) if k in own], _READ)

    blocks = materialise(out.groupBy("file", "offset", "length").agg(F.collect_set("key").alias("keys")), "blocks")
    n = spark.sparkContext.defaultParallelism
    return blocks.repartition(max(n, int(blocks.count() // 64)), "file", "offset").mapInArrow(read, READ_SCHEMA)


def archive(pages: DataFrame) -> tuple[DataFrame, str, str]:
    """Writes archives and index into the shared folder: the directory and the two folders."""
    at = fresh_path(pages.sparkSession, "warc")
    directory = write_index(write_archives(pages, f"{at}/archive"), f"{at}/index")
    return directory, f"{at}/index", f"{at}/archive"


def op8_warc(spark, sf_dir: str) -> DataFrame:
    from assetgraph.llm.jobs import table

    pages = table(spark, sf_dir, "pages")
    directory, index, archives = archive(pages)
    return lookup(directory, pages, index, archives)


ORACLE = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, ''))) as payload_bytes, url from pages),
first as (select payload_digest, payload_bytes, max(page_id) as m from p where payload_bytes >= {REVISIT_BYTES} group by 1, 2)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest, case when m is null or m = page_id then 'response' else 'revisit' end as record_type,
       case when m is null or m = page_id then null else m end as refers_to, coalesce(url, '') as url
from p left join first using (payload_digest, payload_bytes)"""
