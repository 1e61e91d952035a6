"""WARC archives with a two-level capture index.

Pages become gzip members of WARC files, one record each. The first of
records with equal payloads is a response, the others are revisits. Captures
are indexed by reversed-host URL key: index lines are range-sorted and cut
into compressed blocks, and a sparse directory holds the first and last key
of each block. The directory is in parts, one for each partition of the sort.
A lookup finds a key's part by bisection over the parts' bounds, searches the
part's entries by bisection, unpacks only the blocks that may hold the key,
and reads the records' byte ranges.

All files lie in a folder that every executor shares, reached through the
file system its URI names (local path, HDFS or object store). An archive's
name has the attempt that wrote it, so a retried or speculative task never
replaces a file whose offsets are in the index; files of attempts that failed
are in no index line and are deleted once the others stand.

Defined results: null html is an empty payload; of equal payloads the
smallest page_id (nulls last), then the smallest url, is the response, one
row of several that are equal in all three; null urls have the empty key; a
page_id that repeats with other payloads has several captures; an empty
table gives no archives and no rows; further columns are left out; a payload
of any length is one record, held whole by the task that writes or reads it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import shared_folder, shuffle_partitions, written

#: Index lines in a compressed block; payload bytes that an archive holds about.
LINES, ARCHIVE = 1024, 64 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "key string, page_id long, url string, archive string, offset long, length long"
BLOCKS = "block string, first_key string, last_key string, n long, data binary"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: com,example)/a?b."""
    if not url:
        return ""
    url = re.sub(r"[\t\r\n]", " ", url.strip().lower())
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    query = f"?{'&'.join(sorted(parts.query.split('&')))}" if parts.query else ""
    return f"{labels}{f':{port}' if port and port not in (80, 443) else ''}){parts.path or '/'}{query}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int | None, str | None] | None) -> bytes:
    """One WARC record; a revisit carries no payload, only what it refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if refers_to else http + payload
    line = lambda value: re.sub(r"[\r\n]", "", value or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {page_urn(page_id, url)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {line(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {page_urn(*refers_to)}", f"WARC-Refers-To-Target-URI: {line(refers_to[1])}",
            f"X-Refers-To-Page-ID: {'' if refers_to[0] is None else refers_to[0]}",
        ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def page_urn(page_id: int | None, url: str | None) -> str:
    name = hashlib.md5(f"{page_id} {url}".encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>"


def parsed(member: bytes) -> dict:
    """A record's fields, from its gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    number = lambda name: int(fields[name]) if fields.get(name) else None
    payload = body.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    return {
        "page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "payload": payload,
        # A response's figures come from the payload read, a revisit's from its header.
        "payload_bytes": number("X-Payload-Length") if payload is None else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if payload is None else digest(payload),
        "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"),
    }


def store(uri: str):
    """(file system, path) of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes the archives; returns the capture lines (a written table).

    Payloads under ``least`` bytes are always responses. Which record of
    equal payloads is the response is decided from digests alone; only
    payloads that occur more than once make up that table.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    size = F.octet_length("html")
    slim = rows.select("page_id", "url", F.sha1(F.col("html").cast("binary")).alias("sha"), size.alias("size"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    groups = slim.groupBy("sha").agg(first.alias("first"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("size"))
    groups = written(spark, groups, "warc-payloads")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    twice = written(spark, groups.where((F.col("n") > 1) & (F.col("size") >= least)).select("sha", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.lit(True).alias("repeats")), "warc-repeats")
    # A payload may be a third of all pages: both sides are salted.
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(16))
    marked = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("salt", salt)
    salted = twice.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    marked = marked.join(salted, ["sha", "salt"], "left").drop("sha", "salt")
    archives = max(1, shuffle_partitions(spark), -(-total // ARCHIVE))
    # Rows that are equal in all that decides lie in one task, which picks one.
    dealt = marked.repartition(archives, F.xxhash64("page_id", "url")).sortWithinPartitions("page_id", "url")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        system, root = store(folder)
        system.create_dir(root, recursive=True)
        at, done, answered, out = 0, 0, set(), None
        for pdf in frames:
            lines = []
            for r in pdf.astype({"page_id": "Int64", "first_id": "Int64"}).itertuples(index=False):
                key = None if pd.isna(r.page_id) else int(r.page_id)
                first_id = None if pd.isna(r.first_id) else int(r.first_id)
                payload = r.html.encode("utf-8", "surrogatepass")
                refers = None
                if r.repeats is True:
                    mine = (key, r.url, hashlib.sha1(payload).digest())
                    if (key, r.url) != (first_id, r.first_url) or mine in answered:
                        refers = (first_id, r.first_url)
                    answered.add(mine)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(key, r.url, payload, refers)) + packer.flush()
                out = out or system.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                lines.append((url_key(r.url), key, r.url, name, at, len(member)))
                at += len(member)
            done += len(lines)
            yield pd.DataFrame(lines, columns=[c.split()[0] for c in INDEX.split(", ")]).astype({"page_id": "Int64"})
        if out:
            out.close()

    captures = written(spark, dealt.mapInPandas(write, INDEX), "warc-captures")
    drop_strays(captures, folder)
    return captures


def drop_strays(captures: DataFrame, folder: str) -> None:
    """Deletes archives that no capture line names: those of attempts that did not count."""
    from pyarrow import fs

    named = {r["archive"] for r in captures.select("archive").distinct().collect()}  # one for each task that wrote
    if named:
        system, root = store(folder)
        for found in system.get_file_info(fs.FileSelector(root)):
            if found.base_name.endswith(".warc.gz") and found.base_name not in named:
                system.delete_file(found.path)


def line_of(r: tuple) -> str:
    """Index lines are tab-separated; the sort key comes first."""
    return "\t".join("" if x is None or x is pd.NA else str(x).replace("\t", " ").replace("\n", " ") for x in r)


def write_index(spark: SparkSession, captures: DataFrame, lines: int = LINES) -> tuple[DataFrame, DataFrame]:
    """(blocks, directory): compressed sorted blocks, and where each begins and ends."""
    ordered = captures.repartitionByRange(shuffle_partitions(spark), "key", "page_id", "archive", "offset").sortWithinPartitions("key", "page_id", "archive", "offset")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def block() -> pd.DataFrame:
            data = zlib.compress("\n".join(map(line_of, held)).encode("utf-8", "surrogatepass"))
            return pd.DataFrame({"block": [f"{part:06d}-{number:06d}"], "first_key": [held[0][0]], "last_key": [held[-1][0]], "n": [len(held)], "data": [data]})

        for pdf in frames:
            for row in pdf.astype({"page_id": "Int64"}).itertuples(index=False, name=None):
                held.append(row)
                if len(held) == lines:
                    yield block()
                    number, held = number + 1, []
        if held:
            yield block()

    blocks = written(spark, ordered.mapInPandas(pack, BLOCKS), "warc-index")
    return blocks, written(spark, blocks.select("block", "first_key", "last_key", "n"), "warc-directory")


def unpacked(blocks: DataFrame) -> DataFrame:
    """All index lines of some blocks."""

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for data in pdf["data"]:
                rows = [x.split("\t") for x in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")]
                frame = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
                frame["page_id"] = pd.to_numeric(frame["page_id"].replace("", None)).astype("Int64")
                yield frame.astype({"offset": "int64", "length": "int64"})

    return blocks.select("data").mapInPandas(lines, INDEX)


def read_records(spark: SparkSession, lines: DataFrame, folder: str) -> DataFrame:
    """Range reads: the record of every index line, in file order of each archive."""

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = store(folder)
        name, source = None, None
        for pdf in frames:
            rows = []
            for archive, offset, length in zip(pdf["archive"], pdf["offset"], pdf["length"], strict=True):
                if archive != name:
                    if source:
                        source.close()
                    name, source = archive, system.open_input_file(f"{root}/{archive}")
                rows.append(parsed(source.read_at(int(length), int(offset))))
            if rows:
                yield pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})
        if source:
            source.close()

    ordered = lines.select("archive", "offset", "length").repartition(shuffle_partitions(spark), "archive").sortWithinPartitions("archive", "offset")
    return ordered.mapInPandas(fetch, RECORDS)


def blocks_of(keys: list[str], first: list[str], last: list[str]) -> list[tuple[int, int]]:
    """For each key the range of blocks that may hold it, by bisection.

    ``first`` and ``last`` are the directory's keys in block order.
    """
    return [(bisect_left(last, k), bisect_right(first, k)) for k in keys]


def lookup(spark: SparkSession, urls: DataFrame, blocks: DataFrame, directory: DataFrame, folder: str, url: str = "url") -> DataFrame:
    """Records captured under any of the urls' keys.

    The driver holds the bounds of the directory's parts only, two keys for
    each partition of the index's sort; a part's entries meet the keys that
    may be in it in a task of their own.
    """

    @F.pandas_udf("string")
    def key(urls: pd.Series) -> pd.Series:
        return pd.Series([url_key(u) for u in urls.array], dtype=object)

    entries = directory.withColumn("part", F.substring_index("block", "-", 1))
    held = entries.groupBy("part").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).orderBy("part").collect()
    parts, first, last = ([r[c] for r in held] for c in ("part", "first", "last"))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            keys = pdf["key"].tolist()
            found = [(k, parts[j]) for k, (a, b) in zip(keys, blocks_of(keys, first, last), strict=True) for j in range(a, b)]
            yield pd.DataFrame(found, columns=["key", "part"])

    def search(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        names, keys = part["block"].tolist(), asked["key"].tolist()
        found = [(k, names[j]) for k, (a, b) in zip(keys, blocks_of(keys, part["first_key"].tolist(), part["last_key"].tolist()), strict=True) for j in range(a, b)]
        return pd.DataFrame(found, columns=["key", "block"])

    wanted = urls.select(key(F.col(url)).alias("key")).distinct().mapInPandas(route, "key string, part string")
    hits = entries.groupBy("part").cogroup(wanted.groupBy("part")).applyInPandas(search, "key string, block string")
    hits = written(spark, hits, "warc-hits")
    lines = unpacked(blocks.join(hits.select("block").distinct(), "block", "left_semi"))
    return read_records(spark, lines.join(hits.select("key").distinct(), "key", "left_semi"), folder)


def archived(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(blocks, directory, folder) of all pages, written to a shared folder."""
    folder = folder or shared_folder(spark, "warc")
    return *write_index(spark, write_archives(spark, pages, folder)), folder
