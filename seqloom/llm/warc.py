"""Web captures written as WARC 1.1 archives, read back, and indexed by an external merge.

Payloads that were seen before become revisit records: of records with equal payloads of at least ``least_bytes`` bytes the one with the
smallest page id is the response. Archives are plain WARC files that Spark's text writer puts down record by record (the
record's own last line feed is the writer's separator), so any store that Spark writes will do and the commit protocol keeps
files whole. Reading parses each file by its content lengths and yields one capture run a file, sorted by URL key, time and id. The
runs are dealt by key range; within a range a loser tree merges the slices of all runs into one ordered history.

Defined results: null html is an empty payload; a null URL is written as ``urn:x-none:``; rows with a null page id are written with a
name-based record id and come back with a null id (as responses unless their payload belongs to a page with an id); rows that
repeat a response's id and payload are responses too; an empty table gives no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import KeyFilter, fresh_path, joined_to_groups, pinned, shuffle_width

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST_DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)
SPAN = 10 * 365 * 86400
RANGE_ROWS = 100_000
#: A file holds at most so many records of ordinary size, or so many bytes of larger ones (one record at least): it is read whole.
FILE_RECORDS, FILE_BYTES = 512, 1 << 26


def record_uuid(page_id: int | None, url: str, digest: str) -> uuid.UUID:
    """A custom (version 8) UUID that holds the page id; a name-based one where there is no id."""
    if page_id is None:
        return uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {digest}")
    bits = page_id & (1 << 64) - 1
    return uuid.UUID(int=(bits >> 16) << 80 | 8 << 76 | (bits >> 4 & 0xFFF) << 64 | 2 << 62 | (bits & 0xF) << 58)


def page_of(value: str) -> int | None:
    u = uuid.UUID(value.strip("<>").removeprefix("urn:uuid:"))
    if u.version != 8:
        return None
    bits = (u.int >> 80) << 16 | (u.int >> 64 & 0xFFF) << 4 | (u.int >> 58 & 0xF)
    return bits - (1 << 64) if bits >> 63 else bits


def captured(page_id: int | None) -> str:
    return (FIRST_DAY + timedelta(seconds=(page_id or 0) % SPAN)).strftime("%Y-%m-%dT%H:%M:%SZ")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:x-none:"


#: Fixed value: scheme, host without a leading www., port, path and query of a URL in lower case.
URL = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:@\[\]]+)(?::([0-9]*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$", re.S)


def url_key(url: str) -> str:
    """Host labels reversed, then path and sorted query, in lower case and without what doesn't tell pages apart. What isn't a
    URL with a host is its own key, in lower case."""
    low = url.lower()
    if not (m := URL.match(low)):
        return low
    host, port, path, query = (x or "" for x in m.groups())
    labels = ",".join(reversed(host.split(".")))
    sorted_query = "&".join(sorted(x for x in query.split("&") if x))
    return labels + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (path.rstrip("/") or "/") + (f"?{sorted_query}" if sorted_query else "")


def record(page_id: int | None, url: str | None, digest: bytes, size: int, payload: bytes | None, response_of: int | None = None) -> bytes:
    """A whole record without its last line feed: a response with its payload, or without one a revisit of ``response_of``."""
    uri, named = clean(url), base32(digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        VERSION,
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <{record_uuid(page_id, uri, named).urn}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {captured(page_id)}",
        f"WARC-Payload-Digest: sha1:{named}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
    ]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_uuid(response_of, '', '').urn}>", f"WARC-Refers-To-Date: {captured(response_of)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "surrogateescape").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def records(raw: memoryview) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """Offset, length, headers and block of each record of an archive, by content lengths alone."""
    at, whole = 0, raw.obj if isinstance(raw.obj, bytes) else bytes(raw)
    while at < len(whole):
        stop = whole.index(b"\r\n\r\n", at)
        named = headers(whole[at:stop])
        if not whole.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        size = int(named["content-length"])
        end = stop + 4 + size
        if whole[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} doesn't end where it should")
        yield at, end + 4 - at, named, memoryview(whole)[stop + 4 : end]
        at = end + 4


def capture(named: dict[str, str], block: memoryview) -> dict[str, Any]:
    """What the index holds of a record; a response's digest is computed anew and must agree with its header."""
    raw = bytes(block)
    cut = raw.index(b"\r\n\r\n")
    http, payload = headers(raw[:cut]), raw[cut + 4 :]
    digest = named["warc-payload-digest"].removeprefix("sha1:")
    kind = named["warc-type"]
    if kind == "response" and (base32(hashlib.sha1(payload).digest()) != digest or len(payload) != int(http["content-length"])):
        raise ValueError(f"{named['warc-record-id']}: payload and headers disagree")
    return {
        "url_key": url_key(named["warc-target-uri"]), "captured_at": named["warc-date"], "page_id": page_of(named["warc-record-id"]), "payload_bytes": int(http["content-length"]),
        "payload_digest": digest, "record_type": kind, "refers_to": page_of(named["warc-refers-to"]) if "warc-refers-to" in named else None,
    }


RECORD_COLUMNS = ("page_id", "url", "digest", "n")


def written(rows: DataFrame, path: str, per_file: int) -> None:
    """``rows`` (RECORD_COLUMNS and ``html`` or, for revisits, ``response``) as archives added to those under ``path``."""
    revisits = "response" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                out = []
                for page, url, digest, n, last in zip(*(c.to_pylist() for c in whole.slice(at, 64).columns), strict=True):
                    out.append(record(page, url, digest, n, None, last) if revisits else record(page, url, digest, n, (last or "").encode()))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    lines = rows.select(*RECORD_COLUMNS, "response" if revisits else "html").mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)


def write(pages: DataFrame, path: str, *, least_bytes: int = 0) -> None:
    """Archives of all rows of ``pages`` (page_id, url, html) under ``path``.

    A revisit needs no payload, so it is written from a narrow table of digests. Pages that a key filter tells from all revisits
    are responses and are written where they are read; only what passes the filter, revisits and a few others, is shuffled.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    base = base.withColumn("digest", F.unhex(F.sha1(F.coalesce("html", F.lit(""))))).withColumn("n", F.coalesce(F.octet_length("html"), F.lit(0)))
    narrow = pinned(base.select(*RECORD_COLUMNS), "payloads")
    sized = narrow.where(F.col("n") >= least_bytes)
    groups = pinned(sized.groupBy("digest").agg(F.min("page_id").alias("response"), F.count("*").alias("rows")).where("rows > 1 AND response IS NOT NULL"), "payload-groups")
    revisits = pinned(joined_to_groups(sized, groups, "digest", "rows", narrow.count()).where("NOT (page_id <=> response)").select(*RECORD_COLUMNS, "response"), "revisits")
    written(revisits, path, FILE_RECORDS)

    keys = revisits.select("page_id", "digest").distinct()
    marked = KeyFilter.of(pinned(keys, "revisit-keys"), "page_id", "digest").mark(base, "maybe", "page_id", "digest")
    known = keys.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"))
    rest = marked.where("maybe").join(known, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_anti")
    responses = marked.where("NOT maybe").unionByName(rest)
    most = narrow.agg(F.max("n")).first()[0] or 0
    ordinary = FILE_BYTES // FILE_RECORDS
    written(responses.where(F.col("n") <= ordinary), path, FILE_RECORDS)
    if most > ordinary:
        written(responses.where(F.col("n") > ordinary), path, max(1, FILE_BYTES // most))


RUN_DDL = "run string, seq long, url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long"
RUN = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in RUN_DDL.split(", "))])


def order_key(row: dict[str, Any]) -> tuple:
    return row["url_key"].encode("utf-8", "surrogateescape"), row["captured_at"], row["page_id"] is not None, row["page_id"] or 0


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """One run a file: its captures with file, offset and length, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name = b.column(0)[k].as_py().rpartition("/")[2]
                found = [capture(named, block) | {"offset": at, "length": size} for at, size, named, block in records(memoryview(b.column(1)[k].as_py()))]
                found.sort(key=order_key)
                rows = [x | {"run": name, "seq": i, "url_key": x["url_key"].encode("utf-8", "replace").decode()} for i, x in enumerate(found)]
                yield pa.RecordBatch.from_pylist(rows, RUN)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, RUN_DDL)


class LoserTree:
    """K sorted iterators as one: each inner node keeps the loser of its match, so a step costs one match a level."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(1, self.k)
        self.winner = self._play(1) if self.k else -1

    def _beats(self, a: int, b: int) -> bool:
        """Whether head a comes before head b; ended runs lose, equal heads keep the order of the runs."""
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and ((x[0], a) <= (y[0], b)))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[Any]:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head[1]
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node:
                if self._beats(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def merged(runs: DataFrame, ranges: int) -> DataFrame:
    """The captures of all runs in global order: ranges of keys in order, and within each what the loser tree gives.

    ``capture`` numbers the captures of a range; together with ``range`` it is the global order.
    """
    wanted = [f.name for f in RUN if f.name != "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches), RUN).select(wanted)  # RANGE_ROWS or so, by run, each run's in its own order
        if not table.num_rows:
            return
        keys = [(u, t, p is not None, p or 0) for u, t, p in zip(*(table.column(c).to_pylist() for c in ("url_key", "captured_at", "page_id")), strict=True)]
        of = table.column("run").combine_chunks().dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        order = np.fromiter(LoserTree([iter(zip(keys[a:b], range(a, b), strict=True)) for a, b in zip(cuts, cuts[1:], strict=False)]), np.int64, len(of))
        here = TaskContext.get().partitionId()
        for at in range(0, len(order), 8192):
            rows = table.take(pa.array(order[at : at + 8192])).combine_chunks()
            number = np.arange(at, at + rows.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), here, np.int32)), pa.array(number), *(c.combine_chunks() for c in rows.columns)], names=["range", "capture", *wanted])

    dealt = runs.repartitionByRange(ranges, "url_key", "captured_at", "page_id").sortWithinPartitions("run", "seq")
    return dealt.mapInArrow(run, "range int, capture long, " + ", ".join(x for x in RUN_DDL.split(", ") if not x.startswith("seq ")))


def write_and_read(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """The ordered capture histories of ``pages`` from archives just written."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, least_bytes=least_bytes)
    runs = pinned(capture_runs(spark, path), "capture-runs")
    return merged(runs, max(shuffle_width(spark), -(-runs.count() // RANGE_ROWS)))
