"""Web archives (WARC/1.1): written by Spark's text sink, read back by byte ranges with boundary-chain verification.

A record is a string and records are parted by the two line ends that the format asks for, so Spark's text sink with these as its line
separator writes valid archives, with the commit protocol that survives lost tasks. Pages with equal payloads are written once: the others
become revisit records that name the first.

To read, files are cut into ranges. Each task looks for the magic in its range and emits every candidate with the place of its successor, which
its header states, and with the place where the chain that begins at it leaves the range (found by pointer jumping inside the range). A payload
may hold magic, even whole records, so candidates prove nothing. Only what can be reached from a file's start is a record: the chains' ends are
matched with the candidates that begin there, and these cross-range pointers are doubled until the end of the file, in about log2(ranges of a file) joins.
A range is then read from the place where the chain enters it.

Defined results: a null or empty payload is a record with an empty one; payloads under MIN_REVISIT bytes are never revisits; rows that repeat a page_id
and its payload are written alike; a row without page_id is a response that none refers to; line ends in a url are written as %0D and %0A; a
record that its file ends before is not returned, nor is what follows bytes that break the chain; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, read, roots, runs, shared_dir, staged

MAGIC, END = b"WARC/1.1\r\n", "\r\n\r\n"
#: Bytes of a range; bytes read of a header at a time; fewest bytes of a payload that is revisited; rows that a join may broadcast.
RANGE, STEP, MIN_REVISIT, HELD = 8 << 20, 1 << 16, 100, 50_000
RECORDS = "path string, at long, record_type string, page_id long, refers_to long, url string, digest string, full_bytes long, payload binary"


def first_copies(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """pages (with _digest, _bytes) plus refers_to: the smallest page_id with the same payload, null where the page is that one itself.

    A payload that very many pages share is found by count: at most HELD payloads hold more than a HELD-th of all rows each, so
    these are broadcast; the others are too, if they are few, or else meet their pages in a shuffle.
    """
    copies = pages.where((F.col("_bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_copies"))
    copies = staged(copies.where("_copies > 1"), "copies")
    total, groups = copies.agg(F.sum("_copies"), F.count("*")).first()
    parts = [F.broadcast(copies)] if groups <= HELD else [F.broadcast(copies.where(F.col("_copies") * HELD > total)), copies.where(F.col("_copies") * HELD <= total)]
    found = []
    for i, part in enumerate(parts):
        pages = pages.join(part.select("_digest", F.col("_first").alias(f"_first{i}")), "_digest", "left")
        found.append(F.col(f"_first{i}"))
    first = F.coalesce(*found)
    return pages.withColumn("refers_to", F.when((first != F.col("page_id")), first))


def records(pages: DataFrame, date: str) -> DataFrame:
    """The archive records of pages (page_id long, url, html) as one string column."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = first_copies(rows.select("*", F.sha2("html", 256).alias("_digest"), F.octet_length("html").alias("_bytes")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit("\r\n\r\n"))
    again = F.col("refers_to").isNotNull()
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.lit("")),
        F.when(again, F.concat(line("WARC-Refers-To", name("refers_to")), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.octet_length(http) + F.when(again, 0).otherwise(F.col("_bytes"))).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header, http, F.when(again, "").otherwise(F.col("html"))).alias("record"))


def write_warc(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) as WARC files, one for each task."""
    records(pages, date).write.option("lineSep", END).text(folder)


@lru_cache(maxsize=8)
def _store(scheme: str, host: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(f"{scheme}://{host}/")


def _open(path: str):
    """A file that Spark listed, opened for reading by ranges."""
    scheme, _, rest = path.partition(":")
    host, name = "", rest
    if rest.startswith("//"):
        host, _, name = rest[2:].partition("/")
    files, root = _store(scheme, host)
    return files.open_input_file(root.rstrip("/") + "/" + name.lstrip("/"))


_LENGTH = re.compile(rb"\r\nContent-Length: *(\d{1,18}) *(?=\r\n)", re.I)


def candidates_in(f, start: int, stop: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, successors) of the magic that begins from start to before stop and whose header states a record that ends inside the file of size bytes."""
    data = f.read_at(min(size, stop + STEP) - start, start)
    at, after, places = data.find(MAGIC), [], []
    while 0 <= at < stop - start:
        head = data.find(b"\r\n\r\n", at)
        while head < 0 and start + len(data) < size:  # a header beyond what was read
            seen = len(data)
            data += f.read_at(min(max(STEP, seen - at), size - start - seen), start + seen)
            head = data.find(b"\r\n\r\n", max(at, seen - 3))
        if head < 0:
            break
        length = _LENGTH.search(data, at, head + 2)
        if length:
            after.append(start + head + 4 + int(length[1]) + 4)
            places.append(start + at)
        at = data.find(MAGIC, at + 1)
    places, after = np.array(places, np.int64), np.array(after, np.int64)
    inside = after <= size
    return places[inside], after[inside]


def chain_ends(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each candidate of a range, the first successor along its chain that is no candidate of the range."""
    to = np.searchsorted(places, after)
    held = (to < len(places)) & (places[np.minimum(to, len(places) - 1)] == after) if len(places) else np.zeros(0, bool)
    return after[roots(np.where(held, to, np.arange(len(places))))] if len(places) else after


def _scan(range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with _open(path) as f:
                    places, after = candidates_in(f, start, min(size, start + range_bytes), size)
                n = len(places)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(places), pa.array(after), pa.array(chain_ends(places, after))], ["path", "start", "at", "after", "leaves"])

    return run


def candidates(spark: SparkSession, folder: str, range_bytes: int) -> DataFrame:
    """path, start (of the range), at, after (its successor) and leaves (where its chain leaves the range) of every candidate."""
    files = spark.read.format("binaryFile").load(folder).where("length > 0")  # names and lengths only
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    dealt = ranges.repartition(partitions(spark), "path", "start")
    return staged(dealt.mapInArrow(_scan(range_bytes), "path string, start long, at long, after long, leaves long"), "candidates")


def entries(found: DataFrame) -> DataFrame:
    """(path, start, at): the candidates at which the chain from a file's start enters a range."""
    ends = found.select("path", F.col("leaves").alias("at")).distinct()
    heads = staged(found.where("at = 0").union(found.where("at > 0").join(ends, ["path", "at"], "leftsemi").select(*found.columns)).select("path", "start", "at", "leaves"), "heads")
    places = heads.select("path", F.col("at").alias("to"))
    jump = heads.select("path", "at", F.col("leaves").alias("to")).join(places, ["path", "to"], "leftsemi").select("path", "at", "to")
    reached, jump = heads.where("at = 0").select("path", "at"), staged(jump, "jumps")
    while jump.take(1):
        more = reached.join(jump, ["path", "at"]).select("path", F.col("to").alias("at"))
        reached = staged(reached.union(more).distinct(), "reached")
        far = jump.select("path", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = staged(jump.join(far, ["path", "to"]).select("path", "at", F.col("far").alias("to")), "jumps")
    return heads.join(reached, ["path", "at"], "leftsemi").select("path", "start", "at")


_PAGE = re.compile(rb"<urn:page:(-?\d+)>")


def _page(value: bytes | None) -> int | None:
    found = _PAGE.fullmatch(value or b"")
    return int(found[1]) if found else None


def parse(record: bytes) -> tuple:
    """record_type, page_id, refers_to, url, digest, full_bytes and payload (None for a revisit) of a record's bytes."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(b": ") for x in head.split(b"\r\n")[1:])}
    http, _, payload = block[:-4].partition(b"\r\n\r\n")
    length = _LENGTH.search(http + b"\r\n")
    kind, text = fields.get(b"warc-type", b"").decode(), lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    digest = text(b"warc-payload-digest")
    return kind, _page(fields.get(b"warc-record-id")), _page(fields.get(b"warc-refers-to")), text(b"warc-target-uri"), digest and digest.removeprefix("sha256:"), int(length[1]) if length else None, None if kind == "revisit" else payload


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by path, range, kind (the entry first) and place; yields the records from the entry on."""
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("full_bytes", pa.int64()), ("payload", pa.binary())])
    opened, f, chain, now = None, None, None, None
    for batch in batches:
        paths = batch.column(0).to_pylist()
        start, kind, at, after = (np.asarray(batch.column(i).fill_null(0)) for i in range(1, 5))
        out, held = [], 0
        for a, b in runs(start, np.array([hash(p) for p in paths])):
            if (paths[a], start[a]) != chain:
                chain, now = (paths[a], start[a]), None
            for i in range(a, b):
                if kind[i] == 0:
                    now = at[i]
                elif now is not None and at[i] == now:
                    if opened != paths[i]:
                        opened, f = paths[i], _open(paths[i])
                    out.append((paths[i], int(at[i]), *parse(f.read_at(int(after[i] - at[i]), int(at[i])))))
                    now, held = after[i], held + int(after[i] - at[i])
                    if held > STEP << 6:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def read_warc(spark: SparkSession, folder: str, range_bytes: int = RANGE) -> DataFrame:
    """The records of the WARC files in folder: path, at, record_type, page_id, refers_to, url, digest (as stated), full_bytes (as stated) and payload (null for a revisit)."""
    found = candidates(spark, folder, range_bytes)
    rows = found.select("path", "start", F.lit(1).alias("kind"), "at", "after").union(entries(found).select("path", "start", F.lit(0).alias("kind"), "at", F.lit(0).cast("long").alias("after")))
    dealt = rows.repartition(partitions(spark), "path", "start").sortWithinPartitions("path", "start", "kind", "at")
    return dealt.mapInArrow(_read, RECORDS)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), folder)
    out = read_warc(spark, folder)
    whole = F.col("payload").isNotNull()
    return out.select(
        "page_id",
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("full_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
