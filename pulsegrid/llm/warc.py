"""WARC archives: written by Spark's text writer, read back through a verified chain of record boundaries.

A record says how long it is, so each names the offset of its successor. Reading is split anywhere: a task takes every
"WARC/1." at the start of a line for a candidate and emits (offset, successor). Payloads may hold such lines too, so a
candidate counts only if the chain from the file's start reaches it. Inside a split the task follows its candidates to
where they leave it; across splits the chain is followed by pointer jumping, doubling the reach in every round.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pulsegrid.llm.common import BATCH_BYTES, map_arrow, table, utf8
from pulsegrid.sources.stage import materialise, new_path

MAGIC = b"WARC/1."
END = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"

SPLITS_TO_SEND = 50_000
"""The table of splits is sent to every task up to this many rows (under 20 MB); beyond, lines are shuffled to it."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ------------------------------------------------------------------- writing
def with_digest(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = [digest(b) for b in batch.column("_text").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "_text")), pa.array(sums, pa.string())], names=["page_id", "url", "payload", "digest"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), utf8(html).alias("_text"))
    return map_arrow(rows, run, "page_id long, url string, payload binary, digest string")


def write_warc(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> None:
    """One record per row. Of equal payloads of at least `min_bytes`, the largest page_id is the response; the others are
    revisits without a payload that refer to it. Null html is an empty payload, a null url an empty one; line breaks in a url are
    escaped. Rows that share the response's id are responses too; a null page_id is never referred to.

    Only ids and digests are grouped; payloads move only if the table of repeated digests is too large for Spark to send.
    """
    rows = with_digest(pages, page_id, url, html)
    groups = rows.select("page_id", "digest").where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("digest").alias("n"))
    firsts = materialise(groups.where("n > 1 and first is not null").select("digest", "first"), "repeated-payloads")
    revisit = F.col("first").isNotNull() & (F.length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), F.when(revisit, line("WARC-Refers-To", urn(F.col("first")))).otherwise(""),
        line("Content-Type", F.lit("text/html")), line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.length("payload")).cast("string")), F.lit("\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    rows.join(firsts, "digest", "left").select(F.concat(head, body).alias("value")).write.option("lineSep", END).text(path)


# ------------------------------------------------------------------- reading
def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line's bytes without its "\\n", in order inside a split. One byte ends a line, so splits agree wherever they are cut."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Consecutive lines of one split; each group must be used up before the next."""
    names = None

    def rows() -> Iterator[tuple]:
        nonlocal names
        for b in batches:
            names = [f for f in b.schema.names if f != "line"]
            keys = zip(*(b.column(n).to_pylist() for n in names), strict=True)
            yield from zip(keys, b.column("line").to_pylist(), strict=True)

    held = rows()
    row = next(held, None)

    def group(key: tuple) -> Iterator[bytes]:
        nonlocal row
        while row is not None and row[0] == key:
            yield row[1]
            row = next(held, None)

    while row is not None:
        key = row[0]
        lines = group(key)
        yield key, lines
        for _ in lines:
            pass


@dataclass
class Scan:
    """What one split knows of its candidates; offsets count from the split's first whole line."""

    size: int = 0
    head_end: int | None = None
    head_length: int | None = None
    found: list[tuple[int, int]] = field(default_factory=list)
    open: list[tuple[int, int | None]] = field(default_factory=list)


def _length(line: bytes) -> int | None:
    """The value of a Content-Length line."""
    if line[:15].lower() != b"content-length:":
        return None
    value = line[15:].strip()
    return int(value) if value.isdigit() and len(value) < 19 else None


def scan(lines: Iterator[bytes]) -> Scan:
    s = Scan()
    waiting: list[int] = []  # candidates whose length is not read yet
    known: list[tuple[int, int]] = []
    for line in lines:
        at = s.size
        s.size += len(line) + 1
        if line.startswith(MAGIC):
            waiting.append(at)
        elif (waiting or s.head_end is None) and (n := _length(line)) is not None:
            known += [(a, n) for a in waiting]
            waiting = []
            if s.head_end is None and s.head_length is None:
                s.head_length = n
        elif line == b"\r":
            s.found += [(a, s.size + n + len(END)) for a, n in known]
            waiting, known = [], []
            if s.head_end is None:
                s.head_end = s.size
    s.open = [*known, *((a, None) for a in waiting)]
    return s


def leave(found: list[tuple[int, int]], size: int, cut: list[int]) -> list[tuple[int, int, int]]:
    """For each candidate (offset, exit, last): where its chain leaves the split and from which record; exit -1 if it breaks off.

    A chain also leaves at a header that the split's end cuts (`cut`): that candidate goes on by itself.
    """
    known: dict[int, tuple[int, int]] = {at: (at, at) for at in cut}
    for at, nxt in sorted(found, reverse=True):
        known[at] = (nxt, at) if nxt >= size else known.get(nxt, (-1, at))
    return [(at, *known[at]) for at, _ in found]


CANDIDATES = "file string, split long, kind string, at long, next long, last long"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Per split one `size` row, one `head` row (end of its first header and the length read before), `link` rows (offset, exit,
    last record before the exit), and `open` rows for headers that the next split ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, split), lines in _by_split(batches):
            s = scan(lines)
            rows = [("size", s.size, None, None), ("head", s.head_end, s.head_length, None), *(("link", *x) for x in leave(s.found, s.size, [at for at, _ in s.open])),
                    *(("open", at, n, None) for at, n in s.open)]
            kind, at, nxt, last = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array([split] * len(rows), pa.int64()), pa.array(kind),
                                              *(pa.array(x, pa.int64()) for x in (at, nxt, last))], names=["file", "split", "kind", "at", "next", "last"])

    return _lines(spark, path).mapInArrow(run, CANDIDATES)


def verified_splits(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, base, size, entry, carry): where the split's bytes begin, the first reachable record in it, and the record that reaches into it."""
    found = materialise(candidates(spark, path), "warc-candidates")
    order = W.partitionBy("file").orderBy("split")
    sizes = found.where("kind = 'size'").select("file", "split", F.col("at").alias("size")).where("size > 0")
    heads = found.where("kind = 'head'").select("file", "split", F.col("at").alias("head_end"), F.col("next").alias("head_length"))
    # one row per split of a file
    splits = sizes.join(heads, ["file", "split"]).withColumn("base", F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    splits = splits.withColumn("next_end", F.lead(F.col("base") + F.col("head_end")).over(order)).withColumn("next_length", F.lead("head_length").over(order))
    splits = materialise(splits, "warc-splits")
    based = found.where("kind in ('link', 'open')").join(splits, ["file", "split"])
    base, whole = F.col("base"), F.col("kind") == "link"
    links = based.select(
        "file", "split", (base + F.col("at")).alias("at"), F.when(whole, (base + F.col("last"))).otherwise(base + F.col("at")).alias("last"),
        F.when(whole, F.when(F.col("next") >= 0, base + F.col("next"))).otherwise(F.col("next_end") + F.coalesce("next", "next_length") + len(END)).alias("exit"))
    links = materialise(links, "warc-links")
    entries = materialise(links.join(links.select("file", F.col("exit").alias("at")).distinct(), ["file", "at"], "left_semi").unionByName(
        links.where("at = 0")).select("file", "at", "exit").distinct(), "warc-entries")
    reached = entries.where("at = 0").select("file", "at")
    jumps, n = entries, -1
    while (now := reached.count()) != n:
        n = now
        step = jumps.select("file", "at", F.col("exit").alias("to")).where("to is not null")
        reached = materialise(reached.unionByName(reached.join(step, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "warc-reached")
        further = jumps.select("file", F.col("at").alias("to"), F.col("exit").alias("exit"))
        jumps = materialise(step.join(further, ["file", "to"]).select("file", "at", "exit"), "warc-jumps")
    true = links.join(reached, ["file", "at"], "left_semi")
    chain = true.groupBy("file", "split").agg(F.min("at").alias("entry"), F.max_by("last", "at").alias("last"))
    return splits.join(chain, ["file", "split"], "left").select(
        "file", "split", "base", "size", "entry", F.last("last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("carry"))


def parse(record: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, digest said, payload)"""
    head, _, rest = record.partition(END.encode())
    f = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    number = lambda k: int(x) if (x := f.get(k, b"").removeprefix(b"<urn:page:").removesuffix(b">")).lstrip(b"-").isdigit() else None
    payload = rest[:int(f.get(b"content-length", b"0"))]
    return (number(b"warc-record-id"), f.get(b"warc-target-uri", b"").decode("utf-8", "replace"), f.get(b"warc-type", b"").decode("utf-8", "replace"), number(b"warc-refers-to"),
            f.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:"), payload)


def records(lines: Iterator[bytes], base: int, size: int, entry: int | None, carry: int | None) -> Iterator[tuple[int, int, bytes, bool]]:
    """(record's offset, place inside it, bytes, whole) of one split, given the first reachable record."""
    at, first = base, base + size if entry is None else entry
    part: list[bytes] = []
    for line in lines:
        if at == first:
            break
        part.append(line)
        at += len(line) + 1
    else:
        line = None
    if part and carry is not None:
        yield carry, base - carry, b"\n".join([*part, b""]), False
    while line is not None:
        start, part, end, length = at, [], None, None
        while line is not None:
            part.append(line)
            at += len(line) + 1
            if end is None:
                length = _length(line) if length is None else length
                if line == b"\r" and length is not None:
                    end = at + length + len(END)
            line = next(lines, None)
            if end is not None and at >= end:
                break
        yield start, 0, b"\n".join([*part, b""]), end is not None and at >= end


READ = "page_id long, url string, record_type string, refers_to long, said string, payload_bytes long, payload_digest string, payload binary"


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives: page_id, url, record_type, refers_to, said (the digest in the header), payload_bytes,
    payload_digest (of what was read), payload (null unless asked for).

    Files of any size are read in splits; a record may reach over splits, its header over one boundary. Bytes after a broken
    link of the chain are not read as records; one that the file's end cuts keeps what is there. Archives must not be compressed, so that they can be split.
    """
    splits = materialise(verified_splits(spark, path), "warc-verified")
    lines = _lines(spark, path)
    if splits.count() <= SPLITS_TO_SEND:
        rows = lines.join(F.broadcast(splits), ["file", "split"])
    else:
        rows = lines.withColumn("place", F.monotonically_increasing_id()).join(splits, ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "place")
    rows = rows.select("line", "file", "split", "base", "size", "entry", "carry")

    def fields(record: bytes) -> tuple:
        *head, body = parse(record)
        return *head, len(body), digest(body), body if payload else None

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in READ.split(", ")]

    piece_kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), *kinds]

    def batch_of(rows_: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_, strict=True), piece_kinds, strict=True)], names=["file", "start", "place", "data", *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        for (file, _, base, size, entry, carry), own in _by_split(batches):
            for start, place, data, whole in records(own, base, size, entry, carry):
                held.append((file, start, place, None if whole else data, *(fields(data) if whole else [None] * len(kinds))))
                size_held += 200 if whole and not payload else len(data)
                if size_held > BATCH_BYTES:
                    yield batch_of(held)
                    held, size_held = [], 0
        if held:
            yield batch_of(held)

    pieces = rows.mapInArrow(cut, "file string, start long, place long, data binary, " + READ)
    joined = pieces.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.when(F.col("data").isNotNull(), F.struct("place", "data")))).alias("parts"),
                                                 *[F.first(n, ignorenulls=True).alias(n) for n in names])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = zip(*(b.column(n).to_pylist() for n in names), strict=True)
            out = [fields(b"".join(p["data"] for p in parts)) if parts else row for parts, row in zip(b.column("parts").to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=names)

    return joined.mapInArrow(finish, READ)


def resolved(read: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a revisit has the size of the response it refers to."""
    read = materialise(read.drop("payload"), "warc-read")
    said = read.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("said")).agg(F.max("payload_bytes").alias("_n"))
    back = read.where("record_type = 'revisit'").join(said, ["refers_to", "said"], "left").select(
        "page_id", F.col("_n").alias("payload_bytes"), F.col("said").alias("payload_digest"), "record_type", "refers_to")
    return read.where("record_type <> 'revisit'").select(*back.columns).unionByName(back)


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return resolved(read_warc(spark, path, payload=False))
