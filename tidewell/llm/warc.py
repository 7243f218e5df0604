"""WARC archives of pages: written with revisits, read back by verified record boundaries.

Writing: every page becomes one record. Of pages with equal payloads of at least ``MIN_BYTES``
bytes, that with the smallest page_id is the response and the others revisit it; digests alone
decide that, and only digests that occur twice are joined. A task appends its records to files of
its own, and the table of committed files names them, so files of lost tasks are never read.

Reading: files are cut into blocks. Each task looks in its block for the magic and emits every
candidate record with the offset of its successor, and the offset where its chain leaves the block.
Magic inside a payload also gives candidates, at the cost of the lines that look like a header's
there. Pointer jumping over those exits, from offset 0 of
each file, doubles the reach with each round, so a file of n blocks needs log2(n) rounds over a few
rows per block. Only records on a chain that starts at the file's start are read.

Nulls and edges: null html is an empty payload; a null page_id is written as such and only is a
response if its whole group has null ids; repeated rows with the smallest page_id are all
responses; an empty table gives no files and no rows; other columns are ignored; records may be
longer than blocks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, partitions, stage

MIN_BYTES = 100
BLOCK = 4 << 20
ROLL = 256 << 20        # a task begins a new file beyond this size
MAGIC = b"WARC/1."
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")      # of equal length
NAME = 256                  # bytes in which the name of a header field ends
END = b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "file string, bytes long, records long"
CHAIN = "file string, block long, offset long, successor long, exit long"
RECORDS = ("page_id long, uri string, record_type string, refers_to long, payload_digest string, "
           "payload_bytes long, intact boolean, payload binary")


def with_references(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, and refers_to where the page repeats another's payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                         payload.alias("payload"))
            .select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest")))
    firsts = stage(rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
                   .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                   .where("n > 1").select("digest", "first"), "repeated-payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest",
                                                      refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None, date: str) -> bytes:
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(
            f"%{ord(c):02X}" if ord(c) < 33 else c for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES,
                   date: str = "1970-01-01T00:00:00Z", roll: int = ROLL) -> None:
    """Archives of all pages below ``path``, and the table ``files`` of those to be read."""
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(path)
        fs.create_dir(base, recursive=True)
        out, done, size, records = None, [], 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}")
                data = record(*row, date)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= roll:
                    out.close()
                    out = done.append((name, size, records))
        if out is not None:
            out.close()
            done.append((name, size, records))
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("file", "bytes", "records"), d)) for d in done],
            pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    (with_references(pages, min_bytes).mapInArrow(written, FILES)
     .write.parquet(f"{path.rstrip('/')}/files"))


class Reader:
    """Bytes of a file by offset, read in pieces that grow with what is needed."""

    def __init__(self, fs, path: str, size: int, begin: int, span: int):
        self.file, self.size, self.begin = fs.open_input_file(path), size, begin
        self.data = bytearray(self.file.read_at(min(span, size - begin), begin))
        self.known: dict[int, tuple[int, bytes | None] | None] = {}

    def upto(self, end: int) -> bool:
        """Have the bytes before ``end`` at hand; false if the file ends before."""
        have = self.begin + len(self.data)
        if end > have:
            more = min(max(end - have, 1 << 16, len(self.data) >> 2), self.size - have)
            self.data += self.file.read_at(more, have)
        return end <= self.size

    def line(self, at: int) -> tuple[bytes, int] | None:
        """The line at ``at`` in the data and the place after it; None if it cannot be a header's.

        A line that goes on without a colon is given up early, and no byte is searched twice.
        """
        seen = at
        while (end := self.data.find(b"\r\n", max(seen - 1, at))) < 0:
            seen = len(self.data)
            if seen - at > NAME and self.data.find(b":", at, at + NAME) < 0:
                return None
            if not self.upto(self.begin + seen + 1):
                return None
        return bytes(self.data[at:end]), end + 2

    def header(self, offset: int) -> tuple[dict[str, str], int, int] | None:
        """Fields, begin and end of the block of the record at ``offset``; None if there is none."""
        at = offset - self.begin
        self.upto(offset + len(VERSIONS[0]))
        if self.data[at:at + len(VERSIONS[0])] not in VERSIONS:
            return None
        at += len(VERSIONS[0])
        fields = {}
        while True:
            got = self.line(at)
            if got is None:
                return None
            line, at = got
            if not line:
                break
            name, colon, value = line.partition(b":")
            if not colon:
                return None
            fields[name.strip().lower().decode("latin1")] = value.strip().decode("utf-8", "replace")
        length = fields.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            return None
        begin = self.begin + at
        stop = begin + int(length)
        return (fields, begin, stop) if stop + len(END) <= self.size else None

    def extent(self, offset: int) -> int | None:
        """End of the block of the record that may be at ``offset``, as ``header`` finds it.

        A line that was looked at before is not looked at again: what follows it is remembered, as
        (begin of the block, the last Content-Length), or None where no header ends.
        """
        at = offset - self.begin
        self.upto(offset + len(VERSIONS[0]))
        if self.data[at:at + len(VERSIONS[0])] not in VERSIONS:
            return None
        at += len(VERSIONS[0])
        passed, after = [], None
        while True:
            if (start := self.begin + at) in self.known:
                after = self.known[start]
                break
            got = self.line(at)
            if got is None:
                break
            line, at = got
            name, colon, value = line.partition(b":")
            if not line:
                after = (self.begin + at, None)
                break
            if not colon:
                break
            passed.append((start, value.strip() if name.strip().lower() == b"content-length" else None))
        for start, value in reversed(passed):
            if after and after[1] is None and value is not None:
                after = (after[0], value)
            self.known[start] = after
        if not after or after[1] is None or not after[1].isdigit():
            return None
        stop = after[0] + int(after[1])
        return stop if stop + len(END) <= self.size else None

    def bytes(self, begin: int, end: int) -> bytes:
        self.upto(end)
        return bytes(self.data[begin - self.begin:end - self.begin])


def candidates(files: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """Every possible record with its successor, and where its chain leaves the block."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(path)
        for batch in batches:
            for name, size, k in zip(*(c.to_pylist() for c in batch.columns)):
                begin, end = k * block, min((k + 1) * block, size)
                reader = Reader(fs, f"{base}/{name}", size, begin, block + len(MAGIC))
                found, at = [], reader.data.find(MAGIC)
                while 0 <= at < end - begin:
                    if (stop := reader.extent(begin + at)) is not None:
                        found.append((begin + at, stop + len(END)))
                    at = reader.data.find(MAGIC, at + 1)
                reader.file.close()
                own = np.array(found, np.int64).reshape(-1, 2)
                offset, successor = own[:, 0], own[:, 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(own), pa.string()),
                     pa.array(np.full(len(own), k)), pa.array(offset), pa.array(successor),
                     pa.array(exits(offset, successor, end))],
                    names=[c.split()[0] for c in CHAIN.split(", ")])

    blocks = files.select("file", "bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block))).alias("block"))
    return blocks.repartition(partitions(files.sparkSession)).mapInArrow(scan, CHAIN)


def exits(offset: np.ndarray, successor: np.ndarray, end: int) -> np.ndarray:
    """Where each chain leaves the block, by pointer jumping; -1 where it breaks inside."""
    if not len(offset):
        return successor
    step = np.minimum(np.searchsorted(offset, successor), len(offset) - 1)
    inside = offset[step] == successor
    step = np.where(inside, step, np.arange(len(offset)))
    while not np.array_equal(step[step], step):
        step = step[step]
    out = successor[step]
    return np.where(out >= end, out, -1)


def reachable(chains: DataFrame, rounds: int) -> DataFrame:
    """file, block, offset of the first record of each block that the chain from 0 enters."""
    entered = chains.select("file", F.col("exit").alias("offset")).where("offset >= 0").distinct()
    heads = (chains.select("file", "block", "offset", "exit")
             .join(entered.withColumn("entered", F.lit(True)), ["file", "offset"], "left")
             .where("offset = 0 OR entered")
             .select("file", "block", "offset", "exit", (F.col("offset") == 0).alias("reached")))
    heads = stage(heads, "chain-heads")
    for _ in range(rounds):
        onward = heads.select("file", F.col("offset").alias("exit"), F.col("exit").alias("next"))
        marked = (heads.where("reached").select("file", F.col("exit").alias("offset")).distinct()
                  .withColumn("marked", F.lit(True)))
        heads = stage(
            heads.join(onward, ["file", "exit"], "left").join(marked, ["file", "offset"], "left")
            .select("file", "block", "offset", F.coalesce("next", "exit").alias("exit"),
                    (F.col("reached") | F.coalesce("marked", F.lit(False))).alias("reached")),
            "chain-heads")
    return heads.where("reached").select("file", "block", "offset")


def parsed(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    ident = lambda text: text[10:-1] if text.startswith("<urn:page:") else ""
    number = lambda text: int(text) if text.lstrip("-").isdigit() else None
    head, _, payload = block.partition(END)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    kind = fields.get("warc-type")
    length, intact, body = len(payload), None, None
    if kind == "revisit":
        for line in head.split(b"\r\n")[1:]:
            if line.lower().startswith(b"content-length:"):
                length = number(line.partition(b":")[2].strip().decode("latin1"))
    else:
        own = hashlib.sha256(payload).hexdigest()
        intact, digest, body = own == digest, own, payload if payloads else None
    return (number(ident(fields.get("warc-record-id", ""))), fields.get("warc-target-uri"), kind,
            number(ident(fields.get("warc-refers-to", ""))), digest, length, intact, body)


def read_archives(files: DataFrame, path: str, block: int = BLOCK,
                  payloads: bool = True) -> DataFrame:
    """A row per verified record; revisits have no payload, ``intact`` compares digests.

    ``files`` has the columns file and bytes, as written in the table ``files``.
    """
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(path)
        schema = pa.schema([("page_id", pa.int64()), ("uri", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                            ("intact", pa.bool_()), ("payload", pa.binary())])
        for batch in batches:
            for name, k, offset, size in zip(*(c.to_pylist() for c in batch.columns)):
                end, rows = min((k + 1) * block, size), []
                reader = Reader(fs, f"{base}/{name}", size, offset, end - offset)
                while offset < end:
                    fields, begin, stop = reader.header(offset)
                    rows.append(parsed(fields, reader.bytes(begin, stop), payloads))
                    offset = stop + len(END)
                reader.file.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = files.select("file", "bytes")
    chains = stage(candidates(files, path, block), "record-chains")
    longest = files.agg(F.max("bytes")).first()[0] or 0
    rounds = max(0, (longest // block).bit_length())
    starts = reachable(chains, rounds).join(files, "file").select("file", "block", "offset", "bytes")
    return (starts.repartition(partitions(files.sparkSession), "file", "block")
            .mapInArrow(records, RECORDS))
