"""Token-id shards: one compressed frame per document, a shared dictionary, an offset index.

A shard holds a header (magic, width of an id in bytes, SHA-256 of the dictionary) and then the
zstandard frames of its documents, each compressed alone, so that one short document can be read
without its neighbours. The dictionary is trained once on the serialized id arrays of a bounded
sample of slices and lies beside the shards; header and index carry its hash, and a reader refuses
any other. Readers fetch the frames of one shard that stand close to each other at once.
The index is a Parquet table with a row per document: shard, offset and length of the frame,
number of ids, and ``start``, the number of ids of all documents before it.

Shards are range partitions by doc_id, so their order is the order of ids. A task writes its shard
under a name of its own and returns index rows; only rows of committed tasks name a shard, so lost
executors leave unused files at most.

Nulls and edges: a null text has no ids but the end id; a null doc_id sorts first; repeated rows
are separate documents, equal doc_ids in order of a hash of the text; an empty table gives an empty
index; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, hash_sample, partitions
from .tokens import encoder, vocabulary_width, widened

MAGIC = b"TWIDS1"
FRAMES = "part int, doc_id long, shard string, offset long, length long, n_tokens long, before long"


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample: int = 2000,
                     longest: int = 4000, size: int = 32768) -> bytes:
    """A zstandard dictionary from slices of at most ``sample`` texts, each of at most ``longest``
    characters from a place that a hash chooses.

    It only affects how small frames get. Too few samples for training give a dictionary of raw
    content; no text at all gives an empty one.
    """
    place = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - longest, F.lit(0)) + 1) + 1
    slices = (hash_sample(docs.select("doc_id", "text").where(F.length("text") > 0), sample,
                          "doc_id", "text")
              .select(F.substring(F.col("text"), place.cast("int"), F.lit(longest)).alias("text")))
    e = encoder(tokenizer)
    end = end_id.to_bytes(e.width, "little")
    arrays = [ids + end for ids in e.encode([r["text"] for r in slices.toLocalIterator()])]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(arrays)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int,
                 level: int = 3, dictionary: bytes | None = None) -> None:
    """Encode every whole text, append ``end_id``, write shards, dictionary and index at ``path``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    width = vocabulary_width(tokenizer)
    if dictionary is None:
        dictionary = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    fs, base = filesystem(path)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary-{digest}") as out:
        out.write(dictionary)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(path)
        part = TaskContext.get().partitionId()
        name = f"shard-{part:08d}-{uuid.uuid4().hex}"
        compress = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary)).compress
        end, out, offset, before = end_id.to_bytes(width, "little"), None, 0, 0
        encode = encoder(tokenizer).encode
        for batch in batches:
            if out is None:
                out = fs.open_output_stream(f"{base}/{name}")
                header = MAGIC + bytes([width]) + bytes.fromhex(digest)
                out.write(header)
                offset = len(header)
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(),
                                   encode(batch.column(1).to_pylist())):
                frame, n = compress(ids + end), len(ids) // width + 1
                out.write(frame)
                rows.append((part, doc_id, name, offset, len(frame), n, before))
                offset += len(frame)
                before += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [
                pa.int32(), pa.int64(), pa.string(), *[pa.int64()] * 4])],
                names=[c.split()[0] for c in FRAMES.split(", ")])
        if out is not None:
            out.close()

    n = partitions(spark)
    # the last tie lets rows that are equal in all else stand in several shards
    ordered = (docs.select("*", F.xxhash64("text").alias("tie"),
                           F.monotonically_increasing_id().alias("row"))
               .repartitionByRange(n, "doc_id", "tie", "row")
               .sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text"))
    ordered.mapInArrow(shard, FRAMES).write.parquet(f"{path.rstrip('/')}/frames")
    frames = spark.read.schema(FRAMES).parquet(f"{path.rstrip('/')}/frames")
    # one row per shard, at most n of them: bounded, whatever the number of documents
    shards = frames.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    earlier = shards.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids"))
                            .alias("earlier"))
    (frames.join(F.broadcast(earlier), "part")
     .select("doc_id", (F.col("earlier") + F.col("before")).alias("start"), "n_tokens", "shard",
             "offset", "length", F.lit(width).alias("width"), F.lit(digest).alias("dictionary"))
     .write.parquet(f"{path.rstrip('/')}/index"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index of ``path``; filter it to read single documents."""
    return spark.read.parquet(f"{path.rstrip('/')}/index")


@lru_cache(maxsize=4)
def _decompressor(path: str, digest: str) -> zstandard.ZstdDecompressor:
    fs, base = filesystem(path)
    with fs.open_input_stream(f"{base}/dictionary-{digest}") as f:
        data = f.read()
    if hashlib.sha256(data).hexdigest() != digest:
        raise ValueError(f"dictionary of {path} does not match its hash")
    return zstandard.ZstdDecompressor(dict_data=_dictionary(data))


def spans(offset: np.ndarray, length: np.ndarray, most: int = 32 << 20
          ) -> Iterator[tuple[int, int, list[int]]]:
    """(begin, size, frames) of reads that each fetch close frames, given in order, at once."""
    begin, end, held = 0, 0, []
    for i, (at, n) in enumerate(zip(offset.tolist(), length.tolist())):
        if held and not (0 <= at - end <= n + 4096 and at + n - begin <= most):
            yield begin, end - begin, held
            held = []
        if not held:
            begin = at
        end = at + n
        held.append(i)
    if held:
        yield begin, end - begin, held


def read_tokens(rows: DataFrame, path: str) -> DataFrame:
    """The documents of index ``rows``: doc_id, start, n_tokens, ids (unsigned 32-bit, binary)."""
    def shard_ids(file, shard: pa.Table) -> list[bytes]:
        """Ids of a batch's documents in one shard, in the order of their offsets."""
        width, digest = shard["width"][0].as_py(), shard["dictionary"][0].as_py()
        if file.read_at(len(MAGIC) + 33, 0) != MAGIC + bytes([width]) + bytes.fromhex(digest):
            raise ValueError(f"{shard['shard'][0]} does not match its index")
        decompress, out = _decompressor(path, digest).decompress, []
        offset, length = (shard[c].to_numpy() for c in ("offset", "length"))
        for begin, size, frames in spans(offset, length):
            data = memoryview(file.read_at(size, begin))
            for i in frames:
                at = int(offset[i]) - begin
                out.append(widened(decompress(data[at:at + int(length[i])]), width))
        if any(len(ids) != 4 * n for ids, n in zip(out, shard["n_tokens"].to_pylist())):
            raise ValueError(f"{shard['shard'][0]} has a damaged frame")
        return out

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(path)
        for batch in batches:
            found = pa.Table.from_batches([batch]).sort_by([("shard", "ascending"),
                                                           ("offset", "ascending")])
            for name in found["shard"].unique().to_pylist():
                own = found.filter(pc.equal(found["shard"], name)).combine_chunks()
                with fs.open_input_file(f"{base}/{name}") as file:
                    ids = shard_ids(file, own)
                yield from (own.select(["doc_id", "start", "n_tokens"])
                            .append_column("ids", pa.array(ids, pa.binary())).to_batches())

    wanted = rows.select("doc_id", "start", "shard", "offset", "length", "n_tokens", "width",
                         "dictionary")
    return wanted.mapInArrow(frames, "doc_id long, start long, n_tokens long, ids binary")
