"""Best-two-fit packing of token sequences into fixed windows.

Documents are encoded, get an end id, and are cut only where longer than the window. Pieces are
dealt to groups of about ``GROUP`` pieces, by a hash of their place in the task that cut them, so that
equal rows spread like others, and each group is packed alone: a bin is filled greedily with the longest piece that fits; then its shortest piece gives way to two unpacked pieces
whose sum fits the widened gap more tightly, if there are such. One bin of a group may stay half
empty, a loss of one in thousands.

Nulls and edges: a null text has the end id only; a null doc_id is packed like any other; repeated
rows are packed as often as they occur; an empty table packs to nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import encoder, widened

GROUP = 8192        # pieces packed together, on average
WINDOW = 1024


def cut(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole windows, the first piece may be shorter."""
    first = n % window or window
    return [(0, min(first, n))] + [(s, window) for s in range(first, n, window)] if n else []


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW,
           group: int = GROUP) -> DataFrame:
    """group, doc_id, piece, start, length, ids (``width`` bytes each) of every whole text."""
    n_docs, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    # some 2.5 bytes a token; groups need not be of equal size
    groups = max(1, round((n_docs + (size or 0) / (2.5 * window)) / group))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        end, w = end_id.to_bytes(e.width, "little"), e.width
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(),
                                   e.encode(batch.column(1).to_pylist())):
                ids += end
                rows += [(doc_id, k, s, n, ids[w * s:w * (s + n)])
                         for k, (s, n) in enumerate(cut(len(ids) // w, window))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rng.integers(0, groups, len(rows), np.int32)), *(
                    pa.array(c, t) for c, t in zip(zip(*rows), [
                        pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]))],
                names=["group", "doc_id", "piece", "start", "length", "ids"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(encoded, "group int, doc_id long, piece int, start long, length long, "
                                 "ids binary"))


def best_two_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths from 1 to ``window``."""
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=window + 1)
    ends = np.cumsum(count)                       # pieces of length n end here in `order`
    sizes = np.arange(window + 1)
    fits = np.maximum.accumulate(np.where(count > 0, sizes, 0))   # longest piece up to a gap
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(n: int, k: int = 1) -> None:
        nonlocal fits
        count[n] -= k
        if count[n] in (0, -k):     # a length ran out, or came back
            fits = np.maximum.accumulate(np.where(count > 0, sizes, 0))

    left, number = len(lengths), 0
    while left:
        gap, content = window, []
        while gap and fits[gap]:
            n = int(fits[gap])
            content.append(n)
            gap -= n
            take(n)
        if gap and len(content) > 1:
            least = content[-1]                   # the greedy fill is longest first
            room = gap + least
            first = np.flatnonzero(count[:room] > 0)
            first = first[first > 0]
            second = fits[room - first]
            # two equal pieces need two of them
            second = np.where((second == first) & (count[first] < 2), 0, second)
            total = np.where(second > 0, first + second, 0)
            if len(first) and total.max() > least:
                k = int(total.argmax())
                take(least, -1)
                content[-1:] = [int(first[k]), int(second[k])]
                take(content[-2])
                take(content[-1])
        at = 0
        for n in content:
            ends[n] -= 1
            row = order[ends[n]]
            bins[row], offsets[row] = number, at
            at += n
        left -= len(content)
        number += 1
    return bins, offsets


SEQUENCE = T.StructType([
    T.StructField("sequence_id", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()), T.StructField("pieces", T.ArrayType(T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("offset", T.LongType())])))])


def sequences(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per sequence: its ids and its pieces in their order, gapless from 0; from ``pieces``."""
    names = ["doc_id", "piece", "start", "length", "ids"]
    place = SEQUENCE["pieces"].dataType.elementType.names

    def packed(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([(c, "ascending") for c in ("doc_id", "piece", "length")]).select(names)
        bins, offsets = best_two_fit(part["length"].to_numpy().astype(np.int64), window)
        order = np.lexsort((offsets, bins))
        part = part.append_column("offset", pa.array(offsets)).take(pa.array(order))
        bins = bins[order]
        begins = np.flatnonzero(np.diff(bins, prepend=-1)).tolist()
        ranges = list(zip(begins, begins[1:] + [len(bins)]))
        ids, places = part["ids"].to_pylist(), part.select(place).to_pylist()
        return pa.table({
            "sequence_id": pa.array((key[0].as_py() << 32) + bins[begins]),
            "length": pa.array([sum(p["length"] for p in places[a:b]) for a, b in ranges], pa.int64()),
            "ids": pa.array([b"".join(ids[a:b]) for a, b in ranges], pa.binary()),
            "pieces": pa.array([places[a:b] for a, b in ranges], pa.list_(pa.struct(
                [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                 ("length", pa.int64()), ("offset", pa.int64())])))})

    return rows.groupBy("group").applyInArrow(packed, SEQUENCE)


def places(packed: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of the pieces in ``sequences``.

    The checksum is that of the ids, as unsigned 32-bit integers, which the sequence has at the
    piece's place.
    """
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = pa.compute.list_parent_indices(batch.column("pieces")).to_numpy()
            own = pa.Table.from_struct_array(batch.column("pieces").flatten())
            numbers, ids = batch.column("sequence_id").to_numpy()[of], batch.column("ids").to_pylist()
            widths = [len(i) // n for i, n in zip(ids, batch.column("length").to_pylist())]
            crcs = [zlib.crc32(widened(ids[k][w * a:w * (a + n)], w)) for k, w, a, n in zip(
                of.tolist(), (widths[k] for k in of.tolist()), own["offset"].to_pylist(),
                own["length"].to_pylist())]
            yield from (own.select(["doc_id", "piece", "start", "length"])
                        .append_column("ids_crc32", pa.array(crcs, pa.int64()))
                        .append_column("sequence_id", pa.array(numbers))
                        .append_column("offset", own["offset"]).to_batches())

    return packed.select("sequence_id", "length", "ids", "pieces").mapInArrow(
        placed, "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long")
