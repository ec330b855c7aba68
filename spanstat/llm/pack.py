"""Packing of documents into fixed-length sequences.

Every document's ids (with an end id) are cut at multiples of the sequence
length; what is left over is packed by first-fit decreasing. A tournament tree
over the bins' free capacities finds the first bin that fits in O(log bins).
Documents are dealt at random into groups of about ``group_docs``, each packed by
itself, so no task holds more than a group and a hot key can't gather in one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanstat.llm.common import released, small_batches
from spanstat.llm.tokens import fast_encoder, ids_bytes

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free capacities of bins; every inner node holds the larger of its two."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin that has room: its number and offset."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        free, bin_ = tree[i], i - self.leaves
        tree[i] = free - size
        while i > 1:
            i //= 2
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a >= b else b
        return bin_, free


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size, all of which are in 1..capacity."""
    tour, out = Tournament(max(1, len(sizes)), capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        bin_, free = tour.place(sizes[i])
        out[i] = bin_, capacity - free
    return out


def token_pieces(docs: DataFrame, length: int, end_id: int, path: str | None) -> DataFrame:
    """doc_id, doc_tokens and the crc32 of each piece of ``length`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, step = fast_encoder(path, specials=True), ids_bytes([end_id]), 4 * length
        for batch in batches:
            n, crcs = [], []
            for part in range(0, batch.num_rows, 512):
                for ids in encoder.encode(batch.column(1).slice(part, 512).to_pylist()):
                    ids += end
                    n.append(len(ids) // 4)
                    crcs.append([zlib.crc32(ids[a : a + step]) for a in range(0, len(ids), step)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(released(run), "doc_id long, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, path: str | None = None, group_docs: int = 1024) -> DataFrame:
    """One row per piece: where its ids lie in the document and in a sequence.

    A null or empty text has the end id alone. Repeated rows are packed once each.
    Rows are dealt by a hash of the id, the size and the row's place, so equal ids
    don't meet in one group. An empty table gives no pieces; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    sized = token_pieces(docs, length, end_id, path).withColumn("deal", F.pmod(F.xxhash64("doc_id", "doc_tokens", F.monotonically_increasing_id()), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        ids, n, crcs = (rows.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "crcs"))
        base = (rows.column("deal")[0].as_py() if ids else 0) << 32
        order = sorted(range(len(ids)), key=lambda i: (n[i], ids[i] is None, ids[i] or 0, crcs[i]))
        rest = [i for i in order if n[i] % length]
        spots = dict(zip(rest, first_fit_decreasing([n[i] % length for i in rest], length)))
        used = 1 + max((b for b, _ in spots.values()), default=-1)
        out: list[list] = [[] for _ in range(7)]
        for i in order:
            for k, crc in enumerate(crcs[i]):
                size = min(length, n[i] - k * length)
                if size < length:
                    seq, at = spots[i]
                else:
                    seq, at, used = used, 0, used + 1
                for col, v in zip(out, (ids[i], k * length, size, crc, n[i], base + seq, at)):
                    col.append(v)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return sized.groupBy("deal").applyInArrow(run, SCHEMA)
