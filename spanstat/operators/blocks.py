"""Rows cut into blocks of their chromosome, and sums over one block at a time.

All rows of a block come to one task one after the other (a sort, not a group in
memory). A task adds them up as they come, so it holds what is distinct in a block, not
its rows, and what it has found in all its blocks it gives out once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a grid: the tiles or bins of a block.
CELLS = 4096


def block_of(x: str, width: int) -> str:
    """SQL of the block of a position, rounded down also below 0."""
    return f"(({x}) - pmod({x}, {width}L)) div {width}L"


def cut(df: DataFrame, width: int, *cols: str) -> DataFrame:
    """chrom, block, ``cols``, start and stop of every block's piece of a row, counted from
    the block's start, and if it came into the block from the one before; empty rows are left out."""
    d = df.where("start < stop and chrom is not null").select(*cols, "chrom", "start", "stop", F.explode(F.expr(f"sequence({block_of('start', width)}, {block_of('stop - 1', width)})")).alias("block"))
    lo = F.col("block") * F.lit(width).cast("long")
    return d.select("chrom", "block", *cols, F.greatest(F.col("start") - lo, F.lit(0)).cast("int").alias("start"), F.least(F.col("stop") - lo, F.lit(width)).cast("int").alias("stop"), (F.col("start") < lo).alias("cut"))


def by_block(df: DataFrame, f, schema: str) -> DataFrame:
    """``f`` over the record batches of all blocks of a partition, a block's rows together."""
    return df.repartition("chrom", "block").sortWithinPartitions("chrom", "block").mapInArrow(f, schema)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[pa.RecordBatch]]]:
    """(chrom, block) and the batches of each block, which must be used up in turn."""
    parts = _parts(batches)
    head = next(parts, None)

    def rest(key):
        nonlocal head
        while head is not None and head[0] == key:
            yield head[1]
            head = next(parts, None)

    while head is not None:
        key = head[0]
        yield key, rest(key)


def _parts(batches):
    for b in batches:
        if not b.num_rows:
            continue
        chrom, block = b.column("chrom"), b.column("block").to_numpy(zero_copy_only=False)
        new = block[1:] != block[:-1]
        new |= pc.not_equal(chrom.slice(1), chrom.slice(0, len(chrom) - 1)).to_numpy(zero_copy_only=False)
        at = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for i, j in zip(at, at[1:]):
            yield (chrom[i].as_py(), int(block[i])), b.slice(i, j - i)


class Codes:
    """Small numbers for the values of a column, null included."""

    def __init__(self):
        self.values, self._at = [], {}

    def of(self, column: pa.Array) -> np.ndarray:
        d = pc.dictionary_encode(column, null_encoding="encode")
        here = []
        for v in d.dictionary.to_pylist():
            if v not in self._at:
                self._at[v] = len(self.values)
                self.values.append(v)
            here.append(self._at[v])
        return np.array(here, np.int64)[d.indices.to_numpy(zero_copy_only=False)]

    def column(self, codes: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.array(self.values, kind).take(pa.array(codes))


def runs(keys: np.ndarray) -> np.ndarray:
    """The first place of every run of equal keys."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


class Tally:
    """Sums of values per key, in memory of about twice the distinct keys."""

    def __init__(self, least: int = 1 << 21):
        self.least = self.limit = least
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, keys: np.ndarray, *values: np.ndarray) -> None:
        self.parts.append((keys, *values))
        self.n += len(keys)
        if self.n > self.limit:
            self.get()
            self.limit = max(self.least, 2 * self.n)

    def get(self) -> tuple[np.ndarray, ...]:
        """The keys in order and their sums; keys without values are counted."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        plain = [p[0] for p in self.parts if len(p) == 1]
        rest = [p for p in self.parts if len(p) > 1]
        if plain:
            keys = np.sort(np.concatenate(plain))
            first = runs(keys)
            rest.append((keys[first], np.diff(np.concatenate((first, [len(keys)])))))
        if len(rest) > 1 or not plain:
            keys = np.concatenate([p[0] for p in rest])
            order = np.argsort(keys)
            keys = keys[order]
            first = runs(keys)
            sums = [np.concatenate(v)[order] for v in list(zip(*rest))[1:]]
            rest = [(keys[first], *[np.add.reduceat(v, first) if len(first) else v for v in sums])]
        self.parts, self.n = rest, len(rest[0][0])
        return rest[0]


class Grid:
    """Whole sums per code and cell of a block; what falls beyond the last cell is left out."""

    def __init__(self, cells: int = CELLS):
        self.cells, self.kept, self.n = cells, np.zeros((0, cells), np.int64), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, codes: np.ndarray, cell: np.ndarray, value: np.ndarray) -> None:
        inside = (cell >= 0) & (cell < self.cells)
        self.parts.append((codes[inside], cell[inside], value[inside]))
        self.n += len(codes)
        if self.n > max(1 << 18, self.kept.size):
            self.get(0)

    def get(self, codes: int) -> np.ndarray:
        """The sums, a row for each of at least ``codes`` codes."""
        code, cell, value = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 3
        n = max(codes, len(self.kept), int(code.max()) + 1 if len(code) else 0)
        if n > len(self.kept):
            self.kept = np.concatenate((self.kept, np.zeros((n - len(self.kept), self.cells), np.int64)))
        if len(code):
            flat = code * self.cells + cell
            # Weights are whole numbers, exact as doubles.
            self.kept += np.bincount(flat, value, n * self.cells).astype(np.int64).reshape(n, self.cells)
        self.parts, self.n = [], 0
        return self.kept
