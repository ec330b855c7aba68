"""Monte Carlo permutation of query sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanstat.operators.blocks import Codes, Tally, block_of, blocks, by_block, runs
from spanstat.operators.overlap import BLOCK, clip, overlap_counts
from spanstat.operators.regions import merge
from spanstat.schema import HG38, genome_map


def drawn(below: Column, *keys: Column, seed: int = 42) -> Column:
    """A number in [0, below) from a hash of the keys, the same under any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), below)


def moved(q: DataFrame, trials: int, mode: str, genome: dict[str, int] = HG38, seed: int = 42, allowed: DataFrame | None = None, offset: Callable | None = None) -> DataFrame:
    """Every query row in every trial, at a new place; ``sid`` and ``trial`` tell whose.

    circular: one offset per trial for all chromosomes, cut off at their ends.
    shuffle: every row anywhere on its chromosome; longer rows are left out.
    ``offset``, a function of an object with trial, row, start, stop and size, replaces
    the hash; it takes columns as well as arrays. The trials are exploded per row, so there
    is no cross join.
    """
    d = _numbered(q, genome).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    if offset is not None:
        offset = offset(SimpleNamespace(trial=F.col("trial").cast("long"), **{c: F.col(c) for c in ("row", "start", "stop", "size")}))
    if mode == "circular":
        top = max(genome.values())
        by = offset if offset is not None else drawn(F.lit(2 * top + 1), F.col("trial"), seed=seed) - top
        d = d.withColumn("by", by)
        d = d.withColumn("start", F.greatest(F.col("start") + F.col("by"), F.lit(0))).withColumn("stop", F.least(F.col("stop") + F.col("by"), F.col("size")))
    else:
        d = d.where("stop - start <= size").withColumn("len", F.col("stop") - F.col("start"))
        at = offset if offset is not None else drawn(F.col("size") - F.col("len") + 1, F.col("trial"), F.col("row"), seed=seed)
        d = d.withColumn("start", at).withColumn("stop", F.col("start") + F.col("len"))
    d = d.where("start < stop").select("sid", "trial", "chrom", "start", "stop")
    return clip(d, merge(allowed)) if allowed is not None else d


def _numbered(q: DataFrame, genome: dict[str, int]) -> DataFrame:
    """Rows on the genome with its size there; repeated ones are numbered, so that each has its own draw."""
    same = F.row_number().over(Window.partitionBy("sid", "chrom", "start", "stop").orderBy("start"))
    d = q.select("sid", "chrom", "start", "stop", F.xxhash64("sid", "chrom", "start", "stop", same).alias("row"), genome_map(genome, F.col("chrom")).alias("size"))
    return d.where("size is not null")


# The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def _hash_int(x: int, seed: np.ndarray) -> np.ndarray:
    return _mixed(_turned((seed + P5 + np.uint64(4)) ^ (np.array([x], np.uint64) * P1), 23) * P2 + P3)


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    return _mixed(_turned((seed + P5 + np.uint64(8)) ^ (_turned(x.view(np.uint64) * P2, 31) * P1), 27) * P1 + P4)


def drawn_array(below, trial: int, row: np.ndarray | None = None, seed: int = 42) -> np.ndarray:
    """``drawn`` of a trial and of each of ``row``, as an array."""
    h = _hash_int(trial, _hash_int(seed & 0xFFFFFFFF, np.array([42], np.uint64)))
    return np.mod((h if row is None else _hash_long(row, h)).view(np.int64), below)


class Before:
    """How many of the given positions, each so often, lie before a position of a chromosome.

    A bit for each base pair and the count of bits per word lead to the running sums, which
    are kept for the distinct positions only.
    """

    def __init__(self, at: np.ndarray, n: np.ndarray, size: int):
        first, low = int(np.searchsorted(at, size + 1)), int(np.searchsorted(at, 0))
        self.sums = np.concatenate(([0], np.cumsum(n[:first])))[low:]
        at = at[low:first]
        self.bits = np.zeros((size >> 6) + 2, np.uint64)
        word = at >> 6
        start = runs(word)
        if len(at):
            self.bits[word[start]] = np.add.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), start)
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        word = x >> 6
        below = self.bits[word] & ((np.uint64(1) << (x & 63).view(np.uint64)) - np.uint64(1))
        return self.sums[self.rank[word] + np.bitwise_count(below)]


def _ends(d: DataFrame) -> DataFrame:
    """chrom, d_sid, and the distinct starts and stops of each block with their rows, as bytes."""
    kind = d.schema["sid"].dataType
    both = [block_of(x, BLOCK) for x in ("start", "stop")]
    rows = d.where("start < stop and chrom is not null").select("chrom", "sid", "start", "stop", F.explode(F.expr(f"array_distinct(array({', '.join(both)}))")).alias("block"))

    def run(batches):
        codes = Codes()
        for (chrom, block), parts in blocks(batches):
            ends = Tally(), Tally()
            for b in parts:
                code = codes.of(b.column("sid"))
                for t, c in zip(ends, ("start", "stop")):
                    x = b.column(c).to_numpy() - block * BLOCK
                    own = (x >= 0) & (x < BLOCK)
                    t.add(code[own] << 32 | x[own])
            for k, t in enumerate(ends):
                keys, n = t.get()
                bounds = [*runs(keys >> 32).tolist(), len(keys)]
                for i, j in zip(bounds, bounds[1:]):
                    at = (keys[i:j] & 0xFFFFFFFF).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([chrom]), codes.column(keys[i : i + 1] >> 32, to_arrow_type(kind)), pa.array([block]), pa.array([k], pa.int32()), pa.array([at.tobytes()]), pa.array([n[i:j].astype(np.int64).tobytes()])], ["chrom", "d_sid", "block", "stops", "at", "n"])

    return by_block(rows, run, f"chrom string, d_sid {kind.simpleString()}, block long, stops int, at binary, n binary")


def _trial_counts(q: DataFrame, d: DataFrame, trials: int, mode: str, genome: dict[str, int], seed: int, offset: Callable | None, units: int = 48) -> DataFrame:
    """q_sid, d_sid, trial and n, of the trials with an overlap; no moved row leaves its task.

    The rows of a chromosome are dealt to some tasks, and each gets all distinct ends of
    ``d`` there; a row meets those that start before its stop, less those that stop by its start.
    """
    kinds = [x.schema["sid"].dataType for x in (q, d)]
    chroms = sorted(genome)
    parts = max(1, -(-units // len(chroms)))
    where = genome_map({c: i * parts for i, c in enumerate(chroms)}, F.col("chrom"))
    none = lambda t: F.lit(None).cast(t)
    rows = _numbered(q, genome)
    if mode == "circular":
        # As in ``moved``, a row without a start or stop reaches to the chromosome's end there.
        rows = rows.withColumns({"start": F.coalesce("start", F.lit(-(1 << 60))), "stop": F.coalesce("stop", F.lit(1 << 60))})
    rows = rows.where("start < stop").select("chrom", (where + F.pmod(F.hash("row"), F.lit(parts))).cast("int").alias("unit"), F.lit(True).alias("of_q"), F.col("sid").alias("q_sid"), none(kinds[1]).alias("d_sid"), "row", "start", "stop", *[none(t).alias(c) for c, t in (("block", "long"), ("stops", "int"), ("at", "binary"), ("n", "binary"))])
    ends = _ends(d.where(F.col("chrom").isin(chroms))).withColumn("unit", F.explode(F.sequence(where.cast("int"), (where + parts - 1).cast("int"))))
    ends = ends.select("chrom", "unit", F.lit(False).alias("of_q"), none(kinds[0]).alias("q_sid"), "d_sid", *[none("long").alias(c) for c in ("row", "start", "stop")], "block", "stops", "at", "n")
    top = max(genome.values())

    def moved_to(trial, row, start, stop, size):
        """The new starts and stops, as ``moved`` has them."""
        r = SimpleNamespace(trial=trial, row=row, start=start, stop=stop, size=size)
        if mode == "circular":
            by = offset(r) if offset else drawn_array(2 * top + 1, trial, seed=seed) - top
            return np.maximum(start + by, 0), np.minimum(stop + by, size)
        at = offset(r) if offset else drawn_array(size - (stop - start) + 1, trial, row, seed)
        if len(at) and (at.min() < 0 or (at + stop - start).max() > size):
            raise ValueError("an offset leads out of the chromosome")
        return at, at + (stop - start)

    def run(batches):
        unit, size, table = None, 0, None
        names, codes = Codes(), Codes()
        ends, found = {}, {}

        def tables():
            out = []
            for i in range(len(names.values)):
                pair = []
                for k in (0, 1):
                    got = sorted(ends.get((i, k), []), key=lambda x: x[0])
                    at = np.concatenate([np.frombuffer(a, np.int32).astype(np.int64) + b * BLOCK for b, a, _ in got]) if got else np.zeros(0, np.int64)
                    pair.append(Before(at, np.concatenate([np.frombuffer(n, np.int64) for *_, n in got]) if got else at, size))
                out.append((i, *pair))
            return out

        def result():
            for (i, c), n in found.items():
                t = np.flatnonzero(n)
                for j in range(0, len(t), 1 << 16):
                    some = t[j : j + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([codes.column(np.full(len(some), c), to_arrow_type(kinds[0])), names.column(np.full(len(some), i), to_arrow_type(kinds[1])), pa.array(some), pa.array(n[some])], ["q_sid", "d_sid", "trial", "n"])

        for batch in batches:
            for b in _of_units(batch):
                if unit != (now := b.column("unit")[0].as_py()):
                    unit, size, table = now, genome[chroms[now // parts]], None
                    ends.clear()
                of_q = b.column("of_q").to_numpy(zero_copy_only=False)
                mine, other = b.filter(pa.array(of_q)), b.filter(pa.array(~of_q))
                if other.num_rows:
                    for i, k, *x in zip(names.of(other.column("d_sid")).tolist(), *[other.column(c).to_pylist() for c in ("stops", "block", "at", "n")]):
                        ends.setdefault((i, k), []).append(x)
                if not mine.num_rows:
                    continue
                if table is None:
                    table = [(i, s, e) for i, s, e in tables() if (i, 0) in ends or (i, 1) in ends]
                    ends = {k: [] for k in ends}
                code = codes.of(mine.column("q_sid"))
                row, start, stop = (mine.column(c).to_numpy() for c in ("row", "start", "stop"))
                if mode != "circular":
                    fits = stop - start <= size
                    code, row, start, stop = code[fits], row[fits], start[fits], stop[fits]
                order = np.argsort(code, kind="stable")
                code, row, start, stop = code[order], row[order], start[order], stop[order]
                for i, j in zip(first := [*runs(code).tolist(), len(code)], first[1:]):
                    sums = [found.setdefault((k, int(code[i])), np.zeros(trials, np.int64)) for k, *_ in table]
                    for t in range(trials):
                        a, z = moved_to(t, row[i:j], start[i:j], stop[i:j], size)
                        if mode == "circular" and len(keep := np.flatnonzero(a < z)) < len(a):
                            a, z = a[keep], z[keep]
                        after = a + 1
                        for n, (_, starts, stops) in zip(sums, table):
                            n[t] += int(starts(z).sum() - stops(after).sum())
        yield from result()

    # By unit, its ends first, then its rows by source.
    dealt = rows.unionByName(ends).repartitionById(parts * len(chroms), "unit").sortWithinPartitions("unit", "of_q", "q_sid")
    return dealt.mapInArrow(run, f"q_sid {kinds[0].simpleString()}, d_sid {kinds[1].simpleString()}, trial long, n long").groupBy("q_sid", "d_sid", "trial").agg(F.sum("n").alias("n"))


def _of_units(batch):
    unit = batch.column("unit").to_numpy()
    at = [*runs(unit).tolist(), len(unit)]
    return [batch.slice(i, j - i) for i, j in zip(at, at[1:])]


def montecarlo(q: DataFrame, d: DataFrame, milestones: Sequence[int], mode: str = "circular", genome: dict[str, int] = HG38, seed: int = 42, allowed: DataFrame | None = None, offset: Callable | None = None) -> DataFrame:
    """q_sid, d_sid, milestone, observed, exceed and p_value; a pair without an
    overlap isn't listed (its p-value is 1). Milestone n uses the first n trials."""
    marks = sorted(set(milestones))
    seen = overlap_counts(q, d).select("q_sid", "d_sid", F.col("overlap_count").alias("observed"))
    if allowed is None:
        c = _trial_counts(q, d, marks[-1], mode, genome, seed, offset)
    else:
        m = moved(q, marks[-1], mode, genome, seed, allowed, offset)
        # A trial is part of the set's id: (sid, trial) as one long.
        sets = m.select((F.col("sid").cast("long") * (1 << 24) + F.col("trial")).alias("sid"), "chrom", "start", "stop")
        c = overlap_counts(sets, d).selectExpr("q_sid div 16777216 as q_sid", "q_sid % 16777216 as trial", "d_sid", "overlap_count as n")
        c = c.withColumn("q_sid", F.col("q_sid").cast(q.schema["sid"].dataType))
    j = seen.join(c, ["q_sid", "d_sid"], "left")
    hits = [F.sum(F.when((F.col("trial") < k) & (F.col("n") >= F.col("observed")), 1).otherwise(0)).alias(f"m{k}") for k in marks]
    wide = j.groupBy("q_sid", "d_sid", "observed").agg(*hits)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("milestone"), F.col(f"m{k}").alias("exceed")) for k in marks])).alias("r")
    return wide.select("q_sid", "d_sid", "observed", rows).select("q_sid", "d_sid", "r.milestone", "observed", "r.exceed", (F.col("r.exceed") / F.col("r.milestone")).alias("p_value"))
