"""Region algebra and coverage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanstat.operators.blocks import CELLS, Codes, Grid, Tally, block_of, blocks, by_block, cut
from spanstat.schema import BIN, bins_of, genome_map


def slop(df: DataFrame, bp: int, genome: dict[str, int]) -> DataFrame:
    """Widen by ``bp`` on both sides, within [0, size of the chromosome]."""
    size = F.coalesce(genome_map(genome, F.col("chrom")), F.lit(1 << 62))
    return df.withColumn("start", F.greatest(F.col("start") - bp, F.lit(0).cast("long"))).withColumn("stop", F.least(F.col("stop") + bp, size))


def merge(df: DataFrame, by: tuple[str, ...] = ("chrom",), tile: int = 1 << 22) -> DataFrame:
    """Unions of overlapping or book-ended intervals per ``by``.

    Intervals are first cut at tile borders and merged per (by, tile), so no
    window holds a whole chromosome; only pieces that touch a tile's border, at most
    two per tile, are merged again.
    """
    cut = df.where("start < stop").select(*by, "start", "stop").withColumn("_t", F.explode(F.expr(f"sequence({block_of('start', tile)}, {block_of('stop - 1', tile)})")))
    cut = cut.withColumn("start", F.greatest("start", F.col("_t") * tile)).withColumn("stop", F.least("stop", (F.col("_t") + 1) * tile))
    parts = _islands(cut.distinct(), (*by, "_t"))
    border = (F.col("start") == F.col("_t") * tile) | (F.col("stop") == (F.col("_t") + 1) * tile)
    inner = parts.where(~border).select(*by, "start", "stop")
    return inner.unionByName(_islands(parts.where(border), by))


def _islands(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("start", "stop")
    seen = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(seen.isNull() | (F.col("start") > seen), 1).otherwise(0)
    island = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("_n", new).withColumn("_i", island)
    return d.groupBy(*by, "_i").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_i")


def clamped(df: DataFrame, genome: dict[str, int]) -> DataFrame:
    """Rows on chromosomes of the genome, both ends clamped to its whole bins."""
    rows = df.withColumn("_top", genome_map({k: bins_of(v) * BIN for k, v in genome.items()}, F.col("chrom"))).where("_top is not null")
    return rows.withColumn("start", F.least("start", "_top")).withColumn("stop", F.least("stop", "_top")).drop("_top")


def _steps(grid: Grid, code: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    """Add what an end at ``at``, counted from the grid's start, changes: in its bin and in the next."""
    bin_, rest = at // BIN, at % BIN
    grid.add(code, bin_, value * (BIN - rest))
    grid.add(code, bin_ + 1, value * rest)


def spikes(df: DataFrame, genome: dict[str, int]) -> DataFrame:
    """(sid, chrom, bin, d): steps whose running sum is the coverage of each bin.

    Summed per bin, so a source has no more rows on a chromosome than that has bins.
    In hundredths, so sums are exact. A row goes to the blocks of its ends, and of the
    bins after them, and each block keeps its own bins.
    """
    width = BIN * CELLS
    kind = df.schema["sid"].dataType
    ends = [block_of(x, width) for x in ("start", f"start + {BIN}", "stop", f"stop + {BIN}")]
    rows = clamped(df, genome).where("start is not null and stop is not null")
    rows = rows.select("chrom", F.explode(F.expr(f"if({ends[0]} = {ends[3]} and start <= stop, array({ends[0]}), array_distinct(array({', '.join(ends)})))")).alias("block"), "sid", "start", "stop")
    sizes = {k: bins_of(v) for k, v in genome.items()}

    def run(batches):
        codes = Codes()
        for (chrom, block), parts in blocks(batches):
            grid = Grid()
            for b in parts:
                code = codes.of(b.column("sid"))
                for c, sign in (("start", 1), ("stop", -1)):
                    _steps(grid, code, b.column(c).to_numpy() - block * width, np.full(len(code), sign, np.int64))
            d = grid.get(0)
            code, cell = np.nonzero(d)
            own = cell + block * CELLS < sizes[chrom]
            code, cell = code[own], cell[own]
            for i in range(0, len(code), 1 << 16):
                c, t = code[i : i + (1 << 16)], cell[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([codes.column(c, to_arrow_type(kind)), pa.repeat(chrom, len(c)), pa.array(t + block * CELLS), pa.array(d[c, t])], ["sid", "chrom", "bin", "d"])

    return by_block(rows, run, f"sid {kind.simpleString()}, chrom string, bin long, d long")


def coverage(df: DataFrame, genome: dict[str, int]) -> DataFrame:
    """(sid, chrom, bin, until, cover): bins bin..until-1 have ``cover`` hundredths each."""
    w = Window.partitionBy("sid", "chrom").orderBy("bin")
    s = spikes(df, genome).withColumn("cover", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    end = genome_map({k: bins_of(v) for k, v in genome.items()}, F.col("chrom"))
    return s.withColumn("until", F.coalesce(F.lead("bin").over(w), end)).where("cover <> 0").select("sid", "chrom", "bin", "until", "cover")


def total_coverage(df: DataFrame, genome: dict[str, int]) -> DataFrame:
    """sid, total_bp within the genome and n_spikes (two per interval)."""
    return clamped(df, genome).groupBy("sid").agg(F.sum(F.col("stop") - F.col("start")).alias("total_bp"), (2 * F.count("*")).alias("n_spikes"))


def coverage_dot(a: DataFrame, b: DataFrame, genome: dict[str, int]) -> DataFrame:
    """q_sid, d_sid and ``dot``: the sum over bins of the product of both coverages.

    A block's coverages are one matrix a side, multiplied, so the work grows with rows,
    and with pairs of sources and bins, not with pairs of rows.
    """
    width = BIN * CELLS
    kinds = [x.schema["sid"].dataType for x in (a, b)]

    def side(df: DataFrame, k: int) -> DataFrame:
        # A reversed row takes from the coverage.
        rows = clamped(df, genome).select(F.col("sid").alias("s"), "chrom", F.least("start", "stop").alias("start"), F.greatest("start", "stop").alias("stop"), F.when(F.col("start") > F.col("stop"), -1).otherwise(1).alias("sign"))
        return cut(rows, width, "s", "sign").select("chrom", "block", F.lit(k == 0).alias("of_q"), *[(F.col("s") if i == k else F.lit(None).cast(t)).alias(f"{x}_sid") for i, (x, t) in enumerate(zip("qd", kinds))], "sign", "start", "stop")

    def run(batches):
        codes, total = (Codes(), Codes()), Tally()

        def found():
            keys, *n = total.get()
            total.__init__()
            if len(keys):
                names = [codes[i].column(c, to_arrow_type(kinds[i])) for i, c in enumerate((keys >> 32, keys & 0xFFFFFFFF))]
                yield pa.RecordBatch.from_arrays([*names, pa.array(n[0])], ["q_sid", "d_sid", "dot"])

        for _, parts in blocks(batches):
            grids = (Grid(), Grid())
            for x in parts:
                of_q = x.column("of_q").to_numpy(zero_copy_only=False)
                for k, mine in enumerate((of_q, ~of_q)):
                    if mine.any():
                        part = x.filter(pa.array(mine))
                        code, sign = codes[k].of(part.column("qd"[k] + "_sid")), part.column("sign").to_numpy().astype(np.int64)
                        for c, by in (("start", sign), ("stop", -sign)):
                            _steps(grids[k], code, part.column(c).to_numpy().astype(np.int64), by)
            left, right = (np.cumsum(g.get(0), axis=1) for g in grids)
            if not len(left) or not len(right):
                continue
            # Doubles hold whole numbers to 2**53; beyond, long integers are multiplied.
            exact = float(np.abs(left).max()) * float(np.abs(right).max()) * CELLS < 2.0**53
            signed = left.min() < 0 or right.min() < 0
            for i in range(0, len(left), 1024):
                part = left[i : i + 1024]
                dot = (part.astype(float) @ right.T.astype(float)).astype(np.int64) if exact else part @ right.T
                r, c = np.nonzero((part != 0).astype(float) @ (right != 0).T.astype(float) if signed else dot)
                total.add((r + i) << 32 | c, dot[r, c])
                if total.n > total.least // 2:
                    yield from found()
        yield from found()

    schema = f"q_sid {kinds[0].simpleString()}, d_sid {kinds[1].simpleString()}, dot long"
    j = by_block(side(a, 0).unionByName(side(b, 1)), run, schema)
    return j.groupBy("q_sid", "d_sid").agg((F.sum("dot") / (BIN * BIN)).alias("dot"))
