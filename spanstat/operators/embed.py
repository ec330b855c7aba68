"""Similarity of sources by the tiles that they cover."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanstat.operators.blocks import CELLS, Codes, Grid, Tally, block_of, blocks, by_block, cut

TILE = 100


def tiles(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Distinct (sid, chrom, tile).

    Rows are added up in the tiles of a block where they begin and end, and none is spelled
    out, so the work grows with rows, and what is kept with sources and tiles.
    """
    kind = df.schema["sid"].dataType

    def run(batches):
        codes = Codes()
        for (chrom, block), rows in blocks(batches):
            grid = Grid()
            for b in rows:
                code = codes.of(b.column("sid"))
                start, stop = (b.column(c).to_numpy().astype(np.int64) for c in ("start", "stop"))
                one = np.ones(len(code), np.int64)
                grid.add(code, start // tile, one)
                grid.add(code, (stop - 1) // tile + 1, -one)
            code, cell = np.nonzero(np.cumsum(grid.get(0), axis=1) > 0)
            for i in range(0, len(code), 1 << 16):
                c, t = code[i : i + (1 << 16)], cell[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([codes.column(c, to_arrow_type(kind)), pa.repeat(chrom, len(c)), pa.array(t + block * CELLS)], ["sid", "chrom", "tile"])

    return by_block(cut(df, tile * CELLS, "sid"), run, f"sid {kind.simpleString()}, chrom string, tile long")


def shared_tiles(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """a_sid, b_sid and ``both``: the tiles that a source of ``a`` shares with one of ``b``, if any.

    Without ``b``, those of the sources of ``a``, in both orders. With it, a null b_sid has
    those shared with any source of ``b``. A block's tiles are one matrix a side, multiplied.
    """
    kinds = [x.schema["sid"].dataType for x in (a, b or a)]
    side = lambda df, k: df.where("sid is not null").select("chrom", F.expr(block_of("tile", CELLS)).alias("block"), F.lit(k == 0).alias("of_a"), *[(F.col("sid") if i == k else F.lit(None).cast(t)).alias(f"{x}_sid") for i, (x, t) in enumerate(zip("ab", kinds))], F.expr(f"cast(pmod(tile, {CELLS}L) as int)").alias("cell"))
    alone = b is None

    def run(batches):
        codes, total = (Codes(), Codes()), Tally()

        def found():
            keys, *n = total.get()
            total.__init__()
            if len(keys):
                other = pa.array([None, *codes[0 if alone else 1].values], to_arrow_type(kinds[1])).take(pa.array(keys & 0xFFFFFFFF))
                yield pa.RecordBatch.from_arrays([codes[0].column(keys >> 32, to_arrow_type(kinds[0])), other, pa.array(n[0])], ["a_sid", "b_sid", "both"])

        for _, rows in blocks(batches):
            grids = (Grid(), Grid())
            for x in rows:
                of_a = x.column("of_a").to_numpy(zero_copy_only=False)
                for k, mine in enumerate((of_a, ~of_a)):
                    if mine.any():
                        part = x.filter(pa.array(mine))
                        grids[k].add(codes[k].of(part.column("ab"[k] + "_sid")), part.column("cell").to_numpy().astype(np.int64), np.ones(part.num_rows, np.int64))
            # Sums of at most CELLS ones are exact in single precision.
            left = (grids[0].get(0) > 0).astype(np.float32)
            right = left if alone else (grids[1].get(0) > 0).astype(np.float32)
            if not alone:
                right = np.concatenate((right.max(axis=0, keepdims=True) if len(right) else np.zeros((1, CELLS), np.float32), right))
            for i in range(0, len(left), 1024):
                both = left[i : i + 1024] @ right.T
                r, c = np.nonzero(both)
                total.add((r + i) << 32 | (c + 1 if alone else c), both[r, c].astype(np.int64))
                if total.n > total.least // 2:
                    yield from found()
        yield from found()

    rows = side(a, 0) if alone else side(a, 0).unionByName(side(b, 1))
    return by_block(rows, run, f"a_sid {kinds[0].simpleString()}, b_sid {kinds[1].simpleString()}, both long").groupBy("a_sid", "b_sid").agg(F.sum("both").alias("both"))


def cosine_gram(t: DataFrame) -> DataFrame:
    """a_sid <= b_sid and the cosine of their tile sets; pairs without a common tile are 0 and not listed."""
    both = shared_tiles(t)
    # A source shares all of its tiles with itself; all of a source's pairs are with it, in either order.
    own = F.max(F.when(F.col("a_sid") == F.col("b_sid"), F.col("both")))
    n = both.select("*", *[own.over(Window.partitionBy(f"{x}_sid")).alias(f"n{x}") for x in "ab"])
    return n.where("a_sid <= b_sid").select("a_sid", "b_sid", (F.col("both") / F.sqrt(F.col("na").cast("double") * F.col("nb"))).alias("cosine"))


def svd_index(t: DataFrame, variance: float = 0.95, components: int = 128) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Source ids, unit embeddings, singular values and left singular vectors. Only the gram matrix, sources
    by sources, reaches the driver; beyond some thousands of sources it shouldn't."""
    rows = cosine_gram(t).collect()
    sids = sorted({r.a_sid for r in rows})
    if len(sids) < 2:
        raise ValueError("an index needs two sources or more")
    at = {s: i for i, s in enumerate(sids)}
    g = np.zeros((len(sids),) * 2)
    for r in rows:
        g[at[r.a_sid], at[r.b_sid]] = g[at[r.b_sid], at[r.a_sid]] = r.cosine
    val, vec = np.linalg.eigh(g)
    val, vec = np.maximum(val[::-1], 0.0), vec[:, ::-1]
    share = np.cumsum(val) / val.sum()
    k = max(1, min(int(np.searchsorted(share, variance)) + 1, components, len(sids) - 1))
    sigma = np.sqrt(val[:k])
    u = vec[:, :k] * sigma
    norm = np.linalg.norm(u, axis=1, keepdims=True)
    return sids, np.divide(u, norm, out=np.zeros_like(u), where=norm > 0), sigma, vec[:, :k]


def svd_project(t: DataFrame, index: tuple[list[int], np.ndarray, np.ndarray, np.ndarray], queries: DataFrame) -> DataFrame:
    """q_sid, n_tiles, n_hits (tiles that the index knows) and the unit embedding of these.

    A source of the index projects onto its own embedding.
    """
    sids, _, sigma, left = index
    spark = t.sparkSession
    n = t.groupBy("sid").agg(F.count("*").alias("n"))
    k = len(sigma)
    raw = spark.createDataFrame([(s, [float(x) for x in left[i]]) for i, s in enumerate(sids)], "sid int, e array<double>")
    inv = F.array(*[F.lit(float(1 / s) if s > 1e-10 else 0.0) for s in sigma])
    # V = X' U / sigma: a tile's row is the sum over its sources, so a query's is the sum over
    # all sources, each as often as they share a tile.
    known = raw.join(n, "sid").select("sid", F.zip_with("e", inv, lambda a, b: a * b).alias("e"), F.sqrt("n").alias("r"))
    c = shared_tiles(queries, t.join(F.broadcast(raw.select("sid")), "sid", "left_semi")).join(F.broadcast(known), F.col("b_sid") == F.col("sid"), "left")
    hits = F.sum(F.when(F.col("b_sid").isNull(), F.col("both"))).alias("n_hits")
    p = c.groupBy(F.col("a_sid").alias("q_sid")).agg(*[F.sum(F.col("both") * F.col("e")[i] / F.col("r")).alias(f"v{i}") for i in range(k)], hits)
    norm = F.sqrt(sum((F.col(f"v{i}") * F.col(f"v{i}") for i in range(k)), F.lit(0.0)))
    total = queries.groupBy(F.col("sid").alias("q_sid")).agg(F.count("*").alias("n_tiles"))
    return p.join(total, "q_sid").select("q_sid", "n_tiles", "n_hits", F.array(*[F.when(norm > 0, F.col(f"v{i}") / norm).otherwise(0.0) for i in range(k)]).alias("e"))


def top_similar(sims: DataFrame, n: int = 10) -> DataFrame:
    """The n most similar per q_sid; ties by d_sid."""
    w = Window.partitionBy("q_sid").orderBy(F.desc("cosine"), "d_sid")
    return sims.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
