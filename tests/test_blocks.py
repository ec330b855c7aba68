"""Operators that add up blocks, against plain sums, and on inputs whose pairs are too many to be made."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanstat.operators import embed, overlap, permute, regions
from spanstat.plans.queries import QUERIES

ROWS = "sid int, chrom string, start long, stop long"


def made(spark, n, seed, least=-900_000, most=2_000_000, sids=(0, 1, 2, 7, None)):
    """Rows over several blocks: short, long, empty, repeated and with nulls."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = r.choice([r.randrange(least, most), 262_144 * r.randrange(-3, 7)])
        out += [(r.choice(sids), r.choice("ab"), a, a + r.choice([0, 1, 50, 99, 9000, 262_144, 1_500_000, -3]))] * r.choice([1, 1, 3])
    out += [(1, None, 5, 9), (1, "a", None, 9), (1, "a", 5, None)]
    return spark.createDataFrame(out, ROWS), [x for x in out if None not in x[1:] and x[2] < x[3]]


@pytest.mark.parametrize("sizes", [(300, 40), (40, 300)])
def test_counts(spark, sizes):
    (q, a), (d, b) = made(spark, sizes[0], 1), made(spark, sizes[1], 2, sids=range(9))
    n, bp = Counter(), Counter()
    for s, c, x, y in a:
        for t, e, u, v in b:
            if c == e and x < v and y > u:
                n[s, t] += 1
                bp[s, t] += min(y, v) - max(x, u)
    got = overlap.overlap_counts(q, d).collect()
    assert {(r.q_sid, r.d_sid): (r.overlap_count, r.overlap_bp) for r in got} == {k: (n[k], bp[k]) for k in n}
    assert len(got) == len(n)


def stacked(spark, n, sid=0):
    """``n`` rows over each other."""
    return spark.range(n).select(F.lit(sid).cast("int").alias("sid"), F.lit("chr20").alias("chrom"), F.col("id"), (F.col("id") + n).alias("stop")).withColumnRenamed("id", "start")


def test_counts_without_pairs(spark):
    n = 200_000
    assert [tuple(r) for r in overlap.overlap_counts(stacked(spark, n), stacked(spark, n, 3)).select("q_sid", "d_sid", "overlap_count").collect()] == [(0, 3, n * n)]


def test_tiles(spark):
    df, rows = made(spark, 200, 3)
    want = {(s, c, t) for s, c, a, b in rows for t in range(a // 100, (b - 1) // 100 + 1)}
    t = embed.tiles(df)
    assert Counter(map(tuple, t.collect())) == Counter(want)
    n = Counter(s for s, *_ in want)
    sets = {s: {x[1:] for x in want if x[0] == s} for s in n if s is not None}
    got = {(r.a_sid, r.b_sid): r.cosine for r in embed.cosine_gram(t).collect()}
    assert got == {(a, b): pytest.approx(len(sets[a] & sets[b]) / (n[a] * n[b]) ** 0.5) for a in sets for b in sets if a <= b and sets[a] & sets[b]}
    some = t.where("sid > 0")
    got = {(r.a_sid, r.b_sid): r.both for r in embed.shared_tiles(t, some).collect()}
    assert got == {(a, b): len(sets[a] & (sets[b] if b else sets[1] | sets[2] | sets[7])) for a in sets for b in (1, 2, 7, None)}


def test_tiles_of_stacked_rows(spark):
    # Spelled out, these would be 2,000 tiles in each of 200,000 rows.
    assert embed.tiles(stacked(spark, 200_000)).count() == 4000


def test_coverage(spark):
    genome = {"a": 1_900_050, "b": 1_000_000}
    (q, a), (d, b) = made(spark, 120, 4, least=0, sids=(0, 1)), made(spark, 90, 5, least=0, sids=(3, 4, 5))
    cover = []
    for df, rows in ((q, a), (d, b)):
        cells = Counter()
        for s, c, x, y in rows:
            top = -(-genome[c] // 100) * 100
            for t in range(x // 100, -(-min(y, top) // 100)):
                cells[s, c, t] += max(min(y, t * 100 + 100, top) - max(x, t * 100), 0)
        cover.append(cells)
        steps = Counter()
        for (s, c, t), n in cells.items():
            steps[s, c, t] += n
            if t + 1 < -(-genome[c] // 100):
                steps[s, c, t + 1] -= n
        good = df.where("start < stop and chrom is not null")
        assert Counter({(r.sid, r.chrom, r.bin): r.d for r in regions.spikes(good, genome).collect()}) == Counter({k: v for k, v in steps.items() if v})
    want = Counter()
    for (s, c, t), n in cover[0].items():
        for u in (3, 4, 5):
            if cover[1][u, c, t] and n:
                want[s, u] += n * cover[1][u, c, t]
    good = [x.where("start < stop and chrom is not null") for x in (q, d)]
    assert {(r.q_sid, r.d_sid): r.dot for r in regions.coverage_dot(*good, genome).collect()} == {k: v / 10000 for k, v in want.items()}


@pytest.mark.parametrize("mode", ["shuffle", "circular"])
def test_trials(spark, mode):
    genome = {"a": 1_900_050, "b": 1_000_000}
    q, d = made(spark, 60, 6, least=0, sids=(0, 1))[0], made(spark, 40, 7, sids=(3, 4))[0]
    m = permute.moved(q, 7, mode, genome)
    sets = m.select((F.col("sid") * 10 + F.col("trial")).alias("sid"), "chrom", "start", "stop")
    want = {(r.q_sid // 10, r.q_sid % 10, r.d_sid): r.overlap_count for r in overlap.overlap_counts(sets, d).collect()}
    got = permute._trial_counts(q, d, 7, mode, genome, 42, None).collect()
    assert {(r.q_sid, r.trial, r.d_sid): r.n for r in got} == want


def test_all_milestones(spark):
    got = QUERIES["mc_shuffle"](spark, "/root/testdata/sf0.001").collect()
    assert {r.milestone for r in got} == {100, 500, 1000, 5000, 10000}


def test_rows_without_overlap(spark):
    (q, _), (d, rows) = made(spark, 300, 8, least=0), made(spark, 20, 9, least=0)
    hit = lambda c, x, y: None not in (c, x, y) and x < y and any(c == e and u < y and v > x for _, e, u, v in rows)
    want = Counter(tuple(r) for r in q.collect() if not hit(*r[1:]))
    assert Counter(map(tuple, overlap.anti_overlap(q, d).collect())) == want
    n = 200_000
    far = stacked(spark, 5).selectExpr("sid", "chrom", "start + 900000 as start", "stop + 900000 as stop")
    assert overlap.anti_overlap(stacked(spark, n).unionByName(far), stacked(spark, n)).count() == 5
