"""Near-duplicate documents by ProbMinHash, banding and verification.

Every document is the set of its shingles of five words, each with weight 1.
An element's arrivals are a Poisson process with its weight as the rate; each
arrival falls on one register, which keeps the earliest, and an element stops once
its next arrival is later than every register's. Two documents agree in a register
with their probability Jaccard, which for equal weights is the Jaccard of the sets.
Bands of registers give candidates (of a pair at 0.8 they miss 1 in 20,000); a candidate
is a link if that same Jaccard is at least ``threshold``. Counts as weights would lose documents that repeat a line
unequally often: their probability Jaccard is far below the Jaccard of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanstat.llm.common import dropped, free_name, released, small_batches, stored
from spanstat.llm.graph import components

WORDS, BANDS, ROWS = 5, 25, 5
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle hashes of texts; word hashes are kept in a bounded memo."""

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, {}

    def hashes(self, text: str | None) -> np.ndarray:
        """Of each shingle, in order; fewer words than a shingle make one; none give none."""
        w = (text or "").split()
        if not w:
            return np.zeros(0, np.uint64)
        memo = self.memo
        got = list(map(memo.get, w))
        if None in got:
            if len(memo) > 200_000:
                memo.clear()
            for x in w:
                if x not in memo:
                    memo[x] = xxhash.xxh64_intdigest(x)
            got = list(map(memo.__getitem__, w))
        h = np.array(got, np.uint64)
        n = min(self.words, len(h))
        out = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x100000001B3) + mix(h[k : k + len(out)])
        return mix(out + np.uint64(n))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures of many documents at once: docs x registers elements.

    A round draws the next arrival of every element that still runs.
    """
    first = np.full(docs * registers, np.inf)
    owner = np.zeros(docs * registers, np.uint64)
    time, last = np.zeros(len(doc)), np.full(docs, np.inf)
    r = 0
    with np.errstate(over="ignore"):
        while len(doc):
            r += 1
            u = mix(element + MIX * np.uint64(2 * r))
            time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
            runs = time < last[doc]
            doc, element, weight, time = doc[runs], element[runs], weight[runs], time[runs]
            spot = (mix(element + MIX * np.uint64(2 * r + 1)) % np.uint64(registers)).astype(np.int64) + doc * registers
            np.minimum.at(first, spot, time)
            won = first[spot] == time
            owner[spot[won]] = element[won]
            if r % 4 == 0 or r < 4:
                last = first.reshape(docs, registers).max(axis=1)
    return owner.reshape(docs, registers)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = mix(out * np.uint64(31) + sig[:, k * bands : (k + 1) * bands] + MIX * np.arange(bands, dtype=np.uint64))
    return out.view(np.int64)


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """uid, doc_id, whole (two hashes of the set of shingles; null: no words), n (its size) and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                b = batch.slice(part, 256)
                sets = [np.unique(shingler.hashes(t)) for t in b.column(2).to_pylist()]
                doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                element = np.concatenate(sets or [np.zeros(0, np.uint64)])
                keys = band_keys(signatures(doc, element, np.ones(len(element)), len(sets), bands * rows), bands, rows)
                with np.errstate(over="ignore"):
                    whole = [f"{int(mix(x).sum()):x}-{int(mix(x ^ MIX).sum()):x}-{len(x)}" if len(x) else None for x in sets]
                cols = [b.column(0), b.column(1), pa.array(whole, pa.string()), pa.array([len(x) for x in sets], pa.int64()), pa.array([k.tolist() if len(x) else [] for k, x in zip(keys, sets)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["uid", "doc_id", "whole", "n", "keys"])

    d = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(released(run), "uid long, doc_id long, whole string, n long, keys array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """uid and the sorted shingle set, as bytes, of (uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                b = batch.slice(part, 256)
                sets = [np.unique(shingler.hashes(t)).tobytes() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["uid", "items"])

    return texts.select("uid", "text").mapInArrow(released(run), "uid long, items binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have at least this Jaccard.

    ``v`` is the side on which many pairs may meet, so it is joined while a pair is
    two numbers; the sets then go to the partitions of ``u``.
    """
    a = sets.select(F.col("uid").alias("u"), F.col("items").alias("x"))
    b = sets.select(F.col("uid").alias("v"), F.col("items").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(i.as_buffer(), np.uint64) for i in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    joined = pairs.join(b, "v").join(a, "u").select("u", "v", "x", "y")
    return joined.mapInArrow(released(run), "u long, v long")


def prefixes(sets: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """uid, item, place, n of the shingles in each set's prefix that another of these sets has too.

    A set's shingles are ordered by how many of the sets have them, the rarest first;
    the prefix is so long that two sets of this Jaccard share a shingle of both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                b = batch.slice(part, 64)
                n = np.array([len(x.as_buffer()) // 8 for x in b.column(1)], np.int64)
                flat = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(flat)], names=["uid", "item"])

    rows = sets.join(nodes.select("uid"), "uid", "left_semi").select("uid", "items").mapInArrow(released(run), "uid long, item long")
    common = rows.groupBy("item").agg(F.count("*").alias("k")).where("k > 1")
    ranked = rows.join(common, "item").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("k", "item"))).alias("s"))
    sized = ranked.join(nodes.select("uid", "n"), "uid").withColumn("own", F.col("n") - F.size("s"))
    length = F.col("n") - F.ceil(F.col("n") * threshold - 1e-6) + 1 - F.col("own")
    short = sized.select("uid", "n", "own", F.slice("s", F.lit(1), F.greatest(length, F.lit(0)).cast("int")).alias("s"))
    return short.select("uid", "n", "own", F.posexplode("s").alias("k", "x")).select("uid", F.col("x.item").alias("item"), (F.col("own") + F.col("k")).alias("place"), "n")


def links(docs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) between documents of different shingle sets that give the classes.

    One document stands for each set. In a band's bucket the pivot - the member that
    shares most with others - is compared with all members. Buckets that then still
    span several components hold strays, members outside the bucket's largest one.
    A stray meets the members of other components by an exact prefix filter: on a
    shingle of both prefixes, and only if what is left of both sets from there on can
    reach the threshold. So every candidate pair is compared, is known not to be a
    link, or lies in one component, and a large group of near copies isn't paired.
    """
    one = sketches.where("whole is not null").groupBy("whole").agg(F.min(F.struct("uid", "n", "keys")).alias("s")).select("s.uid", "s.n", "s.keys")
    bands = one.select("uid", "n", F.explode("keys").alias("key"))
    size = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(bands.join(size, "key"), "bands")
    degree = shared.groupBy("uid").agg(F.sum("size").alias("degree"))
    member = stored(shared.join(degree, "uid").select("key", "uid", "n", "degree"), "members")
    dropped(shared)

    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("text").cast("string").alias("text"))
    # Merged at every size: texts are only moved once, and nothing grows into a broadcast.
    sets = stored(shingle_sets(texts.join(member.select("uid").distinct().hint("merge"), "uid", "left_semi")), "shingles")

    best = member.groupBy("key").agg(F.max(F.struct("degree", (-F.col("uid")).alias("m"))).alias("p"))
    pivot = best.select("key", (-F.col("p.m")).alias("v"))
    pairs = member.join(pivot, "key").where("uid <> v").select(F.col("uid").alias("u"), "v").distinct()
    found = stored(verified(pairs, sets, threshold), "links")

    comp = components(found).withColumnRenamed("node", "uid")
    named = member.join(comp, "uid", "left").select("key", "uid", "n", F.coalesce("comp", "uid").alias("comp"))
    parts = named.groupBy("key", "comp").agg(F.count("*").alias("k"))
    home = parts.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("h"), F.sum("k").alias("all")).where("all > h.k").select("key", F.col("h.comp").alias("home"))
    mixed = named.join(home, "key").groupBy("uid", "n", "comp").agg(F.max(F.col("comp") != F.col("home")).alias("stray"))
    mixed = stored(mixed, "mixed")
    tokens = stored(prefixes(sets, mixed, threshold).join(mixed.select("uid", "comp", "stray"), "uid"), "prefixes")
    x = tokens.where("stray").select("item", F.col("uid").alias("u"), F.col("n").alias("nu"), F.col("place").alias("at"), F.col("comp").alias("of"))
    y = tokens.select(F.col("item").alias("same"), F.col("uid").alias("v"), "n", "place", "comp", "stray")
    rest = F.least(F.col("nu") - F.col("at"), F.col("n") - F.col("place"))
    can = rest * (1 + threshold) >= (F.col("nu") + F.col("n")) * threshold - 1e-6
    # Of two strays the one with the larger id asks.
    more = x.join(y, (x["item"] == y["same"]) & (F.col("of") != F.col("comp")) & can & (~F.col("stray") | (F.col("u") > F.col("v")))).select("u", "v").distinct()
    return found.unionByName(verified(more, sets, threshold))


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """uid, doc_id, class_id and kept of each row of ``docs``, a scan of files.

    class_id is the least doc_id of the class. Equal sets of shingles are one class;
    a document without words (null, empty) is a class of its own. kept marks one
    row per class: the first with the least doc_id, null ids last. Repeated rows
    fall into one class; a long text is one set of shingles; no rows give no rows;
    columns other than doc_id and text aren't read.
    """
    small_batches(docs.sparkSession)
    sketches = stored(sketch(docs), "sketches")
    comp = components(links(docs, sketches, threshold))
    first = sketches.where("whole is not null").groupBy("whole").agg(F.min("uid").alias("node"))
    named = first.join(comp, "node", "left").select("whole", F.coalesce("comp", "node").alias("comp"))
    rows = sketches.select("uid", "doc_id", "whole").join(named, "whole", "left").select("uid", "doc_id", F.coalesce("comp", "uid").alias("comp"))
    rows = stored(rows, "classes")
    dropped(sketches)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    best = rows.groupBy("comp").agg(F.min(order).alias("b")).select("comp", F.col("b.doc_id").alias("class_id"), F.col("b.uid").alias("best"))
    return rows.join(best, "comp").select("uid", "doc_id", "class_id", (F.col("uid") == F.col("best")).alias("kept"))


def dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of ``docs`` (a scan of files) of each class; all columns are kept, whatever their names."""
    name = free_name(docs.columns, "_uid")
    kept = classes(docs, threshold).where("kept").select(F.col("uid").alias(name))
    return docs.withColumn(name, F.monotonically_increasing_id()).join(kept, name, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
