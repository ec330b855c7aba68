"""Token counts from flat, unindexed token files.

A token file is a run of little-endian unsigned 16-bit ids in which the end id
closes every document; there is no index. The end id is one that the vocabulary
lacks, so that <|endoftext|> in a text stays a token of its document. ``write_flat`` makes such files,
``scan_files`` reads them in blocks: each block is searched for the end id at
once (numpy), and a prefix scan over the blocks' summaries stitches documents
that cross block borders, so no file is ever held as a whole in one task's Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanstat.llm.common import scratch
from spanstat.llm.tokens import fast_encoder

#: Tokens of a block.
BLOCK = 1 << 19
#: The end-of-document id.
END_ID = 0xFFFF
#: Documents of a token file at most: a reader has one file at once in memory.
FILE_DOCS = 20_000


def write_flat(docs: DataFrame, path: str, json_path: str | None = None, file_docs: int = FILE_DOCS) -> None:
    """Write token files of ``file_docs`` documents per partition of ``docs``, rows in their order.

    Ids need 16 bits and must be under END_ID; a null text is an empty document. The
    text sink writes each row's bytes and then its line separator, here the end id:
    that is the format.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = fast_encoder(json_path, specials=True)
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                ids = encoder.encode(batch.column(0).slice(part, 512).to_pylist())
                wide = [np.frombuffer(x, "<u4") for x in ids]
                if any(len(x) and x.max() >= END_ID for x in wide):
                    raise ValueError("a token id doesn't fit the token files' 16 bits")
                raw = [x.astype("<u2").tobytes() for x in wide]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["value"])

    end = END_ID.to_bytes(2, "little").decode("latin-1")
    rows = docs.selectExpr("cast(text as string) text").mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", end).option("maxRecordsPerFile", file_docs).text(path)


def block_summaries(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Per block (file, block, data): its tokens and the places of its end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column(2)[k].as_py(), "<u2")
                ends = np.flatnonzero(ids == end_id).astype(np.int64)
                row = [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([len(ids)], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(row, names=["file", "block", "n", "ends"])

    return blocks.select("file", "block", "data").mapInArrow(run, "file string, block long, n long, ends array<long>")


def stitch(summaries: DataFrame) -> DataFrame:
    """file, ordinal (from 0), start and n_tokens (its end id not counted) of each document.

    ``before`` is a prefix sum of tokens, ``ended`` of documents, and ``last`` a
    prefix maximum of the place after the last end id: the three carry a document
    over any number of blocks. Ids after a file's last end id are a document too.
    """
    scan = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    s = summaries.withColumn("before", F.coalesce(F.sum("n").over(scan), F.lit(0)))
    s = s.withColumn("ended", F.coalesce(F.sum(F.size("ends")).over(scan), F.lit(0)).cast("long"))
    s = s.withColumn("after", F.when(F.size("ends") > 0, F.col("before") + F.element_at("ends", -1) + 1))
    s = s.withColumn("last", F.coalesce(F.max("after").over(scan), F.lit(0)))
    s = s.withColumn("final", F.max("block").over(whole) == F.col("block"))
    open_tail = F.col("final") & (F.col("before") + F.col("n") > F.coalesce("after", "last"))
    ends = F.when(open_tail, F.concat("ends", F.array(F.col("n")))).otherwise(F.col("ends"))
    s = s.select("file", "before", "ended", "last", F.posexplode(ends).alias("k", "at"), ends.alias("all"))
    start = F.when(F.col("k") == 0, F.col("last")).otherwise(F.col("before") + F.get("all", F.col("k") - 1) + 1)
    return s.select("file", (F.col("ended") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("before") + F.col("at") - start).alias("n_tokens"))


def scan_files(spark: SparkSession, path: str, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """The documents of all token files under ``path``.

    A file that is empty has no documents; a file of an odd number of bytes fails.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    size = 2 * block
    odd = "cast(raise_error('a token file has an odd number of bytes') as bigint)"
    last = f"(if(length % 2 = 0, length, {odd}) - 1) div {size}"
    blocks = files.select(F.col("path").alias("file"), "content", F.explode(F.expr(f"sequence(0L, {last})")).alias("block"))
    blocks = blocks.select("file", "block", F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("data"))
    return stitch(block_summaries(blocks, end_id))


def token_counts(docs: DataFrame, json_path: str | None = None, file_docs: int = FILE_DOCS) -> DataFrame:
    """doc_id and n_tokens of every document, counted in flat token files.

    ``docs`` is a scan of files: a second scan of its ids has the same partitions
    and order, which is what a document's place in a token file is matched by.
    Null and empty texts have 0 tokens; repeated rows are counted once each; an empty
    table gives no rows. <|endoftext|> in a text is one token, as in the library.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "token-files")
    write_flat(docs, path, json_path, file_docs)
    # The token file's name holds the number of the partition that wrote it and which of its files it is.
    number, nth = (F.regexp_extract("file", r"part-(\d+)-.*-c(\d+)", k).cast("long") for k in (1, 2))
    place = F.shiftleft(number, 33) + nth * file_docs + F.col("ordinal")
    found = scan_files(spark, path).select(place.alias("place"), "start", "n_tokens")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place"))
    joined = ids.join(found, "place", "full_outer")
    missing = F.col("n_tokens").isNull() | F.col("place").isNull()
    whole = F.when(missing, F.raise_error(F.lit("the token files don't match the documents")).cast("long")).otherwise(F.col("n_tokens"))
    return joined.select("doc_id", whole.alias("n_tokens"))
