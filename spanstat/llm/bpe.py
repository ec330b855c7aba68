"""Byte-level BPE encoding and decoding by a pair occurrence index.

All pre-tokens that a partition hasn't met yet are laid out in one linked list
of symbols. An index maps each mergeable pair, named by its rank, to all its
positions; a heap holds the active ranks. The lowest rank is applied at all its
positions from left to right, and the lists of the pairs that this makes are
updated. As the lowest active rank of the partition is also the lowest one of
each word that holds it, each word gets the merges that it would get alone.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanstat.llm.common import small_batches
from spanstat.llm.tokens import CachedEncoder, ids_bytes, tokenizer_path

#: Fixed value: the byte-level pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairIndexBPE:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str | None = None):
        import regex

        with open(path or tokenizer_path(), encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        letters = byte_letters()
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        back = {c: b for b, c in enumerate(letters)}
        self.token_bytes = [b""] * (max([*vocab.values(), *(x["id"] for x in model["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for x in model["added_tokens"]:
            self.token_bytes[x["id"]] = x["content"].encode()
        self.rank, self.made, self.pair = {}, [], []
        for r, m in enumerate(model["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            key = vocab[a] << 20 | vocab[b]
            if key not in self.rank:
                self.rank[key] = r
            self.pair.append(key)
            self.made.append(vocab[a + b])
        #: Rank of each pair of single bytes, -1 where there is none.
        byte_id = self.byte_id.tolist()
        self.byte_rank = np.array([self.rank.get(a << 20 | b, -1) for a in byte_id for b in byte_id], np.int64)
        self.findall = regex.compile(PATTERN).findall
        self.words: dict[str, bytes] = {}

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, by one pair occurrence index over all of them."""
        rank = self.rank
        raw = [w.encode() for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        codes = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        ends = np.cumsum(size)
        at = np.arange(len(codes))
        last, first = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        last[(ends - 1)[size > 0]], first[(ends - size)[size > 0]] = True, True
        sym: list[int] = self.byte_id[codes].tolist()
        nxt: list[int] = np.where(last, -1, at + 1).tolist()
        prv: list[int] = np.where(first, -1, at - 1).tolist()
        # The index of the pairs of single bytes, all positions at once.
        spot = np.flatnonzero(~last)
        r = self.byte_rank[codes[spot] * 256 + codes[spot + 1]] if len(spot) else spot
        spot, r = spot[r >= 0], r[r >= 0]
        order = np.argsort(r, kind="stable")
        spot, r = spot[order], r[order]
        new = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else r
        where: dict[int, list[int]] = {k: x.tolist() for k, x in zip(r[new].tolist(), np.split(spot, new[1:]))}
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            spots = where.pop(r)
            key, new = self.pair[r], self.made[r]
            spots.sort()
            for i in spots:
                j = nxt[i]
                if j < 0 or sym[i] << 20 | sym[j] != key:
                    continue
                sym[i], sym[j] = new, -1
                k = nxt[i] = nxt[j]
                nxt[j] = -1
                p = prv[i]
                if k >= 0:
                    prv[k] = i
                    q = rank.get(new << 20 | sym[k])
                    if q is not None:
                        x = where.get(q)
                        if x is None:
                            where[q] = [i]
                            heapq.heappush(active, q)
                        else:
                            x.append(i)
                if p >= 0:
                    q = rank.get(sym[p] << 20 | new)
                    if q is not None:
                        x = where.get(q)
                        if x is None:
                            where[q] = [p]
                            heapq.heappush(active, q)
                        else:
                            x.append(p)
        ids = np.array(sym, np.int64)
        kept = np.r_[0, np.cumsum(ids >= 0)] * 4
        out = ids[ids >= 0].astype("<u4").tobytes()
        return [out[a:b] for a, b in zip(kept[ends - size].tolist(), kept[ends].tolist())]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > 500_000:
            self.words = {}
        # Letters, or a space and letters, are one pre-token.
        cut = [(t,) if t.isalpha() or t[:1] == " " and t[1:].isalpha() else self.findall(t) for t in texts]
        fresh = list({w for c in cut for w in c} - self.words.keys())
        self.words.update(zip(fresh, self.merge_words(fresh)))
        get = self.words.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        get = self.token_bytes.__getitem__
        return b"".join(map(get, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@functools.cache
def coder(path: str | None) -> tuple[PairIndexBPE, CachedEncoder]:
    """One of each in a Python worker: its tasks share the vocabulary and the bounded caches."""
    bpe = PairIndexBPE(path)
    return bpe, CachedEncoder(bpe.encode_many, limit=500_000)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens and the two digests.

    A null or empty text has no ids and decodes to the empty text; repeated rows
    give repeated rows; no other column than doc_id and text is read; an empty
    table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = coder(path)
        for batch in batches:
            n, a, b = [], [], []
            for part in range(0, batch.num_rows, 256):
                for ids in encoder.encode(batch.column(1).slice(part, 256).to_pylist()):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
