"""Byte-level BPE ids of whole texts, with a cache over space-separated chunks.

A boundary between a character that is no white space and a following single
space or newline is always a boundary of the pre-tokeniser's pattern, so a text
can be cut there and each chunk encoded once. Texts with other white space take
the encoder as they are.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256
#: White space other than the space and the newline, in either regex dialect.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")
CHUNK = re.compile("[ \n]*[^ \n]+|[ \n]+")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ids_bytes(ids) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    return out.tobytes()


def library_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """encode_many by the tokenizers library; special strings are ordinary text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = True
    return lambda texts: [ids_bytes(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def chunk_encoder(ranks: str) -> Callable[[list[str]], list[bytes]]:
    """Ids of chunks that have no inner white space (a leading space at most).

    The chunks go through the same vocabulary's fast encoder as one text, a
    newline between each two: the newline is a token of its own there. Tests hold
    the ids against the tokenizers library.
    """
    import base64

    import numpy as np
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    newline = enc.encode_ordinary("\n")[0]

    def many(chunks: list[str]) -> list[bytes]:
        ids = np.asarray(enc.encode_ordinary("\n".join(chunks) + "\n"), "<u4")
        ends = np.flatnonzero(ids == newline)
        raw, starts = ids.tobytes(), np.r_[0, ends[:-1] + 1]
        return [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist())]

    return many


@functools.cache
def fast_encoder(json_path: str | None = None, ranks_path: str | None = None, specials: bool = False) -> CachedEncoder:
    """The ids of the tokenizers library, by the quickest way that gives them; one in a Python worker."""
    chunks = chunk_encoder(ranks_path or tokenizer_path("byte_bpe_50k.tiktoken"))
    return CachedEncoder(library_encoder(json_path or tokenizer_path()), specials, chunks=chunks)


class CachedEncoder:
    """encode(texts) -> ids of each text as bytes; null counts as empty.

    ``limit`` bounds the cache's entries: it's emptied when it is full, which
    changes the speed only. With ``specials`` the string <|endoftext|> in a text
    becomes its special id, as the library does by default.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], specials: bool = True, limit: int = 500_000, chunks: Callable[[list[str]], list[bytes]] | None = None):
        self.many, self.specials, self.limit, self.chunks = encode_many, specials, limit, chunks or encode_many
        self.newline = encode_many(["\n"])[0]
        self.special = ids_bytes([SPECIAL_ID])
        self._clear()

    def _clear(self) -> None:
        self.head: dict = {}
        self.spaced: dict = {}
        self.mid: dict = {None: b""}

    def _learn(self, to: dict, words: list[str], lead: str) -> None:
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            to.update(zip(part, self.chunks([lead + w for w in part] if lead else part)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        batch, size = [], 0
        for t in texts:
            batch.append(t or "")
            size += len(t or "")
            if size > 2_000_000:
                out += self._encode(batch)
                batch, size = [], 0
        return out + self._encode(batch)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.specials and any(SPECIAL in t for t in texts):
            parts = [t.split(SPECIAL) for t in texts]
            flat = iter(self._plain([x for p in parts for x in p]))
            return [self.special.join([next(flat) for _ in p]) for p in parts]
        return self._plain(texts)

    def _plain(self, texts: list[str]) -> list[bytes]:
        if len(self.head) + len(self.mid) + len(self.spaced) > self.limit:
            self._clear()
        plans, heads, mids, spaced = [], set(), set(), set()
        head, mid = self.head, self.mid
        for t in texts:
            if not t:
                plans.append(())
            elif OTHER_SPACE.search(t):
                plans.append(t)
            elif "  " in t or " \n" in t or "\n " in t or "\n\n" in t or t[0] in " \n" or t[-1] in " \n":
                parts = CHUNK.findall(t)
                spaced.update(parts)
                plans.append((parts,))
            else:
                lines = []
                for line in t.split("\n"):
                    x = line.split(" ")
                    first, x[0] = x[0], None
                    if first not in head:
                        heads.add(first)
                    ids = list(map(mid.get, x))
                    if None in ids:
                        mids.update([w for w, v in zip(x, ids) if v is None])
                        ids = None
                    lines.append((first, x, ids))
                plans.append((None, lines))
        self._learn(head, list(heads), "")
        self._learn(mid, list(mids), " ")
        odd = list(spaced - self.spaced.keys())
        self.spaced.update(zip(odd, self.many(odd)))
        out = []
        for p in plans:
            if isinstance(p, str):
                out += self.many([p])
            elif len(p) == 2:
                out.append(self.newline.join([head[f] + b"".join(map(mid.__getitem__, x) if v is None else v) for f, x, v in p[1]]))
            else:
                out.append(b"".join(map(self.spaced.__getitem__, p[0])) if p else b"")
        return out
