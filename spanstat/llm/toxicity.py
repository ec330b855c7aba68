"""Toxicity of whole texts after noisy-channel deobfuscation.

1. A character trigram model is counted over all documents.
2. Tokens that the channel may have made - spacers or leetspeak beside letters,
   doubled letters, single letters in a row - become lattices of what each
   character may stand for (leetspeak, a spacer, a repetition); Viterbi decoding
   under the trigram model gives the restored token. Two tokens in a row count as
   a word that a space splits where the model prefers the whole and it has weight.
3. Word and prefix features of restored tokens get smoothed log-odds from a bounded
   sample of labelled documents, and a logistic model over the strongest feature
   and the sum of the strong ones gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanstat.llm.common import released, small_batches, stored

#: Labelled documents that the classifier is fitted on at most: a sample by hash.
SAMPLE_DOCS = 20_000
#: Of the features those are kept that this many toxic documents of the sample have,
#: whose log-odds are this high, and of these the strongest so many.
LEAST_DOCS, LEAST_WEIGHT, FEATURES = 3, 2.0, 4_000
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
#: 0: word border, 1: any other letter.
CLASSES = len(LETTERS) + 2
#: What a character of leetspeak may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c", "¢": "c", "*": "aeiou", "#": "h", "%": "x", "&": "e",
}
SPACERS = frozenset(" .-_*~'`,:/\\·•")
#: Costs of the channel, as logarithms of probabilities.
SAME, SWAPPED, SPACED, REPEATED = -0.05, -2.5, -1.0, -0.7
EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”„…–—¿¡"
_LETTER = r"[^\W\d_]"
_LEET, _BETWEEN = (f"[{re.escape(''.join(sorted(x)))}]" for x in ("".join(LEET), "".join(SPACERS) + "".join(LEET)))
#: What the channel may have made: its signs between letters, leetspeak beside one, a doubled letter.
ODD = re.compile(rf"{_LETTER}{_BETWEEN}+{_LETTER}|{_LEET}{_LETTER}|{_LETTER}{_LEET}|({_LETTER})\1")
_SPACER = f"[{re.escape(''.join(sorted(SPACERS)))}]"
RUN, SIGNS = re.compile(r"(.)\1+"), re.compile(r"[\W\d_]+")
SPELLED = re.compile(rf"(?<!\S)(?:[^\W_]{_SPACER}+){{3,}}[^\W_](?!\S)")


def classes_of(text: str) -> np.ndarray:
    """The trigram model's class of each character of a text in lower case."""
    table = _table()
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return table[np.minimum(codes, 0xFFFF)]


def _table(memo: list = []) -> np.ndarray:  # noqa: B006
    if not memo:
        t = np.zeros(0x10000, np.int32)
        for c in range(0x10000):
            if chr(c).isalpha():
                t[c] = 1
        for k, c in enumerate(LETTERS):
            t[ord(c)] = k + 2
        memo.append(t)
    return memo[0]


class CharModel:
    """log P(c | a, b) from trigram counts, with additive smoothing."""

    def __init__(self, counts: dict[int, int]):
        n = np.zeros(CLASSES**3)
        for k, v in counts.items():
            n[k] = v
        n = n.reshape(CLASSES, CLASSES, CLASSES)
        two = n.sum(axis=0) + 0.1  # counts of (b, c)
        back = two / two.sum(axis=1, keepdims=True)
        self.log = np.log((n + 5 * back) / (n.sum(axis=2, keepdims=True) + 5)).tolist()
        self.index = {c: k + 2 for k, c in enumerate(LETTERS)}

    def restore(self, token: str) -> str:
        """The likeliest letters behind a token, by Viterbi decoding."""
        # State: the last two emitted classes -> (score, letters so far, last letter).
        states: dict[tuple[int, int], tuple[float, tuple, str]] = {(0, 0): (0.0, (), "")}
        index, log = self.index, self.log
        for ch in token:
            moves = [(x, SWAPPED) for x in LEET.get(ch, "")]
            if ch.isalpha():
                moves.append((ch, SAME))
            skip = SPACED if ch in SPACERS else 2 * SWAPPED if not ch.isalnum() else None
            after: dict[tuple[int, int], tuple[float, tuple, str]] = {}
            for (a, b), (score, path, last) in states.items():
                row = log[a][b]
                for x, cost in moves:
                    k = index.get(x, 1)
                    s = score + cost + row[k]
                    old = after.get((b, k))
                    if old is None or s > old[0]:
                        after[(b, k)] = (s, (path, x), x)
                    if x == last:
                        s = score + REPEATED + cost
                        old = after.get((a, b))
                        if old is None or s > old[0]:
                            after[(a, b)] = (s, path, last)
                if skip is not None or not moves:
                    s = score + (2 * SWAPPED if skip is None else skip)
                    old = after.get((a, b))
                    if old is None or s > old[0]:
                        after[(a, b)] = (s, path, last)
            states = after
        score, path, _ = max(((s + self.log[a][b][0], p, last) for (a, b), (s, p, last) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out))


    def chance(self, word: str) -> float:
        """log P of a whole word, borders included."""
        a = b = 0
        out = 0.0
        for k in [*(self.index.get(c, 1) for c in word), 0]:
            out += self.log[a][b][k]
            a, b = b, k
        return out


def character_counts(docs: DataFrame) -> dict[int, int]:
    """Trigram counts over all documents: at most CLASSES ** 3 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                texts = [t for t in batch.column(0).slice(part, 256).to_pylist() if t]
                c = classes_of(f"  {'  '.join(texts)}  ".lower())
                c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]  # one border between words
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["k", "n"])

    rows = docs.selectExpr("cast(text as string) text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {r.k: r.n for r in rows}


def squeezed(word: str) -> str:
    """Each run of one letter as a single one."""
    return RUN.sub(r"\1", word)


class Restorer:
    """Distinct restored words of a text; decoded tokens are kept in a bounded memo.

    With ``weights``, a token of letters, and signs behind them, is decoded if that can
    matter: decoding does no more than shorten its runs of one letter and add letters at
    its end, so what comes out begins with the same squeezed form, and a feature with a
    weight must hold it, or begin it.
    """

    def __init__(self, model: CharModel, weights: dict[str, float] | None = None):
        self.model, self.memo = model, {}
        self.whole = None
        if weights is not None:
            # Any part of a word: a space may split it, and leetspeak stand at a part's end.
            spans = ((w, i, k) for w in weights for i in range(len(w)) for k in range(i + 1, len(w) + 1))
            self.whole = {squeezed(w[i:k]) for w, i, k in spans}
            self.begin = {squeezed(w[:-1]) for w in weights if w.endswith("*")}

    def matters(self, t: str, core: str) -> bool:
        if self.whole is None or not core.isalpha() or not LEET.keys().isdisjoint(t[: t.index(core)]):
            return True
        s = squeezed(core)
        return s in self.whole or any(s[:k] in self.begin for k in range(1, 7))

    def decoded(self, t: str) -> tuple[str, ...]:
        core = t.strip(EDGE)
        words = {core} if core.isalpha() else {w for w in SIGNS.split(core) if w}
        if ODD.search(t) and self.matters(t, core):
            if t == core or ODD.search(core):
                words.add(self.model.restore(core))
            if t != core:
                words.add(self.model.restore(t))
        return tuple(w for w in words if w)

    def token(self, t: str) -> tuple[str, ...]:
        found = self.memo.get(t)
        if found is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            found = self.memo[t] = self.decoded(t)
        return found

    def spelled(self, low: str) -> set[str]:
        """Runs of single letters: the whole run, then its parts at wider gaps."""
        return {self.model.restore(part) for m in SPELLED.finditer(low) for part in [m[0], *re.split(r" {2,}", m[0])]}

    def words(self, text: str) -> set[str]:
        low = text.lower()
        out = self.spelled(low)
        for t in set(low.split()):
            out.update(self.token(t))
        out.discard("")
        return out


def features_of(word: str) -> list[str]:
    """A word and its prefixes of four to six letters."""
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k)]


class Scorer:
    """score(text) in 0..1 from feature weights and the logistic coefficients."""

    def __init__(self, counts: dict[int, int], weights: dict[str, float], coef: tuple[float, float, float] | None):
        self.restorer, self.weights, self.coef = Restorer(CharModel(counts), weights), weights, coef
        #: Of each token met: its words with a weight, those that may begin one, and those that may end one; () if none.
        self.memo: dict[str, tuple] = {}
        words = [w for w in weights if not w.endswith("*")]
        self.starts, self.ends = {w[:k] for w in words for k in range(1, len(w))}, {w[k:] for w in words for k in range(1, len(w))}

    def known(self, t: str) -> tuple:
        words = self.restorer.decoded(t)
        found = tuple(w for w in words if self.word(w) > 0), tuple(w for w in words if w in self.starts), tuple(w for w in words if w in self.ends)
        if len(self.memo) > 300_000:
            self.memo.clear()
        self.memo[t] = found = found if any(found) else ()
        return found

    def split(self, tokens: list[str], begins: dict[str, tuple], ends: dict[str, tuple]) -> set[str]:
        """Words with a weight that a space splits, where the model prefers the whole."""
        out, model = set(), self.restorer.model
        for a, b in {(a, b) for a, b in zip(tokens, tokens[1:]) if a in begins and b in ends}:
            for x in begins[a]:
                for y in ends[b]:
                    if x + y in self.weights and x + y not in out and model.chance(x + y) > model.chance(x) + model.chance(y) + SPACED:
                        out.add(x + y)
        return out

    def word(self, w: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features_of(w)), default=0.0)

    def evidence(self, text: str | None) -> tuple[float, float]:
        """The strongest word's weight, and the logarithm of the strong words' sum."""
        low = (text or "").lower()
        tokens = low.split()
        words, begins, ends = self.restorer.spelled(low), {}, {}
        distinct = set(tokens)
        for t, found in zip(distinct, map(self.memo.get, distinct)):
            if found is None:
                found = self.known(t)
            if found:
                words.update(found[0])
                if found[1]:
                    begins[t] = found[1]
                if found[2]:
                    ends[t] = found[2]
        if begins and ends:
            words |= self.split(tokens, begins, ends)
        found = sorted(v for v in map(self.word, words) if v > 0)
        return max(found, default=0.0), math.log1p(sum(found))

    def score(self, text: str | None) -> float:
        if self.coef is None:
            return 0.0
        a, b = self.evidence(text)
        z = self.coef[0] + self.coef[1] * a + self.coef[2] * b
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (intercept first) by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, features: int = FEATURES, least_docs: int = LEAST_DOCS, least_weight: float = LEAST_WEIGHT) -> tuple[dict, dict, tuple | None]:
    """(trigram counts, feature weights, logistic coefficients).

    Labels of held-out ids are never read. Of the others, the ``sample_docs`` first
    by a hash of the id are used; of equal texts one, toxic if any of them is. The
    features are chosen in this sample by ``least_docs``, ``least_weight`` and
    ``features``; texts are scored whole. Without both classes, as with an empty
    table, there are no coefficients.
    """
    counts = character_counts(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Bounded by sample_docs rows of 12 bytes; one row per distinct labelled text.
    rows = texts.join(F.broadcast(known), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    rows = stored(rows, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(CharModel(counts))
        pos, neg = Counter(), Counter()
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (pos if y else neg).update({f for w in restorer.words(t or "") for f in features_of(w)} | {""})
        names = list(pos | neg)
        cols = [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in (pos, neg))]
        yield pa.RecordBatch.from_arrays(cols, names=["f", "pos", "neg"])

    seen = rows.mapInArrow(released(count), "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    seen = stored(seen.where((F.col("f") == "") | (F.col("pos") >= least_docs)), "toxicity-features")
    total = {r.f: r for r in seen.where("f = ''").collect()}.get("")
    if total is None or not total.pos or not total.neg:
        return counts, {}, None
    odds = F.log((F.col("pos") + 0.5) / (total.pos + 1)) - F.log((F.col("neg") + 0.5) / (total.neg + 1))
    best = seen.where("f <> ''").withColumn("w", odds).where(F.col("w") > least_weight).orderBy(F.desc(F.col("w") * F.sqrt("pos")), "f").limit(features).collect()
    weights = {r.f: r.w for r in best}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(counts, weights, None)
        for batch in batches:
            found = [scorer.evidence(t) for t in batch.column(0).to_pylist()]
            cols = [pa.array([x[k] for x in found], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, batch.column(1)], names=["a", "b", "toxic"])

    # At most sample_docs rows of 20 bytes; sorted here, so that sums don't depend on the partitions.
    data = np.array(sorted([r.a, r.b, r.toxic] for r in rows.mapInArrow(measure, "a double, b double, toxic int").collect()))
    return counts, weights, tuple(logistic(data[:, :2], data[:, 2]).tolist())


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A null or empty text gets the score of a text without evidence; without labels
    of both classes every score is 0. A null doc_id isn't held out. Repeated rows get
    equal scores, an empty table none; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                b = batch.slice(part, 512)
                scores = [scorer.score(t) for t in b.column(2).to_pylist()]
                cols = [b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(released(run), "doc_id long, held_out boolean, score double, predicted int")


def filter_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score under the threshold, with all their columns.

    Null and empty texts are judged as texts without evidence, and stay.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                b = batch.slice(part, 512)
                texts = b.column(b.schema.get_field_index("text")).to_pylist()
                yield b.filter(pa.array([scorer.score(t) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
