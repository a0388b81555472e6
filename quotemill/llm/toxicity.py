"""Toxicity 9: noisy-channel deobfuscation, then a score of the restored text.

1. A character trigram model is counted over all documents (a bounded table: 64**3 counts, summed map-side).
2. Words that may be disguised become character lattices: words with a letter twice or more in a row, with digits or signs among their letters, or with
   separators or masks between them. Each run of a letter may be meant once, twice or as it stands, a sign may stand for the letters it resembles, a
   separator for nothing, for a blank or, alone, for a masked letter. Three or more single letters with gaps of any width between them are one lattice,
   whose gaps may vanish. The channel's costs and the character model decide: Viterbi decoding takes the path of least cost, which may be the word as it
   stands. Two neighbouring words that make a known toxic one together are read as one if that reading costs least.
3. Words and word beginnings that are commoner in toxic documents get a weight (log odds), learned from at most ``train_rows`` labelled
   documents, chosen by a hash of doc_id among those that are not held out. The weights a document's restored words have are summed up into a few
   features; a logistic regression, fitted on features made with the other half's weights, turns them into a score.

All features that occur in ``LEAST_SEEN`` toxic documents of the sample and are clearly commoner there are kept, however many.
Held-out rows (crc32 of doc_id as text, modulo 4, is 2) are never learned from; labels, lang, source and doc_id are never features.

Edge cases: null and empty texts get the score of a text without words. A null doc_id is not held out and not learned from. If there are no
labels of both kinds, scores are the share of toxic labels (0 without labels). Repeated rows score alike; of rows with one doc_id, one is learned from. Very long texts and
words are read whole, in time that follows their length. Further columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared, steps, unshare

CUT = 0.3
#: Labelled documents that are learned from; least toxic documents that a feature occurs in.
TRAIN_ROWS, LEAST_SEEN = 12_000, 4
PREFIXES = (4, 5, 6, 7)

# The alphabet of the character model, and what signs may stand for.
ALPHABET = " abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöùúûüßœ"
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}

SIDE = 64
OTHER = len(ALPHABET)
_CODE = {c: i for i, c in enumerate(ALPHABET)}
_TABLE = np.full(0x2000, OTHER, np.int64)
for _c, _i in _CODE.items():
    _TABLE[ord(_c)] = _i
for _c in "\t\n\v\f\r":
    _TABLE[ord(_c)] = 0

_EDGE = " \t.,;:?!\"'()[]{}#*$%&|<>-_/\\=~`"
_SEPARATORS, _MASKS = r".\-_*/#~,:;=·•", "*#"
_LETTER = re.compile(r"[^\W\d_]")
#: What may be disguised: a letter in a row, a sign or digit that resembles a letter, a separator.
_SITE = re.compile(rf"([^\W\d_])\1+|([0-9@$!|+(€])\2*|[{_SEPARATORS}]+")
#: Single letters or signs with gaps that hold a blank; letters and gaps share no character, so no part can be matched in two ways.
_GAP = rf"[{_SEPARATORS}]*+[ \t\n\v\f\r][{_SEPARATORS} \t\n\v\f\r]*+"
_SPACED = re.compile(rf"(?<![^ \t\n\v\f\r])[^\W_@$!|+€](?:{_GAP}(?:[^\W_]|[@$!|+€])){{2,}}(?=[{_SEPARATORS}]*+(?:[ \t\n\v\f\r]|\Z))")
_SPACED_PART = re.compile(rf"({_GAP})|.", re.S)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Prices of the channel: another sign for a letter, a masked letter, a letter masked by a separator; a blank within a word.
RESEMBLES, MASKED, HIDDEN, SPLIT = 1.5, 2.0, 4.0, 2.5


def char_codes(text: str) -> np.ndarray:
    """The model's symbols of lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts of (text): an array of 64**3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIDE**3, np.int64)
        for part in steps(batches, "text"):
            c = char_codes(" " + " ".join(t for t in part.column("text").to_pylist() if t) + " ")
            total += np.bincount(c[:-2] * SIDE * SIDE + c[1:-1] * SIDE + c[2:], minlength=SIDE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    out = np.zeros(SIDE**3)
    for r in docs.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # 64**3 at most
        out[r["code"]] = r["n"]
    return out


def char_model(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), interpolated with bigrams and single symbols."""
    tri = counts.reshape(SIDE, SIDE, SIDE)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + SIDE)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    p3 = (tri + 20 * p2) / (tri.sum(2, keepdims=True) + 20)
    return -np.log(p3).astype(np.float32)


def _run(price: float, letter: str, n: int) -> list[tuple[float, str]]:
    """What n equal signs in a row may mean, if one means ``letter``."""
    if n == 1:
        return [(price, letter)]
    if n == 2:
        return [(price, letter * 2), (price + 2.5, letter)]
    return [(price + 0.7, letter), (price + 1.0, letter * 2), (price + 4.0, letter * n)]


def _sign(run: str) -> list[tuple[float, str]]:
    """What a run of one sign may mean."""
    return [x for price, letter in [(0.0, run[0]), *((RESEMBLES, x) for x in LOOKS_LIKE.get(run[0], ""))] for x in _run(price, letter, len(run))]


def _separator(run: str, alone: bool) -> list[tuple[float, str]]:
    """What separators within a word may mean: one without others about it may hide a letter."""
    out = [(0.5, " "), (1.0, "")]
    return out + [(MASKED if run in _MASKS else HIDDEN, c) for c in ALPHABET[1:]] if alone and len(run) == 1 else out


#: A lattice: texts that are certain, and lists of (price, reading).
Lattice = list[str | list[tuple[float, str]]]


def word_lattice(word: str) -> Lattice:
    out: Lattice = []
    at, last, sites = 0, -3, list(_SITE.finditer(word))
    for k, m in enumerate(sites):
        if m.start() > at:
            out.append(word[at : m.start()])
        if m[1] or m[2]:
            out.append(_sign(m.group()))
        else:
            following = next((x.start() for x in sites[k + 1 : k + 4] if not (x[1] or x[2])), len(word) + 3)
            out.append(_separator(m.group(), min(m.start() - last, following - m.end()) > 2))
            last = m.end()
        at = m.end()
    return [*out, word[at:]] if at < len(word) else out


def spaced_lattice(run: str) -> Lattice:
    """Of single letters: the narrowest gaps stand between letters, wider ones rather between words."""
    parts = [(m.group(), bool(m[1])) for m in _SPACED_PART.finditer(run)]
    least = min((len(x) for x, gap in parts if gap), default=0)
    return [([(0.3, ""), (1.5, " ")] if len(x) == least else [(1.0, ""), (0.3, " ")]) if gap else _sign(x) for x, gap in parts]


@dataclass
class Restorer:
    """Viterbi decoding of disguised words, in lower case."""

    cost: np.ndarray  # -log P(c | a, b)
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.price = self.cost.tolist()

    def word(self, low: str) -> tuple[str, ...]:
        """The restored words of one word, without punctuation around it; a separator may have parted several."""
        bare = low.strip(_EDGE)
        if low[:1] in "$@€" and len(bare) > 1:
            bare = low[:1] + bare
        if not _SITE.search(bare) or len(_LETTER.findall(bare)) < 2:
            return (bare,) if bare else ()
        if bare not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[bare] = tuple(self.decode(word_lattice(bare)).split())
        return self.known[bare]

    def spaced(self, run: str) -> list[str]:
        """The words of single letters with gaps; signs and digits alone stay as they are."""
        return self.decode(spaced_lattice(run)).split() if len(_LETTER.findall(run)) > 1 else _WORD.findall(run)

    def text(self, text: str) -> list[str]:
        """The restored words of a text."""
        low = text.lower()
        out: list[str] = []
        at = 0
        for m in _SPACED.finditer(low):
            out += [w for x in _WORD.findall(low[at : m.start()]) for w in self.word(x)]
            out += self.spaced(m.group())
            at = m.end()
        out += [w for x in _WORD.findall(low[at:]) for w in self.word(x)]
        return out

    def joins(self, a: str, b: str) -> bool:
        """Whether two words read best as one."""
        return " " not in self.decode([a, [(SPLIT, ""), (0.0, " ")], b])

    def decode(self, lattice: Lattice) -> str:
        """The least costly reading. Two certain letters make one path of all, so certain text costs no search."""
        price = self.price
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for part in lattice:
            rest = ""
            if isinstance(part, str):
                part, rest = [(0.0, part[:2])], part[2:]
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (spent, back) in paths.items():
                for more, text in part:
                    x, y, total = a, b, spent + more
                    for ch in text:
                        c = _CODE.get(ch, OTHER)
                        if c or y:  # no two spaces
                            total += price[x][y][c]
                            x, y = y, c
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, (text, back))
            paths = after
            if rest:
                ((_, (_, back)),) = paths.items()
                ends = [_CODE.get(ch, OTHER) for ch in (part[0][1] + rest)[-2:]]
                paths = {(ends[0], ends[1]): (0.0, (rest, back))}
        _, chain = min(((s + price[a][b][0], back) for (a, b), (s, back) in paths.items()), key=lambda p: p[0])
        out = []
        while chain:
            out.append(chain[0])
            chain = chain[1]
        return "".join(reversed(out)).strip()


def features_of(word: str) -> list[str]:
    """A word and its beginnings (marked)."""
    return [word, *(f"{word[:n]}^" for n in PREFIXES if n <= len(word))]


class Weights(dict):
    """The weight of a raw lower-case word: that of its restored words or of one of their beginnings, whichever is largest."""

    def __init__(self, lexicon: dict[str, float], restorer: Restorer) -> None:
        super().__init__()
        self.lexicon, self.restorer = lexicon, restorer

    def of(self, word: str) -> float:
        return max((x for f in features_of(word) if (x := self.lexicon.get(f)) is not None), default=0.0)

    def __missing__(self, raw: str) -> float:
        if len(self) > 300_000:
            self.clear()
        w = self[raw] = max(map(self.of, self.restorer.word(raw)), default=0.0)
        return w

    def of_words(self, words: list[str]) -> list[float]:
        """The weights that are not 0, of words and of neighbours that are one word."""
        each = [self[x] for x in words]
        got = [w for w in each if w]
        for k, (a, b) in enumerate(zip(words, words[1:], strict=False)):
            joined = (a + b).strip(_EDGE)
            if joined in self.lexicon and not each[k] and not each[k + 1] and self.restorer.joins(a.lstrip(_EDGE), b.rstrip(_EDGE)):
                got.append(self.lexicon[joined])
        return got


def summary(text: str | None, weights: Weights) -> list[float]:
    """The features of a document."""
    low = (text or "").lower()
    got: list[float] = []
    at = n = 0
    for m in _SPACED.finditer(low):
        words = _WORD.findall(low[at : m.start()])
        restored = weights.restorer.spaced(m.group())
        got += weights.of_words(words) + [w for x in restored if (w := weights.of(x))]
        n += len(words) + len(restored)
        at = m.end()
    words = _WORD.findall(low[at:])
    got += weights.of_words(words)
    n += len(words)
    total, size = sum(got), math.log1p(n)
    return [1.0, math.log1p(total), max(got, default=0.0), math.log1p(len(got)), size, math.log1p(total) * size / 8, math.log1p(100 * total / (n + 20))]


#: What makes a feature clearly commoner in toxic documents: standard errors above ``ODDS`` of log odds, and not rarer than a quarter of all that have it.
ERRORS, ODDS, QUARTER = 1.65, 0.5, 3


def lexicon_of(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log odds of features that are clearly commoner in toxic documents: (feature, toxic documents, clean documents)."""
    out = {}
    for f, p, n in counts:
        if p >= LEAST_SEEN and p * QUARTER > n:
            odds = math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))
            spread = math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
            if odds - ERRORS * spread > ODDS:
                out[f] = odds - spread
    return out


def _telling(p: Column, n: Column, toxic: int, clean: int) -> Column:
    """The same condition (a hair wider) where counts are a table, so that only features of a lexicon leave it."""
    odds = F.log((p + 0.5) / (toxic + 1.0)) - F.log((n + 0.5) / (clean + 1.0))
    return (p >= LEAST_SEEN) & (p * QUARTER > n) & (odds - ERRORS * F.sqrt(1 / (p + 0.5) + 1 / (n + 0.5)) > ODDS - 1e-6)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; column 0 is not shrunk."""
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    cost: np.ndarray
    lexicon: dict[str, float]
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, texts: list[str | None], weights: Weights) -> np.ndarray:
        x = (np.array([summary(t, weights) for t in texts]).reshape(len(texts), -1) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS) -> Model:
    """docs: (doc_id, text), labels: (doc_id, toxic)."""
    spark = docs.sparkSession
    cost = char_model(char_counts(docs.select("text")))
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit("train"))).limit(train_rows)
    # The bound makes this side small enough to broadcast: texts are not shuffled, but for those of the sample. One row counts of each document.
    own = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("own")
    texts = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(own)
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int").alias("fold")
    sample = shared(texts.select(F.col("own.text").alias("text"), "toxic", fold).repartition(4 * max(1, spark.sparkContext.defaultParallelism // 2)), "toxicity-sample")
    size = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # 4 rows
    p0, p1, n0, n1 = (size.get(k, 0) for k in ((0, 1), (1, 1), (0, 0), (1, 0)))
    width = len(summary("", Weights({}, Restorer(cost))))
    if not p0 + p1 or not n0 + n1:
        w = np.zeros(width)
        w[0] = 30.0 if p0 + p1 else -30.0
        return Model(cost, {}, w, np.zeros(width), np.ones(width))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(cost)
        seen: list[Counter] = [Counter() for _ in range(4)]
        for part in steps(batches, "text"):
            for text, toxic, fold in zip(*(part.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                seen[2 * fold + toxic].update({f for w in restorer.text(text or "") for f in features_of(w)})
        every = [(f, fold, toxic, n) for fold in (0, 1) for toxic in (0, 1) for f, n in seen[2 * fold + toxic].items()]
        for at in range(0, len(every), 50_000):
            f, fold, toxic, n = zip(*every[at : at + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(fold, pa.int32()), pa.array(toxic, pa.int32()), pa.array(n, pa.int64())], names=["f", "fold", "toxic", "n"])

    of = lambda fold, toxic: F.sum(F.when((F.col("fold") == fold) & (F.col("toxic") == toxic), F.col("n")).otherwise(0))
    counts = sample.mapInArrow(count, "f string, fold int, toxic int, n long").groupBy("f").agg(of(0, 1).alias("p0"), of(1, 1).alias("p1"), of(0, 0).alias("n0"), of(1, 0).alias("n1"))
    c = {x: F.col(x) for x in ("p0", "p1", "n0", "n1")}
    told = _telling(c["p0"] + c["p1"], c["n0"] + c["n1"], p0 + p1, n0 + n1) | _telling(c["p1"], c["n1"], p1, n1) | _telling(c["p0"], c["n0"], p0, n0)
    rows = counts.filter(told).collect()  # features of the lexicons, found in a bounded sample
    lexicon = lexicon_of([(r["f"], r["p0"] + r["p1"], r["n0"] + r["n1"]) for r in rows], p0 + p1, n0 + n1)
    # A document's features for the fit are made with weights of the other half.
    others = [lexicon_of([(r["f"], r["p1"], r["n1"]) for r in rows], p1, n1), lexicon_of([(r["f"], r["p0"], r["n0"]) for r in rows], p0, n0)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [Weights(x, Restorer(cost)) for x in others]
        for part in steps(batches, "text"):
            toxic, fold = part.column("toxic"), part.column("fold").to_pylist()
            x = [summary(t, weights[k]) for t, k in zip(part.column("text").to_pylist(), fold, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), toxic], names=["x", "toxic"])

    got = sample.mapInArrow(measure, "x array<double>, toxic int").collect()  # train_rows at most
    unshare(sample)
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float)
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order rows came in
    x, y = x[order], y[order]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    mean[0], scale[0] = 0.0, 1.0
    return Model(cost, lexicon, logistic((x - mean) / scale, y), mean, scale)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(rows, labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).alias("toxic")), train_rows=train_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        weights = Weights(model.lexicon, Restorer(model.cost))
        for part in steps(batches, "text"):
            score = model.scores(part.column("text").to_pylist(), weights)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
