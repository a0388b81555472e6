"""Benchmark decontamination 8: BM25 over an inverted index of test items, searched by block-max WAND.

Every training passage (two cells of words) is a query; all items whose BM25 score reaches ``threshold`` are retrieved. Cells are
as long as the item's own length class (``LEAST_CELL`` words, doubled until the item fits), so that no run of an item's length is split, and which other items there are changes
no verdict: an index holds items of one class. Scores are divided
by the item's score for itself, so the threshold means a share of an item's weight. Impacts are fixed at indexing.

Block-max WAND (Ding and Suel 2011): postings are in blocks of consecutive items with the largest impact of each;
a pivot is found from whole-list maxima, checked against block maxima, and only then scored. Most passages
hold no such pivot; a vectorised pass finds them: it sums block maxima over a passage's rare terms, plus the most that frequent terms can add
to an item of the block, and leaves out passages whose blocks all stay below the threshold. This loses nothing.

A retrieved pair is verified: at least 0.8 of the item's 5-word shingles occur in the passage, and 0.8 of
the words of its answer, its last sentence (of one that has only one: its last third).

Indexes have a bounded size: items are taken in runs of at most ``most_words`` words (or one item), each a pass of its own over the documents, and
only one run is with the executors at a time. Document frequencies come from all items by an aggregation, so runs change no score.

Edge cases: null and empty texts, of documents or items, match nothing; an item of fewer than 5 words is one shingle. Equal items are all
found. Ties do not matter, as nothing is ranked or cut off. Very long texts are searched whole, passage by passage. Repeated rows get equal results; a null doc_id is
returned as null. Further columns do not matter; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared, steps, unshare

THRESHOLD, SHINGLE, OVERLAP = 0.6, 5, 0.8
K1, B = 1.2, 0.75
#: Items of a block; words of items in one run of indexes; words of the shortest cells.
BLOCK, MOST_WORDS, LEAST_CELL = 8, 1_000_000, 64
_PUNCTUATION = bytes.maketrans(bytes(x for x in range(128) if not chr(x).isalnum()), b" " * sum(not chr(x).isalnum() for x in range(128)))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")

FOUND = "doc_id long, item_id long, score double, item_overlap double, answer_overlap double, passage long"


def normal_words(text: str | None) -> list[bytes]:
    """Lower-case words between ASCII punctuation and white space."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PUNCTUATION).split()


def answer_words(text: str | None) -> list[bytes]:
    """The words of an item's answer."""
    parts = [w for s in _SENTENCE.split(text or "") if (w := normal_words(s))]
    if len(parts) > 1:
        return parts[-1]
    words = parts[0] if parts else []
    return words[-max(1, len(words) // 3) :] if words else []


def shingles(words: list[bytes], size: int = SHINGLE) -> set[bytes]:
    if not words:
        return set()
    size = min(size, len(words))
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


@dataclass
class Index:
    """An inverted index of items of one length class, with impacts and block maxima."""

    items: list[tuple[int, list[bytes], list[bytes]]]  # id, words, answer
    weights: list[dict[bytes, float]]  # of each item, shares of its own score
    threshold: float
    block: int = BLOCK
    cell: int = LEAST_CELL
    terms: dict[bytes, int] = field(default_factory=dict)
    postings: list[tuple[list[int], list[float]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        for n, w in enumerate(self.weights):
            for term, x in w.items():
                t = self.terms.setdefault(term, len(self.terms))
                if t == len(self.postings):
                    self.postings.append(([], []))
                self.postings[t][0].append(n)
                self.postings[t][1].append(x)
        self.top = [max(p[1]) for p in self.postings]
        self.blocks: list[dict[int, float]] = []
        for at, xs in self.postings:
            best: dict[int, float] = {}
            for n, x in zip(at, xs, strict=True):
                best[n // self.block] = max(best.get(n // self.block, 0.0), x)
            self.blocks.append(best)
        # Frequent terms are left out of the vectorised pass as long as no item gets over half the threshold from them.
        mass = np.zeros(len(self.items))
        self.rare = np.ones(len(self.postings), bool)
        for t in sorted(range(len(self.postings)), key=lambda t: -len(self.postings[t][0])):
            at, xs = self.postings[t]
            more = mass[at] + xs
            if len(at) < 2 or more.max() > self.threshold / 2:
                break
            mass[at] = more
            self.rare[t] = False
        self.n_blocks = -(-len(self.items) // self.block)
        self.left = np.zeros(self.n_blocks)
        np.maximum.at(self.left, np.arange(len(mass)) // self.block, mass)
        flat = [(b, x) for t, bs in enumerate(self.blocks) if self.rare[t] for b, x in bs.items()]
        size = np.array([len(bs) if self.rare[t] else 0 for t, bs in enumerate(self.blocks)], np.int64)
        self.flat_start, self.flat_size = np.cumsum(size) - size, size
        self.flat_block = np.array([b for b, _ in flat], np.int64)
        self.flat_max = np.array([x for _, x in flat], np.float64)
        self.shingles = [shingles(w) for _, w, _ in self.items]
        self.answers = [set(a) for _, _, a in self.items]

    def promising(self, term: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
        """The passages (of n) that have a block whose bound reaches the threshold. term: -1 where not indexed."""
        ok = term >= 0
        ok[ok] = self.rare[term[ok]]
        pair = np.unique(passage[ok] * len(self.postings) + term[ok])
        p, t = np.divmod(pair, max(1, len(self.postings)))
        size = self.flat_size[t]
        at = np.repeat(self.flat_start[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key, inverse = np.unique(np.repeat(p, size) * self.n_blocks + self.flat_block[at], return_inverse=True)
        bound = np.bincount(inverse, self.flat_max[at], len(key)) + self.left[key % self.n_blocks]
        return np.unique(key[bound >= self.threshold - 1e-9] // self.n_blocks)

    def search(self, query: set[int]) -> list[tuple[int, float]]:
        """All (item number, score) that reach the threshold, by block-max WAND."""
        lists = [(self.postings[t][0], self.postings[t][1], self.top[t], self.blocks[t]) for t in query]
        cursor = [0] * len(lists)
        live = list(range(len(lists)))
        out: list[tuple[int, float]] = []
        need = self.threshold - 1e-9
        while live:
            live.sort(key=lambda i: lists[i][0][cursor[i]])
            bound, pivot = 0.0, -1
            for k, i in enumerate(live):
                bound += lists[i][2]
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[live[pivot]][0][cursor[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][cursor[live[pivot + 1]]] == item:
                pivot += 1
            block = item // self.block
            if sum(lists[i][3].get(block, 0.0) for i in live[: pivot + 1]) < need:  # no item of these lists in this block
                after = (block + 1) * self.block
                if pivot + 1 < len(live):
                    after = min(after, lists[live[pivot + 1]][0][cursor[live[pivot + 1]]])
                move, to = live[: pivot + 1], max(after, item + 1)
            elif lists[live[0]][0][cursor[live[0]]] == item:
                score = sum(lists[i][1][cursor[i]] for i in live[: pivot + 1])
                if score >= need:
                    out.append((item, score))
                move, to = live[: pivot + 1], item + 1
            else:
                move, to = [i for i in live[: pivot + 1] if lists[i][0][cursor[i]] < item], item
            for i in move:
                at, c = lists[i][0], cursor[i]
                while c < len(at) and at[c] < to:
                    c += 1
                cursor[i] = c
            live = [i for i in live if cursor[i] < len(lists[i][0])]
        return out

    def matches(self, per: list[list[bytes]], counts: np.ndarray, term: np.ndarray) -> list[tuple[int, int, float, float, float, int]]:
        """(row, item number, score, item overlap, answer overlap, passage): the best passage of each verified pair.

        ``per``: the words of each text, ``counts``: how many; ``term``: the numbers of all words, -1 where not indexed.
        """
        get, cell = self.terms.get, self.cell
        # Passage k of a document covers its cells k and k + 1.
        cells = np.maximum(1, -(-counts // cell))
        base = np.cumsum(cells) - cells
        row = np.repeat(np.arange(len(per)), counts)
        at = np.arange(len(term)) - (np.cumsum(counts) - counts)[row]
        here = base[row] + at // cell
        hit = np.flatnonzero(term >= 0)
        earlier = hit[at[hit] >= cell]
        passages = self.promising(np.r_[term[hit], term[earlier]], np.r_[here[hit], here[earlier] - 1], int(cells.sum()))
        rows = np.searchsorted(base, passages, side="right") - 1
        best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        for p, r in zip(passages.tolist(), rows.tolist(), strict=True):
            k = p - int(base[r])
            words = per[r][k * cell : (k + 2) * cell]
            found = self.search({t for t in map(get, words) if t is not None})
            if not found:
                continue
            have, inside = None, set(words)
            for item, score in found:
                size = min(SHINGLE, len(self.items[item][1]))
                if size < SHINGLE:
                    mine = shingles_of(words, size)
                else:
                    mine = have = have if have is not None else shingles_of(words, SHINGLE)
                whole = len(self.shingles[item] & mine) / len(self.shingles[item])
                answer = len(self.answers[item] & inside) / len(self.answers[item])
                score = round(score, 9)  # terms come in any order; of equal passages the first counts
                if whole >= OVERLAP and answer >= OVERLAP and (whole, score) > best.get((r, item), (0.0, 0.0))[:2]:
                    best[r, item] = (whole, score, answer, k)
        return [(r, item, score, whole, answer, k) for (r, item), (whole, score, answer, k) in best.items()]


@dataclass
class Run:
    """Indexes that go over the documents together, a length class each."""

    indexes: list[Index]

    def __post_init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        for index in self.indexes:
            for term in index.terms:
                self.terms.setdefault(term, len(self.terms))
        # The number that a term of the run has in each index.
        self.own = []
        for index in self.indexes:
            own = np.full(len(self.terms) + 1, -1, np.int64)
            own[[self.terms[t] for t in index.terms]] = list(index.terms.values())
            self.own.append(own)

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int | None, float, float, float, int]]:
        """(row, item id, score, item overlap, answer overlap, passage) of each verified pair."""
        get = self.terms.get
        per = [normal_words(t) for t in texts]
        counts = np.fromiter(map(len, per), np.int64, len(per))
        term = np.fromiter((get(w, -1) for ws in per for w in ws), np.int64, int(counts.sum()))
        for index, own in zip(self.indexes, self.own, strict=True):
            for r, n, *rest in index.matches(per, counts, own[term]):
                yield r, index.items[n][0], *rest


def length_class(words: list[bytes], least: int = LEAST_CELL) -> int:
    """The cell that an item of these words fits in."""
    return least << max(0, -(-len(words) // least) - 1).bit_length()


def shingles_of(words: list[bytes], size: int) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def runs(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD, most_words: int = MOST_WORDS, block: int = BLOCK) -> Iterator[Run]:
    """The indexes over all items, in runs of a bounded size; BM25 statistics are those of all items."""
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            out = [(i, w, answer_words(t)) for i, t in zip(part.column("item").to_pylist(), part.column("text").to_pylist(), strict=True) if (w := normal_words(t))]
            if out:
                i, w, a = zip(*out, strict=True)
                words = pa.list_(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(w, words), pa.array(a, words)], names=["item", "words", "answer"])

    split = rows.mapInArrow(cut, "item long, words array<binary>, answer array<binary>")
    n, total = split.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    if not n:
        return
    mean = total / n
    each = split.withColumn("term", F.explode(F.array_distinct("words")))
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    key = F.xxhash64("item", "words")
    known = split.withColumn("key", key).withColumn("term", F.explode(F.array_distinct("words"))).select("key", "term").distinct().join(df, "term").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
    ordered = split.withColumn("key", key).join(known, "key").orderBy("item").select("item", "words", "answer", "df")

    def weigh(words: list[bytes], freq: dict[bytes, int]) -> dict[bytes, float]:
        tf = Counter(words)
        raw = {w: math.log(1 + (n - freq[w] + 0.5) / (freq[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean)) for w, c in tf.items()}
        own = sum(raw.values())
        return {w: x / own for w, x in raw.items()}

    def run_of(held: dict[int, list[tuple]]) -> Run:
        return Run([Index([x[0] for x in of], [x[1] for x in of], threshold, block, cell) for cell, of in sorted(held.items())])

    held: dict[int, list[tuple]] = defaultdict(list)
    size = 0
    for r in ordered.toLocalIterator():  # a run at a time
        words = [bytes(w) for w in r["words"]]
        held[length_class(words)].append(((r["item"], words, [bytes(w) for w in r["answer"]]), weigh(words, {bytes(k): v for k, v in r["df"].items()})))
        size += len(words)
        if size >= most_words:
            yield run_of(held)
            held, size = defaultdict(list), 0
    if held:
        yield run_of(held)


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """One row of ``FOUND`` for each document and item that it holds. No shuffle of documents."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def found(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in steps(batches, "text"):
                ids = part.column("doc_id").to_pylist()
                if got := [(ids[r], *rest) for r, *rest in sent.value.matches(part.column("text").to_pylist())]:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "score", "item_overlap", "answer_overlap", "passage"])

        return rows.mapInArrow(run, FOUND)

    out = None
    for some in _one_at_a_time(spark, items, options, found, "leaks"):
        out = some if out is None else out.unionByName(some)
    return out if out is not None else spark.createDataFrame([], FOUND)


def _one_at_a_time(spark: SparkSession, items: DataFrame, options: dict, step: Callable[[Broadcast], DataFrame], name: str) -> Iterator[DataFrame]:
    """What ``step`` makes of each run: a table is written before the next run is sent, and its broadcast ends there; the last result is still a plan."""
    sent, last = None, None
    for run in runs(items, **options):
        if sent is not None:
            yield shared(last, name)
            sent.destroy()
        sent = spark.sparkContext.broadcast(run)
        last = step(sent)
    if last is not None:
        yield last


def drop_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options: float) -> DataFrame:
    """The documents that hold no item, with all their columns. Row by row; each run goes over what the one before has left."""
    left, at = [docs], docs.columns.index(text_col)

    def clean(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.schema.names
                for part in steps([batch.rename_columns([f"c{i}" for i in range(len(names))])], f"c{at}"):
                    ok = np.ones(part.num_rows, bool)
                    ok[[m[0] for m in sent.value.matches(part.column(at).to_pylist())]] = False
                    yield part.filter(pa.array(ok)).rename_columns(names)

        return left[-1].mapInArrow(run, docs.schema)

    for some in _one_at_a_time(docs.sparkSession, items, options, clean, "clean"):
        left.append(some)
        if len(left) > 3:  # read by the table that was just written, or is about to be
            unshare(left.pop(-3))
    return left[-1]
