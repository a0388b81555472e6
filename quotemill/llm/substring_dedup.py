"""Substring dedup 1: repeated windows of 50 words, found through super-k-mers.

A window of 50 words has a minimiser: the least hash among its runs of 8 words. Consecutive windows that share it form a super-k-mer and go
to the minimiser's bucket as one packed string, so a word is not sent 50 times. In a bucket the windows are sorted by their
words, and runs of equal windows give the smallest document each window starts in.

Less is sent than all super-k-mers:

1. Each document names its super-k-mers by (minimiser, content hash): 16 bytes for some 20 windows. They are written once. Equal ones are
   pre-aggregated to the smallest document, so copies of a text or passage meet as counts.
2. Only minimisers that have two or more different contents need their windows compared; of each such content, one document (the smallest) sends
   the packed string to the bucket, and of repeated rows one.
3. In the bucket, sorting (prefix doubling over word numbers, many buckets at a time) gives each window's smallest document.
4. What a document loses follows from its contents' answers. Texts meet their answers by one join on the document.

A bucket with over ``most`` contents is not gathered: its windows go on alone, as 128-bit hashes aggregated to the smallest
document with map-side combining, so no bucket's size bounds the job.

Words of a document are compared with those of documents with a smaller doc_id only, on the input as given.

What steps hand on is written to the shared folder, and freed once the spans are known. So joins read tables on both sides, and the engine can split a
key of theirs that many rows share (a minimiser of near copies, a passage that many documents hold).

Edge cases: null and empty texts have no words and come back with n_words 0; documents of fewer than 50 words lose
nothing; very long texts are worked on whole, their super-k-mers dealt out like those of others. Rows with the same doc_id (repeated rows too) never take from one another. A null doc_id is larger than all others, so the row loses what
occurs elsewhere and takes from none. Further columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, as_bytes, free_name, parted, shared, steps, unshare, words_of

WINDOW, MINIMISER = 50, 8
#: Windows of one super-k-mer; contents of a bucket that are sorted in one task.
LONGEST, MOST = 64, 8192
#: Stands for a null doc_id: larger than any other.
NO_ID = (1 << 63) - 1
ANSWERS = "key long, content long, first_doc long, least binary"


class Hashes(dict):
    """A word's 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs; wraps modulo 2**64."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019) + (a >> np.uint64(17)))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, by doubling."""
    out, have, power, span = None, 0, h, 1
    while size:
        if size & 1:
            out = power if out is None else _mix(out[: len(h) - have - span + 1], power[have : len(h) - span + 1])
            have += span
        size >>= 1
        if size:
            power = _mix(power[: len(power) - span], power[span:])
            span *= 2
    return out


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minima of all runs of ``size`` values."""
    span = 1
    while 2 * span <= size:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = size - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def super_kmers(hashes: np.ndarray, counts: np.ndarray, window: int, minimiser: int, longest: int) -> tuple[np.ndarray, ...]:
    """(document, start, windows, key, content) of every super-k-mer; ``start`` counts from the document's first word.

    ``hashes``: word hashes of documents one after another, ``counts``: words of each. Content is a hash of the words.
    """
    empty = np.zeros(0, np.int64)
    if len(hashes) < window:
        return empty, empty, empty, empty, empty
    least = sliding_min(run_hashes(hashes, minimiser), window - minimiser + 1)  # of the window that starts here
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    at = np.arange(len(least))
    whole = at + window <= (first + counts)[doc]
    new = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]
    begin = np.maximum.accumulate(np.where(new, at, 0))
    new |= (at - begin) % longest == 0
    new &= whole
    starts = at[new]
    if not len(starts):
        return empty, empty, empty, empty, empty
    last_window = first + counts - window  # last window of each document
    windows = np.minimum(np.r_[starts[1:], len(least) + window], last_window[doc[starts]] + 1) - starts
    windows = np.minimum(windows, longest)
    # A prefix hash of words, by powers of an odd number, gives the content of any run.
    words = windows + window - 1
    power = np.full(len(hashes) + 1, np.uint64(0x9E3779B97F4A7C15 | 1))
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.r_[np.uint64(0), np.cumsum(hashes * power[:-1], dtype=np.uint64)]
    inverse = pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
    back = np.full(int(starts[-1]) + 1, np.uint64(inverse))
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    content = _mix((total[starts + words] - total[starts]) * back[starts], words.astype(np.uint64))
    return doc[starts], starts - first[doc[starts]], windows, least[starts].view(np.int64), content.view(np.int64)


def _named(docs: DataFrame, window: int, minimiser: int, longest: int) -> DataFrame:
    """(key, content, doc, row, place): every super-k-mer of every row. ``place``: start * 128 + windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Hashes()
        for part in steps(batches, "text"):
            per = [words_of(t) for t in part.column("text").to_pylist()]
            counts = np.fromiter(map(len, per), np.int64, len(per))
            hashes = np.fromiter((table[w] for ws in per for w in ws), np.uint64, int(counts.sum()))
            n, start, windows, key, content = super_kmers(hashes, counts, window, minimiser, longest)
            doc, row = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, content, doc[n], row[n], start * 128 + windows)], names=["key", "content", "doc", "row", "place"])

    return docs.select("doc", "row", "text").mapInArrow(run, "key long, content long, doc long, row long, place long")


def _packed(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(key, content, doc, size, packed): the words of the wanted super-k-mers. ``wanted``: (row, doc, want[key, content, place, size])."""
    # Repeated rows have one (doc, row): the join brings them together, and one of them answers.
    both = wanted.join(docs.select("doc", "row", "text"), ["doc", "row"]).dropDuplicates(["doc", "row"]).select("doc", "want", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            out: list[tuple] = []
            for doc, want, text in zip(part.column("doc").to_pylist(), part.column("want").to_pylist(), part.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for w in want:
                    start, windows = divmod(w["place"], 128)
                    out.append((w["key"], w["content"], doc, w["size"], b" ".join(words[start : start + windows + window - 1])))
            if out:
                *numbers, packed = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(packed, pa.binary())], names=["key", "content", "doc", "size", "packed"])

    return both.mapInArrow(run, "key long, content long, doc long, size long, packed binary")


def smallest_docs(token: np.ndarray, counts: np.ndarray, bucket: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts all windows of packed strings: the smallest document of each, and the string it belongs to.

    ``token``: word numbers of strings one after another; ``counts``, ``bucket``, ``doc``: of each string.
    Ranks of runs of 1, 2, 4, ... words are doubled up to the window's length; equal ranks are equal words.
    """
    string = np.repeat(np.arange(len(counts)), counts)
    rank = np.unique(bucket[string] * (int(token.max()) + 1) + token, return_inverse=True)[1].astype(np.int64)
    span = 1
    while 2 * span <= window:
        rank = np.unique(rank[: len(rank) - span] * (len(string) + 1) + rank[span:], return_inverse=True)[1].astype(np.int64)
        span *= 2
    if rest := window - span:
        rank = np.unique(rank[: len(rank) - rest] * (len(string) + 1) + rank[rest:], return_inverse=True)[1].astype(np.int64)
    end = np.cumsum(counts)
    whole = np.flatnonzero(np.arange(len(rank)) + window <= end[string[: len(rank)]])
    order = whole[np.lexsort((doc[string[whole]], rank[whole]))]  # equal windows side by side, smallest document first
    head = np.r_[True, rank[order][1:] != rank[order][:-1]]
    out = np.zeros(len(rank), np.int64)
    out[order] = doc[string[order]][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    return out[whole], string[whole]


def _sorted_buckets(packed: DataFrame, window: int) -> DataFrame:
    """(key, content, first_doc, least binary): the content's own document, and per window the smallest, little-endian longs; buckets come whole."""
    arranged = packed.repartition("key").sortWithinPartitions("key")

    def solve(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        ids = Ids()
        per = [words_of(r[3]) for r in rows]
        counts = np.fromiter(map(len, per), np.int64, len(per))
        token = np.fromiter((ids[w] for ws in per for w in ws), np.int64, int(counts.sum()))
        key = np.array([r[0] for r in rows], np.int64)
        bucket = np.unique(key, return_inverse=True)[1].astype(np.int64)
        least, string = smallest_docs(token, counts, bucket, np.array([r[2] for r in rows], np.int64), window)
        cuts = np.searchsorted(string, np.arange(len(rows) + 1))
        data = [least[cuts[i] : cuts[i + 1]].astype("<i8").tobytes() for i in range(len(rows))]
        return pa.RecordBatch.from_arrays([pa.array(key), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)), pa.array(data, pa.binary())], names=["key", "content", "first_doc", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "content", "doc", "packed")), strict=True):
                if row[0] != last and size > 1 << 20:  # a bucket stays whole
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                last = row[0]
        if held:
            yield solve(held)

    return arranged.mapInArrow(run, ANSWERS)


def _spread_buckets(packed: DataFrame, window: int) -> DataFrame:
    """The same for buckets that no task gathers: windows are aggregated by their 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "packed", 1 << 18):
            out: list[tuple] = []
            for key, content, doc, packed_words in zip(*(part.column(c).to_pylist() for c in ("key", "content", "doc", "packed")), strict=True):
                words = words_of(packed_words)
                for i in range(len(words) - window + 1):
                    h = xxhash.xxh3_128_digest(b" ".join(words[i : i + window]))
                    out.append((key, content, doc, i, *struct.unpack(">qq", h)))
            if out:
                cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "content", "doc", "i", "h1", "h2"])

    windows = packed.mapInArrow(run, "key long, content long, doc long, i long, h1 long, h2 long")
    least = windows.groupBy("h1", "h2").agg(F.min("doc").alias("m"))
    found = windows.join(least, ["h1", "h2"])
    # A content has LONGEST windows at most.
    per = found.groupBy("key", "content", "doc").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("w"))

    def pack_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array([x["m"] for x in w], "<i8").tobytes() for w in batch.column("w").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "content", "doc")), pa.array(data, pa.binary())], names=["key", "content", "first_doc", "least"])

    return per.mapInArrow(pack_up, ANSWERS)


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, minimiser: int = MINIMISER, longest: int = LONGEST, most: int = MOST) -> DataFrame:
    """(doc, row, spans): for each row of (doc, row, text) that loses words, [start, end) packed as start << 32 | end."""
    if not 0 < longest < 128:
        raise ValueError("longest must be below 128")
    named = shared(_named(docs, window, minimiser, longest), "super-kmers")
    one = F.min(F.struct("doc", "row", "place"))
    contents = named.groupBy("key", "content").agg(one.alias("first"), F.max("doc").alias("last")).select("key", "content", "first.*", "last")
    contents = shared(contents, "contents")
    sizes = shared(contents.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "bucket-sizes")
    wanted = contents.join(sizes, "key").groupBy("doc", "row").agg(F.collect_list(F.struct("key", "content", "place", "size")).alias("want"))
    packed = shared(_packed(docs, wanted, window), "packed")
    answers = _sorted_buckets(packed.filter(F.col("size") <= most).drop("size"), window).unionByName(_spread_buckets(packed.filter(F.col("size") > most).drop("size"), window))
    # What can take something: answers, and contents that a later document has too; the answers of these name the same windows, and more.
    again = contents.filter(F.col("last") > F.col("doc")).select("key", "content", F.col("doc").alias("first_doc"), F.lit(None).cast("binary").alias("least"))
    known = shared(answers.unionByName(again), "known")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, row, place, first, least in zip(*(batch.column(c).to_pylist() for c in ("doc", "row", "place", "first_doc", "least")), strict=True):
                start, windows = divmod(place, 128)
                hit = np.frombuffer(least, "<i8") < doc if least is not None else np.full(windows, first < doc)
                edge = np.flatnonzero(np.diff(np.r_[False, hit, False]))
                out += [(doc, row, (start + a) << 32 | (start + b - 1 + window)) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc", "row", "span"])

    hits = named.join(known, ["key", "content"]).select("doc", "row", "place", "first_doc", "least").mapInArrow(spans, "doc long, row long, span long")
    out = shared(hits.groupBy("doc", "row").agg(F.collect_set("span").alias("spans")), "spans")  # a set, as repeated rows name the same
    for table in (named, contents, sizes, packed, known):
        unshare(table)
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_col).alias("row"), as_bytes(text_col).alias("text"))


def _kept(text: bytes | None, spans: list[int] | None) -> tuple[int, list[bytes]]:
    words = words_of(text)
    if not spans:
        return len(words), words
    gone = np.zeros(len(words) + 1, np.int64)
    at = np.array(spans, np.int64)
    np.add.at(gone, at >> 32, 1)
    np.add.at(gone, at & 0xFFFFFFFF, -1)
    return len(words), [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]


def dedup_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows = _rows(docs, id_col, text_col)
    both = rows.join(repeated_spans(rows, **options), ["doc", "row"], "left").select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            n, gone, sha = [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                all_words, kept = _kept(text, spans)
                n.append(all_words)
                gone.append(all_words - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows with their repeated words taken out; texts that lose none stay as they are, and but for few are not shuffled. All rows and columns stay."""
    rows = _rows(docs, id_col, text_col)
    doc, row, lost, whole = (free_name(docs.columns, x) for x in ("span_doc", "span_row", "lost_spans", "whole_text"))
    spans = repeated_spans(rows, **options).select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("spans").alias(lost))
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    losing, whole_ones = parted(docs, F.xxhash64(own, F.xxhash64(text_col)), spans, F.xxhash64(doc, row))
    both = losing.join(spans, (own == F.col(doc)) & (F.xxhash64(text_col) == F.col(row)), "left")
    both = both.withColumn(whole, F.when(F.col(lost).isNotNull(), as_bytes(text_col))).withColumn(text_col, F.when(F.col(lost).isNull(), F.col(text_col)))
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i) for i in range(len(names))]
            texts, cut, spans = cols[at].to_pylist(), batch.column(len(names) + 1).to_pylist(), batch.column(len(names)).to_pylist()
            for i, s in enumerate(spans):
                if s is not None:
                    texts[i] = b" ".join(_kept(cut[i], s)[1]).decode()
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    ordered = both.select(*(F.col(c) for c in names), lost, whole)
    return ordered.mapInArrow(run, docs.schema).unionByName(whole_ones)
