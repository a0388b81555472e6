"""LM scoring 5: stupid-backoff scores from n-gram count tables over the whole corpus.

Documents are dealt into blocks by a hash. A block explodes its texts into n-grams and pre-aggregates them: each different n-gram (as a 64-bit hash) is sent
once per block with its count, packed with others of the same hash range into one row. A range's rows meet in one task, where sorting sums them:
that is the count table of the range. Joined there to what each block asked, it gives every block its n-grams' corpus counts, again one packed row per range and block.
The block joins these to its exploded n-grams and sums per document. So frequent n-grams cost one entry per block, never a hot key, and all that is shuffled follows the input.

A corpus of more than ``most_ranges`` ranges is counted in two levels, else blocks times ranges, and so rows, would grow with its square. Blocks send one row for each of some
square root of the ranges, to their group of blocks; the group sums its blocks' n-grams and asks the ranges itself, and hands the answers down to its blocks. The
rows of a block then grow with the square root of the corpus. The counts are the same.

Score (Brants et al. 2007): the n-gram's count over its context's; if the n-gram does not occur, ``BACKOFF`` times the
score of the n-gram one word shorter; a word that does not occur counts as ``UNSEEN``. The document's own occurrences are taken off all counts,
else every n-gram would be known.

Words are ``[^\\x20\\x09-\\x0D]+``. Edge cases: null and empty texts have no words, log score 0 and a null mean. Equal texts of other rows do count for each
other, as they are in the corpus. Repeated rows are separate documents; they are spread over blocks, as no block holds more than some ``block_bytes`` of rows that are equal. A text longer
than a block is one of its own, worked on whole. A null doc_id is returned as null. Further columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, words_of
from .substring_dedup import Hashes, _mix

BACKOFF, UNSEEN = 0.4, 0.5
ORDER = 2
#: Bytes of text in a block and behind a range of hashes.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 12 << 20
#: Ranges, and so rows of a block, that are asked in one level.
MOST_RANGES = 4096

RESULT = "doc_id long, n_words long, log_score double, mean_log_score double"


def grams(texts: list[bytes | None], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Words per text; for n = 1..order the hash of the n-gram that starts at each word; the document of each word.

    An n-gram that would leave its document has no meaning there; use ``valid``.
    """
    table = Hashes()
    per = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, per), np.int64, len(per))
    h = np.fromiter((table[w] for ws in per for w in ws), np.uint64, int(counts.sum()))
    out, now = [], h
    for n in range(1, order + 1):
        if n > 1:
            full = max(0, len(h) - n + 1)
            now = np.r_[_mix(now[:full], h[n - 1 :]), np.zeros(len(h) - full, np.uint64)]
        out.append(_mix(now, np.full(len(now), np.uint64(n))))
    return counts, out, np.repeat(np.arange(len(per)), counts)


def valid(counts: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which words begin an n-gram of their own document."""
    end = np.cumsum(counts)
    return np.arange(len(doc)) + n <= end[doc]


def planes(x: np.ndarray) -> bytes:
    """Bytes in planes, so that the shuffle's compression sees those that are mostly zero."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def pack_hashes(h: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return planes(np.diff(h, prepend=np.uint64(0)))


def unpack_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<u8"), dtype=np.uint64)


def distinct(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's different n-grams, sorted, and their counts."""
    counts, each, doc = grams(texts, order)
    return np.unique(np.concatenate([g[valid(counts, doc, n)] for n, g in enumerate(each, 1)]), return_counts=True)


def cut_ranges(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash; ascending with the hash."""
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def score_block(texts: list[bytes | None], known: np.ndarray, total: np.ndarray, corpus: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and log score of each text. known: the block's n-grams, sorted; total: their corpus counts."""
    counts, each, doc = grams(texts, order)
    if not len(doc):
        return counts, np.zeros(len(counts))
    at = np.arange(len(doc))
    rest = []  # per order: corpus count of the n-gram that starts here, without its own document
    for n, g in enumerate(each, 1):
        ok = valid(counts, doc, n)
        place = np.searchsorted(known, g[ok])
        _, inverse, own = np.unique(doc[ok] * len(known) + place, return_inverse=True, return_counts=True)
        r = np.zeros(len(doc), np.int64)
        r[ok] = total[place] - own[inverse]
        rest.append(r)
    others = np.maximum(corpus - counts, 1)[doc].astype(float)
    score = np.where(rest[0] > 0, rest[0], UNSEEN) / others
    first = (np.cumsum(counts) - counts)[doc]
    for n in range(2, order + 1):  # of the n-gram that ends here
        start = at - (n - 1)
        ok = np.flatnonzero(start >= first)
        seen = rest[n - 1][start[ok]]
        context = rest[n - 2][start[ok]]
        score[ok] = np.where(seen > 0, seen / np.maximum(context, 1), BACKOFF * score[ok])
    return counts, np.bincount(doc, np.log(score), len(counts))


def _deal(rows: DataFrame, blocks: int, block_bytes: int) -> DataFrame:
    """Adds the block of each row. Equal rows go on to another block after ``block_bytes``; which of them does, does not depend on the order of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, int] = {}
        for batch in batches:
            block = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h = xxhash.xxh3_64_intdigest(text or b"", hash(doc) & 0xFFFFFFFF)
                before = sent.get(h, 0)
                sent[h] = before + len(text or b"") + 16
                block.append(xxhash.xxh3_64_intdigest(h.to_bytes(8, "little"), before // block_bytes) % blocks)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(block, pa.int32())], names=["doc_id", "text", "block"])

    return rows.mapInArrow(run, "doc_id long, text binary, block int")


def _summed(part: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The different n-grams of packed rows, sorted, their summed counts, and the n-grams of each row."""
    hashes = [unpack_hashes(x) for x in part.column("hashes").to_pylist()]
    every, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    counts = np.concatenate([from_planes(x, "<u8") for x in part.column("counts").to_pylist()])
    total = np.zeros(len(every), np.uint64)
    np.add.at(total, inverse, counts)
    return every, total, hashes


def _asked(h: np.ndarray, n: np.ndarray, of: np.ndarray, who: int) -> dict[str, pa.Array]:
    """A packed row for each range that has n-grams. h: sorted; of: the range of each."""
    edges = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(h)] if len(h) else np.zeros(1, np.int64)
    cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    return {
        "bin": pa.array([int(of[a]) for a, _ in cuts], pa.int32()), "block": pa.array([who] * len(cuts), pa.int32()),
        "hashes": pa.array([pack_hashes(h[a:b]) for a, b in cuts], pa.binary()), "counts": pa.array([planes(n[a:b].astype("<u8")) for a, b in cuts], pa.binary()),
    }


def _totals(answers: pa.Table) -> np.ndarray:
    """The answers to all that was asked, in the order of the n-grams."""
    by = sorted(zip(answers.column("bin").to_pylist(), answers.column("totals").to_pylist(), strict=True))
    return np.concatenate([from_planes(x, "<u8") for _, x in by]).astype(np.int64) if by else np.zeros(0, np.int64)


ASKED, ANSWERED = "bin int, block int, hashes binary, counts binary", "block int, bin int, totals binary"


def _answers(asked: DataFrame) -> DataFrame:
    """The count tables: each range sums what was asked of it, and answers with the sums."""

    def answer(part: pa.Table) -> pa.Table:
        every, total, hashes = _summed(part)
        out = [planes(total[np.searchsorted(every, h)]) for h in hashes]
        return pa.table({"block": part.column("block"), "bin": part.column("bin"), "totals": pa.array(out, pa.binary())})

    return asked.groupBy("bin").applyInArrow(answer, ANSWERED)


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, most_ranges: int = MOST_RANGES) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score (per word) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    size, corpus = _sizes(rows)
    blocks, ranges = (max(1, -(-size // x)) for x in (block_bytes, range_bytes))
    coarse = ranges if ranges <= most_ranges else math.isqrt(ranges - 1) + 1
    fine = -(-ranges // coarse)  # ranges of a coarse one
    ranges = coarse * fine
    together = -(-blocks // coarse)  # blocks of a group
    dealt = _deal(rows, blocks, block_bytes).repartition(min(blocks, 20_000), "block")

    def ask(part: pa.Table) -> pa.Table:
        h, n = distinct(part.column("text").to_pylist(), order)
        return pa.table(_asked(h, n, cut_ranges(h, ranges) // fine, part.column("block")[0].as_py()))

    asked = dealt.groupBy("block").applyInArrow(ask, ASKED)
    if fine == 1:
        answers = _answers(asked)
    else:
        grouped = asked.withColumn("above", F.floor(F.col("block") / together).cast("int"))

        def merge(part: pa.Table) -> pa.Table:
            every, total, _ = _summed(part)
            return pa.table(_asked(every, total, cut_ranges(every, ranges), part.column("above")[0].as_py()))

        def hand_down(left: pa.Table, right: pa.Table) -> pa.Table:
            every, _, hashes = _summed(left)
            total = _totals(right).astype("<u8")
            out = [planes(total[np.searchsorted(every, h)]) for h in hashes]
            return pa.table({"block": left.column("block"), "bin": left.column("bin"), "totals": pa.array(out, pa.binary())})

        above = _answers(grouped.groupBy("bin", "above").applyInArrow(merge, ASKED)).withColumn("coarse", F.floor(F.col("bin") / fine).cast("int"))
        answers = grouped.groupBy("bin", "above").cogroup(above.groupBy("coarse", "block")).applyInArrow(hand_down, ANSWERED)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("text").to_pylist()
        h, _ = distinct(texts, order)
        n, score = score_block(texts, h, _totals(right), corpus, order)
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(n, pa.int64()), "log_score": pa.array(score, pa.float64()), "mean_log_score": pa.array([s / k if k else None for s, k in zip(score.tolist(), n.tolist(), strict=True)], pa.float64())})

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, RESULT)


def _sizes(rows: DataFrame) -> tuple[int, int]:
    """Bytes (and 16 for each row) and words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = words = 0
        for batch in batches:
            for t in batch.column("text").to_pylist():
                size += len(t or b"") + 16
                words += len(words_of(t))
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([words], pa.int64())], names=["size", "words"])

    both = rows.select("text").mapInArrow(run, "size long, words long").agg(F.sum("size"), F.sum("words")).first()
    return both[0] or 0, both[1] or 0
