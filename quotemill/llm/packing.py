"""Packing 2: shortest-pack-first histogram packing of token sequences.

A document's ids are cut into full sequences and one rest of 1 to 2047 ids; where pieces are cut depends on the
document alone, so each text is tokenised once and no ids are shuffled or kept. The lengths of all rests make a histogram of at
most 2047 counts. Shortest-pack-first (Krell et al. 2021) places its lengths longest first, each into the shortest
open packs, by updating counts of packing patterns, not of packs. What a pattern still lacks is known only after
that, so the last packs may stay short. Then patterns are joined back to documents by rank: the k-th rest of a length
takes the k-th place for that length. Ranks come from counts of buckets, as many as the pieces ask for, so a length that a third of all documents have is the
work of many tasks. The histogram and the patterns are bounded by the sequence length, whatever the corpus.

Edge cases: a null text is an empty one, whose only id is the end id. Repeated rows and tied or null ids are packed
as separate documents; very long texts are tokenised whole. Further columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranks_in_groups, salted, shared, steps

LENGTH, END = 2048, 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts as ``tokenizers`` gives them for the file, without special tokens added.

    Byte-level BPE with the plain ranks of the file's vocabulary gives the same ids several times faster; it is
    built from the same file, and used only for texts without the file's special strings. A file of another kind, or
    one whose ids differ on a probe, is left to ``tokenizers``.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    plain = lambda texts: [slow.encode(t, add_special_tokens=False).ids for t in texts]
    try:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            return plain
        special = [t["content"] for t in spec.get("added_tokens", ())]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        ranks = {bytes(back[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("bpe", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
        probe = ["It's  a\n\n test,\tof 1234 Wörter — ñandú!!  　x", " \n ", "aaaaaaaa", ""]
        if [fast.encode_ordinary(t) for t in probe] != plain(probe):
            return plain
    except (ImportError, KeyError, TypeError, ValueError):
        return plain

    def ids(text: str) -> list[int]:
        if any(s in text for s in special):
            return plain([text])[0]
        try:
            return fast.encode_ordinary(text)
        except BaseException as e:  # the regex engine gives up on extreme texts
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return plain([text])[0]

    return lambda texts: [ids(t) for t in texts]


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of each document: ``PIECES``. No shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for part in steps(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.array([*encode([text])[0], end], "<u4")
                for at in range(0, len(ids), length):
                    cut = ids[at : at + length]
                    out.append((doc, at, len(cut), zlib.crc32(cut.tobytes()), len(ids)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(run, PIECES)


def pack(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns [(how many packs, lengths)], longest length first, each into the shortest packs that are open."""
    filled = [0]  # used lengths that have open packs, as a heap
    open_packs: dict[int, list[list]] = defaultdict(list)  # used length: [[count, lengths], ...]
    out: list[tuple[int, tuple[int, ...]]] = []
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            while filled and not open_packs.get(filled[0]):
                open_packs.pop(heapq.heappop(filled), None)
            if not filled or filled[0] + size > length:  # not even the shortest packs take it: new ones
                at, count, held, many = 0, left, (), left
            else:
                at = filled[0]
                many, held = open_packs[at].pop()
                count = min(left, many)
                if many > count:
                    open_packs[at].append([many - count, held])
            left -= count
            now = at + size
            if now == length:
                out.append((count, (*held, size)))
            else:
                if not open_packs.get(now):
                    heapq.heappush(filled, now)
                open_packs[now].append([count, (*held, size)])
    for groups in open_packs.values():
        out += [(count, held) for count, held in groups]
    return sorted(out, key=lambda x: (-sum(x[1]), x[1], x[0]))


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """length -> (first ranks, sequence ids less first ranks, offsets) of its runs of places."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = defaultdict(lambda: ([], [], []))
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for count, held in patterns:
        offset = 0
        for size in held:
            first, seq, off = out[size]
            first.append(taken[size])
            seq.append(base - taken[size])
            off.append(offset)
            taken[size] += count
            offset += size
        base += count
    return dict(out)


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """Every piece with its sequence_id and offset; sequence ids are gapless."""
    cut = pieces(docs, tokenizer, id_col=id_col, text_col=text_col, length=length, end=end)
    cut = shared(salted(cut, "salt", "doc_id", "start", "ids_crc32"), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `length` rows
    full = histogram.pop(length, 0)
    where = places([(full, (length,)), *pack(histogram, length)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("length").to_pylist(), batch.column("rank").to_pylist()
            seq, off = [], []
            for s, r in zip(size, rank, strict=True):
                first, base, offset = where[s]
                k = bisect_right(first, r) - 1
                seq.append(base[k] + r)
                off.append(offset[k])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = ranks_in_groups(cut, "length", "salt", "rank")
    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
