"""SimHash near-duplicates 6, with pigeonring filtering.

Fingerprints: a bit is 1 if it is set in over half the XXH64 values (seed 42) of a document's lower-cased 3-word
shingles, repeats included. Documents link where fingerprints differ in at most 3 bits; groups are what links reach.

Search. Equal fingerprints are one representative from the start, so copies are never paired. The 64 bits form a
ring of 4 segments. By the pigeonring principle (Qin and Xiao 2018) two fingerprints within distance t have a start
from which every chain of k consecutive segments differs in at most k * t / 4 bits: 0, 1, 2, 3 for t = 3. So a
candidate shares a whole segment and, as the next may differ in one bit, one of its halves: 24 bits, 8 tables, an
equi-join. Of more than ``wide_from`` rows, the third segment joins the key: the second and third differ in two bits at most and the second in one, so a candidate shares
two of their four halves in one of 5 ways: 32 bits, 20 tables. Either way the links found are all links. The whole chain condition then prunes candidates before the full Hamming check.

A bucket of a table with over ``most`` representatives is not paired. There the rest of the search is linear:
within it, a and b lie within 3 bits just if some x has distance <= 1 from a and <= 2 from b, so every representative
names the words of up to 2 flips among its 40 free bits (32 of wide keys), and all that share a name with a flip-1 member link to it
(each of them is within 3 of it). That finds all groups, with no pairs of a bucket.

Edge cases: a null text counts as empty; an empty text has fingerprint 0 and links like any other; a document of one
or two words has them all as its single shingle. A null doc_id keeps its row; it never names a component unless the
component has no other id. Very long texts are hashed whole. Repeated rows and tied ids stay as they are. Further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import as_bytes, free_name, join_hot, shared, steps, unshare

SEED, SHINGLE, DISTANCE, SEGMENTS, SEGMENT = 42, 3, 3, 4, 16
#: Halves of the second and third segment (numbers of bytes after the first) that a table's key holds besides the first segment.
NARROW, WIDE = ((2,), (3,)), ((2, 3), (3, 4), (3, 5), (2, 4), (2, 5))
#: Rows from which wide keys pay: some 4 of a narrow key's bucket.
WIDE_FROM = 1 << 26
#: Representatives of one bucket that are compared by an equi-join.
MOST = 1024


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of UTF-8 text; bytes.lower() changes A-Z only."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    count = len(words) - size + 1
    hashes = [xxhash.xxh64_intdigest(whole[i:j], SEED) for i, j in zip(starts[:count].tolist(), ends[size - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for at in range(0, count, 4096):
        total += np.unpackbits(np.array(hashes[at : at + 4096], ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp long, *extra) of every row. No shuffle."""
    extra = extra or {}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"), *(c.alias(k) for k, c in extra.items()))
    names = list(extra)
    out = rows.select("doc_id", F.lit(0).cast("long").alias("fp"), *names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text", 8 << 20):
            fp = np.fromiter((fingerprint(t) for t in part.column("text").to_pylist()), np.uint64, part.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp), *(part.column(k) for k in names)], names=["doc_id", "fp", *names])

    return rows.mapInArrow(run, out)


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 64 - SEGMENT * (i % SEGMENTS + 1)).bitwiseAND(F.lit(0xFFFF))


def _tables(wide: bool) -> list[tuple[int, ...]]:
    """The bytes of a fingerprint (0 is the highest) that each table's key is made of; those of one start follow each other."""
    return [tuple((2 * i + k) % 8 for k in (0, 1, *more)) for i in range(SEGMENTS) for more in (WIDE if wide else NARROW)]


def _table_keys(fp: Column, tables: list[tuple[int, ...]]) -> Column:
    """An array of longs, one of each table: its number above the bytes."""
    byte = lambda k: F.shiftrightunsigned(fp, 56 - 8 * k).bitwiseAND(F.lit(0xFF))
    return F.array(*(sum((F.shiftleft(byte(k), 8 * n) for n, k in enumerate(of)), F.lit(t << 8 * len(of)).cast("long")).cast("long") for t, of in enumerate(tables)))


def _chain_holds(differ: Column, start: int) -> Column:
    """Whether all chains from a segment stay within their share of the distance."""
    seen, ok = F.lit(0), F.lit(True)
    for k in range(1, SEGMENTS + 1):
        seen = seen + F.bit_count(_segment(differ, start + k - 1))
        ok = ok & (seen <= k * DISTANCE // SEGMENTS)
    return ok


def links(fps: DataFrame, most: int = MOST, wide: bool = False) -> DataFrame:
    """(a, b): links between distinct fingerprints in column ``fp``, enough to give the same groups as all links."""
    tables = _tables(wide)
    bits = 8 * len(tables[0])
    keyed = fps.select("fp", F.explode(_table_keys(F.col("fp"), tables)).alias("key"))
    size = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    keyed = shared(keyed.join(size, "key"), "simhash-keys")
    few = keyed.filter(F.col("size") <= most)
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    table = F.shiftright("key", bits).cast("int")
    # A pair is named once: by the first start whose chains hold, and the first table of that start that it shares.
    pruned, earlier = F.lit(False), F.lit(False)
    each = len(tables) // SEGMENTS
    for i in range(SEGMENTS):
        holds, named, before = _chain_holds(x, i), F.lit(False), F.lit(False)
        for t in range(i * each, (i + 1) * each):
            agrees = x.bitwiseAND(F.lit(_signed(sum(0xFF << (56 - 8 * k) for k in tables[t])))) == 0
            named = named | ((table == t) & ~before)
            before = before | agrees
        pruned = pruned | (holds & ~earlier & named)
        earlier = earlier | holds
    near = a.join(b, "key").filter((F.col("a") < F.col("b")) & pruned).filter(F.bit_count(x) <= DISTANCE).select("a", "b")
    return near.unionByName(_links_in_large_buckets(keyed.filter(F.col("size") > most), tables))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links_in_large_buckets(keyed: DataFrame, tables: list[tuple[int, ...]]) -> DataFrame:
    masks, bits = [], 8 * len(tables[0])
    for of in tables:
        free = [1 << (63 - p) for p in range(64) if p // 8 not in of]
        masks.append([0, *free, *(p | q for p, q in combinations(free, 2))])
    flips, near = np.array(masks, np.uint64), 1 + len(free)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                key, fp = (part.column(k).to_numpy() for k in ("key", "fp"))
                word = fp.view(np.uint64)[:, None] ^ flips[key >> bits]
                n = word.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key >> bits, n)), pa.array(word.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, n)), pa.array(np.tile(np.arange(n) < near, len(fp)))], names=["table", "word", "fp", "hub"])

    named = keyed.select("key", "fp").mapInArrow(run, "table long, word long, fp long, hub boolean")
    groups = named.groupBy("table", "word").agg(F.min(F.when(F.col("hub"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("fps"))  # 821 at most
    return groups.filter(F.col("a").isNotNull() & (F.size("fps") > 1)).select("a", F.explode("fps").alias("b")).filter("a != b").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, wide_from: int = WIDE_FROM, extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp long, *extra, grouped long, component_id) for every row.

    component_id: the smallest doc_id reachable; grouped: the group's least fingerprint, which tells groups apart even where doc_ids are not unique.
    """
    rows = shared(fingerprints(docs, id_col=id_col, text_col=text_col, extra=extra), "simhash")
    total = rows.count()
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    comp = components(links(reps.select("fp"), most, total > wide_from))
    return grouped(rows, reps, comp, total)


def grouped(rows: DataFrame, reps: DataFrame, comp: DataFrame, total: int) -> DataFrame:
    """``rows`` (doc_id, fp, ...), all ``total`` of them, with grouped and component_id. ``reps``: (fp, least doc_id, copies); ``comp``: what links reach."""
    named = shared(reps.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("grouped")), "simhash-nodes")
    least = named.groupBy("grouped").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    by_fp = shared(join_hot(named.drop("least"), least, "grouped", "nodes", named.count()), "simhash-groups")
    unshare(named)
    return join_hot(rows, by_fp, "fp", "copies", total)


def hex_of(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", grouping: Callable[..., DataFrame] = near_duplicates, **options: float) -> DataFrame:
    """One document of each group, with all its columns: the one of the smallest doc_id, ties by a hash of the row.

    ``grouping``: what finds the groups, with its options.
    """
    tag, key, own_key, own_tag = (free_name(docs.columns, x) for x in ("row_tag", "row_key", "kept_key", "kept_tag"))
    whole = F.xxhash64(*(docs[c] for c in docs.columns))
    groups = grouping(docs, id_col=id_col, text_col=text_col, extra={"tag": whole}, **options)
    # Rows that have no id lose to any other; a hash stands for "no id", and the tag tells rows apart.
    key_of = lambda c: F.xxhash64(c.cast("long"))
    best = groups.groupBy("grouped").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("best")).select(key_of(F.col("best.doc_id")).alias(own_key), F.col("best.tag").alias(own_tag))
    # Join and distinct use the same two columns, so texts are shuffled once.
    kept = docs.withColumn(tag, whole).withColumn(key, key_of(F.col(id_col))).join(best, (F.col(key) == F.col(own_key)) & (F.col(tag) == F.col(own_tag))).drop(own_key, own_tag)
    return kept.dropDuplicates([key, tag]).drop(key, tag)
