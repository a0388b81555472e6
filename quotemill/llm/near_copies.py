"""Near copies by word shingles: groups of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from MinHash: 24 bands of 5 minima, so a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^5)^24 =
0.99993. Equal sets are one node from the start. In a bucket of a band up to ``most`` nodes are all paired. A larger bucket is searched in two steps, and
no pair of it is left out:

1. Nodes are sorted by their next two bands and each is paired with the ``near`` that follow. That joins most of what belongs together, with pairs in
   proportion to the bucket.
2. If the bucket still holds several groups, its nodes go to an exact search by prefixes (Chaudhuri et al. 2006, with the positions of Xiao et al. 2008):
   shingles are put in order of rarity, and of two sets of the asked similarity, the rarest n - ceil(similarity * n) + 1 shingles have one in common. Only
   nodes of different groups are paired there, so a large group of near copies costs no pairs of its own; nor does a shingle that one group alone holds.

Every candidate is verified: the shingles' hashes of both are intersected, and only pairs of the asked similarity link. Groups are what links reach. Only
texts that are in some candidate or in step 2 are read again for their shingles, so no table holds the shingles of all. What step 2 pairs without a link are
texts of different groups that have a rare shingle in common; only a corpus of many such texts makes it slow.

With ``simhash``, documents link by ``simhash_dedup``'s method first: its fingerprint of the asked shingles, its pigeonring search and its distance. These links stand
unverified, as there; the search above adds the pairs of the asked similarity that differ in more bits, and groups are what links of either kind reach.

Edge cases: a null text counts as empty; empty texts are equal; a document of fewer words than a shingle has them all as its
single shingle. Very long texts are hashed whole. Null ids, repeated rows and tied ids are as in ``simhash_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import as_bytes, shared, steps, unshare
from .simhash_dedup import WIDE_FROM, fingerprint, grouped
from .simhash_dedup import links as simhash_links
from .substring_dedup import Hashes, run_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Nodes of a bucket that are all paired; neighbours that a node of a larger bucket is paired with at first.
MOST, NEAR = 12, 4
#: Nodes of a large bucket that one task sorts, about.
TOGETHER = 4096

_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(BANDS * ROWS)], np.uint64)


def shingles(text: bytes | None, size: int, table: Hashes) -> np.ndarray:
    """The different shingles' hashes, sorted; bytes.lower() changes A-Z only."""
    words = (text or b"").lower().split()
    h = np.fromiter((table[w] for w in words), np.uint64, len(words))
    return np.unique(run_hashes(h, min(size, len(h)))) if len(h) else h


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; the band's number is part of it."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024] * _MULTIPLIERS[:, None]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _key(hashes: np.ndarray) -> int:
    """A set's own hash."""
    return xxhash.xxh64_intdigest(hashes.tobytes())


def _bands(docs: DataFrame, id_col: str, text_col: str, size: int, extra: dict[str, Column], simhash: bool = False) -> DataFrame:
    """(doc_id, fp, bands, *extra) of every row; fp is a hash of the set. ``simhash``: also sim, the SimHash fingerprint, after bands."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"), *(c.alias(k) for k, c in extra.items()))
    names = list(extra)
    sims = ["sim"] if simhash else []
    out = rows.select("doc_id", F.lit(0).cast("long").alias("fp"), F.array().cast("array<long>").alias("bands"), *(F.lit(0).cast("long").alias(c) for c in sims), *names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Hashes()
        for part in steps(batches, "text"):
            texts = part.column("text").to_pylist()
            sets = [shingles(t, size, table) for t in texts]
            fp = np.fromiter(map(_key, sets), np.uint64, len(sets)).view(np.int64)
            bands = pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))
            sim = [pa.array(np.fromiter((fingerprint(t, size) for t in texts), np.uint64, len(texts)).view(np.int64)) for _ in sims]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp), bands, *sim, *(part.column(k) for k in names)], names=["doc_id", "fp", "bands", *sims, *names])

    return rows.mapInArrow(run, out)


def _sets(texts: DataFrame, size: int, name: str) -> DataFrame:
    """(name, set): the shingles of texts that are asked for. ``texts``: (name, text)."""
    out = texts.select(name, F.array().cast("array<int>").alias("set")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Hashes()
        for part in steps(batches, "text"):
            # 32 bits tell a pair's shingles apart.
            low = [np.unique(shingles(t, size, table).astype(np.uint32)).view(np.int32) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(name), pa.array(low, pa.list_(pa.int32()))], names=[name, "set"])

    return texts.select(name, "text").mapInArrow(run, out)


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, fp, n1, n2, size) of every bucket of several nodes; n1 and n2 are a node's next two bands."""
    after = lambda k: F.element_at("bands", ((F.col("at") + k) % BANDS + 1).cast("int"))
    keyed = nodes.select("fp", "bands", F.posexplode("bands").alias("at", "key")).select("fp", "key", after(1).alias("n1"), after(2).alias("n2"))
    size = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return keyed.join(size, "key")


def candidates(keyed: DataFrame, most: int = MOST, near: int = NEAR) -> DataFrame:
    """(a, b), a < b: all pairs of small buckets, and neighbours of large ones."""
    spread = F.when(F.col("size") > most, F.pmod("n1", F.ceil(F.col("size") / TOGETHER))).otherwise(0)
    order = Window.partitionBy("key", "part").orderBy("n1", "n2", "fp")
    following = F.when(F.col("size") <= most, F.collect_list("fp").over(order.rowsBetween(1, most - 1))).otherwise(F.collect_list("fp").over(order.rowsBetween(1, near)))
    pairs = keyed.withColumn("part", spread).select("fp", following.alias("others")).select("fp", F.explode("others").alias("other"))
    return pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()


def _alike(x: str, y: str, similarity: float) -> Column:
    common = F.size(F.array_intersect(x, y))
    return common >= similarity * (F.size(x) + F.size(y) - common)


def undecided(large: DataFrame, comp: DataFrame) -> DataFrame:
    """(fp, component) of the nodes of buckets that hold several groups. ``large``: (key, fp)."""
    named = large.join(comp, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("component", "fp").alias("component"))
    several = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    return named.join(several, "key").select("fp", "component").distinct()


def links_by_prefix(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of ``sets`` (fp, component, set) of the asked similarity and of different components."""
    shingle = sets.select("fp", F.size("set").alias("n"), F.explode("set").alias("s"))
    # Shingles of one holder come first in the order and are in no pair, so they only count.
    held = shingle.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ordered = shingle.join(held, "s").groupBy("fp").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "s"))).alias("common"))
    place = ordered.select("fp", "n", F.posexplode("common").alias("i", "x"), (F.col("n") - F.size("common")).alias("alone")).select("fp", "n", "x.s", (F.col("alone") + F.col("i")).alias("at"))
    # The rounding errs towards longer prefixes.
    prefix = place.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-6)).join(sets.select("fp", "component"), "fp")
    prefix = shared(prefix, "shingle-prefixes")
    several = prefix.groupBy("s").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("s")
    prefix_of = prefix.join(several, "s")
    x, y = (prefix_of.select("s", *(F.col(c).alias(f"{c}_{side}") for c in ("fp", "n", "at", "component"))) for side in "xy")
    # What two sets can have in common from their first common shingle on.
    most = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    asked = similarity / (1 + similarity) * (F.col("n_x") + F.col("n_y")) - 1e-6
    pairs = x.join(y, "s").filter((F.col("component_x") < F.col("component_y")) & (most >= asked)).select(F.least("fp_x", "fp_y").alias("a"), F.greatest("fp_x", "fp_y").alias("b")).distinct()
    pairs = shared(pairs, "shingle-pairs")
    a, b = sets.select(F.col("fp").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("fp").alias("b"), F.col("set").alias("set_b"))
    found = shared(pairs.join(a, "a").join(b, "b").filter(_alike("set_a", "set_b", similarity)).select("a", "b"), "shingle-links")
    unshare(prefix)
    unshare(pairs)
    return found


def links_by_simhash(prints: DataFrame, wide: bool = False) -> DataFrame:
    """(a, b): links between nodes whose fingerprints are equal or near, enough to give their groups. ``prints``: (fp, sim), which may repeat."""
    prints = shared(prints.distinct(), "shingle-prints")
    hubs = shared(prints.groupBy("sim").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("nodes")), "shingle-hubs")
    equal = prints.join(hubs.filter("nodes > 1"), "sim").filter("fp != hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    near = simhash_links(hubs.select(F.col("sim").alias("fp")), wide=wide)
    hub_of = lambda side: hubs.select(F.col("sim").alias(side), F.col("hub").alias(f"hub_{side}"))
    near = near.join(hub_of("a"), "a").join(hub_of("b"), "b").filter("hub_a != hub_b").select(F.col("hub_a").alias("a"), F.col("hub_b").alias("b"))
    found = shared(equal.unionByName(near), "simhash-links")
    unshare(prints)
    unshare(hubs)
    return found


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, most: int = MOST, near: int = NEAR, simhash: bool = False, wide_from: int = WIDE_FROM, extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp, *extra, grouped, component_id) of every row, as ``simhash_dedup.near_duplicates`` gives them. ``simhash``: its links count too."""
    extra = extra or {}
    whole = F.xxhash64(*(docs[c] for c in docs.columns))
    rows = shared(_bands(docs, id_col, text_col, shingle, {**extra, "_whole": whole}, simhash), "shingle-bands")
    total = rows.count()
    by_simhash = [links_by_simhash(rows.select("fp", "sim"), total > wide_from)] if simhash else []
    # One row stands for all of equal sets.
    reps = shared(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("_whole").alias("whole"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")), "shingle-nodes")
    keyed = shared(buckets(reps.select("fp", "bands")), "shingle-buckets")
    pairs = shared(candidates(keyed, most, near), "shingle-pairs")
    large = shared(keyed.filter(F.col("size") > most).select("key", "fp"), "shingle-large")
    unshare(keyed)
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("fp"))
    asked = shared(ends.groupBy("fp").agg(F.collect_list(F.struct("a", "b")).alias("pairs")).join(reps.select("fp", "whole"), "fp"), "shingle-asked")
    unshare(pairs)
    # Repeated rows have one hash; only one of them answers.
    hashed = docs.select(whole.alias("whole"), as_bytes(text_col).alias("text"))
    texts = hashed.join(asked, "whole").dropDuplicates(["whole"])
    sent = _sets(texts, shingle, "pairs").select(F.explode("pairs").alias("pair"), "set").select("pair.a", "pair.b", "set")
    both = sent.groupBy("a", "b").agg(F.collect_list("set").alias("sets")).filter(F.size("sets") == 2)
    both = both.select("a", "b", F.element_at("sets", 1).alias("x"), F.element_at("sets", 2).alias("y"))
    verified = shared(both.filter(_alike("x", "y", similarity)).select("a", "b"), "shingle-links")
    links = verified
    unshare(asked)
    for found in by_simhash:
        links = links.unionByName(found)
    comp = components(links)
    rest = shared(undecided(large, comp).join(reps.select("fp", "whole"), "fp"), "shingle-rest")
    if not rest.isEmpty():
        texts = hashed.join(rest.select("whole", "fp"), "whole").dropDuplicates(["whole"])
        sets = shared(_sets(texts, shingle, "fp").join(rest.select("fp", "component"), "fp"), "shingle-sets")
        more = links_by_prefix(sets, similarity)
        unshare(sets)
        if not more.isEmpty():
            comp = components(links.unionByName(more))
        unshare(more)
    for table in (large, verified, rest, *by_simhash):
        unshare(table)
    return grouped(rows.drop("bands", "sim", "_whole"), reps.select("fp", "least", "copies"), comp, total)
