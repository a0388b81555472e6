"""Quality rules 7: how much of a document repeats itself, from a suffix array of its words.

Every document's words are put into a suffix array (prefix doubling, many documents at a time, each apart from the
others). Runs of the longest-common-prefix array, its LCP intervals, are the maximal repeated word sequences. The spans of all their
occurrences are united; a document fails if the union covers too large a fraction of its words, or if one repeat is
too long.

Edge cases: a null text has no words; such, empty and short documents fail the base rule (fewer than 50 words).
Repeated rows get equal results each; further columns of the input do not matter; an empty table gives no rows.
Long texts are worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Ids, as_bytes, steps, words_of

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
_NOT_COUNTED = SPACE + bytes(range(0x80, 0xC0))
MIN_WORDS = 50
WINDOW = 3
#: A repeat counts from so many words on; the most of the words that repeats may cover; the longest repeat allowed.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 8, 0.4, 100

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
    T.StructField("repeat_covered", T.LongType()), T.StructField("longest_repeat", T.LongType()),
])


def match_lengths(token: np.ndarray, doc: np.ndarray, least: int = WINDOW) -> np.ndarray:
    """For each position, the words that its suffix shares with the most similar other suffix of its document.

    0 where fewer than ``least`` words are shared. ``token``: small integers; ``doc``: ascending document numbers.
    The array is sparse: only positions whose first ``least`` words occur elsewhere in the document are sorted.
    """
    n = len(token)
    out = np.zeros(n, np.int64)
    if n < least + 1:
        return out
    end = np.searchsorted(doc, doc, side="right")
    at = np.arange(n)
    whole = np.flatnonzero(at + least <= end)
    rank = _dense(doc * (int(token.max()) + 1) + token)
    first = rank
    for k in range(1, least):  # ranks of the first `least` words
        nxt = np.full(n, -1, np.int64)
        ok = at + k < end
        nxt[ok] = first[at[ok] + k]
        rank = _dense(rank * (n + 2) + nxt + 1)
    # The rank of a position: how many positions have smaller first words; ranks of all positions are comparable.
    count = np.bincount(rank, minlength=n)
    level = (np.cumsum(count) - count)[rank]
    live = whole[count[rank[whole]] > 1]
    if not len(live):
        return out
    levels, h = [level], least  # levels[j][p]: rank by the first least * 2**j words
    while True:
        now = levels[-1]
        nxt = np.full(len(live), -1, np.int64)
        ok = live + h < end[live]
        nxt[ok] = now[live[ok] + h]
        by = np.lexsort((nxt, now[live]))
        group, second, i = now[live[by]], nxt[by], np.arange(len(live))
        old = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], i, 0))
        fresh = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        if fresh.all():
            order = live[by]
            break
        level = now.copy()
        level[live[by]] = group + np.maximum.accumulate(np.where(fresh, i, 0)) - old
        levels.append(level)
        h *= 2
    # Longest common prefixes of neighbours in the suffix array, by descent through the levels.
    a, b = order[:-1].copy(), order[1:].copy()
    same = doc[a] == doc[b]
    lcp = np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        hop = least << j
        ok = same & (a < n) & (b < n)
        ok[ok] = (a[ok] < end[order[:-1][ok]]) & (b[ok] < end[order[1:][ok]])
        ok[ok] = levels[j][a[ok]] == levels[j][b[ok]]
        lcp[ok] += hop
        a[ok] += hop
        b[ok] += hop
    going = same & (lcp >= least)
    for _ in range(least - 1):
        going &= (a < end[order[:-1]]) & (b < end[order[1:]])
        ok = np.flatnonzero(going)
        eq = token[a[ok]] == token[b[ok]]
        going[ok[~eq]] = False
        ok = ok[eq]
        lcp[ok] += 1
        a[ok] += 1
        b[ok] += 1
    lcp[lcp < least] = 0
    best = np.zeros(len(order), np.int64)
    best[:-1] = lcp
    best[1:] = np.maximum(best[1:], lcp)
    out[order] = best
    return out


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1].astype(np.int64)


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + lengths, -1)
    return np.cumsum(d[:-1]) > 0


def measure(texts: list[bytes | None], min_repeat: int) -> dict[str, np.ndarray]:
    """The measures of several documents at once."""
    ids = Ids()
    per = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, per), np.int64, len(per))
    token = np.fromiter((ids[w] for ws in per for w in ws), np.int64, int(counts.sum()))
    doc = np.repeat(np.arange(len(per)), counts)
    match = match_lengths(token, doc)
    n = len(token)
    total = lambda mask: np.bincount(doc[mask], minlength=len(per))
    win, rep = np.flatnonzero(match >= WINDOW), np.flatnonzero(match >= min_repeat)
    longest = np.zeros(len(per), np.int64)
    np.maximum.at(longest, doc[rep], match[rep])
    dup = []
    for t in texts:
        lines = [x for x in (t or b"").split(b"\n") if x.strip(SPACE)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": counts,
        "word_chars": np.array([len((t or b"").translate(None, _NOT_COUNTED)) for t in texts], np.int64),
        "n_symbols": np.array([len(t or b"") - len((t or b"").translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": total(covered(win, np.full(len(win), WINDOW), n)),
        "repeat_covered": total(covered(rep, match[rep], n)),
        "longest_repeat": longest,
    }


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Measures and verdict of every document: one row each, of ``SCHEMA``. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            m = measure(part.column("text").to_pylist(), min_repeat)
            failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            kept = ~failed & (m["repeat_covered"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_repeat)
            cols = [part.column("doc_id"), *(m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed, kept, m["repeat_covered"], m["longest_repeat"]]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=SCHEMA.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, *, text_col: str = "text", min_words: int = MIN_WORDS, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The documents that pass, with all their columns. Row by row, so no join or shuffle."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            batch = batch.rename_columns([f"c{i}" for i in range(len(names))])  # names may clash
            for part in steps([batch], f"c{at}"):
                texts = part.column(f"c{at}").cast(pa.large_binary()).to_pylist()
                m = measure(texts, min_repeat)
                ok = (m["n_words"] >= min_words) & (100 * m["n_repeat_words"] <= 50 * m["n_words"]) & (m["repeat_covered"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_repeat)
                yield part.filter(pa.array(ok)).rename_columns(names)

    return docs.mapInArrow(run, schema)
