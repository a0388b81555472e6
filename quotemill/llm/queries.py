"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import importable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import hex_of, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality

    return quality(table(spark, sf_dir, "documents"))


#: Words in repeated windows are the union of what repeats cover; the longest repeat is the longest run of equal windows at one distance.
ORACLE_SQL["op7_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
g AS (
  SELECT doc_id, i, CASE WHEN i + 2 <= n THEN string_agg(word, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) END AS g3,
    CASE WHEN i + 7 <= n THEN string_agg(word, ' ') OVER (o ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS g8
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (
  SELECT doc_id, i, g8, g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS r3, g8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g8) > 1 AS r8 FROM g),
c AS (SELECT doc_id, max(r3::INTEGER) OVER (o ROWS 2 PRECEDING) AS c3, max(r8::INTEGER) OVER (o ROWS 7 PRECEDING) AS c8 FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
per AS (SELECT doc_id, count(*) AS n_words, sum(c3)::BIGINT AS n_repeat_words, sum(c8)::BIGINT AS repeat_covered FROM c GROUP BY 1),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS apart FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.g8 = b.g8 AND a.i < b.i WHERE a.r8),
stretch AS (SELECT doc_id, apart, i - row_number() OVER (PARTITION BY doc_id, apart ORDER BY i) AS s FROM pairs),
longest AS (SELECT doc_id, max(n) + 7 AS longest_repeat FROM (SELECT doc_id, count(*) AS n FROM stretch GROUP BY doc_id, apart, s) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(repeat_covered, 0) AS repeat_covered, coalesce(longest_repeat, 0) AS longest_repeat
  FROM d LEFT JOIN per USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 10 * repeat_covered <= 4 * n_words AND longest_repeat <= 100 AS kept FROM f"""


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_report

    return dedup_report(table(spark, sf_dir, "documents"))


ORACLE_SQL["op1_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
g AS (SELECT doc_id, i, n, word, CASE WHEN i + 49 <= n THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS h FROM w),
first AS (SELECT h, min(doc_id) AS least FROM g WHERE h IS NOT NULL GROUP BY 1),
hit AS (SELECT g.*, coalesce(least < doc_id, false) AS gone FROM g LEFT JOIN first USING (h)),
kept AS (SELECT doc_id, i, word, coalesce(max(gone::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING), 0) = 1 AS removed FROM hit),
per AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT removed), '')) AS kept_sha256 FROM kept GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN per USING (doc_id)"""


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import manifest

    return manifest(table(spark, sf_dir, "documents"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("score", F.round("score", 6))


#: BM25 without an index: every passage against every item that shares a word with it.
ORACLE_SQL["op8_decontamination"] = r"""
WITH raw AS (
  SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws,
    list_filter([regexp_extract_all(lower(x), '[a-z0-9\x{80}-\x{10FFFF}]+') FOR x IN string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))], lambda x: len(x) > 0) AS parts
  FROM benchmark WHERE text IS NOT NULL),
items AS (
  SELECT item_id, ws, len(ws) AS n, CASE WHEN len(ws) <= 64 THEN 64 ELSE 64 * (1 << ceil(log2(ceil(len(ws) / 64)))::INTEGER) END AS cell, least(5, len(ws)) AS size,
    list_distinct(CASE WHEN len(parts) > 1 THEN parts[-1] ELSE parts[1][-greatest(1, len(parts[1]) // 3):] END) AS answer
  FROM raw WHERE len(ws) > 0),
tf AS (SELECT item_id, n, cell, word, count(*) AS c FROM (SELECT item_id, n, cell, unnest(ws) AS word FROM items) GROUP BY ALL),
df AS (SELECT word, count(*) AS f FROM tf GROUP BY 1),
every AS (SELECT count(*) AS items, avg(n) AS mean FROM items),
weight AS (SELECT item_id, cell, word, ln(1 + (items - f + 0.5) / (f + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / mean)) AS x FROM tf JOIN df USING (word), every),
share AS (SELECT item_id, cell, word, x / sum(x) OVER (PARTITION BY item_id) AS x FROM weight),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents WHERE text IS NOT NULL)),
spot AS (
  SELECT doc_id, cell, i, word, unnest(CASE WHEN i >= cell THEN [i // cell, i // cell - 1] ELSE [0] END) AS passage
  FROM w, (SELECT DISTINCT cell FROM items)),
held AS (SELECT DISTINCT doc_id, cell, passage, word FROM spot),
found AS (SELECT doc_id, item_id, cell, passage, round(sum(x), 9) AS score FROM held JOIN share USING (cell, word) GROUP BY ALL HAVING sum(x) >= 0.6 - 1e-9),
shingle AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + size - 1], ' ') AS s FROM (SELECT item_id, ws, size, unnest(range(1, n - size + 2)) AS i FROM items)),
passages AS (SELECT doc_id, cell, passage, list(word ORDER BY i) AS ws FROM spot SEMI JOIN found USING (doc_id, cell, passage) GROUP BY ALL),
sizes AS (SELECT DISTINCT doc_id, cell, passage, size FROM found JOIN items USING (item_id, cell)),
runs AS (SELECT DISTINCT doc_id, cell, passage, size, array_to_string(ws[i:i + size - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM passages JOIN sizes USING (doc_id, cell, passage))),
whole AS (
  SELECT f.doc_id, f.item_id, f.cell, f.passage, f.score, count(r.s) / count(*) AS item_overlap
  FROM found f JOIN items USING (item_id) JOIN shingle USING (item_id) LEFT JOIN runs r ON r.doc_id = f.doc_id AND r.cell = f.cell AND r.passage = f.passage AND r.size = items.size AND r.s = shingle.s GROUP BY ALL),
answered AS (
  SELECT whole.*, len(list_intersect(answer, passages.ws)) / len(answer) AS answer_overlap
  FROM whole JOIN items USING (item_id) JOIN passages ON passages.doc_id = whole.doc_id AND passages.cell = whole.cell AND passages.passage = whole.passage)
SELECT doc_id, item_id, round(score, 6) AS score, item_overlap, answer_overlap, passage FROM answered WHERE item_overlap >= 0.8 AND answer_overlap >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY item_overlap DESC, score DESC, passage) = 1"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


@query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_scores

    return lm_scores(table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("mean_log_score", 6).alias("mean_log_score"))


#: Stupid backoff of order 2; the document's own occurrences are taken off.
ORACLE_SQL["op5_lm_scoring"] = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL)),
total AS (SELECT count(*) AS n FROM w),
b AS (SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w),
u1 AS (SELECT word, count(*) AS c FROM w GROUP BY 1), o1 AS (SELECT doc_id, word, count(*) AS c FROM w GROUP BY 1, 2),
u2 AS (SELECT before, word, count(*) AS c FROM b WHERE before IS NOT NULL GROUP BY 1, 2),
o2 AS (SELECT doc_id, before, word, count(*) AS c FROM b WHERE before IS NOT NULL GROUP BY 1, 2, 3),
size AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
s AS (
  SELECT b.doc_id, CASE
    WHEN u2.c > o2.c THEN (u2.c - o2.c) / greatest(p.c - op.c, 1)
    ELSE CASE WHEN b.before IS NULL THEN 1 ELSE 0.4 END * CASE WHEN u1.c > o1.c THEN u1.c - o1.c ELSE 0.5 END::DOUBLE / greatest(total.n - size.n, 1) END AS score
  FROM b JOIN total ON true JOIN size USING (doc_id) JOIN u1 ON u1.word = b.word JOIN o1 ON o1.doc_id = b.doc_id AND o1.word = b.word
  LEFT JOIN u2 ON u2.before = b.before AND u2.word = b.word LEFT JOIN o2 ON o2.doc_id = b.doc_id AND o2.before = b.before AND o2.word = b.word
  LEFT JOIN u1 p ON p.word = b.before LEFT JOIN o1 op ON op.doc_id = b.doc_id AND op.word = b.before),
scored AS (SELECT doc_id, count(*) AS n_words, round(sum(ln(score)) / count(*), 6) AS mean_log_score FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, mean_log_score FROM documents d LEFT JOIN scored USING (doc_id)"""


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import dialogues

    span = F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return dialogues(table(spark, sf_dir, "conversations")).select("conv_id", "speaker", "part", "n_messages", "text", F.array_join(span, " ").alias("spans"))


ORACLE_SQL["op3_chat_format"] = r"""
WITH r AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1) // 512 AS part
  FROM (SELECT conv_id, turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '\s+', '_', 'g') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations)),
v AS (
  SELECT r.*, w.speaker, CASE WHEN role = w.speaker THEN '<|im_start|>assistant' WHEN role = 'system' THEN '<|im_start|>system' ELSE '<|im_start|>user name=' || role END || chr(10) AS head
  FROM r JOIN (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system') w ON r.conv_id IS NOT DISTINCT FROM w.conv_id),
o AS (
  SELECT *, row_number() OVER k AS i, sum(length(head) + length(text) + 11) OVER (k ROWS UNBOUNDED PRECEDING) AS stop
  FROM v WINDOW k AS (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS LAST, role, text))
SELECT conv_id, speaker, part, count(*) AS n_messages, string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY i) AS text,
  coalesce(string_agg((stop - 11 - length(text))::BIGINT || '-' || (stop - 1)::BIGINT, ' ' ORDER BY i) FILTER (role = speaker), '') AS spans
FROM o GROUP BY 1, 2, 3"""
