"""The registered query of each operator of this subpackage, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, exact_dedup, jaccard, langid, lmscore, mixing, neardup, quality, secrets, sharding, toxicity, trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.lm_scores(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_sharding, op3_language_id, op4_near_duplicates, op5_mixing, op6_toxicity, op7_quality, op8_exact_dedup, op9_decontamination, op10_secrets, op11_source_divergence, op12_ngram_jaccard, op13_prefix_trie)}


OP8_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body)
"""

#: Windows of ten words, or a whole shorter item, as joined words; a document's words are hit if within one that occurs.
OP9_SQL = r"""
WITH fold AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM fold),
items AS (SELECT id AS item_id, ws, least(len(ws), 10) AS n FROM w WHERE kind = 'b' AND len(ws) > 0),
pats AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS pat FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM pats),
wins AS (SELECT id AS doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS pat
         FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE kind = 'd' AND len(ws) >= n)),
hits AS (SELECT doc_id, i, wins.n, item_id FROM wins JOIN pats ON wins.pat = pats.pat AND wins.n = pats.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered ON covered.doc_id = w.id LEFT JOIN named ON named.doc_id = w.id WHERE kind = 'd'
"""


#: Every group with every kept term of its language; p and q are shares of the group and of the other source or the language.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT rid, lang, source, unnest(ws) AS term FROM d),
keep AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM keep GROUP BY 1),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN keep USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM grp LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT tot.lang, tot.source, keep.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (tot.total + 2 * v) AS BIGINT) AS p,
        CAST(1 + (1000000000::HUGEINT * (keep.n + 2)) // (langs.total + 2 * v) AS BIGINT) AS q
      FROM tot JOIN langs USING (lang) JOIN keep USING (lang) LEFT JOIN c ON c.lang = tot.lang AND c.source = tot.source AND c.term = keep.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


#: Links from all pairs that share a shingle, and what they reach.
OP12_SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT rid, unnest(CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach(a, b) AS (SELECT rid, rid FROM t UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN t ON t.rid = b GROUP BY 1),
many AS (SELECT a AS rid, count(*) AS n_links FROM links GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM t LEFT JOIN n USING (rid) LEFT JOIN least USING (rid) LEFT JOIN many USING (rid)
"""

#: CRC-32 bit by bit; a path is the digests of its turns; each node adds to those that lie on its smallest member's path.
OP13_SQL = """
WITH t AS (SELECT conv_id AS c, length(coalesce(text, '')) AS tok, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS body, turn FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, tok, body, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, body) AS i FROM t),
crc AS (SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
          lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM n)),
head AS (SELECT crc.c, h, count(i) AS k FROM crc LEFT JOIN n ON n.c = base AND i <= h GROUP BY ALL),
r AS (SELECT crc.c, i AS d, body, tok FROM crc JOIN n ON n.c = base AND i <= h
      UNION ALL SELECT c, k + i - h, body, tok FROM n JOIN head USING (c) WHERE i > h
      UNION ALL SELECT c, 0, '', 0 FROM crc),
path AS (SELECT c, d, tok, string_agg(body, '/') OVER (PARTITION BY c ORDER BY d) AS path, max(d) OVER (PARTITION BY c) AS len FROM r),
node AS (SELECT path, d, min(c) AS owner, count(*) AS n_convs, min(tok) AS tok, max(len) = d AS leaf, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '') AS ends FROM path GROUP BY path, d),
up AS (SELECT node.*, above.path AS on_path, above.d AS on_d FROM node JOIN path above ON above.c = owner AND above.d <= node.d),
sums AS (SELECT on_path AS path, sum((n_convs - 1) * tok) AS saved_tokens, count_if(leaf) AS n_leaves, count_if(d = on_d + 1) AS n_children FROM up GROUP BY 1)
SELECT node.owner AS conv_id, node.d AS depth, p.owner AS parent_conv_id, node.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN sums USING (path) LEFT JOIN up ON up.path = node.path AND up.on_d = node.d - 1 LEFT JOIN node p ON p.path = up.on_path
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": OP8_SQL, "op9_decontamination": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_ngram_jaccard": OP12_SQL, "op13_prefix_trie": OP13_SQL}
